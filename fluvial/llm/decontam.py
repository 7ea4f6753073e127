"""Benchmark decontamination with broadcast sets of normalised test n-grams.

A benchmark item's windows are all runs of ``size`` of its words (one shorter
window if it has fewer). A scan of each document looks its windows up in a set
of window hashes; hits are compared with the windows themselves.

A small benchmark (``most_windows`` distinct windows) puts exact sets into the
plan, which Spark sends to each executor once: the windows' anchors (each
window's longest word), which a first scan looks for, and hashes and texts. A
larger one is a table of window hashes, broadcast while it has at most
``most_hashes`` rows (about 50 bytes each) and shuffled beyond that: documents,
written once with row numbers, give a row (number, start, length, hash) for each
window, of which only those in the set go on, to be compared word by word.
Item ids are joined last, once for each set of them that some documents share,
so a sentence that all items have is neither broadcast nor repeated.

Edge cases: null or wordless texts have no words and no hits; an item without
words has no window; an empty benchmark leaves every document clean; windows
never cross documents. Repeated rows give repeated results; items with equal
text are all reported. Items with a null id hit words and contaminate, count as
one item together, and have no place in the list of ids.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Characters that separate words: ASCII except letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def window_items(benchmark: DataFrame, size: int = 10, text: str = "text", item: str = "item_id") -> DataFrame:
    """Distinct (win, len, anchor, item): the items (ids as strings) of each window (words joined by spaces)."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0")
    each = rows.select("item", "w", F.expr(f"explode(sequence(1, greatest(1, size(w) - {size - 1})))").alias("at"))
    each = each.select("item", F.expr(f"slice(w, at, {size})").alias("v"))
    anchor = F.expr("aggregate(v, '', (a, x) -> if(length(x) > length(a), x, a))")
    return each.select(F.array_join("v", " ").alias("win"), F.size("v").alias("len"), anchor.alias("anchor"), "item").distinct()


def windows(pairs: DataFrame) -> DataFrame:
    """Distinct windows: ``win``, ``len``, ``anchor``, ``unnamed`` (an item without id has it) and ``list``, which windows of the same items share: a count and two sums of hashes (128 bits) of the ids. Null where no item has an id."""
    h = lambda seed: F.sum(F.when(F.col("item").isNotNull(), F.xxhash64("item", F.lit(seed)).cast("decimal(38, 0)")))
    listed = F.when(F.count("item") > 0, F.concat_ws(":", F.count("item"), h(1), h(2)))
    return pairs.groupBy("win", "len", "anchor").agg(listed.alias("list"), F.bool_or(F.col("item").isNull()).alias("unnamed"))


def _items_of(per: DataFrame, wins: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds ``items`` (sorted ids) to rows with ``lists``. Documents with the same lists share one set of ids, so what many items or documents have in common is made once."""
    used = per.select(F.explode("lists").alias("list")).distinct()
    known = wins.join(used, "list", "left_semi").groupBy(F.col("list").alias("one")).agg(F.min(F.struct("win", "len")).alias("w"))
    ids = pairs.where("item is not null").join(known, (F.col("win") == F.col("w.win")) & (F.col("len") == F.col("w.len"))).select("one", "item")
    sets = per.where("size(lists) > 0").select(F.col("lists").alias("__lists")).distinct()
    sets = sets.select("__lists", F.explode("__lists").alias("one")).join(ids, "one").groupBy("__lists").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hit = per.where("size(lists) > 0").join(sets, F.col("lists") == F.col("__lists")).drop("__lists")
    return hit.unionByName(per.where("size(lists) = 0").withColumn("items", F.array().cast("array<string>")))  # clean documents meet nothing


def _with_hits(rows: DataFrame, keep: list[str], found: list) -> DataFrame:
    """Adds ``n_words`` and ``ats``: array of struct(start, len, win) of all windows that occur, compared word by word."""
    anchors = [r["anchor"] for r in found]
    hashes = [r["h"] for r in found]
    wins = [r["win"] for r in found]
    none = F.array().cast("array<int>")
    near = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.element_at("w", i).isin(anchors))
    rows = rows.select(*keep, "w", F.size("w").alias("n_words"), F.when(F.size("w") > 0, near).otherwise(none).alias("near"))

    def hits(n: int) -> Column:
        lo, hi = lambda i: F.greatest(F.lit(1), i - F.lit(n - 1)), lambda i: F.least(i, F.size("w") - F.lit(n - 1))
        starts = F.flatten(F.transform("near", lambda i: F.when(lo(i) <= hi(i), F.sequence(lo(i), hi(i))).otherwise(none)))
        hit = F.filter(F.array_distinct(starts), lambda s: F.xxhash64(F.slice("w", s, n)).isin(hashes))
        spans = F.transform(hit, lambda s: F.struct(s.alias("start"), F.lit(n).alias("len"), F.array_join(F.slice("w", s, n), " ").alias("win")))
        return F.filter(spans, lambda x: x["win"].isin(wins))

    parts = [hits(n) for n in sorted({r["len"] for r in found})]
    empty = F.array().cast("array<struct<start:int,len:int,win:string>>")
    ats = F.when(F.size("near") > 0, F.concat(*parts) if parts else empty).otherwise(empty)
    return rows.select(*keep, "n_words", ats.alias("ats"))


def _bounded(wins: DataFrame, most_windows: int) -> list | None:
    """All windows, if there are at most so many: these go into the plan as literals."""
    some = wins.select("win", "anchor", "len", F.xxhash64(F.split("win", " ")).alias("h")).limit(most_windows + 1).collect()
    return some if len(some) <= most_windows else None


def _hash(words_: Column) -> Column:
    return F.xxhash64(words_)


def _found_windows(rows: DataFrame, wins: DataFrame, most_hashes: int) -> DataFrame:
    """(__row, start, len, win) of the windows of numbered rows (__row, w) whose hashes are in the set."""
    lengths = sorted(r["len"] for r in wins.select("len").distinct().collect())  # at most ``size`` values
    none = F.array().cast("array<struct<start:int,len:int,h:bigint>>")

    def windows_of(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda s: F.struct(s.alias("start"), F.lit(n).alias("len"), _hash(F.slice("w", s, n)).alias("h")))
        return F.when(F.size("w") >= n, each).otherwise(none)

    parts = [windows_of(n) for n in lengths]
    hashes = wins.select(_hash(F.split("win", " ")).alias("h")).distinct()
    each = F.explode(F.concat(*parts)).alias("at")
    text = F.array_join(F.slice("w", F.col("at.start"), F.col("at.len")), " ").alias("win")
    if hashes.count() <= most_hashes:
        near = rows.select("__row", "w", each).join(F.broadcast(hashes), F.col("at.h") == F.col("h"), "left_semi")
        return near.select("__row", "at.start", "at.len", text)
    near = rows.select("__row", each).select("__row", "at", F.col("at.h").alias("h")).join(hashes, "h", "left_semi").select(F.col("__row").alias("__r"), "at")
    return rows.join(near, F.col("__row") == F.col("__r")).select("__row", "at.start", "at.len", text)


def find(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", item_text: str = "text", item: str = "item_id", keep: tuple[str, ...] = ("doc_id",), most_windows: int = 20_000, most_hashes: int = 2_000_000) -> DataFrame:
    """One row a document: ``keep``, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted strings), ``spans`` (array of start, len, from 1) and ``contaminated``."""
    pairs = materialise(window_items(benchmark, size, item_text, item), "items")
    wins = materialise(windows(pairs), "windows")
    named = [f"__k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(k).alias(n) for k, n in zip(keep, named, strict=True)), F.monotonically_increasing_id().alias("__row"), F.col(text).alias("__text"))
    own = [*named, "__row"]
    some = _bounded(wins, most_windows)
    sets = wins.select("win", "list", "unnamed")
    together = [F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("list")).alias("lists"), F.max("unnamed").alias("unnamed")]
    if some is not None:
        rows = rows.select(*own, words(F.col("__text")).alias("w"))
        spans = _with_hits(rows, own, some).select(*own, "n_words", F.explode_outer("ats").alias("at"))
        joined = spans.join(F.broadcast(sets), spans["at.win"] == sets["win"], "left")  # at most ``most_windows`` rows of a window and two numbers
        hits = joined.select(*own, "n_words", F.when(F.col("unnamed").isNotNull(), F.struct(F.col("at.start"), F.col("at.len"))).alias("span"), "list", F.coalesce("unnamed", F.lit(False)).alias("unnamed"))
        per = hits.groupBy("__row").agg(*(F.first(n).alias(n) for n in (*named, "n_words")), *together)
    else:
        rows = materialise(rows, "numbered").withColumn("w", words(F.col("__text")))
        # by a merge, whose hot windows are split at run time; the sets of a large benchmark are never broadcast
        hits = _found_windows(rows, wins, most_hashes).join(sets.hint("merge"), "win").select("__row", F.struct("start", "len").alias("span"), "list", "unnamed")
        hits = hits.groupBy(F.col("__row").alias("__hit")).agg(*together)
        per = rows.select(*own, F.size("w").alias("n_words")).join(hits, F.col("__row") == F.col("__hit"), "left")
        empty = {"spans": F.array().cast("array<struct<start:int,len:int>>"), "lists": F.array().cast("array<string>"), "unnamed": F.lit(False)}
        per = per.withColumns({c: F.coalesce(c, e) for c, e in empty.items()})
    per = _items_of(materialise(per.select(*named, "n_words", "spans", "lists", "unnamed"), "hits"), wins, pairs)
    n_hit = F.expr("aggregate(spans, named_struct('n', 0L, 'e', 0), (a, s) -> named_struct('n', a.n + greatest(0, s.start + s.len - greatest(a.e, s.start)), 'e', greatest(a.e, s.start + s.len)), a -> a.n)")
    n_items = F.size("items") + F.col("unnamed").cast("int")
    return per.select(*(F.col(n).alias(k) for k, n in zip(keep, named, strict=True)), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), n_items.cast("long").alias("n_items"), "items", "spans", (F.size("spans") > 0).alias("contaminated"))


def remove_spans(text: Column, spans: Column) -> Column:
    """The text without the words of the spans (start, len; from 1), each with the separators behind it."""
    return F.when(F.size(spans) > 0, _cut(text, spans)).otherwise(text)


def _cut(text: Column, spans: Column) -> Column:
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # here the letters have their case
    pieces = F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(f"({word})")).alias("w"), F.slice(F.split(text, word), 2, 1 << 30).alias("s")), lambda p, i: F.when(F.exists(spans, lambda s: (i + 1 >= s["start"]) & (i + 1 < s["start"] + s["len"])), F.lit("")).otherwise(F.concat(F.coalesce(p["w"], F.lit("")), F.coalesce(p["s"], F.lit("")))))
    return F.concat(F.element_at(F.split(text, word), 1), F.array_join(pieces, ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text: str = "text", size: int = 10, item_text: str = "text", item: str = "item_id", most_windows: int = 20_000) -> DataFrame:
    """The documents without contaminated ones (``documents``) or without their hit words (``spans``); same columns.

    With a small benchmark this is one pass over the documents, without a shuffle.
    """
    columns = docs.columns
    wins = windows(window_items(benchmark, size, item_text, item))
    some = _bounded(wins, most_windows)
    named = [f"__k{i}" for i in range(len(columns))]
    if some is None:  # written once, so that documents meet their spans again by a row number
        rows = materialise(docs.select(*(F.col(k).alias(n) for k, n in zip(columns, named, strict=True)), F.monotonically_increasing_id().alias("__id")), "numbered")
        found = find(rows, benchmark, size, named[columns.index(text)], item_text, item, ("__id",), most_windows).where("contaminated").select(F.col("__id").alias("__hit"), "spans")
        found = rows.join(found, F.col("__id") == F.col("__hit"), "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,len:int>>")))
    else:
        rows = docs.select(*(F.col(k).alias(n) for k, n in zip(columns, named, strict=True)), words(F.col(text)).alias("w"))
        # the row number keeps the optimiser from moving the filter below, which would split a text again for each word
        found = _with_hits(rows, named, some).select(*named, F.col("ats").alias("spans"), F.monotonically_increasing_id().alias("__row"))
    body = named[columns.index(text)]
    if mode == "documents":
        found = found.where((F.size("spans") == 0) & (F.col("__row") >= 0)) if some is not None else found.where(F.size("spans") == 0)
    else:
        found = found.withColumn(body, remove_spans(F.col(body), F.col("spans")))
    return found.select(*(F.col(n).alias(c) for n, c in zip(named, columns, strict=True)))


ORACLE_SQL = r"""
with d as (select doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
b as (select item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark),
bw as (select distinct item_id, least(10, len(w)) n, array_to_string(w[s:s + 9], ' ') win from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) s from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') win from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) s from d, lens where len(w) >= n)),
hit as (select distinct dw.doc_id, dw.s, dw.n, bw.item_id from dw join bw on dw.win = bw.win and dw.n = bw.n),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + n)) p from (select distinct doc_id, s, n from hit)) group by doc_id),
it as (select doc_id, count(*) n_items, string_agg(i, ',' order by i) items from (select distinct doc_id, cast(item_id as varchar) i from hit) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join pos using (doc_id) left join it using (doc_id)
"""
