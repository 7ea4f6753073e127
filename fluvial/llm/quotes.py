"""Quotation linking: conversations in reply order, without the quotes.

Each line of a message has a quote level, its leading ``>`` marks. Adjacent
lines of one level, up to a blank one, are a passage; its text is normalised
(marks off, lower case, single spaces, lines joined) and hashed. The hash of a
quoted passage is joined to the first message of the conversation that has it
unquoted, however either one is wrapped; lines of a passage that is not found
are looked for line by line. A message answers the latest message it quotes at
the lowest level; without a link it answers the turn before it.

Replies form trees. ``position`` numbers a conversation's messages depth first:
each message, then its replies with all theirs, by turn. It is made by ranking
the list of steps into and out of each message, with links that double in length
each round, so no conversation has to fit a task.

Keys are (conversation, hash), and originals are reduced to the first turn
before the join, so a hot conversation or a line said very often gives one row.

Edge cases: null text has no lines and an empty body; a quote whose original is
not found, or comes later, is unlinked but still taken out; blank lines are not
linked; the first turn answers nothing, nor does a turn after a missing one;
repeated rows are all returned, and replies belong to the first of them; rows
with null conversation or turn are returned unlinked and without position; very
long messages are split within their row. Columns named as the results give way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions

#: The marks at the start of a quoted line.
MARKS = r"^(?:[ \t]*>)+"


def lines(messages: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``__lines``: of each line its level, its text, and its normalised text."""
    parts = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"), x.alias("line"), F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, MARKS, ""), r"[ \t\r]+", " "))).alias("norm")))
    return messages.withColumn("__lines", parts)


def passages() -> Column:
    """Of ``__lines`` the passages: level, normalised text, and the normalised lines."""
    at = lambda i: F.element_at("__lines", i)
    starts = F.filter(F.sequence(F.lit(1), F.size("__lines")), lambda i: (at(i)["norm"] != "") & F.when(i == 1, F.lit(True)).otherwise((at(F.greatest(i - 1, F.lit(1)))["level"] != at(i)["level"]) | (at(F.greatest(i - 1, F.lit(1)))["norm"] == "")))
    ends = F.filter(F.sequence(F.lit(1), F.size("__lines")), lambda i: (at(i)["norm"] != "") & F.when(i == F.size("__lines"), F.lit(True)).otherwise((at(F.least(i + 1, F.size("__lines")))["level"] != at(i)["level"]) | (at(F.least(i + 1, F.size("__lines")))["norm"] == "")))
    norms = lambda p: F.transform(F.slice("__lines", p["starts"], p["ends"] - p["starts"] + 1), lambda x: x["norm"])
    return F.transform(F.arrays_zip(starts.alias("starts"), ends.alias("ends")), lambda p: F.struct(at(p["starts"])["level"].alias("level"), F.array_join(norms(p), " ").alias("norm"), norms(p).alias("lines")))


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", order: bool = True) -> DataFrame:
    """One row a message: its columns and ``parent_turn``, ``n_quoted``, ``n_linked`` (quoted lines), ``body`` and, with ``order``, ``position``."""
    columns = messages.columns
    base = messages.select(F.col(conv).alias("__conv"), F.col(turn).cast("long").alias("__turn"), F.struct(*columns).alias("__all"), F.col(text).alias("__text"))
    base = lines(base, "__text").drop("__text").withColumn("__row", F.monotonically_increasing_id())
    base = materialise(base, "messages")  # gives each message its row number for good
    named = base.where(F.col("__conv").isNotNull() & F.col("__turn").isNotNull())
    each = named.select("__row", "__conv", "__turn", F.explode(passages()).alias("p"))
    each = each.select("__row", "__conv", "__turn", "p.level", F.xxhash64("p.norm").alias("h"), F.md5("p.norm").alias("m"), "p.lines")
    by_line = lambda df: df.select("__row", "__conv", "__turn", "level", F.explode("lines").alias("x")).select("__row", "__conv", "__turn", "level", F.xxhash64("x").alias("h"), F.md5("x").alias("m"))
    first = lambda df: df.groupBy("__conv", "h", "m").agg(F.min("__turn").alias("said"))
    said = F.when(F.col("said") < F.col("__turn"), F.col("said")).alias("said")
    own, quoted = each.where("level = 0"), each.where("level > 0")
    whole = materialise(quoted.join(first(own), ["__conv", "h", "m"], "left").select("__row", "__conv", "__turn", "level", "lines", said), "passages")
    rest = by_line(whole.where("said is null")).join(first(by_line(own)), ["__conv", "h", "m"], "left").select("__row", "level", F.lit(1).alias("n"), said)
    found = whole.where("said is not null").select("__row", "level", F.size("lines").alias("n"), "said").unionByName(rest)
    per = found.groupBy("__row").agg(F.sum("n").alias("n_quoted"), F.coalesce(F.sum(F.when(F.col("said").isNotNull(), F.col("n"))), F.lit(0)).alias("n_linked"), F.max(F.when(F.col("said").isNotNull(), F.struct(-F.col("level"), "said"))).alias("best"))
    before = named.select(F.col("__conv").alias("c"), F.col("__turn").alias("t")).distinct()
    body = F.array_join(F.transform(F.filter("__lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    joined = base.join(per, "__row", "left")
    joined = joined.join(before, (F.col("__conv") == F.col("c")) & (F.col("__turn") - 1 == F.col("t")), "left")
    made = {"parent_turn": F.coalesce("best.said", "t"), "n_quoted": F.coalesce("n_quoted", F.lit(0)), "n_linked": F.coalesce("n_linked", F.lit(0)), "body": F.trim(body)}
    results = [*made, "position"] if order else list(made)
    kept = [F.col(f"__all.{c}").alias(c) for c in columns if c not in results]
    if not order:
        return joined.select(*kept, *(v.alias(k) for k, v in made.items()))
    links = materialise(joined.select("__row", "__conv", "__turn", made["parent_turn"].alias("__parent")).where(F.col("__conv").isNotNull() & F.col("__turn").isNotNull()), "links")
    places = reply_order(links).select(F.col("__row").alias("__r"), "position")
    return joined.join(places, F.col("__row") == F.col("__r"), "left").select(*kept, *(v.alias(k) for k, v in made.items()), "position")


def _next_row(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``__next``: the following row's ``order`` columns as a struct, over all rows in that order, range by range."""
    n = partitions(rows.sparkSession)
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = materialise(ranged, "ranges")
    counts = ranged.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count("*").alias("__n"))
    parts = counts.groupBy().agg(F.array_sort(F.collect_list(F.struct("__part", "__n"))).alias("p"))  # one entry a range
    before = parts.select(F.explode(F.transform("p", lambda x, i: F.struct(x["__part"].alias("__part"), F.aggregate(F.slice("p", 1, i), F.lit(0).cast("long"), lambda s, y: s + y["__n"]).alias("__before")))).alias("b")).select("b.*")
    numbered = ranged.join(F.broadcast(before), F.shiftright("__at", 33) == F.col("__part")).withColumn("__number", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__before")
    ahead = numbered.select((F.col("__number") - 1).alias("__of"), F.struct(*order).alias("__next"))
    return numbered.join(ahead, F.col("__number") == F.col("__of"), "left").drop("__number", "__of")


def reply_order(links: DataFrame) -> DataFrame:
    """``position`` (from 1) of each message (__row, __conv, __turn, __parent) in its conversation, depth first."""
    one = links.groupBy("__conv", "__turn").agg(F.min("__row").alias("__up")).select(F.col("__conv").alias("c"), F.col("__turn").alias("t"), "__up")
    tree = links.join(one, (F.col("__conv") == F.col("c")) & (F.col("__parent") == F.col("t")), "left").select("__row", "__conv", "__turn", F.coalesce("__up", F.lit(-1)).alias("__up"))
    tree = _next_row(tree, ["__conv", "__up", "__turn", "__row"])
    sibling = F.when((F.col("__next.__conv") == F.col("__conv")) & (F.col("__next.__up") == F.col("__up")), F.col("__next.__row"))
    child = tree.where("__up >= 0").groupBy(F.col("__up").alias("__of")).agg(F.min(F.struct("__turn", "__row"))["__row"].alias("__child"))
    tree = materialise(tree.withColumn("__sibling", sibling).join(child, F.col("__row") == F.col("__of"), "left"), "tree")
    enter, leave = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    down = tree.select(enter("__row").alias("id"), F.coalesce(enter("__child"), leave("__row")).alias("next"), F.lit(1).cast("long").alias("w"))
    up = tree.select(leave("__row").alias("id"), F.coalesce(enter("__sibling"), F.when(F.col("__up") >= 0, leave("__up"))).alias("next"), F.lit(0).cast("long").alias("w"))
    current = materialise(down.unionByName(up), "steps")
    rounds = [current]

    def ended() -> DataFrame:
        """Steps whose links have reached the end of their list; they are not joined again."""
        return reduce(DataFrame.unionByName, (r.where("next is null") for r in rounds))

    while not current.where("next is not null").isEmpty():  # w counts the messages from a step up to its link's end
        open_ = current.where("next is not null")
        ahead = ended().unionByName(open_).select(F.col("id").alias("to"), F.col("next").alias("far"), F.col("w").alias("more"))
        current = materialise(open_.join(ahead, F.col("next") == F.col("to")).select("id", F.col("far").alias("next"), (F.col("w") + F.col("more")).alias("w")), "steps")
        rounds.append(current)
    rest = ended().where("id % 2 = 0").select((F.col("id") / 2).cast("long").alias("__id"), "w")
    total = links.groupBy(F.col("__conv").alias("c")).agg(F.count("*").alias("n"))
    both = links.join(rest, F.col("__row") == F.col("__id")).join(total, F.col("__conv") == F.col("c"))
    return both.select("__row", (F.col("n") - F.col("w") + 1).alias("position"))


ORACLE_SQL = r"""
with recursive l as (select conv_id, turn, generate_subscripts(s, 1) i, unnest(s) line from (select conv_id, turn, string_split(coalesce(text, ''), chr(10)) s from conversations)),
n as (select conv_id, turn, i, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) lev, lower(trim(regexp_replace(regexp_replace(line, '^(?:[ \t]*>)+', ''), '[ \t\r]+', ' ', 'g'))) norm from l),
k as (select *, sum(case when lev = blev and bnorm <> '' then 0 else 1 end) over (partition by conv_id, turn order by i) blk from (select *, lag(lev) over (partition by conv_id, turn order by i) blev, lag(norm) over (partition by conv_id, turn order by i) bnorm from n)),
b as (select conv_id, turn, blk, lev, string_agg(norm, ' ' order by i) norm, count(*) c from k where norm <> '' group by 1, 2, 3, 4),
fb as (select conv_id, norm, min(turn) said from b where lev = 0 group by 1, 2),
fl as (select conv_id, norm, min(turn) said from k where lev = 0 and norm <> '' group by 1, 2),
qb as (select b.*, case when fb.said < b.turn then fb.said end said from b left join fb on fb.conv_id = b.conv_id and fb.norm = b.norm where lev > 0),
q as (select conv_id, turn, lev, c, said from qb where said is not null union all select k.conv_id, k.turn, k.lev, 1, case when fl.said < k.turn then fl.said end from k join qb on qb.conv_id = k.conv_id and qb.turn = k.turn and qb.blk = k.blk and qb.said is null left join fl on fl.conv_id = k.conv_id and fl.norm = k.norm where k.norm <> ''),
p as (select conv_id, turn, cast(sum(c) as bigint) n_quoted, cast(coalesce(sum(c) filter (where said is not null), 0) as bigint) n_linked, max((-lev, said)) filter (where said is not null) as best from q group by 1, 2),
m as (select c.conv_id, c.turn, coalesce(p.best[2], o.turn) parent_turn from conversations c left join p on p.conv_id = c.conv_id and p.turn = c.turn left join conversations o on o.conv_id = c.conv_id and o.turn = c.turn - 1),
r(conv_id, turn, path) as (select conv_id, turn, [turn] from m where parent_turn is null union all select m.conv_id, m.turn, list_append(r.path, m.turn) from r join m on m.conv_id = r.conv_id and m.parent_turn = r.turn),
z as (select conv_id, turn, row_number() over (partition by conv_id order by path) as position from r)
select c.conv_id, c.turn, c.role, m.parent_turn, coalesce(n_quoted, 0) n_quoted, coalesce(n_linked, 0) n_linked, z.position,
 sha256(trim(coalesce(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: not regexp_matches(x, '^(?:[ \t]*>)+')), chr(10)), ''))) body_sha256
from conversations c left join m on m.conv_id = c.conv_id and m.turn = c.turn left join p on p.conv_id = c.conv_id and p.turn = c.turn left join z on z.conv_id = c.conv_id and z.turn = c.turn
"""
