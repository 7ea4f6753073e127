"""Host-level quality rules with an empirical beta prior.

Rules are applied to each document; failures are counted by host, and each
host's failure rate is shrunk towards all hosts' by a beta prior whose mean
and strength are fitted to the hosts by moments. Hosts whose shrunk rate
exceeds ``most`` are rejected with all their documents.

Edge cases: null and empty texts have no words and fail by themselves;
documents without a host count as one host; with one host, or rates that vary
no more than chance, the prior is strong and no host stands out. Repeated rows
are separate documents. Other columns pass through if kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: White space between words, and the symbols that are counted.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


#: Of each 3-word window its place in the low bits, as many as the text's places need, and its hash in the others; sorted.
WINDOWS = "case when size(__w) >= 3 then sort_array(transform(sequence(1, size(__w) - 2), i -> (xxhash64(element_at(__w, i), element_at(__w, i + 1), element_at(__w, i + 2)) & shiftleft(-1L, __b)) | cast(i as bigint))) end"
#: Places of two neighbours there with one hash.
NEIGHBOURS = """transform(filter(sequence(1, greatest(size(__s) - 1, 1)), k -> k < size(__s) and shiftright(element_at(__s, k), __b) = shiftright(element_at(__s, k + 1), __b)),
    k -> struct(cast(element_at(__s, k) & ~shiftleft(-1L, __b) as int) as a, cast(element_at(__s, k + 1) & ~shiftleft(-1L, __b) as int) as b))"""
#: Two neighbours are other words with one hash: there may be equal windows beyond them.
CLASH = "exists(__k, k -> element_at(__w, k.a) <> element_at(__w, k.b) or element_at(__w, k.a + 1) <> element_at(__w, k.b + 1) or element_at(__w, k.a + 2) <> element_at(__w, k.b + 2))"
#: All windows of a text by hash and then by words, so that equal ones are neighbours whatever their hashes.
BY_WORDS = "sort_array(transform(sequence(1, size(__w) - 2), i -> struct(xxhash64(element_at(__w, i), element_at(__w, i + 1), element_at(__w, i + 2)) as h, element_at(__w, i) as x, element_at(__w, i + 1) as y, element_at(__w, i + 2) as z, i as i)))"
SAME = "element_at(t, k).h = element_at(t, k + 1).h and element_at(t, k).x = element_at(t, k + 1).x and element_at(t, k).y = element_at(t, k + 1).y and element_at(t, k).z = element_at(t, k + 1).z"
#: Places of windows that are there twice or more, sorted. Neighbours by hash decide where all of them are equal; if any two are not, the text's windows are sorted by words.
REPEATED = f"""sort_array(array_distinct(flatten(case when {CLASH}
    then transform(transform(array({BY_WORDS}), t -> transform(filter(sequence(1, size(t) - 1), k -> {SAME}), k -> array(element_at(t, k).i, element_at(t, k + 1).i)))[0], p -> p)
    else transform(__k, k -> array(k.a, k.b)) end)))"""


def features(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, t.alias("__t"), F.array_remove(F.split(t, SPACE), "").alias("__w"))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__l"),
        "__w",
        F.expr("cast(ceil(log2(size(__w) + 1)) as int)").alias("__b"),
    )
    rows = rows.select(*keep, "n_words", "word_chars", "n_symbols", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), "__w", "__b", F.expr(WINDOWS).alias("__s"))
    rows = rows.withColumn("__k", F.expr(NEIGHBOURS))
    rows = rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(REPEATED).alias("__i"))
    covered = F.expr("case when size(__i) > 0 then aggregate(sequence(1, size(__i)), 0L, (a, k) -> a + if(k = size(__i), 3, least(3, element_at(__i, k + 1) - element_at(__i, k)))) else 0L end")
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_failed() -> Column:
    """Fails a base rule, has many symbols for its letters, or mostly repeated lines."""
    return base_failed() | (10 * F.col("n_symbols") > F.col("word_chars")) | (5 * F.col("n_dup_lines") > F.col("n_words"))


def host_rates(rows: DataFrame, host: str = "source") -> DataFrame:
    """Host, n, failed and ``rate``: the failure rate shrunk by the fitted beta prior."""
    hosts = rows.groupBy(F.coalesce(F.col(host), F.lit("")).alias("host")).agg(F.count("*").alias("n"), F.sum(rule_failed().cast("long")).alias("failed"))
    # moments over hosts: m, and the variance of rates beyond what chance gives hosts of their sizes
    prior = hosts.agg((F.sum("failed") / F.sum("n")).alias("m"), F.var_pop(F.col("failed") / F.col("n")).alias("v"), F.avg(1 / F.col("n")).alias("c"))
    spread = F.greatest(F.coalesce("v", F.lit(0.0)) - F.col("m") * (1 - F.col("m")) * F.col("c"), F.lit(1e-6))
    prior = prior.select("m", F.greatest(F.col("m") * (1 - F.col("m")) / spread - 1, F.lit(1.0)).alias("s"))
    both = hosts.join(F.broadcast(prior), F.lit(True))  # one row
    return both.select("host", "n", "failed", ((F.col("failed") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s"))).alias("rate"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep: tuple[str, ...] = ("doc_id",), most: float = 0.5, broadcast_hosts: int = 200_000) -> DataFrame:
    """One row a document: ``keep``, the features, ``base_failed``, ``host_rate`` and ``kept``."""
    names = (*keep, "__host") if host not in keep else keep
    at = host if host in keep else "__host"
    rows = docs.withColumn("__host", F.col(host)) if at == "__host" else docs
    rows = materialise(features(rows, text, names), "features")  # a few numbers a document
    hosts = materialise(host_rates(rows, at), "hosts")
    rows = rows.withColumn("base_failed", base_failed())
    verdict = hosts.select("host", F.col("rate").alias("host_rate"))
    if hosts.count() <= broadcast_hosts:
        joined = rows.join(F.broadcast(verdict), F.coalesce(F.col(at), F.lit("")) == F.col("host"), "left")
    else:  # few hosts are bad: only those are joined, spread over salts so that no host meets in one task
        salts = 64
        salted = verdict.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        left = rows.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(k) for k in keep]), F.lit(salts)).cast("int"))
        joined = left.join(salted, (F.coalesce(F.col(at), F.lit("")) == salted.host) & (left["__salt"] == salted["__salt"]), "left")
    return joined.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", (~F.col("base_failed") & (F.col("host_rate") <= most)).alias("kept"))


ORACLE_SQL = r"""
with w as (select doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as (select doc_id, i, count(*) over (partition by doc_id, a, b, c) n from (select doc_id, i, w[i] a, w[i + 1] b, w[i + 2] c from (select doc_id, w, unnest(range(1, len(w) - 1)) i from w where len(w) >= 3))),
r as (select doc_id, count(distinct p) n_repeat from (select doc_id, unnest([i, i + 1, i + 2]) p from g where n > 1) group by doc_id),
f as (select doc_id, source, cast(len(w) as bigint) n_words,
 cast(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as bigint) word_chars,
 cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) n_symbols,
 cast(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as bigint) n_dup_lines,
 cast(coalesce(n_repeat, 0) as bigint) n_repeat_words from w left join r using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > word_chars or 5 * n_dup_lines > n_words as rule_failed from f),
h as (select coalesce(source, '') host, count(*) n, sum(cast(rule_failed as bigint)) failed from b group by 1),
p as (select sum(failed) / sum(n) m, var_pop(failed / n) v, avg(1 / n) c from h),
q as (select m, greatest(m * (1 - m) / greatest(coalesce(v, 0) - m * (1 - m) * c, 1e-6) - 1, 1.0) s from p),
k as (select host, (failed + m * s) / (n + s) rate from h, q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rate <= 0.5 as kept from b join k on coalesce(b.source, '') = k.host
"""
