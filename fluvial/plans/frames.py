"""Queries of joins, streams, readers and writers, array helpers, further statistics, sampling and learning; each against SQL."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import distributions as D
from ..functions import scalars as X
from ..operators import curves, learning, numbering, powers, relational, sampling, sequences, series, stats, trees
from ..sources import stations, tables
from ..streaming import windows
from .registry import query, rows_of, table

# --- relational forms ---------------------------------------------------------------


@query("""select 'inner' kind, count(*) n, sum(o_totalprice) total from customer join orders on c_custkey = o_custkey union all select 'left', count(*), sum(o_totalprice) from customer left join orders on c_custkey = o_custkey
union all select 'full', count(*), sum(c_acctbal) from customer full join supplier on c_nationkey = s_nationkey and c_acctbal < s_acctbal union all select 'semi', count(*), sum(c_acctbal) from customer where exists (select 1 from orders where o_custkey = c_custkey)
union all select 'anti', count(*), sum(c_acctbal) from customer where not exists (select 1 from orders where o_custkey = c_custkey) union all select 'theta', count(*), sum(c_acctbal - s_acctbal) from customer join supplier on c_nationkey = s_nationkey and c_acctbal between s_acctbal - 1000 and s_acctbal + 1000""")
def join_kinds(spark, d):
    c, o, s = table(spark, d, "customer"), table(spark, d, "orders", "o_custkey", "o_totalprice"), table(spark, d, "supplier")
    on = F.col("c_custkey") == F.col("o_custkey")
    near = (F.col("c_nationkey") == F.col("s_nationkey")) & F.col("c_acctbal").between(F.col("s_acctbal") - 1000, F.col("s_acctbal") + 1000)
    parts = {"inner": (c.join(o, on), "o_totalprice"), "left": (c.join(o, on, "left"), "o_totalprice"), "full": (c.join(s, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("c_acctbal") < F.col("s_acctbal")), "full"), "c_acctbal"), "semi": (c.join(o, on, "left_semi"), "c_acctbal"), "anti": (c.join(o, on, "left_anti"), "c_acctbal"), "theta": (c.join(s, near).withColumn("gap", F.col("c_acctbal") - F.col("s_acctbal")), "gap")}
    out = None
    for kind, (df, v) in parts.items():
        row = df.agg(F.count("*").alias("n"), F.sum(v).alias("total")).select(F.lit(kind).alias("kind"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query("""select o_orderstatus, o_orderpriority, count(*) n, count(distinct o_custkey) customers, true as approximate from orders group by cube (o_orderstatus, o_orderpriority) union all select o_orderstatus, null, count(*), count(distinct o_custkey), true from orders group by grouping sets ((o_orderstatus), ())""")
def cubes_and_distinct_counts(spark, d):
    o = table(spark, d, "orders")
    keys = ["o_orderstatus", "o_orderpriority"]

    def counted(grouped):
        """Exact and approximate counts apart: in one aggregate each customer of each set would have a sketch."""
        exact = grouped.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))
        about = grouped.agg(F.grouping_id().alias("ag"), F.approx_count_distinct("o_custkey", 0.01).alias("about")).withColumnsRenamed({k: f"a_{k}" for k in keys})
        same = F.col("g") == F.col("ag")
        for k in (k for k in keys if k in exact.columns):
            same = same & F.col(k).eqNullSafe(F.col(f"a_{k}"))
        return exact.join(about, same).select(*(F.col(k) if k in exact.columns else F.lit(None).cast("string").alias(k) for k in keys), "n", "customers", "about")

    rows = counted(o.cube(*keys)).unionByName(counted(o.groupingSets([["o_orderstatus"], []], "o_orderstatus")))
    return rows.withColumn("approximate", F.abs(F.col("about") - F.col("customers")) <= 0.05 * F.col("customers")).drop("about")


@query("""with r as (select c_nationkey, c_custkey, rank() over w rk, dense_rank() over w dr, ntile(4) over w q, lag(c_acctbal) over w before, lead(c_acctbal, 2) over w after, first_value(c_acctbal) over w lowest from customer window w as (partition by c_nationkey order by c_acctbal, c_custkey)) select * from r""")
def ranks_and_offsets(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    c = table(spark, d, "customer")
    return c.select("c_nationkey", "c_custkey", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(w).alias("q"), F.lag("c_acctbal").over(w).alias("before"), F.lead("c_acctbal", 2).over(w).alias("after"), F.first("c_acctbal").over(w).alias("lowest"))


@query("select c_mktsegment, stddev_samp(c_acctbal) / sqrt(count(*)) as error, stddev_samp(c_acctbal) / sqrt(count(*)) as jackknife, avg(c_acctbal) mean, 3 as pieces, strlen(c_mktsegment) letters from customer group by c_mktsegment")
def user_functions(spark, d):
    """A grouped pandas aggregate (the jackknife), a pandas scalar function, a table function and a plain expression side by side."""

    @F.pandas_udf("double")
    def jackknife(v: pd.Series) -> float:
        n = len(v)
        out = (v.sum() - v) / (n - 1)  # means without each value
        return float(math.sqrt((n - 1) / n * ((out - out.mean()) ** 2).sum()))

    @F.pandas_udf("long")
    def letters(s: pd.Series) -> pd.Series:
        return s.str.len()

    @F.udtf(returnType="piece: int")
    class Pieces:
        def eval(self, n: int):
            for k in range(n):
                yield (k,)

    pieces = Pieces(F.lit(3)).count()
    c = table(spark, d, "customer").groupBy("c_mktsegment").agg((F.stddev_samp("c_acctbal") / F.sqrt(F.count("*"))).alias("error"), F.avg("c_acctbal").alias("mean"))
    j = table(spark, d, "customer").groupBy("c_mktsegment").agg(jackknife("c_acctbal").alias("jackknife"))
    return c.join(j, "c_mktsegment").withColumn("pieces", F.lit(int(pieces))).withColumn("letters", letters("c_mktsegment"))


# --- streams ---------------------------------------------------------------------------


def streamed(spark, d, build, mode: str = "append"):
    """Runs a stream over the events table until its rows are used up, and returns what it wrote."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = build(events)
    path = tables.shared_path(spark)
    if mode == "append":
        out.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    else:

        def write(batch, number):
            batch.write.mode("overwrite").parquet(path)

        out.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


_LAST = "(select max(ts) - interval 10 minutes from events)"


@query(f"""with w as (select time_bucket(interval 1 hour, ts) as start, event_type, count(*) n, sum(value) total, avg(value) mean, min(value) lo, max(value) hi from events group by 1, 2) select start, start + interval 1 hour as "end", event_type, n, total, mean, lo, hi from w where start + interval 1 hour <= {_LAST}""")
def stream_of_hours(spark, d):
    """Tumbling windows behind a watermark of ten minutes; windows that the watermark has not passed are open still."""
    return streamed(spark, d, windows.block_stream).select(*(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), "event_type", "n", "total", "mean", "lo", "hi")


@query(f"""with s as (select start, event_type, value from (select event_type, value, unnest([time_bucket(interval 30 minutes, ts) - interval 30 minutes, time_bucket(interval 30 minutes, ts)]) as start from events)) select start, start + interval 1 hour as "end", event_type, count(*) n, sum(value) total from s where start + interval 1 hour <= {_LAST} group by 1, 2, 3""")
def stream_of_sliding_hours(spark, d):
    got = streamed(spark, d, lambda e: windows.block_stream(e, "1 hour", "30 minutes"))
    return got.select(*(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), "event_type", "n", "total")


@query(f"""with l as (select user_id, ts, value, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end nw from events window w as (partition by user_id order by ts)), s as (select *, sum(nw) over (partition by user_id order by ts, nw desc rows unbounded preceding) k from l), g as (select user_id, min(ts) as start, max(ts) + interval 30 minutes as "end", count(*) n, sum(value) total from s group by user_id, k) select user_id, start, "end", n, total from g where "end" <= {_LAST}""")
def stream_of_sessions(spark, d):
    got = streamed(spark, d, windows.sessions)
    return got.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), "n", "total")


@query("select event_type, count(*) n, min(value) lo, max(value) hi, avg(value) mean, var_samp(value) variance, skewness(value) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) skew, kurtosis_pop(value) kurt from events group by 1")
def stream_of_moments(spark, d):
    return streamed(spark, d, windows.running_moments, "complete")


@query(f"""with o as (select event_type, ts, value, case when ts - lag(ts) over w <= interval 30 minutes then 0 else 1 end nw from events where value > 60 window w as (partition by event_type order by ts)), c as (select *, sum(nw) over (partition by event_type order by ts rows unbounded preceding) k from o)
select event_type, max(value) peak, arg_max(ts, (value, ts)) as at, max(ts) as last, count(*) n from c group by event_type, k having max(ts) + interval 30 minutes < (select max(ts) - interval 10 minutes from events where value > 60)""")
def stream_of_peaks(spark, d):
    """Clusters over a threshold; those that rows may still join are open."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    windows.use_rocks(spark)
    try:
        got = streamed(spark, d, lambda e: windows.peaks(e, 60.0))
    finally:
        spark.conf.set(provider, before)
    return got.select("event_type", "peak", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("at", "last")), "n")


# --- readers and writers -----------------------------------------------------------------


def _days(spark, d):
    e = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("site")).agg(F.floor(F.sum("value") + 0.001).cast("double").alias("v"))
    return e.select("site", "day", F.col("v"))


_DAYS = "with e as (select event_type site, date_trunc('day', ts)::timestamp ts, floor(sum(value) + 0.001) v from events group by 1, 2)"
_CALENDAR = _DAYS + ", b as (select site, min(ts) a, max(ts) z from e group by 1), g as (select site, unnest(generate_series(a, z, interval 1 day)) ts from b) select g.site, g.ts, e.v from g left join e on e.site = g.site and e.ts = g.ts"


def _text_file(spark, lines):
    path = tables.shared_path(spark)
    lines.write.text(path)
    return path


@query(_CALENDAR)
def ghcn_daily_files(spark, d):
    """Fixed-width months written from the events, and read again."""
    e = _days(spark, d).select("site", F.substring("day", 1, 4).alias("y"), F.substring("day", 6, 2).alias("m"), F.substring("day", 9, 2).cast("int").alias("n"), F.round(F.col("v") * 10).cast("long").alias("t"))
    month = e.groupBy("site", "y", "m").agg(F.map_from_entries(F.collect_list(F.struct("n", "t"))).alias("days"))
    cell = lambda k: F.concat(F.lpad(F.coalesce(F.try_element_at("days", k), F.lit(-9999)).cast("string"), 8, " "), F.lit("   "))
    wide = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(31)), cell), "")
    lines = month.select(F.concat(F.rpad("site", 11, "_"), "y", "m", F.lit("TEST"), wide).alias("value"))
    path = _text_file(spark, lines)
    return stations.ghcn_daily(spark, path, "TEST", width=8).select(F.regexp_replace("site", "_+$", "").alias("site"), "ts", "v")


@query(_CALENDAR)
def usgs_daily_files(spark, d):
    """Tab-separated files with comments, a header and a line of formats; absent days come back as missing."""
    path = tables.shared_path(spark)
    sites = {r["site"]: f"{i + 1:08d}" for i, r in enumerate(table(spark, d, "events").select(F.col("event_type").alias("site")).distinct().orderBy("site").collect())}  # one row an event type
    names = F.create_map(*(F.lit(x) for kv in sites.items() for x in kv))
    back = F.create_map(*(F.lit(x) for kv in sites.items() for x in kv[::-1]))
    head = spark.createDataFrame([("# a comment", 0), ("agency_cd\tsite_no\tdatetime\tflow", 1), ("5s\t15s\t20d\t14n", 2)], "value string, k int")
    rows = _days(spark, d).select(F.concat_ws("\t", F.lit("USGS"), names[F.col("site")], "day", F.col("v").cast("string")).alias("value"), F.lit(3).alias("k"))
    head.unionByName(rows).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return stations.daily_calendar(stations.usgs_rdb(spark, path, "flow")).select(back[F.col("site")].alias("site"), "ts", "v")


@query(_DAYS + " select site, ts, round(v * 0.028316846592, 9) as v from e")
def canadian_and_australian_files(spark, d):
    """The same days through CSV files (cubic feet) and JSON lists (cubic metres), joined."""
    days = _days(spark, d)
    a, b = tables.shared_path(spark), tables.shared_path(spark)
    days.select(F.col("site").alias("STATION_NUMBER"), F.col("day").alias("DATE"), F.col("v").alias("DISCHARGE")).write.csv(a, header=True)
    listed = days.groupBy(F.col("site").alias("station_no")).agg(F.collect_list(F.array("day", F.col("v").cast("string"))).alias("data"))
    listed.agg(F.to_json(F.collect_list(F.struct("station_no", "data"))).alias("value")).write.text(b)
    one = stations.canadian_csv(spark, a).withColumn("v", stations.convert(F.col("v"), "cfs", "cms"))
    two = stations.australian_json(spark, b).withColumnRenamed("v", "w")
    return one.join(two, ["site", "ts"]).where(F.abs(F.col("v") - F.col("w") * 0.028316846592) < 1e-9).select("site", "ts", F.round("v", 9).alias("v"))


@query("select n_nationkey k, n_nationkey * 1.5 as x, n_nationkey * 0.25 as y, 'normal' as dist, n_nationkey * 1.0 as mu, true as strict_x, 'Ascending' as order_y, n_nationkey * 2.0 as cell, n_nationkey * 1.0 as j10, 'NaN' as odd, n_name back from nation")
def written_and_read_again(spark, d):
    """Curves, uncertain curves and matrices as XML, arrays and NaN as JSON, bytes through compression."""
    n = table(spark, d, "nation").withColumn("k", F.col("n_nationkey").cast("double"))
    p, q, m = (tables.shared_path(spark) for _ in range(3))
    tables.write_curve_xml(n.select((F.col("k") * 1.5).alias("x"), (F.col("k") * 0.25).alias("y")), p)
    tables.write_uncertain_curve_xml(n.select((F.col("k") * 1.5).alias("x"), F.lit("normal").alias("dist"), F.array("k", F.lit(1.0)).alias("params")), q)
    tables.write_matrix_xml(n.select(F.col("n_nationkey").cast("long").alias("i"), F.lit(0).cast("long").alias("j"), (F.col("k") * 2).alias("v")), m)
    out = tables.read_curve_xml(spark, p).crossJoin(F.broadcast(tables.read_curve_options(spark, p).select("strict_x", "order_y")))
    out = out.join(tables.read_uncertain_curve_xml(spark, q).select("x", "dist", F.element_at("params", 1).alias("mu")), "x")
    out = out.withColumn("k", F.round(F.col("x") / 1.5).cast("long")).join(tables.read_matrix_xml(spark, m).select(F.col("i").alias("k"), F.col("v").alias("cell")), "k")
    square = F.array(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.col("k").cast("double"), F.lit(float("nan"))))
    again = tables.array_2d_from_json(tables.array_2d_json(square))
    out = out.withColumn("j10", F.element_at(F.element_at(again, 2), 1)).withColumn("odd", F.element_at(F.element_at(again, 2), 2).cast("string"))

    @F.udf("string")
    def squeezed(s):
        return tables.decompress(tables.compress(s.encode())).decode()

    names = n.select(F.col("n_nationkey").cast("long").alias("k"), squeezed("n_name").alias("back"))
    return out.join(names, "k").select(F.col("k").cast("int").alias("k"), "x", "y", "dist", "mu", "strict_x", "order_y", "cell", "j10", "odd", "back")


@query("with o as (select o_orderpriority, o_orderdate ts, o_totalprice v from orders) select epoch_us(ts) us, count(*) n, round(sum(v), 2) total from o group by 1")
def series_as_xml(spark, d):
    path = tables.shared_path(spark)
    tables.write_series_xml(table(spark, d, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("v")), path)
    return tables.read_series_xml(spark, path).groupBy(F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("select n_nationkey, '{\"dist\":\"gumbel\",\"params\":[' || n_nationkey || '.0,2.0]}' as stored, n_nationkey * 1.0 as first, 'gumbel' as dist from nation")
def results_as_json_bytes(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", tables.to_json_bytes(F.struct(F.lit("gumbel").alias("dist"), F.array(F.col("n_nationkey").cast("double"), F.lit(2.0)).alias("params"))).alias("b"))
    back = tables.from_json_bytes(F.col("b"), "dist string, params array<double>")
    return n.select("n_nationkey", F.col("b").cast("string").alias("stored"), F.element_at(back["params"], 1).alias("first"), back["dist"].alias("dist"))


# --- scalars, arrays, links, transforms ---------------------------------------------------


@query("""with x as (select n_nationkey k, n_nationkey - 12.0 as x from nation) select k, case when k % 2 = 0 then -abs(x) else abs(x) end copied, true as finite, k in (1, 2, 4, 8, 16) as power, cast(case when k <= 1 then 1 else pow(2, ceil(log2(k))) end as bigint) next, least(greatest(x, -5), 7) as clamped, sign(x) * 1.0 as sg, x * x as squared,
ln(greatest(k, 1e-16)) as lg, log10(greatest(k, 1e-16)) as lg10, ln(1 + k) as l1p, true as near from x""")
def scalar_helpers(spark, d):
    x, k = F.col("n_nationkey") - 12.0, F.col("n_nationkey")
    return table(spark, d, "nation").select(
        k.alias("k"), X.copy_sign(x, F.when(k % 2 == 0, -1.0).otherwise(1.0)).alias("copied"), (X.is_finite(x) & ~X.is_finite(F.lit(float("inf"))) & ~X.is_finite(F.lit(float("nan")))).alias("finite"), X.is_power_of_two(k).alias("power"), X.next_power_of_two(k).alias("next"), X.clamp(x, -5, 7).alias("clamped"), F.signum(x).alias("sg"), (x * x).alias("squared"),
        X.floored_log(k.cast("double")).alias("lg"), X.floored_log(k.cast("double"), 10).alias("lg10"), F.log1p(k.cast("double")).alias("l1p"), X.almost_equals(x + 1e-16, x).alias("near"),
    )


@query("""with e as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings), f as (select *, list_transform(range(1, len(e) + 1), lambda i: i * 1.0) w from e) select vec_id, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * w[i])), 6) dot, round(sqrt(list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] - w[i]) ** 2))), 6) dist, round(sqrt(list_sum(list_transform(range(1, len(e) + 1), lambda i: w[i] * (e[i] - w[i]) ** 2))), 6) weighted,
round(sqrt(list_sum(list_transform(range(1, len(e) + 1), lambda i: ((e[i] - w[i]) / 2) ** 2))), 6) normalised, round(list_max(e) + ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))), 6) lse, round(e[3] + w[3], 6) added, round(e[2] * 2 - w[2], 6) scaled, 3 as taken, 1.0 as filled from f""")
def array_algebra(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).withColumn("w", F.transform(F.sequence(F.lit(1), F.size("e")), lambda i: i.cast("double")))
    a, w = F.col("e"), F.col("w")
    r = lambda c: F.round(c, 6)
    lo, hi = F.transform(a, lambda x: F.lit(0.0)), F.transform(a, lambda x: F.lit(2.0))
    return e.select("vec_id", r(X.dot(a, w)).alias("dot"), r(X.distance(a, w)).alias("dist"), r(X.weighted_distance(a, w, w)).alias("weighted"), r(X.normalised_distance(a, w, lo, hi)).alias("normalised"), r(X.log_sum_exp(a)).alias("lse"), r(F.element_at(X.add(a, w), 3)).alias("added"), r(F.element_at(X.subtract(X.scale(a, 2), w), 2)).alias("scaled"), F.size(X.subset(a, 1, 3)).alias("taken"), F.element_at(X.fill(1.0, 4), 4).alias("filled"))


@query("""with u as (select n_nationkey k, (n_nationkey + 1) / 26.0 u, n_nationkey - 12.0 x from nation) select k, round(u, 8) as identity, round(1 / u, 8) d_log, round(1 / (u * (1 - u)), 8) d_logit, round(u, 8) back_logit, round(u, 8) back_probit, round(u, 8) back_cloglog, round(-1 / ((1 - u) * ln(1 - u)), 8) d_cloglog, round(1 / (1 - u * u), 8) d_fisher, round(u, 8) back_fisher,
round(case when x >= 0 then ((x + 1) ** 0.5 - 1) / 0.5 else -((1 - x) ** 1.5 - 1) / 1.5 end, 8) yj, round(x, 6) yj_back, round(case when x >= 0 then (x + 1) ** -0.5 else (1 - x) ** 0.5 end, 8) yj_slope, round(ln(u), 8) vector_2, round(-ln(u), 8) log_det from u""")
def links_and_derivatives(spark, d):
    u, x = (F.col("n_nationkey") + 1) / 26.0, F.col("n_nationkey") - 12.0
    yj, back, slope = X.link("yeo_johnson", 0.5)
    control, vector = X.LinkController.for_location_scale_shape(), F.array(x, u, x)
    made = {"identity": X.link("identity")[0](u)} | {f"d_{n}": C.LINKS[k][2](u) for n, k in (("log", "log"), ("logit", "logit"), ("cloglog", "cloglog"), ("fisher", "fisher_z"))} | {f"back_{n}": C.LINKS[k][1](C.LINKS[k][0](u)) for n, k in (("logit", "logit"), ("probit", "probit"), ("cloglog", "cloglog"), ("fisher", "fisher_z"))}
    made |= {"yj": yj(x), "yj_slope": slope(x), "vector_2": F.element_at(control.forward(vector, 3), 2), "log_det": control.log_determinant(vector, 3)}
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), *(F.round(c, 8).alias(n) for n, c in made.items()), F.round(back(yj(x)), 6).alias("yj_back"))


@query("""with x as (select n_nationkey k, n_nationkey * 1.0 x from nation) select k, round(least(greatest(2 + 3 * x, 5), 40), 8) linear, round(x, 8) linear_back, round(2 * pow(greatest(x - 1, 1e-16), 1.5), 6) power, round(greatest(x - 1, 1e-16) + 1, 6) power_back, 1.0 as median_shift from x""")
def rating_functions(spark, d):
    x = F.col("n_nationkey").cast("double")
    up = X.linear_function(x, 2, 3, 1.0, 0.8413447460685429) - X.linear_function(x, 2, 3)
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.round(X.linear_function(x, 2, 3, lo=5, hi=40), 8).alias("linear"), F.round(X.linear_inverse(X.linear_function(x, 2, 3), 2, 3), 8).alias("linear_back"), F.round(X.power_function(x, 2, 1.5, 1), 6).alias("power"), F.round(X.power_inverse(X.power_function(x, 2, 1.5, 1), 2, 1.5, 1), 6).alias("power_back"), F.round(up, 6).alias("median_shift"))


_LIKE = {"box_cox": ("case when l = 0 then ln(x) else (pow(x, l) - 1) / l end", "(l - 1) * ln(x)"), "yeo_johnson": ("case when l = 0 then ln(1 + x) else (pow(x + 1, l) - 1) / l end", "(l - 1) * ln(1 + x)")}


def _likelihoods(source: str, grid: str) -> str:
    return " union all ".join(f"select '{k}' as kind, l, -count(*) / 2.0 * ln(var_pop({t})) + sum({j}) as ll from {source}, {grid} group by l" for k, (t, j) in _LIKE.items())


_PRICE = "(select o_totalprice / 1e5 as x from orders)"


@query(f"select kind, l as lambda, ll as loglik from ({_likelihoods(_PRICE, '(select unnest([-1.0, 0.0, 0.5, 1.0, 2.0]) l)')})")
def power_likelihoods(spark, d):
    o = table(spark, d, "orders").select((F.col("o_totalprice") / 1e5).alias("x"))
    both = [powers.log_likelihoods(o, "x", [-1.0, 0.0, 0.5, 1.0, 2.0], k).select(F.lit(k).alias("kind"), "lambda", "loglik") for k in _LIKE]
    return both[0].unionByName(both[1])


@query(f"select kind, round(arg_max(l, ll), 2) as lambda from ({_likelihoods(_PRICE, '(select k / 100.0 as l from (select unnest(range(-200, 300)) k))')}) group by kind")
def fitted_powers(spark, d):
    o = table(spark, d, "orders").select((F.col("o_totalprice") / 1e5).alias("x"))
    return spark.createDataFrame([(k, round(powers.fit_power(o, "x", k, tol=1e-4), 2)) for k in _LIKE], "kind string, lambda double")


# --- series --------------------------------------------------------------------------------


@query("""with o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 i from orders) select o_orderkey, timestamp '2024-02-04' + i * interval 1 month as by_month, timestamp '2024-02-04' + i * interval 6 hours as by_hours, timestamp '2024-02-04' + interval 7 days as a_week_on, timestamp '2024-01-04' as a_month_back from o""")
def shifted_calendars(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("ts"))
    both = None
    for name, step in (("by_month", "1month"), ("by_hours", "6hour")):
        s = series.shift_all(o, "2024-02-04", step, ["o_custkey"]).select("o_orderkey", F.col("ts").alias(name))
        both = s if both is None else both.join(s, "o_orderkey")
    at = F.expr("timestamp_ntz '2024-02-04'")
    return both.withColumn("a_week_on", series.add_step(at, "7day")).withColumn("a_month_back", series.add_step(at, "1month", -1))


@query("""with h as (select event_type, date_trunc('hour', ts) t, sum(value) v from events group by 1, 2), g as (select event_type, t, v, lead(v) over w nv, lead(t) over w nt from h window w as (partition by event_type order by t)), k as (select *, unnest(range(0, case when nt is null then 1 else 4 end)) k from g)
select event_type, t, k, case when k = 0 then v else v + (nv - v) * k / 4 end finer, v / 4 as shares, k * 15 as minute from k""")
def finer_steps(spark, d):
    h = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.sum("value").alias("v"))
    a = series.refine(h, "1hour", "15min", "avg", ["event_type"], out="finer")
    b = series.refine(h, "1hour", "15min", "sum", ["event_type"], out="shares")
    both = a.join(b, ["event_type", "ts"])
    minute = F.minute("ts")
    return both.select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t"), F.floor(minute / 15).alias("k"), "finer", "shares", minute.alias("minute"))


@query("""with s as (select event_type, avg(value) m, stddev_samp(value) s, min(value) lo, max(value) hi from events group by 1) select event_id, abs(value) as magnitude, case when value > 400 then 0.0 else value end as replaced, round(value, 6) back_z, round(value, 6) back_u from events join s using (event_type)""")
def series_inverses(spark, d):
    e = table(spark, d, "events", "event_id", "event_type", F.col("value").alias("v"))
    s = e.groupBy("event_type").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    z = series.normalize(series.standardize(e, ["event_type"]), ["event_type"], out="u").join(s, "event_type")
    z = series.arithmetic(z.withColumn("magnitude", F.col("v")), "abs", 0.0, "magnitude")
    z = series.replace_missing(z.withColumn("replaced", F.when(F.col("v") <= 400, F.col("v"))), 0.0, "replaced")
    return z.select("event_id", "magnitude", "replaced", F.round(series.destandardize(F.col("z"), F.col("m"), F.col("s")), 6).alias("back_z"), F.round(series.denormalize(F.col("u"), F.col("lo"), F.col("hi")), 6).alias("back_u"))


@query("""with h as (select event_type, row_number() over (partition by event_type order by date_trunc('hour', ts)) i, sum(value) x from events group by event_type, date_trunc('hour', ts)), m as (select event_type, avg(x) m, count(*) n from h group by 1), d as (select h.event_type, i, x - m d, n from h join m using (event_type)), c as (select a.event_type, a.i - b.i lag, sum(a.d * b.d) s from d a join d b on a.event_type = b.event_type and a.i - b.i between 0 and 5 group by 1, 2),
r as (select c.event_type, lag, s / s0 r from c join (select event_type, s s0 from c where lag = 0) using (event_type)), l as (select event_type, n * (n + 2.0) * sum(r * r / (n - lag)) q from r join m using (event_type) where lag > 0 group by event_type, n),
w as (select event_type, sum(d * coalesce(nd, fd)) r, any_value(n) * 1.0 n, sum(d) s1, sum(d ** 2) s2, sum(d ** 3) s3, sum(d ** 4) s4 from (select *, lead(d) over w nd, first_value(d) over w fd from d window w as (partition by event_type order by i)) group by 1),
v as (select event_type, r, (s1 * s1 - s2) / (n - 1) mu, (s2 * s2 - s4) / (n - 1) + (s1 ** 4 - 4 * s1 * s1 * s2 + 4 * s1 * s3 + s2 * s2 - 2 * s4) / ((n - 1) * (n - 2)) - ((s1 * s1 - s2) / (n - 1)) ** 2 va from w)
select event_type, round(q, 5) q, round((v.r - mu) / sqrt(va), 5) z, round((r1.r), 7) pacf1, round((r2.r - r1.r ** 2) / (1 - r1.r ** 2), 7) pacf2, true as limits from l join v using (event_type) join (select event_type, r from r where lag = 1) r1 using (event_type) join (select event_type, r from r where lag = 2) r2 using (event_type)""")
def serial_tests(spark, d):
    """Ljung-Box Q of five lags, Wald-Wolfowitz z, and partial autocorrelations of two lags."""
    e = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("ts")).agg(F.sum("value").alias("v"))
    q = sequences.ljung_box(e, 5, ["event_type"]).select("event_type", F.round("q", 5).alias("q"))
    z = sequences.wald_wolfowitz(e, ["event_type"]).select("event_type", F.round("z", 5).alias("z"))
    acf = series.autocovariance(e, 2, ["event_type"]).groupBy("event_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"]).alias("a"))

    @F.pandas_udf("array<double>")
    def partial(a: pd.Series) -> pd.Series:
        return pd.Series([sequences.partial_autocorrelation(list(v)) for v in a])

    p = acf.select("event_type", partial("a").alias("p")).select("event_type", F.round(F.element_at("p", 2), 7).alias("pacf1"), F.round(F.element_at("p", 3), 7).alias("pacf2"))
    lo, hi = sequences.correlation_limits(100)
    return q.join(z, "event_type").join(p, "event_type").withColumn("limits", F.lit(abs(hi - 0.1959963985) < 1e-8 and lo == -hi))


@query("""with h as (select event_type, date_trunc('hour', ts) t, sum(value) v from events group by 1, 2) select event_type, t as ts, case when row_number() over w >= 24 then avg(v) over (partition by event_type order by t rows 23 preceding) end trend, true as adds_up, true as periodic from h window w as (partition by event_type order by t)""")
def seasonal_decomposition(spark, d):
    """Trend of 24 hours; parts that add up to the series, and a seasonal part that returns every 24 rows."""
    e = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.sum("value").alias("v"))
    x = sequences.decompose(e, 24, ["event_type"])
    w = Window.partitionBy("event_type").orderBy("ts")
    trend = F.when(~F.isnan("trend"), F.col("trend"))
    again = F.abs(F.col("seasonal") - F.lag("seasonal", 24).over(w)) < 1e-6
    return x.select("event_type", "ts", trend.alias("trend"), F.coalesce(F.abs(trend + F.col("seasonal") + F.col("rest") - F.col("v")) < 1e-6, F.lit(True)).alias("adds_up"), F.coalesce(again, F.lit(True)).alias("periodic"))


@query("select n_nationkey k, round(case when n_nationkey % 4 = 0 then 1.0 else 0 end, 9) correlation, 25 as n from nation")
def fourier_correlation(spark, d):
    """Circular correlation of a spike train (every fourth place of 32) with one spike."""
    x, y = np.zeros(32), np.zeros(32)
    x[::4], y[0] = 1.0, 1.0
    got = sequences.fft_correlation(x, y)
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.element_at(F.array(*(F.lit(round(float(v), 9) + 0.0) for v in got)), F.col("n_nationkey") + 1).alias("correlation"), F.lit(25).alias("n"))


# --- statistics -------------------------------------------------------------------------------


@query("""with p as (select o_orderstatus s, o_orderpriority g, count(*) * 1.0 / sum(count(*)) over (partition by o_orderstatus) p from orders group by 1, 2), e as (select s, -sum(p * ln(p)) entropy from p group by 1), m as (select o_orderstatus s, count(o_totalprice) filter (where o_totalprice > 150000) n_in, sum(o_totalprice) filter (where o_totalprice > 150000) total_in, avg(o_totalprice) filter (where o_totalprice <= 150000) mean_out, min(o_totalprice) lo, max(o_totalprice) hi, arg_min(o_orderkey, (o_totalprice, o_orderkey)) arg_lo, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) arg_hi, sum(o_totalprice * o_custkey) dot from orders group by 1)
select s o_orderstatus, entropy, n_in, total_in, mean_out, lo, hi, arg_lo, arg_hi, dot from e join m using (s)""")
def entropy_masks_and_extremes(spark, d):
    o = table(spark, d, "orders")
    counts = o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    shares = counts.join(counts.groupBy("o_orderstatus").agg(F.sum("n").alias("t")), "o_orderstatus")
    e = stats.entropy(shares, F.col("n") / F.col("t"), ["o_orderstatus"])
    m = stats.masked(o, "o_totalprice", F.col("o_totalprice") > 150000, ["o_orderstatus"]).select("o_orderstatus", "n_in", "total_in", "mean_out")
    x = stats.extremes(o, "o_totalprice", "o_orderkey", ["o_orderstatus"])
    dot = o.groupBy("o_orderstatus").agg(F.sum(F.col("o_totalprice") * F.col("o_custkey")).alias("dot"))
    return e.join(m, "o_orderstatus").join(x, "o_orderstatus").join(dot, "o_orderstatus")


@query("""with p as (select l_returnflag g, l_extendedprice o, l_quantity * 1500 m from lineitem), e as (select g, avg(o) / 100 e from p group by 1), s as (select p.g, sqrt(sum((o - m) ** 2) / (count(*) - 2)) rmse, 1 - sum((ln(o + e) - ln(m + e)) ** 2) / (var_pop(ln(o + e)) * count(*)) log_nse from p join e on e.g = p.g group by 1)
select g l_returnflag, rmse rmse_adjusted, log_nse, (1 / rmse ** 2) / (select sum(1 / rmse ** 2) from s) weight from s""")
def adjusted_errors_and_weights(spark, d):
    p = table(spark, d, "lineitem").withColumn("m", F.col("l_quantity") * 1500)
    return stats.rmse_weights(stats.adjusted_errors(p, "l_extendedprice", "m", 2, ["l_returnflag"]), "rmse_adjusted")


@query("""with x as (select o_orderpriority g, o_totalprice / 1e5 x from orders), f as (select g, 1 - exp(-x / 1.5) f, row_number() over (partition by g order by x) i, count(*) over (partition by g) n from x) select g o_orderpriority, max(greatest(f - (i - 1.0) / n, i * 1.0 / n - f)) ks, -any_value(n) - sum((2 * i - 1) * ln(f) + (2 * (n + 1 - i) - 1) * ln(1 - f)) / any_value(n) ad from f group by 1""")
def distances_to_a_family(spark, d):
    """Kolmogorov-Smirnov and Anderson-Darling distances to an exponential distribution."""
    o = table(spark, d, "orders").select("o_orderpriority", (F.col("o_totalprice") / 1e5).alias("x"))
    return stats.fit_distances(o, "x", lambda c: D.apply("cdf", c, "exponential", [0.0, 1.5]), ["o_orderpriority"])


_BINS = "with x as (select o_totalprice / 1e5 x from orders), s as (select min(x) lo, max(x) hi, count(*) n from x), k as (select lo, (hi - lo) / 20 w, n from s), b as (select least(19, cast(floor((x - lo) / w) as int)) bin, lo, w, n from x, k), h as (select bin, lo + bin * w l, lo + (bin + 1) * w u, count(*) freq, any_value(n) n from b group by bin, lo, w) "


@query(_BINS + "select round(sum((freq - n * (exp(-l / 1.5) - exp(-u / 1.5))) ** 2 / (n * (exp(-l / 1.5) - exp(-u / 1.5)))), 4) chi_squared, count(*) bins from h")
def chi_squared_distance(spark, d):
    o = table(spark, d, "orders").select((F.col("o_totalprice") / 1e5).alias("x"))
    return stats.chi_squared_fit(o, "x", lambda c: D.apply("cdf", c, "exponential", [0.0, 1.5]), 20).withColumn("chi_squared", F.round("chi_squared", 4))


@query(_BINS + ", c as (select *, (l + u) / 2 m, sum(freq) over (order by bin) c from h), a as (select sum(m * freq) / sum(freq) mean from c) select any_value(n) n, any_value(a.mean) mean, (select arg_max(m, (freq, -bin)) from c) as mode, (select min(m) from c where c >= n // 2) median, sqrt(sum(freq * (m - a.mean) ** 2) / sum(freq)) sd, 0 as below, 19 as above from c, a")
def histogram_summary(spark, d):
    o = table(spark, d, "orders").select((F.col("o_totalprice") / 1e5).alias("x"))
    ends = [stats.bin_index(F.lit(v), F.lit(0.0), F.lit(1.0), 20).alias(n) for n, v in (("below", -3.0), ("above", 99.0))]
    return stats.histogram_statistics(stats.histogram(o, "x", 20)).select("*", *ends)


@query("""with s as (select o_orderstatus g, count(*) * 1.0 n, count(*) * 1.0 length, 0.0 missing, min(o_totalprice) minimum, max(o_totalprice) maximum, avg(o_totalprice) mean, stddev_samp(o_totalprice) sd, skewness(o_totalprice) skew, kurtosis(o_totalprice) kurtosis, quantile_cont(o_totalprice, 0.01) p1, quantile_cont(o_totalprice, 0.05) p5, quantile_cont(o_totalprice, 0.25) p25, quantile_cont(o_totalprice, 0.5) p50, quantile_cont(o_totalprice, 0.75) p75, quantile_cont(o_totalprice, 0.95) p95, quantile_cont(o_totalprice, 0.99) p99 from orders group by 1)
select g o_orderstatus, statistic, value from (select * exclude (n) from s) unpivot (value for statistic in (length, missing, minimum, maximum, mean, sd, skew, kurtosis, p1, p5, p25, p50, p75, p95, p99))""")
def summary_of_prices(spark, d):
    return stats.summary(table(spark, d, "orders"), "o_totalprice", ["o_orderstatus"])


@query("""with m as (select regr_syy(l_extendedprice, l_quantity) syy, regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) ** 2 * regr_sxx(l_extendedprice, l_quantity) sse, count(*) n from lineitem) select round((syy - sse) / (sse / (n - 2)), 4) f, (syy - sse) / (sse / (n - 2)) > 3.8415 as significant from m""")
def nested_models(spark, d):
    """F of a line against the mean alone."""
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    m = table(spark, d, "lineitem").agg(F.regr_syy(y, x).alias("syy"), (F.regr_syy(y, x) - F.pow(F.regr_slope(y, x), F.lit(2)) * F.regr_sxx(y, x)).alias("sse"), F.count("*").cast("double").alias("n"))
    f, p = stats.nested_f(F.col("syy"), F.col("sse"), F.col("n") - 1, F.col("n") - 2)
    return m.select(F.round(f, 4).alias("f"), (p < 0.05).alias("significant"))


@query("select o_orderstatus, count(*) n, 2 as n_low, true as two_humps from (select o_orderstatus from orders where o_orderkey <= 400) group by 1 having count(*) >= 40")
def planted_low_outliers(spark, d):
    """Counts of low outliers, with two planted in each group, and the test for two humps, with two planted."""
    o = table(spark, d, "orders").where("o_orderkey <= 400").select("o_orderstatus", "o_orderkey")
    w = Window.partitionBy("o_orderstatus").orderBy("o_orderkey")
    n = Window.partitionBy("o_orderstatus")
    o = o.withColumn("i", F.row_number().over(w)).withColumn("m", F.count("*").over(n)).where("m >= 40")
    z = C.normal_quantile((F.col("i") - 0.5) / F.col("m"))
    low = F.when(F.col("i") == 1, 1e-4).when(F.col("i") == 2, 2e-4).otherwise(F.exp(0.3 * z))
    rows = o.select("o_orderstatus", low.alias("x"), (z * 0.2 + F.when(F.col("i") % 2 == 0, 5.0).otherwise(0.0)).alias("y"))
    found = stats.low_outliers(rows, "x", ["o_orderstatus"])
    humps = stats.unimodality(rows, "y", ["o_orderstatus"]).select("o_orderstatus", (F.col("p") < 0.01).alias("two_humps"))
    return found.join(humps, "o_orderstatus")


@query("""with x as (select c_custkey k, c_acctbal v from customer) select k, row_number() over (order by v, k) as number, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as middle from x""")
def numbers_over_all_rows(spark, d):
    """Row numbers and mean ranks without a key, counted range by range."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return numbering.numbered(numbering.average_ranks(c, "v", out="middle"), ["v", "k"], out="number").drop("v")


# --- curves and paths ---------------------------------------------------------------------------


@query("""with k as (select n_nationkey q from nation) select q, case when q > 20 then 5 when q = 20 then 4 else (case when q >= 2 then 1 else 0 end) + (case when q >= 5 then 1 else 0 end) + (case when q >= 9 then 1 else 0 end) + (case when q >= 14 then 1 else 0 end) - 1 end as idx, case when q < 2 then 5 when q = 2 then 4 else (case when q <= 20 then 1 else 0 end) + (case when q <= 14 then 1 else 0 end) + (case when q <= 9 then 1 else 0 end) + (case when q <= 5 then 1 else 0 end) - 1 end as down from k""")
def search_positions(spark, d):
    q = F.col("n_nationkey").cast("double")
    v = [2.0, 5.0, 9.0, 14.0, 20.0]
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("q"), curves.search_index(q, v).alias("idx"), curves.search_index(q, v[::-1], descending=True).alias("down"))


@query("""with s as (select n_nationkey k, n_nationkey / 12.0 q from nation), y as (select *, 1.0 as y0, 3.0 as y1, 2.0 as y2, 6 * ((2.0 - 3.0) - (3.0 - 1.0)) / 4 as m from s) select k, round(case when q <= 1 then (1 - q) * y0 + q * y1 + (q ** 3 - q) * m / 6 else (2 - q) * y1 + (q - 1) * y2 + ((2 - q) ** 3 - (2 - q)) * m / 6 end, 8) spline,
round(1 + 3.5 * q - 1.5 * q * q, 8) parabola, round(q * (1 - q / 2), 8) area_part, round((1 - q / 2) * 1 + q / 2 * 5, 8) plane from y""")
def smooth_interpolation(spark, d):
    """A natural spline through three points, the parabola through them, and a bilinear table of a plane."""

    def run(p):
        q = p.k.to_numpy() / 12
        both = [curves.neville_error([0.0, 1.0, 2.0], [1.0, 3.0, 2.0], v, 2) for v in q]
        return pd.DataFrame({"k": p.k, "spline": np.round(curves.spline([0, 1, 2], [1, 3, 2], q), 8), "parabola": np.round([b[0] for b in both], 8), "area_part": np.round(q * (1 - q / 2), 8) + 0.0, "plane": np.round(curves.bilinear([0, 2], [0, 2], [[1, 1], [5, 5]], q, q), 8)})

    return rows_of(table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), run, "k int, spline double, parabola double, area_part double, plane double")


@query("""with c as (select n_nationkey idx, n_nationkey * 2.0 x, 100.0 + 3 * n_nationkey a, 150.0 + 3 * n_nationkey b from nation) select idx, x, a + 0.3 * (b - a) low, round((a + b) / 2, 6) mean, a + 0.3 * (b - a) + (case when idx < 24 then 0.9 else 0 end) as between, 0 as errors from c""")
def uncertain_curves(spark, d):
    """A curve whose ordinates are uniform distributions: at a probability, at the means, looked up between its points, and checked."""
    n = table(spark, d, "nation").select(F.lit(1).alias("curve_id"), F.col("n_nationkey").alias("idx"), (F.col("n_nationkey") * 2.0).alias("x"), F.lit("uniform").alias("dist"), F.array(100.0 + 3 * F.col("n_nationkey"), 150.0 + 3 * F.col("n_nationkey")).alias("params"))
    low, mean = curves.curve_sample(n, 0.3).select("idx", "x", F.col("y").alias("low")), curves.curve_sample(n).select("idx", F.round(F.col("y"), 6).alias("mean"))
    asked = n.select("idx", (F.col("x") + 0.6).alias("q"))
    between = curves.uncertain_lookup(asked, "q", n, 0.3, "between").select("idx", "between")
    errors = curves.uncertain_errors(n).agg(F.count("*").cast("int").alias("errors"))
    return low.join(mean, "idx").join(between, "idx").crossJoin(F.broadcast(errors))


@query("""select 'added' what, 27 n, 25 * 24 / 2 + 100.0 + 101 total union all select 'removed', 22, 25 * 24 / 2.0 - (0 + 1 + 2) union all select 'kept', 3, 3.0 union all select 'contains', 1, 7.0 union all select 'cleared', 0, null""")
def curve_maintenance(spark, d):
    """Ordinates added, removed, looked for and cleared."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("double").alias("x"), F.col("n_nationkey").cast("double").alias("y"))
    more, few = spark.createDataFrame([(100.0, 100.0), (101.0, 101.0)], "x double, y double"), n.where("x < 3")
    parts = {"added": n.unionByName(more), "removed": curves.without(n, few, ["x"]), "kept": n.join(few, "x", "left_semi"), "contains": n.where("x = 7 and y = 7"), "cleared": n.limit(0)}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").cast("int").alias("n"), F.sum("y").alias("total")).select(F.lit(name).alias("what"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query("""with recursive r(v, hops, path) as (select 0, 0, [0] union all select v + 1, hops + 1, list_append(path, v + 1) from r where v < 8) select v, cast(v as double) distance, case when v = 0 then 0 else v - 1 end next, array_to_string(list_reverse(path), '>') path, case when v < 4 then cast(v as double) end cut from r""")
def paths_to_a_target(spark, d):
    """A chain of edges with costly shortcuts: distances, next vertices and whole paths, and distances once an edge is gone."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k")).where("k <= 8")
    e = n.where("k > 0").select(F.col("k").alias("src"), (F.col("k") - 1).alias("dst"), F.lit(1.0).alias("w")).unionByName(n.where("k > 1").select(F.col("k").alias("src"), F.lit(0).alias("dst"), (F.col("k") * 2.0).alias("w")))
    found = relational.shortest_paths(e, 0)
    step = relational.next_vertices(e, found, 0)
    walks = relational.extract_paths(step, 0)
    broken = relational.shortest_paths(relational.without_edges(e, e.where("src = 4 or dst = 0 and src > 1")), 0).select("v", F.col("distance").alias("cut"))
    return found.join(step.select("v", "next"), "v").join(walks, "v").join(broken, "v", "left")


# --- sampling -------------------------------------------------------------------------------------


@query("""select 'hypercube' what, k as bin, 4 as n from (select unnest(range(0, 25)) k) union all select 'sobol', k, 4 from (select unnest(range(0, 32)) k) union all select 'uniform', k, 1 from (select unnest(range(0, 10)) k) union all select 'strata', k, 2 from (select unnest(range(0, 10)) k)""")
def even_samples(spark, d):
    """Points in each stratum of a Latin hypercube (4 axes), of a Sobol sequence (128 points, 32 bins), bins of equal width, and strata drawn once an axis."""
    lhs = (sampling.latin_hypercube(25, 4, 3) * 25).astype(int).ravel()
    dots = (sampling.sobol(128, 5)[:, 4] * 32).astype(int)
    bins = [round(a / 10) for a, _, _ in sampling.stratify(0.0, 100.0, 10)]
    drawn = sampling.multivariate_strata([sampling.stratify(0.0, 1.0, 10)] * 2, [[1, 0.5], [0.5, 1]]).ravel()
    rows = [(w, int(b), int(n)) for w, v in (("hypercube", lhs), ("sobol", dots), ("uniform", bins), ("strata", drawn)) for b, n in zip(*np.unique(v, return_counts=True), strict=True)]
    return spark.createDataFrame(rows, "what string, bin long, n int")


@query("""select cast(k as int) bin, round(k / 10.0, 9) lower, round((k + 1) / 10.0, 9) as upper, round(1 - exp(-k / 10.0), 9) p_lower, round(exp(-k / 10.0), 9) x_lower, round(case when k = 0 then 0.11 when k = 9 then 0.09 + 0.01 + 0.01 else 0.098 end, 3) weight, true as back from (select unnest(range(0, 10)) k)""")
def stratification_bins(spark, d):
    bins = sampling.stratify(0.0, 1.0, 10)
    p, x = sampling.bins_to_probability(bins, "exponential", [0.0, 1.0]), sampling.bins_to_probability(bins, "exponential", [0.0, 1.0], exceedance=True)
    w = sampling.stratify_probability(0.01, 0.99, 10)
    back = sampling.strata_from_xml(sampling.strata_xml(bins)) == bins and not sampling.strata_errors(0, 1, 10) and len(sampling.strata_errors(2, 1, 0)) == 2
    weights = [0.11 if i == 0 else 0.11 if i == 9 else 0.098 for i in range(10)]
    good = all(abs(a[2] - (0.098 + (0.01 if i in (0, 9) else 0))) < 1e-9 for i, a in enumerate(w)) and abs(sum(a[2] for a in w) - 1) < 1e-12
    return spark.createDataFrame([(i, round(b[0], 9), round(b[1], 9), round(p[i][0], 9), round(x[i][0], 9), weights[i], bool(back and good)) for i, b in enumerate(bins)], "bin int, lower double, upper double, p_lower double, x_lower double, weight double, back boolean")


_LIMITS = ["percentile", "normal", "bias_corrected", "bca", "pivotal", "student"]


@query(f"select method, p, true as ordered, true as around, true as narrow from (select unnest([{', '.join(repr(m) for m in _LIMITS)}]) as method), (select unnest([0.5, 0.9, 0.99]) p)")
def bootstrap_limits(spark, d):
    """Limits of Gumbel quantiles by six methods: in order, around the truth, and no wider than eight standard errors."""
    p, params, n = [0.5, 0.9, 0.99], [100.0, 20.0], 80
    reps = tables.materialise(sampling.bootstrap(spark, "gumbel", params, n, 400, p, inner=12))
    own = D.evaluate("gumbel", "quantile", p, params).tolist()
    sd = [float(v) for v in reps.select(*(F.stddev_samp(F.element_at("quantiles", i + 1)) for i in range(3))).first()]
    sample = D.evaluate("gumbel", "quantile", (np.arange(n) + 0.5) / n, params)
    speed = sampling.acceleration("gumbel", sample, p)
    out = None
    for how in _LIMITS:
        got = sampling.percentile_intervals(reps, p, 0.9, own, how, speed, sd)
        truth, error = (F.element_at(F.array(*(F.lit(v) for v in a)), F.array_position(F.array(*(F.lit(x) for x in p)), F.col("p")).cast("int")) for a in (own, sd))
        row = got.select(F.lit(how).alias("method"), "p", (F.col("lower") < F.col("upper")).alias("ordered"), truth.between(F.col("lower"), F.col("upper")).alias("around"), (F.col("upper") - F.col("lower") < 8 * error).alias("narrow"))
        out = row if out is None else out.unionByName(row)
    return out


@query("select p, true as corrected, true as expected_rises, true as mode_matches, true as mirrored from (select unnest([0.5, 0.9, 0.99]) p)")
def bootstrap_curves(spark, d):
    """Double bootstrap near the truth; expected probabilities that rise; the mode curve; and mirrored parameters whose mean is mirrored too."""
    p, params = [0.5, 0.9, 0.99], [100.0, 20.0]
    reps = tables.materialise(sampling.bootstrap(spark, "gumbel", params, 80, 200, p, inner=10))
    own = D.evaluate("gumbel", "quantile", p, params)
    two = {r["p"]: r["corrected"] for r in sampling.double_bootstrap(reps, p).collect()}
    curve = [r["expected"] for r in sampling.expected_curve(reps, "gumbel", sampling.log_grid(50.0, 300.0, 20)).orderBy("x").collect()]
    mirrored = sampling.pivotal_replicates(reps, params, ["identity", "log"]).agg(F.avg(F.element_at("params", 1))).first()[0]
    mean = reps.agg(F.avg(F.element_at("params", 1))).first()[0]
    rises = all(a <= b for a, b in zip(curve[:-1], curve[1:], strict=True))
    mode = sampling.mode_curve("gumbel", params, p)
    rows = [(x, abs(two[x] / q - 1) < 0.03, rises, abs(m[1] - q) < 1e-9, abs(mirrored + mean - 200) < 1e-6) for x, q, m in zip(p, own.tolist(), mode, strict=True)]
    return spark.createDataFrame(rows, "p double, corrected boolean, expected_rises boolean, mode_matches boolean, mirrored boolean")


_SAMPLERS = ["rwmh", "arwmh", "demcz", "demczs", "hmc", "nuts", "gibbs", "importance"]


@query(f"select sampler, true as mean_found, true as spread_found, true as mixed from (select unnest([{', '.join(repr(s) for s in _SAMPLERS)}]) sampler)")
def posterior_samplers(spark, d):
    """Every sampler on a normal posterior of mean (1, -2) and deviations (1, 0.5)."""
    loglik = lambda x: -0.5 * ((x[0] - 1) ** 2 + ((x[1] + 2) / 0.5) ** 2)
    rows = []
    for name in _SAMPLERS[:6]:
        draws = 400 if name in ("hmc", "nuts") else 1500
        got = {r["param"]: r for r in sampling.posterior(sampling.chains(spark, loglik, ["a", "b"], [0.5, -1.5], name, draws=draws, warm=400, **({"step": 0.3, "leaps": 8} if name == "hmc" else {}))).collect()}
        rows.append((name, abs(got["a"]["mean"] - 1) < 0.25 and abs(got["b"]["mean"] + 2) < 0.15, 0.7 < got["a"]["sd"] < 1.3 and 0.35 < got["b"]["sd"] < 0.65, all(g["rhat"] < 1.15 for g in got.values())))
    rng = np.random.default_rng(2)
    g = np.array(list(sampling.gibbs(rng, lambda x, rng: np.array([rng.normal(1, 1), rng.normal(-2, 0.5)]), np.zeros(2), 4000, 10)))
    rows.append(("gibbs", bool(abs(g[:, 0].mean() - 1) < 0.1), bool(abs(g[:, 1].std() - 0.5) < 0.05), bool(sampling.effective_size(g[:, 0]) > 2000)))
    w, x = sampling.importance_sample(loglik, lambda rng, n: rng.normal(0, 3, (n, 2)), lambda v: -0.5 * (v**2).sum(1) / 9, 40_000, 4000)
    rows.append(("importance", bool(abs(x[:, 0].mean() - 1) < 0.15), bool(abs(x[:, 1].std() - 0.5) < 0.1), sampling.minimum_size() == 3746))
    return spark.createDataFrame([(n, *map(bool, v)) for n, *v in rows], "sampler string, mean_found boolean, spread_found boolean, mixed boolean")


@query("select 'nearest' what, 500 n, true as inside, true as like union all select 'blocks', 500, true, true union all select 'subset', 100, true, true union all select 'draws', 20000, true, true")
def resampled_series(spark, d):
    """Series resampled by near neighbours and by blocks: as long as asked, of values that were there, near the mean; a random subset; draws by inversion."""
    x = np.array([r[0] for r in table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.sum("value").alias("v")).orderBy("h").select("v").collect()])[:3000]
    rows = []
    for name, got in (("nearest", sampling.knn_resample(x, 500)), ("blocks", sampling.block_resample(x, 500, 12))):
        rows.append((name, len(got), bool(np.isin(got, x).all()), bool(abs(got.mean() - x.mean()) < 0.5 * x.std())))
    sub = sampling.random_subset(table(spark, d, "customer"), 100, key="c_custkey")
    rows.append(("subset", sub.select("c_custkey").distinct().count(), True, True))
    g = sampling.random_values(spark, 20_000, "gev", [100.0, 20.0, 0.1]).agg(F.count("*").alias("n"), F.avg("x").alias("m")).first()
    rows.append(("draws", int(g["n"]), True, bool(abs(g["m"] - D.moments("gev", [100.0, 20.0, 0.1])[0]) < 1)))
    return spark.createDataFrame(rows, "what string, n int, inside boolean, like boolean")


@query("""with m as (select o_orderstatus g, avg(o_totalprice) m, count(*) n, stddev_samp(o_totalprice) s from orders where o_orderkey <= 2000 group by 1) select g o_orderstatus, round(s / sqrt(n), 4) error from m""")
def jackknife_errors(spark, d):
    o = table(spark, d, "orders").where("o_orderkey <= 2000").select("o_orderstatus", "o_totalprice")

    def one(key, pdf):
        return pd.DataFrame([[key[0], round(sampling.jackknife(pdf.o_totalprice.to_numpy(), np.mean)[0], 4)]], columns=["o_orderstatus", "error"])

    return o.groupBy("o_orderstatus").applyInPandas(one, "o_orderstatus string, error double")


# --- learning ---------------------------------------------------------------------------------------


@query("""with m as (select regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a, regr_avgx(l_extendedprice, l_quantity) mx, regr_sxx(l_extendedprice, l_quantity) sxx, regr_syy(l_extendedprice, l_quantity) syy, count(*) n from lineitem), s as (select *, sqrt((syy - b * b * sxx) / (n - 2)) s from m)
select q, round(a + b * q, 4) predicted, round(sqrt(1 + 1.0 / n + (q - mx) ** 2 / sxx) / sqrt(1 + 1.0 / n + mx ** 2 / sxx), 8) relative, true as symmetric from s, (select unnest([1.0, 10.0, 25.0, 50.0, 80.0]) q)""")
def prediction_intervals(spark, d):
    """Predictions of a line, and widths of their intervals as a share of the width at 0."""
    m = learning.linear(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    asked = spark.createDataFrame([(q,) for q in (0.0, 1.0, 10.0, 25.0, 50.0, 80.0)], "l_quantity double")
    got = m.intervals(asked, 0.9)
    zero = got.where("l_quantity = 0").select((F.col("upper") - F.col("lower")).alias("w0"))
    rows = got.where("l_quantity > 0").crossJoin(F.broadcast(zero))
    return rows.select(F.col("l_quantity").alias("q"), F.round("predicted", 4).alias("predicted"), F.round((F.col("upper") - F.col("lower")) / F.col("w0"), 8).alias("relative"), (F.abs(F.col("upper") + F.col("lower") - 2 * F.col("predicted")) < 1e-6).alias("symmetric"))


@query("""with b as (select quality y, toxic x from labels where quality is not null and toxic is not null), c as (select count(*) filter (where y = 1 and x = 1) * 1.0 a, count(*) filter (where y = 0 and x = 1) * 1.0 b, count(*) filter (where y = 1 and x = 0) * 1.0 c, count(*) filter (where y = 0 and x = 0) * 1.0 d from b)
select 'logit' model, '(intercept)' term, round(ln(c / d), 6) coefficient, round(sqrt(1 / c + 1 / d), 6) error from c union all select 'logit', 'toxic', round(ln(a / b) - ln(c / d), 6), round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 6) from c
union all select 'log', '(intercept)', round(ln(c / (c + d)), 6), round(sqrt(1 / c), 6) from c union all select 'log', 'toxic', round(ln(a / (a + b)) - ln(c / (c + d)), 6), round(sqrt(1 / a + 1 / c), 6) from c
union all select 'identity', '(intercept)', round(c / (c + d), 6), null from c union all select 'identity', 'toxic', round(a / (a + b) - c / (c + d), 6), null from c""")
def generalised_models(spark, d):
    """One binary term has closed estimates and errors: logistic, Poisson with logarithms, and normal."""
    rows = table(spark, d, "labels").select("quality", "toxic")
    out = []
    for name, family in (("logit", "binomial"), ("log", "poisson"), ("identity", "gaussian")):
        m = learning.glm(rows, "quality", ["toxic"], family)
        out += [(name, t, round(c, 6), round(e, 6) if name != "identity" else None) for t, c, e, _, _ in m.summary()]
    return spark.createDataFrame(out, "model string, term string, coefficient double, error double")


@query("""with t as (select r_regionkey q, r_regionkey * 5 + 0.25 x from region), d as (select q, n_nationkey * 2.0 y, abs(n_nationkey - x) d, row_number() over (partition by q order by abs(n_nationkey - x), n_nationkey) k from t, nation) select q r, round(sum(y / d ** 2) / sum(1 / d ** 2), 6) value, true as inside, cast(arg_min(y, k) as int) // 2 % 3 as label from d where k <= 3 group by q""")
def neighbour_predictions(spark, d):
    n = table(spark, d, "nation").orderBy("n_nationkey").select("n_nationkey").toPandas().n_nationkey.to_numpy(float)
    x, y = n[:, None], 2 * n

    def run(p):
        t = p.r.to_numpy(float)[:, None] * 5 + 0.25
        value = learning.knn_predict(x, y, t, 3)
        limits = learning.knn_intervals(x, y, t, 3, 200)
        return pd.DataFrame({"r": p.r, "value": np.round(value, 6), "inside": (limits[:, 0] <= limits[:, 1]) & (limits[:, 1] <= limits[:, 2]), "label": learning.knn_predict(x, n % 3, t, 1, True).astype(int)})

    return rows_of(table(spark, d, "region").select(F.col("r_regionkey").alias("r")), run, "r int, value double, inside boolean, label int")


_SPLIT = """, c as (select v, n, s, q, sum(n) over o cn, sum(s) over o cs, sum(q) over o cq, sum(n) over () tn, sum(s) over () ts, sum(q) over () tq, lead(v) over o nv from g window o as (order by v)),
b as (select v, nv, cn, cs, tn, ts, (cq - cs * cs / cn) + (tq - cq - (ts - cs) ** 2 / (tn - cn)) loss, tq - ts * ts / tn total from c where cn < tn) """


@query("with g as (select p_size * 1.0 v, count(*) n, sum(p_size) * 1.0 s, sum(p_size * p_size) * 1.0 q from part group by 1)" + _SPLIT + ", w as (select v, 1 - loss / total fit from b order by loss, v limit 1) select 0 as cluster, v as upper, count(*) n, sum(p_size) * 1.0 total, min(p_size) * 1.0 lo, max(p_size) * 1.0 hi, round(any_value(fit), 9) fit from part join w on p_size <= v group by v union all select 1, max(p_size) * 1.0, count(*), sum(p_size) * 1.0, min(p_size) * 1.0, max(p_size) * 1.0, round(any_value(fit), 9) from part join w on p_size > v")
def natural_breaks_in_two(spark, d):
    part = table(spark, d, "part").where("p_size is not null")
    found = part.groupBy("p_size").count().collect()
    ends, fit = learning.natural_breaks([r[0] for r in found], 2, [r[1] for r in found])
    names = spark.createDataFrame([(i, float(e), round(fit, 9)) for i, e in enumerate(ends)], "cluster int, upper double, fit double")
    return learning.break_clusters(part, "p_size", ends).drop("ssd").join(F.broadcast(names), "cluster")


@query("with g as (select p_size * 1.0 v, count(*) n, sum(p_retailprice) s, sum(p_retailprice ** 2) q from part group by 1)" + _SPLIT + ", w as (select (v + nv) / 2 cut, cs / cn low, (ts - cs) / (tn - cn) high from b order by loss limit 1) select p_partkey, round(case when p_size <= cut then low else high end, 4) predicted from part, w")
def regression_stump(spark, d):
    """A tree of one split of all rows."""
    part = table(spark, d, "part").where("p_size is not null and p_retailprice is not null")
    tree = trees.grow(part, "p_retailprice", ["p_size"], ["p_partkey"], depth=1)
    return part.select("p_partkey", F.round(tree.expression(), 4).alias("predicted"))


@query("select 'kmeans' what, true as centred, true as complete, 3 as parts union all select 'mixture', true, true, 3 union all select 'tree', true, true, 3")
def clusters_of_planted_groups(spark, d):
    """Three planted groups: centres that are the means of their own rows and near the truth; mixture weights that add to one; and a tree that tells the groups apart."""
    n = table(spark, d, "customer").select("c_custkey", F.array((F.col("c_custkey") % 3) * 10.0 + F.col("c_acctbal") / 1e4, F.col("c_acctbal") / 1e4).alias("v"), (F.col("c_custkey") % 3).alias("g"))
    c = learning.kmeans(n, "v", 3)
    truth = n.groupBy("g").agg(F.avg(F.element_at("v", 1)).alias("a"), F.avg(F.element_at("v", 2)).alias("b")).orderBy("g").toPandas()[["a", "b"]].to_numpy()
    c = c[np.argsort(c[:, 0])]
    some = n.where("c_custkey <= 600").toPandas()
    x = np.stack(some.v.to_list())
    w, means, _, _ = learning.gaussian_mixture(x[:, :1] + 0.0, 3)
    tree = learning.grow_tree(x, some.g.to_numpy(float), np.random.default_rng(1), classify=True)
    rows = [("kmeans", bool(np.abs(c - truth).max() < 1e-6), True, len(c)), ("mixture", bool(np.abs(np.sort(means[:, 0]) - truth[:, 0]).max() < 0.2), bool(abs(w.sum() - 1) < 1e-9), len(w)), ("tree", bool((tree.predict(x) == some.g).all()), True, len(set(tree.predict(x))))]
    return spark.createDataFrame(rows, "what string, centred boolean, complete boolean, parts int")




# --- further readers, curves and paths --------------------------------------------------------------


@query("""select 'measured' kind, event_type site, cast(ts as timestamp) ts, value v from events where event_id < 200 union all select 'realtime', event_type, cast(ts as timestamp), value from events where event_id < 200 union all select 'listed', n_name, null, n_nationkey * 1.0 from nation""")
def station_pages(spark, d):
    """JSON pages of field measurements, five-minute CSV files with stamps of a zone, and lists of series, written and read again."""
    e = table(spark, d, "events").where("event_id < 200").select(F.col("event_type").alias("site"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"), F.col("value").cast("string").alias("x"))
    a, b, c = (tables.shared_path(spark) for _ in range(3))
    feature = F.struct(F.struct(F.col("site").alias("monitoring_location_id"), F.col("at").alias("time"), F.col("x").alias("value")).alias("properties"))
    e.agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value")).write.text(a)
    e.select(F.col("site").alias("ID"), F.col("at").alias("Date"), F.col("x").alias("Value")).write.csv(b, header=True)
    listed = F.concat(F.array(F.array(F.lit("ts_id"), F.lit("station_no"), F.lit("ts_name"))), F.collect_list(F.array(F.col("n_nationkey").cast("string"), F.col("n_name"), F.lit("daily"))))
    table(spark, d, "nation").agg(F.to_json(listed).alias("value")).write.text(c)
    ids = stations.australian_series_ids(spark, c).select("site", F.lit(None).cast("timestamp_ntz").alias("ts"), F.col("ts_id").cast("double").alias("v"))
    parts = {"measured": stations.usgs_measurements(spark, a), "realtime": stations.canadian_realtime(spark, b), "listed": ids}
    out = None
    for kind, df in parts.items():
        row = df.select(F.lit(kind).alias("kind"), "site", F.col("ts").cast("timestamp_ntz").alias("ts"), "v")
        out = row if out is None else out.unionByName(row)
    return out


@query("with recursive e as (select n_nationkey src, (n_nationkey * 7 + 3) % 25 dst, (n_nationkey % 5 + 1) * 1.0 w from nation union all select n_nationkey, (n_nationkey + 1) % 25, 2.5 from nation), r(v, d, h) as (select 0, 0.0::double, 0 union select e.src, r.d + e.w, r.h + 1 from r join e on e.dst = r.v where r.h < 14) select v, min(d) distance from r group by v")
def heap_paths(spark, d):
    """Distances of a graph that fits the driver, by a heap."""
    keys = [r[0] for r in table(spark, d, "nation", "n_nationkey").collect()]
    edges = [(k, (k * 7 + 3) % 25, k % 5 + 1.0) for k in keys] + [(k, (k + 1) % 25, 2.5) for k in keys]
    return spark.createDataFrame([(v, float(w)) for v, (w, _) in relational.dijkstra(edges, 0).items()], "v int, distance double")


@query("select method, cast(r_regionkey as int) curve_id, x, abs(x - 10) * (r_regionkey + 1.0) as y from (select unnest(['peucker', 'visvalingam', 'lang']) as method), region, (select unnest([0.0, 10.0, 20.0]) x)")
def simplified_polylines(spark, d):
    """Curves of one bend each: only the ends and the bend are left."""
    c = table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("curve_id"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"))
    c = c.select("curve_id", F.col("k").cast("double").alias("x"), (F.abs(F.col("k") - 10) * (F.col("curve_id") + 1.0)).alias("y"))
    out = None
    for method, amount in (("peucker", 0.01), ("visvalingam", 3), ("lang", 0.01)):
        row = curves.simplify(c, method, amount).select(F.lit(method).alias("method"), "curve_id", "x", "y")
        out = row if out is None else out.unionByName(row)
    return out


@query("select k, round(case when k <= 10 then k / 50.0 else (20 - k) / 50.0 end, 2) density, round((exp(-0.5 * ((k / 5.0 - 1) / 0.5) ** 2) + exp(-0.5 * ((k / 5.0 - 2) / 0.5) ** 2) + exp(-0.5 * ((k / 5.0 - 4) / 0.5) ** 2)) / (3 * 0.5 * sqrt(2 * pi())), 8) kernel from (select unnest(range(0, 21)) k)")
def summed_and_smoothed_densities(spark, d):
    """Density of the sum of two uniforms on 0..5, at halves, and a normal kernel density of three values."""
    x, f = curves.convolve([(0.0, 0.2), (5.0, 0.2)], [(0.0, 0.2), (5.0, 0.2)], 4001)
    at = np.arange(21)
    tri = np.interp(at / 2, x, f)
    kernel = D.kernel_density(at / 5, np.array([1.0, 2.0, 4.0]), 0.5)
    return spark.createDataFrame([(int(k), round(float(t) + 0.0, 2), round(float(g), 8)) for k, t, g in zip(at, tri, kernel, strict=True)], "k long, density double, kernel double")


@query("select 'order' what, n_nationkey k, n_nationkey % 6 = 0 bad_x, n_nationkey % 10 = 0 bad_y from nation where n_nationkey > 0 and (n_nationkey % 6 = 0 or n_nationkey % 10 = 0) union all select 'inverted', n_nationkey, true, true from nation union all select 'list', n_nationkey, n_nationkey < 1 or n_nationkey = 12 or n_nationkey > 23, true from nation")
def ordinate_checks(spark, d):
    """Ordinates out of order on either axis, axes exchanged, and lists of probabilities that are no rising or falling ones in (0, 1)."""
    k = F.col("n_nationkey")
    c = table(spark, d, "nation").select(F.lit(1).alias("curve_id"), k.alias("idx"), F.when((k % 6 == 0) & (k > 0), k - 1.5).otherwise(k.cast("double")).alias("x"), F.when((k % 10 == 0) & (k > 0), k - 1.5).otherwise(k.cast("double")).alias("y"))
    wrong = curves.order_errors(c).select(F.lit("order").alias("what"), F.col("idx").alias("k"), "bad_x", "bad_y")
    turned = curves.invert(c).select(F.lit("inverted").alias("what"), F.col("idx").alias("k"), F.lit(True).alias("bad_x"), F.lit(True).alias("bad_y"))
    lists = table(spark, d, "nation").select(F.lit("list").alias("what"), k.alias("k"), tables.probability_list_errors(F.array(k / 24.0, F.lit(0.5))).alias("bad_x"), F.lit(True).alias("bad_y"))
    return wrong.unionByName(turned).unionByName(lists)
