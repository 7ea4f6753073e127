"""Queries over the relational tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import curves, metric, probability, relational, series, stats
from .registry import ORACLES, QUERIES, query, table

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

FLAGSHIP = "l_moments_by_priority"


def orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("ts"))


def hourly(spark, d):
    """Hourly sums of events by type; sums over 12,000 count as missing."""
    e = table(spark, d, "events", "event_type", "ts", "value").withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    h = e.groupBy("event_type", "ts").agg(F.sum("value").alias("v"))
    return h.withColumn("v", F.when(F.col("v") <= 400, F.col("v")))


#: The same as ``hourly`` in SQL.
_H = "with h as (select event_type, date_trunc('hour', ts) ts, sum(value) s from events group by 1, 2), x as (select event_type, ts, case when s <= 400 then s end v from h) "


# --- moments, ranks, metrics -------------------------------------------------


@query("""select o_orderpriority, count(*) n, sum(o_totalprice) total, min(o_totalprice) minimum, max(o_totalprice) maximum, avg(o_totalprice) mean, exp(avg(ln(o_totalprice))) geometric, count(*) / sum(1 / o_totalprice) harmonic,
var_samp(o_totalprice) variance, var_pop(o_totalprice) pop_variance, stddev_samp(o_totalprice) sd, stddev_pop(o_totalprice) pop_sd, stddev_samp(o_totalprice) / avg(o_totalprice) cv, skewness(o_totalprice) skew, kurtosis(o_totalprice) kurt from orders group by 1""")
def moments_by_priority(spark, d):
    return stats.describe(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"])


@query("""with r as (select o_orderpriority g, o_totalprice x, row_number() over (partition by o_orderpriority order by o_totalprice) - 1.0 i, count(*) over (partition by o_orderpriority) * 1.0 n from orders),
b as (select g, count(*) n, avg(x) b0, avg(i / (n - 1) * x) b1, avg(i * (i - 1) / ((n - 1) * (n - 2)) * x) b2, avg(i * (i - 1) * (i - 2) / ((n - 1) * (n - 2) * (n - 3)) * x) b3 from r group by 1)
select g o_orderpriority, n, b0 l1, 2 * b1 - b0 l2, 2 * (3 * b2 - b0) / (2 * b1 - b0) - 3 t3, 5 * (2 * (2 * b3 - 3 * b2) + b0) / (2 * b1 - b0) + 6 t4 from b""")
def l_moments_by_priority(spark, d):
    return stats.l_moments(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"])


@query("""select l_returnflag, p, case p when 0.05 then quantile_cont(l_extendedprice, 0.05) when 0.25 then quantile_cont(l_extendedprice, 0.25) when 0.5 then quantile_cont(l_extendedprice, 0.5) when 0.75 then quantile_cont(l_extendedprice, 0.75) else quantile_cont(l_extendedprice, 0.95) end as value
from lineitem, (select unnest([0.05, 0.25, 0.5, 0.75, 0.95]::double[]) p) group by 1, 2""")
def percentiles_by_flag(spark, d):
    return stats.percentiles(table(spark, d, "lineitem"), "l_extendedprice", [0.05, 0.25, 0.5, 0.75, 0.95], ["l_returnflag"])


@query("""with r as (select l_returnflag g, l_quantity a, l_extendedprice b, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 ra, rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2.0 rb from lineitem)
select g l_returnflag, corr(a, b) pearson, corr(ra, rb) spearman, covar_samp(a, b) cov, covar_pop(a, b) pop_cov from r group by 1""")
def correlations_by_flag(spark, d):
    return stats.correlations(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])


@query("""with s as (select c_nationkey g, c_custkey i, c_acctbal a, length(c_mktsegment) * 1.0 b from customer),
p as (select x.g, sign(x.a - y.a) da, sign(x.b - y.b) db from s x join s y on x.g = y.g and x.i < y.i)
select g c_nationkey, case when sum(abs(da)) * sum(abs(db)) > 0 then sum(da * db) / sqrt(sum(abs(da)) * sum(abs(db))) end tau from p group by 1""")
def kendall_by_nation(spark, d):
    c = table(spark, d, "customer").withColumn("len", F.length("c_mktsegment").cast("double"))
    return stats.kendall(c, "c_acctbal", "len", ["c_nationkey"], "c_custkey")


@query("""with s as (select min(o_totalprice) lo, max(o_totalprice) hi, count(*) n from orders), k as (select lo, cast(ceil(2 * pow(n, 1.0 / 3)) as int) + 1 k, hi from s), w as (select lo, k, (hi - lo) / k w from k),
b as (select least(k - 1, cast(floor((o_totalprice - lo) / w) as int)) bin, lo, w from orders, w) select bin, lo + bin * w as lower, lo + (bin + 1) * w as upper, count(*) freq from b group by bin, lo, w""")
def histogram_rice(spark, d):
    return stats.histogram(table(spark, d, "orders"), "o_totalprice")


@query("""with p as (select l_shipdate, l_returnflag g, l_extendedprice o, l_quantity * 1500 m from lineitem), a as (select g, avg(o) mo from p group by 1)
select p.g l_returnflag, sqrt(sum((o - m) ** 2) / count(*)) rmse, sum((o - m) ** 2) / count(*) mse, avg(abs(o - m)) mae, 100 * avg(abs((o - m) / o)) mape, 100 * avg(abs(o - m) / ((abs(o) + abs(m)) / 2)) smape,
1 - sum((o - m) ** 2) / sum((o - mo) ** 2) nse, 1 - sqrt((corr(o, m) - 1) ** 2 + (stddev_samp(m) / stddev_samp(o) - 1) ** 2 + (avg(m) / avg(o) - 1) ** 2) kge,
1 - sqrt((corr(o, m) - 1) ** 2 + (stddev_samp(m) / avg(m) / (stddev_samp(o) / avg(o)) - 1) ** 2 + (avg(m) / avg(o) - 1) ** 2) kge_mod,
100 * sum(m - o) / sum(o) pbias, sqrt(sum((o - m) ** 2) / count(*)) / stddev_pop(o) rsr, corr(o, m) ** 2 r2, 1 - sum(abs(o - m)) / sum(o) ve, 1 - sum((o - m) ** 2) / sum((abs(m - mo) + abs(o - mo)) ** 2) d, 1 - sum(abs(o - m)) / sum(abs(m - mo) + abs(o - mo)) d1,
case when sum(abs(o - m)) <= 2 * sum(abs(o - mo)) then 1 - sum(abs(o - m)) / (2 * sum(abs(o - mo))) else 2 * sum(abs(o - mo)) / sum(abs(o - m)) - 1 end dr from p join a on a.g = p.g group by 1""")
def goodness_of_fit(spark, d):
    p = table(spark, d, "lineitem").withColumn("m", F.col("l_quantity") * 1500)
    return stats.errors(p, "l_extendedprice", "m", ["l_returnflag"])


@query("""with c as (select l.quality o, case when d.n_chars > 500 then 1 else 0 end m from documents d join labels l on l.doc_id = d.doc_id),
k as (select count(*) filter (where o = 1 and m = 1) tp, count(*) filter (where o = 0 and m = 0) tn, count(*) filter (where o = 0 and m = 1) fp, count(*) filter (where o = 1 and m = 0) fn from c),
r as (select 100.0 * (tp + tn) / (tp + tn + fp + fn) accuracy, tp / (tp + fp) prec, tp / (tp + fn) recall, tn / (tn + fp) specificity from k) select accuracy, prec, recall, 2 * prec * recall / (prec + recall) f1, specificity, (recall + specificity) / 2 balanced from r""")
def classification_scores(spark, d):
    both = table(spark, d, "documents", "doc_id", "n_chars").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id")
    return stats.classification(both.withColumn("m", (F.col("n_chars") > 500).cast("int")), "quality", "m")


@query("""with m as (select o_orderpriority g, count(*) n, 2 k, -count(*) / 2.0 * (ln(2 * pi() * var_pop(o_totalprice)) + 1) ll from orders group by 1), a as (select g, n, k, ll, 2 * k - 2 * ll aic, 2 * k - 2 * ll + 2.0 * k * (k + 1) / (n - k - 1) aicc, k * ln(n) - 2 * ll bic from m)
select g o_orderpriority, n, k, ll, aic, aicc, bic, exp(-0.5 * (aic - (select min(aic) from a))) / (select sum(exp(-0.5 * (aic - (select min(aic) from a)))) from a) weight from a""")
def information_criteria(spark, d):
    n = F.count("*")
    m = table(spark, d, "orders").groupBy("o_orderpriority").agg(n.alias("n"), F.lit(2).alias("k"), (-n / 2.0 * (F.ln(2 * F.pi() * F.var_pop("o_totalprice")) + 1)).alias("ll"))
    return stats.information(m, "n", "k", "ll")


@query("select c_custkey, (row_number() over (partition by c_mktsegment order by c_acctbal, c_custkey) - 0.4) / (count(*) over (partition by c_mktsegment) + 0.2) pp from customer")
def plotting_positions(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    return stats.plotting_positions(c, "c_acctbal", "c_custkey", ["c_mktsegment"], stats.POSITIONS["cunnane"]).select("c_custkey", "pp")


# --- tests -----------------------------------------------------------------


@query("""with p as (select o_totalprice x, o_orderpriority g, o_orderkey % 2 = 0 f from orders), j as (select g, count(x) filter (where f) n1, count(x) filter (where not f) n2, avg(x) filter (where f) m1, avg(x) filter (where not f) m2, var_samp(x) filter (where f) v1, var_samp(x) filter (where not f) v2 from p group by 1)
select g o_orderpriority, (m1 - 150000) / sqrt(v1 / n1) t_one, n1 - 1.0 df_one, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) t_equal, n1 + n2 - 2.0 df_equal, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) t_welch,
(v1 / n1 + v2 / n2) ** 2 / (v1 * v1 / (n1 * n1 * (n1 - 1)) + v2 * v2 / (n2 * n2 * (n2 - 1))) df_welch, v1 / v2 f from j""")
def t_and_f_statistics(spark, d):
    return stats.t_tests(table(spark, d, "orders"), "o_totalprice", F.col("o_orderkey") % 2 == 0, ["o_orderpriority"], 150000.0).drop("p_one", "p_equal", "p_welch", "p_f")


@query()
def t_and_f_p_values(spark, d):
    return stats.t_tests(table(spark, d, "orders"), "o_totalprice", F.col("o_orderkey") % 2 == 0, ["o_orderpriority"], 150000.0)


@query("""with m as (select o_orderpriority g, count(*) n, skewness(o_totalprice) s, kurtosis_pop(o_totalprice) k from orders group by 1), b as (select g, n / 6.0 * ((s * (n - 2) / sqrt(n * (n - 1.0))) ** 2 + k ** 2 / 4) jb from m) select g o_orderpriority, jb, exp(-jb / 2) p from b""")
def jarque_bera(spark, d):
    return stats.jarque_bera(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"])


@query("""with r as (select o_orderstatus g, o_orderkey % 3 = 0 f, rank() over (partition by o_orderstatus order by o_totalprice) + (count(*) over (partition by o_orderstatus, o_totalprice) - 1) / 2.0 r from orders), s as (select g, sum(r) filter (where f) r1, count(*) filter (where f) n1, count(*) filter (where not f) n2 from r group by 1)
select g o_orderstatus, n1, n2, r1 - n1 * (n1 + 1) / 2.0 u, (r1 - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0) z from s""")
def mann_whitney(spark, d):
    return stats.mann_whitney(table(spark, d, "orders"), "o_totalprice", F.col("o_orderkey") % 3 == 0, ["o_orderstatus"]).drop("p")


@query("""with x as (select c_nationkey g, c_custkey i, round(c_acctbal, -2) v from customer), s as (select a.g, sum(sign(b.v - a.v)) s from x a join x b on a.g = b.g and a.i < b.i group by 1), t as (select g, sum(t) n, sum(t * (t - 1) * (2 * t + 5)) c from (select g, v, count(*) t from x group by 1, 2) group by 1),
r as (select s.g, s, (n * (n - 1) * (2 * n + 5) - c) / 18.0 var_s from s join t on s.g = t.g) select g c_nationkey, s, var_s, case when var_s > 0 then (s - sign(s)) / sqrt(var_s) end z from r""")
def mann_kendall(spark, d):
    c = table(spark, d, "customer").withColumn("v", F.round("c_acctbal", -2))
    return stats.mann_kendall(c, "v", "c_custkey", ["c_nationkey"]).drop("p")


@query("""with m as (select o_orderpriority g, regr_slope(o_totalprice, epoch(o_orderdate) / 86400) slope, regr_intercept(o_totalprice, epoch(o_orderdate) / 86400) intercept, regr_r2(o_totalprice, epoch(o_orderdate) / 86400) r2, count(*) n, regr_sxx(o_totalprice, epoch(o_orderdate) / 86400) sxx, regr_syy(o_totalprice, epoch(o_orderdate) / 86400) syy from orders group by 1)
select g o_orderpriority, slope, intercept, r2, n, slope / sqrt((syy - slope * slope * sxx) / (n - 2) / sxx) t from m""")
def linear_trend(spark, d):
    o = orders(spark, d).withColumn("x", F.expr("unix_micros(cast(ts as timestamp)) / 86400000000"))
    return stats.linear_trend(o, "v", "x", ["o_orderpriority"]).drop("p")


@query("""with m as (select o_orderpriority g, count(*) * 1.0 n, avg(ln(o_totalprice)) m, stddev_samp(ln(o_totalprice)) s from orders group by 1), k as (select *, -3.62201 + 6.28446 * n ** 0.25 - 2.49835 * n ** 0.5 + 0.491436 * n ** 0.75 - 0.037911 * n k from m) select g o_orderpriority, n, exp(m - k * s) low, exp(m + k * s) high from k""")
def grubbs_beck_thresholds(spark, d):
    return stats.grubbs_beck(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"])


@query()
def ks_and_anderson_darling(spark, d):
    return stats.ks_normal(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"])


# --- series ---------------------------------------------------------------


@query("select o_orderpriority, date_trunc('month', o_orderdate)::timestamp as block, sum(o_totalprice) b, max(o_orderdate) as at from orders group by 1, 2")
def block_monthly_sum(spark, d):
    return series.block(orders(spark, d), "month", "sum", ["o_orderpriority"])


@query("select o_orderpriority, date_trunc('quarter', o_orderdate)::timestamp as block, max(o_totalprice) b, arg_max(o_orderdate, (o_totalprice, -epoch_us(o_orderdate))) as at from orders group by 1, 2")
def block_quarterly_maximum(spark, d):
    return series.block(orders(spark, d), "quarter", "max", ["o_orderpriority"])


@query("select o_orderpriority, date_trunc('year', o_orderdate)::timestamp as block, avg(o_totalprice) b, max(o_orderdate) as at from orders group by 1, 2")
def block_yearly_mean(spark, d):
    return series.block(orders(spark, d), "year", "avg", ["o_orderpriority"])


@query("select o_orderpriority, cast(year(o_orderdate) + case when month(o_orderdate) >= 10 then 1 else 0 end as int) water_year, max(o_totalprice) b, count(*) n from orders group by 1, 2")
def water_year_maximum(spark, d):
    return series.water_year(orders(spark, d), 10, "max", ["o_orderpriority"])


@query("select o_orderpriority, cast(year(o_orderdate) + case when month(o_orderdate) >= 11 then 1 else 0 end as int) water_year, min(o_totalprice) b, count(*) n from orders where month(o_orderdate) >= 11 or month(o_orderdate) <= 3 group by 1, 2")
def season_minimum(spark, d):
    return series.water_year(orders(spark, d), 11, "min", ["o_orderpriority"], season=(11, 3))


@query(_H + "select event_type, ts, v, case when count(v) over w = 6 then avg(v) over w end m from x window w as (partition by event_type order by ts rows 5 preceding) qualify row_number() over (partition by event_type order by ts) >= 6")
def moving_average(spark, d):
    return series.moving(hourly(spark, d), 6, "avg", ["event_type"])


@query(_H + "select event_type, ts, v, case when count(v) over w >= 3 then sum(v) over w end m from x window w as (partition by event_type order by ts rows 23 preceding) qualify row_number() over (partition by event_type order by ts) >= 24")
def moving_sum_partial(spark, d):
    return series.moving(hourly(spark, d), 24, "sum", ["event_type"], least=3)


@query(_H + "select event_type, ts, v, sum(coalesce(v, 0)) over (partition by event_type order by ts) total from x")
def cumulative_sum(spark, d):
    return series.cumulative(hourly(spark, d), ["event_type"])


@query(_H + "select event_type, ts, v, v - lag(v, 2) over (partition by event_type order by ts) d from x qualify row_number() over (partition by event_type order by ts) > 2")
def lagged_difference(spark, d):
    return series.difference(hourly(spark, d), 2, 1, ["event_type"])


@query("""with e as (select event_type, date_trunc('hour', ts) ts, sum(value) v from events group by 1, 2), b as (select event_type, min(ts) a, max(ts) z from e group by 1), g as (select event_type, unnest(generate_series(a, z, interval 1 hour)) ts from b)
select g.event_type, g.ts, coalesce(v, 0) v from g left join e on e.event_type = g.event_type and e.ts = g.ts""")
def fill_missing_dates(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return series.fill_dates(e.groupBy("event_type", "ts").agg(F.sum("value").alias("v")), "1hour", 0.0, ["event_type"])


@query(_H + """, r as (select *, row_number() over (partition by event_type order by ts) i, epoch(ts) s from x), p as (select *, last_value(case when v is not null then i end ignore nulls) over a pi, last_value(case when v is not null then s end ignore nulls) over a ps, last_value(v ignore nulls) over a pv,
first_value(case when v is not null then i end ignore nulls) over b ni, first_value(case when v is not null then s end ignore nulls) over b ns, first_value(v ignore nulls) over b nv from r window a as (partition by event_type order by ts rows between unbounded preceding and current row), b as (partition by event_type order by ts rows between current row and unbounded following)), k as (select event_type, i ki, s ks, v kv, lag(i) over z oi, lag(s) over z os, lag(v) over z ov from r where v is not null window z as (partition by event_type order by i)), c as (select event_type, count(*) n from r group by 1) select p.event_type, ts, v, case when v is not null then v when ni - pi - 1 <= 3 then pv + (nv - pv) * (s - ps) / (ns - ps) when ni is null and n - pi <= 4 and pi - oi - 1 <= 3 then pv + (pv - ov) * (s - ps) / (ps - os) end filled from p join c on c.event_type = p.event_type left join k on k.event_type = p.event_type and k.ki = p.pi""")
def interpolate_gaps(spark, d):
    return series.interpolate(hourly(spark, d), 3, ["event_type"])


@query(_H + "select event_type, ts0 ts, r from (select event_type, floor((i - 1) / 6) b, min(ts) ts0, avg(v) r from (select *, row_number() over (partition by event_type order by ts) i from x) group by 1, 2)")
def resample_means(spark, d):
    return series.resample(hourly(spark, d), 6, "avg", ["event_type"])


@query("select o_orderpriority, month(o_orderdate)::int as month, count(*) n, min(o_totalprice) min, quantile_cont(o_totalprice, 0.05) p05, quantile_cont(o_totalprice, 0.25) p25, quantile_cont(o_totalprice, 0.5) p50, quantile_cont(o_totalprice, 0.75) p75, quantile_cont(o_totalprice, 0.95) p95, max(o_totalprice) max, avg(o_totalprice) mean from orders group by 1, 2")
def monthly_summary(spark, d):
    return series.monthly_summary(orders(spark, d), ["o_orderpriority"])


@query("select o_orderkey, 100.0 * row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) / (count(*) over (partition by o_orderpriority) + 1) exceedance from orders")
def duration_curve(spark, d):
    return series.duration(orders(spark, d), ["o_orderpriority"], tie="o_orderkey").select("o_orderkey", "exceedance")


@query("""with recursive h as (select event_type, date_trunc('hour', ts) ts, sum(value) v from events group by 1, 2), r as (select *, row_number() over (partition by event_type order by ts) i from h), o as (select *, row_number() over (partition by event_type order by i) j from r where v > 250),
w(event_type, j, i, cluster, best, best_i) as (select event_type, j, i, 1, -1e300::double, i + 1 from o where j = 1 union all select event_type, j, i, cluster + k, case when k = 1 then -1e300 when v >= best then v else best end, case when k = 1 then i + 1 when v >= best then i else best_i end from (select o.event_type, o.j, o.i, o.v, w.cluster, w.best, w.best_i, case when o.i > w.i + 1 and o.i - 1 - w.best_i > 3 then 1 else 0 end k from w join o on o.event_type = w.event_type and o.j = w.j + 1)),
f as (select w.*, o.v, o.ts from w join o on o.event_type = w.event_type and o.j = w.j) select event_type, cast(cluster as bigint) as cluster, max(v) peak, arg_max(ts, (v, ts)) as at, count(*) n from f group by 1, 2""")
def peaks_over_threshold(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")).groupBy("event_type", "ts").agg(F.sum("value").alias("v"))
    return series.peaks_over(e, 250.0, 3, ["event_type"])


@query("""with h as (select event_type, date_trunc('hour', ts) ts, sum(value) v from events group by 1, 2), m as (select event_type, avg(v) m, count(*) n from h group by 1), e as (select h.event_type, ts, v - m d, n from h join m on m.event_type = h.event_type), l as (select *, row_number() over (partition by event_type order by ts) i from e),
s as (select a.event_type, a.i - b.i lag, sum(a.d * b.d) s, max(a.n) n from l a join l b on a.event_type = b.event_type and a.i - b.i between 0 and 5 group by 1, 2) select s.event_type, cast(s.lag as int) lag, s.s / s.n acvf, s.s / z.s acf from s join s z on z.event_type = s.event_type and z.lag = 0""")
def autocorrelation(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")).groupBy("event_type", "ts").agg(F.sum("value").alias("v"))
    return series.autocovariance(e, 5, ["event_type"])


@query("select event_type, count(*) n, count(*) filter (where value > 400) n_missing, bool_or(value > 400) has_missing, min(ts) as start, max(ts) as \"end\" from events group by 1")
def missing_values(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("value") <= 400, F.col("value")))
    return series.missing(e, ["event_type"])


@query("select event_id, (value - avg(value) over (partition by event_type)) / stddev_samp(value) over (partition by event_type) z, (value - min(value) over (partition by event_type)) / (max(value) over (partition by event_type) - min(value) over (partition by event_type)) u from events")
def standardize_and_normalize(spark, d):
    e = table(spark, d, "events", "event_id", "event_type", F.col("value").alias("v"))
    return series.normalize(series.standardize(e, ["event_type"]), ["event_type"], out="u").select("event_id", "z", "u")


@query("select o_orderkey, o_totalprice + 1 as a, o_totalprice * 2 as m, o_totalprice / 4 as q, o_totalprice ** 0.5 as p, log10(o_totalprice) as l, 1 / o_totalprice as i from orders where o_orderdate between timestamp '1996-01-01' and timestamp '1997-06-30'")
def series_arithmetic(spark, d):
    o = series.clip(orders(spark, d), "1996-01-01", "1997-06-30")
    for name, op, c in (("a", "add", 1.0), ("m", "multiply", 2.0), ("q", "divide", 4.0), ("p", "power", 0.5), ("l", "log", 10.0), ("i", "inverse", 0.0)):
        o = series.arithmetic(o.withColumn(name, F.col("v")), op, c, name)
    return o.select("o_orderkey", "a", "m", "q", "p", "l", "i")


@query("select o_orderkey, o_orderdate + interval 1 month as next_month, o_orderdate + interval 45 days as later, o_orderdate - interval 1 year as before from orders")
def shift_dates(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    for name, n, unit in (("next_month", 1, "month"), ("later", 45, "days"), ("before", -1, "year")):
        o = series.shift(o.withColumn(name, F.col("o_orderdate")), n, unit, name)
    return o.drop("o_orderdate")


# --- transforms, links, curves, probability ---------------------------------


@query("select o_orderkey, (o_totalprice ** 0.3 - 1) / 0.3 as bc, ((o_totalprice + 1) ** 0.3 - 1) / 0.3 as yj, ln(o_totalprice) lg, ln((least(o_totalprice / 1e6, 0.999)) / (1 - least(o_totalprice / 1e6, 0.999))) lt, ln(-ln(1 - least(o_totalprice / 1e6, 0.999))) cl, atanh(least(o_totalprice / 1e6, 0.999)) fz from orders")
def transforms_and_links(spark, d):
    o = table(spark, d, "orders")
    u = F.least(F.col("o_totalprice") / 1e6, F.lit(0.999))
    return o.select("o_orderkey", C.box_cox(F.col("o_totalprice"), 0.3).alias("bc"), C.yeo_johnson(F.col("o_totalprice"), 0.3).alias("yj"), C.LINKS["log"][0](F.col("o_totalprice")).alias("lg"), C.LINKS["logit"][0](u).alias("lt"), C.LINKS["cloglog"][0](u).alias("cl"), C.LINKS["fisher_z"][0](u).alias("fz"))


@query("""with c as (select o_orderpriority g, count(*) x, sum(o_totalprice) y from orders group by 1), k as (select row_number() over (order by p_size) - 1 i, p_size * 1.0 x, avg(p_retailprice) y from part group by p_size), b as (select x, y, lead(x) over (order by x) x2, lead(y) over (order by x) y2 from k)
select l_orderkey, l_linenumber, case when q <= (select min(x) from k) then (select arg_min(y, x) from k) when q >= (select max(x) from k) then (select arg_max(y, x) from k) else (select y + (y2 - y) * (q - x) / (x2 - x) from b where q >= x and q < x2) end as fitted from (select l_orderkey, l_linenumber, l_quantity * 1.1 q from lineitem)""")
def curve_lookup(spark, d):
    curve = table(spark, d, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("y")).select(F.col("p_size").cast("double").alias("x"), "y")
    q = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 1.1).alias("q"))
    return curves.lookup(q, "q", curve, out="fitted").select("l_orderkey", "l_linenumber", "fitted")


@query("""with k as (select p_size * 1.0 x, avg(p_retailprice) y from part group by 1), s as (select x, y, lag(x) over (order by x) px, lag(y) over (order by x) py from k) select sum(0.5 * (x - px) * (y + py)) area_y, sum(0.5 * (y - py) * (x + px)) area_x from s""")
def trapezoid_area(spark, d):
    curve = table(spark, d, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("y")).select(F.lit(1).alias("curve_id"), F.col("p_size").cast("double").alias("x"), "y")
    return curves.area(curve).drop("curve_id")


@query("""with e as (select c_nationkey g, (c_custkey % 7 + 1) / 100.0 p from customer) select g c_nationkey, 1 - exp(sum(ln(1 - p))) independent, max(p) positive, least(1, sum(p)) negative, exp(sum(ln(p))) joint, min(p) joint_positive, (1 - exp(sum(ln(1 - p)))) / sum(p) common_cause, case when sum(p) > 1 then 1 / sum(p) else 1 end exclusive from e group by 1""")
def event_unions(spark, d):
    e = table(spark, d, "customer").withColumn("p", (F.col("c_custkey") % 7 + 1) / 100.0)
    return probability.unions(e, "p", ["c_nationkey"])


@query("with recursive e as (select n_nationkey src, (n_nationkey * 7 + 3) % 25 dst, (n_nationkey % 5 + 1) * 1.0 w from nation union all select n_nationkey, (n_nationkey + 1) % 25, 2.5 from nation), r(v, d, h) as (select 0, 0.0::double, 0 union select e.src, r.d + e.w, h + 1 from r join e on e.dst = r.v where h < 12) select v::int v, min(d) distance from r group by 1")
def shortest_paths(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    e = n.select(F.col("k").alias("src"), F.expr("(k * 7 + 3) % 25").alias("dst"), F.expr("cast(k % 5 + 1 as double)").alias("w")).unionByName(n.select(F.col("k").alias("src"), F.expr("(k + 1) % 25").alias("dst"), F.lit(2.5).alias("w")))
    return relational.shortest_paths(e, 0)


@query("""with a as (select vec_id, embedding e from embeddings where vec_id % 20 = 0), p as (select a.vec_id q, b.vec_id n, list_distance(a.e, b.embedding) dist from a join embeddings b on a.vec_id <> b.vec_id) select q, n, row_number() over (partition by q order by dist, n) rank from p qualify row_number() over (partition by q order by dist, n) <= 5""")
def nearest_neighbours(spark, d):
    v = table(spark, d, "embeddings")
    return metric.MetricIndex.build(v, "vec_id", "embedding").search(v.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)[0].select("q", "n", "rank")


@query("select r_name, n_name, count(*) customers, sum(c_acctbal) balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def rollup_regions(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))


@query("select l_returnflag, l_linestatus, sum(l_quantity) sum_qty, sum(l_extendedprice) sum_base, sum(l_extendedprice * (1 - l_discount)) sum_disc, avg(l_quantity) avg_qty, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.expr("timestamp_ntz '1998-09-02'"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_base"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sum_disc"), F.avg("l_quantity").alias("avg_qty"), F.count("*").alias("n"))


@query("select o_orderstatus, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) <= 10")
def top_orders(spark, d):
    o = table(spark, d, "orders", "o_orderstatus", "o_orderkey", "o_totalprice")
    w = Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("i", F.row_number().over(w)).where("i <= 10").drop("i")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders) union select s_suppkey from supplier where s_acctbal < 0")
def set_operations(spark, d):
    c = table(spark, d, "customer", "c_custkey").join(table(spark, d, "orders", F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return c.union(table(spark, d, "supplier").where("s_acctbal < 0").select("s_suppkey")).distinct()


from . import frames, kernels, large, models  # noqa: E402,F401  (add their queries)
