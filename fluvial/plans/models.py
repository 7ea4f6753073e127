"""Queries that fit distributions, draw samples, or learn; SQL oracles where the fit is closed."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import distributions as D
from ..operators import curves, learning, likelihood, sampling, stats, trees
from ..sources import tables
from .kernels import _PHI
from .registry import query, table

_LM = """with r as (select o_orderpriority g, o_totalprice x, row_number() over (partition by o_orderpriority order by o_totalprice) - 1.0 i, count(*) over (partition by o_orderpriority) * 1.0 n from orders),
b as (select g, avg(x) b0, avg(i / (n - 1) * x) b1, avg(i * (i - 1) / ((n - 1) * (n - 2)) * x) b2 from r group by 1), l as (select g, b0 l1, 2 * b1 - b0 l2, 2 * (3 * b2 - b0) / (2 * b1 - b0) - 3 t3 from b) """


def _fits(spark, d):
    return stats.l_moments(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"])


@query(_LM + """select g o_orderpriority, l1 as normal_mu, l2 * sqrt(pi()) as normal_sigma, l1 - l2 / ln(2) * 0.5772156649015329 as gumbel_xi, l2 / ln(2) as gumbel_alpha, l1 - 2 * l2 as exp_xi, 2 * l2 as exp_alpha,
(1 - 3 * t3) / (1 + t3) as gpa_kappa, (1 + (1 - 3 * t3) / (1 + t3)) * (2 + (1 - 3 * t3) / (1 + t3)) * l2 as gpa_alpha, l1 - (2 + (1 - 3 * t3) / (1 + t3)) * l2 as gpa_xi, -t3 as glo_kappa, l2 * sin(-t3 * pi()) / (-t3 * pi()) as glo_alpha from l""")
def l_moment_fits(spark, d):
    m = _fits(spark, d)
    fit = {n: D.from_l_moments(n, F.col("l1"), F.col("l2"), F.col("t3")) for n in ("normal", "gumbel", "exponential", "generalized_pareto", "generalized_logistic")}
    m = m.select("o_orderpriority", *(v.alias(k) for k, v in fit.items()))
    at = lambda c, i: F.element_at(c, i)
    return m.select("o_orderpriority", at("normal", 1).alias("normal_mu"), at("normal", 2).alias("normal_sigma"), at("gumbel", 1).alias("gumbel_xi"), at("gumbel", 2).alias("gumbel_alpha"), at("exponential", 1).alias("exp_xi"), at("exponential", 2).alias("exp_alpha"), at("generalized_pareto", 3).alias("gpa_kappa"), at("generalized_pareto", 2).alias("gpa_alpha"), at("generalized_pareto", 1).alias("gpa_xi"), at("generalized_logistic", 3).alias("glo_kappa"), at("generalized_logistic", 2).alias("glo_alpha"))


@query(_LM + ", k as (select *, 2 / (3 + t3) - ln(2) / ln(3) c from l), s as (select *, 7.8590 * c + 2.9554 * c * c kappa from k) select g o_orderpriority, kappa, l2 * kappa / ((1 - 2 ** -kappa) * gamma(1 + kappa)) alpha, l1 - l2 / ((1 - 2 ** -kappa) * gamma(1 + kappa)) * (1 - gamma(1 + kappa)) xi from s")
def gev_fit(spark, d):
    m = _fits(spark, d).select("o_orderpriority", D.from_l_moments("gev", F.col("l1"), F.col("l2"), F.col("t3")).alias("p"))
    return m.select("o_orderpriority", F.element_at("p", 3).alias("kappa"), F.element_at("p", 2).alias("alpha"), F.element_at("p", 1).alias("xi"))


@query("with m as (select o_orderpriority g, avg(o_totalprice) m, stddev_samp(o_totalprice) s from orders group by 1) select g o_orderpriority, m - 0.5772156649015329 * sqrt(6) / pi() * s as gumbel_xi, sqrt(6) / pi() * s as gumbel_alpha, s * s / m as gamma_theta, m * m / (s * s) as gamma_kappa, s * sqrt(3) / pi() as logistic_alpha from m")
def moment_fits(spark, d):
    m = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"), F.skewness("o_totalprice").alias("k"))
    fit = {n: D.moment_parameters(n, *(F.col(c) for c in "nmsk")) for n in ("gumbel", "gamma", "logistic")}
    return m.select("o_orderpriority", F.element_at(fit["gumbel"], 1).alias("gumbel_xi"), F.element_at(fit["gumbel"], 2).alias("gumbel_alpha"), F.element_at(fit["gamma"], 1).alias("gamma_theta"), F.element_at(fit["gamma"], 2).alias("gamma_kappa"), F.element_at(fit["logistic"], 2).alias("logistic_alpha"))


@query(_LM + """, f as (select g, l1 - l2 / ln(2) * 0.5772156649015329 a, l2 / ln(2) b from l) select o_orderkey, exp(-(o_totalprice - a) / b - exp(-(o_totalprice - a) / b)) / b as density, exp(-exp(-(o_totalprice - a) / b)) as probability, a - b * ln(-ln(0.99)) as q99 from orders join f on o_orderpriority = g""")
def gumbel_by_row(spark, d):
    m = _fits(spark, d).select("o_orderpriority", D.from_l_moments("gumbel", F.col("l1"), F.col("l2"), F.col("t3")).alias("p"))
    j = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_totalprice").join(m, "o_orderpriority")
    x, n = F.col("o_totalprice"), "gumbel"
    return j.select("o_orderkey", D.apply("pdf", x, n, F.col("p")).alias("density"), D.apply("cdf", x, n, F.col("p")).alias("probability"), D.apply("quantile", F.lit(0.99), n, F.col("p")).alias("q99"))


@query(f"with x as (select l_orderkey, l_linenumber, (l_discount - 0.05) * 40 / sqrt(2) z from lineitem) select l_orderkey, l_linenumber, round(0.5 + ({_PHI}) / 2, 8) p, 0.0 as error from x")
def normal_quantiles_round_trip(spark, d):
    z = (F.col("l_discount") - 0.05) * 40
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.normal_cdf(z), 8).alias("p"), (F.round(C.normal_quantile(C.normal_cdf(z)) - z, 9) + 0.0).alias("error"))


@query()
def maximum_likelihood_fits(spark, d):
    o = table(spark, d, "customer", "c_mktsegment", (F.col("c_acctbal") + 2000).alias("v"))
    return likelihood.fit(o, "v", ["c_mktsegment"], "gumbel").drop("converged")


@query("select c_mktsegment, round(avg(c_acctbal), 0) mu, round(stddev_pop(c_acctbal), 0) sigma, count(*) n from customer group by 1")
def normal_likelihood_fits(spark, d):
    fits = likelihood.fit(table(spark, d, "customer", "c_mktsegment", F.col("c_acctbal").alias("v")), "v", ["c_mktsegment"], "normal")
    return fits.select("c_mktsegment", F.round(F.element_at("params", 1), 0).alias("mu"), F.round(F.element_at("params", 2), 0).alias("sigma"), "n")


@query("""with s as (select count(*) n, sum(l_quantity) x, sum(l_discount) z, sum(l_quantity * l_quantity) xx, sum(l_quantity * l_discount) xz, sum(l_discount * l_discount) zz, sum(l_extendedprice) y, sum(l_quantity * l_extendedprice) xy, sum(l_discount * l_extendedprice) zy from lineitem),
c as (select n, xx - x * x / n a, xz - x * z / n b, zz - z * z / n c, xy - x * y / n p, zy - z * y / n q, x, y, z from s), f as (select n, x, y, z, (p * c - q * b) / (a * c - b * b) b1, (a * q - b * p) / (a * c - b * b) b2 from c)
select '(intercept)' term, y / n - b1 * x / n - b2 * z / n as coefficient from f union all select 'l_quantity', b1 from f union all select 'l_discount', b2 from f""")
def linear_regression(spark, d):
    m = learning.linear(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return spark.createDataFrame([(n, float(c)) for n, c in zip(m.names, m.coefficients, strict=True)], "term string, coefficient double")


@query()
def logistic_regression(spark, d):
    both = table(spark, d, "documents", "doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id").select((F.log1p("n_chars")).alias("size"), "toxic", "quality")
    m = learning.glm(both, "quality", ["size", "toxic"])
    return spark.createDataFrame([(n, float(c), float(e), float(p)) for n, c, e, p in zip(m.names, m.coefficients, m.errors, m.p, strict=True)], "term string, coefficient double, error double, p double")


@query("""with c as (select o_orderstatus c, ln(count(*) * 1.0 / (select count(*) from orders)) lp, avg(o_totalprice) m, stddev_samp(o_totalprice) s from orders group by 1), p as (select o_orderkey, c, lp - 0.5 * ((o_totalprice - m) / s) ** 2 - ln(s) score from orders, c) select o_orderkey, arg_max(c, (score, c)) predicted from p group by 1""")
def naive_bayes_classes(spark, d):
    o = table(spark, d, "orders")
    return learning.naive_bayes_predict(o, learning.naive_bayes(o, "o_orderstatus", ["o_totalprice"]), ["o_totalprice"]).select("o_orderkey", "predicted")


@query()
def kmeans_centres(spark, d):
    c = learning.kmeans(table(spark, d, "embeddings"), "embedding", 8)
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(c)], "cluster int, centre array<double>")


@query()
def natural_breaks_of_sizes(spark, d):
    found = table(spark, d, "part").where("p_size is not null").groupBy("p_size").count().collect()
    ends, fit = learning.natural_breaks([r[0] for r in found], 5, [r[1] for r in found])
    return spark.createDataFrame([(float(e), fit) for e in ends], "upper double, fit double")


@query()
def random_forest_intervals(spark, d):
    """Intervals of every part's price by its size, from a forest fitted on all parts."""
    part = table(spark, d, "part", "p_partkey", "p_size", "p_retailprice")
    forest = trees.grow(part, "p_retailprice", ["p_size"], ["p_partkey"], depth=6, trees=200, bag=1)
    return trees.forest_intervals(part.withColumn("size", F.col("p_size")), forest, ["p_partkey", "size"]).withColumnRenamed("size", "p_size")


@query()
def parametric_bootstrap(spark, d):
    p = [0.5, 0.9, 0.99]
    reps = sampling.bootstrap(spark, "gumbel", [100.0, 20.0], 80, 1000, p)
    return sampling.percentile_intervals(reps, p)


@query()
def random_sample(spark, d):
    return sampling.random_values(spark, 20_000, "gev", [100.0, 20.0, 0.1]).agg(F.count("*").alias("n"), F.round(F.avg("x"), 0).alias("mean"))


@query()
def posterior_of_normal(spark, d):
    x = F.col("c_acctbal").cast("double")
    r = table(spark, d, "customer").agg(F.count(x), F.avg(x), F.var_pop(x)).first()
    n, m, v = (float(y) for y in r)  # of all rows: the likelihood needs no more

    def loglik(p):
        return -n * p[1] - 0.5 * n * (v + (m - p[0]) ** 2) / math.exp(2 * p[1]) if abs(p[1]) < 30 else -math.inf

    return sampling.posterior(sampling.chains(spark, loglik, ["mu", "log_sigma"], [4500.0, 8.0], draws=500, warm=500))


@query()
def curve_simplification(spark, d):
    e = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.sum("value").alias("y"))
    curve = e.select(F.col("event_type").alias("curve_id"), F.unix_seconds(F.col("h").cast("timestamp")).cast("double").alias("x"), "y")
    return curves.simplify(curve, "peucker", 50.0).groupBy("curve_id").agg(F.count("*").alias("kept"))


@query("select n_nationkey, '0.' || (n_nationkey + 1) || '|0.5' as list, cast('0.' || (n_nationkey + 1) as double) + 0.5 as total from nation")
def probability_lists(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("0."), (F.col("n_nationkey") + 1).cast("string"), F.lit("|0.5")).alias("list"))
    parsed = tables.parse_list(F.col("list"))
    return n.select("n_nationkey", "list", F.aggregate(parsed, F.lit(0.0), lambda a, x: a + x).alias("total"))
