"""Queries of operators that work over one long table without a key, or over a key that many rows share; each against SQL where SQL has it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import breaks, density, likelihood, metric, resampling, series, stats, tall, trees
from .registry import query, table

# --- windows over all rows ----------------------------------------------------------

#: The order of all line items; it tells them apart.
LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_W = "window w as (order by " + ", ".join(LINES)


def lines(spark, d):
    return table(spark, d, "lineitem", *LINES, F.col("l_quantity").alias("v"))


def hours(spark, d):
    """Sums of all events by hour; those over a limit are missing."""
    e = table(spark, d, "events").withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return e.groupBy("ts").agg(F.sum("value").alias("s")).select("ts", F.when(F.col("s") <= 1600, F.col("s")).alias("v"))


@query(f"select {', '.join(LINES)}, l_quantity v, case when count(l_quantity) over w = 7 then avg(l_quantity) over w end m from lineitem {_W} rows 6 preceding) qualify row_number() over (order by {', '.join(LINES)}) >= 7")
def moving_average_of_all_lines(spark, d):
    return series.moving(lines(spark, d), 7, ts=LINES)


@query(f"select {', '.join(LINES)}, l_quantity v, max(l_quantity) over w m from lineitem {_W} rows 499 preceding) qualify row_number() over (order by {', '.join(LINES)}) >= 500")
def moving_maximum_of_all_lines(spark, d):
    return series.moving(lines(spark, d), 500, "max", ts=LINES)


@query(f"select {', '.join(LINES)}, l_quantity v, sum(l_quantity) over w total from lineitem {_W} rows unbounded preceding)")
def cumulative_sum_of_all_lines(spark, d):
    return series.cumulative(lines(spark, d), ts=LINES)


@query(f"select {', '.join(LINES)}, l_quantity v, l_quantity - 2 * lag(l_quantity, 3) over w + lag(l_quantity, 6) over w d from lineitem {_W}) qualify row_number() over w > 6")
def second_difference_of_all_lines(spark, d):
    return series.difference(lines(spark, d), 3, 2, ts=LINES)


@query(f"""with e as (select l_quantity - avg(l_quantity) over () d, count(*) over () n, row_number() over (order by {', '.join(LINES)}) i from lineitem), s as (select cast(l.k as int) lag, sum(a.d * b.d) s, max(a.n) n from e a, range(5) l(k), e b where b.i = a.i - l.k group by 1)
select s.lag, s.s / s.n acvf, s.s / z.s acf from s join s z on z.lag = 0""")
def autocorrelation_of_all_lines(spark, d):
    return series.autocovariance(lines(spark, d), 4, ts=LINES)


_ALL_HOURS = "with x as (select ts, case when s <= 1600 then s end v from (select date_trunc('hour', ts) ts, sum(value) s from events group by 1)) "


@query(_ALL_HOURS + """, r as (select *, row_number() over (order by ts) i, epoch(ts) s, count(*) over () n from x), k as (select i ki, s ks, v kv, lag(i) over (order by i) oi, lag(s) over (order by i) os, lag(v) over (order by i) ov, lead(i) over (order by i) ni, lead(s) over (order by i) ns, lead(v) over (order by i) nv from r where v is not null)
select ts, v, case when v is not null then v when ni - ki - 1 <= 2 then kv + (nv - kv) * (s - ks) / (ns - ks) when ni is null and n - ki <= 3 and ki - oi - 1 <= 2 then kv + (kv - ov) * (s - ks) / (ks - os) end filled from r asof left join k on r.i >= k.ki""")
def interpolate_all_hours(spark, d):
    return series.interpolate(hours(spark, d), 2)


@query(_ALL_HOURS + "select ts0 ts, r from (select floor((i - 1) / 24) b, min(ts) ts0, sum(v) r from (select *, row_number() over (order by ts) i from x) group by 1)")
def resample_all_hours(spark, d):
    return series.resample(hours(spark, d), 24, "sum")


# --- trees --------------------------------------------------------------------------

#: Features of a line's price, and the depth of its tree.
FEATURES, DEPTH = ["l_quantity", "l_discount", "l_tax"], 3


def _tree_sql() -> str:
    """The tree grown a level at a time: of each node the threshold that leaves least squares."""
    steps = [f"r0 as (select row_number() over () id, 0 node, l_extendedprice y, [{', '.join(FEATURES)}] x from lineitem)"]
    for k in range(DEPTH):
        steps += [
            f"g{k} as (select node, f, x[f] v, count(*) n, sum(y) s from r{k}, range(1, {len(FEATURES) + 1}) t(f) group by all)",
            f"c{k} as (select node, f, v, sum(n) over w n, sum(s) over w s, sum(n) over p tn, sum(s) over p ts, lead(v) over w nv from g{k} window w as (partition by node, f order by v), p as (partition by node, f))",
            f"b{k} as (select node, arg_max((f, (v + nv) / 2), s * s / n + (ts - s) * (ts - s) / (tn - n)) b from c{k} where nv is not null group by node)",
            f"r{k + 1} as materialized (select id, case when b.b is null then r.node when x[b.b[1]] <= b.b[2] then 2 * r.node + 1 else 2 * r.node + 2 end node, y, x from r{k} r left join b{k} b on b.node = r.node)",
        ]
    return "with " + ",\n".join(steps) + f"\nselect count(*) n, round(avg(y), 2) predicted from r{DEPTH} group by node"


@query(_tree_sql())
def regression_tree_of_lines(spark, d):
    """A tree of three levels on all line items: rows of each leaf, and what it predicts."""
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", *FEATURES)
    tree = trees.grow(rows, "l_extendedprice", FEATURES, ["l_orderkey", "l_linenumber"], depth=DEPTH)
    return rows.groupBy(F.round(tree.expression(), 2).alias("predicted")).agg(F.count("*").alias("n"))


# --- likelihood ---------------------------------------------------------------------


def _gumbel_sql(source: str, key: str, rounds: int = 12) -> str:
    """Newton steps for the scale b of mean - b - sum(x w) / sum(w) = 0 with w = exp(-x / b)."""
    steps = [f"x as (select {key} k, x from {source})", "m as (select k, count(*) n, avg(x) m, stddev_pop(x) * 0.78 b from x group by k)", "b0 as (select k, n, m, b from m)"]
    for r in range(rounds):
        steps.append(f"s{r} as (select k, any_value(n) n, any_value(m) m, any_value(b) b, sum(exp((m - x) / b)) s, sum(x * exp((m - x) / b)) sx, sum(x * x * exp((m - x) / b)) sxx from x join b{r} using (k) group by k)")
        steps.append(f"b{r + 1} as materialized (select k, n, m, b - (b - m + sx / s) / (1 + (sxx / s - (sx / s) ** 2) / (b * b)) b from s{r})")
    return "with " + ",\n".join(steps) + f"\nselect k {key}, round(m - ln(s / n) * b, 1) xi, round(b, 1) alpha, n, true as converged from (select k, any_value(n) n, any_value(m) m, any_value(b) b, sum(exp((m - x) / b)) s from x join b{rounds} using (k) group by k)"


def _weibull_sql(source: str, rounds: int = 12) -> str:
    """Newton steps for the shape c of sum(x^c ln x) / sum(x^c) - 1 / c = mean(ln x)."""
    steps = [f"x as (select x, ln(x) l from {source})", "c0 as (select 1.2 c, avg(l) m from x)"]
    for r in range(rounds):
        steps.append(f"c{r + 1} as materialized (select c - (b / a - 1 / c - m) / (d / a - (b / a) ** 2 + 1 / (c * c)) c, m from (select any_value(c) c, any_value(m) m, sum(exp(c * (l - m))) a, sum(l * exp(c * (l - m))) b, sum(l * l * exp(c * (l - m))) d from x, c{r}))")
    return "with " + ",\n".join(steps) + f"\nselect round(exp(m) * avg(exp(c * (l - m))) ** (1 / c), 0) as scale, round(c, 4) as shape, count(*) n, true as converged from x, c{rounds} group by c, m"


@query(_gumbel_sql("(select c_mktsegment, c_acctbal + 2000 x from customer)", "c_mktsegment"))
def gumbel_likelihood_by_segment(spark, d):
    fits = likelihood.fit(table(spark, d, "customer", "c_mktsegment", (F.col("c_acctbal") + 2000).alias("v")), "v", ["c_mktsegment"], "gumbel")
    return fits.select("c_mktsegment", F.round(F.col("params")[0], 1).alias("xi"), F.round(F.col("params")[1], 1).alias("alpha"), "n", "converged")


@query(_weibull_sql("(select o_totalprice x from orders where o_totalprice > 0)"))
def weibull_likelihood_of_all_orders(spark, d):
    fits = likelihood.fit(table(spark, d, "orders", "o_totalprice").where("o_totalprice > 0"), "o_totalprice", [], "weibull")
    return fits.select(F.round(F.col("params")[0], 0).alias("scale"), F.round(F.col("params")[1], 4).alias("shape"), "n", "converged")


@query("select l_returnflag, round(min(l_extendedprice), 2) as start, round(avg(l_extendedprice) - min(l_extendedprice), 2) as scale, round(-count(*) * (ln(avg(l_extendedprice) - min(l_extendedprice)) + 1), 0) loglik, count(*) n from lineitem group by 1")
def exponential_likelihood_by_flag(spark, d):
    fits = likelihood.fit(table(spark, d, "lineitem", "l_returnflag", "l_extendedprice"), "l_extendedprice", ["l_returnflag"], "exponential")
    return fits.select("l_returnflag", F.round(F.col("params")[0], 2).alias("start"), F.round(F.col("params")[1], 2).alias("scale"), F.round("loglik", 0).alias("loglik"), "n")


# --- counts over pairs ----------------------------------------------------------------


@query("""with p as (select sign(a.o_totalprice - b.o_totalprice) x, sign(a.o_custkey - b.o_custkey) y from orders a join orders b on a.o_orderkey < b.o_orderkey)
select round(sum(x * y) / sqrt(sum(abs(x)) * sum(abs(y))), 9) tau from p""")
def kendall_of_all_orders(spark, d):
    return stats.kendall(table(spark, d, "orders", "o_totalprice", "o_custkey"), "o_totalprice", "o_custkey").select(F.round("tau", 9).alias("tau"))


@query("""with x as (select o_orderkey i, floor(o_totalprice / 1000) v from orders), s as (select sum(sign(b.v - a.v)) s from x a join x b on a.i < b.i), t as (select sum(t) n, sum(t * (t - 1) * (2 * t + 5)) c from (select v, count(*) t from x group by 1))
select s, (n * (n - 1) * (2 * n + 5) - c) / 18.0 var_s, (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - c) / 18.0) z from s, t""")
def mann_kendall_of_all_orders(spark, d):
    o = table(spark, d, "orders", "o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("v"))
    return stats.mann_kendall(o, "v", "o_orderkey").drop("p")


# --- neighbours -----------------------------------------------------------------------


@query("""with p as (select a.vec_id q, b.label y, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (cast(z[1] as double) - z[2]) ** 2))) d, b.vec_id n from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
k as (select * from p qualify row_number() over (partition by q order by d, n) <= 7) select q, round(sum(y / (d * d)) / sum(1 / (d * d)), 6) predicted from k group by q""")
def labels_by_neighbours(spark, d):
    v = table(spark, d, "embeddings")
    near, _ = metric.MetricIndex.build(v, "vec_id", "embedding").search(v.where("vec_id % 20 = 0"), "vec_id", "embedding", 7)
    return metric.predicted(near, v, "vec_id", "label").select("q", F.round("predicted", 6).alias("predicted"))


# --- bootstrap of rows ----------------------------------------------------------------


def _weights_sql(source: str, row: str, replicates: int, seed: int = 1) -> str:
    """Rows with the Poisson weights of all replicates: the hash of row and replicate in 128-bit arithmetic modulo 2^64."""
    product = lambda a, b: f"cast((cast({a} as uhugeint) * cast({b} as uhugeint)) % 18446744073709551616::uhugeint as ubigint)"
    h = f"xor(xor(cast({row} as ubigint), {product('r + 1', resampling.REPLICATE)}), {product(seed, resampling.SEED)})"
    steps = [f"h0 as materialized (select s.*, cast(r as bigint) replicate, {h} h from {source} s, range({replicates}) t(r))"]
    for k, (shift, factor) in enumerate(zip(resampling.SHIFTS, resampling.FINALISER, strict=False)):
        steps.append(f"h{k + 1} as materialized (select * replace ({product(f'xor(h, h >> {shift})', factor)} as h) from h{k})")
    u = f"(xor(h, h >> {resampling.SHIFTS[-1]}) >> 11)::double / 9007199254740992"
    steps.append("w as materialized (select * exclude (h), " + " + ".join(f"cast(u >= {float(c)!r}::double as int)" for c in resampling.POISSON) + f" w from (select *, {u} u from h2))")
    return "with " + ",\n".join(steps)


_ORDERS = "(select o_orderkey, o_custkey, o_totalprice x from orders)"


@query(_weights_sql(_ORDERS, "o_orderkey", 24) + """
select replicate, cast(sum(w) as double) n, round(sum(w * x) / sum(w), 4) mean, round(sqrt(sum(w * (x - m) ** 2) / sum(w)), 4) sd from (select *, sum(w * x) over (partition by replicate) / sum(w) over (partition by replicate) m from w) group by replicate""")
def bootstrap_of_order_prices(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    return resampling.moments(o, "o_orderkey", "o_totalprice", 24).select("replicate", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


@query(_weights_sql("(select l_orderkey * 8 + l_linenumber k, l_returnflag, l_quantity x, l_extendedprice y from lineitem)", "k", 8) + """
select l_returnflag, replicate, round((sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) ** 2), 4) slope from w group by 1, 2""")
def bootstrap_of_price_slopes(spark, d):
    rows = table(spark, d, "lineitem", "l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), "l_quantity", "l_extendedprice")
    return resampling.regression(rows, "k", "l_extendedprice", "l_quantity", 8, keys=["l_returnflag"]).select("l_returnflag", "replicate", F.round("slope", 4).alias("slope"))


@query(_weights_sql(_ORDERS, "o_orderkey", 12) + """,
c as (select *, sum(w) over (partition by replicate order by x, o_orderkey) z, sum(w) over (partition by replicate) n from w where w > 0)
select replicate, cast(any_value(n) as double) n, round(sum(w * x) / any_value(n), 3) l1, round(2 * sum(x * (z * (z - 1) - (z - w) * (z - w - 1)) / 2e0 / (cast(n as double) * (n - 1e0))) - sum(w * x) / any_value(n), 3) l2 from c group by replicate""")
def bootstrap_of_l_moments(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    return resampling.l_moments(o, "o_orderkey", "o_totalprice", 12).select("replicate", "n", F.round("l1", 3).alias("l1"), F.round("l2", 3).alias("l2"))


@query("select count(*) n, round(avg(o_totalprice), 0) mean, true as limits_hold from orders")
def bootstrap_limits_of_the_mean(spark, d):
    """Limits of the mean of all orders; they hold if they are within a quarter of the normal ones' width of them."""
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    got = resampling.limits(resampling.moments(o, "o_orderkey", "o_totalprice", 400), "mean")
    x = F.col("o_totalprice")
    normal = o.agg(F.count("*").alias("n"), F.avg(x).alias("m"), (1.6448536 * F.stddev_samp(x) / F.sqrt(F.count("*"))).alias("h"))
    near = lambda a, b: F.abs(F.col(a) - b) < 0.25 * F.col("h")
    return normal.join(F.broadcast(got), F.lit(True)).select("n", F.round("m", 0).alias("mean"), (near("lower", F.col("m") - F.col("h")) & near("upper", F.col("m") + F.col("h"))).alias("limits_hold"))


# --- tall matrices, mixtures, densities -------------------------------------------------


@query("""with v as (select embedding[1:4] x from embeddings), g as (select i, j, sum(cast(x[i] as double) * x[j]) g from v, range(1, 5) a(i), range(1, 5) b(j) group by i, j)
select i - 1 i, j - 1 j, round(g, 6) gram from g""")
def tall_qr_of_embeddings(spark, d):
    """R of the first components, folded over partitions: R'R is the matrix of their products."""
    r = tall.tall_r(table(spark, d, "embeddings", F.slice("embedding", 1, 4).alias("v")), "v")
    g = r.T @ r
    return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(4) for j in range(4)], "i long, j long, gram double").select("i", "j", F.round("gram", 6).alias("gram"))


@query("""with g as (select i, j, sum(cast(embedding[i] as double) * embedding[j]) g from embeddings, range(1, 65) a(i), range(1, 65) b(j) group by i, j) select count(*) // 64 n, round(sum(case when i = j then g end), 4) squares, round(sum(g * g), 2) fourth_powers from g""")
def singular_values_of_embeddings(spark, d):
    """Of all components: the sums of their squares and fourth powers are traces."""
    s, _ = tall.singular_values(table(spark, d, "embeddings", "embedding"), "embedding")
    return spark.createDataFrame([(len(s), float((s**2).sum()), float((s**4).sum()))], "n long, squares double, fourth_powers double").select("n", F.round("squares", 4).alias("squares"), F.round("fourth_powers", 2).alias("fourth_powers"))


#: Rounds and start of the mixture of prices, in thousands.
_ROUNDS, _START = 12, ((100.0, 400.0), (10_000.0, 10_000.0))


def _mixture_sql() -> str:
    """Fixed rounds of expectation and maximisation for two normal components."""
    (m1, m2), (v1, v2) = _START
    steps = ["x as materialized (select o_totalprice / 1000 x from orders)", f"p0 as (select 0.5::double w1, 0.5::double w2, {m1}::double m1, {m2}::double m2, {v1}::double v1, {v2}::double v2)"]
    for k in range(_ROUNDS):
        density = "w{0} * exp(-((x - m{0}) ** 2) / (2 * v{0})) / sqrt(2 * pi() * v{0})"
        steps.append(f"r{k} as materialized (select x, a / (a + b) r, ln(a + b) l from (select x, {density.format(1)} a, {density.format(2)} b from x, p{k}))")
        steps.append(f"m{k} as (select sum(r) / count(*) w1, sum(1 - r) / count(*) w2, sum(r * x) / sum(r) m1, sum((1 - r) * x) / sum(1 - r) m2, sum(l) total from r{k})")
        steps.append(f"p{k + 1} as materialized (select w1, w2, m1, m2, sum(r * (x - m1) ** 2) / sum(r) + 1e-6 v1, sum((1 - r) * (x - m2) ** 2) / sum(1 - r) + 1e-6 v2, total from r{k}, m{k} group by w1, w2, m1, m2, total)")
    last = f"p{_ROUNDS}"
    return "with " + ",\n".join(steps) + f"\nselect 0 component, round(w1, 6) weight, round(m1, 4) mean, round(sqrt(v1), 4) sd, round(total, 2) loglik from {last} union all select 1, round(w2, 6), round(m2, 4), round(sqrt(v2), 4), round(total, 2) from {last}"


@query(_mixture_sql())
def mixture_of_order_prices(spark, d):
    """Two components fitted to all prices in a fixed number of rounds."""
    means, variances = _START
    m = tall.fit_mixture(table(spark, d, "orders", F.array(F.col("o_totalprice") / 1000).alias("v")), "v", [[x] for x in means], covariances=variances, rounds=_ROUNDS, tol=0)
    rows = [(j, float(m.weights[j]), float(m.means[j, 0]), float(m.covariances[j, 0, 0] ** 0.5), m.loglik[-1]) for j in range(2)]
    return spark.createDataFrame(rows, "component int, weight double, mean double, sd double, loglik double").select("component", *(F.round(c, n).alias(c) for c, n in (("weight", 6), ("mean", 4), ("sd", 4), ("loglik", 2))))


@query("""with k as (select o_orderpriority, count(*) n, min(o_totalprice) - 60000 a, max(o_totalprice) + 60000 b from orders group by 1), g as (select o_orderpriority, n, a + t * (b - a) / 255 x from k, range(256) r(t)),
e as (select g.o_orderpriority, x, sum(exp(-(((x - o_totalprice) / 20000) ** 2) / 2)) / any_value(n) / 20000 / sqrt(2 * pi()) d from g join orders o on g.o_orderpriority = o.o_orderpriority group by 1, 2)
select o_orderpriority, count(*) points, true as near_exact, round(sum(d) * (max(x) - min(x)) / 255, 3) total, true as within_bound from e group by 1""")
def price_densities(spark, d):
    """Densities of each priority's prices on a grid; beside exact sums of all kernels at every sixteenth grid point, which they are within the stated bound of."""
    o = table(spark, d, "orders", "o_orderpriority", "o_totalprice")
    h, points = 20_000.0, 256
    got = density.kernel_density(o, "o_totalprice", points, ["o_orderpriority"], h=h)
    summed = got.groupBy("o_orderpriority").agg(F.count("*").alias("points"), F.round(F.sum("density") * (F.max("x") - F.min("x")) / (points - 1), 3).alias("total"), F.min("x").alias("a"), ((F.max("x") - F.min("x")) / (points - 1)).alias("s"))
    u = (F.col("x") - F.col("o_totalprice")) / h
    at = summed.select("o_orderpriority", "a", "s").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(points - 1), F.lit(16)))).select("o_orderpriority", F.col("t"), (F.col("a") + F.col("t") * F.col("s")).alias("x"), "s")
    exact = o.join(F.broadcast(at), "o_orderpriority").groupBy("o_orderpriority", "t", "s").agg((F.sum(F.exp(-u * u / 2)) / F.count("*") / h / (2 * math.pi) ** 0.5).alias("exact"))
    both = exact.join(got.join(F.broadcast(summed.select("o_orderpriority", "a", "s")), "o_orderpriority").select("o_orderpriority", F.round((F.col("x") - F.col("a")) / F.col("s")).cast("int").alias("t"), "density"), ["o_orderpriority", "t"])
    bound = F.col("s") * F.col("s") * 0.4 / (8 * h**3)
    checked = both.groupBy("o_orderpriority").agg(F.bool_and(F.abs(F.col("density") - F.col("exact")) <= bound + 1e-15).alias("within_bound"), (F.max(F.abs(F.col("density") - F.col("exact"))) < 0.01 * F.max("exact")).alias("near_exact"))
    return summed.join(checked, "o_orderpriority").select("o_orderpriority", "points", "near_exact", "total", "within_bound")


# --- classes ----------------------------------------------------------------------------


@query("""with v as (select o_totalprice x, count(*) n from orders group by 1), c as (select x, sum(n) over w n, sum(n * x) over w s, sum(n * x * x) over w q, sum(n) over () tn, sum(n * x) over () ts, sum(n * x * x) over () tq from v window w as (order by x)),
b as (select x, (q - s * s / n + tq - q - (ts - s) ** 2 / (tn - n)) / (tq - ts * ts / tn) rest from c where n < tn), e as (select arg_min(x, rest) x, min(rest) rest from b)
select round(x, 2) upper, round(1 - rest, 6) fit from e union all select round(max(o_totalprice), 2), round(1 - any_value(rest), 6) from orders, e""")
def natural_breaks_of_prices(spark, d):
    """Two classes of all prices."""
    ends, fit = breaks.natural_breaks(table(spark, d, "orders", "o_totalprice"), "o_totalprice", 2)
    return spark.createDataFrame([(e, fit) for e in ends], "upper double, fit double").select(F.round("upper", 2).alias("upper"), F.round("fit", 6).alias("fit"))
