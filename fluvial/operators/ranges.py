"""Windows over all rows of a table in an order, in as many tasks as there are ranges.

A window without a partition key puts all rows into one task. Here rows are
sorted in ranges that are written once; each row has its number among all rows.
What a window needs from other ranges is little: a frame of fixed width needs
the last rows before the range and the first ones after it (its halo), which
are copied to it; running sums and the last present value need one carry a
range. The driver holds the bounds and carries of the ranges, and no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise

#: Bits of a row's place within its range, in the id that is given when ranges are written.
INSIDE = 33


class Ranges:
    """The rows with ``__part`` (range), ``__i`` (number from 1) and ``__own`` (not a copy).

    ``order`` must tell rows apart where their order matters: rows that agree
    in it come in no particular order, and many of them make one large range.
    """

    def __init__(self, df: DataFrame, order: Sequence[str | Column], n: int | None = None):
        columns = [F.col(c) if isinstance(c, str) else c for c in order]
        n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sorted_ = df.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
        written = materialise(sorted_.withColumn("__at", F.monotonically_increasing_id()))
        part = F.shiftright("__at", INSIDE)
        counts = sorted((r["p"], r["n"]) for r in written.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each range
        self.bounds, self.total = [], 0
        for p, n in counts:
            self.bounds.append((p, self.total + 1, self.total + n))
            self.total += n
        self.window = Window.partitionBy("__part").orderBy("__i")
        first = self._joined(written.withColumn("__part", part), {p: a for p, a, _ in self.bounds}, "__first", "bigint")
        self.rows = first.withColumn("__i", F.col("__first") + F.col("__at").bitwiseAND((1 << INSIDE) - 1)).drop("__at", "__first").withColumn("__own", F.lit(True))

    def _joined(self, rows: DataFrame, values: dict, name: str, kind: str) -> DataFrame:
        """Each range's value as a column, from a table of a row for each range."""
        small = rows.sparkSession.createDataFrame(list(values.items()), f"__range bigint, `{name}` {kind}")
        return rows.join(F.broadcast(small), F.col("__part") == F.col("__range"), "left").drop("__range")

    def with_halo(self, before: int = 0, after: int = 0) -> DataFrame:
        """The rows, and copies (``__own`` false) of the ``before`` rows in front of each range and the ``after`` rows behind it, from as many ranges as that takes."""
        wanted: dict[int, list] = {}
        for p, a, b in self.bounds:  # ranges that need rows of range p, and which ones
            for q, c, d in self.bounds:
                if q > p and c - before <= b:
                    wanted.setdefault(p, []).append((q, max(a, c - before), b))
                elif q < p and d + after >= a:
                    wanted.setdefault(p, []).append((q, a, min(b, d + after)))
        if not wanted:
            return self.rows
        lent = self._joined(self.rows, wanted, "__to", "array<struct<q: bigint, a: bigint, b: bigint>>").where(F.col("__to").isNotNull())
        lent = lent.withColumn("__to", F.explode(F.filter("__to", lambda t: F.col("__i").between(t["a"], t["b"]))))
        copies = lent.withColumns({"__part": F.col("__to.q"), "__own": F.lit(False)}).drop("__to")
        return self.rows.unionByName(copies)

    def running_sum(self, value: Column, out: str) -> DataFrame:
        """Sums of all rows up to each: those inside the range behind the sum of the ranges before it."""
        sums = {r["__part"]: r["s"] for r in self.rows.groupBy("__part").agg(F.sum(value).alias("s")).collect()}  # a row for each range
        carry, total = {}, None
        for p, *_ in self.bounds:
            carry[p] = total
            total = sums[p] if total is None else total if sums[p] is None else total + sums[p]
        inside = F.sum(value).over(self.window.rowsBetween(Window.unboundedPreceding, 0))
        kind = self.rows.select(F.sum(value).alias("s")).schema["s"].dataType.simpleString()
        rows = self._joined(self.rows.withColumn(out, inside), carry, "__carry", kind)
        return rows.withColumn(out, F.coalesce(F.col(out) + F.col("__carry"), F.col(out), F.col("__carry"))).drop("__carry")

    def around(self, value: Column, last: str, earlier: str, following: str) -> DataFrame:
        """Of each row the last present value up to it, the present one before that, and the first present one from it on."""
        w = self.window
        upto, strictly = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
        rows = self.rows.withColumn("__x", value)
        rows = rows.withColumns({last: F.last("__x", ignorenulls=True).over(upto), following: F.first("__x", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), "__e": F.when(F.col("__x").isNotNull(), F.last("__x", ignorenulls=True).over(strictly))})
        rows = rows.withColumn(earlier, F.last("__e", ignorenulls=True).over(upto)).withColumn("__some", F.col(last).isNotNull())
        kind = rows.schema["__x"].dataType.simpleString()
        ends = rows.groupBy("__part").agg(F.max_by(F.struct(F.col(last).alias("l"), F.col(earlier).alias("e")), "__i").alias("end"), F.min_by(F.col(following), "__i").alias("begin")).collect()  # a row for each range
        ends = {r["__part"]: r for r in ends}
        carry, l, e = {}, None, None
        for p, *_ in self.bounds:
            carry[p] = (l, e)
            end = ends[p]["end"]
            if end["l"] is not None:
                e = end["e"] if end["e"] is not None else l
                l = end["l"]
        ahead, f = {}, None
        for p, *_ in reversed(self.bounds):
            ahead[p] = (*carry[p], f)
            f = ends[p]["begin"] if ends[p]["begin"] is not None else f
        rows = self._joined(rows, ahead, "__c", f"struct<l: {kind}, e: {kind}, f: {kind}>")
        before = F.when(F.col("__some"), F.coalesce(earlier, "__c.l")).otherwise(F.col("__c.e"))
        return rows.withColumns({earlier: before, last: F.coalesce(last, "__c.l"), following: F.coalesce(following, "__c.f")}).drop("__x", "__e", "__c", "__some")
