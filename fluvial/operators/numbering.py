"""Row numbers in an order over any number of rows, without one task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a row's place within its partition.
INSIDE = 33


def numbered(df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = (), out: str = "__i") -> DataFrame:
    """Adds the row number (from 1) in the given order, by key.

    With keys this is a window. Without, rows are sorted in ranges, which are
    written once; each range's rows are numbered by their place, behind the
    counts of the ranges before it. Ranges split equal values too if the order
    has a last column that tells rows apart.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    if keys:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*columns)).cast("long"))
    from ..sources.tables import materialise

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    ranged = materialise(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", INSIDE)
    counts = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    # one row a range: their running sum is of bounded size
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("__before"))
    joined = ranged.join(F.broadcast(before), part == F.col("__part"))
    return joined.withColumn(out, F.col("__before") + F.col("__at").bitwiseAND((1 << INSIDE) - 1) + 1).drop("__at", "__part", "__before")


def average_ranks(df: DataFrame, v: str, keys: Sequence[str] = (), out: str = "__r") -> DataFrame:
    """Adds the rank; equal values share the mean of theirs. Values are ranked by their counts, so many equal ones are one row."""
    counts = df.where(F.col(v).isNotNull()).groupBy(*keys, v).agg(F.count("*").alias("__t"))
    if keys:
        w = Window.partitionBy(*keys).orderBy(v).rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("__c", F.sum("__t").over(w))
    else:
        ranked = running_sum(counts, "__t", [v], "__c")
    ranked = ranked.select(*keys, v, (F.col("__c") - F.col("__t") + (F.col("__t") + 1) / 2.0).alias(out))
    return df.join(ranked, [*keys, v])


def running_sum(df: DataFrame, amount: str, order: Sequence[str], out: str) -> DataFrame:
    """Running sum over all rows in an order, range by range."""
    from ..sources.tables import materialise

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    ranged = materialise(ranged)
    inside = F.sum(amount).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = ranged.groupBy("__part").agg(F.sum(amount).alias("n"))
    before = sums.select(F.col("__part").alias("__p"), (F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("__before"))
    return ranged.withColumn("__inside", inside).join(F.broadcast(before), F.col("__part") == F.col("__p")).withColumn(out, F.col("__before") + F.col("__inside")).drop("__part", "__p", "__before", "__inside")
