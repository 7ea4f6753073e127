"""Structured Streaming forms of the series operators: windows, sessions, running statistics, peaks over a threshold."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType, DoubleType, LongType, StructField, StructType


def block_stream(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", key: str = "event_type", v: str = "value", ts: str = "ts") -> DataFrame:
    """Count, sum, mean, min and max of tumbling or sliding windows; rows later than the watermark are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    got = events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total", "mean", "lo", "hi")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id", v: str = "value", ts: str = "ts") -> DataFrame:
    """Sessions that end after a gap."""
    got = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum(v).alias("total"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def running_moments(events: DataFrame, key: str = "event_type", v: str = "value") -> DataFrame:
    """Count, extremes, and power sums so far, from which all moments follow; for complete or update mode."""
    x = F.col(v)
    return events.groupBy(key).agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))


def _state(**columns: DataType) -> StructType:
    """A schema without a session, as workers have none."""
    return StructType([StructField(name, kind) for name, kind in columns.items()])


class _Clusters(StatefulProcessor):
    """Exceedances of a key wait in a list until the watermark has passed them, so they are walked through in order however they came; the open cluster is one value."""

    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _state(at=LongType(), x=DoubleType()))
        self.open = handle.getValueState("open", _state(peak=DoubleType(), at=LongType(), last=LongType(), n=LongType()))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for pdf in rows:  # batch by batch: no more of a key is held than came in one
            if len(pdf):
                self.waiting.appendList(list(zip(pdf["at"].tolist(), pdf["x"].tolist(), strict=True)))
                for at in {int(pdf["at"].min()) // 1000 + 1, int(pdf["at"].max()) // 1000 + 1}:
                    self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] < now], [r for r in rows if r[0] >= now]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        elif rows:
            self.waiting.clear()
        cur = self.open.get() if self.open.exists() else None
        closed = []
        for at, x in ready:
            if cur is not None and at - cur[2] > self.gap:
                closed.append(cur)
                cur = None
            if cur is None:
                cur = (x, at, at, 1)
            else:
                cur = (x, at, at, cur[3] + 1) if x >= cur[0] else (cur[0], cur[1], at, cur[3] + 1)
        if cur is not None and now > cur[2] + self.gap and not (rest and rest[0][0] - cur[2] <= self.gap):
            closed.append(cur)
            cur = None
        if cur is not None:
            self.open.update(cur)
            self.handle.registerTimer(max((cur[2] + self.gap) // 1000 + 1, now // 1000 + 1))
        elif self.open.exists():
            self.open.clear()
        if closed:
            yield pd.DataFrame([[key[0], c[0], pd.Timestamp(c[1], unit="us"), pd.Timestamp(c[2], unit="us"), c[3]] for c in closed], columns=[self.key, "peak", "at", "last", "n"])

    def close(self) -> None:
        pass


def peaks(events: DataFrame, threshold: float, gap: str = "30 minutes", late: str = "10 minutes", key: str = "event_type", v: str = "value", ts: str = "ts") -> DataFrame:
    """key, peak, at, last and n of clusters over a threshold: a cluster goes on while the next exceedance is at most ``gap`` behind the one before; of equal peaks the last counts.

    A row may come in any order within ``late``; later ones are dropped. The
    watermark follows the rows over the threshold, as others are filtered where
    they are read. A cluster is written once the watermark is past its last row and the gap.
    The session's state store must be one that has lists and timers
    (``use_rocks``).
    """
    micros = int(pd.Timedelta(gap) / pd.Timedelta("1us"))
    over = events.withWatermark(ts, late).where((F.col(v) > threshold) & ~F.isnan(v) & F.col(ts).isNotNull())
    rows = over.select(F.col(key).cast("string").alias(key), F.col(ts), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(v).cast("double").alias("x"))
    schema = f"`{key}` string, peak double, at timestamp, last timestamp, n long"
    return rows.groupBy(key).transformWithStateInPandas(_Clusters(key, micros), schema, "append", "eventtime")


def exceedances(events: DataFrame, threshold: float, gap_seconds: float, key: str = "event_type", v: str = "value", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """``peaks`` with a gap in seconds, without the last stamp."""
    return peaks(events, threshold, f"{gap_seconds} seconds", late, key, v, ts).drop("last")


def use_rocks(spark: SparkSession) -> None:
    """State in RocksDB, which lists and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
