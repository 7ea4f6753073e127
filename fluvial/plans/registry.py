"""Where queries and their SQL are entered, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rows_of(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """Maps Arrow batches by a function of a pandas frame."""

    def run(batches):
        for pdf in batches:
            yield f(pdf)

    return df.mapInPandas(run, schema)
