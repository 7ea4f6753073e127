"""Reading and writing of series, curves, matrices and results; shared intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder of the context; one is made in local mode alone, where there is one disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='fluvial-')}"
    spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/fluvial-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes to the shared folder and reads it back: cuts lineage for good."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._fluvial_folder = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Removes what ``materialise`` wrote for tables that nothing reads any more."""
    for table in tables:
        folder = getattr(table, "_fluvial_folder", None)
        if folder:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_series_xml(df: DataFrame, path: str, ts: str = "ts", v: str = "v") -> None:
    """One SeriesOrdinate element a row, with ISO stamps."""
    df.select(F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("Index"), F.col(v).alias("Value")).write.format("xml").option("rootTag", "TimeSeries").option("rowTag", "SeriesOrdinate").mode("overwrite").save(path)


def read_series_xml(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "SeriesOrdinate").schema("Index string, Value double").load(path)
    return rows.select(F.to_timestamp("Index").cast("timestamp_ntz").alias("ts"), F.col("Value").alias("v"))


def write_curve_xml(df: DataFrame, path: str, strict_x: bool = True, strict_y: bool = True, order_x: str = "Ascending", order_y: str = "Ascending") -> None:
    """One Ordinate element a row; order and strictness of both axes are attributes of the root."""
    root = f'PairedData StrictX="{strict_x}" StrictY="{strict_y}" OrderX="{order_x}" OrderY="{order_y}"'
    df.select("x", "y").write.format("xml").option("rootTag", root).option("rowTag", "Ordinate").mode("overwrite").save(path)


def read_curve_xml(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "Ordinate").schema("x double, y double").load(path)


def read_curve_options(spark: SparkSession, path: str) -> DataFrame:
    """strict_x, strict_y, order_x and order_y of a written curve: one row."""
    names = {"strict_x": "boolean", "strict_y": "boolean", "order_x": "string", "order_y": "string"}
    raw = ["StrictX", "StrictY", "OrderX", "OrderY"]
    rows = spark.read.text(path).select(*(F.regexp_extract("value", f'{r}="([^"]*)"', 1).alias(n) for r, n in zip(raw, names, strict=True))).where("strict_x <> ''")
    return rows.select(*(F.col(n).cast(t) for n, t in names.items())).distinct()


def write_uncertain_curve_xml(df: DataFrame, path: str) -> None:
    """Columns x, dist, params: one Ordinate element a row, with its distribution inside."""
    rows = df.select("x", F.struct(F.col("dist").alias("_Type"), F.array_join(F.transform("params", lambda p: p.cast("string")), "|").alias("_Parameters")).alias("Distribution"))
    rows.write.format("xml").option("rootTag", "UncertainPairedData").option("rowTag", "Ordinate").mode("overwrite").save(path)


def read_uncertain_curve_xml(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "Ordinate").schema("x double, Distribution struct<_Type: string, _Parameters: string>").load(path)
    return rows.select("x", F.col("Distribution._Type").alias("dist"), parse_list(F.col("Distribution._Parameters")).alias("params"))


def write_matrix_xml(df: DataFrame, path: str) -> None:
    """(i, j, v) rows."""
    df.select("i", "j", "v").write.format("xml").option("rootTag", "Matrix").option("rowTag", "Cell").mode("overwrite").save(path)


def read_matrix_xml(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "Cell").schema("i long, j long, v double").load(path)


def array_2d_json(m: Column) -> Column:
    """An array of rows as JSON: numbers of rows and columns, and all values in one list."""
    return F.to_json(F.struct(F.size(m).alias("rows"), F.coalesce(F.size(F.try_element_at(m, F.lit(1))), F.lit(0)).alias("cols"), F.flatten(m).alias("data")))


def array_2d_from_json(c: Column, kind: str = "double") -> Column:
    s = F.from_json(c, f"rows int, cols int, data array<{kind}>", {"allowNonNumericNumbers": "true"})
    return F.when(s["rows"] > 0, F.transform(F.sequence(F.lit(1), s["rows"]), lambda i: F.slice(s["data"], (i - 1) * s["cols"] + 1, s["cols"]))).otherwise(F.array())


def to_json_bytes(c: Column) -> Column:
    """A struct as JSON bytes."""
    return F.to_json(c).cast("binary")


def from_json_bytes(c: Column, schema: str) -> Column:
    return F.from_json(c.cast("string"), schema, {"allowNonNumericNumbers": "true"})


def parse_list(c: Column, delimiter: str = "|") -> Column:
    """A delimited list of numbers as an array."""
    import re

    return F.transform(F.split(c, re.escape(delimiter)), lambda x: F.trim(x).cast("double"))


def format_list(c: Column, delimiter: str = "|") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), delimiter)


def probability_list_errors(c: Column) -> Column:
    """Whether a list of probabilities is not strictly monotone or leaves (0, 1)."""
    outside = F.exists(c, lambda p: (p <= 0) | (p >= 1))
    steps = F.transform(F.sequence(F.lit(2), F.size(c)), lambda i: F.signum(F.element_at(c, i) - F.element_at(c, i - 1)))
    return outside | F.when(F.size(c) >= 2, (F.size(F.array_distinct(steps)) > 1) | F.array_contains(steps, 0.0)).otherwise(F.lit(False))


def matrix_rows(df: DataFrame) -> DataFrame:
    """(i, j, v) rows of an array<array<double>> column ``m``."""
    return df.select(F.posexplode("m").alias("i", "r")).select("i", F.posexplode("r").alias("j", "v"))


def compress(data: bytes) -> bytes:
    return zlib.compress(data)


def decompress(data: bytes) -> bytes:
    return zlib.decompress(data)
