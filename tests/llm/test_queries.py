"""The queries of the corpus operators against their SQL, and the pipeline against its stages done plainly."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fluvial.llm import neardup, queries

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, D).toPandas(), duck.execute(queries.ORACLES[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    a, b = (sorted(map(tuple, x[cols].astype(object).where(x[cols].notna(), None).astype(str).values.tolist())) for x in (got, want))
    assert [[v.removesuffix(".0") for v in r] for r in a] == [[v.removesuffix(".0") for v in r] for r in b]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, left = docs.columns, docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = left
        left = stage(spark, left, D)
        assert left.columns == columns, name
        left = spark.createDataFrame(left.toPandas(), docs.schema)
        assert left.join(before, "doc_id", "left_anti").count() == 0
        counts.append(left.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    last = corpus_pipeline.STAGES[-1][1](spark, left, D)
    assert last.count() == counts[-1] and np.min([r["n_tokens"] for r in last.collect()]) >= 0
    # what the second stage keeps has no near copies left
    kept = neardup.near_duplicates(left)
    assert kept.where("not kept").count() <= 2


def test_pipeline_stages_on_odd_rows(spark):
    """Repeated rows leave one; clashing columns keep names and values; nulls, empty and very long texts and ties pass; empty tables stay empty."""
    labels = spark.read.parquet(f"{D}/labels.parquet")
    assert labels.count() > 0
    texts = {1: "one two three four five six seven " * 20 + "tail", 2: None, 3: "", 4: " ".join(f"w{k}" for k in range(30_000)), 5: "short text"}
    rows = [(k, t, f"s{k}") for k, t in texts.items()] * 2 + [(6, "short text", "s6"), (None, "no id", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = ("score", "predicted", "n_bytes", "n_removed", "kept", "n_tokens", "key", "__text", "__row", "component_id", "n_words")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.coalesce("source", F.lit(""))) for c in clash})
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, D)
        assert left.columns == docs.columns, name
        left = spark.createDataFrame(left.collect(), docs.schema)
        assert left.where(" or ".join(f"`{c}` <> concat('{c}', source)" for c in clash)).count() == 0, name
        assert stage(spark, docs.limit(0), D).count() == 0, name
    got = {r["doc_id"]: r["text"] for r in left.collect() if r["doc_id"] is not None and r["doc_id"] > 1}
    assert got == {k: t for k, t in texts.items() if k > 1}
    assert left.where("doc_id is null").count() == 1 and left.where("doc_id = 1").count() <= 1
    last = corpus_pipeline.STAGES[-1][1](spark, left, D)
    assert last.count() == left.count() and corpus_pipeline.STAGES[-1][1](spark, left.limit(0), D).count() == 0
