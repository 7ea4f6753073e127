"""The corpus pipeline: five stages over documents, each one operator of ``fluvial.llm``.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
all their columns and values, whatever their names; the last one returns the
encoded documents. ``run`` writes each stage's result as Parquet to the shared
folder and reads it again.

Edge cases, in every stage: an empty table gives an empty one; null and empty
texts are kept (the first stage judges them by its bias alone); very long texts
are taken whole. Rows that repeat, with equal id and text, become one in the
second stage; before it all of them are judged alike. Rows with a null id are
only compared with each other, for equal texts. Ties go to the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.llm import bpe, decontam, neardup, sufdedup, toxicity
from fluvial.llm.common import batch_bytes, crc_bucket, discard, materialise

#: Batches to Python workers in stages that take texts one by one, and in the third, whose packets grow with its batches.
SMALL, LARGE = "8m", "32m"
#: Characters that the last stage encodes at once: fewer than by default, which needs less memory and about a tenth more time.
BLOCK_CHARS = 1_000_000
#: Ids (of 8 bytes) up to which a table of ids is broadcast, some 80 MB in memory.
BROADCAST_IDS = 1_000_000


def private(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns under names that no operator uses, and the new name of each."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(docs[f"`{c}`"].alias(n) for c, n in names.items())), names


def public(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(n).alias(c) for c, n in names.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the classifier rejects (score of 0.5 or more)."""
    batch_bytes(spark, SMALL)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs.select("doc_id", "text"), labels, lambda key: crc_bucket(key, 5) != 0)
    rows, names = private(docs)
    return public(toxicity.score(rows, model, names["text"], tuple(rows.columns)).where("predicted = 0"), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8) stays: the one of the smallest id; of rows with equal id and text one stays."""
    batch_bytes(spark, SMALL)
    found = neardup.near_duplicates(docs.select("doc_id", "text"))
    rows, names = private(docs)
    key, text = names["doc_id"], names["text"]
    gone = materialise(found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    left = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, F.col(key) == F.col("__gone"), "left_anti")
    # ids on several rows are few; only their rows are compared by text
    again = materialise(left.groupBy(F.col(key).alias("__again")).count().where("count > 1").select("__again"), "again")
    n = again.count()
    if n:
        again = F.broadcast(again) if n <= BROADCAST_IDS else again
        same = F.col(key).eqNullSafe(F.col("__again"))
        several = left.join(again, same, "left_semi").dropDuplicates([key, text])
        left = left.join(again, same, "left_anti").unionByName(several)
    return public(left, names)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 200 bytes or more that stand elsewhere too; a document of which nothing is left goes."""
    batch_bytes(spark, LARGE)
    rows, names = private(docs)
    text = names["text"]
    found = sufdedup.dedup(rows, text, tuple(rows.columns)).where("n_bytes = 0 or n_removed < n_bytes")
    body = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(text))  # a null text stays null
    return public(found.withColumn(text, body), names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold ten words in a row of a benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), mode="documents")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    import public_tokenizers

    batch_bytes(spark, SMALL)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_documents(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, block_chars=BLOCK_CHARS, digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("contamination", drop_contaminated),
    ("tokens", encode),
]

#: Trained models and tokenizers cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        discard(last)
        last = docs
    return docs
