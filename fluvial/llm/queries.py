"""The queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, cotrain, decontam, hostrules, langid, licenses, neardup, negatives, quotes, simhash, sufdedup, toxicity
from .common import crc_bucket


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_bucket(F.col("doc_id"), 3) == 1
    model = langid.train(docs, ~held)
    return langid.predict(docs.withColumn("held_out", held), model, keep=("doc_id", "held_out"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sufdedup.dedup(table(spark, sf_dir, "documents"), digests=True)


def op3_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotes.link(table(spark, sf_dir, "conversations"))
    return linked.select("conv_id", "turn", "role", "parent_turn", "n_quoted", "n_linked", "position", F.sha2("body", 256).alias("body_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.train(docs))
    return found.select("doc_id", "n_licences", "n_unknown", F.array_join("families", ",").alias("families"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str, ranks_file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path(ranks_file))
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, digests=True)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda k: crc_bucket(k, 5) != 0)
    held = crc_bucket(F.col("doc_id"), 5) == 0
    return toxicity.score(docs.withColumn("held_out", held), model, keep=("doc_id", "held_out"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(table(spark, sf_dir, "documents")).drop("host_rate")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = cotrain.train(docs, table(spark, sf_dir, "labels"), lambda k: crc_bucket(k, 5) != 0)
    held = crc_bucket(F.col("doc_id"), 5) == 0
    return cotrain.score(docs.withColumn("held_out", held), model, keep=("doc_id", "held_out"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.expr("vec_id % 100 = 0"))


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_suffix_dedup, op3_chat_quotes, op4_license_scan, op5_byte_bpe, op6_toxicity, op7_decontamination, op8_near_duplicates, op9_host_rules, op10_quality, op11_centroids, op12_simhash, op13_hard_negatives)
}
ORACLES: dict[str, str] = {
    "op3_chat_quotes": quotes.ORACLE_SQL,
    "op7_decontamination": decontam.ORACLE_SQL,
    "op8_near_duplicates": neardup.ORACLE_SQL,
    "op9_host_rules": hostrules.ORACLE_SQL,
    "op11_centroids": centroids.ORACLE_SQL,
    "op13_hard_negatives": negatives.ORACLE_SQL,
}
