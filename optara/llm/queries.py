"""The ten operators as registered queries, each over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, minhash, mixing, pii, quality, topk, toxicity, url_filter
from .common import held_out, table

TOXIC_CUT = 0.7
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
TOKENIZER = "word_bpe_49k.json"


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from labelled documents outside the held-out third."""
    return toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_CUT).cast("int").alias("predicted"), "n_passages")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), percent=85)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents")).drop("top_score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("epochs", "source")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Grades 0 (poor), 1 (good but toxic) and 2 (good), from labelled documents outside the held-out third."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return quality.fit(docs, labels.where("quality is not null").where(~held_out(F.col("doc_id"))).select("doc_id", grade))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    graded = quality.grade(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return graded.withColumn("held_out", held_out(F.col("doc_id")))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_url_filter, op3_minhash, op4_pii, op5_mixing, op6_chat, op7_topk, op8_exact_dedup, op9_quality, op10_bpe)}
