"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optara.llm import bpe, exact_dedup, minhash, mixing, toxicity
from optara.llm.common import ROW, materialize, numbered, table
from optara.llm.queries import TOXIC_CUT, tokenizer_path, toxicity_model
from optara.shared import settle, written
from optara.shipping import shipped


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the cut; the model learns from the labelled ones among docs."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    names = {f"__c{i}": c for i, c in enumerate(docs.columns)}  # columns of docs may be called as the score's
    renamed = docs.toDF(*names)
    scored = toxicity.score(renamed, model, text=f"__c{docs.columns.index('text')}", keep=tuple(names))
    return scored.where(F.col("score") < TOXIC_CUT).select(*(F.col(n).alias(c) for n, c in names.items()))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest original text, then the least id."""
    rows = numbered(docs)
    return _without(rows, exact_dedup.groups(rows, key=ROW, ties=("doc_id",))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one of least id, of each group that shares 80% or more of its five-word shingles."""
    rows = numbered(docs)
    return _without(rows, minhash.groups(rows, percent=80, key=ROW, ties=("doc_id",))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last one of a source cut at its budget."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row for every document of the mix."""
    return bpe.encode(docs, tokenizer_path(), keep=("doc_id", "source"))


STAGES = [
    ("toxicity", shipped(drop_toxic)),
    ("exact_dedup", shipped(drop_exact_copies)),
    ("minhash_dedup", shipped(drop_near_copies)),
    ("mixing", shipped(mix_sources)),
    ("bpe", shipped(encode)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again.

    What a stage and those before it wrote besides is deleted as soon as its result is there.
    """
    docs, since = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}", since)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Toxicity learns a model and near-duplicate links need transitive closure over hashed bands: no SQL; tests use brute force.
ORACLE_SQL = None


def _without(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Numbered rows without those that their group doesn't keep.

    Decisions are made for rows, not ids, so that repeated and null ids are judged like others. The dropped rows' numbers
    are written first: where their files are small enough to broadcast, Spark sees that beforehand and no text is
    shuffled for the join; where they aren't, it is an ordinary one.
    """
    return rows.join(materialize(groups.where(~F.col("kept")).select(ROW), "dropped-rows"), ROW, "left_anti")
