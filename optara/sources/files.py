"""JSON-lines, document, text, digest and log sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .store import Store

# Columns of the files.
EPISODE = (
    "id string, state string, question string, candidates array<struct<id: string, text: string>>, answer string, group_id string, lang string, capability string, "
    "domain string, difficulty string, decidable boolean, origin string, license string, source_id string"
)
HISTORY = ("cycle int, rung string, accuracy double, chance double, wilson_lower double, rows int, loss double, train_rows int, cleared boolean, seconds double, at timestamp")
RESULT = (
    "system struct<name: string, kind: string, device: string>, rows long, hits long, accuracy double, wilson_lower double, decidable_rows long, decidable_accuracy double, chance double, unparsed long, "
    "`by` map<string, struct<accuracy: double, rows: long>>, latency_ms struct<p50: double, p95: double, mean: double>, batched_decisions_per_s double"
)


def read_jsonl(spark: SparkSession, path: str, schema: str = EPISODE) -> DataFrame:
    """One row per line; blank lines are skipped and bad ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write JSON lines and return their number, counted while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    """One small document, keys sorted, in whatever store the path names."""
    Store(spark).write(path, json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n")


def read_documents(spark: SparkSession, folder: str, schema: str = RESULT) -> DataFrame:
    """A folder of JSON documents, each a row with its file's name, sorted by it."""
    return spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).orderBy("file")


def write_lines(lines: DataFrame, path: str, order: str, column: str = "line") -> None:
    """Ordered lines as text. A report is small: its rows are one per system."""
    lines.orderBy(order).select(column).coalesce(1).write.mode("overwrite").text(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
