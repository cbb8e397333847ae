"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the session's checkpoint folder, else (local masters only) one made here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="optara-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


_written: list[str] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def clear(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that materialize wrote for this driver, from the one numbered since on; for use once results are stored."""
    jvm, n = spark.sparkContext._jvm, 0
    while len(_written) > since:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def written() -> int:
    """How many tables materialize has written that aren't deleted."""
    return len(_written)


def settle(df: DataFrame, label: str, since: int) -> DataFrame:
    """df written as materialize does; all tables written since are deleted then, for nothing needs them any more."""
    out = materialize(df, label)
    kept = _written.pop()
    clear(df.sparkSession, since)
    _written.append(kept)
    return out
