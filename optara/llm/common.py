"""Shared helpers: table access, the shared folder, word rules and session bounds."""

from __future__ import annotations

import ctypes
import functools
import re
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..shared import partitions, shared_dir  # noqa: F401  (operators take them from here)

#: A word is a maximal run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
#: Largest value that operators broadcast to executors, in bytes.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Column that numbers the rows of a table while a stage needs to tell them apart.
ROW = "__row"


#: Rows that a function over long texts gets at once.
ARROW_ROWS = 2_000


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back, see shared.materialize.

    While it is written, ARROW_ROWS rows cross to Python at once where the session has Spark's default of 10,000, which is meant for
    short rows; the session's own setting is put back before this returns.
    """
    conf, size = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(size)
    if before != "10000":
        return shared.materialize(df, label)
    conf.set(size, str(ARROW_ROWS))
    try:
        return shared.materialize(df, label)
    finally:
        conf.set(size, before)


def numbered(df: DataFrame) -> DataFrame:
    """df with a number for each row in ROW, written once so that every later pass sees the same numbers."""
    return materialize(df.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def broadcast_checked(spark: SparkSession, value, size: int, what: str):
    """Broadcast a value whose size in bytes is known and below BROADCAST_BYTES."""
    if size > BROADCAST_BYTES:
        raise ValueError(f"{what}: {size} bytes exceed the broadcast bound of {BROADCAST_BYTES}")
    return spark.sparkContext.broadcast(value)


#: Keys of a table that may be broadcast whole; of more keys, those with more than this part of all rows, which are fewer.
HEAVY = 20_000


def with_groups(rows: DataFrame, groups: DataFrame, key: str, n: str = "n") -> DataFrame:
    """rows with the columns that groups has for their key, null where it has none; no task gets all rows of a heavy key.

    groups has a row of bounded size for each of its keys, and in n how many rows have it. Up to HEAVY keys are broadcast. Of more, the
    fewer than HEAVY keys with more than that part of all these rows are, and the rest is an ordinary join.
    """
    keys, whole = groups.agg(F.count("*"), F.coalesce(F.sum(n), F.lit(0))).first()
    if keys <= HEAVY:
        return rows.join(F.broadcast(groups), key, "left")
    heavy, light = F.broadcast(groups.where(F.col(n) > whole / HEAVY)), groups.where(F.col(n) <= whole / HEAVY)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key, "left"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1: rows whose labels no model may see."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def frugal(run):
    """A function over batches for long texts: it gets short batches, and memory is given back at its end.

    Python workers live on after a task and would keep what it took. The session's own settings stay as they are.
    """

    @functools.wraps(run)
    def over(batches):
        try:
            yield from run(b.slice(at, ARROW_ROWS) for b in batches for at in range(0, max(1, b.num_rows), ARROW_ROWS))
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return over
