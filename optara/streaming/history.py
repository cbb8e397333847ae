"""The append-only history as a stream: running bests, champions and rung positions per run.

The batch views of the same log are in operators.relations; the state here is one row per run.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shared import shared_dir

EVENT = "run string, cycle long, accuracy double, cleared boolean"
OUT = "run string, cycle long, accuracy double, best_before double, champion boolean, rung_index long"
STATE = "best double, cleared long, last long"
LAST_RUNG = 5


def read_log(spark: SparkSession, path: str, schema: str | T.StructType = EVENT, files_per_trigger: int | None = None) -> DataFrame:
    """Files appended to a folder, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best, cleared, last = state.get if state.exists else (0.0, 0, -1)
    events = pd.concat(list(frames)).sort_values("cycle", kind="stable")
    events = events[events["cycle"] > last]  # a line that comes again changes nothing
    out = []
    for cycle, accuracy, clear in zip(events["cycle"], events["accuracy"], events["cleared"], strict=True):
        value = 0.0 if pd.isna(accuracy) else float(accuracy)
        out.append((key[0], int(cycle), accuracy, best, value > best, min(cleared, LAST_RUNG)))
        best, cleared, last = max(best, value), cleared + bool(clear), int(cycle)
    state.update((best, cleared, last))
    yield pd.DataFrame(out, columns=[f.split()[0] for f in OUT.split(", ")])


def champions(events: DataFrame) -> DataFrame:
    """Each event with the best before it, whether it is a champion, and the rung it was tried on."""
    return events.groupBy("run").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def hourly(events: DataFrame, late: str = "1 hour", every: str = "1 hour") -> DataFrame:
    """An extension beyond the log's own views: windowed counts and means of (ts, event_type, value), late rows bounded by a watermark."""
    window = F.window("ts", every)
    out = events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def drain(df: DataFrame, name: str) -> DataFrame:
    """Run an appending stream over what is there, into files of the shared folder, and read them as a table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")
