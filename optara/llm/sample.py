"""A bounded sample of labelled documents, found from the labels alone so that no other text moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def labelled(docs: DataFrame, labels: DataFrame, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label, h) of the documents whose labels (key, label) have the least hashes of their keys: at most `most` keys.

    Labels without a key or value don't count, of several labels for a key the largest does. The chosen keys, at most
    `most` of them, are broadcast; the sample is written once, since fitting passes over it several times.
    """
    rated = labels.select(F.col(labels.columns[0]).alias("__key"), F.col(labels.columns[1]).cast("int").alias("label")).where("__key is not null and label is not null")
    rated = rated.groupBy("__key").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("__key"))
    rated = rated.orderBy("h", "__key").limit(most)
    found = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(rated), F.col("key") == F.col("__key"))
    return materialize(found.select("key", "text", "label", "h"), "labelled-sample")
