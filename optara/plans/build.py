"""Dump to decision files: products, pools, keyed draws, sealed and undecidable rows out, files and a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import episodes, relations
from ..sources.dump import read_products
from ..sources.files import write_json, write_jsonl

SEED = 20261015


def histogram(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row: a map from a column's values, which are few, to their counts."""
    return df.groupBy(column).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "count")))).alias(name))


def counted(products: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: products, rows kept and dropped on both sides, and histograms of the training rows kept."""
    c = rows.select("split", "difficulty", "lang", episodes.is_publishable().alias("kept"))
    side = lambda split, kept: F.count_if((F.col("split") == split) & (F.col("kept") == kept))
    whole = c.agg(side("train", True).alias("train_rows"), side("train", False).alias("train_undecidable_dropped"), side("dev", True).alias("dev_pool_rows"), side("dev", False).alias("dev_sealed_or_undecidable_dropped"))
    train = c.where((F.col("split") == "train") & F.col("kept"))
    one = products.select("code").distinct().agg(F.count("*").alias("products"))
    for other in (whole, histogram(train, "difficulty", "by_difficulty"), histogram(train, "lang", "by_language")):
        one = one.join(F.broadcast(other))  # one row each
    return one


def build(spark: SparkSession, path: str, out: str, per_category: int = 12, seed: int = SEED, partitions: int | None = None) -> dict:
    """Write train, dev-pool and manifest.json below out; the rows depend on dump and seed, not on partitioning."""
    products = read_products(spark, path, partitions).persist()
    try:
        rows = episodes.build(products, per_category, seed).persist()
        kept = episodes.publishable(rows)
        train, dev = (kept.where(F.col("split") == s).drop("split") for s in ("train", "dev"))
        write_jsonl(train, f"{out}/train", "overwrite")
        write_jsonl(dev, f"{out}/dev-pool", "overwrite")
        manifest = {"source": {"path": path.rsplit("/", 1)[-1], "license": "ODbL-1.0"}, "seed": seed} | counted(products, rows).first().asDict()
        rows.unpersist()
    finally:
        products.unpersist()
    write_json(spark, f"{out}/manifest.json", manifest)
    return manifest


def leaks(train: DataFrame, dev: DataFrame) -> DataFrame:
    """One row (shared): products on both sides of the split."""
    codes = lambda df: df.select(F.explode(F.split(F.regexp_replace("group_id", "^off/", ""), r"\+")).alias("code"))
    return relations.disjoint(codes(train), codes(dev), ["code"])
