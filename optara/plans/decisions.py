"""Order decisions: orders with 3 to 5 line items as pick-one-of-K groups, and cards printed for their items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.exact import fmt
from ..functions.text import card, fill

VALUES = ("quantity", "price", "discount", "tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, k, line, part, quantity, price, discount, tax): one row per order with 3 to 5 items, arrays in option order.

    Items are counted before they are gathered, in a window that spills: an order of any other size is never held.
    """
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax")).alias("o"))
    sized = items.withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey"))).where(F.col("n").between(3, 5))
    grouped = sized.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list("o")).alias("o"))
    return grouped.select("id", F.size("o").cast("long").alias("k"), *(F.col(f"o.{c}").alias(c) for c in ("line", "part", *VALUES)))


def item_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, k, texts, quantity, price): each item's numbers printed as a card; salt is quantity, energy the price in hundreds."""
    d = decisions(spark, sf_dir)
    rows = F.arrays_zip("part", "quantity", "price", "discount", "tax")

    def text(x, i):
        values = F.struct((x["price"] / F.lit(100.0)).alias("energy"), (x["discount"] * F.lit(100.0)).alias("fat"), (x["tax"] * F.lit(50.0)).alias("saturated_fat"), (x["tax"] * F.lit(100.0)).alias("sugars"), x["discount"].alias("fiber"), x["tax"].alias("proteins"), x["quantity"].alias("salt"))
        product = {"brand": F.lit(""), "name": F.concat(F.lit("Part "), x["part"].cast("string")), "quantity": F.lit(""), "values": values, "sodium": x["quantity"] / F.lit(2.5)}
        return card(product, F.lit("en"), (i % 2 == 0) & F.lit(False))

    return d.select("id", "k", "quantity", "price", F.transform(rows, text).alias("texts"))


def questions(rows: DataFrame, limit) -> DataFrame:
    """rows with a capped question: at most limit g of salt, and the highest calories."""
    shown = rows.withColumn("limit", limit).withColumn("limit", fmt(F.col("limit")))
    return shown.withColumn("question", fill(F.lit(W.CAPPED["en"][0]), limit=F.col("limit"), c=F.lit("salt"), dir=F.lit("highest"), a=F.lit("calories")))
