"""The product dump: tab-separated, gzip, no quoting; cleaned products with a consistent panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.exact import strip, to_number

TEXTS = ("code", "product_name", "brands", "quantity", "countries_en", "main_category_en", "categories_en", "sodium_100g")


def read_dump(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """All columns as strings under their header's names, with file_pos in file order.

    Columns are picked by name: a schema would bind by position. A gzip file is one partition whatever its size, so the
    position is taken before rows are dealt out again.
    """
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("maxCharsPerColumn", -1).csv(path)
    wanted = [*TEXTS, *W.COLUMNS.values()]
    rows = raw.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in wanted), F.monotonically_increasing_id().alias("file_pos"))
    return rows.repartition(partitions) if partitions else rows


def language_of(countries: Column) -> Column:
    """Language of the first country of a comma list that has one."""
    known = F.create_map(*(F.lit(x) for pair in W.COUNTRIES.items() for x in pair))
    found = F.filter(F.transform(F.split(countries, ","), lambda c: F.try_element_at(known, c)), lambda x: x.isNotNull())
    return F.try_element_at(found, F.lit(1))


def clean(rows: DataFrame) -> DataFrame:
    """Products (code, name, brand, quantity, category, group, language, values, sodium, file_pos) that pass all rules."""
    first = lambda c, n: F.substring(strip(F.split(F.col(c), ",")[0]), 1, n)
    out = rows.select(
        "code", "file_pos", language_of(F.col("countries_en")).alias("language"), strip(F.col("product_name")).alias("name"), strip(F.col("main_category_en")).alias("category"),
        first("brands", 40).alias("brand"), F.substring(strip(F.col("quantity")), 1, 20).alias("quantity"), first("categories_en", 1 << 20).alias("group"),
        *(to_number(F.col(f"`{c}`")).alias(f"v_{n}") for n, c in W.COLUMNS.items()), to_number(F.col("sodium_100g")).alias("sodium"),
    )
    grams = [F.col(f"v_{n}").between(0, 100) for n in W.COLUMNS if n != "energy"]
    ok = F.col("language").isNotNull() & (F.col("name") != "") & (F.col("category") != "") & ~F.col("category").contains(":") & (F.col("v_energy") > 0) & (F.col("v_energy") <= 900)
    for g in grams:
        ok = ok & g
    # Sodium must agree with salt; a slightly negative sodium next to no salt passes and is kept.
    ok = ok & (F.abs(F.col("sodium") * F.lit(2.5) - F.col("v_salt")) <= F.greatest(F.lit(0.05), F.lit(0.1) * F.col("v_salt")))
    return out.where(ok).select(
        "code", F.substring("name", 1, 80).alias("name"), "brand", "quantity", "category", F.coalesce(F.nullif("group", F.lit("")), F.col("category")).alias("group"), "language",
        F.struct(*(F.col(f"v_{n}").alias(n) for n in W.COLUMNS)).alias("values"), "sodium", "file_pos",
    )


def read_products(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    return clean(read_dump(spark, path, partitions))
