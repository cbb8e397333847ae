"""Deduplication, splits, pools, stratified samples and history windows over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import unit
from .ranks import PART, carried, in_ranges, row_numbers

DEV_SHARE, SEALED_SHARE, POOL_ROWS = 0.2, 0.25, 400


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order. order must be total over a key's rows for a reproducible result.

    min over a struct combines before the shuffle, so a key of any size costs one row per task.
    """
    names = [f"__o{i}" for i in range(len(order))]
    rest = [c for c in df.columns if c not in key]
    packed = df.select(*key, F.struct(*(o.alias(n) for o, n in zip(order, names, strict=True)), *(F.col(c).alias(f"__r{i}") for i, c in enumerate(rest))).alias("__row"))
    best = packed.groupBy(*key).agg(F.min("__row").alias("__row"))
    return best.select(*key, *(F.col(f"__row.__r{i}").alias(c) for i, c in enumerate(rest))).select(*df.columns)


def last_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by columns whose values are total over a key's rows; combined before the shuffle as in first_of."""
    rest = [c for c in df.columns if c not in (*key, *order)]
    best = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("__row"))
    return best.select(*key, *(F.col(f"__row.{c}").alias(c) for c in (*order, *rest))).select(*df.columns)


def split_of(key: Column) -> Column:
    """dev or train by a hash of the key: stable when rows come or go."""
    return F.when(unit(key) < DEV_SHARE, "dev").otherwise("train")


def sealed(key: Column, salt: str = "sealed") -> Column:
    """A second, salted hash that sets part of the rows aside."""
    return unit(F.concat(F.lit(salt + "/"), key)) < SEALED_SHARE


def pool_cap(df: DataFrame, pool: list[str], order: list[Column], most: int = POOL_ROWS) -> DataFrame:
    """The first rows of each pool; Spark turns the ranked filter into a group limit before the shuffle."""
    at = F.row_number().over(Window.partitionBy(*pool).orderBy(*order))
    return df.withColumn("__at", at).where(F.col("__at") <= most).drop("__at")


def stratified(df: DataFrame, cell: list[str], order: list[Column], limit: int) -> DataFrame:
    """Every n-th row of each cell so that about limit rows stay: at least one of each cell, evenly spaced.

    With n of N rows in a cell its share is max(1, rint(n * limit / N)), and positions int(i * n / share) stay. Counts come
    from partial aggregates, positions from row numbers that no single task computes; whether position j is one of those
    that stay is settled by the neighbours of j / step.
    """
    if not limit:
        return df
    counts = df.groupBy(*cell).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__rows"))
    counts = counts.join(F.broadcast(total))  # one row
    shares = counts.withColumn("__share", F.greatest(F.lit(1.0), F.rint(F.col("__n") * F.lit(limit) / F.col("__rows")))).withColumn("__step", F.col("__n") / F.col("__share"))
    match = [F.col(f"__c{i}").eqNullSafe(F.col(c)) for i, c in enumerate(cell)]
    shares = shares.select(*(F.col(c).alias(f"__c{i}") for i, c in enumerate(cell)), "__rows", "__share", "__step")
    ranked = row_numbers(df, cell, order, "__j")
    joined = ranked.join(shares, match)
    near = F.ceil(F.col("__j") / F.col("__step"))
    hit = F.lit(False)
    for d in (-1, 0, 1):
        i = near + d
        hit = hit | ((i >= 0) & (i < F.col("__share")) & (F.floor(i * F.col("__step")) == F.col("__j")))
    return joined.where(hit | (F.col("__rows") <= limit)).select(*df.columns)


def running_total(df: DataFrame, key: list[str], order: list[Column], value: Column, name: str = "total") -> DataFrame:
    """df with the sum of value up to each row. In this and the next ones a key of any size spans tasks: windows run within
    ranges of its rows, and what earlier ranges amount to is carried over."""
    dealt, keys = in_ranges(df.withColumn("__v", value), key, order)
    here = F.sum("__v").over(Window.partitionBy(*key, PART).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    total = F.when(F.col("__before").isNull(), here).otherwise(F.col("__before") + F.coalesce(here, F.lit(0)))
    return carried(dealt, key, __before=(F.sum("__v"), F.sum)).withColumn(name, total).select(*df.columns, name)


def champions(df: DataFrame, key: list[str], order: list[Column], value: str) -> DataFrame:
    """df with best_before (0 at first) and champion: whether value is above all before it."""
    dealt, keys = in_ranges(df, key, order)
    here = F.max(value).over(Window.partitionBy(*key, PART).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    best = carried(dealt, key, __before=(F.max(value), F.max)).withColumn("best_before", F.coalesce(F.greatest(here, "__before"), F.lit(0.0)))
    return best.withColumn("champion", F.coalesce(F.col(value) > F.col("best_before"), F.lit(False))).select(*df.columns, "best_before", "champion")


def islands(df: DataFrame, key: list[str], order: list[Column], value: str) -> DataFrame:
    """df with island: runs of equal value numbered from 0."""
    dealt, keys = in_ranges(df, key, order)
    w = Window.partitionBy(*key, PART).orderBy(*keys)
    last = F.max(F.struct(*keys, F.col(value).alias("v")))
    before = F.coalesce(F.lag(F.struct(F.col(value).alias("v"))).over(w), F.when(F.col("__last").isNotNull(), F.struct(F.col("__last.v").alias("v"))))
    marked = carried(dealt, key, __last=(last, F.max)).withColumn("__previous", before)
    marked = marked.withColumn("__new", (F.col("__previous").isNotNull() & ~F.col("__previous.v").eqNullSafe(F.col(value))).cast("int"))
    here = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return carried(marked, key, __earlier=(F.sum("__new"), F.sum)).withColumn("island", here + F.coalesce("__earlier", F.lit(0))).select(*df.columns, "island")


def rung_index(df: DataFrame, key: list[str], order: list[Column], cleared: Column, last: int = 5) -> DataFrame:
    """df with rung_index: how often a rung was cleared before, clipped to the last rung."""
    dealt, keys = in_ranges(df.withColumn("__c", cleared.cast("int")), key, order)
    here = F.sum("__c").over(Window.partitionBy(*key, PART).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    n = F.coalesce(here, F.lit(0)) + F.coalesce("__before", F.lit(0))
    return carried(dealt, key, __before=(F.sum("__c"), F.sum)).withColumn("rung_index", F.least(n, F.lit(last)).cast("long")).select(*df.columns, "rung_index")


def first_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows by an explicit order, as a top-n without a full sort."""
    return df.orderBy(*order).limit(n)


def unequal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (only_left, only_right): rows of one table that the other lacks, repeats counted; zeros where both are equal."""
    rest = lambda a, b, name: a.exceptAll(b).agg(F.count("*").alias(name))
    return rest(left, right, "only_left").join(F.broadcast(rest(right, left, "only_right")))  # one row each


def disjoint(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """One row (shared): how many distinct keys of left are in right."""
    return left.select(*key).join(right.select(*key), key, "left_semi").distinct().agg(F.count("*").alias("shared"))
