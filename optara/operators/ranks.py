"""Row numbers and exact quantiles of groups of any size: no group is sorted in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize, partitions

SPLITTERS = 200


PART = "__part"


def in_ranges(df: DataFrame, group: list[str], order: list[Column]) -> tuple[DataFrame, list[str]]:
    """df dealt by ranges of (group, order), so that a large group spans partitions, with its partition in PART; and order's columns.

    The dealt rows are written once, since all that follows must see the same partitions.
    """
    keys = [f"__k{i}" for i in range(len(order))]
    dealt = df.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(partitions(df.sparkSession), *group, *keys).withColumn(PART, F.spark_partition_id())
    return materialize(dealt, "ranges"), keys


def carried(dealt: DataFrame, group: list[str], **of: tuple[Column, Callable[[Column], Column]]) -> DataFrame:
    """dealt with, for each name, what an aggregate gives over a group's earlier parts: (the aggregate, how parts' results combine)."""
    parts = dealt.groupBy(*group, PART).agg(*(a.alias(n) for n, (a, _) in of.items()))
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(group)), F.col(PART).alias("__p"), *(combine(F.col(n)).over(before).alias(n) for n, (_, combine) in of.items()))
    match = [F.col(f"__g{i}").eqNullSafe(F.col(c)) for i, c in enumerate(group)] + [F.col("__p") == F.col(PART)]
    return dealt.join(parts, match).drop("__p", *(f"__g{i}" for i in range(len(group))))


def row_numbers(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """df with name: each row's place (from 0) in its group by order, which should be total for a reproducible result.

    Counts of a group's earlier ranges give offsets, and a window runs only within a range.
    """
    dealt, keys = in_ranges(df, group, order)
    at = F.row_number().over(Window.partitionBy(*group, PART).orderBy(*keys)) - 1
    return carried(dealt, group, __offset=(F.count("*"), F.sum)).withColumn(name, at + F.coalesce("__offset", F.lit(0))).select(*df.columns, name)


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Per group n and, for each name, the value at that rank (from 0, a whole number made from n) of the sorted values.

    Approximate quantiles cut each group into ranges; counts per range tell which ranges hold the ranks wanted, and only
    the distinct values of those are ranked. Null values don't count. Groups are few: one row of splitters each.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    fractions = F.array(*(F.lit(i / SPLITTERS) for i in range(1, SPLITTERS)))
    splits = rows.groupBy(*by).agg(F.percentile_approx("__v", fractions, F.lit(4 * SPLITTERS)).alias("__splits"))
    same = lambda a: [F.col(f"{a}{i}").eqNullSafe(F.col(c)) for i, c in enumerate(by)]
    renamed = lambda t, a, *more: t.select(*(F.col(c).alias(f"{a}{i}") for i, c in enumerate(by)), *more)
    placed = rows.join(renamed(splits, "__s", "__splits"), same("__s")) if by else rows.join(F.broadcast(splits))
    counted = placed.withColumn("__range", F.size(F.filter("__splits", lambda s: s < F.col("__v")))).groupBy(*by, "__range", "__v").agg(F.count("*").alias("__c"))
    counted = materialize(counted, "quantile-counts")
    ranges = counted.groupBy(*by, "__range").agg(F.sum("__c").alias("__m"))
    whole = Window.partitionBy(*by)
    ranges = ranges.withColumn("n", F.sum("__m").over(whole)).withColumn("__before", F.coalesce(F.sum("__m").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wanted = ranges.withColumn("__want", F.array(*(F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items())))
    wanted = wanted.withColumn("__want", F.filter("__want", lambda w: (w["rank"] >= F.col("__before")) & (w["rank"] < F.col("__before") + F.col("__m")))).where(F.size("__want") > 0)
    w = renamed(wanted, "__w", F.col("__range").alias("__r"), "n", "__before", "__want")
    hit = counted.join(w, [*same("__w"), F.col("__r") == F.col("__range")])
    upto = Window.partitionBy(*by, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumn("__end", F.col("__before") + F.sum("__c").over(upto)).withColumn("__w", F.explode("__want"))
    found = hit.where((F.col("__w.rank") < F.col("__end")) & (F.col("__w.rank") >= F.col("__end") - F.col("__c")))
    return found.groupBy(*by, "n").agg(*(F.max(F.when(F.col("__w.name") == k, F.col("__v"))).alias(k) for k in ranks))
