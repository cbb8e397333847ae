"""Scoring answers: accuracy, cells, chance, latency, and the ranked report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import let, percent, wilson_lower
from .ranks import at_ranks

# Cells of the report in its order.
CELLS = ("difficulty:extreme", "difficulty:constrained", "options:3", "options:4", "options:5", "units:salt_g", "units:sodium_mg", "lang:en", "lang:es")


def cell_keys(difficulty: Column, options: Column, language: Column, sodium: Column) -> Column:
    return F.array(F.concat(F.lit("difficulty:"), F.split(difficulty, r"\+")[0]), F.concat(F.lit("options:"), options.cast("string")), F.concat(F.lit("lang:"), language), F.concat(F.lit("units:"), F.when(sodium, "sodium_mg").otherwise("salt_g")))


def totals(df: DataFrame, by: list[str], choice: Column, answer: Column, decidable: Column) -> DataFrame:
    """Per group: rows, hits, accuracy, wilson_lower, decidable_rows, decidable_accuracy and unparsed; a null choice is wrong."""
    hit = F.coalesce(choice == answer, F.lit(False))
    ok = F.coalesce(decidable, F.lit(True))
    out = df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(hit).alias("hits"), F.count_if(ok).alias("decidable_rows"), F.count_if(ok & hit).alias("decidable_hits"), F.count_if(choice.isNull()).alias("unparsed"))
    return (
        out.withColumn("accuracy", F.col("hits") / F.col("rows")).withColumn("wilson_lower", wilson_lower(F.col("hits"), F.col("rows")))
        .withColumn("decidable_accuracy", F.when(F.col("decidable_rows") > 0, F.try_divide("decidable_hits", "decidable_rows"))).drop("decidable_hits")
    )


def cells(df: DataFrame, by: list[str], keys: Column, hit: Column) -> DataFrame:
    """Accuracy and rows per cell key."""
    spread = df.select(*by, F.explode(keys).alias("cell"), F.coalesce(hit, F.lit(False)).alias("hit"))
    return spread.groupBy(*by, "cell").agg(F.count("*").alias("rows"), F.count_if(F.col("hit")).alias("hits")).withColumn("accuracy", F.col("hits") / F.col("rows"))


def chance(df: DataFrame, by: list[str], options: Column) -> DataFrame:
    """Accuracy of a uniform pick, 0 without rows."""
    return df.groupBy(*by).agg(F.coalesce(F.avg(F.lit(1.0) / options), F.lit(0.0)).alias("chance"))


def latency(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group n, the interpolated median, the value at position int(0.95 * (n - 1)) of the sorted values, and the mean."""
    last = F.col("n") - 1
    ranked = at_ranks(df, by, value, {"__lo": F.floor(last / 2), "__hi": F.ceil(last / 2), "p95": F.floor(F.lit(0.95) * last)})
    means = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"))
    joined = ranked.join(means.select(*(F.col(c).alias(f"__m{i}") for i, c in enumerate(by)), "mean"), [F.col(f"__m{i}").eqNullSafe(F.col(c)) for i, c in enumerate(by)] or F.lit(True))
    return joined.select(*by, "n", ((F.col("__lo") + F.col("__hi")) / F.lit(2.0)).alias("p50"), "p95", "mean")


def label(name: Column, kind: Column, device: Column) -> Column:
    return F.when(kind == "own", F.concat(name, F.lit(" ("), device, F.lit(")"))).when(kind == "ollama-chat", F.concat(name, F.lit(", zero-shot"))).otherwise(name)


def leaderboard(results: DataFrame) -> DataFrame:
    """Ranked rows (rank, line) from (label, rows, accuracy, wilson_lower, decidable_accuracy, p50, p95): best first, then by label."""
    number = lambda c: F.format_string("%.1f", F.col(c))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("label"), F.col("rows").cast("string"), percent(F.col("accuracy")), percent(F.col("wilson_lower")), percent(F.col("decidable_accuracy")), number("p50"), number("p95")), F.lit(" |"))
    return results.select(F.row_number().over(Window.orderBy(F.col("accuracy").desc(), "label")).alias("rank"), line.alias("line"))


def softmax_choice(logits: Column, options: Column) -> Column:
    """Probabilities over the first options logits (what follows, such as `unknown`, is left out) and the best position."""

    def of(kept: Column) -> Column:
        top = let(F.array_max(kept), lambda t: F.struct((F.array_position(kept, t) - 1).cast("long").alias("choice"), F.transform(kept, lambda x: F.exp(x - t)).alias("e")))
        return let(top, lambda t: let(F.aggregate(t["e"], F.lit(0.0), lambda a, x: a + x), lambda total: F.struct(F.transform(t["e"], lambda x: F.round(x / total, 6)).alias("probabilities"), t["choice"].alias("choice"))))

    return let(F.slice(logits, 1, options), of)


def masked_mean(vectors: Column, mask: Column, width: int) -> Column:
    """Mean of the vectors where the mask holds, zeros if nowhere; an array of width doubles."""
    zero = F.array_repeat(F.lit(0.0), width)

    def of(kept: Column) -> Column:
        n = F.greatest(F.size(kept), F.lit(1))
        return F.transform(F.aggregate(kept, zero, lambda acc, x: F.zip_with(acc, x["v"], lambda a, b: a + b)), lambda s: s / n)

    return let(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"]), of)
