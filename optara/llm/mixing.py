"""Mix sources to target weights: hash-random keys, a range sort within each source, prefix sums, exact cuts.

Every document gets the key md5(seed, id), uniform over its source; of rows that share an id or have none, all but the first by
source and size get the md5 of that key and their place. Since the keys are uniform, equal-width
ranges of the key space are balanced splitters known beforehand: each source is cut into as many ranges as
its rows need, sums per range give the ranges' offsets, and a running sum inside a range gives every
document's prefix. No task holds a whole source. A budget of b words over a source of s words is b div s
whole epochs and, of the last epoch, the documents whose prefix lies below the rest; the one document on
the cut gives the words up to it, so that each source meets its budget exactly.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size 0
take nothing; repeated rows get interchangeable results; an empty
table gives an empty result; columns of the input whose names clash with results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import row_numbers
from .common import ROW, WORD, materialize, numbered, with_groups

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
RANGE_ROWS = 4_000  # rows of a source in one key range, about


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """From (source, source_size), one row per source: target double and budget long.

    Sources in code-point order, null last, weigh as listed, repeating. Water filling in closed form: by rising
    cap per weight, sources are full while their cap is below their share of what is left over for them.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    level = (F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    return (
        sources.withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("level", level.cast("double"))
        .withColumn("level", F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(total))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))))
        .select("source", "source_size", "target", F.least(F.col("cap"), F.floor(F.col("target") + 0.5)).alias("budget"))
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix", range_rows: int = RANGE_ROWS, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: key, size, source_size, target, taken (words, repeats counted), epochs taken whole, source, and the columns of also."""
    rows = materialize(docs.select(*also, F.col(key).alias("id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null")))).alias("order")), "mix-sizes")
    rows = _spread(rows, also)
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = targets(per_source.select("source", "source_size"), weights, most).join(per_source.select(F.col("source").alias("s2"), F.ceil(F.col("n") / range_rows).alias("ranges")), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    plan = materialize(plan, "mix-plan")  # one row per source
    at = F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / 4294967296.0 * F.col("ranges")).cast("int")
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).select(rows["source"], "id", "size", "order", *also, "source_size", "target", "budget", at.alias("range"))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    offsets = sums.select("source", "range", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "range").orderBy("order", "id", "size")
    prefixed = rows.withColumn("prefix", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    o = offsets.select(F.col("source").alias("s2"), F.col("range").alias("r2"), "offset")
    placed = prefixed.join(o, prefixed["source"].eqNullSafe(o["s2"]) & (prefixed["range"] == o["r2"]))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("prefix")))
    return placed.withColumn("epochs", epochs.cast("long")).select(F.col("id").alias(key), "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "epochs", rows["source"], *also)


def _spread(rows: DataFrame, also: tuple[str, ...]) -> DataFrame:
    """rows where those after the first of an id, and of no id, have keys of their own, so that none gathers in one range."""
    repeated = materialize(rows.groupBy("order").agg(F.count("*").alias("n")).where("n > 1"), "mix-repeated")
    if repeated.isEmpty():
        return rows
    tagged = with_groups(rows, repeated, "order")
    many = row_numbers(tagged.where("n is not null").select(*rows.columns), ["order"], [F.col("source"), F.col("size"), *map(F.col, also)], "__nth")
    key = F.when(F.col("__nth") > 0, F.md5(F.concat_ws(":", "order", F.col("__nth").cast("string")))).otherwise(F.col("order"))
    return materialize(tagged.where("n is null").select(*rows.columns).unionByName(many.withColumn("order", key).drop("__nth")), "mix-keys")


def take(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs as their mix takes them, ids repeated or null as they may be: rows are numbered, and each gets its own result."""
    rows = numbered(docs)
    return _cut(rows, mix(rows, key, text, source, also=(ROW,)).select(ROW, "size", "taken"), text).select(*docs.columns)


def apply(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs as the mix takes them: a row per epoch, the last one cut after the words taken.

    Rows that share id, source and size are interchangeable, and each gets one of the mix's results for them.
    """
    rows = numbered(docs)
    same = ["__id", "__source", "__size"]
    own = row_numbers(rows.select(ROW, F.col(key).alias("__id"), F.col(source).alias("__source"), size_of(F.col(text)).alias("__size")), same, [F.col(ROW)], "__nth")
    results = row_numbers(mixed.select(F.col(key).alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("taken")), same, [F.col("taken")], "__nth")
    results = results.select(F.col("__id").alias("i"), F.col("__source").alias("s"), F.col("__size").alias("size"), F.col("__nth").alias("n"), "taken")
    paired = own.join(results, own["__id"].eqNullSafe(results["i"]) & own["__source"].eqNullSafe(results["s"]) & (own["__size"] == results["size"]) & (own["__nth"] == results["n"]))
    return _cut(rows, paired.select(ROW, "size", "taken"), text).select(*docs.columns)


def _cut(rows: DataFrame, results: DataFrame, text: str) -> DataFrame:
    """Numbered rows with results (ROW, size, taken) as often as taken, the last time cut."""
    m = results.select(F.col(ROW).alias("__id"), F.col("size").alias("__size"), F.col("taken").alias("__taken")).where("__taken > 0")
    joined = rows.join(m, rows[ROW] == m["__id"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("__taken") / F.col("__size")).cast("int"))))
    left = F.col("__taken") - (F.col("__copy") - 1) * F.col("__size")
    # Each piece is a word with the white space before it, so that the pieces' start is the text's start.
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"([\x20\x09-\x0D]*" + WORD + ")"), F.lit(1))
    out = joined.withColumn(text, F.when(left >= F.col("__size"), F.col(text)).otherwise(F.array_join(F.slice(pieces, 1, left.cast("int")), "")))
    if "n_chars" in rows.columns:
        out = out.withColumn("n_chars", F.when(left >= F.col("__size"), F.col("n_chars")).otherwise(F.length(text)).cast(rows.schema["n_chars"].dataType))
    return out
