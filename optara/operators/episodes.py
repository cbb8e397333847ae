"""Real decision rows from pools of products: keyed draws, optional caps, printed cards, decidability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words as W
from ..functions.exact import choose, draw, field, fmt, let, printed
from . import pick, relations
from .rows import valid_episode

SIZES = (3, 4, 4, 5)
CAP_SHARE, SODIUM_SHARE = 0.6, 0.4
SMALLEST_POOL = 6
DRAWS = 32


def pools(products: DataFrame, most: int = relations.POOL_ROWS) -> DataFrame:
    """Products once per code (the first), with split and their place in (split, language, category), at most `most` each."""
    once = relations.first_of(products, ["code"], [F.col("file_pos")])
    split = once.withColumn("split", relations.split_of(F.concat(F.lit("off/"), F.col("code"))))
    at = F.row_number().over(Window.partitionBy("split", "language", "category").orderBy("file_pos"))
    return split.withColumn("place", at).where(F.col("place") <= most)


def attempts(pooled: DataFrame, per_category: int, seed: int) -> DataFrame:
    """(split, language, category, budget, attempt, key, products): twice the budget of keyed draws for each pool.

    A draw is a list of distinct places; its products come by an equi-join on pool and place, so no pool is gathered.
    """
    pool = ["split", "language", "category"]
    sizes = pooled.groupBy(*pool).agg(F.max("place").alias("n")).where(F.col("n") >= SMALLEST_POOL)
    sizes = sizes.withColumn("budget", F.when(F.col("split") == "dev", per_category).otherwise(4 * per_category))
    tries = sizes.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.col("budget") * 2 - 1)))
    tries = tries.withColumn("key", F.concat_ws("/", F.lit(str(seed)), *pool, F.col("attempt").cast("string")))
    k = choose(list(SIZES), draw(F.col("key"), "size"))
    places = F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda i: (F.floor(draw(F.col("key"), "place", i.cast("string")) * F.col("n")) + 1).cast("int"))
    tries = tries.withColumn("k", k).withColumn("places", F.slice(F.array_distinct(places), 1, F.col("k"))).where(F.size("places") == F.col("k"))
    spread = tries.select(*pool, "budget", "attempt", "key", "k", F.posexplode("places").alias("pos", "place"))
    item = F.struct("pos", F.struct("code", "name", "brand", "quantity", "group", "values", "sodium").alias("p"))
    joined = spread.join(pooled, [*pool, "place"]).groupBy(*pool, "attempt").agg(F.first("budget").alias("budget"), F.first("key").alias("key"), F.array_sort(F.collect_list(item)).alias("items"))
    return joined.withColumn("products", F.col("items.p")).drop("items")


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def _template(language: Column, table: dict, at: Column) -> Column:
    return X.by_language(language, lambda code: choose(list(table[code]), at))


def make(tries: DataFrame) -> DataFrame:
    """A row for each attempt, with accepted: it has a clear winner, cards that all differ, and is valid.

    Nothing is filtered here: a filter would be pushed below the projections and repeat all they compute.
    """
    names = list(W.COLUMNS)
    d = tries.withColumn("attr", choose(names, draw(F.col("key"), "attr"))).withColumn("most", draw(F.col("key"), "direction") >= 0.5)
    d = d.withColumn("by", F.map_from_arrays(F.array(*(F.lit(n) for n in names)), F.array(*(F.transform(F.col("products.values"), field(n)) for n in names))))
    d = d.withColumn("floor", _lookup(W.FLOORS, F.col("attr"))).withColumn("target", F.col("by")[F.col("attr")])
    d = d.withColumn("overall", pick.clear_winner(F.col("target"), F.col("most"), F.col("floor")))
    # Caps in a keyed order; the first for which both winners are clear and differ.
    order = F.transform(F.array_sort(F.transform(F.filter(F.array(*(F.lit(n) for n in names if n != "energy")), lambda n: n != F.col("attr")), lambda n: F.struct(draw(F.col("key"), "cap", n).alias("u"), n.alias("n")))), lambda s: s["n"])

    def cap(n: Column) -> Column:
        limit = F.struct(n.alias("name"), F.col("by")[n].alias("v"), pick.middle_cap(F.col("by")[n]).alias("limit"))
        return let(limit, lambda c: let(pick.allowed(c["v"], c["limit"]), lambda w: F.struct(
            c["name"].alias("name"), c["limit"].alias("limit"),
            F.when((F.size(w) >= 2) & (F.size(w) < F.size(c["v"])), pick.capped_winner(F.col("target"), w, F.col("most"), F.col("floor"))).alias("winner"))))

    d = d.withColumn("caps", F.when((draw(F.col("key"), "capped") < CAP_SHARE) & F.col("overall").isNotNull(), F.transform(order, cap)))
    d = d.withColumn("cap", F.try_element_at(F.filter("caps", lambda c: c["winner"].isNotNull() & (c["winner"] != F.col("overall"))), F.lit(1)))
    d = d.withColumn("kind", F.when(F.col("cap").isNotNull(), "constrained").otherwise("extreme")).withColumn("winner", F.coalesce("cap.winner", "overall"))
    asked = lambda n: X.by_language(F.col("language"), lambda code: _lookup(W.ASKED[code], n))
    side = F.when(F.col("most"), "max").otherwise("min")
    at = draw(F.col("key"), "template")
    plain = X.fill(F.when(F.col("most"), _template(F.col("language"), {c: W.EXTREME[c]["max"] for c in W.EXTREME}, at)).otherwise(_template(F.col("language"), {c: W.EXTREME[c]["min"] for c in W.EXTREME}, at)), a=asked(F.col("attr")))
    capped = X.fill(_template(F.col("language"), W.CAPPED, at), limit=fmt(F.col("cap.limit")), c_cap=X.capitalize(asked(F.col("cap.name"))), c=asked(F.col("cap.name")), dir=X.by_language(F.col("language"), lambda code: _lookup(W.DIRECTION[code], side)), a=asked(F.col("attr")))
    d = d.withColumn("question", F.when(F.col("kind") == "constrained", capped).otherwise(plain))
    salted = (F.col("attr") == "salt") | F.coalesce(F.col("cap.name") == "salt", F.lit(False))
    d = d.withColumn("mg", salted & (draw(F.col("key"), "sodium") < SODIUM_SHARE))
    d = d.withColumn("texts", F.transform("products", lambda p, i: X.card(p, F.col("language"), F.col("mg") & (i % 2 == 0))))

    def agrees(p: Column, i: Column) -> Column:
        value = F.create_map(*(x for n in names for x in (F.lit(n), p["values"][n])))[F.col("cap.name")]
        salt = F.col("mg") & (i % 2 == 0) & (F.col("cap.name") == "salt")
        seen = F.when(salt, printed(p["sodium"] * F.lit(1000.0)) * F.lit(2.5) / F.lit(1000.0)).otherwise(printed(value))
        return (seen <= printed(F.col("cap.limit"))) == (value <= F.col("cap.limit"))

    d = d.withColumn("decidable", (F.col("kind") == "extreme") | F.forall(F.transform("products", agrees), lambda x: F.coalesce(x, F.lit(False))))
    codes = F.array_join(F.array_sort(F.col("products.code")), "+")
    d = d.select(
        "split", "language", "category", "budget", "attempt",
        F.concat(F.lit("v3-prod-"), F.substring(F.sha2(F.encode(F.concat(codes, F.col("question")), "UTF-8"), 256), 1, 16)).alias("id"),
        X.fill(X.by_language(F.col("language"), lambda c: F.lit(W.STATE[c])), cat=F.lower("category")).alias("state"), "question",
        F.transform("texts", lambda t, i: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("id"), t.alias("text"))).alias("candidates"),
        F.concat(F.lit("c"), F.col("winner").cast("string")).alias("answer"), F.concat(F.lit("off/"), codes).alias("group_id"), F.col("language").alias("lang"),
        F.lit("product_specs").alias("capability"), F.concat(F.lit("food_"), X.slug(F.get("products", F.col("winner").cast("int"))["group"])).alias("domain"),
        F.concat(F.col("kind"), F.when(F.col("mg"), "+sodium_mg").otherwise("")).alias("difficulty"), "decidable", F.lit("off-computed").alias("origin"), F.lit("ODbL-1.0").alias("license"), F.lit("openfoodfacts").alias("source_id"),
    )
    texts = F.col("candidates.text")
    return d.withColumn("accepted", F.coalesce((F.size(F.array_distinct(texts)) == F.size(texts)) & valid_episode({c: F.col(c) for c in d.columns}), F.lit(False)))


def within_budget(made: DataFrame) -> DataFrame:
    """The first accepted attempts of each pool, up to its budget."""
    at = F.row_number().over(Window.partitionBy("split", "language", "category").orderBy(F.col("accepted").desc(), "attempt"))
    return made.withColumn("at", at).where(F.col("accepted") & (F.col("at") <= F.col("budget"))).drop("at", "budget", "attempt", "category", "language", "accepted")


def build(products: DataFrame, per_category: int = 12, seed: int = 20261015) -> DataFrame:
    """All accepted rows with split, decidable or not and sealed or not: dropping comes after every draw."""
    return within_budget(make(attempts(pools(products), per_category, seed)))


def is_publishable() -> Column:
    """Decidable training rows, and decidable development rows that aren't sealed."""
    return F.col("decidable") & ((F.col("split") == "train") | ~relations.sealed(F.col("group_id"), "v3-sealed"))


def publishable(rows: DataFrame) -> DataFrame:
    return rows.where(is_publishable())
