"""Synthetic decision rows of rising difficulty, from keyed randomness: the same rows under any partitioning.

All numbers of a row come from SHA-256 digests cut into eight 32-bit numbers: one digest for the row, one for each attempt at
acceptable values, and one for each option of an attempt, which holds the option's seven values. An attempt computes only the values
that its question asks for; all seven are computed for the accepted attempt. Attempts are tried in blocks, the next
one only where none was accepted so far, in one expression: making rows is a single pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words as W
from ..functions.exact import choose, fmt_plain, fmt_plain_all, let, round1
from . import pick

# Shares of capped rows and of sodium on cards, and option counts by rung.
CAPPED_SHARE, SODIUM_SHARE = 0.6, 0.5
KINDS = {"r0-most": (2,), "r1-pair": (2,), "r2-panel": (2, 3, 4), "r3-units": (3, 4, 5), "r4-constraints": (3, 4, 5)}
BLOCKS = (8, 24, 96, 384, 1536)  # attempts tried at once
GRAMS = tuple(n for n in W.NUTRIENTS if n != "energy")


def digest(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by slashes, in hex."""
    return F.sha2(F.encode(F.concat_ws("/", *(p if isinstance(p, Column) else F.lit(p) for p in parts)), "UTF-8"), 256)


def word(of: Column, n: int | Column) -> Column:
    """The n-th of a digest's eight 32-bit numbers."""
    at = F.lit(8 * n + 1) if isinstance(n, int) else n * 8 + 1
    return F.conv(F.substring(of, at, F.lit(8)), 16, 10).cast("bigint")


def part(of: Column, n: int | Column) -> Column:
    """The n-th number of a digest, in [0, 1)."""
    return word(of, n) / F.lit(4294967296.0)


def value(of: Column, n: int | Column) -> Column:
    """Value of the n-th nutrient in an option's digest: whole for energy and for every second of the others, else in tenths."""
    low, high = (F.array(*(F.lit(float(W.RANGES[x][side])) for x in W.NUTRIENTS)) for side in (0, 1))
    i = F.lit(n) if isinstance(n, int) else n
    flags = word(of, 7)
    odd = F.floor(flags / F.pow(F.lit(2.0), i)) % 2 == 1
    return let(F.get(low, i) + (F.get(high, i) - F.get(low, i)) * part(of, n), lambda v: F.when((i == 0) | ~odd, F.rint(v)).otherwise(round1(v)))


def _options(s: Column, attempt: Column, k: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: digest(s, attempt.cast("string"), i.cast("string")))


def _tried(row, attempt: Column) -> Column:
    """What an attempt gives: struct (asked, cap, limit, within, gold, good)."""
    options = _options(row["s"], attempt, row["k"])
    grams = F.array(*(F.lit(1 + i) for i in range(len(GRAMS))))  # positions among all nutrients

    def chosen(h: Column) -> Column:
        first, second = F.floor(part(h, 0) * len(GRAMS)).cast("int"), F.floor(part(h, 1) * (len(GRAMS) - 1)).cast("int")
        other = F.get(grams, F.when(second >= first, second + 1).otherwise(second))
        return F.struct(F.when(row["capped"], F.get(grams, first)).alias("cap"), F.when(row["capped"], other).otherwise(row["target"]).alias("asked"), part(h, 2).alias("u"))

    def valued(c: Column) -> Column:
        values = let(options, lambda o: F.struct(F.transform(o, lambda h: value(h, c["asked"])).alias("v"), F.when(row["capped"], F.transform(o, lambda h: value(h, c["cap"]))).alias("c")))
        return let(values, lambda x: limited(c, x))

    def limited(c: Column, x: Column) -> Column:
        limit = let(F.sort_array(x["c"]), lambda r: F.get(r, F.lit(1)) + (F.array_max(r) - F.get(r, F.lit(1))) * c["u"])
        return let(F.struct(F.when(row["capped"], round1(limit)).alias("limit")), lambda b: settled(c, x, b["limit"]))

    def settled(c: Column, x: Column, limit: Column) -> Column:
        within = F.when(row["capped"], pick.allowed(x["c"], limit)).otherwise(F.sequence(F.lit(0), row["k"] - 1))
        return let(within, lambda w: let(F.transform(w, lambda i: F.get(x["v"], i)), lambda v: let(pick.first_extreme(v, row["most"]), lambda best: judged(c, x, limit, w, v, best))))

    def judged(c: Column, x: Column, limit: Column, within: Column, v: Column, best: Column) -> Column:
        gold = F.get(within, best.cast("int"))
        clear = ~F.exists(x["c"], lambda y: F.abs(y - limit) <= F.greatest(F.lit(0.1) * limit, F.lit(0.2)))
        some = (F.size(within) >= 2) & (F.size(within) < row["k"])
        caps = F.when(row["capped"], clear & some & pick.trap(x["v"], within, gold, row["most"])).otherwise(F.lit(True))
        good = F.coalesce(gold.isNotNull() & caps & pick.separated(v, best), F.lit(False))
        return F.struct(attempt.alias("attempt"), c["asked"].alias("asked"), c["cap"].alias("cap"), limit.alias("limit"), gold.alias("gold"), good.alias("good"))

    return let(let(digest(row["s"], attempt.cast("string")), chosen), valued)


def _found(row) -> Column:
    """The first acceptable attempt; a block is computed only where the blocks before it hold none."""
    ends = [sum(BLOCKS[: i + 1]) for i in range(len(BLOCKS))]
    blocks = F.array(*(F.struct(F.lit(e - n).alias("first"), F.lit(e - 1).alias("last")) for e, n in zip(ends, BLOCKS, strict=True)))
    kind = "struct<attempt:int,asked:int,cap:int,limit:double,gold:int,good:boolean>"
    tried = lambda b: F.transform(F.sequence(b["first"], b["last"]), lambda a: _tried(row, a).cast(kind))
    first = lambda b: F.get(F.filter(tried(b), lambda t: t["good"]), F.lit(0))
    return F.aggregate(blocks, F.lit(None).cast(kind), lambda found, b: F.coalesce(found, first(b)))


def rows(rungs: DataFrame, seed: int) -> DataFrame:
    """Decision rows from (index, rung): texts, question and gold are functions of seed, rung and index alone."""
    base = rungs.select("rung", "index", F.concat_ws("-", "rung", F.col("index").cast("string")).alias("id")).withColumn("s", F.concat_ws("/", F.lit(str(seed)), "id"))
    base = base.withColumn("h", digest(F.col("s")))
    one = lambda n: part(F.col("h"), n)
    k = F.lit(None).cast("int")
    for rung, sizes in KINDS.items():
        k = F.when(F.col("rung") == rung, choose(list(sizes), one(4))).otherwise(k)
    base = base.select(
        "rung", "id", "s", F.when(one(0) < 0.5, "en").otherwise("es").alias("lang"), one(1).alias("u_item"), ((F.col("rung") == "r0-most") | (one(2) < 0.5)).alias("most"),
        F.floor(one(3) * len(W.NUTRIENTS)).cast("int").alias("target"), k.alias("k"), ((F.col("rung") == "r4-constraints") & (one(5) < CAPPED_SHARE)).alias("capped"), one(6).alias("u_template"),
    )
    found = base.withColumn("found", _found({c: F.col(c) for c in base.columns}))
    return _render(found.withColumn("found", F.when(F.col("found").isNull(), F.raise_error(F.concat(F.col("id"), F.lit(" found no acceptable values")))).otherwise(F.col("found"))))


def _render(found: DataFrame) -> DataFrame:
    most = F.when(F.col("most"), "max").otherwise("min")
    names = F.array(*(F.lit(n) for n in W.NUTRIENTS))
    of = lambda table, key: X.by_language(F.col("lang"), lambda c: F.create_map(*(F.lit(x) for kv in table[c].items() for x in kv))[key])
    item = X.by_language(F.col("lang"), lambda c: choose(list(W.ITEMS[c]), F.col("u_item")))
    # A filter or a second use of found would repeat what it is made of: panels are bound to it in the same row first.
    found = found.select("rung", "id", "s", "lang", "most", "capped", "k", "u_template", item.alias("item"), "found")
    found = found.select("*", F.get(names, F.col("found.asked")).alias("asked"), F.get(names, F.col("found.cap")).alias("cap_name"))
    pair, named = F.col("rung").isin("r0-most", "r1-pair"), F.col("rung").isin("r3-units", "r4-constraints")

    def text(h: Column, i: Column) -> Column:
        short = F.concat(of(W.PRINTED, F.col("asked")), F.lit(" "), let(value(h, F.col("found.asked")), fmt_plain), F.when(F.col("asked") == "energy", " kcal").otherwise(" g"))
        return F.when(pair, short).otherwise(let(F.array(*(value(h, n) for n in range(len(W.NUTRIENTS)))), lambda v: let(digest(F.col("s"), "card", i.cast("string")), lambda c: full(v, c))))

    def full(values: Column, c: Column) -> Column:
        numbers = F.concat(fmt_plain_all(values), F.array(F.rint(F.get(values, F.lit(6)) * F.lit(400.0)).cast("bigint").cast("string")))
        body = let(numbers, lambda n: X.panel_text(n, F.col("lang"), named & (part(c, 2) < SODIUM_SHARE)))
        name = F.concat(choose(list(W.BRANDS), part(c, 0)), F.lit(" · "), X.capitalize(F.col("item")), F.lit(" "), (F.floor(part(c, 1) * 99) + 1).cast("string"))
        return F.when(named, F.concat(name, F.lit(". "), body)).otherwise(body)

    asked = of(W.RUNG_ASKED, F.col("asked"))
    plain = F.lit(None).cast("string")
    for side in ("max", "min"):
        plain = F.when(most == side, X.by_language(F.col("lang"), lambda c, side=side: choose(list(W.RUNG_EXTREME[c][side]), F.col("u_template")))).otherwise(plain)
    capped = X.fill(X.by_language(F.col("lang"), lambda c: F.lit(W.CAPPED[c][0])), limit=fmt_plain(F.col("found.limit")), c=of(W.RUNG_ASKED, F.col("cap_name")), dir=of(W.RUNG_DIRECTION, most), a=asked)
    options = _options(F.col("s"), F.col("found.attempt"), F.col("k"))
    return found.select(
        "id", X.fill(X.by_language(F.col("lang"), lambda c: F.lit(W.STATE[c])), cat=F.col("item")).alias("state"), F.when(F.col("capped"), capped).otherwise(X.fill(plain, a=asked)).alias("question"),
        F.transform(F.transform(options, text), lambda t, i: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("id"), t.alias("text"))).alias("candidates"),
        F.concat(F.lit("c"), F.col("found.gold").cast("string")).alias("answer"), "lang", F.lit("product_specs").alias("capability"), F.concat(F.lit("curriculum:"), F.col("rung")).alias("origin"),
    )


def mixed(indices: DataFrame, rung: str, seed: int, replay: float = 0.0) -> DataFrame:
    """Rows of a rung for a column index; a share of them, replay, comes from earlier rungs (from all rungs for a rung that isn't synthetic)."""
    earlier = list(W.RUNGS[: W.RUNGS.index(rung)]) if rung in W.RUNGS else list(W.RUNGS)
    source = F.lit(rung)
    if earlier and replay:
        h = digest(str(seed), "replay", F.col("index").cast("string"))
        source = F.when(part(h, 0) < replay, choose(earlier, part(h, 1))).otherwise(source)
    return rows(indices.select("index", source.alias("rung")), seed)


def batch(spark: SparkSession, rung: str, n: int, seed: int, replay: float = 0.0) -> DataFrame:
    """n rows of a rung, mixed with earlier ones."""
    return mixed(spark.range(n).select((F.col("id") + seed * 1_000_000).alias("index")), rung, seed, replay)
