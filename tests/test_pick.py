import random

from pyspark.sql import functions as F

from optara.functions import text as X
from optara.functions import words as W
from optara.operators import answer, pick


def py_clear(values, most, floor):
    r = sorted(range(len(values)), key=lambda i: values[i], reverse=most)
    gap = abs(values[r[0]] - values[r[1]])
    return values.index(values[r[0]]) if gap >= floor and gap >= 0.15 * max(values[r[0]], values[r[1]]) else None


def test_picks_match_plain_python(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        k = rng.choice([2, 3, 4, 5])
        rows.append((i, [round(rng.uniform(0, 20), 1) for _ in range(k)], [round(rng.uniform(0, 9), 2) for _ in range(k)], rng.random() < 0.5))
    df = spark.createDataFrame(rows, "id int, v array<double>, c array<double>, most boolean")
    df = df.withColumn("cap", pick.middle_cap(F.col("c"))).withColumn("within", pick.allowed(F.col("c"), F.col("cap")))
    got = df.select("*", pick.first_extreme(F.col("v"), F.col("most")).alias("x"), pick.clear_winner(F.col("v"), F.col("most"), 1.0).alias("w"), pick.capped_winner(F.col("v"), F.col("within"), F.col("most"), 1.0).alias("cw"), pick.separated(F.col("v"), pick.first_extreme(F.col("v"), F.col("most"))).alias("s"), pick.decidable(F.col("c"), F.col("cap")).alias("d")).collect()
    for r in got:
        v, c, k = r["v"], r["c"], len(r["v"])
        best = max if r["most"] else min
        assert r["x"] == v.index(best(v)) and r["w"] == py_clear(v, r["most"], 1.0)
        s = sorted(c)
        cap = round((s[k // 2 - 1] + s[k // 2]) / 2, 1)
        assert r["cap"] == cap and r["within"] == [i for i, x in enumerate(c) if x <= cap]
        local = [v[i] for i in r["within"]]
        w = py_clear(local, r["most"], 1.0) if len(local) > 1 else None
        assert r["cw"] == (None if w is None else r["within"][w])
        top = v[r["x"]]
        assert r["s"] == all(abs(top - x) / max(abs(top), 1e-9) >= 0.15 and abs(top - x) >= 0.2 for i, x in enumerate(v) if i != r["x"])
        assert r["d"] == all((float(f"{x:.1f}") <= float(f"{cap:.1f}")) == (x <= cap) for x in c)


def test_cards_and_reading_back(spark):
    product = {"brand": F.lit("Alba"), "name": F.lit("Energy 5 bar"), "quantity": F.lit("40 g"), "values": F.struct(*(F.lit(v).alias(n) for n, v in {"energy": 512.0, "fat": 0.25, "saturated_fat": 0.04, "sugars": 100.0, "fiber": 3.0, "proteins": 9.96, "salt": 1.3}.items())), "sodium": F.lit(0.52)}
    r = spark.range(1).select(X.card(product, F.lit("en"), F.lit(True)).alias("mg"), X.card(product, F.lit("es"), F.lit(False)).alias("es")).first()
    assert r["mg"] == "Alba · Energy 5 bar (40 g). energy 512 kcal, fat 0.2 g, of which saturates 0 g, sugars 100 g, fibre 3 g, protein 10 g, sodium 520 mg."
    assert r["es"] == "Alba · Energy 5 bar (40 g). energía 512 kcal, grasas 0.2 g, de las cuales saturadas 0 g, azúcares 100 g, fibra 3 g, proteínas 10 g, sal 1.3 g."
    p = spark.createDataFrame([(r["mg"],), (r["es"].upper(),), ("nothing",)], "t string").select(X.panel(F.col("t")).alias("p")).collect()
    assert p[0]["p"]["salt"] == 1.3 and p[0]["p"]["energy"] == 512 and p[1]["p"]["sugars"] == 100 and p[2]["p"]["fat"] is None


def test_questions(spark):
    q = ["Which product has the least saturated fat per 100 g?", "¿Qué salú tiene más sal?", "Salt must stay at or below 1.2 g per 100 g. Within that limit, which product has the lowest sugar?", "no idea", "fat saturated fat fatty FAT"]
    df = spark.createDataFrame([(x,) for x in q], "q string").select(X.language(F.col("q")).alias("l"), F.array_join(X.mentions(F.col("q"), X.language(F.col("q"))), ",").alias("m"), X.asks_least(F.col("q")).alias("least"), X.cap_of(F.col("q")).alias("cap"))
    assert [tuple(r) for r in df.collect()] == [("en", "saturated_fat", True, None), ("es", "salt", False, None), ("en", "salt,sugars", True, 1.2), ("en", "", False, None), ("en", "fat,saturated_fat,fat", False, None)]


def test_decide(spark):
    card = lambda e, s: f"X. energy {e} kcal, fat 1 g, of which saturates 0 g, sugars 2 g, fibre 3 g, protein 4 g, {s}."
    rows = [
        ("Which product has the least salt per 100 g?", [card(1, "salt 0.9 g"), card(2, "sodium 200 mg")], 1),
        ("Among the products with at most 0.6 g of salt per 100 g, which has the highest calories?", [card(900, "salt 2 g"), card(10, "salt 0.5 g"), card(20, "sodium 200 mg")], 2),
        ("Which product has the most protein?", [card(1, "salt 1 g"), card(2, "salt 1 g")], 0),
        ("Which one?", [card(1, "salt 1 g")], None),
        ("Which has the most salt?", ["blank", "also blank"], None),
        ("Which has the most energy?", [card(1, "salt 1 g")], None),
    ]
    df = spark.createDataFrame([(q, t) for q, t, _ in rows], "q string, t array<string>")
    assert [r[0] for r in df.select(answer.decide(F.col("q"), F.col("t"))).collect()] == [w for *_, w in rows]


def test_letters_and_slugs(spark):
    df = spark.createDataFrame([(" b. ",), ("The answer is C",), ("Z",), ("none",), ("AB",)], "t string")
    assert [r[0] for r in df.select(X.letter_choice(F.col("t"), F.lit(3))).collect()] == [1, 2, None, None, None]
    r = spark.range(1).select(X.slug(F.lit("Plant Based Foods")), X.capitalize(F.lit("proteína Alta"))).first()
    assert tuple(r) == ("plant_based_foods", "Proteína alta") and len(W.NUTRIENTS) == 7
