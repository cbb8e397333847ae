import pytest
from pyspark.sql import functions as F

from optara.operators import relations, rows, score, scorer

EP = "state string, question string, candidates array<struct<id: string, text: string>>, answer string"


def row(df):
    return {c: F.col(c) for c in df.columns}


def test_validity_and_requests(spark):
    c = [("a", "x"), ("b", "y")]
    cases = [
        (("s", "q", c, "a"), True, None), (("", "q", c, "a"), False, "state must be non-empty text"), (("s", None, c, "a"), False, "question must be non-empty text"),
        (("s", "q", c[:1], "a"), False, "candidates must hold 2 to 26 options"), (("s", "q", None, "a"), False, "candidates must hold 2 to 26 options"), (("s", "q", [("a", "x"), ("a", "y")], "a"), False, "candidate ids must be present and unique"),
        (("s", "q", [("a", "x"), ("b", "")], "a"), False, "every candidate needs a non-empty text"), (("s", "q", c, "z"), False, None), (("s", "q", c, None), False, None), ((" ", "q", c, "a"), True, "state must be non-empty text"),
    ]
    df = spark.createDataFrame([x for x, *_ in cases], EP)
    got = df.select(rows.valid_episode(row(df)), rows.request_problem(row(df))).collect()
    assert [tuple(g) for g in got] == [(v, p) for _, v, p in cases]


@pytest.mark.parametrize("limit", [64, 300, 1536])
def test_budgets_match_plain_form(spark, limit):
    got = spark.range(0, 27).select("id", rows.budgets(F.lit(limit), F.col("id")).alias("b")).collect()
    for r in got:
        assert tuple(r["b"]) == rows.shares(limit, r["id"], rows.NUMBERS)
        q, s, o = r["b"]
        if limit == 1536:
            assert q + s + (1 + max(1, r["id"])) + o * max(1, r["id"]) <= limit


def test_layout_equals_the_models(spark):
    m = scorer.random_model(scorer.Config(max_length=300, d_model=8, n_heads=2, n_layers=1, d_ff=8, pointer_layers=1, question_slot=20, option_slot=30))
    state, question, options = "s" * 100, "q" * 30, ["a" * 10, "b" * 50, "c"]
    _, positions, spans = m.layout(state, question, options)
    got = spark.range(1).select(rows.layout(F.lit(102), F.lit(32), F.array(*(F.lit(len(o) + 2) for o in options)), 300, 20, 30).alias("l")).first()["l"]
    assert got["question_start"] == positions[spans[1].start] and list(got["option_starts"]) == [int(positions[s.start]) for s in spans[2:]]


def test_stratified_matches_plain_python(spark):
    import random

    rng = random.Random(8)
    data = [(i, rng.choice("abc"), rng.choice([1, 2, None])) for i in range(700)]
    for limit in (1, 37, 300, 699, 700, 9000):
        cells = {}
        for d in data:
            cells.setdefault(d[1:], []).append(d[0])
        want = set()
        for m in cells.values():
            share = max(1, round(len(m) * limit / len(data)))
            want |= {m[int(i * (len(m) / share))] for i in range(share)} if limit < len(data) else set(m)
        df = spark.createDataFrame(data, "id int, a string, b int").repartition(5)
        assert {r["id"] for r in relations.stratified(df, ["a", "b"], [F.col("id")], limit).collect()} == want


def test_first_of_and_history(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 2, None), (2, 9, "z"), (None, 1, "n")], "k int, pos int, v string")
    assert sorted(map(tuple, relations.first_of(df, ["k"], [F.col("pos")]).collect()), key=str) == sorted([(1, 2, None), (2, 9, "z"), (None, 1, "n")], key=str)
    h = spark.createDataFrame([("r", i, a, c) for i, (a, c) in enumerate([(0.5, False), (0.95, True), (0.95, True), (0.2, False), (0.96, True)])], "run string, cycle int, accuracy double, cleared boolean")
    h = relations.rung_index(relations.champions(h, ["run"], [F.col("cycle")], "accuracy"), ["run"], [F.col("cycle")], F.col("cleared"), 2)
    assert [(r["champion"], r["rung_index"]) for r in h.orderBy("cycle").collect()] == [(True, 0), (True, 0), (False, 1), (False, 2), (True, 2)]


def test_scores(spark):
    df = spark.createDataFrame([("s", "a", "a", True), ("s", None, "a", None), ("s", "b", "a", False), ("t", "b", "a", False)], "system string, choice string, answer string, decidable boolean")
    got = {r["system"]: r for r in score.totals(df, ["system"], F.col("choice"), F.col("answer"), F.col("decidable")).collect()}
    assert (got["s"]["rows"], got["s"]["hits"], got["s"]["decidable_rows"], got["s"]["decidable_accuracy"], got["s"]["unparsed"]) == (3, 1, 2, 0.5, 1)
    assert got["t"]["decidable_accuracy"] is None
    k = spark.createDataFrame([(4,), (2,)], "k int")
    assert score.chance(k, [], F.col("k")).first()["chance"] == 0.375 and score.chance(k.limit(0), [], F.col("k")).first()["chance"] == 0.0


def test_softmax_drops_the_last(spark):
    r = spark.range(1).select(score.softmax_choice(F.array(F.lit(1.0), F.lit(3.0), F.lit(99.0)), F.lit(2)).alias("s")).first()["s"]
    assert r["choice"] == 1 and r["probabilities"] == [0.119203, 0.880797]


def test_shuffle_keeps_options(spark):
    df = spark.range(50).select("id", F.array(*(F.lit(x) for x in "abcde")).alias("o"))
    got = df.select(rows.shuffle_options(F.col("o"), F.lit("seed"), F.col("id").cast("string")).alias("s")).collect()
    assert all(sorted(r["s"]) == list("abcde") for r in got) and len({tuple(r["s"]) for r in got}) > 20


def test_history_windows_over_one_large_key(spark):
    """One key over many ranges, with nulls, ties in the order and runs that cross ranges, against plain loops."""
    import random

    rng = random.Random(3)
    log = [("hot", i // 2, i, rng.choice([None, 1.0, 2.0, 5.0, 95.0]), rng.choice(["a", "a", "a", "b", None])) for i in range(700)] + [("cold", 1, 0, None, None), ("cold", 2, 1, 3.0, None), (None, 1, 2, 4.0, "x"), (None, 1, 3, None, "x")]
    df = spark.createDataFrame(log, "k string, t int, id int, v double, e string").repartition(5)
    order = [F.col("t"), F.col("id")]
    want = {}
    for k in ("hot", "cold", None):
        total, best, clears, island, previous = None, 0.0, 0, 0, None
        for n, (_, _, i, v, e) in enumerate(sorted((r for r in log if r[0] == k), key=lambda r: (r[1], r[2]))):
            total = v if total is None else total + (v or 0.0)
            island += n > 0 and e != previous
            want[i if k == "hot" else (k, i)] = (total, best, v is not None and v > best, min(clears, 5), island)
            best, clears, previous = max(best, v or 0.0), clears + (v is not None and v >= 90), e
    out = relations.running_total(df, ["k"], order, F.col("v"))
    out = relations.champions(out, ["k"], order, "v")
    out = relations.rung_index(out, ["k"], order, F.col("v") >= 90)
    out = relations.islands(out, ["k"], order, "e")
    got = {r["id"] if r["k"] == "hot" else (r["k"], r["id"]): (r["total"], r["best_before"], r["champion"], r["rung_index"], r["island"]) for r in out.collect()}
    assert got == want
