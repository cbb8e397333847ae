import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pytest

from optara.llm import queries, toxicity


def brute(scores):
    """Maximal scoring segments by their definition: repeatedly the best segment of what is left, within both sides."""
    out = []

    def go(lo, hi):
        best = max(((sum(scores[a:b]), -(b - a), -a) for a, b in itertools.combinations(range(lo, hi + 1), 2)), default=(0,))
        if best[0] <= 0:
            return
        a = -best[2]
        b = a - best[1]
        out.append((a, b, best[0]))
        go(lo, a)
        go(b, hi)

    go(0, len(scores))
    return sorted(out)


def test_segments_match_definition():
    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.choice([-3.1, -1.3, -0.7, 0.9, 2.3, 4.1]) + rng.random() * 0.01 for _ in range(rng.randint(0, 14))]
        got = toxicity.segments(np.array(scores))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute(scores)]
        assert all(math.isclose(s, t) for (*_, s), (*_, t) in zip(got, brute(scores), strict=True))


@pytest.fixture(scope="module")
def trained(spark):
    clean = [(f"quiet words number {i} about calm weather and soft rain {i % 7}", 0, i) for i in range(120)]
    foul = [(f"quiet words number {i} you grubnik{e} and vile snarfle about rain", 1, 1000 + i) for i, e in zip(range(60), itertools.cycle(["a", "os", "ery", "te"]))]
    rows = spark.createDataFrame([*clean, *foul, (None, 0, None), ("no label", None, 5)], "text string, toxic int, doc_id long")
    return toxicity.fit(rows, rows.select("doc_id", "toxic"))


def test_words_and_stems_are_learned(trained):
    assert trained.word("snarfle") > 0 and trained.word("grubnikwyz") > 0
    assert trained.word("weather") < 0 and trained.word("unseen") < 0


def test_awkward_rows(spark, trained, awkward, empty):
    got = toxicity.score(awkward, trained).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty, trained).count() == 0 and toxicity.passages(empty, trained).count() == 0
    docs = spark.createDataFrame([(1, "soft rain " * 500 + "you grubnikos vile snarfle " + "soft rain " * 500), (2, "soft rain " * 1000), (3, None), (4, "")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.score(docs, trained).collect()}
    assert s[1] > 0.7 and s[2] < 0.3 and s[3] == s[4] < 0.3
    p = toxicity.passages(docs, trained).collect()
    assert [r["doc_id"] for r in p] == [1] and "grubnikos" in p[0]["passage"] and 999 <= p[0]["start"] <= 1002


def test_one_class_scores_nothing(spark, awkward):
    model = toxicity.fit(awkward, spark.createDataFrame([(1, 0), (1, None), (None, 1), (99, 1)], "doc_id long, toxic int"))
    assert all(r["score"] == 0 for r in toxicity.score(awkward, model).collect())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op1_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    pos, neg = [r for r in got if r["toxic"]], [r for r in got if not r["toxic"]]
    assert sum(r["predicted"] for r in pos) / len(pos) > 0.9
    assert sum(r["predicted"] for r in neg) / len(neg) < 0.01


def test_bound_keeps_the_most_telling_units(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_UNITS", 8)
    clean = [(f"quiet words number about calm weather and soft rain {i % 7}", 0, i) for i in range(120)]
    foul = [("quiet words number about calm weather vile snarfle", 1, 1000 + i) for i in range(30)]
    rows = spark.createDataFrame([*clean, *foul], "text string, toxic int, doc_id long")
    model = toxicity.fit(rows, rows.select("doc_id", "toxic"))
    assert model.word("snarfle") > 0 and model.word("vile") > 0 and model.word("weather") < 0


def test_scan_takes_linear_time():
    shapes = {"rising": [1.0, -2.0], "falling": [2.0, -1.0], "flat": [1.0, -1.0], "long": [3.0, -1.0, -1.0, -2.0, 0.5]}
    for shape in shapes.values():
        took = []
        for n in (50_000, 400_000):
            scores = np.resize(np.array(shape), n)
            began = time.process_time()
            toxicity.segments(scores)
            took.append(time.process_time() - began)
        assert took[1] < 2 and took[1] < 40 * max(took[0], 0.02)
    deep = np.concatenate([np.resize(np.array([1.0, -2.0]), 100_000), np.resize(np.array([2.0, -1.0]), 100_000)])
    began = time.process_time()
    toxicity.segments(deep)
    assert time.process_time() - began < 2


def test_tail_is_the_likeliest():
    rng = np.random.default_rng(4)
    scores, best = 1.1 + rng.exponential(0.6, 801), 5.0
    lam, k = toxicity.tail(scores, 90_000, best)
    u = sorted(scores)[400]
    over = [x - u for x in [*scores, best] if x >= u]
    likely = lambda v: (len(over) - 1) * math.log(v) - v * sum(over)
    assert likely(lam) > max(likely(lam * 1.01), likely(lam * 0.99)) and k * 90_000 * math.exp(-lam * u) == pytest.approx(len(over))
    assert toxicity.tail(np.array([]), 1000, 4.0) == (1.0, pytest.approx(math.exp(4) / 1000)) and toxicity.tail(np.array([4.0, 4.0]), 0, 4.0)[0] == 1.0


def test_e_values_count_chance_segments():
    """Texts of words drawn at random: about as many segments of a score and more as the E-value says, over all texts."""
    rng = np.random.default_rng(7)
    draw = lambda: np.where(rng.random(300) < 0.93, -toxicity.COST, rng.exponential(0.8, 300))
    found = lambda texts: np.array([v for _ in range(texts) for *_, v in toxicity.segments(draw())])
    lam, k = toxicity.tail(found(600), 600 * 300, 4.0)
    fresh = found(3000)
    for x in (1.0, 2.0, 3.0, 4.0, 5.0):
        expected, seen = k * 3000 * 300 * math.exp(-lam * x), int((fresh >= x).sum())
        assert 0.5 * expected < seen < 2 * expected, (x, expected, seen)


def test_fit_matches_brute_force(spark):
    """Counts, prior, units, calibration and scores against plain Python over the same rows."""
    rng = random.Random(12)
    common, foul = [f"plain{c}" for c in "abcdefghij"], ["vilegrub", "vilegrob", "vilegrit", "snarfling", "mocker"]
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        words = rng.choices(common, k=30) + (rng.sample(foul, 3) if toxic else rng.sample(foul, 1) * (rng.random() < 0.03))
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    t, c = Counter(), Counter()
    for _, text, toxic in rows:
        (t if toxic else c).update(set(text.split()))
    base = 100 / 400
    logit = lambda p: math.log(p / (1 - p))

    def ratio(a, b):
        return sum(2 * x * math.log(x / ((a + b) * p)) for x, p in ((a, base), (b, 1 - base)) if x)

    st, sc, sw = Counter(), Counter(), Counter()
    for w in t | c:
        for n in toxicity.STEMS:
            if len(w) >= n:
                st[w[:n]] += t[w]
                sc[w[:n]] += c[w]
                sw[w[:n]] += 1
    stems = {s for s in sw if st[s] + sc[s] >= toxicity.MIN_COUNT and sw[s] >= toxicity.MIN_WORDS}
    words = {w for w in t | c if t[w] + c[w] >= toxicity.MIN_COUNT}
    least = 2 * math.log(len(stems) + len(words))
    telling = lambda a, b: a > b and ratio(a, b) > least
    share = {s: (st[s] + 2 * base) / (st[s] + sc[s] + 2) for s in stems if telling(st[s], sc[s])}
    bound = lambda p: max(-8.0, min(8.0, logit(min(1 - 1e-9, max(1e-9, p))) - logit(base)))
    assert model.stems == pytest.approx({s: bound(p) - 1 for s, p in share.items()})
    want = {}
    for w in words:
        parent = next((share[w[:n]] for n in reversed(toxicity.STEMS) if w[:n] in share and len(w) >= n), None)
        own = (t[w] + 2 * (base if parent is None else parent)) / (t[w] + c[w] + 2)
        if telling(t[w], c[w]):
            want[w] = bound(own) - 1
        elif parent is not None and own < parent:
            want[w] = min(bound(own), 0.0) - 1
    assert model.words == pytest.approx(want) and {"snarfling", "mocker"} <= set(want) and share
    value = lambda w: want.get(w, next((bound(share[w[:n]]) - 1 for n in reversed(toxicity.STEMS) if len(w) >= n and w[:n] in share), -1.0))
    stats = []
    top = max([*want.values(), *(bound(p) - 1 for p in share.values())])
    passages, clean, n_clean = [], [], 0
    for _, text, toxic in rows:
        ws = text.split()
        v = [value(w) for w in ws]
        v = [-1.0 if x > 0 and i and ws[i] == ws[i - 1] else x for i, x in enumerate(v)]
        found = {tuple(ws[a:b]): x for a, b, x in brute(v)}
        passages.append((len(ws), sorted(found.values()), toxic))
        if not toxic:
            clean += found.values()
            n_clean += len(ws)
    u = float(np.median(clean))
    over = [x - u for x in [*clean, top] if x >= u]
    assert model.lam == pytest.approx((len(over) - 1) / sum(over)) and model.k == pytest.approx(len(over) / n_clean * math.exp(model.lam * u))
    for n, found, _ in passages:
        x = sorted((model.lam * s - math.log(model.k * n) for s in found), reverse=True)
        strong = [s for s in x if math.exp(-s) < 0.05]
        r, total = len(strong), sum(strong)
        if strong:
            stats.append(max(strong[0], total - (r - 1) * math.log(total) + math.log(math.factorial(r)) + math.log(math.factorial(r - 1))))
        else:
            stats.append(-math.log(max(1e-12, 1 - math.exp(-math.exp(-x[0])))) if x else 0.0)
    # The curve is at the optimum of its regularised likelihood, with Platt's targets.
    x, y = np.log1p(stats), np.array([float(z) for *_, z in passages])
    y = y * (y.sum() + 1) / (y.sum() + 2) + (1 - y) / (len(y) - y.sum() + 2)
    p = 1 / (1 + np.exp(-(model.slope * x + model.bias)))
    assert abs(((y - p) * x).sum() - 1e-3 * model.slope) < 1e-3 and abs((y - p).sum()) < 1e-3
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert [got[i] for i in range(400)] == pytest.approx(p.tolist(), abs=1e-9)
