import math
import zlib

import numpy as np
import pytest

from optara.llm import quality, queries


def test_ordered_grades_are_learned():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(600):
        g = int(rng.integers(0, 3))
        words = ["good"] * (2 + 6 * g) + ["bad!!"] * (14 - 6 * g)
        rng.shuffle(words)
        rows.append((" ".join(words).encode(), g))
    model = quality.train([quality.features(t) for t, _ in rows], np.array([g for _, g in rows]), 3)
    assert model.thresholds[0] < model.thresholds[1]
    got = [1 - quality.Model.tails(model, float(model.weights[c] @ v)) for c, v in (quality.features(t) for t, _ in rows)]
    picked = [int((1 - g > 0.5).sum()) for g in got]
    assert np.mean([p == g for p, (_, g) in zip(picked, rows, strict=True)]) > 0.9


def test_awkward_rows(spark, awkward, empty):
    rows = spark.createDataFrame([("good text here", 1, 1), ("BAD!! BAD!!", 0, 2), (None, 1, 3), ("x", None, 4)] * 5, "text string, grade int, doc_id long")
    model = quality.fit(rows, rows.select("doc_id", "grade"))
    got = quality.grade(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r["tail_probability"] <= 1 for r in got)
    assert quality.grade(empty, model).count() == 0
    none = quality.fit(awkward, spark.createDataFrame([], "doc_id long, grade int"))
    assert {r["expected_grade"] for r in quality.grade(awkward, none).collect()} == {0.0}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op9_quality(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, poor = [r for r in got if r["quality"]], [r for r in got if not r["quality"]]
    assert sum(r["selected"] for r in good) / len(good) > 0.97
    assert sum(not r["selected"] for r in poor) / len(poor) > 0.8
    assert all(0 <= r["expected_grade"] <= 2 for r in got)


def plain_features(text):
    """Roots of trigram frequencies by bucket, in plain whole numbers, of unit length."""
    b, counts = text or b"", {}
    for i in range(max(0, len(b) - 2)) if len(b) > 2 else range(len(b)):
        if len(b) > 2:
            h = ((b[i] * 0x9E3779B1) ^ (b[i + 1] * 0x85EBCA6B) ^ (b[i + 2] * 0xC2B2AE35)) & 0xFFFFFFFF
        else:
            h = b[i] * 0x27D4EB2F & 0xFFFFFFFF
        at = (h * 0x2C1B3C6D & 0xFFFFFFFF) >> 16
        counts[at] = counts.get(at, 0) + 1
    words = b.split()
    again = sum(x == y for x, y in zip(words, words[1:], strict=False))
    if again:
        counts[0] = counts.get(0, 0) + 8 * again
    total = sum(counts.values())
    return {k: math.sqrt(v / total) for k, v in counts.items()}


def plain_loss(p, rows, grades):
    """Mean negative log-likelihood of the cumulative-link model, with the ridge."""
    theta = [p[quality.BUCKETS]]
    for g in p[quality.BUCKETS + 1 :]:
        theta.append(theta[-1] + math.exp(g))
    total = 0.0
    for x, y in rows:
        f = sum(p[k] * v for k, v in x.items())
        cum = [0.0, *(1 / (1 + math.exp(f - t)) for t in theta), 1.0]
        total -= math.log(max(1e-12, cum[y + 1] - cum[y]))
    return total / len(rows) + quality.RIDGE / 2 * sum(v * v for v in p[: quality.BUCKETS])


def test_gradient_and_fit_against_plain_loss():
    rng = np.random.default_rng(3)
    texts = [("good words here " * int(rng.integers(1, 5)) + "bad!! " * int(rng.integers(0, 4)) * (3 - g)).encode() for g in range(3) for _ in range(15)]
    y = np.repeat(np.arange(3), 15)
    rows = [(plain_features(t), int(g)) for t, g in zip(texts, y, strict=True)]
    made = [quality.features(t) for t in texts]
    assert all(dict(zip(a.tolist(), v.tolist(), strict=True)) == pytest.approx(x) for (a, v), (x, _) in zip(made, rows, strict=True))
    col, val, own = np.concatenate([a for a, _ in made]), np.concatenate([v for _, v in made]), np.repeat(np.arange(45), [len(a) for a, _ in made])
    p = np.zeros(quality.BUCKETS + 2)
    p[col] = rng.normal(size=len(col))
    p[quality.BUCKETS :] = (-0.4, 0.3)
    loss, g = quality.slopes(p, y, own, col, val, 3)
    assert loss == pytest.approx(plain_loss(p, rows, 3))
    for k in [*np.unique(col)[:6].tolist(), quality.BUCKETS, quality.BUCKETS + 1]:
        up, down = p.copy(), p.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert g[k] == pytest.approx((plain_loss(up, rows, 3) - plain_loss(down, rows, 3)) / 2e-5, abs=1e-6)
    model = quality.train(made, y, 3)
    best = np.concatenate([model.weights.astype(float), model.thresholds[:1], np.log(np.diff(model.thresholds))])
    fitted = plain_loss(best, rows, 3)
    assert fitted < plain_loss(np.zeros_like(best), rows, 3) and all(fitted < plain_loss(best * (1 - f), rows, 3) for f in (0.3, 0.6))


def test_query_matches_plain_scoring(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = queries.quality_model(docs, labels)
    got = {r["doc_id"]: r for r in queries.op9_quality(spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        f = sum(float(model.weights[k]) * v for k, v in plain_features(r["text"].encode()).items())
        tails = [1 / (1 + math.exp(t - f)) for t in model.thresholds]
        g = got[r["doc_id"]]
        assert (g["expected_grade"], g["tail_probability"]) == (pytest.approx(sum(tails), abs=1e-5), pytest.approx(tails[0], abs=1e-5)) and g["selected"] == (g["tail_probability"] >= 0.5)
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_sample_is_bounded_in_features(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"text number {i} " * 5, i % 2) for i in range(60)], "doc_id long, text string, grade int")
    monkeypatch.setattr(quality, "MAX_FEATURES", 300)
    few = quality.fit(rows, rows.select("doc_id", "grade"))
    assert 0 < np.count_nonzero(few.weights) <= 300
    monkeypatch.setattr(quality, "MAX_FEATURES", 0)
    assert quality.fit(rows, rows.select("doc_id", "grade")).thresholds.shape == (0,)
