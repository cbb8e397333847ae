import math

import numpy as np
import pytest

from optara.llm import topk


def brute(rows, k=5, every=50):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in good:
        if i % every == 0:
            queries[i] = max(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        s = sorted((-max(-topk.LONG, min(topk.LONG, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out += [(q, n, i, -x) for n, (x, i) in enumerate(s, 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_matches_brute_force(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert result(topk.search(df, lambda c: c % 50 == 0)) == brute(rows)
    monkeypatch.setattr(topk, "SAMPLE", 30)
    assert result(topk.search(df, lambda c: c % 5 == 0, k=3, block_bytes=6000)) == brute(rows, 3, 5)


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [(200, None), (250, []), (300, [1.0, None]), (301, [float("nan")] * 6), (302, [float("inf")] * 6), (None, [1.0] * 6), (350, [2.0]), (351, [3.0]), (400, [1.0] * 6), (400, [-1.0] * 6)]
    rows += [(i, [0.5] * 6) for i in range(500, 540)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, x int")
    assert result(topk.search(df, lambda c: c % 50 == 0)) == brute(rows)
    assert topk.search(df.limit(0), lambda c: c % 50 == 0).count() == 0


def test_scores_beyond_doubles(spark):
    rows = [(0, [1e14, 3.0]), (1, [1e7, 1.0]), (2, [1e7, 1.00390625])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(topk.search(df, lambda c: c % 50 == 0)) == brute(rows)


@pytest.mark.parametrize("segments", topk.LEVELS)
def test_statistics_bound_products(segments):
    rng = np.random.default_rng(segments)
    a, b = rng.integers(-99, 99, (40, 30)).astype(float), rng.integers(-99, 99, (50, 30)).astype(float)
    assert (topk.statistics(a, segments) @ topk.statistics(b, segments).T + 1e-6 >= a @ b.T).all()


def _blocks(rng, structured):
    """Queries and vectors as whole numbers: isotropic, or smooth ones about centres whose segments differ."""
    if structured:
        centres = np.repeat(rng.normal(size=(200, 16)) * 3, 4, axis=1)
        x = centres[rng.integers(0, 200, 6000)] + rng.normal(size=(6000, 64)) * 0.2
    else:
        x = rng.normal(size=(6000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])
    return np.arange(100), x[:100], np.arange(6000), x


@pytest.mark.parametrize("structured", [False, True])
def test_bounds_prune_and_lose_nothing(structured):
    ids, q, all_ids, x = _blocks(np.random.default_rng(5), structured)
    block = topk.Block(ids, topk.compact(q), np.full(100, -np.inf), 5)
    for s in range(0, 6000, 500):
        block.take(all_ids[s : s + 500], x[s : s + 500])
    got = sorted(zip(block.at.tolist(), (-block.score).tolist(), block.found.tolist(), strict=True))
    want = []
    for i in ids.tolist():
        s = (x @ q[i]).astype(int)
        want += [(i, -int(s[j]), int(j)) for j in sorted((j for j in range(6000) if j != i), key=lambda j: (-s[j], j))[:5]]
    assert got == sorted(want)
    share = block.survived / block.compared
    print(f"structured {structured}: {share:.3f} of the pairs survive the bounds")
    assert share < (0.1 if structured else 1.0)


def test_products_are_exact():
    rng = np.random.default_rng(6)
    for top in (100, 30_000, 10**7, 2**52):
        a, b = rng.integers(-top, top, (7, 12)).astype(float), rng.integers(-top, top, (9, 12)).astype(float)
        want = np.array([[max(-topk.LONG, min(topk.LONG, sum(int(x) * int(y) for x, y in zip(u, v, strict=True)))) for v in b] for u in a])
        i, j = np.nonzero(rng.random((7, 9)) < 0.4)
        assert (topk.products(topk.compact(a), topk.compact(b)) == want).all() and (topk.products(topk.compact(a), topk.compact(b), i, j) == want[i, j]).all()


def test_wide_vectors_come_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=3000)]) for i in range(130)]
    monkeypatch.setattr(topk, "SAMPLE_BYTES", 400_000)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert result(topk.search(df, lambda c: c % 10 == 0, block_bytes=100_000)) == brute(rows, 5, 10)
