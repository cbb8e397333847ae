import random
import re

import numpy as np
import pytest

from optara.llm import minhash
from optara.llm.components import components


def brute(rows, percent):
    """component_id by all pairs of full shingle sets."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_documents_match_brute_force(documents, percent):
    want = brute([(r["doc_id"], r["text"]) for r in documents.collect()], percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.groups(documents, percent=percent).collect()}
    assert got == want


def test_large_groups_in_blocks(spark, monkeypatch):
    """One chain-like group far beyond a block, with buckets and clusters cut in pieces."""
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(140)]
    rows = []
    for i in range(400):
        if i % 40 == 0:
            base = base[:]
            for _ in range(3):
                base[rng.randrange(140)] = f"w{rng.randint(0, 10**6)}"
        t = base[:]
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(140)] = f"w{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(t)))
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(minhash, "CLUSTER_BLOCK", 24)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert got == brute(rows, 85)


def test_star_estimate_equals_the_tasks(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(-(2**63), 2**63 - 1, (50, 6))
    b = np.where(rng.random((50, 6)) < 0.5, a, a ^ rng.integers(0, 2**20, (50, 6)))
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, a array<long>, b array<long>")
    got = [r["d"] for r in df.orderBy("i").select(minhash.unequal(df["a"], df["b"]).alias("d")).collect()]
    for least in (0.3, 0.61, 0.66, 0.8):
        assert [d <= minhash.most_unequal(least) for d in got] == (minhash.estimate(a.view(np.uint64), b.view(np.uint64)) >= least).tolist()


def test_many_texts_under_one_id(spark):
    """More unequal but similar texts of one id than any packed pair of numbers would hold, in one bucket."""
    base = [f"w{i}" for i in range(60)]
    rows = [(7, " ".join([*base, f"x{i}"])) for i in range(5000)] + [(3, " ".join([*base, "y"])), (9, " ".join(base)), (8, "quite another text that nobody else has here")] + [(9, " ".join(base))] * 3
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert got == {(7, 3, False), (3, 3, True), (9, 3, False), (8, 8, True)}


def test_ties_decide_who_is_kept(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base), None), (2, " ".join([*base, "x"]), 4), (3, " ".join([*base, "y"]), 2), (4, " ".join([*base, "y"]), 2), (5, "alone here", None), (6, None, 1)]
    got = {r["row"]: (r["component_id"], r["kept"]) for r in minhash.groups(spark.createDataFrame(rows, "row long, text string, doc_id long"), key="row", ties=("doc_id",)).collect()}
    assert got == {1: (1, False), 2: (1, False), 3: (1, True), 4: (1, False), 5: (5, True), 6: (6, True)}


def test_awkward_rows(awkward, empty):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.groups(awkward).collect()]
    by = {g[0]: g for g in got}
    assert len(got) == awkward.count() and got.count((7, 1, 6, False)) == 2
    assert by[1] == (1, 3, 1, True) and by[2] == (2, 3, 1, False)
    for i in (3, 4, 5):
        assert by[i] == (i, 0, i, True)
    assert by[9][2] == 8 and by[10] == (10, 1, 10, True) and by[None] == (None, 1, None, True)
    assert minhash.groups(empty).count() == 0


def test_estimate_is_corrected():
    rng = np.random.default_rng(1)
    errors = []
    for j in (0.0, 0.3, 0.6, 0.85, 1.0):
        for _ in range(20):
            common = rng.integers(0, 2**63, int(600 * j), dtype=np.uint64)
            sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, (600 - len(common)) // 2, dtype=np.uint64)])) for _ in range(2)]
            true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
            a, b = (minhash.pack(minhash.minima(s)).view(np.uint64) for s in sets)
            errors.append(minhash.estimate(a[None], b[None])[0] - true)
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.2


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(50)] + [(7, 7)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    for small in (0, 30, 10**6):
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), small).collect()}
        assert got == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
