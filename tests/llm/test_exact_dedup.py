import hashlib
import re
from collections import defaultdict

import pyarrow as pa

from optara.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for n, g in groups.items():
        g.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        sha = hashlib.sha256(n.encode()).hexdigest()
        seen = False
        for _, _, i in g:
            out.append((i, g[0][2], len(g), i == g[0][2] and not seen, sha))
            seen |= i == g[0][2]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_matches_brute_force(documents):
    assert result(exact_dedup.groups(documents)) == brute([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_awkward_rows(awkward, empty):
    assert result(exact_dedup.groups(awkward)) == brute([(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert exact_dedup.groups(empty).count() == 0


def test_large_group_over_partitions(spark):
    rows = [(i, "same text" + " " * (i % 3)) for i in range(3000)] + [(10_000 + i, f"other {i % 500}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(exact_dedup.groups(df)) == brute(rows)


def _sorted(texts, sizes=None):
    """Batches of rows (key, sha, part, norm) in the order given, all with one digest."""
    at = 0
    for n in sizes or [len(texts)]:
        yield pa.RecordBatch.from_pydict({"key": list(range(at, at + n)), "sha": [b"s"] * n, "part": [0] * n, "norm": texts[at : at + n]}, schema=pa.schema([("key", pa.int64()), ("sha", pa.binary()), ("part", pa.int32()), ("norm", pa.string())]))
        at += n


def test_runs_are_told_by_texts_alone():
    """Equal digests don't make equal texts, and batches may cut runs anywhere."""
    for texts in (["a", "a", "b", "b", "b", "c"], ["a"] * 6, ["a", "b", "c", "d", "d", "d"], ["", "", "x", "x", "x", "x"]):
        for sizes in ([6], [1] * 6, [2, 3, 1], [3, 0, 3], [5, 1]):
            got = [r for b in exact_dedup._runs(_sorted(texts, sizes)) for r in b.to_pylist()]
            start = {t: texts.index(t) for t in texts}
            assert [(r["key"], r["keep"], r["size"], r["first"]) for r in got] == [(i, start[t], texts.count(t), i == start[t]) for i, t in enumerate(texts)]
            edge = (texts[0], texts[-1])
            assert [r["run"] is not None for r in got] == [t in edge for t in texts]
            assert [r["border"] for r in got] == [t if t in edge and i == start[t] else None for i, t in enumerate(texts)]
    assert list(exact_dedup._runs(_sorted([], [0]))) == []


def test_groups_across_several_partitions(spark, monkeypatch):
    """Groups that begin, fill and end partitions, with unequal texts whose beginnings agree."""
    head = "the same beginning of every text, longer than a splitter's share "
    rows = [(i, head + "A" + " " * (i % 5)) for i in range(700)] + [(1000 + i, head + f"B{i // 200}") for i in range(600)] + [(5000 + i, head + str(i)) for i in range(150)] + [(None, head + "A"), (3, head + "A"), (3, None), (4, " ")]
    for n in (1, 5, 40):
        monkeypatch.setattr(exact_dedup, "partitions", lambda spark, n=n: n)
        assert result(exact_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))) == brute(rows)


def test_ties_decide_before_the_key(spark):
    rows = [(1, "x y", 9), (2, "xy ", 4), (3, "x  y", 9), (4, "x\ty ", 2), (5, "q", None), (6, "q", 3)]
    got = exact_dedup.groups(spark.createDataFrame(rows, "row long, text string, doc_id long"), "row", ties=("doc_id",)).collect()
    assert {r["row"]: (r["keep_id"], r["group_size"]) for r in got} == {1: (4, 4), 2: (4, 4), 3: (4, 4), 4: (4, 4), 5: (6, 2), 6: (6, 2)}
    assert sorted(r["row"] for r in got if r["kept"]) == [4, 6]


def test_no_shuffle_by_group(spark, documents):
    plan = exact_dedup.groups(documents)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_the_sessions_settings_stay(spark, documents):
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    exact_dedup.groups(documents).count()
    assert before == {k: spark.conf.get(k) for k in before}
