import hashlib
import re
from collections import Counter

from optara.llm import mixing


def brute(rows, weights=(5, 2, 1), most=3):
    """(id, size, source_size, target, taken) by filling water step by step and cutting sorted lists."""
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    sources = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for _, x, n in docs if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), sum(size.values())
    while free:
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > most * size[s]}
        if not over:
            total = sum(weight[x] for x in free)
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: float(most * size[s]) for s in over}
        left -= sum(most * size[s] for s in over)
        free -= over
    out, nth, keyed = [], Counter(), []
    for i, x, n in sorted(docs, key=lambda d: (d[1] is not None, d[1] or "", d[2])):
        key = hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()
        keyed.append((hashlib.md5(f"{key}:{nth[i]}".encode()).hexdigest() if nth[i] else key, i, x, n))
        nth[i] += 1
    for s in sources:
        budget = min(most * size[s], int(target[s] + 0.5))
        own = sorted((key, -1 if i is None else i, n) for key, i, x, n in keyed if x == s)
        epochs, rest = divmod(budget, size[s]) if size[s] else (0, 0)
        for _, i, n in own:
            take = max(0, min(n, rest))
            rest -= take
            out.append((None if i == -1 else i, n, size[s], round(target[s], 6), epochs * n + take))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect()), key=repr)


def test_documents_match_brute_force(documents):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    assert result(mixing.mix(documents)) == brute(rows)
    assert result(mixing.mix(documents.repartition(7), range_rows=3)) == brute(rows)


def test_awkward_rows(spark, awkward, empty):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in awkward.collect()]
    assert result(mixing.mix(awkward, range_rows=2)) == brute(rows)
    assert mixing.mix(empty).count() == 0
    lone = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(lone).collect()] == [0, 0]


def test_apply_takes_exactly(documents, awkward):
    mixed = mixing.mix(documents)
    taken = mixed.agg({"taken": "sum"}).first()[0]
    out = mixing.apply(documents, mixed)
    assert out.columns == documents.columns
    assert out.select(mixing.size_of(out["text"]).alias("n")).agg({"n": "sum"}).first()[0] == taken
    once = awkward.where("doc_id <> 7")
    assert mixing.apply(once, mixing.mix(once)).columns == awkward.columns


def test_each_row_is_taken_once(spark, awkward):
    words = lambda df: df.select(mixing.size_of(df["text"]).alias("n")).agg({"n": "sum"}).first()[0]
    plan = mixing.mix(awkward)
    taken = plan.agg({"taken": "sum"}).first()[0]
    assert words(mixing.apply(awkward, plan)) == taken == words(mixing.take(awkward))
    assert mixing.take(awkward).columns == awkward.columns
    # Null and repeated ids in two sources: each source gets its own budget to the word.
    rows = [(i, f"{s} " * n, s, 1) for s in "ab" for i, n in ((None, 3), (None, 3), (None, 5), (1, 4), (1, 4), (2, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)
    budgets = {r["source"]: r["budget"] for r in mixing.targets(docs.groupBy("source").agg(mixing.F.sum(mixing.size_of(docs["text"])).alias("source_size"))).collect()}
    for got in (mixing.take(docs), mixing.apply(docs, mixing.mix(docs))):
        assert {r["source"]: r["n"] for r in got.groupBy("source").agg(mixing.F.sum(mixing.size_of(got["text"])).alias("n")).collect()} == budgets


def test_rows_without_ids_spread_over_ranges(spark):
    rows = [(None, "w " * (1 + i % 7), "a") for i in range(900)] + [(5, "v " * (1 + i % 3), "b") for i in range(300)] + [(i, "u", "a") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    assert result(mixing.mix(docs, range_rows=40)) == brute([(i, t, s) for i, t, s in rows])
    keys = mixing._spread(docs.select("doc_id", "source", mixing.size_of(docs["text"]).alias("size"), mixing.F.md5(mixing.F.coalesce(docs["doc_id"].cast("string"), mixing.F.lit("null"))).alias("order")), ())
    assert keys.select("order").distinct().count() == 1220
