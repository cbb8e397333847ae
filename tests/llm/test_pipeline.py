import hashlib
import re

import corpus_pipeline
from optara.llm import bpe, toxicity
from optara.llm.queries import TOXIC_CUT, tokenizer_path, toxicity_model

from .test_minhash import brute as near
from .test_mixing import brute as mix


def test_stages_match_brute_force(spark, sf_dir, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "minhash_dedup", "mixing", "bpe"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = {r["doc_id"] for r in toxicity.score(documents, toxicity_model(documents, labels)).where(f"score >= {TOXIC_CUT}").collect()}
    docs = {r["doc_id"]: r for r in documents.collect() if r["doc_id"] not in bad}
    first = {}
    for i, r in docs.items():
        k, v = re.sub(r"[\x20\x09-\x0D]", "", r["text"]), (-len(r["text"]), i)
        first[k] = min(first.get(k, v), v)
    docs = {i: docs[i] for _, i in first.values()}
    comp = near([(i, r["text"]) for i, r in docs.items()], 80)
    docs = {i: r for i, r in docs.items() if comp[i][1] == i}
    tokenizer, want = bpe.load(tokenizer_path()), []
    for i, n, _, _, taken in mix([(i, r["text"], r["source"]) for i, r in docs.items()]):
        while taken > 0:
            t = docs[i]["text"]
            if taken < n:
                t = t[: [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)][taken - 1]]
            ids = tokenizer.encode(t, add_special_tokens=False).ids
            want.append((i, docs[i]["source"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
            taken -= n
    got = [(r["doc_id"], r["source"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


def test_stages_return_document_columns(spark, sf_dir, awkward):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_copies_are_dropped_by_row(spark, sf_dir, awkward):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    kept = lambda df: sorted((r["doc_id"] for r in corpus_pipeline.drop_exact_copies(spark, df.select(*columns), sf_dir).collect()), key=repr)
    # 3, 4 and 5 are blank; 6, both 7 and the null id have one text.
    assert kept(awkward) == [1, 10, 11, 2, 5, 6, 8, 9]
    assert kept(awkward.where("doc_id = 7 or doc_id is null")) == [7]
    rows = [(7, "x y"), (7, "x y"), (5, "A"), (5, "B"), (3, "A"), (None, "x y"), (None, "n"), (None, "n"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.drop_exact_copies(spark, docs, sf_dir)
    want = sorted([(7, "x y"), (5, "B"), (3, "A"), (None, "n"), (None, None)], key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == want
    blank = [(None, None)]
    near = corpus_pipeline.drop_near_copies(spark, docs.unionByName(docs.where("text is null")), sf_dir)  # blank texts are linked with nothing
    assert sorted(((r["doc_id"], r["text"]) for r in near.collect()), key=repr) == sorted(want + blank, key=repr)


def test_near_copies_are_dropped_by_row(spark, sf_dir):
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join([*words, "more"]), " ".join(f"v{i}" for i in range(60))
    rows = [(5, a), (5, b), (5, c), (9, a), (None, c), (None, b), (None, "alone in here with a null id")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()]
    assert len(got) == 3 and {i for i, _ in got} == {5, None}
    assert sorted(t[:2] for _, t in got) == ["al", "v0", "w0"] and (5, c) in got


def test_stages_take_extra_columns(spark, sf_dir, awkward):
    docs = awkward.withColumn("statistic", awkward["score"]).withColumn("n_passages", awkward["size"])
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, docs.collect()))  # a model from no labelled rows flags nothing
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert 0 < stage(spark, docs, sf_dir).count()
