import hashlib
import random

import pytest

from optara.llm import bpe
from optara.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.load(tokenizer_path())


@pytest.mark.parametrize("leaf,window", [(16, 2), (64, 3), (2048, 32)])
def test_tree_equals_library(tokenizer, leaf, window):
    e, rng = bpe.Encoder(tokenizer_path(), leaf=leaf, window=window), random.Random(leaf)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ab", "a", "aeinth", "éöüa日本ñ", "0123456789", "!?.'-", "ab1!é'", "ABCé̀", "  x"]
    for k in range(400):
        s = "".join(rng.choice(alphabets[k % len(alphabets)]) for _ in range(rng.choice([5, 17, 40, 100, 400, 1500, 5000])))
        if k % 9 == 0:
            s = s[:30] + "<|endoftext|>" + s[30:]
        assert e.piece(s) == tokenizer.encode(s, add_special_tokens=False).ids


def check(rows, tokenizer):
    for r, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_documents_equal_library(documents, tokenizer):
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    check([(r, text[r["doc_id"]]) for r in bpe.encode(documents, tokenizer_path()).collect()], tokenizer)


def test_awkward_rows(spark, awkward, empty, tokenizer):
    rows = awkward.where("doc_id is not null").collect()
    extra = ["<|startoftext|> a<|endoftext|>b", "it's we'll 'S", "x\x1cy\x85z w　v", "퟿\U0001f600" * 3000, "é ́x", "ABC" * 3000]
    text = {r["doc_id"]: r["text"] for r in rows} | {100 + i: t for i, t in enumerate(extra)}
    df = awkward.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    got = bpe.encode(df, tokenizer_path(), with_ids=True).collect()
    assert len(got) == df.count()
    check([(r, text[r["doc_id"]]) for r in got if r["doc_id"] is not None], tokenizer)
    assert all(len(r["ids"]) == r["n_tokens"] for r in got) and bpe.encode(empty, tokenizer_path()).count() == 0


def test_caches_are_bounded_in_characters():
    recent = bpe.Recent(1000, chars=800)
    for i in range(500):
        recent.put(f"k{i}", (1, "1", "x" * (i % 90)))
        assert sum(len(k) + len(v[1]) + len(v[2]) for d in (recent, recent.old) for k, v in d.items()) <= 1600
    recent.put("long", (1, "1", "x" * 200))
    assert recent.find("long") is None and recent.find("k499") is not None


def test_words_of_a_megabyte(spark):
    """Very long words one after another: results are whole, and nothing of them is remembered."""
    own = bpe.Encoder(tokenizer_path())
    for i in range(6):
        word = "".join(chr(97 + (i + j * j) % 26) for j in range(1 << 20))
        n, ids, decoded = own.text(f"a {word} b")
        assert n > 1000 and len(ids.split()) == n and decoded == own.tokenizer.decode(list(map(int, ids.split())), skip_special_tokens=False) and decoded.replace(" ", "").replace("</w>", "") == f"a{word}b"
    assert sum(len(k) for d in (own.pieces, own.pieces.old, own.words, own.words.old) for k in d) < 1 << 20
