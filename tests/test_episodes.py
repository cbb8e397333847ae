import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from optara.functions import words as W
from optara.operators import episodes, rows, synth, systems
from optara.plans import benchmark
from optara.plans.build import build, leaks
from optara.sources.dump import read_products
from optara.sources.files import read_jsonl, write_jsonl

HEAD = ["code", "extra", "product_name", "brands", "quantity", "countries_en", "main_category_en", "categories_en", *W.COLUMNS.values(), "sodium_100g"]


def line(code, name="Bar", brands="A,B", quantity="1 g", country="Spain", category="Snacks", categories="Snacks,Bars", sodium=None, **v):
    v = {"sugars": "1.5", "salt": "1", "fat": "2", "saturated_fat": "1", "proteins": "3", "fiber": "1", "energy": "100"} | {k: str(x) for k, x in v.items()}
    return "\t".join([code, "?", name, brands, quantity, country, category, categories, *(v[n] for n in W.COLUMNS), str(sodium if sodium is not None else float(v["salt"]) / 2.5)])


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    rng = random.Random(6)
    path = tmp_path_factory.mktemp("dump") / "products.csv.gz"
    with gzip.open(path, "wt", encoding="utf-8", newline="") as out:
        out.write("\t".join(HEAD) + "\n")
        for i in range(400):
            salt = round(rng.uniform(0, 3), 2)
            out.write(line(f"{i:013d}", f"Thing {i}", f"B{i % 7}", country=rng.choice(["Spain", "United Kingdom"]), category=f"Cat {i % 3}", categories=f"Cat {i % 3},x", sugars=round(rng.uniform(0, 40), 1), salt=salt, sodium=round(salt / 2.5, 4), fat=round(rng.uniform(0, 30), 1), saturated_fat=round(rng.uniform(0, 10), 1), proteins=round(rng.uniform(0, 25), 1), fiber=round(rng.uniform(0, 8), 1), energy=rng.randint(20, 600)) + "\n")
    return str(path)


def test_dirty_rows(spark, tmp_path):
    lines = [
        line("0000000000001", 'A "quoted name'), line("2", "  \t".strip("\t")), line("3", sugars="1.5f"), line("4", sugars="1_0"), line("5", sugars="1e1"), line("6", sugars="nan"), line("7", sugars="inf"),
        line("8", energy="0"), line("9", energy="900"), line("10", fat="100"), line("11", fat="100.01"), line("12", salt="1", sodium="0.4399"), line("13", salt="1", sodium="0.44"), line("14", salt="0", sodium="-0.01"),
        line("15", country="France"), line("16", country="France,United States,Spain"), line("17", category="en:x"), line("18", sugars="bad"), line("18", "second"), line("19", "first"), line("19", "later"), line("20", categories=""), "21\tshort", "",
        line("22", "n" * 100, "b" * 50, "q" * 30),
    ]
    path = tmp_path / "d.csv.gz"
    with gzip.open(path, "wb") as out:
        out.write(("\t".join(HEAD) + "\n" + "\n".join(lines) + "\n").encode() + line("23", "bad byte ").encode().replace(b"bad byte ", b"bad \xff byte") + b"\n")
    got = {}
    for r in episodes.pools(read_products(spark, str(path))).collect():
        got[r["code"]] = r
    assert set(got) == {"0000000000001", "4", "5", "9", "10", "12", "14", "16", "18", "19", "20", "22", "23"}
    assert got["0000000000001"]["name"] == 'A "quoted name' and got["18"]["name"] == "second" and got["19"]["name"] == "first"
    assert got["16"]["language"] == "en" and got["20"]["group"] == "Snacks" and got["4"]["values"]["sugars"] == 10 and got["14"]["sodium"] == -0.01
    assert (len(got["22"]["name"]), len(got["22"]["brand"]), len(got["22"]["quantity"])) == (80, 40, 20) and "�" in got["23"]["name"]


def test_built_rows_answer_themselves(spark, dump):
    made = episodes.build(read_products(spark, dump), 8, 5).persist()
    kinds = {r["difficulty"] for r in made.select("difficulty").distinct().collect()}
    assert {"extreme", "constrained"} <= kinds and made.count() > 100
    assert made.where(~rows.valid_episode({c: F.col(c) for c in made.columns})).count() == 0
    # Rendered, read back and decided by the rules: every decidable row gives its own gold.
    wrong = systems.rules(made).where("decidable and not coalesce(choice = answer, false)")
    assert wrong.count() == 0
    for r in made.collect():
        assert r["group_id"] == "off/" + "+".join(sorted(r["group_id"][4:].split("+"))) and re.fullmatch(r"v3-prod-[0-9a-f]{16}", r["id"])
        assert len({c["text"] for c in r["candidates"]}) == len(r["candidates"]) in (3, 4, 5)
    made.unpersist()


def test_build_is_reproducible_and_tight(spark, dump, tmp_path):
    a = build(spark, dump, str(tmp_path / "a"), 6, 1)
    b = build(spark, dump, str(tmp_path / "b"), 6, 1, partitions=5)
    assert a == b and a["train_rows"] > 0 and sum(a["by_language"].values()) == a["train_rows"] and a["products"] == 400
    read = lambda p: sorted(map(str, read_jsonl(spark, str(tmp_path / p)).collect()))
    assert read("a/train") == read("b/train") and read("a/dev-pool") == read("b/dev-pool")
    assert leaks(read_jsonl(spark, str(tmp_path / "a/train")), read_jsonl(spark, str(tmp_path / "a/dev-pool"))).first()["shared"] == 0
    other = build(spark, dump, str(tmp_path / "c"), 6, 2)
    assert read("a/train") != read("c/train") and other["train_rows"] > 0


def value_of(text, name):
    for said, scale in [(W.PRINTED[c][name], 1) for c in ("en", "es")] + ([(W.PRINTED[c]["sodium"], 2.5 / 1000) for c in ("en", "es")] if name == "salt" else []):
        if m := re.search(rf"(?:^|, |\. ){said} ([\d.]+) ", text):
            return float(m[1]) * scale
    raise AssertionError(text)


@pytest.mark.parametrize("rung", W.RUNGS)
def test_synthetic_gold_follows_from_text(spark, rung):
    df = synth.batch(spark, rung, 150, 3)
    got = df.collect()
    assert len(got) == 150 == len({r["id"] for r in got}) and df.where(~rows.valid_episode({c: F.col(c) for c in df.columns})).count() == 0
    names = {c: {v: k for k, v in W.RUNG_ASKED[c].items()} for c in ("en", "es")}
    capped = 0
    for r in got:
        texts, gold = [c["text"] for c in r["candidates"]], int(r["answer"][1:])
        q = r["question"]
        most = not re.search("least|lowest|menos", q)
        said = sorted((m.start(), -len(w), k) for w, k in names[r["lang"]].items() for m in re.finditer(rf"\b{w}\b", q))
        said = [k for n, (at, length, k) in enumerate(said) if not any(a < at < a - b or (a == at and b < length) for a, b, _ in said[:n])]
        target = said[-1]
        v = [value_of(t, target) for t in texts]
        keep = range(len(v))
        if m := re.search(r"(?:at most|como máximo) ([\d.]+) g", q):
            capped += 1
            caps = [value_of(t, said[0]) for t in texts]
            keep = [i for i in keep if caps[i] <= float(m[1])]
            assert 2 <= len(keep) < len(v) and any((v[i] > v[gold]) == most and v[i] != v[gold] for i in range(len(v)) if i not in keep)
        best = (max if most else min)(keep, key=lambda i: v[i])
        assert best == gold, r
    assert (capped > 50) == (rung == "r4-constraints") and (rung != "r0-most" or all(re.search("most|highest|más", r["question"]) for r in got))


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    a = synth.batch(spark, "r3-units", 60, 8, 0.5)
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        b = synth.batch(spark, "r3-units", 60, 8, 0.5)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len({r["origin"] for r in a.select("origin").distinct().collect()}) > 1


def test_report(spark, dump, tmp_path):
    made = episodes.build(read_products(spark, dump), 6, 5).drop("split")
    doc = benchmark.result("rules", systems.rules, made)
    assert doc["decidable_accuracy"] == 1.0 and doc["by"]["lang:en"]["rows"] > 0
    some = benchmark.stratified(made, 60)
    assert 0 < some.count() < made.count()
    from optara.sources.files import read_documents, write_json, write_lines

    write_json(spark, str(tmp_path / "raw/rules.json"), doc)
    write_json(spark, str(tmp_path / "raw/own.json"), doc | {"system": {"name": "m", "kind": "own", "device": "cpu"}, "accuracy": 0.5})
    lines = benchmark.report(read_documents(spark, str(tmp_path / "raw")))
    text = [r["line"] for r in lines.orderBy("n").collect()]
    assert text[6].startswith("| rules |") and text[7].startswith("| m (cpu) |") and any(t.startswith("Chance") for t in text)
    write_lines(lines, str(tmp_path / "report"), "n")
    assert write_jsonl(some, str(tmp_path / "rows")) == read_jsonl(spark, str(tmp_path / "rows")).count()


def test_command_line(spark, dump, tmp_path):
    from optara import cli

    assert cli.main(["build", dump, "--out", str(tmp_path / "off"), "--per-category", "3"]) == 0
    assert cli.main(["bench", str(tmp_path / "off/train"), "--raw", str(tmp_path / "raw"), "--limit", "20"]) == 0
    assert cli.main(["report", "--raw", str(tmp_path / "raw"), "--out", str(tmp_path / "report")]) == 0
    assert cli.main(["rungs", "r1-pair", "--rows", "5", "--out", str(tmp_path / "rungs")]) == 0
    assert read_jsonl(spark, str(tmp_path / "rungs")).count() == 5
