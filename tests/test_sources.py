import hashlib
import json

import pytest

from optara import api
from optara.sources import files
from optara.streaming import history


def test_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([("1", "¿qué?"), ("2", None)], "id string, question string")
    assert files.write_jsonl(rows, str(tmp_path / "rows")) == 2
    assert sorted(r["question"] or "" for r in files.read_jsonl(spark, str(tmp_path / "rows")).collect()) == ["", "¿qué?"]
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n\n{broken\n')
    with pytest.raises(Exception, match="Malformed|FAILFAST|JSON"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "blank.jsonl").write_text('{"id": "1"}\n\n')
    assert files.read_jsonl(spark, str(tmp_path / "blank.jsonl")).count() == 1


def test_documents_and_digests(spark, tmp_path):
    files.write_json(spark, str(tmp_path / "a/x.json"), {"b": "é", "a": 1})
    assert (tmp_path / "a/x.json").read_text() == '{\n  "a": 1,\n  "b": "é"\n}\n' and [p.name for p in (tmp_path / "a").iterdir()] == ["x.json"]
    r = files.digests(spark, str(tmp_path / "a")).first()
    assert r["sha256"] == hashlib.sha256((tmp_path / "a/x.json").read_bytes()).hexdigest()
    for n in ("2", "1"):
        files.write_json(spark, str(tmp_path / f"docs/{n}.json"), {"system": {"name": n}, "by": {"lang:en": {"accuracy": 0.5, "rows": 2}}})
    got = files.read_documents(spark, str(tmp_path / "docs")).collect()
    assert [r["file"] for r in got] == ["1.json", "2.json"] and got[0]["by"]["lang:en"]["rows"] == 2 and json.loads("{}") == {}


def test_windowed_counts(spark, tmp_path):
    lines = [{"ts": f"2026-01-01T0{h}:10:00Z", "event_type": "a", "value": float(h)} for h in (0, 0, 1, 5)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/1.json").write_text("\n".join(map(json.dumps, lines)))
    df = history.hourly(history.read_log(spark, str(tmp_path / "log"), "ts timestamp, event_type string, value double"))
    got = [(r["n"], r["mean"]) for r in history.drain(df, "hourly").orderBy("start").collect()]
    assert got[:2] == [(2, 0.0), (1, 1.0)]  # windows that the watermark has closed


def test_public_names():
    assert all(hasattr(api, n) for n in api.__all__)


def test_written_tables_can_be_cleared(spark):
    from optara import shared

    shared.clear(spark)
    df = shared.materialize(spark.range(3), "test")
    more = shared.settle(shared.materialize(df.selectExpr("id + 1 as id"), "test"), "test", shared.written())
    assert shared.settle(more, "test", 1).count() == 3 and shared.written() == 2
    assert shared.clear(spark, 1) == 1
    assert df.count() == 3 and shared.clear(spark) == 1 and shared.clear(spark) == 0
