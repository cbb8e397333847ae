import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from optara.operators import scorer, systems
from optara.plans import loop
from optara.streaming import history, server

CONFIG = scorer.Config(max_length=256, d_model=16, n_heads=4, n_layers=2, d_ff=32, pointer_layers=2, question_slot=20, option_slot=24)
EP = "state string, question string, candidates array<struct<id: string, text: string>>, answer string"


def test_parameter_count():
    assert scorer.parameters(scorer.Config()) == 16_959_746


def test_model_rows_are_alone(spark):
    m = scorer.random_model(CONFIG, 3)
    a = m.logits("state", "question", ["x", "yy", "zzz"])
    assert len(a) == 4 and np.isfinite(a).all() and scorer.forced(a).sum() == pytest.approx(1)
    rows = [("state", "question", [("c0", "x"), ("c1", "yy"), ("c2", "zzz")], "c1")] * 3 + [("s" * 600, "q" * 400, [("c0", "é" * 300), ("c1", "y")], "c1")]
    got = scorer.predict(spark.createDataFrame(rows, EP), m).collect()
    p = scorer.forced(a)
    assert all(r["choice"] == f"c{int(p.argmax())}" and r["probabilities"] == {f"c{i}": round(float(x), 6) for i, x in enumerate(p)} for r in got[:3]) and len(got[3]["probabilities"]) == 2


def test_options_commute():
    m = scorer.random_model(CONFIG, 3)
    for k in m.w:  # make positions irrelevant, so that only the set of options counts
        if k == "position_embed.weight":
            m.w[k][:] = 0
    a, b = m.logits("s", "q", ["one", "two"]), m.logits("s", "q", ["two", "one"])
    assert np.allclose(a[:2], b[1::-1], atol=1e-5)


def test_save_and_load(tmp_path):
    m = scorer.random_model(CONFIG, 1)
    scorer.save(m, str(tmp_path / "m"))
    back, longer = scorer.load(str(tmp_path / "m")), scorer.load(str(tmp_path / "m"), 300)
    assert np.allclose(m.logits("s", "q", ["a", "b"]), back.logits("s", "q", ["a", "b"])) and longer.w["position_embed.weight"].shape == (300, 16)
    with pytest.raises(KeyError):
        scorer.Model(CONFIG, {k: v for k, v in m.w.items() if k != "encoder_norm.bias"})
    with pytest.raises(ValueError):
        scorer.encode("x", 1)


def test_external_protocols(spark):
    df = spark.createDataFrame([("s", "q", [("a", "x"), ("b", "y")], "b")], EP)
    seen = systems.request_of({c: F.col(c) for c in df.columns})
    assert json.loads(df.select(seen).first()[0]) == {"state": "s", "questions": {"pick": {"type": "choice", "instructions": "q", "criteria": {"a": "x", "b": "y"}}}}
    replies = ['{"answers":{"pick":{"choice":"b"}}}', '{"states":[{"answers":{"pick":{"probabilities":{"a":0.2,"b":0.8}}}}]}', "{}", "broken"]
    got = spark.createDataFrame([(r,) for r in replies], "r string").select(systems.choice_of(F.col("r"))).collect()
    assert [r[0] for r in got] == ["b", "b", None, None]
    flat = systems.decision_service("http://x", lambda url: lambda body: '{"answers":{"pick":{"choice":"a"}}}')(df).first()
    assert flat["choice"] == "a" and flat["latency_ms"] >= 0
    chat = systems.chat_service("http://x", "m", lambda url: lambda body: json.dumps({"message": {"content": " b" if "B. y" in body else "?"}}))(df).first()
    assert chat["choice"] == "b"
    assert set(systems.registry(scorer.random_model(CONFIG))) == {"rules", "own", "decision", "chat", "pointer"}


def test_server():
    s = server.make(lambda body: {"choice": body["candidates"][0]["id"]}, examples=[1])
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_address[1]}"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data=body)) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    good = {"state": "s", "question": "q", "candidates": [{"id": "a", "text": "x"}, {"id": "b", "text": "y"}]}
    assert call("/health") == (200, {"status": "ok"}) and call("/examples") == (200, [1]) and call("/nope")[0] == 404 and call("/nope", b"{}")[0] == 404
    status, body = call("/decide", json.dumps(good).encode())
    assert status == 200 and body["choice"] == "a" and body["latency_ms"] >= 0
    assert call("/decide", b"{")[0] == 400 and call("/decide", json.dumps(good | {"state": ""}).encode())[0] == 422
    s.shutdown()


def test_history_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    lines = [("r", i, a, a >= 0.9) for i, a in enumerate([0.5, 0.95, 0.95, 0.2, 0.99])] + [("q", 0, 0.1, False)]
    for k in range(2):
        spark.createDataFrame(lines[k * 3 : k * 3 + 3], history.EVENT).coalesce(1).write.mode("append").json(path)
    got = history.drain(history.champions(history.read_log(spark, path)), "champions_test").collect()
    want = {("r", 0): (0.0, True, 0), ("r", 1): (0.5, True, 0), ("r", 2): (0.95, False, 1), ("r", 3): (0.95, False, 2), ("r", 4): (0.95, True, 2), ("q", 0): (0.0, True, 0)}
    assert {(r["run"], r["cycle"]): (r["best_before"], r["champion"], r["rung_index"]) for r in got} == want


def test_curriculum_loop(spark, tmp_path, monkeypatch):
    small = tuple(loop.Rung(r.id, 1, 1, 40) for r in loop.RUNGS)
    monkeypatch.setattr(loop, "RUNGS", small)
    scores = iter([0.95, 0.5, 0.92])

    def trainer(train, dev, rung, folder):
        assert train.count() == 40 and dev.count() == 30
        return {"accuracy": next(scores), "chance": 0.5, "wilson_lower": 0.4, "rows": 30, "loss": 1.0}

    run = str(tmp_path / "run")
    state = loop.loop(spark, run, trainer, cycles=2, dev_rows=30)
    assert (state["rung_index"], state["next_cycle"], state["cleared"]) == (1, 2, {"r0-most": 0})
    state = loop.loop(spark, run, trainer, cycles=1, dev_rows=30)  # goes on where the history ends
    assert state["rung_index"] == 2 and state["best"] == {"r0-most": 0.95, "r1-pair": 0.92}
    from optara.sources.files import HISTORY

    lines = spark.read.schema(HISTORY).json(f"{run}/history").orderBy("cycle").collect()
    assert [(r["cycle"], r["rung"], r["cleared"]) for r in lines] == [(0, "r0-most", True), (1, "r1-pair", False), (2, "r1-pair", True)]
    (tmp_path / "run/STOP").touch()
    assert loop.loop(spark, run, trainer)["next_cycle"] == 3


def test_standing_follows_from_history(spark):
    from optara.sources.files import HISTORY

    lines = [(0, "r0-most", 0.95, True), (1, "r1-pair", None, False), (2, "r1-pair", 0.91, True), (3, "r5-real", 0.0, False), (4, "r5-real", 0.93, False), (5, "r5-real", 0.93, False), (6, "r5-real", 0.4, False)]
    full = lambda n: spark.createDataFrame([(c, r, a, None, None, 1, None, 1, k, 1.0, None) for c, r, a, k in lines[:n]], HISTORY)
    got = loop.standing(full(7)).first().asDict(recursive=True)
    assert got == {"next_cycle": 7, "rung_index": 2, "best": {"r0-most": 0.95, "r1-pair": 0.91, "r5-real": 0.93}, "cleared": {"r0-most": 0, "r1-pair": 2}, "champion": {"cycle": 4, "accuracy": 0.93}}
    assert loop.standing(full(4)).first()["champion"] is None and loop.standing(full(0)).first()["next_cycle"] == 0


def test_latest_cycle_and_champion_stay(spark, tmp_path, monkeypatch):
    from optara.operators import synth
    from optara.sources.files import write_jsonl

    rows = synth.batch(spark, "r4-constraints", 16, 1)
    write_jsonl(rows, str(tmp_path / "real"))
    monkeypatch.setattr(loop, "RUNGS", (loop.Rung(loop.REAL, 1, 1, 0),))
    scores = iter([0.5, 0.8, 0.6, 0.7])

    def trainer(train, dev, rung, folder):
        (tmp_path / "run/cycles" / folder.rsplit("/", 1)[1] / "model").write_text("x")
        assert train.count() > 16 and dev.count() == 16
        return {"accuracy": next(scores), "chance": 0.5, "wilson_lower": 0.4, "rows": 16, "loss": 1.0}

    got = loop.loop(spark, str(tmp_path / "run"), trainer, 4, str(tmp_path / "real"), str(tmp_path / "real"))
    assert got["champion"] == {"cycle": 1, "accuracy": 0.8} and got["next_cycle"] == 4 and got["rung_index"] == 0 and got["cleared"] == {}
    assert sorted(p.name for p in (tmp_path / "run/cycles").iterdir()) == ["000001", "000003"]
    assert [p.name for p in (tmp_path / "run/cycles/000001").iterdir()] == ["model"] and (tmp_path / "run/state.json").exists()
