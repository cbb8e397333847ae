"""Answering systems behind one interface: a DataFrame of rows in, the same rows with choice (null: no answer) out."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import letter_choice
from . import scorer
from .answer import decide

System = Callable[[DataFrame], DataFrame]


def rules(rows: DataFrame) -> DataFrame:
    """The rule program: exact where question and cards follow the known templates."""
    at = decide(F.col("question"), F.transform("candidates", lambda c: c["text"]))
    return rows.withColumn("choice", F.get("candidates", at)["id"])


def own(model: scorer.Model) -> System:
    return lambda rows: scorer.predict(rows, model)


def request_of(row) -> Column:
    """A row as a choice question of the external decision protocol, as JSON."""
    criteria = F.map_from_entries(F.transform(row["candidates"], lambda c: F.struct(c["id"], c["text"])))
    return F.to_json(F.struct(row["state"].alias("state"), F.struct(F.struct(F.lit("choice").alias("type"), row["question"].alias("instructions"), criteria.alias("criteria")).alias("pick")).alias("questions")))


_PICK = "struct<pick: struct<choice: string, probabilities: map<string, double>>>"


def choice_of(reply: Column) -> Column:
    """The id picked by a reply, flat or nested in its first state; without a choice the likeliest option."""
    r = F.from_json(reply, f"answers {_PICK}, states array<struct<answers: {_PICK}>>")
    pick = F.coalesce(r["answers"], F.get(r["states"], F.lit(0))["answers"])["pick"]
    ranked = F.array_sort(F.transform(F.map_entries(pick["probabilities"]), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.coalesce(F.nullif(pick["choice"], F.lit("")), F.try_element_at(ranked, F.lit(1))["k"])


def prompt_of(row) -> Column:
    """A zero-shot prompt that asks for the letter of one option."""
    lines = F.transform(row["candidates"], lambda c, i: F.concat(F.char(i + 65), F.lit(". "), c["text"]))
    return F.concat(row["state"], F.lit("\n\n"), row["question"], F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n\nAnswer with the letter of one option and nothing else."))


def post(url: str, timeout: float = 600) -> Callable[[str], str]:
    def send(body: str) -> str:
        request = urllib.request.Request(url, data=body.encode(), headers={"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.read().decode()

    return send


def ask(rows: DataFrame, body: Column, client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """rows with reply and latency_ms: client() is made once per partition and called for each row's body."""
    schema = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType()), T.StructField("latency_ms", T.DoubleType())])
    n = len(rows.columns)

    def run(batches):
        send = client()
        for b in batches:
            replies, took = [], []
            for text in b.column(n).to_pylist():
                began = time.perf_counter()
                replies.append(send(text))
                took.append((time.perf_counter() - began) * 1000)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(replies, pa.string()), pa.array(took, pa.float64())], names=[*b.schema.names[:n], "reply", "latency_ms"])

    return rows.withColumn("__body", body).mapInArrow(run, schema)


def decision_service(url: str, client=post) -> System:
    def system(rows: DataFrame) -> DataFrame:
        asked = ask(rows, request_of({c: F.col(c) for c in rows.columns}), lambda: client(url))
        return asked.withColumn("choice", choice_of(F.col("reply"))).drop("reply")

    return system


def chat_service(url: str, model: str, client=post) -> System:
    def system(rows: DataFrame) -> DataFrame:
        prompt = prompt_of({c: F.col(c) for c in rows.columns})
        message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
        options = F.struct(F.lit(0).alias("temperature"), F.lit(8).alias("num_predict"))
        body = F.to_json(F.struct(F.lit(model).alias("model"), F.lit(False).alias("stream"), F.lit(False).alias("think"), F.array(message).alias("messages"), options.alias("options")))
        asked = ask(rows, body, lambda: client(url))
        content = F.coalesce(F.from_json("reply", "message struct<content: string>")["message"]["content"], F.lit(""))
        return asked.withColumn("choice", F.get("candidates", letter_choice(content, F.size("candidates")))["id"]).drop("reply")

    return system


def registry(model: scorer.Model | None = None, decision_url: str = "http://127.0.0.1:11434/v1/systemone", chat_url: str = "http://127.0.0.1:11434/api/chat", chat_model: str = "", pointer_url: str = "http://127.0.0.1:8080/decide") -> dict[str, System]:
    """The five systems by name; the network ones are made here and reached only when applied."""
    found: dict[str, System] = {"rules": rules, "decision": decision_service(decision_url), "chat": chat_service(chat_url, chat_model), "pointer": decision_service(pointer_url)}
    return found | ({"own": own(model)} if model else {})
