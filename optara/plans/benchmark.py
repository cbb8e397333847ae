"""Score systems over rows and render the ranked report."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import percent
from ..operators import relations, rows, score, systems


def stratified(df: DataFrame, limit: int, order: str = "id") -> DataFrame:
    """Every n-th row of each (difficulty, option count, language) cell."""
    return relations.stratified(df.withColumn("__k", F.size("candidates")), ["difficulty", "__k", "lang"], [F.col(order)], limit).drop("__k")


def answered(df: DataFrame, found: dict[str, systems.System]) -> DataFrame:
    """The same rows once per system, with system and choice."""
    out = None
    for name, system in found.items():
        one = system(df).withColumn("system", F.lit(name)).select("system", *df.columns, "choice")
        out = one if out is None else out.unionByName(one)
    return out


def totals(df: DataFrame) -> DataFrame:
    """Per system: the totals and chance."""
    t = score.totals(df, ["system"], F.col("choice"), F.col("answer"), F.col("decidable"))
    return t.join(score.chance(df, ["system"], F.size("candidates")), "system")


def by_cell(df: DataFrame) -> DataFrame:
    keys = score.cell_keys(F.col("difficulty"), F.size("candidates"), F.col("lang"), rows.prints_sodium(F.transform("candidates", lambda c: c["text"])))
    return score.cells(df, ["system"], keys, F.col("choice") == F.col("answer"))


def result(name: str, system: systems.System, df: DataFrame, kind: str = "rules", device: str | None = None) -> dict:
    """One system's result document; latency is the time per row of the whole run where the system reports none itself."""
    began = time.perf_counter()
    out = answered(df, {name: system}).persist()
    n = out.count()
    each = (time.perf_counter() - began) * 1000 / max(1, n)
    t = totals(out).first().asDict() if n else {}
    cells = {r["cell"]: {"accuracy": r["accuracy"], "rows": r["rows"]} for r in by_cell(out).orderBy("cell").collect()}
    out.unpersist()
    return {"system": {"name": name, "kind": kind, "device": device}, **{k: v for k, v in t.items() if k != "system"}, "by": cells, "latency_ms": {"p50": each, "p95": each, "mean": each}, "batched_decisions_per_s": 1000 / each if each else None}


# Titles of the ranking.
RANKING = ("System", "Rows", "Accuracy %", "Wilson low %", "Decidable %", "p50 ms", "p95 ms")


def _head(titles) -> list[str]:
    """A table's title and alignment lines: names to the left, numbers to the right."""
    sides = ["---" if i == 0 else "---:" for i, _ in enumerate(titles)]
    return [f"| {' | '.join(titles)} |", f"|{'|'.join(sides)}|"]


def report(results: DataFrame) -> DataFrame:
    """Lines (n, line) of the report from result documents: the ranking, chance, and accuracy by question shape."""
    r = results.withColumn("label", score.label(F.col("system.name"), F.col("system.kind"), F.col("system.device")))
    ranked = score.leaderboard(r.select("label", "rows", "accuracy", "wilson_lower", "decidable_accuracy", F.col("latency_ms.p50").alias("p50"), F.col("latency_ms.p95").alias("p95")))
    shapes = F.array(*(F.col("by")[c]["accuracy"] for c in score.CELLS))  # a map has no order
    order = F.array_sort(F.collect_list(F.struct((-F.col("accuracy")).alias("a"), "label", "chance", shapes.alias("shapes"))))
    one = r.agg(order.alias("r"))
    shape = lambda x: F.concat(F.lit("| "), x["label"], F.lit(" | "), F.array_join(F.transform(x["shapes"], percent), " | "), F.lit(" |"))
    head = ["# Results", "", "Forced accuracy per system. Latency is per decision.", "", *_head(RANKING)]
    middle = ["", "## By question shape", "", *_head(["System", *(title for _, _, title in (c.partition(":") for c in score.CELLS))])]
    lines = ranked.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("top")).join(F.broadcast(one))  # one row each
    every = F.concat(F.array(*map(F.lit, head)), F.col("top"), F.array(F.lit(""), F.concat(F.lit("Chance (uniform pick): "), percent(F.get("r", F.lit(0))["chance"]), F.lit("%."))), F.array(*map(F.lit, middle)), F.transform("r", shape))
    return lines.select(F.posexplode(every).alias("n", "line"))
