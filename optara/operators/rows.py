"""Row rules: validity, requests, hard rows, budgets, layouts, batches and shuffles."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import HARD_WORDS
from .ranks import row_numbers

# Bounds of a request and of a row, and what a request's first problem is called, in the order of the tests.
MAX_OPTIONS = 26
MAX_LENGTH = 1536
PROBLEMS = (
    "state must be non-empty text",
    "question must be non-empty text",
    "candidates must hold 2 to 26 options",
    "every candidate needs a non-empty text",
    "candidate ids must be present and unique",
)


def valid_episode(row) -> Column:
    """Texts present, at least two options with unique ids and texts, and the answer among the ids. row: name -> Column."""
    c = row["candidates"]
    ids = F.transform(c, lambda x: F.coalesce(x["id"], F.lit("\0null")))
    full = lambda x: x.isNotNull() & (x != "")
    ok = full(row["state"]) & full(row["question"]) & (F.size(c) >= 2) & (F.size(F.array_distinct(ids)) == F.size(c)) & F.forall(c, lambda x: full(x["text"])) & F.array_contains(ids, F.coalesce(row["answer"], F.lit("\0null")))
    return F.coalesce(ok, F.lit(False))


def request_problem(row) -> Column:
    """The first problem of a request as text, null if it is usable."""
    c = row["candidates"]
    blank = lambda x: F.coalesce(F.regexp_replace(x, r"(?U)\s", "") == "", F.lit(True))
    ids = F.transform(c, lambda x: F.coalesce(x["id"], F.lit("")))
    return (
        F.when(blank(row["state"]), PROBLEMS[0]).when(blank(row["question"]), PROBLEMS[1]).when(F.coalesce(~F.size(c).between(2, MAX_OPTIONS), F.lit(True)), PROBLEMS[2])
        .when(F.exists(c, lambda x: blank(x["text"])), PROBLEMS[3]).when(F.array_contains(ids, "") | (F.size(F.array_distinct(ids)) != F.size(ids)), PROBLEMS[4])
    )


def prints_sodium(texts: Column) -> Column:
    return F.exists(texts, lambda t: t.contains("sodium") | t.contains("sodio"))


def hard(question: Column, texts: Column) -> Column:
    """A cap in the question, five or more options, or sodium on a card."""
    capped = F.lower(question).rlike("|".join(HARD_WORDS))
    return capped | (F.size(texts) >= 5) | prints_sodium(texts)


def oversample(rows: DataFrame, again: Column, copies: int = 1) -> DataFrame:
    """rows, with those where again holds as many times more; copy numbers them from 0."""
    last = F.when(again, F.lit(copies)).otherwise(0)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), last)))


class Arithmetic(NamedTuple):
    """Whole-number arithmetic over one kind of operand."""

    between: Callable  # (value, least, most)
    part: Callable  # (value, divisor), rounded down
    choose: Callable  # (condition, then, otherwise)


NUMBERS = Arithmetic(lambda x, lo, hi: max(lo, x if hi is None else min(x, hi)), lambda a, b: a // b, lambda c, a, b: a if c else b)
COLUMNS = Arithmetic(
    lambda x, lo, hi: F.greatest(F.lit(lo), x if hi is None else F.least(x, F.lit(hi))), lambda a, b: F.floor(a / b), lambda c, a, b: F.when(c, a).otherwise(b),
)


def shares(limit, options, of: Arithmetic) -> tuple:
    """Bytes for the question, the state and each option, for plain numbers or for columns."""
    n = of.between(options, 1, None)
    question, state = (of.between(of.part(limit, 8), lo, hi) for lo, hi in ((8, 160), (16, 256)))
    left = limit - (n + 1) - question  # for the state and the options, separators taken off
    state = of.choose(left - state < n * 4, of.between(left - n * 4, 8, None), state)
    return question, state, of.between(of.part(left - state, n), 1, None)


def budgets(limit: Column, options: Column) -> Column:
    """Struct of byte budgets for question, state and each option, in whole numbers."""
    return F.struct(*(x.cast("long").alias(n) for x, n in zip(shares(limit, options, COLUMNS), ("question", "state", "option"), strict=True)))


def fits(question: Column, texts: Column, limit: int = MAX_LENGTH) -> Column:
    """Whether the question and every option stay whole within their budgets, two marks each included."""
    b = budgets(F.lit(limit), F.size(texts))
    return (F.octet_length(question) + 2 <= b["question"]) & F.forall(texts, lambda t: F.octet_length(t) + 2 <= b["option"])


def layout(state: Column, question: Column, options: Column, limit: int = MAX_LENGTH, question_slot: int = 108, option_slot: int = 191) -> Column:
    """Slots of one row from byte lengths: widths and starts of the state, the question and each option.

    The state's slot is as wide as its budget; the question's and the options' slots grow from their usual width to
    what this row needs, up to the budget. One separator stands after the state, the question and each option but the last.
    """
    b = budgets(F.lit(limit), F.size(options))
    q = F.least(b["question"], F.greatest(F.lit(question_slot), question))
    o = F.least(b["option"], F.greatest(F.lit(option_slot), F.array_max(options)))
    first = b["state"] + 1 + q + 1
    starts = F.transform(options, lambda _, i: first + i * (o + 1))
    return F.struct(b["state"].alias("state_width"), F.least(state, b["state"]).alias("state_used"), (b["state"] + 1).alias("question_start"), q.cast("long").alias("question_width"), o.cast("long").alias("option_width"), starts.alias("option_starts"))


def tail_bytes(text: Column, keep: int) -> Column:
    """Hex of the last keep bytes: a running state keeps its newest part."""
    h = F.hex(F.encode(text, "UTF-8"))
    return F.when(F.octet_length(text) <= keep, h).otherwise(F.right(h, F.lit(2 * keep)))


def batches(rows: DataFrame, options: str, order: list, size: int) -> DataFrame:
    """rows with batch: the number, within their option count, of the batch of size rows that they belong to."""
    numbered = row_numbers(rows, [options], order, "__at")
    return numbered.withColumn("batch", F.floor(F.col("__at") / size).cast("long")).drop("__at")


def shuffled_batches(batched: DataFrame, options: str, seed: int) -> DataFrame:
    """Batched rows with at: the place of their batch, from 0, in an order keyed by SHA-256 of seed, option count and number."""
    each = batched.select(options, "batch").distinct()
    key = F.sha2(F.encode(F.concat_ws("/", F.lit(str(seed)), F.col(options).cast("string"), F.col("batch").cast("string")), "UTF-8"), 256)
    return batched.join(row_numbers(each, [], [key], "at"), [options, "batch"])


def shuffle_options(options: Column, *key: Column) -> Column:
    """The options in an order keyed by SHA-256 of key and position: the same under any partitioning."""
    keyed = F.transform(options, lambda x, i: F.struct(F.sha2(F.encode(F.concat_ws("/", *key, i.cast("string")), "UTF-8"), 256).alias("k"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def gold_position(ids: Column, answer: Column) -> Column:
    """Position of the answer, -1 for none, the option count for `unknown`."""
    return F.when(answer.isNull(), -1).when(answer == "unknown", F.size(ids)).otherwise(F.array_position(ids, answer).cast("int") - 1)
