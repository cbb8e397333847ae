"""Toxicity by maximal scoring segments of token log-odds, calibrated by extreme-value statistics.

Training counts, for a bounded sample of labelled rows, in how many toxic and other documents each
word occurs. A unit is a word or a stem (a prefix shared by several words). Its toxic share has a
Dirichlet prior (two classes) centred on its parent's share, the parent of a word being its longest
stem and of a stem the whole sample; the log-odds against the base share, less a fixed cost per word,
is the word's score. Scoring finds all maximal scoring segments of a text in one linear scan
(Ruzzo and Tompa) and turns their scores into E-values K n exp(-lam S), the extreme-value law of Karlin and
Altschul, with lam and K fitted to the highest segments of the sample's untoxic texts (peaks over a threshold). Significant
segments, each distinct one once, are joined by the sum statistic, and a logistic curve fitted on the sample maps it to 0..1.

Defined results: null and empty texts hold no word and get the score of a text without a passage;
repeated rows get equal scores; a label table with one class only scores every text 0; extra columns
of the input are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_checked, frugal, materialize
from .sample import labelled

TOKEN = re.compile(r"[^\W\d_]+")
#: Bounds of the model: labelled rows used, units kept.
MAX_TRAIN_ROWS, MAX_UNITS = 20_000, 200_000
LONGEST = 64  # characters of a word whose score is remembered
STEMS = range(4, 9)  # lengths of stems
MIN_COUNT, MIN_WORDS = 4, 3  # documents for a unit, distinct words for a stem
PRIOR, COST, TOP = 2.0, 1.0, 8.0  # strength of the prior, cost per word, largest score of a word
SIGNIFICANT = 0.05  # largest E-value of a passage
FLUSH = 200_000  # words counted in a task before partial counts are handed on


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 0.1
    slope: float = 1.0
    bias: float = -30.0

    def word(self, w: str) -> float:
        if (s := self.words.get(w)) is not None:
            return s
        for n in range(min(len(w), STEMS[-1]), STEMS[0] - 1, -1):
            if (s := self.stems.get(w[:n])) is not None:
                return s
        return -COST


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a score sequence, in linear time.

    Only positive scores open a candidate; negative stretches are read off prefix sums. Each candidate keeps a link to the
    last one before it that begins at a smaller sum, so that a search never passes a candidate twice. Where there is none, all
    candidates so far are maximal and are handed out.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    out: list[tuple[int, int, float]] = []
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before start, sum up to end, link
    for i, left, right in zip(positive.tolist(), total[positive].tolist(), total[positive + 1].tolist(), strict=True):
        start, link = i, len(stack) - 1
        while True:
            while link >= 0 and stack[link][2] >= left:
                link = stack[link][4]
            if link < 0:
                out += [(s, e, r - b) for s, e, b, r, _ in stack]
                stack = [(start, i + 1, left, right, -1)]
                break
            if stack[link][3] >= right:
                stack.append((start, i + 1, left, right, link))
                break
            start, _, left, _, before = stack[link]
            del stack[link:]
            link = before
    return out + [(s, e, r - b) for s, e, b, r, _ in stack]


class Scorer:
    """Scores texts with a model; words' scores are remembered within bounds."""

    def __init__(self, model: Model, remember: int = 300_000):
        self.model, self.seen, self.remember = model, {}, remember

    def _scores(self, words: list[str]) -> np.ndarray:
        seen, model = self.seen, self.model
        if len(seen) > self.remember:
            seen.clear()
        out = []
        for w in words:
            s = seen.get(w)
            if s is None:
                s = model.word(w)
                if len(w) <= LONGEST:
                    seen[w] = s
            out.append(s)
        return np.array(out)

    def scan(self, text: str | None) -> tuple[list[str], list[tuple[int, int, float]]]:
        """The words, and the maximal segments as word positions with scores; a word said again at once adds nothing."""
        words = TOKEN.findall(text.lower()) if text else []
        if not words:
            return words, []
        scores = self._scores(words)
        for i in np.flatnonzero(scores > 0).tolist():
            if i and words[i] == words[i - 1]:
                scores[i] = -COST
        return words, segments(scores)

    def evidence(self, text: str | None) -> tuple[int, list[float]]:
        """Number of words, and the scores of the distinct segments: a line that is repeated counts once."""
        words, found = self.scan(text)
        return len(words), list({tuple(words[s:e]): v for s, e, v in found}.values())

    def statistic(self, n: int, found: list[float]) -> tuple[float, int]:
        """-ln of the p-value of the joined passages, and the number of significant ones."""
        if not found:
            return 0.0, 0
        base = math.log(self.model.k * n)
        x = sorted((self.model.lam * s - base for s in found), reverse=True)
        strong = [v for v in x if v > -math.log(SIGNIFICANT)]
        if not strong:
            return -math.log(max(1e-12, 1 - math.exp(-math.exp(min(50.0, -x[0]))))), 0
        r, t = len(strong), sum(strong)
        return max(strong[0], t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r)), r

    def score(self, text: str | None) -> tuple[float, int, float]:
        if not self.model.words and not self.model.stems:
            return 0.0, 0, 0.0
        stat, r = self.statistic(*self.evidence(text))
        z = self.model.slope * math.log1p(stat) + self.model.bias
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z)))), r, stat


def tail(scores: np.ndarray, words: float, best: float) -> tuple[float, float]:
    """(lam, K) of the law that words words hold K * words * exp(-lam * x) segments of score x or more.

    Peaks over a threshold: the upper half of the segments' scores is taken as exponential above its least one, and lam is the
    likeliest rate; a segment of score best counts besides, for what the sample didn't show. Scores are log-odds, so that
    lam is 1 where the sample tells nothing.
    """
    u = float(np.median(scores)) if len(scores) else best
    over = np.append(scores[scores >= u], best)
    above = float((over - u).sum())
    lam = min(50.0, max(1e-3, (len(over) - 1) / above)) if len(over) > 1 and above > 1e-9 else 1.0
    return lam, min(1.0, max(1e-9, len(over) / max(1.0, words) * math.exp(lam * u)))


def _count_words(batches):
    """Partial (word, toxic documents, other documents) counts of (text, toxic) rows."""
    sides = (Counter(), Counter())

    def rows():
        words = list(sides[0].keys() | sides[1].keys())
        yield pa.RecordBatch.from_pydict({"word": words, "t": [sides[1][w] for w in words], "c": [sides[0][w] for w in words]}, schema=pa.schema([("word", pa.string()), ("t", pa.int64()), ("c", pa.int64())]))
        sides[0].clear(), sides[1].clear()

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            sides[int(toxic)].update(set(TOKEN.findall((text or "").lower())))
            if len(sides[0]) + len(sides[1]) > FLUSH:
                yield from rows()
    yield from rows()


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """A model from docs and labels (key, toxic 0/1); at most MAX_TRAIN_ROWS labelled keys, those of least hash."""
    rows = labelled(docs, labels.where(F.col(labels.columns[1]).isin(0, 1)), MAX_TRAIN_ROWS, key, text).select("text", F.col("label").alias("toxic"))
    docs = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(docs) < 2:
        return Model()
    words = rows.select("text", "toxic").mapInArrow(frugal(_count_words), "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    words = materialize(words, "toxicity-words")  # as many as the sample holds
    stems = (
        words.select(F.explode(F.transform(F.sequence(F.lit(STEMS[0]), F.lit(STEMS[-1])), lambda n: F.when(F.length("word") >= n, F.substring("word", F.lit(1), n)))).alias("stem"), "t", "c")
        .where("stem is not null").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count("*").alias("n"))
    )
    base = docs[1] / (docs[0] + docs[1])
    logit = lambda p: math.log(p / (1 - p))

    def share(t: int, c: int, parent: float) -> float:
        return (t + PRIOR * parent) / (t + c + PRIOR)

    def value(p: float) -> float:
        return max(-TOP, min(TOP, logit(min(1 - 1e-9, max(1e-9, p))) - logit(base)))

    stems, words = stems.where(f"t + c >= {MIN_COUNT} and n >= {MIN_WORDS}"), words.where(f"t + c >= {MIN_COUNT}")
    least = 2 * math.log(max(2, stems.count() + words.count()))
    # Units that say no more than the base share would only add noise: a likelihood ratio that holds for all units at once.
    sides = [F.when(F.col(x) > 0, 2 * F.col(x) * F.ln(F.col(x) / ((F.col("t") + F.col("c")) * p))).otherwise(0.0) for x, p in (("t", base), ("c", 1 - base))]
    rated = lambda df: df.withColumn("ratio", sides[0] + sides[1]).withColumn("telling", (F.col("t") > F.col("c")) & (F.col("ratio") > least))
    # What passes is bounded, the most telling first.
    top = lambda df: df.orderBy(F.col("telling").desc(), F.col("ratio").desc(), F.col(df.columns[0])).limit(MAX_UNITS // 2).collect()

    model, shares = Model(), {}
    for r in top(rated(stems).where("telling")):
        shares[r["stem"]] = share(r["t"], r["c"], base)
        model.stems[r["stem"]] = value(shares[r["stem"]]) - COST
    # Besides telling words, those that are less toxic than their longest stem.
    parents = rows.sparkSession.createDataFrame(list(shares.items()), "stem string, share double")
    prefixes = F.transform(F.sequence(F.lit(STEMS[0]), F.lit(STEMS[-1])), lambda n: F.when(F.length("word") >= n, F.substring("word", F.lit(1), n)))
    under = words.select("word", F.explode(prefixes).alias("stem")).join(F.broadcast(parents), "stem").groupBy("word").agg(F.max(F.struct(F.length("stem").alias("n"), "share"))["share"].alias("share"))
    known = rated(words.join(under, "word", "left"))
    for r in top(known.where(F.col("telling") | (F.col("t") + PRIOR * F.col("share") < F.col("share") * (F.col("t") + F.col("c") + PRIOR)))):
        p = share(r["t"], r["c"], base if r["share"] is None else r["share"])
        model.words[r["word"]] = (value(p) if r["telling"] else min(value(p), 0.0)) - COST
    _calibrate(model, rows, docs[0])
    return model


def _calibrate(model: Model, rows: DataFrame, untoxic: int) -> None:
    """Extreme-value parameters from untoxic rows, then the logistic curve from all rows of the sample."""
    best = max([*model.words.values(), *model.stems.values(), 0.0])
    if best <= 0:
        return
    sent = broadcast_checked(rows.sparkSession, model, model_bytes(model), "toxicity model")

    def scan(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            got = [scorer.evidence(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "n": [n for n, _ in got], "s": [s for _, s in got]}, schema=pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))]))

    got = rows.select("text", "toxic").mapInArrow(frugal(scan), "toxic int, n long, s array<double>").collect()
    clean = [r for r in got if not r["toxic"]]
    model.lam, model.k = tail(np.array([s for r in clean for s in r["s"]]), sum(r["n"] for r in clean), best)
    scorer = Scorer(model)
    x = np.array([math.log1p(scorer.statistic(r["n"], r["s"])[0]) for r in got])
    y = np.array([float(r["toxic"]) for r in got])
    y = (y * (y.sum() + 1) / (y.sum() + 2)) + (1 - y) / (len(y) - y.sum() + 2)  # targets as Platt sets them
    a, b = 0.0, math.log(max(1e-9, y.mean()) / max(1e-9, 1 - y.mean()))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        w, g = p * (1 - p) + 1e-9, y - p
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step_ = np.linalg.solve(h, np.array([(g * x).sum() - 1e-3 * a, g.sum()]))
        norm = np.abs(step_).max()
        a, b = np.array([a, b]) + step_ * min(1.0, 2.0 / max(norm, 1e-12))
        if norm < 1e-8:
            break
    model.slope, model.bias = float(a), float(b)


def model_bytes(model: Model) -> int:
    return sum(len(k.encode()) + 120 for d in (model.words, model.stems) for k in d) + 1024


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns of docs with score double, n_passages int and statistic double."""
    sent = broadcast_checked(docs.sparkSession, model, model_bytes(model), "toxicity model")
    frame = docs.select(*keep, *([] if text in keep else [F.col(text).cast("string").alias("__text")]))  # whole texts travel once
    at = keep.index(text) if text in keep else len(keep)
    schema = T.StructType([*frame.schema.fields[: len(keep)], T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.IntegerType()), T.StructField("statistic", T.DoubleType())])

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            got = [scorer.score(t) for t in batch.column(at).to_pylist()]
            own = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.float64(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *own], names=[*batch.schema.names[: len(keep)], "score", "n_passages", "statistic"])

    return frame.mapInArrow(frugal(run), schema)


def passages(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per significant passage: key, start and end (word positions), score, e_value and its words."""
    sent = broadcast_checked(docs.sparkSession, model, model_bytes(model), "toxicity model")
    frame = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    kind = frame.schema.fields[0].dataType
    schema = T.StructType([T.StructField(key, kind), *(T.StructField(n, t) for n, t in (("start", T.LongType()), ("end", T.LongType()), ("score", T.DoubleType()), ("e_value", T.DoubleType()), ("passage", T.StringType())))])

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            take, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                words, found = scorer.scan(t)
                for s, e, v in found:
                    if (ev := scorer.model.k * len(words) * math.exp(-scorer.model.lam * v)) <= SIGNIFICANT:
                        take.append(i)
                        rows.append((s, e, v, ev, " ".join(words[s:e])))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()), strict=True))], names=[key, "start", "end", "score", "e_value", "passage"])

    return frame.mapInArrow(frugal(run), schema)
