"""Quality by ordinal cumulative-link regression on graded ratings.

A text becomes hashed byte trigrams, with a hashed mark for each word that repeats the one before it, as roots of
relative frequencies of unit length. One weight vector is shared by all grades; P(grade <= k) is the logistic function of
threshold k less the text's value, with thresholds kept in order. The fit takes a bounded sample of rated rows, those of least hash of their id up to MAX_TRAIN_ROWS rows
and MAX_FEATURES features (12 bytes each), in one task, which gets features and no texts; scoring gives the expected grade and the probability of
at least the grade that selection asks for.

Defined results: null and empty texts have no feature and get the thresholds' own probabilities; rows with a null grade are
not used; with one grade or none in the sample every text gets that grade with certainty (grade 0 if none); repeated rows
get equal results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_checked, frugal, materialize
from .sample import labelled

BUCKETS = 1 << 16
MAX_TRAIN_ROWS, MAX_FEATURES = 8_000, 24_000_000
STEPS, RATE, RIDGE = 200, 0.15, 1e-4


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # one less than there are grades, rising

    def tails(self, value: float) -> np.ndarray:
        """P(grade >= k) for k = 1 up to the highest grade."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - value, -500, 500)))


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a whole text."""
    if not text:
        return np.empty(0, np.int64), np.empty(0)
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    h = ((b[:-2] * 0x9E3779B1) ^ (b[1:-1] * 0x85EBCA6B) ^ (b[2:] * 0xC2B2AE35)) if len(b) > 2 else b * np.uint32(0x27D4EB2F)
    count = np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(16), minlength=BUCKETS)
    words = text.split()
    repeats = sum(map(bytes.__eq__, words[1:], words[:-1]))
    count[0] += 8 * repeats
    at = np.flatnonzero(count)
    x = np.sqrt(count[at])
    return at, x / np.sqrt((x * x).sum())


def slopes(p: np.ndarray, y: np.ndarray, own: np.ndarray, col: np.ndarray, val: np.ndarray, grades: int) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with its ridge, and its gradient, at p: weights, first threshold, logs of the gaps between thresholds.

    Rows have grades y; feature number i belongs to row own[i] and has bucket col[i] and value val[i].
    """
    n, w, gaps = len(y), p[:BUCKETS], np.exp(p[BUCKETS + 1 :])
    theta = np.concatenate([p[BUCKETS : BUCKETS + 1], p[BUCKETS] + np.cumsum(gaps)])
    f = np.bincount(own, weights=w[col] * val, minlength=n)
    cum = 1 / (1 + np.exp(-np.clip(theta[None, :] - f[:, None], -30, 30)))
    cum = np.concatenate([np.zeros((n, 1)), cum, np.ones((n, 1))], axis=1)
    hi, lo = cum[np.arange(n), y + 1], cum[np.arange(n), y]
    prob = np.maximum(hi - lo, 1e-12)
    g_w = np.bincount(col, weights=((1 - hi - lo) / n)[own] * val, minlength=BUCKETS) + RIDGE * w
    slope = np.zeros((n, grades + 1))
    slope[np.arange(n), y + 1] -= hi * (1 - hi) / prob
    slope[np.arange(n), y] += lo * (1 - lo) / prob
    g_theta = slope[:, 1:-1].mean(axis=0)
    g_gaps = np.array([g_theta[k + 1 :].sum() for k in range(grades - 2)]) * gaps
    return float(-np.log(prob).mean() + RIDGE / 2 * (w @ w)), np.concatenate([g_w, [g_theta.sum()], g_gaps])


def train(made: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, grades: int) -> Model:
    """A model from rows' features (buckets, values) and grades."""
    size = np.array([len(a) for a, _ in made])
    col, val = np.concatenate([a for a, _ in made]), np.concatenate([v for _, v in made])
    own, w = np.repeat(np.arange(len(y)), size), np.zeros(BUCKETS)
    share = np.clip(np.array([(y <= k).mean() for k in range(grades - 1)]), 1e-4, 1 - 1e-4)
    first = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 1e-3))
    p = np.concatenate([w, first[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):  # full-batch Adam: the sample is bounded
        g = slopes(p, y, own, col, val, grades)[1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(p[:BUCKETS].astype(np.float32), np.concatenate([p[BUCKETS : BUCKETS + 1], p[BUCKETS] + np.cumsum(np.exp(p[BUCKETS + 1 :]))]))


def _featured(batches):
    """Rows (h, key, grade, text) -> (h, key, grade, n, buckets, parts): a text's features as packed numbers."""
    for b in batches:
        made = [features(t) for t in b.column(3).cast(pa.binary()).to_pylist()]
        cols = [pa.array([len(a) for a, _ in made], pa.int64()), pa.array([a.astype(np.int32).tobytes() for a, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], names=["h", "key", "grade", "n", "buckets", "parts"])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """A model from docs and labels (key, grade) with grades 0, 1, 2, ..."""
    rows = labelled(docs, labels.where(F.col(labels.columns[1]) >= 0), MAX_TRAIN_ROWS, key, text).withColumnRenamed("label", "grade")
    rows = materialize(rows.select("h", "key", "grade", "text").mapInArrow(frugal(_featured), f"h long, key {rows.schema['key'].dataType.simpleString()}, grade int, n long, buckets binary, parts binary"), "quality-features")
    # Bounded: a row of the sample each, with the number of its features.
    upto = F.sum("n").over(Window.orderBy("h", "key").rangeBetween(Window.unboundedPreceding, 0))
    within = rows.select("h", "key", "grade", upto.alias("upto")).where(F.col("upto") <= MAX_FEATURES)
    n, top, last = within.agg(F.count("*"), F.max("grade"), F.max(F.struct("h", "key"))).first()
    if not n or not top:
        return Model(np.zeros(BUCKETS, np.float32), np.empty(0))

    def run(batches):
        grades, made = [], []
        for b in batches:
            grades += b.column(0).to_pylist()
            made += [(np.frombuffer(c, np.int32), np.frombuffer(v, np.float64)) for c, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        model = train(made, np.array(grades), top + 1)
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "thresholds": [model.thresholds.tobytes()]}, schema=pa.schema([("weights", pa.binary()), ("thresholds", pa.binary())]))

    one = rows.where((F.col("h") < last["h"]) | (F.col("h") == last["h"]) & (F.col("key") <= last["key"])).repartition(1).sortWithinPartitions("h", "key", "grade", "buckets", "parts").select("grade", "buckets", "parts")
    r = one.mapInArrow(frugal(run), "weights binary, thresholds binary").first()
    return Model(np.frombuffer(r["weights"], np.float32), np.frombuffer(r["thresholds"], np.float64))


def grade(docs: DataFrame, model: Model, at_least: int = 1, cut: float = 0.5, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, expected_grade, tail_probability (of a grade of at_least) and selected (tail_probability >= cut)."""
    sent = broadcast_checked(docs.sparkSession, model, model.weights.nbytes + model.thresholds.nbytes, "quality model")
    frame = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    made = [("expected_grade", T.DoubleType(), pa.float64()), ("tail_probability", T.DoubleType(), pa.float64()), ("selected", T.BooleanType(), pa.bool_())]
    schema = T.StructType([*frame.schema.fields[:-1], *(T.StructField(n, t) for n, t, _ in made)])

    def run(batches):
        model = sent.value
        for batch in batches:
            expected, tail = [], []
            for t in batch.column(len(keep)).cast(pa.binary()).to_pylist():
                col, val = features(t)
                tails = model.tails(float(model.weights[col] @ val))
                expected.append(float(tails.sum()))
                tail.append(1.0 if at_least <= 0 else float(tails[at_least - 1]) if at_least <= len(tails) else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array([p >= cut for p in tail], pa.bool_())], names=[*batch.schema.names[: len(keep)], *(n for n, _, _ in made)])

    return frame.mapInArrow(frugal(run), schema)
