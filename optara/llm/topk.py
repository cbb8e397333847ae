"""Exact top-k by inner product with multi-resolution segment statistics.

For a cut of the dimensions into equal segments, q.x is at most sum(L mean_q mean_x + dev_q dev_x), dev being
the root of the summed squared deviations from the segment's mean; since |q-x|^2 = |q|^2 + |x|^2 - 2 q.x, this is
the lower bound on the distance that segment means and deviations give. Bounds run from coarse to fine against
each query's k-th best score so far, which starts with its k-th best among a sample of the vectors; exact integer scores are
computed for what survives.

Queries come in blocks bounded in bytes, each broadcast to every task that holds vectors: vectors are never
shuffled, and only k rows a query leave each task. Results per task are merged by a windowed rank. A block is a pass over
the vectors, so there is a job for each 16 MB of queries (as doubles; some 32,000 of 64 dimensions).

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, neither do
pairs of different length; rows with a query's own id are not its candidates; rows that share an id are each a
candidate, and as a query the largest of their vectors counts; rows without an id take no part; ties go to the smaller vec_id;
fewer candidates than k give fewer rows. Scores beyond 64 bits are clamped. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_checked, frugal, materialize

BLOCK_BYTES = 32 << 20  # of queries (as doubles) broadcast at once; whole numbers travel in fewer
QUERIES, ROWS = 2048, 2048  # queries and vectors compared at once
SAMPLE, SAMPLE_BYTES = 4096, 8 << 20  # vectors that give each query a first bound
DENSE = 16  # where fewer than one in so many pairs survives, they are computed one by one
LEVELS = (1, 4, 16)  # segments, coarse to fine
EXACT = 2.0**53
LONG = 2**63 - 1


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Features whose inner products bound the vectors' inner products: scaled means, then deviations."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    means, devs = [], []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = x[:, a:b]
        mean = part.mean(axis=1)
        means.append(mean * np.sqrt(b - a))
        devs.append(np.sqrt(np.square(part - mean[:, None]).sum(axis=1)))
    return np.stack([*means, *devs], axis=1)


def compact(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them; doubles where none does."""
    top = np.abs(x).max(initial=0)
    for kind in (np.int16, np.int32):
        if top <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def products(a: np.ndarray, b: np.ndarray, rows: np.ndarray | None = None, cols: np.ndarray | None = None) -> np.ndarray:
    """Exact inner products of all rows of a with all of b, or of the pairs (rows, cols) alone; beyond 64 bits clamped."""
    limit = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if limit < EXACT:  # sums of whole products below 2**24 are exact in floats, below 2**53 in doubles
        kind = np.float32 if limit < 2.0**24 else np.float64
        a, b = a.astype(kind), b.astype(kind)
        return (a @ b.T if rows is None else np.einsum("ij,ij->i", a[rows], b[cols])).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    a, b = whole(a), whole(b)
    found = a @ b.T if rows is None else (a[rows] * b[cols]).sum(axis=1)
    return np.vectorize(lambda v: max(-LONG, min(LONG, v)), otypes=[np.int64])(found) if found.size else np.zeros(found.shape, np.int64)


class Block:
    """Queries of one length with their statistics, a lower bound on their k-th best score, and the best k found so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.x, self.k, self.least = ids, vectors, k, least.copy()
        x = vectors.astype(float)
        self.levels = [statistics(x, s) for s in LEVELS]
        self.norm = np.sqrt(np.square(x).sum(axis=1))
        self.at, self.score, self.found = (np.zeros(0, np.int64) for _ in range(3))  # query, score and vec_id of what may be among the best
        self.compared = self.survived = 0

    def take(self, ids: np.ndarray, x: np.ndarray) -> None:
        norm = np.sqrt(np.square(x).sum(axis=1))
        slack = 1e-9 * self.norm[:, None] * norm[None, :] + 1e-6
        alive = self.ids[:, None] != ids[None, :]
        self.compared += int(alive.sum())
        for segments, mine in zip(LEVELS, self.levels, strict=True):
            rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            if not len(rows):
                return
            part = np.ix_(rows, cols)
            alive[part] &= mine[rows] @ statistics(x[cols], segments).T + slack[part] >= self.least[rows, None]
        at, col = np.nonzero(alive)
        if not len(at):
            return
        self.survived += len(at)
        whole = compact(x)
        if len(at) * DENSE < alive.size:
            score = products(self.x, whole, at, col)
        else:
            score = products(self.x, whole)[at, col]
        good = score >= self.least[at]
        self._keep(at[good], score[good], ids[col[good]])

    def _keep(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge more candidates: the k best of each query stay, ties to the smaller id, and the bounds rise."""
        at, score, ids = (np.concatenate(c) for c in ((self.at, at), (self.score, score), (self.found, ids)))
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        kept = place < self.k
        self.at, self.score, self.found = at[kept], score[kept], ids[kept]
        last = place == self.k - 1
        self.least[at[last]] = np.maximum(self.least[at[last]], score[last])


def _prepared(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """floor(scale * component) as an array of doubles; rows that take no part are gone."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fit = F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), x.alias("x")).where(fit & F.col("vec_id").isNotNull())
    return rows.select("vec_id", F.transform("x", lambda v: _floor(v * scale)).alias("x"))


def _floor(v: Column) -> Column:
    """floor as a double, also beyond 64 bits, where every double is whole."""
    return F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v)


def _arrays(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) for each length among the vectors."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    out = []
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out.append((at, flat[(offsets[at][:, None] + np.arange(n)[None, :])]))
    return out


def _seeded(sample, k: int):
    """Rows (vec_id, x) -> with the k-th best score among the sample's vectors of their length, a bound that all tasks share."""

    def run(batches):
        for batch in batches:
            least, ids = np.full(batch.num_rows, -np.inf), batch.column(0).to_numpy()
            for at, m in _arrays(batch.column(1)):
                known, own = sample.value.get(m.shape[1], (None, None))
                if known is None or len(known) <= k:
                    continue
                whole = compact(m)
                for s in range(0, len(at), ROWS):
                    part = at[s : s + ROWS]
                    score = products(whole[s : s + ROWS], own).astype(float)
                    score[ids[part][:, None] == known[None, :]] = -np.inf
                    least[part] = np.partition(score, len(known) - k, axis=1)[:, len(known) - k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least, pa.float64())], names=["vec_id", "x", "least"])

    return run


def _by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, ...]]:
    """Columns (vec_id, x, ...) of a collected table as (ids, matrix, ...) by length of the vectors."""
    if not table.num_rows:
        return {}
    ids, x = table.column("vec_id").to_numpy(), table.column("x").combine_chunks()
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    rest = [table.column(c).to_numpy() for c in table.column_names[2:]]
    return {m.shape[1]: (ids[at], compact(m), *(c[at] for c in rest)) for at, m in _arrays(x)}


def _sent(spark, held: dict, what: str):
    return broadcast_checked(spark, held, sum(c.nbytes for group in held.values() for c in group), what)


def _compared(sent, k: int, count=None):
    """Vectors (vec_id, x) against the queries sent: the k best of each query in this task."""

    def run(batches):
        held = {n: [Block(i[s : s + QUERIES], m[s : s + QUERIES], least[s : s + QUERIES], k) for s in range(0, len(i), QUERIES)] for n, (i, m, least) in sent.value.items()}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, m in _arrays(batch.column(1)):
                for s in range(0, len(at), ROWS):
                    for block in held.get(m.shape[1], ()):
                        block.take(ids[at[s : s + ROWS]], m[s : s + ROWS])
        for block in (b for group in held.values() for b in group):
            if count is not None:
                count(block)
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[block.at], pa.int64()), pa.array(block.found, pa.int64()), pa.array(block.score, pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose key is_query picks, its k best other rows."""
    spark = vectors.sparkSession
    rows = materialize(_prepared(vectors, key, vector, scale), "topk-vectors")
    width, n = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(1)), F.count("*")).first()
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(4 * k, min(SAMPLE, SAMPLE_BYTES // (8 * width)))) if n else rows
    sample = _sent(spark, _by_length(some.toArrow()), "sample of vectors")
    queries = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.max("x").alias("x"))
    queries = materialize(queries.mapInArrow(frugal(_seeded(sample, k)), "vec_id long, x array<double>, least double"), "topk-queries")
    size = queries.agg(F.coalesce(F.sum(F.size("x") * 8 + 24), F.lit(0))).first()[0]
    blocks = max(1, -(-size * 2 // block_bytes))  # half full on average: the hash deals unevenly
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        sent = _sent(spark, _by_length(queries.where(F.col("block") == b).select("vec_id", "x", "least").toArrow()), "query block")
        part = rows.mapInArrow(frugal(_compared(sent, k)), "query_id long, vec_id long, score long")
        if blocks > 1:
            part = materialize(part, "topk-block")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
