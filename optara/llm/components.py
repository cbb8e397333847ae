"""Connected components of an edge table by hook and contract, without any driver-side graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialize

SMALL = 1_000_000  # edges that one task settles; more are contracted by all until so few are left


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, root) for every node of the edges (a, b), two longs: root is the component's smallest node.

    Up to small edges, a bound of 16 bytes each, are settled in one task. Of more, each round hooks every node to its smallest neighbour below it, flattens the trees by pointer doubling and
    contracts the edges to the roots. Rounds are logarithmic; each is written to the shared folder, so that a lost
    executor costs a re-read. Aggregations combine before their shuffles, so stars of any size stay spread.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    done = None
    while (count := edges.count()) > small:
        hooks = edges.groupBy("a").agg(F.min("b").alias("p"))  # every node with a smaller neighbour points down
        tree = materialize(hooks, "hooks")
        while True:  # pointer doubling; roots have no row of their own
            up = tree.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            tree = materialize(tree.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "tree")
            moved = not tree.where("moved").isEmpty()
            tree = tree.select("a", "p")
            if not moved:
                break
        done = tree if done is None else materialize(_through(done, "p", tree).unionByName(tree), "components")
        left = edges.join(tree.withColumnsRenamed({"a": "x", "p": "ra"}), F.col("a") == F.col("x"), "left").select(F.coalesce("ra", "a").alias("a"), "b")
        left = _through(left, "b", tree).where("a <> b")
        edges = materialize(left.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if count:
        tree = materialize(edges.coalesce(1).mapInArrow(frugal(_settle), "a long, p long"), "tree")
        done = tree if done is None else materialize(_through(done, "p", tree).unionByName(tree), "components")
    if done is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = done.select(F.col("p").alias("node")).distinct()
    return done.select(F.col("a").alias("node"), F.col("p").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def _settle(batches):
    """Edges (a, b) of a bounded graph -> (a, p): each node that isn't its component's smallest, and that one."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    a, b = (np.concatenate(c) for c in zip(*held, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "p"])


def _through(df: DataFrame, column: str, tree: DataFrame) -> DataFrame:
    """df with the column's nodes replaced by their roots in the tree."""
    t = tree.select(F.col("a").alias("__a"), F.col("p").alias("__p"))
    return df.join(t, df[column] == t["__a"], "left").withColumn(column, F.coalesce("__p", column)).drop("__a", "__p")
