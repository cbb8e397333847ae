"""Exact deduplication by content sort.

Texts are equal when identical without ASCII white space. Rows are range-partitioned by sampled splitters over the first
PREFIX characters of the normalised text, its digest and the order within equals (longest original text, then the ties), and
sorted externally in each partition by the same with the whole normalised text after the digest. So equal texts stand next to
each other, a group of copies of any size spreads over as many partitions as its rows need, and full comparisons of
neighbours tell where one text ends and the next begins. The first row of a run is the one that stays.

Runs that lie within one partition are settled there. Only the first and the last run of a partition may go on beside it:
those, two rows a partition, are compared with their neighbours in full, and what they amount to together is sent to all tasks.
No group is shuffled by its key.

Defined results: null text counts as empty, and texts without a visible character are all equal; of rows that
repeat an id in one group, one can be kept; a null id sorts last; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, materialize, partitions

SPACE = r"[\x20\x09-\x0D]+"
PREFIX = 32  # characters of the text in a splitter: the driver holds a sample of these, with 32 bytes of digest and the ties


def _runs(batches):
    """Sorted rows (key, sha, part, norm) -> key, sha, part, run, keep, size, first and border.

    run numbers the runs of equal texts in a partition; keep is the key of its first row and size its rows in this partition.
    border holds the text at the first row of a partition's first and last run, which may go on in other partitions; run is
    null in all others, which are complete. Only keys and digests of a run are held until it ends, no texts.
    """
    held: list[pa.Table] = []
    run, last, opening = 0, None, None

    def settled(rows: pa.Table, numbers: np.ndarray, border: dict[int, str | None]) -> pa.RecordBatch:
        starts = np.flatnonzero(np.diff(numbers, prepend=-1))
        sizes = np.diff(np.append(starts, len(numbers)))
        of = np.repeat(np.arange(len(starts)), sizes)
        first = np.zeros(len(numbers), bool)
        first[starts] = True
        texts = [border.get(int(numbers[i])) for i in starts]
        at = np.where(first, of, -1)
        out = [rows.column(i).combine_chunks() for i in range(3)]
        out = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in out]
        edge = np.isin(numbers, list(border))
        return pa.RecordBatch.from_arrays(
            [*out, pa.array(numbers, pa.int64(), mask=~edge), out[0].take(pa.array(starts[of])), pa.array(sizes[of], pa.int64()), pa.array(first), pa.array(texts, pa.string()).take(pa.array(at, pa.int64(), mask=at < 0))],
            names=["key", "sha", "part", "run", "keep", "size", "first", "border"],
        )

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        text, rows = batch.column(3), pa.Table.from_batches([batch.select([0, 1, 2])])
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = ~pc.equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        head = text[0].as_py()
        new[0] = last is None or head != last
        opening = head if last is None else opening
        ends = np.flatnonzero(new) if last is not None else np.flatnonzero(new)[1:]  # rows before which a run ends
        if len(ends):
            cut, before = int(ends[-1]), sum(t.num_rows for t in held)
            numbers = run + np.cumsum(new[:cut]) if last is not None else np.cumsum(new[:cut]) - 1
            done = pa.concat_tables([*held, rows.slice(0, cut)])
            yield settled(done, np.concatenate([np.full(before, run), numbers]).astype(np.int64), {0: opening})
            run, held, rows = run + len(ends), [], rows.slice(cut)
        held.append(rows)
        last = text[n - 1].as_py()
    if held:
        done = pa.concat_tables(held)
        yield settled(done, np.full(done.num_rows, run, np.int64), {run: last})


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", ties: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256. Of texts of one length, the least of ties, then of key, stays."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.length(whole).alias("length"), F.regexp_replace(whole, SPACE, "").alias("norm"), *(F.col(c).alias(f"tie{i}") for i, c in enumerate(ties)))
    rows = rows.withColumns({"prefix": F.substring("norm", 1, PREFIX), "sha": F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256))})
    within = [F.col("length").desc(), *(F.col(c).asc_nulls_last() for c in (*(f"tie{i}" for i in range(len(ties))), "key"))]
    spread = rows.repartitionByRange(partitions(spark), "prefix", "sha", *within).sortWithinPartitions("prefix", "sha", "norm", *within)
    spread = spread.select("key", "sha", F.spark_partition_id().alias("part"), "norm")
    kind = spread.schema["key"].dataType
    runs = materialize(spread.mapInArrow(frugal(_runs), f"key {kind.simpleString()}, sha binary, part int, run long, keep {kind.simpleString()}, size long, first boolean, border string"), "dedup-runs")

    # Two rows a partition at most.
    edges = runs.where(F.col("run").isNotNull() & F.col("first")).select("part", "run", "keep", "size", "border")
    order = sorted(edges.select("part", "run", "keep", "size").collect(), key=lambda r: (r["part"], r["run"]))
    place = spark.createDataFrame([(r["part"], r["run"], i) for i, r in enumerate(order)], "part int, run long, at long")
    placed = edges.select("part", "run", "border").join(F.broadcast(place), ["part", "run"]).select("at", "part", "border")
    left, right = placed.alias("l"), placed.alias("r")
    same = left.join(right, (F.col("l.at") + 1 == F.col("r.at")) & (F.col("l.border") == F.col("r.border")) & (F.col("l.part") < F.col("r.part")))
    goes_on = {r[0] for r in same.select("l.at").collect()}
    merged, i = [], 0
    while i < len(order):
        j = i
        while j in goes_on:
            j += 1
        size = sum(r["size"] for r in order[i : j + 1])
        merged += [(r["part"], r["run"], order[i]["keep"], size, k == 0) for k, r in enumerate(order[i : j + 1])] if j > i else []
        i = j + 1
    schema = T.StructType([T.StructField(n, t) for n, t in (("p", T.IntegerType()), ("r", T.LongType()), ("whole_keep", kind), ("whole_size", T.LongType()), ("begins", T.BooleanType()))])
    across = F.broadcast(spark.createDataFrame(merged, schema))
    found = runs.join(across, (F.col("part") == F.col("p")) & (F.col("run") == F.col("r")), "left")
    beyond = F.col("p").isNotNull()
    return found.select(
        F.col("key").alias(key), F.when(beyond, F.col("whole_keep")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("whole_size", "size").alias("group_size"),
        (F.col("first") & F.coalesce("begins", F.lit(True))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
