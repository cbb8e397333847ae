"""Near-duplicate groups by b-bit MinHash: band buckets, packed signatures, bit-count estimates, exact confirmation.

1. Each text's set of word shingles gets minima under PERMUTATIONS hash functions. Bands of ROWS minima give bucket
   keys; the low BITS bits of every minimum are packed into a signature. Equal word sequences are one node.
2. In each bucket signatures are compared by XOR and bit count; the share of equal minima, corrected for chance collisions
   of BITS bits, estimates the similarity. Pairs estimated within MARGIN of the threshold connect, and components of these
   edges are loose clusters. Buckets beyond BUCKET_BLOCK members are settled against a representative first; only members
   that are not close to it are compared with all others, in pairs of blocks.
3. Within a loose cluster every pair is settled on full shingle sets: linked, not linked, or connected by others anyway.
   Clusters beyond CLUSTER_BLOCK members are sorted by several bands in turn and compared in blocks of neighbours, which connects
   nearly all that belongs together and sends each text once an order; only members outside the cluster's largest component
   after that are compared with all others, in pairs of blocks. So the work grows with the square of those members alone.

A link of the exact threshold is lost only if no band and no other path joins its two texts (below 1e-5 a pair at the
threshold itself, less above). At most one edge per member leaves a unit of work, no pair is emitted as a row, and no group is
gathered in one task: blocks are bounded, sorted groups span partitions, and keys with many rows are joined by broadcast.

Defined results: words are runs without ASCII white space after lower-casing A-Z; fewer words than a shingle form one
shingle; null, empty and blank texts have an empty set and are linked with nothing; equal texts are linked; rows that
repeat an id are one node; a null id is linked with nothing and kept; an empty table gives an empty result; extra columns are
ignored. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialize, partitions, with_groups
from .components import components

SHINGLE = 5
BANDS, ROWS, BITS = 24, 4, 4
PERMUTATIONS = BANDS * ROWS
MARGIN = 0.19  # about five standard deviations of the estimate at 0.85
BUCKET_BLOCK = 512  # members of a bucket compared at once
ORDERS = (0, 8, 16)  # bands by which large clusters are sorted
CLUSTER_BLOCK, CLUSTER_SHINGLES = 256, 400_000  # documents and shingles of a cluster compared at once
REMEMBER, LONGEST = 300_000, 64  # word hashes kept in a task, and bytes of a word that is kept

_rng = np.random.default_rng(20_240_817)
_MULTIPLY = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_FLIP = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_ODD = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.uint64(0x1111111111111111)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBER:
                self.clear()
            self[word] = h
        return h


def words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []  # bytes: A-Z and ASCII white space alone


def shingles(tokens: list[bytes], hashes: _Hashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    n = min(size, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        s += h[i : len(h) - n + 1 + i] * _ODD[i]
    return np.unique(_mix(s))


def minima(s: np.ndarray) -> np.ndarray:
    v = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(v), 512):
        np.minimum(best, ((v[i : i + 512, None] ^ _FLIP) * _MULTIPLY).min(axis=0), out=best)
    return best


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(BANDS, ROWS).astype(np.uint64)
    return _mix((rows * _ODD[8 : 8 + ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[20]).view(np.int64)


def pack(m: np.ndarray) -> np.ndarray:
    low = (m & np.uint32(2**BITS - 1)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures, rows of 64-bit words, corrected for chance collisions."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    differ = np.bitwise_count(x & _LANES).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-BITS
    return ((1 - differ / PERMUTATIONS) - chance) / (1 - chance)


def most_unequal(least: float) -> int:
    """Most minima that may differ where the estimate is to reach least."""
    return int(PERMUTATIONS * (1 - 2.0**-BITS) * (1 - least) + 1e-9)


def unequal(a: Column, b: Column) -> Column:
    """Number of packed minima that differ, for signatures as arrays of longs."""
    total = F.lit(0)
    for i in range(PERMUTATIONS * BITS // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(int(_LANES))))
    return total


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row it is connected with by the pairs."""
    root = np.arange(n)
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _sign(size: int):
    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            seq, count, bands, sigs = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                tokens = words(text)
                s = shingles(tokens, hashes, size)
                count.append(len(s))
                if not len(s):
                    for c in (seq, bands, sigs):
                        c.append(None)
                    continue
                m = minima(s)
                seq.append(xxhash.xxh3_128_digest(b" ".join(tokens)))
                bands.append(band_keys(m))
                sigs.append(pack(m))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seq, pa.binary()), pa.array(count, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "seq", "n_shingles", "bands", "sig"])

    return run


def _groups(batches, columns: int):
    """Batches re-cut so that rows with equal first three columns (sorted) stay together; small groups share a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        keys = [batch.column(i).to_numpy() for i in range(3)]
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            same &= k == k[-1]
        cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if len(held) > 1 and cut == 0:
            first = held[0]
            if all(first.column(i)[-1].as_py() == batch.column(i)[0].as_py() for i in range(3)):
                continue
        whole = pa.Table.from_batches(held).combine_chunks()
        done = whole.num_rows - batch.num_rows + cut
        if done:
            yield whole.slice(0, done)
        rest = whole.slice(done)
        held = rest.combine_chunks().to_batches() if rest.num_rows else []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(group number of each row, start of each group) by the first three columns."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for i in range(3):
        k = table.column(i).to_numpy()
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _edges_schema():
    return pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _loose(least: float):
    """Rows (band, i, j, side, id, sig), sorted: edges between members whose signatures are close.

    Members of side -1 are compared with all others of their unit, sides 0 and 1 with each other.
    """

    def run(batches):
        for table in _groups(batches, 6):
            group, starts = _starts(table)
            sizes = np.diff(np.append(starts, table.num_rows))
            many = np.repeat(sizes, sizes) > 1
            if not many.any():
                continue
            group, at = group[many], np.flatnonzero(many)
            small = table.take(pa.array(at))
            left = np.repeat(sizes, sizes)[many] - (at - starts[group])  # rows of the group from here on
            ids, side = small.column("id").to_numpy(), small.column("side").to_numpy()
            sig = small.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
            found_a, found_b = [], []
            for d in range(1, int(left.max())):
                k = np.flatnonzero(left > d)
                k = k[(side[k] < 0) | (side[k] != side[k + d])]
                for s in range(0, len(k), 65_536):
                    part = k[s : s + 65_536]
                    close = part[estimate(sig[part], sig[part + d]) >= least]
                    found_a.append(close)
                    found_b.append(close + d)
            if not found_a:
                continue
            root = local_roots(len(ids), np.concatenate(found_a), np.concatenate(found_b))
            moved = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], schema=_edges_schema())

    return run


def similar_pairs(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose sets have 100 * intersection >= percent * union; with side, only pairs of unequal side."""
    n, size = len(sets), np.array([len(s) for s in sets])
    if n <= 6:
        a, b = np.triu_indices(n, 1)
        inter = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) if min(size[i], size[j]) * 100 >= percent * max(size[i], size[j]) else 0 for i, j in zip(a, b, strict=True)], np.int64)
    else:
        own = np.repeat(np.arange(n), size)
        _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = count[inverse] > 1
        own, number = own[common], (np.cumsum(count > 1) - 1)[inverse[common]]
        total, width = np.zeros((n, n), np.float32), 8192
        order = np.argsort(number, kind="stable")
        own, number = own[order], number[order]
        for lo in range(0, int(number[-1]) + 1 if len(number) else 0, width):
            s, e = np.searchsorted(number, (lo, lo + width))
            x = np.zeros((n, width), np.float32)
            x[own[s:e], number[s:e] - lo] = 1
            total += x @ x.T  # counts stay below 2**24: exact in single precision
        a, b = np.triu_indices(n, 1)
        inter = total[a, b].astype(np.int64)
    link = 100 * inter >= percent * (size[a] + size[b] - inter)
    if side is not None:
        link &= side[a] != side[b]
    return a[link], b[link]


def _links(ids, texts, percent: int, size: int, hashes: _Hashes, side=None, label=None):
    """Edges (a, b) that connect what full sets link; pairs of one label are connected already."""
    sets = [shingles(words(t), hashes, size) for t in texts]
    a, b = similar_pairs(sets, percent, side)
    if label is not None:
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    root = local_roots(len(sets), a, b) if len(a) else np.arange(len(sets))
    moved = np.flatnonzero(root != np.arange(len(sets)))
    return ids[moved], ids[root[moved]]


def _edges(found):
    a, b = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=_edges_schema())


def _confirm(percent: int, size: int):
    """Rows (root, i, j, side, id, label, text), sorted: edges between members of a unit that are similar enough on full sets."""

    def run(batches):
        hashes = _Hashes()
        for table in _groups(batches, 7):
            _, starts = _starts(table)
            ids, side, label = (table.column(c).to_numpy() for c in ("id", "side", "label"))
            texts, found = table.column("text"), []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                crossed = side[s] >= 0
                if e - s > 1 and not (crossed and side[s:e].min() == side[s:e].max()):
                    found.append(_links(ids[s:e], texts.slice(s, e - s).cast(pa.binary()).to_pylist(), percent, size, hashes, side[s:e] if crossed else None, label[s:e] if crossed else None))
            if found:
                yield _edges(found)

    return run


def _neighbours(percent: int, size: int, block: int, weightiest: int):
    """Rows (order, root, id, n_shingles, text), sorted by likeness within a root: edges found in blocks of neighbours."""

    def run(batches):
        hashes, held, weight, mine, texts = _Hashes(), [], 0, None, []
        for batch in batches:
            for order, root, i, n, text in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4).cast(pa.binary()).to_pylist(), strict=True):
                if (order, root) != mine or len(held) >= block or weight + n > weightiest:
                    if len(held) > 1:
                        yield _edges([_links(np.array(held), texts, percent, size, hashes)])
                    held, texts, weight, mine = [], [], 0, (order, root)
                held.append(i)
                texts.append(text)
                weight += n
        if len(held) > 1:
            yield _edges([_links(np.array(held), texts, percent, size, hashes)])

    return run


def _crossed(rows: DataFrame, key: str, n: str, n_open: str, columns: list[str]) -> DataFrame:
    """Rows (key, i, j, side, columns) that meet open rows (side 0) in blocks of n_open with all rows (side 1) in blocks of n."""
    mine = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))
    opened = rows.where("open").select(key, mine(n_open).alias("i"), every(n).alias("j"), F.lit(0).alias("side"), *columns)
    return opened.unionByName(rows.select(key, every(n_open).alias("i"), mine(n).alias("j"), F.lit(1).alias("side"), *columns))


def _whole(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of small groups, each a unit of its own."""
    return rows.select(key, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("side"), *columns)


def _dealt(units: DataFrame, key: str) -> DataFrame:
    return units.repartition(partitions(units.sparkSession), key, "i", "j").sortWithinPartitions(key, "i", "j", "id")


def _loose_clusters(heads: DataFrame, least: float) -> DataFrame:
    """(node, root) by edges between close signatures in the buckets."""
    members = heads.select(F.explode("bands").alias("band"), "id", "sig")
    large = members.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("head")).where(F.col("n") > BUCKET_BLOCK)
    large = materialize(large, "minhash-large")
    compared = lambda units: _dealt(units, "band").mapInArrow(frugal(_loose(least)), "a long, b long")
    if large.isEmpty():
        return components(compared(_whole(members, "band", ["id", "sig"])))
    first = heads.groupBy("id").agg(F.min("sig").alias("head_sig"))  # one text of an id that has several
    large = materialize(large.join(first.withColumnRenamed("id", "head"), "head"), "minhash-large")
    tagged = with_groups(members, large, "band")
    close = unequal(F.col("sig"), F.col("head_sig")) <= most_unequal(least)
    within = materialize(tagged.where("n is not null").select("band", "id", "sig", "head", "n", (~close).alias("open")), "minhash-buckets")
    star = within.where("not open").select(F.col("id").alias("a"), F.col("head").alias("b"))
    blocks = lambda c: F.ceil(F.col(c) / BUCKET_BLOCK)
    open_ = within.where("open").groupBy("band").agg(F.count("*").alias("n_open"), F.max("n").alias("rows"))
    open_ = materialize(open_.select("band", "rows", blocks("rows").alias("blocks"), blocks("n_open").alias("n_open")), "minhash-open")
    far = with_groups(within.drop("n"), open_, "band", "rows").where("rows is not null")
    units = _whole(tagged.where("n is null"), "band", ["id", "sig"]).unionByName(_crossed(far, "band", "blocks", "n_open", ["id", "sig"]))
    return components(compared(units).unionByName(star))


def _linked(clusters: DataFrame, nodes: DataFrame, percent: int, size: int) -> DataFrame:
    """(node, root) by links on full sets within loose clusters (cluster, id, n_shingles, text); nodes: (id, bands)."""
    compared = lambda units: _dealt(units, "cluster").mapInArrow(frugal(_confirm(percent, size)), "a long, b long")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    large = materialize(sizes.where((F.col("n") > CLUSTER_BLOCK) | (F.col("weight") > CLUSTER_SHINGLES)), "minhash-clusters")
    tagged = with_groups(clusters, large, "cluster")
    small = compared(_whole(tagged.where("n is null"), "cluster", ["id", F.col("id").alias("label"), "text"]))
    if large.isEmpty():
        return components(small)
    within = tagged.where("n is not null").select("cluster", "id", "n_shingles", "text")
    likes = F.array(*(F.get("bands", F.lit(b)) for b in ORDERS))
    ordered = within.join(nodes.groupBy("id").agg(F.max(likes).alias("likes")), "id").select("cluster", "id", "n_shingles", "text", F.posexplode("likes").alias("order", "like"))
    ordered = ordered.repartitionByRange(partitions(ordered.sparkSession), "order", "cluster", "like", "id").sortWithinPartitions("order", "cluster", "like", "id")
    near = ordered.select("order", "cluster", "id", "n_shingles", "text").mapInArrow(frugal(_neighbours(percent, size, CLUSTER_BLOCK, CLUSTER_SHINGLES)), "a long, b long")
    edges = materialize(small.unionByName(near), "minhash-links")
    so_far = components(edges)

    # What lies outside its cluster's largest component is compared with all of the cluster that it isn't connected with.
    names = within.select("cluster", "id").distinct().join(so_far, F.col("id") == F.col("node"), "left").select("cluster", "id", F.coalesce("root", "id").alias("label"))
    names = materialize(names, "minhash-labels")
    counts = names.groupBy("cluster", "label").agg(F.count("*").alias("m"))
    largest = counts.groupBy("cluster").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("all"))
    open_ = largest.where("all > top.m").select("cluster", F.col("top.label").alias("settled"), ((F.col("all") - F.col("top.m")) / F.col("all")).alias("share"))
    blocks = F.greatest(F.col("n") / CLUSTER_BLOCK, F.col("weight") / CLUSTER_SHINGLES)  # open members are taken for as long as the others
    open_ = large.join(open_, "cluster").select("cluster", "n", "settled", F.ceil(blocks).alias("blocks"), F.ceil(blocks * F.col("share")).alias("n_open"))
    open_ = materialize(open_, "minhash-open")
    if open_.isEmpty():
        return so_far
    left = with_groups(names, open_, "cluster").where("n is not null").select("id", "label", "blocks", "n_open", (F.col("label") != F.col("settled")).alias("open"))
    return components(edges.unionByName(compared(_crossed(within.join(left, "id"), "cluster", "blocks", "n_open", ["id", "label", "text"]))))


def groups(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text", size: int = SHINGLE, ties: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: key, n_shingles, component_id (smallest key reachable by links) and kept.

    Of a component the row of least ties (nulls last), then of least key is kept.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"tie{i}") for i, c in enumerate(ties)))
    signed = rows.select("doc_id", "text").mapInArrow(frugal(_sign(size)), "doc_id long, seq binary, n_shingles long, bands array<long>, sig array<long>")
    signed = materialize(signed, "minhash-signatures")
    known = signed.where("seq is not null and doc_id is not null")
    # Rows of one word sequence agree in all but their id.
    nodes = materialize(known.groupBy("seq").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sig"))), "minhash-nodes")
    loose = _loose_clusters(nodes.select("id", "bands", "sig"), percent / 100 - MARGIN)
    members = nodes.join(loose, F.col("id") == F.col("node")).select(F.col("root").alias("cluster"), "id", "n_shingles")
    members = materialize(members, "minhash-members")
    texts = rows.select(F.col("doc_id").alias("id"), "text")
    repeated = materialize(known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("doc_id", "id"), "minhash-repeated")
    if not repeated.isEmpty():  # one row for each text of an id that several rows have
        texts = with_groups(texts, repeated, "id")
        texts = texts.where("n is null").select("id", "text").unionByName(texts.where("n is not null").select("id", "text").distinct())
        members = members.groupBy("cluster", "id").agg(F.max("n_shingles").alias("n_shingles"))
    clusters = materialize(texts.join(members, "id"), "minhash-texts")
    exact = _linked(clusters, nodes.select("id", "bands"), percent, size)

    named = nodes.select("seq", "id", "n").join(exact, F.col("id") == F.col("node"), "left").select("seq", "n", F.coalesce("root", "id").alias("component"))
    named = materialize(named, "minhash-named")
    found = with_groups(known.select("doc_id", "seq", "n_shingles"), named, "seq").drop("seq", "n")
    best = F.col("component")
    if ties:
        found = materialize(found, "minhash-found")
        rank = F.struct(*(x for i in range(len(ties)) for x in (F.col(f"tie{i}").isNull().alias(f"u{i}"), F.col(f"tie{i}"))), "doc_id")
        first = found.join(rows.drop("text"), "doc_id").groupBy("component").agg(F.min(rank)["doc_id"].alias("first"), F.count("*").alias("n"))
        found, best = with_groups(found, materialize(first, "minhash-first"), "component"), F.col("first")
    found = found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == best).alias("kept"))
    alone = signed.where("seq is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return found.unionByName(alone).withColumnRenamed("doc_id", key)
