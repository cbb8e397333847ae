"""URL allow and block lists as a trie over reversed host labels and path segments.

Rules (host, path, verdict) fit their host and all its subdomains where the url's path starts with
the rule's. The longest rule wins: the one with most host labels, then the longest path; of one rule
given twice, the first counts. The trie is broadcast below a size bound; beyond it the rules are cut
into tries below the bound, run one after another, and the longest of their matches wins. A single rule beyond the bound raises.

Defined results: a null url or one without `://` has an empty host and path, fits no rule and gets the
default verdict; empty tables give an empty result; columns of the input other than the url pass through
untouched unless their name is one of the results', which replace them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, ascii_lower, broadcast_checked

Rule = tuple[str, str, str]  # host, path, allow or block
NODE_BYTES = 400  # more than a trie node with its rule takes


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Node:
    __slots__ = ("labels", "segments", "starts", "whole")

    def __init__(self):
        self.labels: dict[str, Node] = {}  # next host label, from the right
        self.segments: dict[str, Node] = {}  # next whole path segment
        self.starts: list[tuple[str, tuple[str, str]]] = []  # start of the next segment, longest first
        self.whole: tuple[str, str] | None = None  # a rule without a path


class Trie:
    def __init__(self, rules: Iterable[Rule]):
        self.root = Node()
        for host, path, verdict in rules:
            if verdict not in ("allow", "block") or not host or (path and path[0] != "/"):
                raise ValueError(f"not a rule: {(host, path, verdict)}")
            node, found = self.root, (host + path, verdict)
            for label in reversed(host.split(".")):
                node = node.labels.setdefault(label, Node())
            if not path:
                node.whole = node.whole or found
                continue
            *full, start = path[1:].split("/")
            for segment in full:
                node = node.segments.setdefault(segment, Node())
            if all(s != start for s, _ in node.starts):
                node.starts.append((start, found))
                node.starts.sort(key=lambda x: -len(x[0]))

    def match(self, host: str, path: str) -> tuple[str, str, int, int] | None:
        """Rule, verdict, host labels and path length of the longest rule that fits."""
        node, best = self.root, None
        segments = path[1:].split("/") if path else []
        for depth, label in enumerate(reversed(host.split(".")), 1):
            node = node.labels.get(label)
            if node is None:
                break
            if found := self._path(node, segments):
                best = (*found[0], depth, found[1])
        return best

    @staticmethod
    def _path(node: Node, segments: list[str]) -> tuple[tuple[str, str], int] | None:
        best, length = (node.whole, 0) if node.whole else (None, 0), 0
        for segment in segments:
            for start, found in node.starts:
                if segment.startswith(start):
                    best = (found, length + 1 + len(start))
                    break
            node = node.segments.get(segment)
            if node is None:
                break
            length += len(segment) + 1
        return best if best[0] else None


def blocks(rules: Iterable[Rule], limit: int) -> Iterator[tuple[list[Rule], int]]:
    """The rules in lists whose tries stay below the limit in bytes, with the bytes; a rule beyond the limit stands alone."""
    block, size = [], 0
    for rule in rules:
        own = NODE_BYTES * (2 + rule[0].count(".") + rule[1].count("/")) + 8 * (len(rule[0]) + len(rule[1]))
        if block and size + own > limit:
            yield block, size
            block, size = [], 0
        block.append(rule)
        size += own
    if block:
        yield block, size


def judge(urls: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow", limit: int = BROADCAST_BYTES) -> DataFrame:
    """urls with host, path, rule (null where none fits) and verdict."""
    spark = urls.sparkSession
    made = ("host", "path", "rule", "verdict")
    frame = urls.withColumn("__host", host(F.col(url))).withColumn("__path", path(F.col(url)))
    kept = [c for c in urls.columns if c not in made]
    frame = frame.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(0).alias("__labels"), F.lit(-1).alias("__length"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in frame.schema.fields])
    at = len(kept)
    for block, size in blocks(rules, limit):
        trie = broadcast_checked(spark, Trie(block), size, "url trie")

        def run(batches, trie=trie):
            match = trie.value.match
            for b in batches:
                before = list(zip(*(b.column(at + i).to_pylist() for i in range(2, 6)), strict=True))
                got = []
                for h, p, old in zip(b.column(at).to_pylist(), b.column(at + 1).to_pylist(), before, strict=True):
                    new = match(h, p)
                    got.append(new if new and new[2:] > old[2:] else old)
                cols = list(zip(*got, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([*b.columns[: at + 2], *(pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True))], names=b.schema.names)

        frame = frame.mapInArrow(run, schema)
    return frame.drop("__labels", "__length")
