"""BPE encoding and decoding with a public tokenizer; long unsplit pieces by tree concatenation.

Tokenizers of the word kind (WORD_SPLIT) drop white space and never merge across it: their texts are cut at ASCII white
space, and pieces are encoded once while a process remembers them. Texts of other kinds go to the library whole. A pre-token longer than LEAF symbols is encoded as a tree: its halves are encoded on their own (the
leaves together in one parallel call), then a window around each join is re-encoded and grown until its first token is
the left half's token there and one of its later tokens is the right half's token there. A sequence of tokens is a
valid encoding exactly if each adjacent pair is, and all pairs of the joined sequence lie in the left half, the window
or the right half, so the joined sequence is the encoding of the whole.

Defined results: null and empty texts have no tokens and decode to the empty text; repeated rows give equal results;
whole texts are encoded, however long; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal

PIECE = re.compile(r"[^\x20\x09-\x0D]+")
LEAF = 2048  # characters of a pre-token encoded in one go
WINDOW = 32  # tokens on each side of a join at first
REMEMBER = 160_000  # pieces, and words, kept in a process in each of two generations
REMEMBER_CHARS = 16 << 20  # characters of them with their ids and decoded texts, at most
#: Fixed value: the pre-tokenizer pattern of the word kind.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A piece of Latin letters and closing punctuation: two pre-tokens, whose letters lower-case one by one.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


def byte_symbols() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: Lower-case letters of SIMPLE beyond ASCII as the byte-level step writes them.
LATIN = {c: "".join(byte_symbols()[b] for b in chr(c).encode()) for c in range(0xDF, 0x100) if c != 0xF7}


@cache
def load(path: str):
    """The tokenizer of a file, with truncation and padding off; one per process."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@cache
def load_bare(path: str):
    """The file's model alone, for strings that are normalised and pre-tokenized already."""
    from tokenizers import Tokenizer

    spec = json.loads(load(path).to_str()) | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
    return Tokenizer.from_str(json.dumps(spec))


class Recent(dict):
    """A dictionary of two generations, bounded in entries and characters: what isn't asked for while one fills up is forgotten."""

    def __init__(self, most: int, chars: int = REMEMBER_CHARS):
        self.most, self.chars, self.held, self.old = most, chars, 0, {}

    def find(self, key):
        found = self.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        self.add({key: value})

    def add(self, entries: dict) -> None:
        """Keep entries key -> (tokens, ids, decoded), one by one where they are an eighth of what may be kept, and none that is so alone."""
        size = sum([len(k) + len(v[1]) + len(v[2]) for k, v in entries.items()])
        if size > self.chars // 8:
            if len(entries) > 1:
                for k, v in entries.items():
                    self.add({k: v})
            return
        if len(self) >= self.most or self.held + size > self.chars:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self.held += size
        self.update(entries)


@contextmanager
def parallel(wanted: bool):
    """Let the library use threads for the leaves of a tree; for small batches they cost more than they bring."""
    before = os.environ.get("TOKENIZERS_PARALLELISM")
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if wanted else "false"
    try:
        yield
    finally:
        os.environ.pop("TOKENIZERS_PARALLELISM")
        if before is not None:
            os.environ["TOKENIZERS_PARALLELISM"] = before


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Encoder:
    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        self.tokenizer, self.bare, self.leaf, self.window = load(path), load_bare(path), leaf, window
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        spec = json.loads(self.tokenizer.to_str())
        spec = json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
        self.by_words = json.dumps(WORD_SPLIT) in spec and '"Lowercase"' in spec
        self.spaced = self.by_words and self.tokenizer.decoder is None  # then decoding joins the tokens by spaces
        self.names = {i: w for w, i in self.tokenizer.get_vocab().items()} if self.spaced else {}
        self.pieces: Recent = Recent(REMEMBER)  # piece -> (tokens, ids as text, decoded)
        self.words: Recent = Recent(REMEMBER)  # lower-case word or punctuation -> the same

    def rest(self) -> None:
        """Keep one generation of what is remembered."""
        self.pieces.old, self.words.old = {}, {}

    def encode_symbols(self, symbols: list[str]) -> list[list[tuple[int, int]]]:
        """(id, end) of each pre-tokenized string's tokens, ends in characters; the strings are encoded in parallel."""
        with parallel(len(symbols) > 1):
            got = self.bare.encode_batch(symbols, add_special_tokens=False)
        return [[(i, b) for i, (_, b) in zip(e.ids, e.offsets, strict=True)] for e in got]

    def tree(self, s: str) -> list[int]:
        """Ids of one pre-token by tree concatenation."""
        cuts = list(range(0, len(s), self.leaf)) + [len(s)]
        leaves = self.encode_symbols([s[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        spans = [([(i, e + a) for i, e in t], a, b) for t, a, b in zip(leaves, cuts, cuts[1:], strict=False)]
        while len(spans) > 1:
            spans = [self.join(s, *spans[k : k + 2]) if k + 1 < len(spans) else spans[k] for k in range(0, len(spans), 2)]
        return [i for i, _ in spans[0][0]]

    def join(self, s: str, left, right):
        """One span of (tokens with ends, start, end) from two neighbours."""
        (lt, la, lb), (rt, _, rb) = left, right
        last = rb == len(s)
        n = self.window
        starts = [la, *(e for _, e in lt[:-1])]
        while True:
            i = max(0, len(lt) - n)
            j = min(len(rt), n)
            begin, end = starts[i], rt[j - 1][1]
            window = [(k, e + begin) for k, e in self.encode_symbols([s[begin:end]])[0]]
            # The left agrees if the window's first token is the left's, or the window reaches the left's start.
            agreed_left = i == 0 or window[0] == lt[i]
            tail = None
            if j == len(rt):
                tail = (len(window), len(rt)) if last or end == rb else None
            else:
                theirs = {(k, e): m for m, (k, e) in enumerate(rt[:j])}
                begins = {e: m + 1 for m, (_, e) in enumerate(rt[:j])} | {lb: 0}
                for w in range(len(window) - 2, 0, -1):  # the window's last token carries its end mark
                    m = theirs.get(window[w])
                    if m is not None and begins.get(window[w - 1][1]) == m:
                        tail = (w, m)
                        break
            if agreed_left and tail:
                return lt[:i] + window[: tail[0]] + rt[tail[1] :], la, rb
            n *= 2

    def piece(self, text: str) -> list[int]:
        """Ids of a piece without ASCII white space."""
        if len(text) <= self.leaf:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        out: list[int] = []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                out.append(self.tokenizer.token_to_id(part))
                continue
            normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
            pre = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
            short = iter(self.encode_symbols([p for p in pre if len(p) <= self.leaf]))
            for p in pre:
                out += [i for i, _ in next(short)] if len(p) <= self.leaf else self.tree(p)
        return out

    def _entry(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), self.tokenizer.decode(ids, skip_special_tokens=False)

    def _spaced(self, ids: list[int]) -> tuple[int, str, str]:
        """The same where decoding joins tokens by spaces."""
        return len(ids), " ".join(map(str, ids)), " ".join([self.names[i] for i in ids])

    def _learn(self, new: list[str]) -> dict[str, tuple[int, str, str]]:
        """Entries of new pieces, which are put into the caches too."""
        simple, short, entries = {}, [], {}
        for p in new:
            if len(p) > self.leaf:
                entries[p] = self._entry(self.piece(p))
            elif m := SIMPLE.fullmatch(p):
                simple[p] = (m[1].lower(), m[2])
            else:
                short.append(p)
        parts = [w for w in dict.fromkeys(x for pair in simple.values() for x in pair if x) if self.words.find(w) is None]
        # Lower-case letters and marks of SIMPLE are pre-tokens already, but for their bytes beyond ASCII.
        got = self.bare.encode_batch_fast([w.translate(LATIN) for w in parts], add_special_tokens=False)
        got += self.tokenizer.encode_batch_fast(short, add_special_tokens=False)
        made = {}
        for w, e in zip(parts, got, strict=False):
            made[w] = self._spaced(e.ids)
        self.words.add(made)
        for p, (w, mark) in simple.items():
            n, ids, text = made.get(w) or self.words.find(w) or self._entry(self.piece(w))
            if mark:
                k, more, end = made.get(mark) or self.words.find(mark) or self._entry(self.piece(mark))
                n, ids, text = n + k, f"{ids} {more}", f"{text} {end}"
            entries[p] = (n, ids, text)
        for p, e in zip(short, got[len(parts) :], strict=True):
            entries[p] = self._spaced(e.ids)
        self.pieces.add(entries)
        return entries

    def text(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, their ids as decimals joined by one space, and the decoded text."""
        if not text:
            return 0, "", ""
        if not self.spaced:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return self._entry(ids)
        found = PIECE.findall(text)
        got = list(map(self.pieces.get, found))
        if None in got:
            missing = dict.fromkeys(p for p, g in zip(found, got, strict=True) if g is None)
            old = self.pieces.old
            known = {p: old[p] for p in missing if p in old}
            self.pieces.add(known)
            known |= self._learn([p for p in missing if p not in known])
            got = [known[p] if g is None else g for p, g in zip(found, got, strict=True)]
        got = [g for g in got if g[0]]
        return sum(g[0] for g in got), " ".join([g[1] for g in got]), " ".join([g[2] for g in got])


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """keep columns, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids and decoded."""
    frame = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    made = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    if with_ids:
        made += [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), ("decoded", T.StringType(), pa.string())]
    schema = T.StructType([*frame.schema.fields[:-1], *(T.StructField(n, t) for n, t, _ in made)])

    def run(batches):
        own = encoder(path)
        for batch in batches:
            cols = [[] for _ in made]
            for t in batch.column(len(keep)).to_pylist():
                with parallel(False):
                    n, ids, decoded = own.text(t)
                row = [n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                if with_ids:
                    row += [[int(i) for i in ids.split()], decoded]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, k) for c, (_, _, k) in zip(cols, made, strict=True))], names=[*batch.schema.names[: len(keep)], *(n for n, _, _ in made)])
        own.rest()

    return frame.mapInArrow(frugal(run), schema)
