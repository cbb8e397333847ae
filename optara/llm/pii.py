"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Kinds in order: email, ip, card, phone (the base kinds), then iban, national_phone, short_card and secret,
which the method adds. A proposed span that fails its validator is dropped without a retry, save that an iban may
end at any space in it (the longest valid one stands) and the next is sought from there on. Each span has a
score: the kind's prior plus a bonus where one of the kind's context words stands within WINDOW characters;
base spans always stay, added ones need MIN_SCORE and must not overlap a span found before them.

Defined results: null counts as the empty text, which has no span; repeated rows give equal results; offsets
are code points with the end exclusive, over whole texts; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_phone", "short_card", "secret")
KINDS = BASE + ADDED
WINDOW, MIN_SCORE = 40, 0.6

# An email has one @: what stands before it, and the domain that must follow. Runs of digits joined by points hold the ips.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
POINTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", re.ASCII)
# An area code in brackets with groups of digits, or groups of digits alone, which count from their first zero on.
NATIONAL = re.compile(r"(\([0-9]{2,5}\)\x20?[0-9]++(?:[\x20.-][0-9]++)++)|[0-9]++(?:[\x20.-][0-9]++)*+")
ZERO, GAP = re.compile(r"0[0-9]"), re.compile(r"[\x20.-]")
SECRET = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,})\b", re.ASCII)

#: prior score and context words by kind; a word raises the score by BONUS.
BONUS = 0.35
CONTEXT = {
    "email": (0.95, ("mail", "contact")),
    "ip": (0.8, ("ip", "host", "server", "address")),
    "card": (0.9, ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte")),
    "phone": (0.85, ("phone", "tel", "call", "mobile", "fax")),
    "iban": (0.8, ("iban", "bank", "account", "konto", "cuenta", "compte")),
    "national_phone": (0.3, ("phone", "tel", "call", "mobile", "fax", "telefon", "tfno")),
    "short_card": (0.3, ("card", "visa", "credit", "payment", "amex", "karte", "tarjeta", "carte")),
    "secret": (0.9, ("key", "token", "secret")),
}


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def email_spans(text: str) -> list[tuple[str, int, int]]:
    """From each @ to both sides, as far as a match that begins behind the one before would go."""
    out, low = [], 0
    while (at := text.find("@", low)) >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        low = m.end() if m else at + 1
    return out


def ip_spans(text: str) -> list[tuple[str, int, int]]:
    """Four by four, the numbers of each run."""
    out = []
    for m in POINTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) < 4 and int(p) <= 255 or len(p) > 3 and len(v := p.lstrip("0")) < 4 and int(v or "0") <= 255 for p in four):
                out.append(("ip", at, end))
            at = end + 1
    return out


def national_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in NATIONAL.finditer(text):
        start, end = m.span()
        if m[1] is None:
            zero = ZERO.search(text, start, end)
            if not zero or not GAP.search(text, zero.end(), end):
                continue
            start = zero.start()
        if 8 <= len(digits(text[start:end])) <= 13 and text[max(0, start - 1) : start] not in tuple("0123456789+.-"):
            out.append(("national_phone", start, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = email_spans(text)
    if text.count(".") >= 3:
        out += ip_spans(text)
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


def iban_spans(text: str) -> list[tuple[str, int, int]]:
    """Valid numbers: the pattern may take a word that follows one, so that spans ending at an earlier space are tried too."""
    out, at = [], 0
    while m := IBAN.search(text, at):
        ends = [m.end(), *(i for i in range(m.end() - 1, m.start(), -1) if text[i] == " ")]
        end = next((e for e in ends if mod97(text[m.start() : e])), None)
        if end:
            out.append(("iban", m.start(), end))
        at = end or m.start() + 1
    return out


def added_spans(text: str) -> list[tuple[str, int, int]]:
    out = iban_spans(text)
    if ")" in text or "0" in text:
        out += national_spans(text)
    out += [("short_card", m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := digits(m[0])) <= 15 and luhn(d)]
    return out + [("secret", m.start(), m.end()) for m in SECRET.finditer(text)]


_LOWER = {c: c + 32 for c in range(65, 91)}
_NEAR = {kind: re.compile("(?:^|[^a-z])(?:" + "|".join(words) + ")") for kind, (_, words) in CONTEXT.items()}


def score(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - WINDOW) : start]} {text[end : end + WINDOW]}".translate(_LOWER)
    return min(1.0, CONTEXT[kind][0] + BONUS * bool(_NEAR[kind].search(near)))


class Taken:
    """Places in a text, as sorted intervals that don't overlap."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def add(self, start: int, end: int) -> bool:
        """Take a place unless part of it is taken."""
        i = bisect.bisect_left(self.starts, end)  # places from i on begin behind it
        if i and self.ends[i - 1] > start:
            return False
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True


def find(text: str | None) -> list[Span]:
    """All spans: base kinds as listed, then added kinds; by start within a kind."""
    if not text:
        return []
    got = [Span(*s, score(text, *s)) for s in base_spans(text)]
    taken = Taken((s.start, s.end) for s in got)
    for s in added_spans(text):
        v = score(text, *s)
        if v >= MIN_SCORE and taken.add(*s[1:]):
            got.append(Span(*s, v))
    return got


def joined(spans) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    if not text:
        return text
    out, at = [], 0
    for s in sorted(find(text), key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), redacted: bool = False) -> DataFrame:
    """keep columns, n_email, n_ip, n_card, n_phone, base_sha256, spans, top_score and, if wanted, redacted."""
    frame = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    made = [*((f"n_{k}", T.LongType(), pa.int64()) for k in BASE), ("base_sha256", T.StringType(), pa.string()), ("spans", T.StringType(), pa.string()), ("top_score", T.DoubleType(), pa.float64()), *([("redacted", T.StringType(), pa.string())] * redacted)]
    schema = T.StructType([*frame.schema.fields[:-1], *(T.StructField(n, t) for n, t, _ in made)])

    def run(batches):
        for batch in batches:
            cols = [[] for _ in made]
            for t in batch.column(len(keep)).to_pylist():
                spans = find(t)
                base = [s for s in spans if s.kind in BASE]
                row = [*(sum(s.kind == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), max((s.score for s in spans), default=None), *([redact(t)] * redacted)]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, k) for c, (_, _, k) in zip(cols, made, strict=True))], names=[*batch.schema.names[: len(keep)], *(n for n, _, _ in made)])

    return frame.mapInArrow(frugal(run), schema)
