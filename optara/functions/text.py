"""Rendering cards and questions, and reading them back, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W
from .exact import fmt_all, let

# How questions ask for the least, and how they state a cap.
LEAST = r"\b(least|lowest|minimum|menos|mínimo)\b"
CAP = r"(?:at most|at or below|como máximo|pasar de) ([\d.]+) g"


def by_language(language: Column, of) -> Column:
    """The column that of(code) gives for the row's language."""
    return F.when(language == "es", of("es")).otherwise(of("en"))


def fill(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def panel_text(numbers: Column, language: Column, sodium: Column) -> Column:
    """The body of a card from eight printed numbers: seven values in fixed order, then sodium in mg, printed in place of salt where asked."""

    def body(code: str) -> Column:
        names = W.PRINTED[code]
        parts = [F.concat(F.lit(names[n] + " "), F.get(numbers, F.lit(i)), F.lit(" kcal" if n == "energy" else " g")) for i, n in enumerate(W.NUTRIENTS[:-1])]
        salt = F.when(sodium, F.concat(F.lit(names["sodium"] + " "), F.get(numbers, F.lit(7)), F.lit(" mg"))).otherwise(F.concat(F.lit(names["salt"] + " "), F.get(numbers, F.lit(6)), F.lit(" g")))
        return F.concat_ws(", ", *parts, salt)

    return F.concat(by_language(language, body), F.lit("."))


def card(product, language: Column, sodium_mg: Column) -> Column:
    """Brand and name, quantity if any, then seven values in fixed order; salt as sodium in mg where asked."""
    blank = lambda c: F.when(c != "", c)
    head = F.concat(F.concat_ws(" · ", blank(product["brand"]), blank(product["name"])), F.when(product["quantity"] != "", F.concat(F.lit(" ("), product["quantity"], F.lit(")"))).otherwise(F.lit("")))
    numbers = fmt_all(F.array(*(product["values"][n] for n in W.NUTRIENTS), product["sodium"] * F.lit(1000.0)))
    return F.concat(head, F.lit(". "), let(numbers, lambda n: panel_text(n, language, sodium_mg)))


def language(question: Column) -> Column:
    return F.when(question.rlike("[¿áéíóúñ]"), F.lit("es")).otherwise(F.lit("en"))


def mentions(question: Column, language: Column) -> Column:
    """Nutrients named in the question in reading order; of overlapping words the longer one."""

    def of(code: str) -> Column:
        pairs = W.MENTIONS[code]
        found = F.regexp_extract_all(F.lower(question), F.lit(r"(?U)\b(" + "|".join(re.escape(w) for w, _ in pairs) + r")\b"), F.lit(1))
        known = F.create_map(*(F.lit(x) for p in pairs for x in p))
        return F.transform(found, lambda w: known[w])

    return by_language(language, of)


def panel(text: Column) -> Column:
    """The values a card prints, as a struct; salt from sodium where salt isn't printed."""
    return let(card_body(text), panel_values)


def card_body(text: Column) -> Column:
    """The text from its last energy label on, if it has one: names before it may hold nutrient words."""
    tail = F.regexp_extract(text, r"(?isuU)^.*((?:energy |energía ).*)$", 1)
    return F.coalesce(F.nullif(tail, F.lit("")), text)


def read_value(body: Column, nutrient: str) -> Column:
    """The first value that a card's body prints for a nutrient; salt from sodium where salt isn't printed."""
    said = "|".join(re.escape(W.PRINTED[c][nutrient]) for c in ("en", "es"))
    unit = {"energy": "kcal", "sodium": "mg"}.get(nutrient, "g")
    found = F.nullif(F.regexp_extract(body, rf"(?iu)(?:{said}) ([0-9.]+) {unit}", 1), F.lit("")).try_cast("double")
    return F.coalesce(found, read_value(body, "sodium") * F.lit(2.5) / F.lit(1000.0)) if nutrient == "salt" else found


def panel_values(body: Column) -> Column:
    return F.struct(*(read_value(body, n).alias(n) for n in W.NUTRIENTS))


def asks_least(question: Column) -> Column:
    return F.lower(question).rlike("(?U)" + LEAST)


def cap_of(question: Column) -> Column:
    return F.nullif(F.regexp_extract(question, CAP, 1), F.lit("")).try_cast("double")


def slug(text: Column) -> Column:
    return F.substring(F.replace(F.lower(text), F.lit(" "), F.lit("_")), 1, 40)


def file_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-")


def letter_choice(reply: Column, options: Column) -> Column:
    """Position of the first lone letter of a reply, null if none or beyond the options."""
    letter = F.regexp_extract(F.upper(F.trim(reply)), r"(?U)\b([A-Z])\b", 1)
    at = F.ascii(letter) - 65
    return F.when((letter != "") & (at < options), at)


def byte_ids(text: Column, limit: int, begin: int, end: int) -> Column:
    """UTF-8 bytes cut to limit - 2, between begin and end marks; a cut may split a character."""
    hexes = F.hex(F.encode(text, "UTF-8"))
    n = F.least(F.octet_length(text), F.lit(limit - 2))
    ids = F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.substring(hexes, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))
    return F.concat(F.array(F.lit(begin)), F.when(n > 0, ids).otherwise(F.array().cast("array<int>")), F.array(F.lit(end)))
