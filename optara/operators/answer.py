"""Answering rows from their text alone: parse the question, read the cards, apply the cap, pick the extreme."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words as W
from ..functions.exact import let


def parsed(question: Column) -> Column:
    """Struct (target, capped, limit, least) of a question; target is null where no nutrient is named.

    The last nutrient named is the target and the first the capped one; a limit counts only with two mentions.
    """
    named = X.mentions(question, X.language(question))
    return let(named, lambda n: F.struct(F.try_element_at(n, F.lit(-1)).alias("target"), F.try_element_at(n, F.lit(1)).alias("capped"), F.when(F.size(n) >= 2, X.cap_of(question)).alias("limit"), X.asks_least(question).alias("least")))


def _value(body: Column, name: Column) -> Column:
    """The value that a card's body prints for the named nutrient; the others aren't looked for."""
    out = F.when(name == W.NUTRIENTS[0], X.read_value(body, W.NUTRIENTS[0]))
    for n in W.NUTRIENTS[1:]:
        out = out.when(name == n, X.read_value(body, n))
    return out


def decide(question: Column, texts: Column) -> Column:
    """Position of the option that the rules pick, null where the question doesn't parse or no card is left.

    A card without the capped value breaks the cap, one without the target is left out; of equal values the first wins.
    """

    def pick(q: Column) -> Column:
        def option(body: Column, i: Column) -> Column:
            within = q["limit"].isNull() | (F.coalesce(_value(body, q["capped"]), F.lit(1e9)) <= q["limit"])
            return F.struct(F.when(within, _value(body, q["target"])).alias("v"), i.alias("i"))

        cards = F.filter(F.transform(F.transform(texts, X.card_body), option), lambda x: x["v"].isNotNull())
        # The least (value, position), the value's sign turned where the most is asked: the first of equal values wins.
        keyed = F.transform(cards, lambda x: F.struct(F.when(q["least"], x["v"]).otherwise(-x["v"]).alias("v"), x["i"].alias("i")))
        return F.when(q["target"].isNotNull(), F.array_min(keyed)["i"].cast("int"))

    return let(parsed(question), pick)
