"""Picking one option of K by an extreme value, with clear margins and optional caps, on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exact import let, printed, round1

REL_MARGIN = 0.15


def first_extreme(values: Column, most: Column) -> Column:
    """Position (from 0) of the largest or smallest value; of equal values the first."""
    return F.array_position(values, F.when(most, F.array_max(values)).otherwise(F.array_min(values))) - 1


def clear_winner(values: Column, most: Column, floor: Column | float, rel: float = REL_MARGIN) -> Column:
    """Position of the extreme if it leads the runner-up by the floor and by a share of the larger of both, else null."""
    floor = floor if isinstance(floor, Column) else F.lit(float(floor))
    ranked = F.sort_array(values)
    best = F.when(most, F.try_element_at(ranked, F.lit(-1))).otherwise(F.try_element_at(ranked, F.lit(1)))
    second = F.when(most, F.try_element_at(ranked, F.lit(-2))).otherwise(F.try_element_at(ranked, F.lit(2)))
    gap = F.abs(best - second)
    return F.when((F.size(values) >= 2) & (gap >= floor) & (gap >= F.lit(rel) * F.greatest(best, second)), F.array_position(values, best) - 1)


def separated(values: Column, best: Column, rel: float = REL_MARGIN, least: float = 0.2) -> Column:
    """Whether the option at best leads every rival by a share of its own value and by least; false without a rival."""
    top = F.get(values, best.cast("int"))
    scale = F.greatest(F.abs(top), F.lit(1e-9))
    rivals = F.filter(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda x: x["i"] != best)
    return (F.size(rivals) > 0) & F.forall(rivals, lambda x: (F.abs(top - x["v"]) / scale >= rel) & (F.abs(top - x["v"]) >= least))


def middle_cap(values: Column) -> Column:
    """Mean of the elements around the middle (the lower two of an odd count), rounded to tenths."""
    half = F.floor(F.size(values) / 2).cast("int")
    return let(let(F.sort_array(values), lambda r: (F.get(r, half - 1) + F.get(r, half)) / F.lit(2.0)), round1)


def allowed(caps: Column, limit: Column) -> Column:
    """Positions whose capped value is within the limit, rising."""
    return F.filter(F.transform(caps, lambda v, i: F.when(v <= limit, i)), lambda i: i.isNotNull())


def capped_winner(values: Column, within: Column, most: Column, floor: Column | float, rel: float = REL_MARGIN) -> Column:
    """clear_winner among the positions in within, as a position among all options."""
    local = clear_winner(F.transform(within, lambda i: F.get(values, i)), most, floor, rel)
    return F.get(within, local.cast("int"))


def decidable(caps: Column, limit: Column) -> Column:
    """Whether printed values against the printed limit allow exactly the options that measured values allow."""
    return F.forall(caps, lambda v: (printed(v) <= printed(limit)) == (v <= limit))


def trap(values: Column, within: Column, gold: Column, most: Column) -> Column:
    """Whether an option outside the cap would beat the gold one."""
    top = F.get(values, gold.cast("int"))
    return F.exists(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda x: ~F.array_contains(within, x["i"]) & F.when(most, x["v"] > top).otherwise(x["v"] < top))
