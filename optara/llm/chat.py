"""Multi-party chat formatting: every participant's view of a dialogue, with loss masks.

For each participant of a conversation the whole dialogue is rendered with that speaker as assistant, all
others as named users and system roles as they are; the mask marks what the assistant says, with the end
marker that it must learn to emit. Only DataFrame functions run here.

A dialogue is written in parts of PART_TURNS rows each, by their place in the conversation, so that no
row or task holds an unbounded conversation whatever its turn numbers: places come from a range sort with offsets. The parts of
one view, joined in order, are the whole rendering, and start_char says where a part begins in it. Ordinary dialogues have one part.
A part is gathered once and rendered for each speaker where it lies, so texts are joined by conversation and part, and no task gets all
texts of a conversation. Only numbers, one row for each speaker and part, are matched by conversation alone.

Defined results: rows of one conversation are ordered by turn, then role and text, nulls first; repeated rows
stay, one after the other; a null role speaks as `unknown`, a null text is empty, a null turn stands
before all others; rows with a null conversation id form one conversation; a conversation of system turns alone
has no participant and no row; `<|` in texts and names becomes `< |`, so that no turn can forge a marker.
Columns of the input beyond the four named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import row_numbers
from ..operators.relations import running_total
from .common import materialize, partitions

SYSTEM_ROLES = ("system",)
PART_TURNS = 256


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system_roles: tuple[str, ...] = SYSTEM_ROLES, part_turns: int = PART_TURNS) -> DataFrame:
    """Rows (conv_id, speaker, part, start_char, n_turns, n_masked_turns, text, mask); mask is `start:end,...` within text."""
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        plain(F.coalesce(F.col(role).cast("string"), F.lit("unknown"))).alias("name"), plain(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("said"),
    )
    placed = row_numbers(rows, ["conv_id"], [F.col("turn"), F.col("name"), F.col("said")], "place")
    opened = lambda head: F.concat(F.lit("<|im_start|>"), head, F.lit("\n"))
    by_others = lambda name: F.when(name.isin(*system_roles), name).otherwise(F.concat(F.lit("user name="), name))
    shown = lambda start, said: F.concat(start, said, F.lit("<|im_end|>\n"))
    # Each turn is gathered once, in its part; views are rendered from parts, not turns, and need no further grouping.
    parts = placed.groupBy("conv_id", F.floor(F.col("place") / part_turns).cast("long").alias("part")).agg(F.sort_array(F.collect_list(F.struct("place", "name", "said"))).alias("turns"))
    lengths = F.transform("turns", lambda t: F.struct(t["name"].alias("name"), F.length(shown(opened(by_others(t["name"])), t["said"])).cast("long").alias("chars")))
    parts = materialize(parts.withColumn("lengths", lengths), "chat-parts")

    # Where a part begins in a view: running sums over lengths alone; the speaker's own turns are shorter by a constant.
    spoken = parts.select("conv_id", "part", F.explode("lengths").alias("t")).select("conv_id", "part", "t.*")
    whole = parts.select("conv_id", "part", F.aggregate("lengths", F.lit(0).cast("long"), lambda n, t: n + t["chars"]).alias("chars"))
    speakers = spoken.where(~F.col("name").isin(*system_roles)).select(F.col("conv_id").alias("c"), F.col("name").alias("speaker")).distinct()
    views = whole.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = spoken.groupBy(F.col("conv_id").alias("c"), F.col("part").alias("p"), "name").agg(F.count("*").alias("own"))
    views = views.join(own, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("speaker") == F.col("name")), "left")
    less = F.length(by_others(F.col("speaker"))) - len("assistant")
    views = views.select("conv_id", "speaker", "part", (F.col("chars") - F.coalesce("own", F.lit(0)) * less).alias("chars"))
    views = running_total(views, ["conv_id", "speaker"], [F.col("part")], F.col("chars"), "upto")
    views = views.select(F.col("conv_id").alias("c"), "speaker", F.col("part").alias("p"), (F.col("upto") - F.col("chars")).cast("long").alias("start_char"))

    # Rendering multiplies texts by speakers, so both sides are dealt over all partitions, however small they are before it.
    at = lambda c, p: F.concat(F.col(p).cast("string"), F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")))
    n = partitions(turns.sparkSession)
    views = parts.drop("lengths").withColumn("at", at("conv_id", "part")).repartition(n, "at").join(views.select("speaker", "start_char", at("c", "p").alias("at")).repartition(n, "at"), "at")

    def seen(t: Column) -> Column:
        mine = t["name"] == F.col("speaker")
        start = opened(F.when(mine, F.lit("assistant")).otherwise(by_others(t["name"])))
        return F.struct(mine.alias("mine"), F.length(start).alias("open"), shown(start, t["said"]).alias("shown"))

    views = views.select("conv_id", "speaker", "part", "start_char", F.transform("turns", seen).alias("ts"))
    # Ends of the turns' renderings, by one running sum; the closing line break is not trained on.
    ends = F.aggregate("ts", F.expr("cast(array() as array<int>)"), lambda acc, t: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(t["shown"]))))
    views = views.withColumn("ends", ends)
    spans = F.transform(F.filter(F.arrays_zip("ts", "ends"), lambda x: x["ts"]["mine"]), lambda x: F.concat((x["ends"] - F.length(x["ts"]["shown"]) + x["ts"]["open"]).cast("string"), F.lit(":"), (x["ends"] - 1).cast("string")))
    views = views.withColumn("spans", spans)
    return views.select(
        "conv_id", "speaker", "part", "start_char", F.size("ts").cast("long").alias("n_turns"), F.size("spans").cast("long").alias("n_masked_turns"),
        F.array_join(F.transform("ts", lambda t: t["shown"]), "").alias("text"), F.array_join("spans", ",").alias("mask"),
    )
