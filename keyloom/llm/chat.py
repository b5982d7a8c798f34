"""Chat formatting by perspective rotation, DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and the others as named users; system turns stay system
turns.  A mask marks what the assistant says.  A rendering of more than ``PART``
turns comes in parts of so many turns, each with its place in the whole dialogue,
so that no conversation, however long, must fit one task.

Turns get their place in the conversation without bringing it together: all
turns are laid out in ranges of conversation and turn, and the turns of earlier
ranges are added up from one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.text import stable

#: Turns of a part.
PART = 64
#: Parts whose sizes are added up in one group.
SPAN = 1024
#: Leading characters of a text that place a turn in a range.
PREFIX = 32
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _safe(text: Column) -> Column:
    """The text with the two markers broken, so that a turn can't forge another."""
    return F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "<| $1 |>")


def _placed(said: DataFrame) -> DataFrame:
    """``said`` with ``at``: the place of each turn in its conversation, from 0."""
    order = ["conv_id", "turn", "role", "text"]
    ranges = int(said.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = said.repartitionByRange(ranges, "conv_id", "turn", "role", F.substring("text", 1, PREFIX)).sortWithinPartitions(*order)
    laid = stable(laid.withColumn("range", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    held = laid.groupBy("conv_id", "range").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return laid.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r"))).select(*order, (F.col("row") + F.col("shift")).alias("at"))


def _summed_before(sizes: DataFrame, names: list[str]) -> DataFrame:
    """``sizes`` with each named column's sum over the participant's earlier parts.

    In two levels: over spans of parts, then within a span.
    """
    sizes = sizes.withColumn("span", F.floor(F.col("part") / SPAN))
    spans = sizes.groupBy("conv_id", "participant", "span").agg(*[F.sum(c).alias(c) for c in names])
    earlier = Window.partitionBy("conv_id", "participant").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    totals = spans.select(F.col("conv_id").alias("c"), F.col("participant").alias("p"), F.col("span").alias("s"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_spans") for c in names])
    within = Window.partitionBy("conv_id", "participant", "span").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inner = sizes.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"{c}_within") for c in names])
    met = inner.join(totals, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("participant") == F.col("p")) & (F.col("span") == F.col("s")))
    return met.select(*sizes.columns, *[(F.col(f"{c}_spans") + F.col(f"{c}_within")).alias(f"{c}_before") for c in names])


def perspectives(turns: DataFrame, part: int = PART) -> DataFrame:
    """A row per conversation, participant and part of ``part`` consecutive turns.

    Needs conv_id, turn, role and text; other columns are ignored, whatever their
    names.  Participants are the conversation's roles but for ``system``; a null
    or blank role is the participant ``unknown``, a null text empty, a null turn
    comes first and null conversations are one.  Rows that repeat conversation,
    turn, role and text are one turn; turns that share a number are ordered by
    role and text.  A conversation of system turns alone has no participants and
    gives no rows, nor does an empty table.

    Parts count from 0, and the renderings of all parts in order are the whole
    dialogue; one of at most ``part`` turns is whole in part 0.

    Returns conv_id, participant, part, first_turn and first_char (turns and
    characters of the dialogue before the part), n_turns, n_assistant, rendered
    (the turns in order), mask (a digit for each turn: 1 where the participant
    speaks) and spans (start:length of the participant's words in the whole
    dialogue, in characters, joined by commas).
    """
    role = F.trim(F.coalesce(F.col("role").cast("string"), F.lit("")))
    said = turns.select(
        "conv_id",
        "turn",
        F.when(role == "", "unknown").otherwise(role).alias("role"),
        _safe(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    ).distinct()
    mine_head, system_head, tail = f"{OPEN}assistant\n", f"{OPEN}system\n", f"{CLOSE}\n"
    theirs = lambda r: F.when(r == SYSTEM, F.lit(system_head)).otherwise(F.concat(F.lit(f"{OPEN}user name="), r, F.lit("\n")))
    placed = _placed(said).withColumn("part", F.floor(F.col("at") / part))
    parts = placed.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    # Sizes alone tell where a part begins: characters if all were others' turns, and the participant's own turns.
    sizes = stable(placed.groupBy("conv_id", "part", "role").agg(F.count("*").alias("n"), F.sum(F.length(theirs(F.col("role"))) + F.length("text") + len(tail)).alias("chars")))
    whole = sizes.groupBy("conv_id", "part").agg(F.sum("chars").alias("chars"))
    speakers = sizes.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("role").alias("participant")).distinct()
    own = sizes.select(F.col("conv_id").alias("oc"), F.col("part").alias("op"), F.col("role").alias("owner"), F.col("n").alias("own"))
    views = whole.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    views = views.join(own, F.col("conv_id").eqNullSafe(F.col("oc")) & (F.col("part") == F.col("op")) & (F.col("participant") == F.col("owner")), "left")
    views = _summed_before(views.select("conv_id", "part", "participant", "chars", F.coalesce("own", F.lit(0)).alias("own")), ["chars", "own"])
    shorter = F.length(theirs(F.col("participant"))) - len(mine_head)
    views = views.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "participant", (F.col("chars_before") - F.col("own_before") * shorter).alias("first_char"))
    both = parts.join(views, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    mine = lambda t: t["role"] == F.col("participant")
    head = lambda t: F.when(mine(t), F.lit(mine_head)).otherwise(theirs(t["role"]))
    length = lambda t: F.length(head(t)) + F.length(t["text"]) + len(tail)
    walk = F.aggregate(
        "turns",
        F.struct(F.col("first_char").alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + length(t)).alias("at"),
            F.when(mine(t), F.concat(a["spans"], F.array(F.concat((a["at"] + F.length(head(t))).cast("string"), F.lit(":"), F.length(t["text"]).cast("string"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return both.select(
        "conv_id",
        "participant",
        "part",
        (F.col("part") * part).alias("first_turn"),
        "first_char",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", mine)).cast("long").alias("n_assistant"),
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(tail))), "").alias("rendered"),
        F.array_join(F.transform("turns", lambda t: F.when(mine(t), "1").otherwise("0")), "").alias("mask"),
        F.array_join(walk["spans"], ",").alias("spans"),
    )
