"""Chat formatting by rotating the perspective over the parties, in DataFrame expressions only.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant, all others as users who are named, and a mask that lets only the speaker's own turns
be learnt. A rendered turn is a row, with its place in the whole rendering in turns and
characters, so a conversation of any length is never collected: places are running sums over
blocks of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers of a block; buckets that one turn number is split into where it is crowded; rows that crowd a block.
BLOCK, SPLIT, CROWD = 64, 64, 512

#: The frame of a rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _ordered(conversations: DataFrame) -> DataFrame:
    """Add `tie` and the block of each row: rows of a conversation in order of (block, turn, tie).

    A block is BLOCK turn numbers; a block of more than CROWD rows (one turn number repeated over
    and over) is split further by turn number and by the first digits of the tie.
    """
    # Of what is left of nulls; a digest that SQL has too, so that ties have one order anywhere.
    tie = F.md5(F.concat("role", F.lit("\0"), "text").cast("binary"))
    number = F.coalesce(F.col("turn"), F.lit(-(1 << 62)))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"tie": tie, "number": number, "wide": F.floor(number / BLOCK)})
    sizes = rows.groupBy("conv_id", "wide").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CROWD)
    marked = rows.join(sizes.select(F.col("conv_id").alias("c"), F.col("wide").alias("w"), "size"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("wide") == F.col("w")), "left").drop("c", "w")
    fine = F.col("size").isNotNull()
    top = F.floor(F.conv(F.substring("tie", 1, 2), 16, 10).cast("int") * SPLIT / 256)
    return marked.withColumns({"near": F.when(fine, F.col("number")), "part": F.when(fine, top)}).drop("size")


BLOCK_KEY = ["conv_id", "wide", "near", "part"]


def rotate(conversations: DataFrame) -> DataFrame:
    """One row a conversation, participant and turn of it: the dialogue as that participant sees it.

    Columns: conv_id, participant, position (from 0), turn, speaker, chat_role (assistant, user or
    system), name (of a user), content, rendered, start and end (characters of `rendered` in the
    whole rendering), learn (the mask: 1 for the participant's own turns).

    System turns belong to nobody: they are rendered as such for every participant, and a
    conversation of system turns alone has no participant and no rows. Null roles are the
    participant "unknown", null texts are empty turns, null turn numbers come first, ties are in
    the order of the md5 of role and text, repeated rows are turns of their own, and a null conv_id
    is a conversation. An empty table gives an empty one.
    """
    rows = _ordered(conversations)
    system = F.col("role") == "system"
    people = rows.where(~system).select("conv_id", F.col("role").alias("participant")).distinct()
    order = [F.col("number"), F.col("tie"), F.col("role"), F.col("text")]
    window = Window.partitionBy(*BLOCK_KEY).orderBy(*order)
    # Characters of a turn for its own speaker and for others differ by the name's line.
    own, other = _rendered(F.lit(True)), _rendered(F.lit(False))
    numbered = rows.withColumns({"k": F.row_number().over(window) - 1, "own_length": F.length(own), "other_length": F.length(other)})
    others_before = F.coalesce(F.sum("other_length").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = numbered.withColumns({"before": others_before})
    gain = F.col("own_length") - F.col("other_length")
    # Blocks: rows and characters before each, and for each participant what its own turns change.
    blocks = numbered.groupBy(*BLOCK_KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("other_length").alias("m"))
    running = Window.partitionBy("conv_id").orderBy("wide", "near", "part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = blocks.select(*BLOCK_KEY, F.coalesce(F.sum("n").over(running), F.lit(0)).alias("n0"), F.coalesce(F.sum("m").over(running), F.lit(0)).alias("m0"))
    placed = _join(numbered, firsts, BLOCK_KEY)
    seen = _join(placed, people, ["conv_id"])
    mine = (F.col("role") == F.col("participant")) & (F.col("role") != "system")
    shift = F.when(mine, gain).otherwise(0)
    inner = Window.partitionBy(*BLOCK_KEY, "participant").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    shifted = seen.withColumns({"mine": mine, "shift": shift}).withColumn("moved", F.coalesce(F.sum("shift").over(inner), F.lit(0)))
    gains = shifted.groupBy(*BLOCK_KEY, "participant").agg(F.sum("shift").alias("g"))
    over = Window.partitionBy("conv_id", "participant").orderBy("wide", "near", "part").rowsBetween(Window.unboundedPreceding, -1)
    gains = gains.select(*BLOCK_KEY, "participant", F.coalesce(F.sum("g").over(over), F.lit(0)).alias("g0"))
    final = _join(shifted, gains, [*BLOCK_KEY, "participant"])
    start = (F.col("m0") + F.col("before") + F.col("g0") + F.col("moved")).cast("long")
    rendered = _rendered(F.col("mine"))
    chat_role = F.when(F.col("role") == "system", "system").when(F.col("mine"), "assistant").otherwise("user")
    return final.select(
        "conv_id",
        "participant",
        (F.col("n0") + F.col("k")).cast("long").alias("position"),
        "turn",
        F.col("role").alias("speaker"),
        chat_role.alias("chat_role"),
        F.when(chat_role == "user", F.col("role")).alias("name"),
        F.col("text").alias("content"),
        rendered.alias("rendered"),
        start.alias("start"),
        (start + F.length(rendered)).cast("long").alias("end"),
        F.col("mine").cast("int").alias("learn"),
    )


def _rendered(mine: Column) -> Column:
    """A turn in its frame: system as it is, the assistant without, users with their name."""
    role = F.col("role")
    header = F.when(role == "system", F.lit("system")).when(mine, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(OPEN), header, F.lit("\n"), F.col("text"), F.lit(CLOSE))


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null; the left side's keys stay."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return left.join(renamed, condition).drop(*[f"__{k}" for k in keys])
