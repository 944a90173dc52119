"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and everyone else as a named user; only what the
assistant says is learned from (mask 1).  System turns are instructions, not
participants: they stay system turns and are masked out.

The rendering is a table of turns, each with its text and its place in the
whole, so no conversation has to fit in one task.  Places are found in two
steps, within blocks of turns and over block totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Turn numbers that share a block of the two-step running total.
TURN_BLOCK = 64
SYSTEM = "system"


def rotated(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """Rows ``(conv, perspective, turn, part_role, part_name, segment, mask, seg_start, seg_chars)``.

    One row per participant and turn.  A rendered dialogue is its segments in
    the order of ``seg_start`` (characters).  Rows that repeat a turn wholly
    are one turn; different texts under one turn number follow in the order
    of speaker and text; null texts are empty, rows without conversation,
    turn or speaker take no part; a conversation of system turns only has no
    participant and no row.
    """
    t = turns.select(conv, turn, speaker, F.coalesce(F.col(text), F.lit("")).alias("_text")).where(F.col(conv).isNotNull() & F.col(turn).isNotNull() & F.col(speaker).isNotNull()).distinct()
    people = t.where(F.col(speaker) != SYSTEM).select(conv, F.col(speaker).alias("perspective")).distinct()
    seen = t.join(people, conv)
    own = F.col(speaker) == F.col("perspective")
    role = F.when(F.col(speaker) == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when((F.col(speaker) != SYSTEM) & ~own, F.col(speaker))
    head = F.concat(F.lit("<|"), F.col("part_role"), F.coalesce(F.concat(F.lit(" name="), F.col("part_name")), F.lit("")), F.lit("|>\n"))
    seen = seen.withColumn("part_role", role).withColumn("part_name", name).withColumn("segment", F.concat(head, F.col("_text"), F.lit("<|end|>\n")))
    seen = seen.withColumn("seg_chars", F.length("segment").cast("long")).withColumn("_block", F.expr(f"{turn} div {TURN_BLOCK}"))
    within = Window.partitionBy(conv, "perspective", "_block").orderBy(turn, speaker, "_text").rowsBetween(Window.unboundedPreceding, -1)
    totals = seen.groupBy(conv, "perspective", "_block").agg(F.sum("seg_chars").alias("_sum"))
    over = Window.partitionBy(conv, "perspective").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(over), F.lit(0))).drop("_sum")
    placed = seen.withColumn("_in", F.coalesce(F.sum("seg_chars").over(within), F.lit(0))).join(starts, [conv, "perspective", "_block"])
    mask = (F.col("part_role") == "assistant").cast("int")
    return placed.select(conv, "perspective", turn, "part_role", "part_name", "segment", mask.alias("mask"), (F.col("_before") + F.col("_in")).alias("seg_start"), "seg_chars")
