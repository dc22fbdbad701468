"""Chat formatting: every dialogue once from the seat of each participant.

From a participant's perspective, that speaker's turns are the assistant's and carry the loss mask;
everybody else is a user who is told apart by name. System turns stay system turns in every
perspective and are nobody's seat. A dialogue among k speakers gives k training examples.

An example is rendered as segments, one row per turn in reading order: ``rendered`` is the text of
the turn with its frame, ``seq_start`` and ``seq_end`` say where it lies in the example, and
``mask_start``/``mask_end`` which code points of it are trained on (null where none are). Joining the
segments of (conversation, perspective) by ``position`` gives the example; a dialogue of any length
is never held in one task.

Frame, for the text T of speaker S: ``<|assistant|>\\nT<|end|>\\n``, ``<|user:S|>\\nT<|end|>\\n`` or
``<|system|>\\nT<|end|>\\n``. In texts and names, ``<|`` is written ``<\\u200b|``, so that nobody can
forge a frame.

The mask covers a trained turn's text and its ``<|end|>``, not the line break behind.

Defined results: a turn without a conversation is in no dialogue; a null text is empty; a null speaker is the participant ``unknown``; turns are in
the order of (turn, speaker, text), nulls first, and equal rows keep a place each (which of them
is first makes no difference). Dialogues with system turns
only have no participant and give no rows. Further columns of the input are ignored.

Positions and places are running sums per conversation. They are taken in blocks: rows are numbered
inside ranges of the sorted table, and every range gets the sums of the ranges before it, so a
conversation with a third of all turns spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.scratch import Scratch

SYSTEM = "system"
UNKNOWN = "unknown"
MARK, BROKEN = "<|", "<\u200b|"
END = "<|end|>\n"

_RANGE_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def _safe(column: Column) -> Column:
    return F.replace(column, F.lit(MARK), F.lit(BROKEN))


def _heads(speaker: Column) -> tuple[Column, Column]:
    """The frame's head for a speaker: as oneself, and as somebody else."""
    system = speaker == SYSTEM
    own = F.when(system, "<|system|>\n").otherwise("<|assistant|>\n")
    other = F.when(system, "<|system|>\n").otherwise(
        F.concat(F.lit("<|user:"), _safe(speaker), F.lit("|>\n"))
    )
    return own, other


def rotate_perspectives(
    turns: DataFrame,
    scratch: Scratch,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per (conversation, perspective, turn); see the module's text for the columns."""
    said = turns.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(speaker), F.lit(UNKNOWN)).alias("speaker"),
        _safe(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    )
    order = ["conv_id", "turn", "speaker", "text"]
    placed = scratch.write(
        said.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_place", _RANGE_BITS)),
        "placed",
    )
    seats = (
        placed.where(F.col("speaker") != SYSTEM)
        .groupBy("conv_id", "speaker")
        .agg(F.count("*").alias("_turns"))
        .select("conv_id", F.col("speaker").alias("perspective"))
    )
    own, other = _heads(F.col("speaker"))
    rotated = (
        placed.join(seats, "conv_id")
        .withColumn("trained", F.col("speaker") == F.col("perspective"))
        .withColumn("_head", F.when(F.col("trained"), own).otherwise(other))
        .withColumn("_size", F.length("_head") + F.length("text") + len(END))
    )
    example = ["conv_id", "perspective"]
    inside = Window.partitionBy(*example, "_range").orderBy("_place")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rotated.withColumns(
        {"_end": F.sum("_size").over(inside), "_rank": F.count("*").over(inside)}
    )
    # At most one row per range and example.
    earlier = Window.partitionBy(*example).orderBy("_range")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rotated.groupBy(*example, "_range")
        .agg(F.sum("_size").alias("_sum"), F.count("*").alias("_count"))
        .select(
            *example,
            "_range",
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_chars_before"),
            F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_rows_before"),
        )
    )
    end = F.col("_chars_before") + F.col("_end")
    start = end - F.col("_size")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM)
    role = role.when(F.col("trained"), "assistant").otherwise("user")
    return running.join(before, [*example, "_range"]).select(
        "conv_id",
        "perspective",
        (F.col("_rows_before") + F.col("_rank")).cast("bigint").alias("position"),
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("chat_role"),
        F.when(role == "user", F.col("speaker")).alias("name"),
        F.concat("_head", "text", F.lit(END)).alias("rendered"),
        start.cast("bigint").alias("seq_start"),
        end.cast("bigint").alias("seq_end"),
        F.when(F.col("trained"), start + F.length("_head")).cast("bigint").alias("mask_start"),
        F.when(F.col("trained"), end - 1).cast("bigint").alias("mask_end"),
    )


#: The same in SQL over a table ``conversations``.
SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') AS words
  FROM conversations WHERE conv_id IS NOT NULL
), seats AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'
), framed AS (
  SELECT s.*, p.perspective, s.speaker = p.perspective AS trained,
         CASE WHEN s.speaker = 'system' THEN '<|system|>' || chr(10)
              WHEN s.speaker = p.perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user:' || replace(s.speaker, '<|', '<' || chr(8203) || '|') || '|>' || chr(10)
         END AS head
  FROM said s JOIN seats p ON s.conv_id = p.conv_id
), sized AS (
  SELECT *, length(head) + length(words) + 8 AS size FROM framed
), running AS (
  SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS position FROM sized
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, words
               ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, position, turn,
       CASE WHEN speaker = 'system' THEN 'system' WHEN trained THEN 'assistant' ELSE 'user' END
         AS chat_role,
       CASE WHEN speaker <> 'system' AND NOT trained THEN speaker END AS name,
       head || words || '<|end|>' || chr(10) AS rendered,
       CAST(upto - size AS BIGINT) AS seq_start, CAST(upto AS BIGINT) AS seq_end,
       CASE WHEN trained THEN CAST(upto - size + length(head) AS BIGINT) END AS mask_start,
       CASE WHEN trained THEN CAST(upto - 1 AS BIGINT) END AS mask_end
FROM running
"""
