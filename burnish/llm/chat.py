"""Chat formatting from every participant's point of view.

For each participant of a conversation the dialogue is rendered once, with that speaker as the assistant,
the other speakers as named users and system turns as they are. Only the assistant's words are to be
learned: their place in the rendering is the mask.

A rendering comes as one row per turn, in order, with its offsets in the whole: concatenated by
``position`` the segments are the rendered text. So no conversation, however long, meets in one row or
one task. All turns are cut into ranges of their order, sorted, numbered and written; positions and offsets
come from windows over short stretches of these numbers, and from sums per stretch. So a conversation whose
turns have no number, or all the same, is cut like any other. Ranges go by the first ``PREFIX`` characters of a
text, as the driver sees a sample of what they go by: only longer texts that share these, of one speaker
and one turn number, always lie in the same range.

Defined results: turns go by number, null first, then by speaker and text, so that equal turns have an
order; repeated rows are turns of their own. A null or blank role is the speaker ``unknown``. A null text is
empty. Rows without a conversation id form one conversation. System turns alone give no rows, for nobody
speaks. ``<|`` inside a text or a speaker's name becomes ``< |``, and line breaks inside a name a blank, so that
neither can end its turn or open another; who speaks is told by the role as it is. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burnish.llm.common import only
from burnish.session import settle

SYSTEM, ASSISTANT, UNKNOWN = "system", "assistant", "unknown"
STRETCH_BITS = 8  # a window has two to that power of turns at most
PREFIX = 256  # characters of a text by which ranges are cut
# Fixed values of the chat format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BREAKS = r"[\n\x0B\f\r\x{85}\x{2028}\x{2029}]+"


def rotated(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation, participant and turn.

    ``conv_id``, ``perspective`` (the participant who is the assistant), ``position`` (from 1), ``turn``,
    ``role`` and ``name`` as rendered, ``segment``, ``char_start`` and ``char_end`` of the segment in the
    rendering, ``learned``, and ``mask_start`` and ``mask_end`` of the words to learn (both the segment's
    start if there are none). Offsets
    count characters, ends are exclusive. The mask covers the text and the mark that ends the turn.
    """
    rows = only(turns, conv_id=conv_id, turn=turn, role=role, text=text)
    speaker = F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit(UNKNOWN))
    said = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = rows.select("conv_id", "turn", speaker.alias("speaker"), said.alias("said"))
    rows = settle(_in_order(rows), "turns")
    voices = rows.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    named = F.regexp_replace(F.replace("speaker", F.lit("<|"), F.lit("< |")), BREAKS, " ")
    head = (
        F.when(own, f"{OPEN}{ASSISTANT}\n")
        .when(F.col("speaker") == SYSTEM, f"{OPEN}{SYSTEM}\n")
        .otherwise(F.concat(F.lit(f"{OPEN}user name="), named, F.lit("\n")))
    )
    # Places take lengths alone; the texts come to them at the end.
    lengths = rows.select("conv_id", "slot", "speaker", F.length("said").alias("size"))
    seen = lengths.join(voices, F.col("conv_id").eqNullSafe(F.col("of")))
    length = F.length(head) + F.col("size") + len(CLOSE)
    seen = seen.select("conv_id", "perspective", "slot", F.shiftright("slot", STRETCH_BITS).alias("stretch"), length.alias("length"))

    stretches = seen.groupBy("conv_id", "perspective", "stretch").agg(F.sum("length").alias("chars"), F.count("*").alias("turns"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select(
        *(F.col(c).alias(f"{c}_") for c in ("conv_id", "perspective", "stretch")),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns_before"),
    )
    within = Window.partitionBy("conv_id", "perspective", "stretch").orderBy("slot")
    seen = seen.withColumn("place", F.row_number().over(within))
    seen = seen.withColumn("chars", F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    placed = seen.join(
        stretches,
        seen["conv_id"].eqNullSafe(stretches["conv_id_"])
        & (seen["perspective"] == stretches["perspective_"])
        & (seen["stretch"] == stretches["stretch_"]),
    )
    placed = placed.select(
        F.col("slot").alias("at"),
        "perspective",
        (F.col("turns_before") + F.col("place")).alias("position"),
        (F.col("chars_before") + F.col("chars") - F.col("length")).alias("start"),
        (F.col("chars_before") + F.col("chars")).alias("end"),
    )
    start, end = F.col("start"), F.col("end")
    return rows.join(placed, F.col("slot") == F.col("at")).select(
        "conv_id",
        "perspective",
        "position",
        "turn",
        F.when(own, ASSISTANT).when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user").alias("role"),
        F.when(~own & (F.col("speaker") != SYSTEM), named).alias("name"),
        F.concat(head, "said", F.lit(CLOSE)).alias("segment"),
        start.alias("char_start"),
        end.alias("char_end"),
        own.alias("learned"),
        F.when(own, start + F.length(head)).otherwise(start).alias("mask_start"),
        F.when(own, end - 1).otherwise(start).alias("mask_end"),
    )


def _in_order(rows: DataFrame) -> DataFrame:
    """The turns in ranges of conversation, number, speaker and text, numbered within each: ``slot``.

    Turns alike in all four lie in any order, and in several ranges if they are many: behind a short text, which
    ``PREFIX`` holds whole, ranges go by the place in the input.
    """
    long = F.length("said") > PREFIX
    keys = {
        "begins": F.substring("said", 1, PREFIX),
        "long": long,
        "place": F.when(~long, F.monotonically_increasing_id()),
    }
    by = ["conv_id", "turn", "speaker", *keys]
    placed = rows.withColumns(keys).repartitionByRange(*by).sortWithinPartitions(*by, "said")
    return placed.withColumn("slot", F.monotonically_increasing_id()).drop(*keys)


ORACLE = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(nullif(trim(role), ''), '{UNKNOWN}') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS said
  FROM conversations
), voices AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> '{SYSTEM}'
), seen AS (
  SELECT s.*, v.perspective, s.speaker = v.perspective AS learned,
         regexp_replace(replace(s.speaker, '<|', '< |'), '{BREAKS}', ' ', 'g') AS named,
         CASE WHEN s.speaker = v.perspective THEN '{OPEN}{ASSISTANT}' WHEN s.speaker = '{SYSTEM}' THEN '{OPEN}{SYSTEM}'
              ELSE '{OPEN}user name=' || regexp_replace(replace(s.speaker, '<|', '< |'), '{BREAKS}', ' ', 'g') END || chr(10) AS head
  FROM said s JOIN voices v ON s.conv_id IS NOT DISTINCT FROM v.conv_id
), cut AS (
  SELECT *, head || said || '{CLOSE.strip()}' || chr(10) AS segment FROM seen
), placed AS (
  SELECT *, row_number() OVER w AS position, sum(length(segment)) OVER w AS char_end
  FROM cut
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, position, turn,
       CASE WHEN learned THEN '{ASSISTANT}' WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user' END AS role,
       CASE WHEN NOT learned AND speaker <> '{SYSTEM}' THEN named END AS name,
       segment, char_end::BIGINT - length(segment) AS char_start, char_end::BIGINT AS char_end, learned,
       char_end::BIGINT - length(segment) + CASE WHEN learned THEN length(head) ELSE 0 END AS mask_start,
       CASE WHEN learned THEN char_end::BIGINT - 1 ELSE char_end::BIGINT - length(segment) END AS mask_end
FROM placed
"""
