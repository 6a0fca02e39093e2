"""Chat formatting by rotating the perspective of a dialogue.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant:
the participant's turns get the assistant's header and are trained on, the turns of all others become
turns of named users, system turns stay as they are; both are masked. A participant is a distinct
speaker (the role) other than the system's.

A dialogue comes in parts of ``part_turns`` turn numbers. Where more rows than that have such numbers
(turns are null or repeat, or there is no conv_id), these are cut by position into parts of ``part_turns``
rows, and the parts after them are numbered on. So no part has more rows than that, a conversation of any
length is never in one row, and the parts of one rendering, in order, make up the whole text. OP2_SQL has
the same parts. Offsets count code points from the start of the part. Everything is built in: one aggregation per part, the list of participants per
conversation from a distinct; positions come from running counts inside sorted ranges (equal rows are one
row with a count) and the sums of ranges.

Cases: a null text is an empty one; a null role is a speaker named ``unknown``; a null turn belongs to
part 0 and comes first; turns of equal number are ordered by role and text, repeated rows stay; a
conversation with only system turns has no participant and no row; rows without conv_id form one
conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

PART_TURNS = 512
RANGE_ROWS, MOST_RANGES = 8192, 2048
PREFIX = 256  # code points of a text that tell its range; what a range holds is sorted by whole texts
BROADCAST_PARTS = 100_000
SYSTEM, UNKNOWN = "system", "unknown"


def header(speaker: Column, viewer: Column) -> Column:
    named = F.when(speaker == viewer, F.lit("assistant")).when(speaker == SYSTEM, F.lit("system")).otherwise(F.concat(F.lit("user name="), speaker))
    return F.concat(F.lit("<|im_start|>"), named, F.lit("\n"))


END, GAP = "<|im_end|>", "\n"


def _same_part() -> Column:
    return F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("part") == F.col("of_part"))


def _cut(rows: DataFrame, part_turns: int) -> DataFrame:
    """``rows(conv_id, part, turn, speaker, said)`` of overfull parts, cut by position: conv_id, part, piece, turns."""
    distinct = materialize(rows.groupBy("conv_id", "part", "turn", "speaker", "said").agg(F.count(F.lit(1)).alias("n")), "turns")
    ranges = min(MOST_RANGES, distinct.count() // RANGE_ROWS + 1)
    dealt = distinct.repartitionByRange(ranges, "conv_id", "part", "turn", "speaker", F.substring("said", 1, PREFIX))
    dealt = materialize(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("conv_id", "part", "range").agg(F.sum("n").alias("n"))
    before = W.partitionBy("conv_id", "part").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("conv_id").alias("of_conv"), F.col("part").alias("of_part"), F.col("range").alias("of_range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    inside = W.partitionBy("conv_id", "part", "range").orderBy("turn", "speaker", "said").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    placed = placed.join(offsets, _same_part() & (F.col("range") == F.col("of_range"))).withColumn("low", F.col("offset") + F.col("inside"))
    first, last = (F.floor(x / part_turns).cast("long") for x in (F.col("low"), F.col("low") + F.col("n") - 1))
    pieces = placed.withColumn("piece", F.explode(F.sequence(first, last)))
    start = F.col("piece") * part_turns
    copies = F.least(F.col("low") + F.col("n"), start + part_turns) - F.greatest(F.col("low"), start)
    listed = pieces.groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "said", copies.cast("int").alias("n")))).alias("turns"))
    repeated = F.transform("turns", lambda t: F.array_repeat(F.struct(t["turn"].alias("turn"), t["speaker"].alias("speaker"), t["said"].alias("said")), t["n"]))
    return listed.withColumn("turns", F.flatten(repeated))


def _parts(rows: DataFrame, part_turns: int) -> DataFrame:
    """(conv_id, part, turns): parts of ``part_turns`` rows at most."""
    sizes = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    names = (F.col("conv_id").alias("of_conv"), F.col("part").alias("of_part"))
    full = materialize(sizes.filter(F.col("n") > part_turns).select(*names), "overfull")
    listed = F.sort_array(F.collect_list(F.struct("turn", "speaker", "said"))).alias("turns")
    count = full.limit(BROADCAST_PARTS + 1).count()
    if not count:
        return rows.groupBy("conv_id", "part").agg(listed)
    small = F.broadcast(full) if count <= BROADCAST_PARTS else full
    others = rows.join(small, _same_part(), "left_anti").groupBy("conv_id", "part").agg(listed).withColumn("piece", F.lit(0).cast("long"))
    parts = others.unionByName(_cut(rows.join(small, _same_part(), "left_semi"), part_turns))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.ceil(F.col("n") / part_turns) - 1).over(before), F.lit(0)).alias("shift")
    shifts = sizes.select(*names, shift).filter("shift > 0")
    return parts.join(shifts, _same_part(), "left").select("conv_id", (F.col("part") + F.coalesce("shift", F.lit(0)) + F.col("piece")).alias("part"), "turns")


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Per conversation, participant and part of ``turns(conv_id, turn, role, text)``: the rendering.

    Returns conv_id, participant, part, n_turns, n_trained (turns), text, and spans: the [start, end) of
    what is trained on (the participant's words with the end mark), in code points of the part's text.
    """
    rows = turns.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(0)).cast("long").alias("part"),
        "turn",
        F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("said"),
    )
    viewers = rows.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("participant")).distinct()
    seen = _parts(rows, part_turns).join(viewers, F.col("conv_id").eqNullSafe(F.col("of")))
    viewer = F.col("participant")
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            header(t["speaker"], viewer).alias("head"),
            F.concat(t["said"], F.lit(END)).alias("body"),
            (t["speaker"] == viewer).alias("trained"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def place(state: Column, p: Column) -> Column:
        low = state["at"] + F.length(p["head"])
        high = low + F.length(p["body"])
        span = F.array(F.struct(low.alias("start"), high.alias("end")))
        return F.struct((high + len(GAP)).alias("at"), F.when(p["trained"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(GAP))), "")
    return seen.withColumn("pieces", pieces).select(
        "conv_id",
        "participant",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["trained"])).cast("long").alias("n_trained"),
        text.alias("text"),
        F.aggregate("pieces", start, place)["spans"].alias("spans"),
    )


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The renderings, their spans written as ``start-end`` and joined by commas."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return rotate(table(spark, sf_dir, "conversations")).withColumn("spans", spans)


OP2_SQL = r"""
WITH numbered AS (
  SELECT conv_id, CAST(coalesce(floor(turn / 512.0), 0) AS BIGINT) AS stretch, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS said,
         row_number() OVER (PARTITION BY conv_id, stretch ORDER BY turn NULLS FIRST, speaker, said) - 1 AS nr
  FROM conversations),
stretches AS (
  SELECT conv_id, stretch, coalesce(sum(ceil(count(*) / 512.0) - 1) OVER (PARTITION BY conv_id ORDER BY stretch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift
  FROM numbered GROUP BY conv_id, stretch),
rows AS (
  SELECT n.conv_id, CAST(n.stretch + s.shift + n.nr // 512 AS BIGINT) AS part, turn, speaker, said
  FROM numbered n JOIN stretches s ON n.conv_id IS NOT DISTINCT FROM s.conv_id AND n.stretch = s.stretch),
viewers AS (SELECT DISTINCT conv_id, speaker AS participant FROM rows WHERE speaker <> 'system'),
pieces AS (
  SELECT r.*, v.participant, r.speaker = v.participant AS trained,
         '<|im_start|>' || CASE WHEN r.speaker = v.participant THEN 'assistant' WHEN r.speaker = 'system' THEN 'system'
                                ELSE 'user name=' || r.speaker END || chr(10) AS head,
         r.said || '<|im_end|>' AS body,
         row_number() OVER (PARTITION BY r.conv_id, v.participant, r.part ORDER BY r.turn NULLS FIRST, r.speaker, r.said) AS nr
  FROM rows r JOIN viewers v ON r.conv_id IS NOT DISTINCT FROM v.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, participant, part ORDER BY nr
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS low FROM pieces)
SELECT conv_id, participant, part, count(*) AS n_turns, CAST(sum(CASE WHEN trained THEN 1 ELSE 0 END) AS BIGINT) AS n_trained,
       string_agg(head || body || chr(10), '' ORDER BY nr) AS text,
       coalesce(string_agg(CAST(low AS BIGINT) || '-' || CAST(low + length(body) AS BIGINT), ',' ORDER BY nr) FILTER (WHERE trained), '') AS spans
FROM placed GROUP BY conv_id, participant, part
"""
