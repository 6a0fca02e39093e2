"""Mixing sources to target weights along a time-varying curriculum.

A source's share of the mix is its weight, capped where it would repeat its documents too often; what a
cap leaves over goes to the others by weight. A schedule gives the weight of a source over training time
t in [0, 1] as a piecewise-linear function. Its integral is the source's cumulative token demand; the
documents of a source lie one after the other on its token axis, in a pseudo-random order, as often as
the target asks, and the inverse of the demand turns a document's place on that axis into a training
position. Sorting all documents by position (a range sort) gives the order of training.

Only DataFrame functions are used. A source is never gathered in one task: all documents are dealt into
sorted ranges of (source, key, doc_id, size and, for rows that are alike in these, their place in the table);
sums of ranges give each range's offset, and only inside a range is a running sum taken
(operators.positions). Sources are numbered in the same way, and the level of the targets is found by sums
over all sources, a few times over.

Cases: a null text has size 0; a null source is a source of its own, last in the order of sources; a
document of size 0 takes nothing and has no position; repeated rows, and rows without doc_id, count as documents
of their own (among equal rows it is open which one is cut short); an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import sums_before
from .common import SPACE_WORD, materialize, table

#: Weight over time, (t, factor) knots for the first, second and third weight class: the integral of each is 1.
CURRICULUM = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)))
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
RANGE_ROWS = 8192
KEY_BITS = 48


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(t, demand so far, weight, slope) of each piece of a schedule, with a total demand of 1."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if not (t1 > t0 and w0 >= 0 and w1 >= 0):
            raise ValueError("knots must have rising times and no negative weights")
        pieces.append((t0, total, w0, (w1 - w0) / (t1 - t0)))
        total += (w0 + w1) / 2 * (t1 - t0)
    if not total:
        raise ValueError("a schedule needs some weight")
    return [(t, d / total, w / total, m / total) for t, d, w, m in pieces]


def schedule_column(klass: Column, schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    arrays = [
        F.array(
            *(
                F.struct(F.lit(t).alias("t"), F.lit(d).alias("d"), F.lit(w).alias("w"), F.lit(m).alias("m"))
                for t, d, w, m in segments(knots)
            )
        )
        for knots in schedules
    ]
    return F.get(F.array(*arrays), klass)


def inverse_demand(share: Column, pieces: Column) -> Column:
    """The time at which the cumulative demand reaches ``share`` (in [0, 1])."""
    piece = F.element_at(F.filter(pieces, lambda p: p["d"] <= share), -1)
    left = share - piece["d"]
    root = F.sqrt(F.greatest(F.lit(0.0), piece["w"] * piece["w"] + 2.0 * piece["m"] * left))
    return piece["t"] + F.when(left <= 0.0, F.lit(0.0)).otherwise(2.0 * left / (piece["w"] + root))


def source_targets(sized: DataFrame, weights: Sequence[float], max_repeat: int) -> DataFrame:
    """One row per source: its size, weight class and target.

    Sources whose share at the present level is above their cap are capped, the level of the others rises by what
    that leaves over, until no more are capped; each step is a sum over all sources.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    numbered = sums_before(sources, [], ["last", "source"], F.lit(1), "number").withColumn("klass", F.col("number") % len(weights))
    ranked = materialize(
        numbered.select(
            "source", "source_size", "klass", F.get(F.array(*(F.lit(float(w)) for w in weights)), F.col("klass")).alias("weight"), (F.col("source_size") * float(max_repeat)).alias("cap")
        ),
        "sources",
    )
    level, before = float("-inf"), -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        row = ranked.agg(
            F.sum("source_size").alias("total"), F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("capped"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open")
        ).first()
        if row["n"] == before or not row["open"]:
            break
        level, before = (row["total"] - row["capped"]) / row["open"], row["n"]
    return ranked.select("source", "source_size", "klass", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = CURRICULUM,
    max_repeat: int = MAX_REPEAT,
    range_rows: int = RANGE_ROWS,
    seed: str = "mix",
) -> DataFrame:
    """One row per document of ``docs(doc_id, source, size)``, in the order of training.

    Returns doc_id, source, size, source_size, target, taken (words, repeats counted), passes (how often
    the document comes, the last time perhaps cut short) and position (of the first time, in [0, 1]).
    """
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, KEY_BITS // 4), 16, 10)
    sized = materialize(
        docs.select("doc_id", "source", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"), key.cast("long").alias("key")),
        "sizes",
    )
    targets = source_targets(sized, weights, max_repeat).withColumn("pieces", schedule_column(F.col("klass"), schedules)).withColumnRenamed("source", "of")
    tied = sized.withColumn("tie", F.monotonically_increasing_id())
    placed = sums_before(tied, ["source"], ["key", "doc_id", "size", "tie"], F.col("size"), "start", range_rows)
    placed = placed.join(targets, F.col("source").eqNullSafe(F.col("of")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("start")))
    share = F.least(F.lit(1.0), (F.col("start") + F.col("size") / 2.0) / F.col("target"))
    return (
        placed.withColumn("whole", whole)
        .withColumn("rest", rest)
        .withColumn("taken", taken)
        .withColumn("passes", F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("position", F.when(F.col("taken") > 0, inverse_demand(share, F.col("pieces"))))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "position")
        .orderBy(F.col("position").asc_nulls_last(), "doc_id")
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_sources(docs).select(
        "doc_id", "size", "source_size", "target", "taken", "passes", F.round("position", 6).alias("position")
    )


_LEVELS = r"""
sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS key
  FROM {docs}),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS klass
  FROM sizes GROUP BY source),
steps AS (
  SELECT *, CAST(klass + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap,
         row_number() OVER soon AS step,
         CAST(sum(source_size) OVER () AS BIGINT) AS total,
         coalesce(sum(source_size * 3.0::DOUBLE) OVER (soon ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS capped,
         sum(CAST(klass + 1 AS DOUBLE)) OVER (soon ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM sources WINDOW soon AS (ORDER BY source_size / CAST(klass + 1 AS DOUBLE), klass, source NULLS LAST)),
level AS (
  SELECT min_by((total - capped) / open, step) AS level FROM steps WHERE (total - capped) / open * weight <= cap),
targets AS (
  SELECT source, source_size, klass, least(cap, coalesce(level * weight, cap)) AS target FROM steps, level),
placed AS (
  SELECT z.doc_id, z.source, z.size, t.source_size, t.klass, t.target,
         CAST(coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.key, z.doc_id, z.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM sizes z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, whole * size + greatest(0, least(size, CAST(floor(target - whole * source_size) AS BIGINT) - start)) AS taken,
         least(1.0::DOUBLE, (start + size / 2.0::DOUBLE) / nullif(target, 0)) AS share,
         CASE klass WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0 ELSE 1.5 END AS w,
         CASE klass WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0 ELSE -1.0 END AS m
  FROM placed)
"""
OP4_SQL = (
    "WITH"
    + _LEVELS.replace("{docs}", "documents")
    + """
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CAST(CASE WHEN taken > 0 THEN ceil(taken / size::DOUBLE) ELSE 0 END AS BIGINT) AS passes,
       CASE WHEN taken > 0 THEN round(2.0::DOUBLE * share / (w + sqrt(greatest(0.0::DOUBLE, w * w + 2.0::DOUBLE * m * share))), 6) END AS position
FROM counted
"""
)
