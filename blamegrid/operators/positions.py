"""Running sums and positions in groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialize

RANGE_ROWS, MOST_RANGES = 8192, 4096


def sums_before(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str, range_rows: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of the whole number ``value`` over the rows of the group before it in ``order``.

    All rows are dealt into sorted ranges; sums of ranges give each range's offset, and only inside a range is a
    running sum taken. Rows that ``order`` doesn't tell apart share a range: add a column that does where there
    can be many. A window over a group sees one row per range, of which there are at most MOST_RANGES. The result reads
    a scratch table, which ``discard`` of the result removes.
    """
    found = materialize(rows.withColumn("_value", value), "rows")
    ranges = max(1, min(MOST_RANGES, found.count() // (range_rows or RANGE_ROWS) + 1))
    dealt = materialize(found.repartitionByRange(ranges, *group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    discard(found)
    sums = dealt.groupBy(*group, "_range").agg(F.sum("_value").alias("_sum"))
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*(F.col(g).alias(f"_of_{g}") for g in group), F.col("_range").alias("_of_range"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*group, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    same = F.col("_range") == F.col("_of_range")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    placed = dealt.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(offsets, same)
    result = placed.select(*rows.columns, (F.col("_offset") + F.col("_inside")).alias(name))
    result._scratch_path = dealt.__dict__.pop("_scratch_path")
    return result
