"""Standing among others: percentiles inside an event and against another event, in groups of any size.

Equal values are one row with a count, summed up in each task first. How many values lie below one follows from
sorted ranges of these rows and the ranges' sums (operators.positions), where a value that meets a range's
border is still one row: no window and no task sees a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import sums_before


def _standing(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """``counts(group..., value, n)``, one row per value, with below (rows of lesser values) and total, under names of their own: of_..., at, same, below, total."""
    placed = sums_before(counts, group, ["value"], F.col("n"), "below")
    totals = counts.groupBy(*group).agg(F.sum("n").alias("total")).withColumnsRenamed({g: f"in_{g}" for g in group})
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"in_{g}"))
    return placed.join(totals, same).select(*(F.col(g).alias(f"of_{g}") for g in group), F.col("value").alias("at"), F.col("n").alias("same"), "below", "total")


def _meeting(rows: DataFrame, standing: DataFrame, group: Sequence[str]) -> DataFrame:
    on = F.col("value").eqNullSafe(F.col("at"))
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    return rows.join(standing, on)


def within_event_percentiles(long: DataFrame) -> DataFrame:
    """``long(case_id, service, ix, value)`` with pct: the rank, ties at their mean, scaled to [0, 1].

    Null in an event with a single candidate. A null value is less than all others, a NaN greater.
    """
    group = ["case_id", "ix"]
    standing = _standing(long.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n")), group)
    pct = (F.col("below") + (F.col("same") - 1) / 2.0) / F.nullif(F.col("total") - 1, F.lit(0))
    return _meeting(long, standing, group).select(*long.columns, pct.alias("pct"))


def foreign_percentiles(values: DataFrame, context: DataFrame, match: DataFrame) -> DataFrame:
    """(case_id, context_id, service, ix, value, pct): share of a foreign event's values below, ties counted half.

    ``match(case_id, context_id)`` names the event that each event is held against. Values of both stand in one order, in which only
    the foreign ones count; that takes the place of a comparison of each with each.
    """
    pair = ["case_id", "context_id", "ix"]
    own = values.join(match, "case_id").select(*pair, "service", "value")
    others = context.withColumnRenamed("case_id", "context_id").join(match, "context_id").select(*pair, "value", F.lit(1).alias("foreign"))
    both = own.select(*pair, "value", F.lit(0).alias("foreign")).unionByName(others)
    standing = _standing(both.groupBy(*pair, "value").agg(F.sum("foreign").alias("n")), pair)
    pct = (F.col("below") + 0.5 * F.col("same")) / F.nullif(F.col("total"), F.lit(0))
    return _meeting(own, standing, pair).select(*pair[:2], "service", "ix", "value", pct.alias("pct"))


def representation(vectors: DataFrame, relative: bool) -> DataFrame:
    """(case_id, service, features): as they are, or followed by their percentiles inside the event."""
    if not relative:
        return vectors.select("case_id", "service", "features")
    long = vectors.select("case_id", "service", F.posexplode("features").alias("ix", "value"))
    ranked = within_event_percentiles(long).groupBy("case_id", "service").agg(F.sort_array(F.collect_list(F.struct("ix", "value", "pct"))).alias("own"))
    return ranked.select(
        "case_id", "service", F.concat(F.transform("own", lambda o: o["value"]), F.transform("own", lambda o: o["pct"])).alias("features")
    )
