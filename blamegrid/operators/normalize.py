"""Each series against its own past: robust centre and scale, deviations, the services' profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grid import TINY, GridSpec
from ..sources.scratch import materialize
from .positions import sums_before

#: Indicators of a service whose deviations may meet in one task, and services with more that are broadcast.
MOST_SERIES, BROADCAST_CROWDED = 100_000, 100_000

SERIES = ("case_id", "service", "channel", "indicator")


def robust_scale(binned: DataFrame, spec: GridSpec) -> DataFrame:
    """``binned`` with center, scale (null where the past shows no spread or is missing).

    1.4826 times the median absolute deviation of the bins before the event, or where that vanishes the
    interquartile range over 1.349. All of it is windows over one partitioning by series.
    """
    series = W.partitionBy(*SERIES)
    past = F.when(F.col("bin") < spec.pre_bins, F.col("x"))
    centred = binned.withColumn("center", F.median(past).over(series))
    mad = 1.4826 * F.median(F.abs(past - F.col("center"))).over(series)
    spread = (F.percentile(past, F.lit(0.75)).over(series) - F.percentile(past, F.lit(0.25)).over(series)) / 1.349
    scaled = centred.withColumn("mad", mad).withColumn("iqr", spread)
    scale = F.when(F.col("mad") >= TINY, F.col("mad")).when(F.col("iqr") >= TINY, F.col("iqr"))
    return scaled.withColumn("scale", scale).drop("mad", "iqr")


def crowded_services(services: DataFrame, most: int = MOST_SERIES) -> DataFrame:
    """(case_id, service, channel) of those with more than ``most`` indicators in ``services(case_id, channel, indicator, service)``."""
    sizes = services.groupBy("case_id", "service", "channel").agg(F.count(F.lit(1)).alias("n"))
    return sizes.filter(F.col("n") > most).drop("n")


def service_profile(scaled: DataFrame, crowded: DataFrame | None = None) -> DataFrame:
    """(case_id, service, channel, bin, q): the 90 % quantile of the indicators' absolute deviations.

    Deviations of one service and bin meet in one task, but for services that ``crowded`` names (a table of
    (case_id, service, channel), as of ``crowded_services``): theirs are selected by counting.
    """
    keys = ("case_id", "service", "channel", "bin")
    far = F.abs((F.col("x") - F.col("center")) / (F.col("scale") + TINY))
    good = scaled.filter(F.col("scale").isNotNull()).withColumn("far", far).select(*keys, "far")
    few = lambda rows: rows.groupBy(*keys).agg(F.percentile("far", F.lit(0.9)).alias("q"))
    if crowded is None:
        return few(good)
    named = materialize(crowded.select(*keys[:3]).distinct(), "crowded")
    count = named.limit(BROADCAST_CROWDED + 1).count()
    if not count:
        return few(good)
    good = materialize(good, "deviations")  # read by either side
    side = F.broadcast(named) if count <= BROADCAST_CROWDED else named
    many = quantiles(good.join(side, list(keys[:3]), "left_semi"), keys, "far", 0.9, "q")
    return few(good.join(side, list(keys[:3]), "left_anti")).unionByName(many)


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """(keys..., name): the exact quantile of ``value`` in groups of any size, between neighbours by linear interpolation.

    Equal values are one row with a count, summed up in each task first; how many values come before one follows from sorted
    ranges of these rows and the ranges' sums; what is left of a group are the two rows that hold the neighbours
    of the quantile's place. Nulls don't count; a NaN is greater than all numbers; a null key is a key.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    placed = sums_before(counts, keys, ["_at"], F.col("_n"), "_before")
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total")).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    place = (F.col("_total") - 1) * F.lit(float(share))
    holds = lambda at: (F.col("_before") <= at) & (at < F.col("_before") + F.col("_n"))
    low, high = F.floor(place), F.ceil(place)
    met = placed.join(totals, same).withColumn("_low", F.when(holds(low), F.col("_at"))).withColumn("_high", F.when(holds(high), F.col("_at"))).filter(holds(low) | holds(high))
    found = met.groupBy(*keys).agg(F.max("_low").alias("_low"), F.max("_high").alias("_high"), F.max(place - low).alias("_part"))
    between = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part"))
    return found.select(*keys, between.alias(name))
