"""Comparing two rankers: paired deltas, stratified bootstrap, factorial effects, the gate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialize
from .positions import sums_before

SLICE, BROADCAST_CASES = 4096, 200_000


def paired_deltas(left: DataFrame, right: DataFrame, metric: str = "Avg@5", stratum: int | None = None) -> DataFrame:
    """(case_id, fault, delta) of two tables of case metrics; a case on one side alone, or with two faults, raises.

    With ``stratum``, so does a fault that hasn't exactly that many cases.
    """
    sides = [d.select("case_id", F.col("fault").alias(f"fault_{s}"), F.col(f"`{metric}`").alias(s), F.lit(True).alias(f"has_{s}")) for d, s in ((left, "l"), (right, "r"))]
    both = sides[0].join(sides[1], "case_id", "full_outer")
    told = lambda why: F.raise_error(F.concat(F.lit(why), F.coalesce(F.col("case_id").cast("string"), F.lit("null")))).cast("double")
    alone = F.col("has_l").isNull() | F.col("has_r").isNull()
    delta = F.when(alone, told("unpaired case ")).when(~F.col("fault_l").eqNullSafe(F.col("fault_r")), told("two faults for case ")).otherwise(F.col("l") - F.col("r"))
    found = both.select("case_id", F.col("fault_l").alias("fault"), delta.alias("delta"))
    if stratum is None:
        return found
    sizes = found.groupBy("fault").agg(F.count(F.lit(1)).alias("size")).select(F.col("fault").alias("of"), "size")
    wrong = F.raise_error(F.concat(F.lit("unequal strata: "), F.coalesce(F.col("fault"), F.lit("null")), F.lit(" has "), F.col("size").cast("string"))).cast("double")
    met = found.join(sizes, F.col("fault").eqNullSafe(F.col("of")))
    return met.select("case_id", "fault", F.when(F.col("size") != stratum, wrong).otherwise(F.col("delta")).alias("delta"))


def mean_deltas(deltas: DataFrame) -> DataFrame:
    """(fault, n, mean_delta) by fault and, with fault ``all``, over all cases."""
    rows = deltas.select(F.explode(F.array(F.lit("all"), F.col("fault"))).alias("fault"), "delta")
    return rows.groupBy("fault").agg(F.count("delta").alias("n"), F.avg("delta").alias("mean_delta"))


def bootstrap_ci(deltas: DataFrame, resamples: int = 10_000, seed: int = 7) -> DataFrame:
    """One row: n, point, low, high: 95 % percentile interval of the mean over stratified resamples.

    Each resample draws every fault's number of cases from that fault, with replacement; a draw is a hash
    of (seed, resample, fault, slot), so reruns agree whatever the partitioning. Cases are numbered inside
    their fault, draws are made in slices of SLICE slots all over the cluster, meet the cases by number and
    are summed by resample before they are shuffled: no task holds a fault's cases.
    """
    cases = materialize(deltas.filter("delta IS NOT NULL").select("fault", "case_id", "delta"), "deltas")
    placed = sums_before(cases, ["fault"], ["case_id", "delta"], F.lit(1), "place")
    numbered = materialize(placed, "numbered").withColumnRenamed("fault", "of")
    discard(placed)
    sizes = cases.groupBy("fault").agg(F.count(F.lit(1)).alias("size"))
    slices = sizes.withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn(
        "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(SLICE).cast("long")))
    )
    slots = slices.repartition("resample", "first").withColumn("slot", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + SLICE, F.col("size")) - 1)))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("resample"), F.col("fault"), F.col("slot")))
    draws = slots.select("resample", "fault", (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % F.col("size")).alias("drawn"))
    side = numbered.select("of", "place", "delta")
    if cases.count() <= BROADCAST_CASES:
        side = F.broadcast(side)
    met = draws.join(side, F.col("fault").eqNullSafe(F.col("of")) & (F.col("drawn") == F.col("place")))
    means = met.groupBy("resample").agg(F.avg("delta").alias("mean"))
    ends = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    interval = means.agg(F.get(ends, F.lit(0)).alias("low"), F.get(ends, F.lit(1)).alias("high"))
    return cases.agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("point")).join(F.broadcast(interval))  # one row each


def factorial_effects(variants: DataFrame) -> DataFrame:
    """One row of effects from ``variants(variant, value)`` with variants A0 to A3 of a 2 x 2 design."""
    wide = variants.groupBy().pivot("variant", ["A0", "A1", "A2", "A3"]).agg(F.first("value"))
    a0, a1, a2, a3 = (F.col(v) for v in ("A0", "A1", "A2", "A3"))
    return wide.select(
        (a1 - a0).alias("a1_a0"), (a3 - a2).alias("a3_a2"), (a2 - a0).alias("a2_a0"), (a3 - a1).alias("a3_a1"), ((a3 - a2) - (a1 - a0)).alias("interaction")
    )


#: Thresholds of the promotion gate.
GATE: Mapping[str, float] = {"mean_delta": 0.01, "ac1_drop": -0.01}


def gate_decision(deltas: DataFrame) -> DataFrame:
    """Checks and decision from one row (avg5_first, avg5_second, ac1_first, ac1_second, ci_low, integrity)."""
    c = {name: F.coalesce(F.col(name), F.lit(float("-inf"))) for name in ("avg5_first", "avg5_second", "ac1_first", "ac1_second", "ci_low")}
    checks = {
        "first_delta_positive": c["avg5_first"] > 0,
        "second_delta_positive": c["avg5_second"] > 0,
        "mean_delta_threshold": (c["avg5_first"] + c["avg5_second"]) / 2.0 >= GATE["mean_delta"],
        "ac1_guardrail": (c["ac1_first"] >= GATE["ac1_drop"]) & (c["ac1_second"] >= GATE["ac1_drop"]),
        "ci_low_positive": c["ci_low"] > 0,
        "integrity": F.coalesce(F.col("integrity"), F.lit(False)),
    }
    passed = F.lit(True)
    for check in checks.values():
        passed = passed & check
    return deltas.select(*(v.alias(k) for k, v in checks.items()), passed.alias("passed"))
