"""Telemetry onto the grid: wide to long, indicators to services, times to bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import GridSpec, finite
from ..functions.names import trace_alias

BROADCAST_CASES, SALTS = 100_000, 32


def wide_to_long(wide: DataFrame, ids: Sequence[str], time: str, indicators: Sequence[str] | None = None) -> DataFrame:
    """``ids``, ts, indicator, value: one row per cell; cells that are no numbers become null."""
    columns = [c for c in (indicators or wide.columns) if c not in {*ids, time}]
    text = wide.select(*ids, F.col(f"`{time}`").cast("string").alias("ts"), *(F.col(f"`{c}`").cast("string").alias(c) for c in columns))
    long = text.unpivot([*ids, "ts"], [f"`{c}`" if "." in c else c for c in columns], "indicator", "value")
    return long.select(*ids, F.expr("try_cast(ts AS double)").alias("ts"), "indicator", F.expr("try_cast(value AS double)").alias("value"))


def kept_indicators(rows: DataFrame, time: str = "time") -> DataFrame:
    """Without the time column and, in the metric channel, without median latencies."""
    latency = (F.col("channel") == "metric") & F.col("indicator").endswith("_latency-50")
    return rows.filter((F.col("indicator") != time) & ~latency)


def indicator_services(indicators: DataFrame, candidates: DataFrame) -> DataFrame:
    """(case_id, channel, indicator, service): the longest candidate that, with ``_``, begins the indicator.

    Both sides are cut into the prefixes that end at an underscore, so the match is an equi-join; a
    candidate may hold underscores itself. Indicators that no candidate begins are dropped.
    """
    named = kept_indicators(indicators.select("case_id", "channel", "indicator").distinct())
    parts = F.split(trace_alias(F.col("indicator"), F.col("channel")), "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))
    cut = named.filter(F.contains(trace_alias(F.col("indicator"), F.col("channel")), F.lit("_"))).withColumn("service", F.explode(prefixes))
    known = candidates.select("case_id", F.col("candidate").alias("service")).distinct()
    found = cut.join(known, ["case_id", "service"])
    return found.groupBy("case_id", "channel", "indicator").agg(F.max_by("service", F.length("service")).alias("service"))


def case_windows(rows: DataFrame, cases: DataFrame, spec: GridSpec, broadcast_cases: int = BROADCAST_CASES) -> DataFrame:
    """``rows(ts, ...)`` of a shared stream in each case's window, with case_id and bin; anchors lie anywhere.

    Time is cut into stretches as long as a window: a case touches two or three of them, which makes the
    range join an equi-join with a residual condition. Up to ``broadcast_cases`` cases go to every task;
    beyond that the rows of a stretch are dealt over SALTS keys, so that a busy stretch is no single task.
    """
    length = spec.bins * spec.bin_seconds
    start = F.col("anchor") - spec.pre_bins * spec.bin_seconds
    spread = cases.select("case_id", "anchor", F.explode(F.sequence(F.floor(start / length), F.floor((start + length) / length))).alias("stretch"))
    timed = rows.filter(finite(F.col("ts"))).withColumn("stretch", F.floor(F.col("ts") / length))
    keys = ["stretch"]
    if cases.limit(broadcast_cases + 1).count() <= broadcast_cases:
        spread = F.broadcast(spread)
    else:
        keys.append("salt")
        timed = timed.withColumn("salt", F.pmod(F.xxhash64("ts", *(c for c in rows.columns if c != "ts")), F.lit(SALTS)).cast("int"))
        spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = timed.join(spread, keys).withColumn("bin", spec.bin_of(F.col("ts"), F.col("anchor")))
    return joined.filter("bin IS NOT NULL").drop("anchor", *keys)


def bin_sums(rows: DataFrame, keys: Sequence[str], spec: GridSpec) -> DataFrame:
    """Sum and count per ``keys`` and absolute bin of finite values: what all cases on the grid share."""
    good = rows.filter(finite(F.col("value")) & finite(F.col("ts")))
    return good.groupBy(*keys, F.floor(F.col("ts") / spec.bin_seconds).alias("slot")).agg(F.sum("value").alias("total"), F.count("value").alias("n"))


def aligned_bins(sums: DataFrame, cases: DataFrame, spec: GridSpec) -> DataFrame:
    """(case_id, keys, bin, x) from ``bin_sums`` for cases whose anchors lie on the grid: an equi-join on slots."""
    first = F.floor(F.col("anchor") / spec.bin_seconds) - spec.pre_bins
    slots = cases.select("case_id", first.alias("first"), F.explode(F.sequence(F.lit(0), F.lit(spec.bins - 1))).alias("bin")).select(
        "case_id", (F.col("first") + F.col("bin")).alias("slot"), "bin"
    )
    return sums.join(slots, "slot").withColumn("x", F.col("total") / F.col("n")).drop("slot", "total", "n")


def binned_mean(rows: DataFrame, services: DataFrame, spec: GridSpec) -> DataFrame:
    """(case_id, service, channel, indicator, bin, x) of ``rows(case_id, channel, indicator, ts, value, anchor)``."""
    placed = rows.withColumn("bin", spec.bin_of(F.col("ts"), F.col("anchor"))).filter(F.col("bin").isNotNull() & finite(F.col("value")))
    named = placed.join(services, ["case_id", "channel", "indicator"])
    return named.groupBy("case_id", "service", "channel", "indicator", "bin").agg(F.avg("value").alias("x"))
