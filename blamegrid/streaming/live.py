"""Telemetry as it arrives: sums and counts per series and bin, with a watermark for late rows.

The result has the shape of ``operators.telemetry.bin_sums``, so finished bins can be stored and aligned
with cases later without reading the raw rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import GridSpec, finite


def stream_bin_sums(rows: DataFrame, keys: Sequence[str], spec: GridSpec, time: str = "time", late: str = "10 minutes") -> DataFrame:
    """(keys, slot, total, n) of a stream ``rows(keys, time, value)``; rows later than ``late`` are dropped."""
    width = f"{round(spec.bin_seconds * 1000)} milliseconds"
    good = rows.filter(finite(F.col("value"))).withWatermark(time, late)
    sums = good.groupBy(F.window(time, width), *keys).agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    slot = F.floor(F.unix_millis(F.col("window.start")) / (spec.bin_seconds * 1000))
    return sums.select(*keys, slot.alias("slot"), "total", "n")
