"""The event-relative time grid and the feature vocabulary."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Channels and features, in the order of the vectors.
CHANNELS = ("metric", "log", "trace-error", "trace-latency")
BASE = ("magnitude", "mean_impact", "pre_post_shift", "onset_seconds", "onset_missing", "persistence", "coverage", "channel_available")
MORPHOLOGY = (
    "normalized_pre_mean",
    "normalized_post_mean",
    "normalized_post_minus_pre_mean",
    "post_peak_time_fraction",
    "post_amplitude_weighted_centroid_fraction",
    "post_ols_slope",
    "post_mean_absolute_adjacent_difference",
    "post_fraction_z_ge_0_5",
    "morphology_active",
)
FEATURE_NAMES = tuple(f"{channel}.{name}" for channel in CHANNELS for name in BASE + MORPHOLOGY)
FEATURE_DIGEST = hashlib.sha256("\n".join(FEATURE_NAMES).encode()).hexdigest()
TINY = 1e-6
MAGNITUDE_CAP = 20.0


@dataclass(frozen=True)
class GridSpec:
    """``pre_bins`` and ``post_bins`` bins of ``bin_seconds`` before and after the anchor."""

    bin_seconds: float = 15.0
    pre_bins: int = 40
    post_bins: int = 40
    onset_threshold: float = 3.0

    def __post_init__(self):
        if self.bin_seconds <= 0 or self.pre_bins < 1 or self.post_bins < 2:
            raise ValueError("a grid needs positive bins on both sides of the anchor")

    @property
    def bins(self) -> int:
        return self.pre_bins + self.post_bins

    @property
    def onset_sentinel(self) -> float:
        return self.post_bins * self.bin_seconds

    @property
    def last_post(self) -> float:
        return float(self.post_bins - 1)

    def bin_of(self, seconds: Column, anchor: Column) -> Column:
        """Bin of a time; null outside of the window or for a time that isn't finite."""
        index = F.floor((seconds - (anchor - self.pre_bins * self.bin_seconds)) / self.bin_seconds)
        return F.when(finite(seconds) & (index >= 0) & (index < self.bins), index.cast("int"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def is_post(spec: GridSpec) -> Column:
    return F.col("bin") >= spec.pre_bins


def channel_index(channel: Column) -> Column:
    found = F.lit(None).cast("int")
    for k, name in enumerate(CHANNELS):
        found = F.when(channel == name, F.lit(k)).otherwise(found)
    return found
