"""From profiles to features: magnitude, onset, persistence, shape; vectors of three sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grid import BASE, CHANNELS, FEATURE_NAMES, MAGNITUDE_CAP, MORPHOLOGY, TINY, GridSpec, channel_index, is_post

CELL = ("case_id", "service", "channel")


def cell_features(profile: DataFrame, spec: GridSpec) -> DataFrame:
    """Base and shape features of each (case, service, channel) that has any bin; one shuffle.

    An unavailable channel (nothing before or nothing after the event) has onset 0, onset_missing 1 and
    its coverage, all else 0. A profile below 1e-6 throughout has no shape.
    """
    cell, ordered = W.partitionBy(*CELL), W.partitionBy(*CELL).orderBy("bin")
    q, z, bin_ = F.col("q"), F.col("z"), F.col("bin")
    post, high = is_post(spec), spec.onset_threshold
    starts = post & (q >= high) & (F.col("next_bin") == bin_ + 1) & (F.col("next_q") >= high)
    steady = (bin_ - F.col("last_bin") == 1) & (F.col("last_bin") >= spec.pre_bins)
    later = F.when(post, (bin_ - spec.pre_bins).cast("double"))
    rows = (
        profile.withColumn("top", F.max("q").over(cell))
        .withColumn("z", q / (F.col("top") + TINY))
        .withColumn("next_bin", F.lead("bin").over(ordered))
        .withColumn("next_q", F.lead("q").over(ordered))
        .withColumn("last_bin", F.lag("bin").over(ordered))
        .withColumn("last_z", F.lag("z").over(ordered))
        .withColumn("later", later)
    )
    weight = F.when(post, F.greatest(z, F.lit(0.0)))
    sums = rows.groupBy(*CELL).agg(
        F.count(F.when(~post, q)).alias("n_pre"),
        F.count(F.when(post, q)).alias("n_post"),
        F.max(F.when(post, q)).alias("magnitude"),
        F.avg(F.when(post, q)).alias("post_mean"),
        F.avg(F.when(~post, q)).alias("pre_mean"),
        F.avg(F.when(post, (q >= high).cast("double"))).alias("persistence"),
        F.min(F.when(starts, bin_ - spec.pre_bins)).alias("onset"),
        F.max("top").alias("top"),
        F.avg(F.when(~post, z)).alias("pre_z"),
        F.avg(F.when(post, z)).alias("post_z"),
        F.max_by("later", F.when(post, F.struct(z, -F.col("later")))).alias("peak"),
        F.sum(F.col("later") * weight).alias("moment"),
        F.sum(weight).alias("mass"),
        F.regr_slope(F.when(post, z), F.col("later") / spec.last_post).alias("slope"),
        F.avg(F.when(post & steady, F.abs(z - F.col("last_z")))).alias("wobble"),
        F.avg(F.when(post, (z >= 0.5).cast("double"))).alias("high_share"),
    )
    there = (F.col("n_pre") > 0) & (F.col("n_post") > 0)
    shaped = there & (F.col("top") >= TINY)

    def base(x: Column, otherwise: float = 0.0) -> Column:
        return F.coalesce(F.when(there, x), F.lit(otherwise))

    def shape(x: Column) -> Column:
        return F.coalesce(F.when(shaped, x), F.lit(0.0))

    onset = F.coalesce(F.col("onset") * spec.bin_seconds, F.lit(spec.onset_sentinel))
    values = {
        "magnitude": base(F.col("magnitude")),
        "mean_impact": base(F.col("post_mean")),
        "pre_post_shift": base(F.col("post_mean") - F.col("pre_mean")),
        "onset_seconds": base(onset.cast("double")),
        "onset_missing": base(F.col("onset").isNull().cast("double"), 1.0),
        "persistence": base(F.col("persistence")),
        "coverage": (F.col("n_pre") + F.col("n_post")) / float(spec.bins),
        "channel_available": there.cast("double"),
        "normalized_pre_mean": shape(F.col("pre_z")),
        "normalized_post_mean": shape(F.col("post_z")),
        "normalized_post_minus_pre_mean": shape(F.col("post_z") - F.col("pre_z")),
        "post_peak_time_fraction": shape(F.col("peak") / spec.last_post),
        "post_amplitude_weighted_centroid_fraction": shape(F.when(F.col("mass") > 0, F.col("moment") / F.nullif(F.col("mass"), F.lit(0.0)) / spec.last_post)),
        "post_ols_slope": shape(F.when(F.col("n_post") >= 2, F.col("slope"))),
        "post_mean_absolute_adjacent_difference": shape(F.col("wobble")),
        "post_fraction_z_ge_0_5": shape(F.col("high_share")),
        "morphology_active": shaped.cast("double"),
    }
    return sums.select(*CELL, *(v.alias(k) for k, v in values.items()))


def densified(cells: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row for every candidate and channel of every case; what has no telemetry is unavailable."""
    channels = F.explode(F.array(*(F.lit(c) for c in CHANNELS))).alias("channel")
    grid = candidates.select("case_id", F.col("candidate").alias("service")).distinct().select("case_id", "service", channels)
    fill = {name: 1.0 if name == "onset_missing" else 0.0 for name in BASE + MORPHOLOGY}
    return grid.join(cells, list(CELL), "left").fillna(fill)


def magnitudes(dense: DataFrame) -> DataFrame:
    """(case_id, service, a): the mean over available channels of the magnitude, at most 20; else 0."""
    total = F.sum(F.least(F.col("magnitude"), F.lit(MAGNITUDE_CAP)))
    return dense.groupBy("case_id", "service").agg(F.coalesce(total / F.nullif(F.sum("channel_available"), F.lit(0.0)), F.lit(0.0)).alias("a"))


def trajectories(profile: DataFrame, dense: DataFrame, spec: GridSpec) -> DataFrame:
    """Per cell of ``dense``: arrays z and mask over all bins (z is 0 where nothing was seen or shape is inactive)."""
    seen = profile.groupBy(*CELL).agg(F.map_from_entries(F.collect_list(F.struct("bin", "q"))).alias("seen"), F.max("q").alias("top"))
    rows = dense.join(seen, list(CELL), "left")
    bins = F.sequence(F.lit(0), F.lit(spec.bins - 1))
    shaped = F.col("morphology_active") > 0
    value = F.transform(bins, lambda b: F.coalesce(F.when(shaped, F.try_element_at("seen", b) / (F.col("top") + TINY)), F.lit(0.0)))
    mask = F.transform(bins, lambda b: F.coalesce(F.map_contains_key("seen", b), F.lit(False)).cast("double"))
    return rows.withColumn("z", value).withColumn("mask", mask).drop("seen", "top")


def _flat(rows: DataFrame, own: Column, name: str) -> DataFrame:
    """One array per (case, service): the channels' arrays one after the other."""
    parts = rows.withColumn("own", own).groupBy("case_id", "service").agg(
        F.sort_array(F.collect_list(F.struct(channel_index(F.col("channel")).alias("ix"), "own"))).alias("parts")
    )
    return parts.select("case_id", "service", F.flatten(F.transform("parts", lambda p: p["own"])).alias(name))


def feature_vectors(dense: DataFrame, variant: str = "z2") -> DataFrame:
    """(case_id, service, features): z0 (the magnitude), z1 (base), z2 (base and shape, by channel), z3.

    z3 needs the arrays of ``trajectories`` and has 169 numbers per channel: base, z, mask, active.
    """
    if variant == "z0":
        return magnitudes(dense).select("case_id", "service", F.array("a").alias("features"))
    if variant == "z3":
        return _flat(dense, F.concat(F.array(*BASE), "z", "mask", F.array("morphology_active")), "features")
    if variant not in ("z1", "z2"):
        raise ValueError("variant is z0, z1, z2 or z3")
    return _flat(dense, F.array(*(BASE if variant == "z1" else BASE + MORPHOLOGY)), "features")


def long_view(vectors: DataFrame, names: tuple[str, ...] = FEATURE_NAMES) -> DataFrame:
    """(case_id, service, ix, name, value) of the vectors; name is null where ``names`` has none."""
    named = F.get(F.array(*(F.lit(n) for n in names)), F.col("ix"))
    return vectors.select("case_id", "service", F.posexplode("features").alias("ix", "value")).select("case_id", "service", "ix", named.alias("name"), "value")


def temporal_shuffle(rows: DataFrame, spec: GridSpec, salt: str = "shuffle") -> DataFrame:
    """z and mask with their bins in a pseudo-random order, the same for all services and channels of a case."""
    order = F.transform(
        F.sequence(F.lit(0), F.lit(spec.bins - 1)), lambda b: F.struct(F.sha2(F.concat_ws(":", F.lit(salt), F.col("case_id"), b), 256).alias("key"), b.alias("bin"))
    )
    moved = F.transform(F.array_sort(order), lambda o: o["bin"])
    cases = rows.select("case_id").distinct().withColumn("moved", moved)  # one hash per case and bin
    joined = rows.join(cases, "case_id")
    for c in ("z", "mask"):
        values = F.col(c)
        joined = joined.withColumn(c, F.transform("moved", lambda b: F.get(values, b)))
    return joined.drop("moved")
