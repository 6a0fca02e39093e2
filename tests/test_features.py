"""Hand-computed telemetry, profiles and features."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blamegrid.functions.grid import BASE, FEATURE_NAMES, MORPHOLOGY, GridSpec
from blamegrid.operators import features, normalize, telemetry

GRID = GridSpec()


def candidates(spark, *names, case="c"):
    return spark.createDataFrame([(case, n) for n in names], "case_id string, candidate string")


def profile(spark, cells, service="a", channel="metric"):
    return spark.createDataFrame([("c", service, channel, b, float(q)) for b, q in cells.items()], "case_id string, service string, channel string, bin int, q double")


def cell(spark, cells):
    return features.cell_features(profile(spark, cells), GRID).first().asDict()


def test_step_series(spark):
    rows = []
    for k in range(80):
        for name, value in (("a_cpu", 1.0), ("a_mem", 1.0), ("b_cpu", 1.0 + 0.1 * (k % 3) if k < 40 else 10.0)):
            rows.append(("c", "metric", name, 15.0 * k, value, 600.0))
    df = spark.createDataFrame(rows, "case_id string, channel string, indicator string, ts double, value double, anchor double")
    services = telemetry.indicator_services(df, candidates(spark, "a", "b"))
    binned = telemetry.binned_mean(df, services, GRID)
    q = normalize.service_profile(normalize.robust_scale(binned, GRID))
    assert {r["service"] for r in q.collect()} == {"b"}  # a is constant: no scale, no profile
    dense = features.densified(features.cell_features(q, GRID), candidates(spark, "a", "b", "missing"))
    vectors = features.feature_vectors(dense).collect()
    assert {r["service"]: len(r["features"]) for r in vectors} == {"a": 68, "b": 68, "missing": 68}
    assert [len(r["features"]) for r in features.feature_vectors(dense, "z1").collect()] == [32] * 3
    with_z = features.trajectories(q, dense, GRID)
    assert [len(r["features"]) for r in features.feature_vectors(with_z, "z3").collect()] == [676] * 3
    gone = dense.filter("service = 'missing' AND channel = 'metric'").first()
    assert (gone["onset_seconds"], gone["onset_missing"], gone["channel_available"]) == (0.0, 1.0, 0.0)
    b = dense.filter("service = 'b' AND channel = 'metric'").first()
    assert b["onset_seconds"] == 0.0 and b["onset_missing"] == 0.0 and b["persistence"] == 1.0 and b["coverage"] == 1.0
    assert {r["service"]: r["a"] for r in features.magnitudes(dense).collect()} == {"a": 0.0, "b": 20.0, "missing": 0.0}
    for r in with_z.collect():
        assert all(z == 0 for z, m in zip(r["z"], r["mask"]) if not m)


def test_names_are_channel_major():
    assert len(FEATURE_NAMES) == 68 and FEATURE_NAMES[0] == "metric.magnitude" and FEATURE_NAMES[17] == "log.magnitude"
    assert len(BASE) == 8 and len(MORPHOLOGY) == 9


def test_onset_needs_the_next_bin(spark):
    assert cell(spark, {0: 1, 78: 5, 79: 5})["onset_seconds"] == 38 * 15.0
    lone = cell(spark, {0: 1, 79: 5})
    assert (lone["onset_seconds"], lone["onset_missing"]) == (600.0, 1.0)
    assert cell(spark, {0: 1, 50: 5, 52: 5})["onset_missing"] == 1.0
    assert cell(spark, {0: 1, 39: 9, 40: 9, 41: 9})["onset_seconds"] == 0.0


def test_peak_tie_and_single_bin(spark):
    tied = cell(spark, {0: 1, 45: 4, 50: 4})
    assert tied["post_peak_time_fraction"] == pytest.approx(5 / 39)
    one = cell(spark, {0: 1, 45: 4})
    assert one["post_ols_slope"] == 0.0 and one["post_mean_absolute_adjacent_difference"] == 0.0
    x = np.array([2, 3, 7]) / 39
    z = np.array([1.0, 2.0, 4.0]) / (4.0 + 1e-6)
    sloped = cell(spark, {0: 1, 42: 1, 43: 2, 47: 4})
    assert sloped["post_ols_slope"] == pytest.approx(np.polyfit(x, z, 1)[0])
    assert sloped["post_mean_absolute_adjacent_difference"] == pytest.approx(1 / (4 + 1e-6))
    assert sloped["post_amplitude_weighted_centroid_fraction"] == pytest.approx(np.average([2, 3, 7], weights=z) / 39)


def test_one_sided_and_flat_channels(spark):
    for cells in ({0: 5, 1: 5}, {41: 5, 42: 5}):
        got = cell(spark, cells)
        assert got.pop("coverage") == 2 / 80 and got.pop("onset_missing") == 1.0
        assert all(v == 0.0 for k, v in got.items() if k not in ("case_id", "service", "channel"))
    flat = cell(spark, {0: 0, 41: 1e-7})
    assert flat["channel_available"] == 1.0 and flat["morphology_active"] == 0.0


def test_scale_falls_back_to_quartiles(spark):
    x = [0.0] * 5 + [1.0, 2.0, 3.0]  # more than half equal: no median deviation
    rows = [("c", "s", "metric", "i", k, v) for k, v in enumerate(x)] + [("c", "s", "metric", "flat", k, 2.0) for k in range(8)] + [("c", "s", "metric", "late", 50, 1.0)]
    binned = spark.createDataFrame(rows, "case_id string, service string, channel string, indicator string, bin int, x double")
    got = {r["indicator"]: r["scale"] for r in normalize.robust_scale(binned, GRID).collect()}
    assert got["i"] == pytest.approx((np.percentile(x, 75) - np.percentile(x, 25)) / 1.349)
    assert got["flat"] is None and got["late"] is None


def test_window_edges_and_bad_cells(spark):
    rows = [("c", "metric", "a_x", t, v, 600.0) for t, v in ((0.0, 1.0), (-0.001, 2.0), (1200.0, 3.0), (1199.9, 4.0), (5.0, math.inf), (6.0, math.nan), (math.nan, 5.0), (None, 6.0))]
    df = spark.createDataFrame(rows, "case_id string, channel string, indicator string, ts double, value double, anchor double")
    services = telemetry.indicator_services(df, candidates(spark, "a"))
    assert {(r["bin"], r["x"]) for r in telemetry.binned_mean(df, services, GRID).collect()} == {(0, 1.0), (79, 4.0)}
    shared = telemetry.case_windows(df.select("ts", "value"), df.select("case_id", "anchor").distinct(), GRID)
    assert sorted((r["bin"], str(r["value"])) for r in shared.collect()) == [(0, "1.0"), (0, "inf"), (0, "nan"), (79, "4.0")]


def test_longest_candidate_alias_and_exclusions(spark):
    names = [("metric", n) for n in ("ts_a_cpu", "ts_cpu", "ts_a_latency-50", "frontendservice_x", "other_x", "ts", "time")]
    names += [("trace-latency", n) for n in ("frontendservice_x", "ts_a_latency-50")]
    df = spark.createDataFrame([("c", *n) for n in names], "case_id string, channel string, indicator string")
    got = {(r["channel"], r["indicator"]): r["service"] for r in telemetry.indicator_services(df, candidates(spark, "ts", "ts_a", "frontend")).collect()}
    assert got == {
        ("metric", "ts_a_cpu"): "ts_a", ("metric", "ts_cpu"): "ts", ("trace-latency", "frontendservice_x"): "frontend", ("trace-latency", "ts_a_latency-50"): "ts_a",
    }


def test_wide_to_long_coerces(spark):
    wide = spark.createDataFrame([("c", "1", "2.5", "x"), ("c", "2", "", None)], "case_id string, time string, a_cpu string, b_cpu string")
    got = sorted(map(tuple, telemetry.wide_to_long(wide, ["case_id"], "time").collect()), key=str)
    assert got == sorted([("c", 1.0, "a_cpu", 2.5), ("c", 1.0, "b_cpu", None), ("c", 2.0, "a_cpu", None), ("c", 2.0, "b_cpu", None)], key=str)


def test_shuffle_moves_z_and_mask_alike(spark):
    q = profile(spark, {k: k + 1 for k in range(80)})
    dense = features.densified(features.cell_features(q, GRID), candidates(spark, "a"))
    rows = features.trajectories(q, dense, GRID).filter("channel = 'metric'")
    before, after = rows.first(), features.temporal_shuffle(rows, GRID).first()
    assert sorted(before["z"]) == sorted(after["z"]) and before["z"] != after["z"]
    assert features.temporal_shuffle(rows, GRID).first()["z"] == after["z"]


def test_shuffled_input_gives_the_same(spark):
    cells = {k: (k * 7) % 11 for k in range(0, 80, 3)}
    assert features.cell_features(profile(spark, cells).orderBy(F.rand(1)), GRID).first() == features.cell_features(profile(spark, cells), GRID).first()


def test_bad_grids():
    for bad in ({"bin_seconds": 0}, {"pre_bins": 0}, {"post_bins": 1}):
        with pytest.raises(ValueError):
            GridSpec(**bad)
