"""Conditional logit, percentiles, rankings and statistics on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blamegrid.functions.grid import GridSpec
from blamegrid.operators import condlogit, ranking, relative, splits, stats, telemetry
from blamegrid.operators.positions import sums_before


def vectors(spark, events):
    rows = [(case, service, [float(v) for v in x]) for case, own in events.items() for service, x in own.items()]
    return spark.createDataFrame(rows, "case_id string, service string, features array<double>")


def toy(spark, n=12):
    events, labels = {}, []
    for k in range(n):
        events[f"e{k:02}"] = {"a": (3.0, (k % 3) / 10), "b": (0.5 * (k % 2), 1.0), "c": (-1.0, 0.3 * (k % 4))}
        labels.append((f"e{k:02}", "a" if k % 5 else "b", "cpu", k % 3))
    return vectors(spark, events), spark.createDataFrame(labels, "case_id string, root string, fault string, fold int")


def test_fit_converges_and_repeats(spark):
    v, labels = toy(spark)
    events, scales = condlogit.event_table(v, labels, labels, 3), condlogit.fold_scales(condlogit.scaler_stats(v, labels))
    fits = condlogit.fit(events, scales)
    assert [f["fold"] for f in fits] == [0, 1, 2] and all(f["converged"] and f["gradient_norm"] <= 1e-8 for f in fits)
    assert all(f["initial_loss"] == pytest.approx(8 * math.log(3)) for f in fits)
    again = condlogit.fit(condlogit.event_table(v.orderBy(F.rand(3)), labels, labels, 3), scales)
    assert all((f["weights"] == g["weights"]).all() for f, g in zip(fits, again))


def test_fit_against_a_plain_one(spark):
    """Scores of held-out cases against Newton steps on whole matrices, in numpy."""
    v, labels = toy(spark)
    rows, told = v.orderBy("case_id", "service").collect(), {r["case_id"]: r for r in labels.collect()}
    want = {}
    for fold in range(3):
        train = [r for r in rows if told[r["case_id"]]["fold"] != fold]
        x = np.array([r["features"] for r in train])
        mean, scale = x.mean(axis=0), x.std(axis=0)
        cases = {}
        for r in train:
            cases.setdefault(r["case_id"], []).append((r["service"], (np.array(r["features"]) - mean) / scale))
        w = np.zeros(2)
        for _ in range(30):
            g, h = w.copy(), np.eye(2)
            for case, own in cases.items():
                z = np.array([f for _, f in own])
                p = np.exp(z @ w) / np.exp(z @ w).sum()
                g += p @ z - z[[s for s, _ in own].index(told[case]["root"])]
                h += (z - p @ z).T @ (p[:, None] * (z - p @ z))
            w = w - np.linalg.solve(h, g)
        want |= {(r["case_id"], r["service"]): float((np.array(r["features"]) - mean) / scale @ w) for r in rows if told[r["case_id"]]["fold"] == fold}
    got, *_ = condlogit.fit_out_of_fold(v, labels, labels)
    assert {(r["case_id"], r["service"]): r["score"] for r in got.collect()} == pytest.approx(want, abs=1e-7)  # the fit stops at a gradient of 1e-8


def test_sums_of_many_parts(spark, monkeypatch):
    v, labels = toy(spark)
    scales = {f: np.ones(2) for f in range(3)}
    weights = {f: np.array([0.1 * f, -0.2]) for f in range(3)}
    one = condlogit.evaluate(condlogit.event_table(v, labels, labels), weights, scales, 1.0)
    monkeypatch.setattr(condlogit, "FAN_IN", 2)
    many = condlogit.evaluate(condlogit.event_table(v, labels, labels, 7), weights, scales, 1.0, 7)
    for f in range(3):
        assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(one[f], many[f]))
    assert condlogit.event_parts(v, 10) == 12 * 3 * 2 // 10 + 1


def test_an_event_in_many_blocks_and_tasks(spark):
    rng = np.random.default_rng(8)
    events = {"big": {f"s{k:04}": rng.normal(size=3) * 4 for k in range(900)}, "mid": {f"s{k}": rng.normal(size=3) for k in range(40)}, "few": {k: rng.normal(size=3) for k in "ab"}}
    v = vectors(spark, events)
    labels = spark.createDataFrame([("big", "s0123", 0), ("mid", "s7", 1), ("few", "a", 0)], "case_id string, root string, fold int")
    scales, weights = {f: np.array([1.0, 2.0, 0.5]) for f in (0, 1, 9)}, {f: np.array([0.4, -0.9, 0.1 * f]) for f in (0, 1, 9)}
    whole = condlogit.evaluate(condlogit.event_table(v, labels, labels, 2), weights, scales, 1.0)
    cut = condlogit.event_table(v, labels, labels, 6, block_cells=60)
    assert cut.spans and cut.table.count() > 45 and cut.table.rdd.getNumPartitions() == 6 and cut.table.agg(F.max("n")).first()[0] < 60
    found = condlogit.evaluate(cut, weights, scales, 1.0)
    along = {f: np.array([1.0, -0.5, 2.0]) for f in weights}
    products = condlogit.hessian_products(cut, weights, along, scales, 1.0)
    for f in weights:
        assert all(np.allclose(a, b, rtol=1e-11, atol=1e-11) for a, b in zip(whole[f], found[f]))
        assert np.allclose(products[f], found[f][2] @ along[f], rtol=1e-11)
    by_hand = 0.0
    for case, root in (("mid", "s7"),):
        x = np.array(list(events[case].values()))
        score = x @ (weights[0] / scales[0])
        by_hand += np.log(np.exp(score).sum()) - score[list(events[case]).index(root)]
    assert found[0][0] == pytest.approx(by_hand + 0.5 * weights[0] @ weights[0])
    with pytest.raises(Exception, match="the root isn't among the candidates"):
        lost = labels.withColumn("root", F.lit("nobody"))
        condlogit.evaluate(condlogit.event_table(v, lost, lost, 6, block_cells=60), weights, scales, 1.0)


def test_wide_vectors_are_fitted_without_a_matrix(spark):
    rng = np.random.default_rng(9)
    d, events, labels = 676, {}, []
    for k in range(12):
        events[f"e{k}"] = {s: rng.normal(size=d) + (0.3 if s == "a" else 0.0) for s in "abcd"}
        labels.append((f"e{k}", "a", k % 2))
    v, folds = vectors(spark, events), spark.createDataFrame(labels, "case_id string, root string, fold int")
    scales = {f: np.ones(d) for f in (0, 1)}
    table = condlogit.event_table(v, folds, folds, 2)
    got = condlogit.fit(table, scales)
    assert table.received * 8 < 50e6 and all(f["converged"] for f in got)
    plain = condlogit.fit(condlogit.event_table(v, folds, folds, 2), scales, wide=False)
    for a, b in zip(got, plain):
        assert np.allclose(a["weights"], b["weights"], atol=1e-7) and a["final_loss"] == pytest.approx(b["final_loss"], abs=1e-10)


def test_gradient_and_hessian_against_differences(spark):
    v, labels = toy(spark)
    events, scales = condlogit.event_table(v, labels, labels), condlogit.fold_scales(condlogit.scaler_stats(v, labels))
    w, h = np.array([0.3, -0.7]), 1e-5
    loss, gradient, hessian = condlogit.evaluate(events, {0: w}, scales, 1.0)[0]
    for k in range(2):
        step = np.eye(2)[k] * h
        up, down = condlogit.evaluate(events, {0: w + step}, scales, 1.0)[0], condlogit.evaluate(events, {0: w - step}, scales, 1.0)[0]
        assert (up[0] - down[0]) / (2 * h) == pytest.approx(gradient[k], abs=1e-6)
        assert (up[1] - down[1]) / (2 * h) == pytest.approx(hessian[k], abs=1e-6)


def test_loss_counts_events(spark):
    v = vectors(spark, {"two": {"a": [0], "b": [0]}, "four": dict.fromkeys("abcd", [0])})
    labels = spark.createDataFrame([("two", "a", 0), ("four", "a", 0)], "case_id string, root string, fold int")
    sums = condlogit.evaluate(condlogit.event_table(v, labels, labels), {1: np.zeros(1)}, {1: np.ones(1)}, 1.0)
    assert sums[1][0] == pytest.approx(math.log(2) + math.log(4))


def test_out_of_fold_does_not_depend_on_candidate_order(spark):
    v, labels = toy(spark)
    first, weights, fits = condlogit.fit_out_of_fold(v, labels, labels)
    second, *_ = condlogit.fit_out_of_fold(v.orderBy(F.desc("service")), labels, labels)
    diff = ranking.prediction_diff(first, second).first()
    assert diff["same_ranks"] and diff["one_sided"] == 0 and diff["max_score_diff"] <= 1e-12  # the tolerance of a replay
    assert fits.filter("converged").count() == 3 and condlogit.unscored(labels, weights).count() == 0
    p = ranking.event_softmax(first).groupBy("case_id").agg(F.sum("p").alias("p")).collect()
    assert all(r["p"] == pytest.approx(1.0) for r in p)


def test_constant_features_keep_scale_one(spark):
    v = vectors(spark, {"x": {"a": [5, 1], "b": [5, 2]}, "y": {"a": [5, 3], "b": [5, 4]}})
    folds = spark.createDataFrame([("x", 0), ("y", 1)], "case_id string, fold int")
    got = {(r["fold"], r["ix"]): (r["mean"], r["scale"]) for r in condlogit.scaler_stats(v, folds).collect()}
    assert got[(0, 0)] == (5.0, 1.0) and got[(0, 1)] == (3.5, 0.5)


def test_within_event_percentiles(spark):
    v = vectors(spark, {"e": {"a": [1, 4, 7], "b": [1, 2, 7], "c": [3, 2, 7]}})
    got = {r["service"]: r["features"] for r in relative.representation(v, True).collect()}
    assert got == {"a": [1, 4, 7, 0.25, 1, 0.5], "b": [1, 2, 7, 0.25, 0.25, 0.5], "c": [3, 2, 7, 1, 0.25, 0.5]}
    assert relative.representation(v, False).count() == 3


def test_quantiles_of_crowded_groups(spark, monkeypatch):
    from blamegrid.operators import normalize, positions

    monkeypatch.setattr(positions, "RANGE_ROWS", 16)
    rng = np.random.default_rng(7)
    rows = [(None if k % 3 == 0 else f"g{k % 4}", float(rng.integers(0, 60)) / 7 if k % 41 else None) for k in range(900)] + [("one", 2.5), ("none", None)]
    got = {r["g"]: r["q"] for r in normalize.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 0.9, "q").collect()}
    want = {g: np.quantile([v for h, v in rows if h == g and v is not None], 0.9) for g in {g for g, v in rows if v is not None}}
    assert got == pytest.approx(want)
    series = [("c", f"s{k % 2}", "metric", f"i{k}", b, float(rng.normal())) for k in range(12) for b in range(8)]
    scaled = spark.createDataFrame(series, "case_id string, service string, channel string, indicator string, bin int, x double").withColumn("center", F.lit(0.1)).withColumn("scale", F.lit(1.0))
    crowded = normalize.crowded_services(scaled.filter("service = 's1' OR indicator = 'i0'").select("case_id", "channel", "indicator", "service").distinct(), 3)
    assert [r["service"] for r in crowded.collect()] == ["s1"]
    plain = {(r["service"], r["bin"]): r["q"] for r in normalize.service_profile(scaled).collect()}
    for names in (crowded, crowded.limit(0)):
        assert {(r["service"], r["bin"]): r["q"] for r in normalize.service_profile(scaled, names).collect()} == pytest.approx(plain)


def test_percentiles_in_one_large_group(spark, monkeypatch):
    """Values that repeat, null and NaN, over many ranges; no window holds the group."""
    from blamegrid.operators import positions

    monkeypatch.setattr(positions, "RANGE_ROWS", 16)
    rng = np.random.default_rng(6)
    drawn = [None if k % 50 == 0 else float("nan") if k % 70 == 1 else float(rng.integers(0, 90)) / 4 for k in range(1500)]
    rows = [("e", f"s{k}", 0, v) for k, v in enumerate(drawn)] + [("one", "s", 0, 1.0)]
    got = relative.within_event_percentiles(spark.createDataFrame(rows, "case_id string, service string, ix int, value double")).collect()
    order = {s: (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v) for _, s, _, v in rows[:-1]}
    for r in got:
        if r["case_id"] == "one":
            assert r["pct"] is None
        else:
            own = order[r["service"]]
            below, same = sum(o < own for o in order.values()), sum(o == own for o in order.values())
            assert r["pct"] == pytest.approx((below + (same - 1) / 2) / 1499)
    assert len(got) == 1501


def test_foreign_percentiles(spark):
    rng = np.random.default_rng(5)
    own, other = rng.integers(0, 5, (4, 2)), rng.integers(0, 5, (6, 2))
    long = lambda case, m: [(case, f"s{i}", k, float(m[i, k])) for i in range(len(m)) for k in range(2)]
    schema = "case_id string, service string, ix int, value double"
    match = spark.createDataFrame([("x", "y")], "case_id string, context_id string")
    got = relative.foreign_percentiles(spark.createDataFrame(long("x", own), schema), spark.createDataFrame(long("y", other), schema), match)
    for r in got.collect():
        below, same = (other[:, r["ix"]] < r["value"]).sum(), (other[:, r["ix"]] == r["value"]).sum()
        assert r["pct"] == pytest.approx((below + 0.5 * same) / 6)
    assert got.count() == 8


def test_metrics_of_known_ranks(spark):
    order = spark.createDataFrame([("x", s, k + 1) for k, s in enumerate("abcde")] + [("y", s, k + 1) for k, s in enumerate("cab")], "case_id string, service string, rank int")
    labels = spark.createDataFrame([("x", "c", "cpu", 0), ("y", "c", "mem", 1)], "case_id string, root string, fault string, fold int")
    rows = {r["case_id"]: r for r in ranking.case_metrics(order, labels).collect()}
    assert [rows["x"][m] for m in ranking.METRICS] == [0.0, 1.0, 1.0, pytest.approx(0.6), pytest.approx(1 / 3)]
    assert [rows["y"][m] for m in ranking.METRICS] == [1.0] * 5
    groups = {(r["grouping"], r["value"]): r["AC@1"] for r in ranking.metric_groups(ranking.case_metrics(order, labels)).collect()}
    assert groups[("overall", "all")] == 0.5 and groups[("fault", "cpu")] == 0.0 and groups[("fold", "1")] == 1.0 and groups[("root", "c")] == 0.5
    for bad in (0, True, 1.5):
        with pytest.raises(ValueError):
            ranking.hits(bad)


def test_root_ranks_by_counting(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{k % 7}", f"s{k:03}", None if k % 11 == 0 else float(rng.integers(0, 4))) for k in range(300)]
    scores = spark.createDataFrame(rows, "case_id string, service string, score double")
    labels = spark.createDataFrame([(f"c{c}", f"s{c + 7 * k:03}", "cpu", k) for k in range(5) for c in range(7)], "case_id string, root string, fault string, fold int").filter("fold = 3 OR fold = 0 AND case_id = 'c0'")
    labels = labels.dropDuplicates(["case_id"])
    got = ranking.root_metrics(scores, labels)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    want = ranking.case_metrics(ranking.ranked(scores), labels)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="the root is not in the ranking of c2"):
        ranking.root_metrics(scores, labels.withColumn("root", F.when(F.col("case_id") == "c2", "nobody").otherwise(F.col("root")))).collect()


def test_refusals(spark):
    order = spark.createDataFrame([("x", "a", 1), ("y", "a", 1)], "case_id string, service string, rank int")
    labels = spark.createDataFrame([("x", "a", "cpu", 0), ("y", "b", "cpu", 0)], "case_id string, root string, fault string, fold int")
    with pytest.raises(Exception, match="the root is not in the ranking of y"):
        ranking.metric_groups(ranking.case_metrics(order, labels)).collect()
    with pytest.raises(Exception, match="no cases to average"):
        ranking.metric_groups(ranking.case_metrics(order.limit(0), labels.limit(0))).collect()
    v, told = toy(spark)
    _, weights, _ = condlogit.fit_out_of_fold(v, told, told)
    for folds, model in ((told, weights.filter("fold <> 1")), (told.filter("case_id <> 'e03'"), weights)):
        with pytest.raises(Exception, match="no model for case"):
            condlogit.predict(v, folds, model).collect()
    schema = "case_id string, fault string, `Avg@5` double"
    one = spark.createDataFrame([("a", "cpu", 0.5), ("b", "mem", 0.1), ("c", "mem", 0.2)], schema)
    assert {r["case_id"]: r["delta"] for r in stats.paired_deltas(one, one).collect()} == {"a": 0.0, "b": 0.0, "c": 0.0}
    with pytest.raises(Exception, match="unpaired case b"):
        stats.mean_deltas(stats.paired_deltas(one, one.filter("case_id <> 'b'"))).collect()
    with pytest.raises(Exception, match="two faults for case a"):
        stats.paired_deltas(one, one.withColumn("fault", F.when(F.col("case_id") == "a", "disk").otherwise(F.col("fault")))).collect()
    with pytest.raises(Exception, match="unequal strata"):
        stats.paired_deltas(one, one, stratum=2).collect()
    assert stats.paired_deltas(one.filter("fault = 'mem'"), one.filter("fault = 'mem'"), stratum=2).count() == 2
    left = spark.createDataFrame([("x", "a", 1.0, 1)], "case_id string, service string, score double, rank int")
    with pytest.raises(Exception, match="not of the same cases and candidates"):
        ranking.prediction_diff(left, left.limit(0), strict=True).collect()


def test_prediction_gaps(spark):
    names = spark.createDataFrame([("x", s) for s in "abc"], "case_id string, candidate string")
    order = spark.createDataFrame([("x", "a", 1), ("x", "b", 2), ("x", "b", 2), ("x", "z", 3)], "case_id string, service string, rank int")
    assert sorted((r["service"], r["gap"]) for r in ranking.prediction_gaps(names, order).collect()) == [("b", "repeated"), ("c", "missing"), ("z", "unknown")]


def test_ties_are_ranked_by_name(spark):
    scores = spark.createDataFrame([("x", s, 1.0) for s in "cab"], "case_id string, service string, score double")
    assert [r["service"] for r in ranking.ranked(scores).orderBy("rank").collect()] == ["a", "b", "c"]


def cases(spark):
    rows = [(f"{root}-{fault}-{r}", root, fault, r) for root in ("a", "b") for fault in ("cpu", "mem") for r in (1, 2, 3)]
    return splits.assign_folds(spark.createDataFrame(rows, "case_id string, root string, fault string, replicate int"))


def test_splits(spark):
    good = cases(spark)
    assert splits.split_violations(good, cases=12, per_fold=4).count() == 0
    member = splits.fold_membership(good).groupBy("fold", "role").count().collect()
    assert {(r["fold"], r["role"]): r["count"] for r in member} == {(f, role): n for f in range(3) for role, n in (("train", 8), ("test", 4))}
    bad = good.unionByName(good.limit(1)).withColumn("replicate", F.when(F.col("replicate") == 3, 4).otherwise(F.col("replicate")))
    assert {r["rule"] for r in splits.split_violations(bad, cases=12, per_fold=4).collect()} == {"repeated case", "replicate", "stratum", "cases", "fold size"}


def test_bootstrap_repeats_and_brackets(spark):
    rng = np.random.default_rng(2)
    rows = [(f"c{k:02}", f"f{k % 3}", float(rng.normal(0.2, 0.1))) for k in range(30)]
    deltas = spark.createDataFrame(rows, "case_id string, fault string, delta double")
    one, two = stats.bootstrap_ci(deltas, 400).first(), stats.bootstrap_ci(deltas.repartition(3), 400).first()
    assert [one[c] for c in ("low", "high", "n")] == [pytest.approx(two[c], rel=1e-12) for c in ("low", "high", "n")] and one["n"] == 30 and one["low"] < one["point"] < one["high"]
    assert one["high"] - one["low"] == pytest.approx(2 * 1.96 * np.std([r[2] for r in rows]) / math.sqrt(30), rel=0.35)


def test_bootstrap_against_draws_by_hand(spark, monkeypatch):
    import hashlib

    rows = [(f"c{k:02}", f"f{k % 3}", (k * 7 % 11) / 10) for k in range(23)]
    monkeypatch.setattr(stats, "SLICE", 3)
    pools = {}
    for case, fault, delta in sorted(rows):
        pools.setdefault(fault, []).append(delta)
    means = []
    for r in range(1, 51):
        drawn = [own[int(hashlib.md5(f"7:{r}:{fault}:{k}".encode()).hexdigest()[:8], 16) % len(own)] for fault, own in pools.items() for k in range(len(own))]
        means.append(np.mean(drawn))
    for bound in (0, 100):
        monkeypatch.setattr(stats, "BROADCAST_CASES", bound)
        got = stats.bootstrap_ci(spark.createDataFrame(rows + [("x", "f0", None)], "case_id string, fault string, delta double"), 50).first()
        assert (got["n"], got["low"], got["high"]) == (23, pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975)))


def test_sums_before(spark):
    rng = np.random.default_rng(4)
    rows = [(None if k % 4 == 0 else f"g{k % 3}", int(rng.integers(0, 30)), k, int(rng.integers(0, 9))) for k in range(400)]
    got = sums_before(spark.createDataFrame(rows, "g string, o int, tie int, v int"), ["g"], ["o", "tie"], F.col("v"), "before", 20).collect()
    assert len(got) == 400
    for r in got:
        assert r["before"] == sum(v for g, o, tie, v in rows if g == r["g"] and (o, tie) < (r["o"], r["tie"]))
    assert sums_before(spark.createDataFrame([], "g string, o int"), ["g"], ["o"], F.lit(1), "before").count() == 0


def test_windows_by_broadcast_and_by_salt(spark):
    spec = GridSpec(bin_seconds=10.0, pre_bins=2, post_bins=3)
    cases = spark.createDataFrame([("a", 100.0), ("b", 107.0), ("c", -3.0)], "case_id string, anchor double")
    rows = spark.createDataFrame([(float(t), k % 3) for k, t in enumerate([*range(60, 160, 3), 100, 100, *range(-30, 40, 7)])] + [(float("nan"), 1), (None, 1)], "ts double, value int")
    want = sorted((c, int((t - (a - 20)) // 10), t) for c, a in (("a", 100.0), ("b", 107.0), ("c", -3.0)) for t, in rows.select("ts").collect() if t == t and t is not None and a - 20 <= t < a + 30)
    for bound in (10, 0):
        got = telemetry.case_windows(rows, cases, spec, bound)
        assert got.columns == ["ts", "value", "case_id", "bin"]
        assert sorted((r["case_id"], r["bin"], r["ts"]) for r in got.collect()) == want


def test_metric_diff_sees_every_metric_and_lost_groups(spark):
    groups = spark.createDataFrame([("overall", "all", 1.0, 1.0, 1.0, 1.0, 0.5), ("fold", "0", 1.0, 1.0, 1.0, 1.0, 0.5)], 'grouping string, value string, `AC@1` double, `AC@3` double, `AC@5` double, `Avg@5` double, MRR double')
    other = groups.filter("value = 'all'").withColumn("MRR", F.lit(0.25))
    assert {r["value"]: r["diff"] for r in ranking.metric_diff(groups, other).collect()} == {"all": 0.25, "0": float("inf")}


def test_effects_and_gate(spark):
    effects = stats.factorial_effects(spark.createDataFrame([("A0", 1.0), ("A1", 2.0), ("A2", 4.0), ("A3", 8.0)], "variant string, value double")).first()
    assert tuple(effects) == (1.0, 4.0, 3.0, 6.0, 3.0)
    schema = "avg5_first double, avg5_second double, ac1_first double, ac1_second double, ci_low double, integrity boolean"
    gate = lambda *row: stats.gate_decision(spark.createDataFrame([row], schema)).first()
    assert gate(0.02, 0.01, 0.0, -0.005, 0.001, True)["passed"]
    for bad in ((0.02, 0.01, 0.0, -0.02, 0.001, True), (0.005, 0.005, 0.0, 0.0, 0.001, True), (0.02, 0.01, 0.0, 0.0, None, True), (0.02, 0.01, 0.0, 0.0, 0.1, False)):
        assert not gate(*bad)["passed"]
