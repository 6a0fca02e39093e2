"""Contracts, names and ingest of case directories."""

import json
import math

import pytest

from blamegrid.functions import names
from blamegrid.operators import contracts
from blamegrid.sources import ingest
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cases(spark, *rows):
    return spark.createDataFrame(rows, "case_id string, dataset string, anchor double, candidates array<string>")


def found(df):
    return sorted(map(tuple, df.collect()))


def test_case_contract(spark):
    df = cases(
        spark, ("ok", "d", 1.0, ["a", "b"]), (" x", "d", 1.0, ["a"]), ("n", "d", math.nan, ["a"]), ("m", None, None, ["a"]), ("e", "d", 1.0, []),
        ("r", "d", 1.0, ["a", "a"]), ("b", "d", 1.0, ["a", " b"]), ("t", "d", 1.0, ["a"]), ("t", "d", 2.0, ["a"]),
    )
    assert found(contracts.case_violations(df)) == sorted(
        [(" x", "case_id"), ("n", "anchor"), ("m", "dataset"), ("m", "anchor"), ("e", "no candidates"), ("r", "repeated candidate"), ("b", "candidate"), ("t", "repeated case")]
    )


def test_label_contract(spark):
    df = cases(spark, ("x", "d", 1.0, ["a"]), ("y", "d", 1.0, ["a"]), ("z", "d", 1.0, ["a"]))
    labels = spark.createDataFrame([("x", "a"), ("y", "b"), ("w", "a")], "case_id string, root string")
    assert found(contracts.label_violations(df, labels)) == [("w", "no case"), ("y", "root is no candidate"), ("z", "no label")]


def test_firewall_at_any_depth(spark):
    texts = {"a": {"nested": {"faultType": "cpu"}}, "b": {"x": [{"Root_Service": 1}]}, "c": {"service": "label"}, "d": {"x": {"y": [[{"ROOT-CAUSE": None}]]}}}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in texts.items()], "case_id string, metadata string")
    assert found(contracts.firewall_violations(df)) == [("a", "faulttype"), ("b", "rootservice"), ("d", "rootcause")]
    schema = T.StructType([T.StructField("ok", T.ArrayType(T.StructType([T.StructField("Fault_Label", T.StringType())]))), T.StructField("target", T.StringType())])
    assert contracts.schema_firewall(schema) == ["ok.Fault_Label", "target"]


def test_firewall_reads_keys_as_they_are_meant(spark):
    texts = [
        ("escaped", '{"l\\u0061bel": 1}'), ("deep", "[" * 30 + '{"Fault Type": 1}' + "]" * 30), ("cut", '{"a": 1'), ("twice", '{"a": 1, "a": {"label": 2}}'), ("word", "label"),
        ("value", '{"a": "\\"label\\": 1", "b": ["label"]}'), ("none", None), ("empty", ""), ("scalar", "17"), ("colon", '{"x": "y", "note:": ":"}'),
    ]
    df = spark.createDataFrame(texts, "case_id string, metadata string")
    assert found(contracts.firewall_violations(df)) == [("cut", contracts.MALFORMED), ("deep", "faulttype"), ("empty", contracts.MALFORMED), ("escaped", "label"), ("twice", contracts.MALFORMED), ("word", contracts.MALFORMED)]
    maps = spark.createDataFrame([("m", {"ok": {"Root Cause": "x"}}), ("n", {"Target": {}}), ("o", {"fine": {"fine": "label"}}), ("p", None)], "case_id string, metadata map<string, map<string, string>>")
    assert found(contracts.firewall_violations(maps)) == [("m", "rootcause"), ("n", "target")]
    rows = spark.createDataFrame([("s", ([{"Ground-Truth": 1}], 2))], "case_id string, metadata struct<items: array<map<string, int>>, plain: int>")
    assert found(contracts.firewall_violations(rows)) == [("s", "groundtruth")]
    assert contracts.firewall_violations(df.limit(0)).count() == 0


def test_white_space_of_any_kind(spark):
    for space in " \t\x0b\x1c\x85\xa0\u2003\u2029\u3000":
        rows = cases(spark, (f"a{space}", "d", 1.0, ["b"]), ("c", f"{space}d", 1.0, ["b"]), ("e", f"d{space}d", 1.0, ["b"]))
        assert found(contracts.case_violations(rows)) == sorted([(f"a{space}", "case_id"), ("c", "dataset")]), repr(space)


def test_event_and_model_contracts(spark):
    rows = [("ok", "a", [1.0]), ("ok", "b", [2.0]), ("one", "a", [1.0]), ("two", "a", [1.0]), ("two", "a", [1.0]), ("nan", "a", [math.nan]), ("nan", "b", [1.0]), ("len", "a", [1.0, 2.0]), ("len", "b", [1.0])]
    df = spark.createDataFrame(rows, "case_id string, service string, features array<double>")
    assert found(contracts.event_violations(df)) == [("len", "dimension"), ("nan", "not finite"), ("one", "few candidates"), ("two", "few candidates"), ("two", "repeated candidate")]
    weights = spark.createDataFrame([(f, k, n if f else "?", 1.0, 0.0, 1.0) for f in (0, 1) for k, n in enumerate(("p", "q"))], "fold int, ix int, name string, weight double, mean double, scale double")
    assert found(contracts.model_violations(weights, ("p", "q"))) == [(0, "names")]
    assert found(contracts.model_violations(weights.filter("ix = 0 AND fold = 1"), ("p", "q"))) == [(1, "dimension")]


def test_alignment(spark):
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "case_id string")
    assert found(contracts.alignment_violations(one("a", "b"), one("a", "c"), one("a", "b", "c"))) == [("b", "no label"), ("c", "no features")]
    folds = spark.createDataFrame([("a", 0), ("b", 0)], "case_id string, fold int")
    assert found(contracts.empty_folds(folds)) == [(0, "no training or test cases")]


def test_names(spark):
    df = spark.createDataFrame([("ts-auth-service_cpu",), ("a_b_mem",), ("a_fire",), ("cpu",), ("_cpu",)], "c string")
    got = [tuple(r) for r in df.select(names.head(F.col("c")), names.tail(F.col("c")), names.known_fault(F.col("c"))).collect()]
    assert got == [("ts-auth-service", "cpu", True), ("a_b", "mem", True), ("a", "fire", False), ("", "", False), ("", "cpu", False)]
    ids = df.select(names.opaque_id("p", "one", F.col("c")), names.opaque_id("p", "two", F.col("c"))).first()
    assert ids[0] != ids[1] and len(ids[0]) == len("p-") + 16


@pytest.fixture
def tree(tmp_path):
    def case(condition, replicate, anchor="1700000000", skip=(), header="time,svc_a_cpu,svc_a_mem,b_cpu,istio-init_cpu"):
        at = tmp_path / condition / replicate
        at.mkdir(parents=True)
        for file in ingest.CASE_FILES:
            if file not in skip:
                at.joinpath(file).write_text(f"{anchor}\n" if file == "inject_time.txt" else f"{header}\n0,1,x,,4\n15,2,3,inf,5\n")

    case("svc_a_cpu", "1")
    case("svc_a_mem", "2", skip=("logs.csv", "traces.csv"))
    case("b_disk", "1", anchor="soon")
    case("c_loss", "3")
    case("b_fire", "1")
    case("b_delay", "4")
    return str(tmp_path)


def test_load_cases(spark, tree):
    good, excluded = ingest.load_cases(spark, tree, "d", "space")
    row = good.first()
    assert good.count() == 1 and row["candidates"] == ["b", "svc_a"] and row["root"] == "svc_a" and row["fault"] == "cpu" and row["anchor"] == 1.7e9
    assert found(excluded) == [("b_disk/1", "parse_error:anchor"), ("c_loss/3", "root_not_in_candidates"), ("svc_a_mem/2", "missing:logs.csv,traces.csv")]
    assert [r["service"] for r in ingest.registry(good).collect()] == ["b", "svc_a"]
    assert ingest.manifest(good, excluded).first()["excluded"] == 3


def test_read_telemetry(spark, tree):
    rows = ingest.read_telemetry(spark, tree).filter("relative = 'svc_a_cpu/1' AND channel = 'log'").collect()
    got = {(r["indicator"], r["ts"]): r["value"] for r in rows}
    assert got[("svc_a_cpu", 0.0)] == 1.0 and math.isinf(got[("b_cpu", 15.0)]) and len(got) == 8
    assert all(v is None or math.isnan(v) for v in (got[("svc_a_mem", 0.0)], got[("b_cpu", 0.0)]))


def test_bundle_and_files(spark, tree, tmp_path):
    good, excluded = ingest.load_cases(spark, tree, "d", "space")
    out = str(tmp_path / "bundle")
    ingest.write_bundle(good, excluded, out)
    assert "root" not in spark.read.parquet(f"{out}/inputs").columns and spark.read.parquet(f"{out}/labels").first()["root"] == "svc_a"
    with pytest.raises(Exception):
        ingest.write_bundle(good, excluded, out)
    ingest.write_jsonl(excluded, f"{out}/x")
    assert ingest.read_jsonl(spark, f"{out}/x", "relative string, reason string").count() == 3
    sums = ingest.checksums(spark, f"{tree}/svc_a_cpu")
    assert sums.count() == 8 and all(len(r["sha256"]) == 64 for r in sums.collect())
    vectors = spark.createDataFrame([("c", "a", [1.0])], "case_id string, service string, features array<double>")
    ingest.write_features(vectors, "d", f"{out}/features")
    assert ingest.read_features(spark, f"{out}/features", 1).count() == 1
    with pytest.raises(Exception, match="unexpected number"):
        ingest.read_features(spark, f"{out}/features").collect()


def test_bucketed_dataset_is_loaded_without_a_shuffle(spark, tmp_path):
    path = (tmp_path / "dataset").as_uri()
    cases = [f"c{k}" for k in range(40)]
    tables = {
        "features": spark.createDataFrame([(c, s, [1.0, 2.0]) for c in cases for s in "ab"], "case_id string, service string, features array<double>"),
        "labels": spark.createDataFrame([(c, "a", "cpu") for c in cases], "case_id string, root string, fault string"),
        "splits": spark.createDataFrame([(c, k % 3) for k, c in enumerate(cases)], "case_id string, fold int"),
    }
    ingest.write_bucketed(tables, path, 4)
    with pytest.raises(Exception):
        ingest.write_bucketed(tables, path, 4)
    for again in (False, True):
        if again:  # as another session would find it
            for name in ingest.BUCKETED:
                spark.sql(f"DROP TABLE IF EXISTS {ingest._table_name(path, name)}")
        rows = ingest.load_bucketed(spark, path, 4, 2)
        assert rows.count() == 80 and rows.columns == ["case_id", "service", "features", "root", "fault", "fold"]
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    with pytest.raises(Exception, match="unexpected number"):
        ingest.load_bucketed(spark, path, 4).collect()
