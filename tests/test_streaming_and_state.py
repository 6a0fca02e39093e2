"""Streaming bins against the batch operator; a saved model against a fresh one."""

import pytest
from pyspark.sql import functions as F

from blamegrid.functions.grid import GridSpec
from blamegrid.operators import condlogit, telemetry
from blamegrid.streaming.live import stream_bin_sums

from .test_learning import toy


def test_stream_equals_batch(spark, tmp_path):
    spec = GridSpec(bin_seconds=60.0)
    rows = spark.range(500).select(
        F.concat(F.lit("i"), (F.col("id") % 3).cast("string")).alias("indicator"), (1_700_000_000 + F.col("id") * 7).cast("double").alias("ts"),
        F.when(F.col("id") % 11 == 0, float("nan")).otherwise(F.col("id").cast("double")).alias("value"),
    )
    source = str(tmp_path / "in")
    rows.withColumn("time", F.timestamp_seconds("ts")).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = stream_bin_sums(stream, ["indicator"], spec).writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.table("live").select("indicator", "slot", "total", "n").collect()))
    assert got == sorted(map(tuple, telemetry.bin_sums(rows, ["indicator"], spec).select("indicator", "slot", "total", "n").collect()))


def test_saved_model_predicts_the_same(spark, tmp_path):
    v, labels = toy(spark)
    fresh, weights, fits = condlogit.fit_out_of_fold(v, labels, labels)
    names = ("metric.magnitude", "metric.mean_impact")
    condlogit.save_model(weights, fits, str(tmp_path / "model"))
    again, stored = condlogit.load_model(spark, str(tmp_path / "model"), names)
    assert stored.filter("converged").count() == 3
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(condlogit.predict(v, labels, again)) == order(fresh)
    with pytest.raises(ValueError, match="names"):
        condlogit.load_model(spark, str(tmp_path / "model"), ("a", "b"))
    with pytest.raises(Exception):
        condlogit.save_model(weights, fits, str(tmp_path / "model"))


def test_replay_fails_on_a_changed_weight(spark, tmp_path):
    v, labels = toy(spark)
    fresh, weights, fits = condlogit.fit_out_of_fold(v, labels, labels)
    path = str(tmp_path / "model")
    condlogit.save_model(weights, fits, path)
    stored, told = condlogit.load_model(spark, path, ("metric.magnitude", "metric.mean_impact"))
    good = condlogit.replay_verdict(v, labels, fresh, stored, told).first()
    assert good["passed"] and good["metrics_agree"]
    changed = stored.withColumn("weight", F.col("weight") + F.when((F.col("fold") == 1) & (F.col("ix") == 0), 1e-9).otherwise(0.0))
    bad = condlogit.replay_verdict(v, labels, fresh, changed, told).first()
    assert not bad["passed"] and not bad["scores_agree"] and bad["same_rankings"]
    turned = stored.withColumn("weight", -F.col("weight"))
    bad = condlogit.replay_verdict(v, labels, fresh, turned, told).first()
    assert not bad["same_rankings"] and not bad["metrics_agree"]


def test_scratch_tables(spark):
    from blamegrid.sources.scratch import discard, materialize

    kept = materialize(spark.range(5), "numbers")
    assert kept.count() == 5
    files = kept.inputFiles()
    discard(kept, spark.range(1))
    discard(kept)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(files[0].rsplit("/", 1)[0])
