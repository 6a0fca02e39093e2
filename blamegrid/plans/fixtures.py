"""The given tables seen as telemetry: an event stream (A) and shipments (B), with cases on each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from ..functions.names import FAULT_TYPES
from ..operators import features, normalize, telemetry

GRID_A = GridSpec(bin_seconds=21600.0)
GRID_B = GridSpec(bin_seconds=1296000.0)
CASES = 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds_since(column: str, start: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{start} 00:00:00', {column}) / 1e6D")


def events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(service, channel, indicator, ts, value): users are services; a few users' indicators fit no service."""
    user, kind = F.col("user_id"), F.col("event_type")
    service = F.concat(F.lit("svc"), (user % 6).cast("string"), F.when(user % 12 >= 6, "_b").otherwise(""))
    channel = F.when(kind == "signup", "log").when(kind == "error", "trace-error").when(kind == "purchase", "trace-latency").otherwise("metric")
    k = F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) AS int)") % 2
    named = F.concat_ws("_", F.when(user % 97 == 0, "unmapped").otherwise(service), kind, F.concat(F.lit("k"), k.cast("string")))
    return table(spark, sf_dir, "events").select(
        service.alias("service"), channel.alias("channel"), named.alias("indicator"), seconds_since("ts", "2024-01-01").alias("ts"), "value"
    )


def _cases(spark: SparkSession, anchor, candidates: list[str]) -> DataFrame:
    j = F.col("id")
    fault = F.get(F.array(*(F.lit(f) for f in FAULT_TYPES)), (j % 6).cast("int"))
    return spark.range(CASES).select(
        F.concat(F.lit("case-"), F.lpad(j.cast("string"), 2, "0")).alias("case_id"),
        anchor(j).cast("double").alias("anchor"),
        fault.alias("fault"),
        (F.floor(j / 6) + 1).cast("int").alias("replicate"),
        F.floor(j / 6).cast("int").alias("fold"),
        F.array(*(F.lit(c) for c in candidates)).alias("candidates"),
    )


def event_cases(spark: SparkSession) -> DataFrame:
    names = sorted([*(f"svc{k}{s}" for k in range(6) for s in ("", "_b")), "svc9_ghost"])
    return _cases(spark, lambda j: 864000 + 43200 * j, names)


def candidate_rows(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.explode("candidates").alias("candidate"))


def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, root, fault, fold): the service with the largest sum after the anchor, ties by name."""
    rows = events_long(spark, sf_dir).filter(~F.col("indicator").startswith("unmapped"))
    sums = telemetry.bin_sums(rows.withColumnRenamed("service", "svc"), ["svc"], GRID_A)
    cases = event_cases(spark)
    first = F.floor(F.col("anchor") / GRID_A.bin_seconds)
    slots = cases.select("case_id", F.explode(F.sequence(first, first + GRID_A.post_bins - 1)).alias("slot"))
    totals = sums.join(slots, "slot").groupBy("case_id", "svc").agg(F.sum("total").alias("total"))
    best = W.partitionBy("case_id").orderBy(F.col("total").desc(), "svc")
    roots = totals.withColumn("nr", F.row_number().over(best)).filter("nr = 1").select("case_id", F.col("svc").alias("root"))
    return roots.join(cases.select("case_id", "fault", "fold", "replicate"), "case_id")


def event_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, service, channel, indicator, bin, x)."""
    sums = telemetry.bin_sums(events_long(spark, sf_dir), ["channel", "indicator"], GRID_A)
    cases = event_cases(spark)
    return _with_services(telemetry.aligned_bins(sums, cases, GRID_A), cases)


def _with_services(binned: DataFrame, cases: DataFrame) -> DataFrame:
    services = telemetry.indicator_services(binned.select("case_id", "channel", "indicator").distinct(), candidate_rows(cases))
    return binned.join(services, ["case_id", "channel", "indicator"]).select("case_id", "service", "channel", "indicator", "bin", "x")


def event_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.service_profile(normalize.robust_scale(event_bins(spark, sf_dir), GRID_A))


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = features.cell_features(event_profile(spark, sf_dir), GRID_A)
    return features.densified(cells, candidate_rows(event_cases(spark)))


MEASURES = {"l_quantity": "metric", "l_discount": "log", "l_tax": "trace-error", "l_extendedprice": "trace-latency"}


def shipments_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, indicator, ts, value): one row per line item and measure."""
    wide = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("sup"), (F.col("l_suppkey") % 8).cast("string"), F.lit("_"), F.col("l_returnflag")).alias("series"),
        seconds_since("l_shipdate", "1995-01-01").alias("ts"),
        *MEASURES,
    )
    long = wide.unpivot(["series", "ts"], list(MEASURES), "measure", "value")
    channel = F.coalesce(*(F.when(F.col("measure") == m, F.lit(c)) for m, c in MEASURES.items()))
    return long.select(channel.alias("channel"), F.concat_ws("_", "series", "measure").alias("indicator"), "ts", "value")


def shipment_cases(spark: SparkSession) -> DataFrame:
    return _cases(spark, lambda j: (43 + 4 * j) * GRID_B.bin_seconds, [f"sup{k}" for k in range(8)])


def shipment_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = telemetry.bin_sums(shipments_long(spark, sf_dir), ["channel", "indicator"], GRID_B)
    cases = shipment_cases(spark)
    return _with_services(telemetry.aligned_bins(sums, cases, GRID_B), cases)


def shipment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = normalize.service_profile(normalize.robust_scale(shipment_bins(spark, sf_dir), GRID_B))
    return features.densified(features.cell_features(profile, GRID_B), candidate_rows(shipment_cases(spark)))
