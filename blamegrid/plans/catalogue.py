"""The registered queries and their SQL. Doubles are rounded on both sides, after everything is decided."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.grid import BASE, FEATURE_DIGEST, FEATURE_NAMES, MORPHOLOGY
from ..operators import condlogit, contracts, features, normalize, ranking, relative, report, splits, stats, telemetry
from ..sources import ingest
from ..sources.scratch import materialize, scratch_path
from . import fixtures as fx
from . import incident_sql as sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
A = sql.chain("a")


def query(oracle: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def tidy(x: Column | str, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*(tidy(f"`{c}`", digits).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns))


# --- telemetry to features ---------------------------------------------------------------------------------


@query(
    f"""WITH {sql.CASES_A.strip()},{sql.TELEMETRY_A}
    SELECT c.case_id, t.channel, CAST(floor((t.ts - (c.anchor - 864000)) / 21600.0::DOUBLE) AS INT) AS bin, count(*) AS n, round(min(t.ts), 3) + 0.0 AS first_ts
    FROM telemetry t JOIN cases c ON t.ts >= c.anchor - 864000 AND t.ts < c.anchor + 864000 GROUP BY ALL"""
)
def case_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry.case_windows(fx.events_long(spark, sf_dir), fx.event_cases(spark), fx.GRID_A)
    return rows.groupBy("case_id", "channel", "bin").agg(F.count(F.lit(1)).alias("n"), tidy(F.min("ts"), 3).alias("first_ts"))


@query(
    f"WITH {sql.TELEMETRY_B.strip()} SELECT indicator, channel, count(*) AS n, round(sum(value), 2) + 0.0 AS total, round(min(ts), 0) + 0.0 AS first_ts FROM telemetry GROUP BY ALL"
)
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = fx.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("sup"), (F.col("l_suppkey") % 8).cast("string"), F.lit("_"), F.col("l_returnflag")).alias("series"),
        fx.seconds_since("l_shipdate", "1995-01-01").alias("ts"),
        *fx.MEASURES,
    )
    long = telemetry.wide_to_long(wide, ["series"], "ts")
    channel = F.coalesce(*(F.when(F.col("indicator") == m, F.lit(c)) for m, c in fx.MEASURES.items()))
    named = long.select(F.concat_ws("_", "series", "indicator").alias("indicator"), channel.alias("channel"), "ts", "value")
    return named.groupBy("indicator", "channel").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("value"), 2).alias("total"), tidy(F.min("ts"), 0).alias("first_ts"))


@query(A + " SELECT * FROM mapped")
def indicator_service_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = fx.event_cases(spark)
    rows = fx.events_long(spark, sf_dir).select("channel", "indicator").distinct()
    spread = rows.withColumn("case_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(fx.CASES - 1)), lambda j: F.concat(F.lit("case-"), F.lpad(j.cast("string"), 2, "0")))))
    return telemetry.indicator_services(spread, fx.candidate_rows(cases)).select("case_id", "channel", "indicator", "service")


@query(A + f" SELECT case_id, service, channel, indicator, bin, {sql.rounded('x')} FROM binned")
def binned_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fx.event_bins(spark, sf_dir), "x")


@query(sql.chain("b") + f" SELECT case_id, service, channel, indicator, bin, {sql.rounded('x')} FROM binned")
def shipment_binned_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fx.shipment_bins(spark, sf_dir), "x")


@query(A + f" SELECT DISTINCT case_id, service, channel, indicator, {sql.rounded('center', 'scale', digits=9)} FROM scaled")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = normalize.robust_scale(fx.event_bins(spark, sf_dir), fx.GRID_A)
    return rounded(scaled.groupBy(*normalize.SERIES).agg(F.first("center").alias("center"), F.first("scale").alias("scale")), "center", "scale", digits=9)


@query(A + f" SELECT case_id, service, channel, bin, {sql.rounded('q')} FROM profile")
def service_q90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fx.event_profile(spark, sf_dir), "q")


@query(
    """WITH rows AS (
      SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'hub' ELSE 'sup' || (l_suppkey % 8) END AS service, CAST(floor(epoch(l_shipdate - TIMESTAMP '1995-01-01') / 7776000) AS BIGINT) AS bin, round(l_quantity * (1 + l_discount), 4) AS load FROM lineitem)
    SELECT service, bin, round(quantile_cont(load, 0.9), 6) + 0.0 AS q FROM rows GROUP BY ALL"""
)
def hot_service_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantile of a load by service and quarter, where one service holds a third of all rows."""
    hub = F.when(F.col("l_orderkey") % 3 == 0, "hub").otherwise(F.concat(F.lit("sup"), (F.col("l_suppkey") % 8).cast("string")))
    quarter = F.floor(fx.seconds_since("l_shipdate", "1995-01-01") / 7_776_000.0).cast("long")
    rows = fx.table(spark, sf_dir, "lineitem").select(hub.alias("service"), quarter.alias("bin"), F.round(F.col("l_quantity") * (1 + F.col("l_discount")), 4).alias("load"))
    return rounded(normalize.quantiles(rows, ["service", "bin"], "load", 0.9, "q"), "q")


@query(A + f" SELECT case_id, service, channel, {sql.rounded(*BASE)} FROM dense")
def base_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fx.event_features(spark, sf_dir).select("case_id", "service", "channel", *BASE), *BASE)


@query(A + f" SELECT case_id, service, channel, {sql.rounded(*MORPHOLOGY)} FROM dense")
def morphology_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fx.event_features(spark, sf_dir).select("case_id", "service", "channel", *MORPHOLOGY), *MORPHOLOGY)


@query(A + f" SELECT case_id, service, {sql.rounded('a')} FROM magnitudes")
def anomaly_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.magnitudes(fx.event_features(spark, sf_dir)), "a")


_RANKED = ", ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY round(a, 9) DESC, service) AS INT) AS rank FROM magnitudes)"


def _magnitude_ranking(spark: SparkSession, dense: DataFrame) -> DataFrame:
    scores = features.magnitudes(dense).withColumn("score", F.round("a", 9))  # equal in either engine
    return ranking.ranked(scores).select("case_id", "service", "a", "rank")


@query(A + _RANKED + f" SELECT case_id, service, {sql.rounded('a')}, rank FROM ranked")
def magnitude_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_magnitude_ranking(spark, fx.event_features(spark, sf_dir)), "a")


@query(sql.chain("b") + _RANKED + f" SELECT case_id, service, {sql.rounded('a')}, rank FROM ranked")
def shipment_magnitude_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_magnitude_ranking(spark, fx.shipment_features(spark, sf_dir)), "a")


def _trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = materialize(fx.event_profile(spark, sf_dir), "profile")  # read twice
    dense = features.densified(features.cell_features(profile, fx.GRID_A), fx.candidate_rows(fx.event_cases(spark)))
    return features.trajectories(profile, dense, fx.GRID_A)


_Z = """, grid AS (
  SELECT d.case_id, d.service, d.channel, d.channel_ix, b.bin, CASE WHEN d.morphology_active > 0 THEN coalesce(p.z, 0) ELSE 0 END AS z,
         CASE WHEN p.q IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS mask
  FROM dense d CROSS JOIN (SELECT CAST(k AS INT) AS bin FROM range(80) r(k)) b
  LEFT JOIN shaped p ON p.case_id = d.case_id AND p.service = d.service AND p.channel = d.channel AND p.bin = b.bin)"""


@query(A + _Z + f" SELECT case_id, service, channel, bin, {sql.rounded('z')}, mask FROM grid")
def z_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _trajectories(spark, sf_dir).select("case_id", "service", "channel", F.posexplode(F.arrays_zip("z", "mask")).alias("bin", "both"))
    return rounded(rows.select("case_id", "service", "channel", "bin", "both.z", "both.mask"), "z")


@query(
    A + _Z + f""", parts AS (
    SELECT case_id, service, channel_ix * 169 + k AS ix, [{', '.join(BASE)}][k + 1] AS value FROM dense, range(8) r(k)
    UNION ALL SELECT case_id, service, channel_ix * 169 + 8 + bin, z FROM grid
    UNION ALL SELECT case_id, service, channel_ix * 169 + 88 + bin, mask FROM grid
    UNION ALL SELECT case_id, service, channel_ix * 169 + 168, morphology_active FROM dense)
    SELECT case_id, service, CAST(ix AS INT) AS ix, {sql.rounded('value')} FROM parts"""
)
def z3_vector_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = features.feature_vectors(_trajectories(spark, sf_dir), "z3")
    return rounded(features.long_view(vectors).drop("name"), "value")


@query(A + f" SELECT case_id, service, CAST(ix AS INT) AS ix, {sql.NAMES}[ix + 1] AS name, {sql.rounded('value')} FROM long")
def z2_vector_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.long_view(features.feature_vectors(fx.event_features(spark, sf_dir))), "value")


@query(
    A + f""" SELECT case_id, service, 'z0' AS variant, 0 AS ix, {sql.rounded('a').replace('AS a', 'AS value')} FROM magnitudes
    UNION ALL SELECT case_id, service, 'z1', CAST(channel_ix * 8 + k AS INT), round([{', '.join(BASE)}][k + 1], 6) + 0.0 FROM dense, range(8) t(k)"""
)
def small_vectors_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two small variants, of 1 and 32 numbers."""
    dense = materialize(fx.event_features(spark, sf_dir), "dense")  # read twice
    sides = [features.long_view(features.feature_vectors(dense, v)).select("case_id", "service", F.lit(v).alias("variant"), "ix", "value") for v in ("z0", "z1")]
    return rounded(sides[0].unionByName(sides[1]), "value")


@query(
    A + _Z + f""", moved AS (
    SELECT case_id, CAST(k AS INT) AS old, CAST(row_number() OVER (PARTITION BY case_id ORDER BY sha256('shuffle:' || case_id || ':' || k)) - 1 AS INT) AS bin FROM cases, range(80) r(k))
    SELECT g.case_id, g.service, g.channel, m.bin, {sql.rounded('z')}, g.mask FROM grid g JOIN moved m ON m.case_id = g.case_id AND m.old = g.bin"""
)
def temporal_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = features.temporal_shuffle(_trajectories(spark, sf_dir), fx.GRID_A)
    rows = moved.select("case_id", "service", "channel", F.posexplode(F.arrays_zip("z", "mask")).alias("bin", "both"))
    return rounded(rows.select("case_id", "service", "channel", "bin", "both.z", "both.mask"), "z")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The z2 vectors, rounded as the SQL rounds them, so that ties are the same."""
    vectors = features.feature_vectors(fx.event_features(spark, sf_dir))
    return vectors.withColumn("features", F.transform("features", lambda x: tidy(x)))


_LONG = ", flat AS (SELECT case_id, service, CAST(ix AS INT) AS ix, round(value, 6) + 0.0 AS value FROM long)"


@query(
    A + _LONG + f""" SELECT case_id, service, ix, value, {sql.rounded('pct')} FROM (
    SELECT *, (rank() OVER (PARTITION BY case_id, ix ORDER BY value) + (count(*) OVER (PARTITION BY case_id, ix, value) - 1) / 2.0::DOUBLE - 1)
              / (count(*) OVER (PARTITION BY case_id, ix) - 1) AS pct FROM flat)"""
)
def within_event_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = materialize(features.long_view(_vectors(spark, sf_dir)).drop("name"), "long")  # read twice
    return rounded(relative.within_event_percentiles(long), "pct")


@query(
    A + _LONG + f""", placed AS (
    SELECT *, (rank() OVER (PARTITION BY case_id, ix ORDER BY value) + (count(*) OVER (PARTITION BY case_id, ix, value) - 1) / 2.0::DOUBLE - 1)
              / (count(*) OVER (PARTITION BY case_id, ix) - 1) AS pct FROM flat)
    SELECT case_id, service, ix, {sql.rounded('value')} FROM placed UNION ALL SELECT case_id, service, ix + 68, round(pct, 6) + 0.0 FROM placed"""
)
def relative_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors followed by their percentiles inside the event, number by number."""
    return rounded(features.long_view(relative.representation(materialize(_vectors(spark, sf_dir), "vectors"), True)).drop("name"), "value")


@query(
    A + _LONG + f""" SELECT v.case_id, m.context_id, v.service, v.ix, v.value,
    round((sum(CASE WHEN c.value < v.value THEN 1 ELSE 0 END) + 0.5 * sum(CASE WHEN c.value = v.value THEN 1 ELSE 0 END)) / count(*)::DOUBLE, 6) + 0.0 AS pct
    FROM flat v JOIN (SELECT a.case_id, b.case_id AS context_id FROM cases a JOIN cases b ON b.anchor = a.anchor + 43200) m ON m.case_id = v.case_id
    JOIN flat c ON c.case_id = m.context_id AND c.ix = v.ix GROUP BY ALL"""
)
def foreign_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = materialize(features.long_view(_vectors(spark, sf_dir)).drop("name"), "long")  # read as values and as context
    cases = fx.event_cases(spark)
    match = cases.select("case_id", "anchor").join(cases.select(F.col("case_id").alias("context_id"), (F.col("anchor") - 43200).alias("anchor")), "anchor").drop("anchor")
    return rounded(relative.foreign_percentiles(long, long, match), "pct")


@query(
    A + f""", reports AS (
    SELECT d.case_id, min(m.a) AS a_min, max(m.a) AS a_max, avg(d.coverage) AS coverage, avg(d.channel_available) AS available, avg(d.morphology_active) AS active,
           count(DISTINCT d.service) AS candidates, bool_and(isfinite(m.a)) AS finite
    FROM dense d JOIN magnitudes m ON m.case_id = d.case_id AND m.service = d.service GROUP BY d.case_id)
    SELECT case_id, {sql.rounded('a_min', 'a_max', 'coverage', 'available', 'active')}, candidates, finite FROM reports"""
)
def extraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.case_report(fx.event_features(spark, sf_dir)), "a_min", "a_max", "coverage", "available", "active")


@query(
    A + f""", reports AS (
    SELECT d.case_id, min(m.a) AS a_min, max(m.a) AS a_max, avg(d.coverage) AS coverage, avg(d.channel_available) AS available, avg(d.morphology_active) AS active, count(DISTINCT d.service) AS candidates, bool_and(isfinite(m.a)) AS finite
    FROM dense d JOIN magnitudes m ON m.case_id = d.case_id AND m.service = d.service GROUP BY d.case_id)
    SELECT count(*) AS cases, round(min(a_min), 6) + 0.0 AS a_min, round(max(a_max), 6) + 0.0 AS a_max, round(avg(coverage), 6) + 0.0 AS coverage, round(avg(available), 6) + 0.0 AS available,
    round(avg(active), 6) + 0.0 AS active, bool_and(finite) AS finite, (SELECT string_agg(candidates || ':' || n, ',' ORDER BY candidates) FROM (SELECT candidates, count(*) AS n FROM reports GROUP BY candidates)) AS histogram FROM reports"""
)
def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = report.dataset_report(report.case_report(fx.event_features(spark, sf_dir)))
    text = F.array_join(F.transform("histogram", lambda h: F.concat_ws(":", h["candidates"], h["cases"])), ",")
    return rounded(summary.withColumn("histogram", text), "a_min", "a_max", "coverage", "available", "active")


# --- cases, names and contracts ----------------------------------------------------------------------------

_CONDITION = """conditions AS (
  SELECT service || '_' || ['cpu', 'mem', 'disk', 'socket', 'delay', 'loss', 'fire'][user_id % 7 + 1] AS condition, user_id % 4 + 1 AS replicate, event_id, user_id, service, event_type
  FROM (SELECT *, 'svc' || (user_id % 6) || CASE WHEN user_id % 12 >= 6 THEN '_b' ELSE '' END AS service FROM events))"""


def _conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    service = F.concat(F.lit("svc"), (user % 6).cast("string"), F.when(user % 12 >= 6, "_b").otherwise(""))
    fault = F.get(F.array(*(F.lit(f) for f in (*names.FAULT_TYPES, "fire"))), (user % 7).cast("int"))
    return fx.table(spark, sf_dir, "events").select(
        F.concat_ws("_", service, fault).alias("condition"), (user % 4 + 1).alias("replicate"), "event_id", "user_id", service.alias("service"), "event_type"
    )


@query(
    f"""WITH {_CONDITION} SELECT condition, regexp_extract(condition, '^(.*)_([^_]*)$', 1) AS root, regexp_extract(condition, '^(.*)_([^_]*)$', 2) AS fault,
    regexp_extract(condition, '^(.*)_([^_]*)$', 2) <> 'fire' AS known, count(*) AS n FROM conditions GROUP BY condition"""
)
def condition_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conditions(spark, sf_dir).groupBy("condition").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("condition")
    return rows.select("condition", names.head(c).alias("root"), names.tail(c).alias("fault"), names.known_fault(c).alias("known"), "n")


@query(
    f"WITH {_CONDITION} SELECT DISTINCT condition || '/' || replicate AS relative, 'ev-' || substr(sha256('events:' || condition || '/' || replicate), 1, 16) AS case_id FROM conditions"
)
def opaque_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conditions(spark, sf_dir).select(F.concat_ws("/", "condition", "replicate").alias("relative")).distinct()
    return rows.select("relative", names.opaque_id("ev", "events", F.col("relative")).alias("case_id"))


@query(
    f"""WITH {_CONDITION}, indicators AS (
      SELECT DISTINCT 'd' || (user_id % 5) AS case_id,
        CASE WHEN user_id % 50 = 0 THEN 'istio-init' ELSE service END || CASE event_type WHEN 'click' THEN '_cpu' WHEN 'view' THEN '_mem' ELSE '_latency-50' END AS indicator FROM conditions),
    named AS (SELECT DISTINCT case_id, regexp_extract(indicator, '^(.*)_([^_]*)$', 1) AS candidate FROM indicators WHERE regexp_matches(indicator, '_(cpu|mem)$'))
    SELECT case_id, string_agg(candidate, ',' ORDER BY candidate) AS candidates FROM named
    WHERE candidate NOT IN ('frontend-check', 'frontend-external', 'istio-init', 'loadgenerator') GROUP BY case_id"""
)
def candidate_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity = F.when(F.col("user_id") % 50 == 0, "istio-init").otherwise(F.col("service"))
    suffix = F.when(F.col("event_type") == "click", "_cpu").when(F.col("event_type") == "view", "_mem").otherwise("_latency-50")
    rows = _conditions(spark, sf_dir).select(F.concat(F.lit("d"), (F.col("user_id") % 5).cast("string")).alias("case_id"), F.concat(entity, suffix).alias("indicator")).distinct()
    return ingest.candidate_arrays(ingest.derive_candidates(rows)).select("case_id", F.array_join("candidates", ",").alias("candidates"))


_FILES = "[" + ", ".join(f"'{f}'" for f in sorted(ingest.CASE_FILES)) + "]"


@query(
    f"""WITH {_CONDITION}, found AS (
      SELECT condition, replicate, list(DISTINCT {_FILES}[CAST(event_id % 8 AS INT) + 1]) AS files, min(CASE WHEN user_id % 12 <> 5 THEN event_id END) AS anchor,
             list(DISTINCT CASE WHEN replicate = 2 THEN 'svc0' ELSE service END) AS candidates
      FROM conditions WHERE NOT condition LIKE '%fire' GROUP BY condition, replicate),
    lacking AS (SELECT *, [f for f in {_FILES} if NOT list_contains(files, f)] AS missing, regexp_extract(condition, '^(.*)_([^_]*)$', 1) AS root FROM found)
    SELECT condition, replicate, CASE WHEN len(missing) > 0 THEN 'missing:' || array_to_string(missing, ',') WHEN anchor IS NULL THEN 'parse_error:anchor'
      WHEN NOT list_contains(candidates, root) THEN 'root_not_in_candidates' END AS reason FROM lacking"""
)
def case_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.get(F.array(*(F.lit(f) for f in sorted(ingest.CASE_FILES))), (F.col("event_id") % 8).cast("int"))
    rows = _conditions(spark, sf_dir).filter(names.known_fault(F.col("condition")))
    found = rows.groupBy("condition", "replicate").agg(
        F.collect_set(file).alias("files"),
        F.min(F.when(F.col("user_id") % 12 != 5, F.col("event_id"))).alias("anchor"),
        F.collect_set(F.when(F.col("replicate") == 2, "svc0").otherwise(F.col("service"))).alias("candidates"),
    )
    return ingest.with_reasons(found).select("condition", "replicate", "reason")


_FORBIDDEN = "(" + ", ".join(f"'{k}'" for k in names.FORBIDDEN_KEYS) + ")"


@query(
    f"""WITH {_CONDITION}, told AS (
      SELECT DISTINCT 'e' || (user_id % 30) AS case_id, CASE user_id % 30 WHEN 3 THEN '{{"nested": {{"faultType": "' || service || '", "x": [{{"LABEL": 1}}]}}}}' WHEN 7 THEN '{{"a": [1, {{"Root-Cause" : null}}]}}'
        WHEN 8 THEN '{{"target": "label"}}' WHEN 11 THEN '{{"' || event_type || '": {{"l\\u0061bel": [], "root\\u005Fcause": {{}}}}}}' WHEN 12 THEN '{{"note": "' || service || '"' WHEN 14 THEN '{{"say \\"label\\": ": "{{\\"label\\": 1}}"}}'
        WHEN 17 THEN '[[[{{"deep": [[{{"ground truth": "' || event_type || '"}}]]}}]]]' ELSE '{{"service": "' || service || '", "note": "label"}}' END AS metadata FROM conditions),
    walked AS (SELECT t.case_id, regexp_replace(lower(j.key), '[^a-z0-9]', '', 'g') AS key FROM (SELECT * FROM told WHERE json_valid(metadata)) t, json_tree(t.metadata) j WHERE j.key IS NOT NULL)
    SELECT DISTINCT case_id, key FROM walked WHERE key IN {_FORBIDDEN} UNION SELECT case_id, 'malformed json' FROM told WHERE NOT json_valid(metadata)"""
)
def label_firewall_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata that tells a label in nested, escaped or oddly written keys, or can't be read; and some that only looks like it."""
    kind = (F.col("user_id") % 30).cast("int")
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    service, event = F.col("service"), F.col("event_type")
    metadata = (
        F.when(kind == 3, text('{"nested": {"faultType": "', service, '", "x": [{"LABEL": 1}]}}'))
        .when(kind == 7, '{"a": [1, {"Root-Cause" : null}]}')
        .when(kind == 8, '{"target": "label"}')
        .when(kind == 11, text('{"', event, '": {"l\\u0061bel": [], "root\\u005Fcause": {}}}'))
        .when(kind == 12, text('{"note": "', service, '"'))
        .when(kind == 14, r'{"say \"label\": ": "{\"label\": 1}"}')
        .when(kind == 17, text('[[[{"deep": [[{"ground truth": "', event, '"}]]}]]]'))
        .otherwise(text('{"service": "', service, '", "note": "label"}'))
    )
    rows = _conditions(spark, sf_dir).select(F.concat(F.lit("e"), kind.cast("string")).alias("case_id"), metadata.alias("metadata")).distinct()
    return contracts.firewall_violations(rows)


@query(
    f"""WITH {_CONDITION}, grouped AS (
      SELECT user_id % 40 AS g, count(*) AS n, list(DISTINCT event_type ORDER BY event_type) AS kinds FROM conditions GROUP BY user_id % 40),
    rules AS (
      SELECT CASE WHEN g = 1 THEN ' u1' WHEN g = 2 THEN 'u3' ELSE 'u' || g END AS case_id, unnest(list_concat(
        CASE WHEN g = 1 THEN ['case_id'] ELSE [] END, CASE WHEN g IN (4, 14) THEN ['dataset'] ELSE [] END, CASE WHEN g = 5 THEN ['anchor'] ELSE [] END,
        CASE WHEN g = 6 THEN ['no candidates'] ELSE [] END, CASE WHEN g = 7 THEN ['repeated candidate'] ELSE [] END, CASE WHEN g = 9 THEN ['candidate'] ELSE [] END,
        CASE WHEN g = 3 THEN ['repeated case'] ELSE [] END, CASE WHEN g = 11 THEN ['root is no candidate'] ELSE [] END, CASE WHEN g = 12 THEN ['no label'] ELSE [] END,
        CASE WHEN g = 6 THEN ['root is no candidate'] ELSE [] END)) AS rule FROM grouped)
    SELECT case_id, rule FROM rules UNION ALL SELECT 'x13', 'no case' FROM grouped WHERE g = 13 UNION ALL SELECT 'u13', 'no label' FROM grouped WHERE g = 13"""
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases made of the events' users, a few of them spoilt, against all contracts of cases and labels."""
    g = F.col("g")
    rows = _conditions(spark, sf_dir).groupBy((F.col("user_id") % 40).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("event_type")).alias("kinds"))
    case_id = F.when(g == 1, " u1").when(g == 2, "u3").otherwise(F.concat(F.lit("u"), g.cast("string")))
    candidates = (
        F.when(g == 6, F.array().cast("array<string>")).when(g == 7, F.concat("kinds", "kinds")).when(g == 9, F.concat("kinds", F.array(F.lit(""))))
        .otherwise(F.col("kinds"))
    )
    anchor = F.when(g == 5, F.lit(float("nan"))).otherwise(F.col("n").cast("double"))
    cases = rows.select(case_id.alias("case_id"), F.when(g == 4, "").when(g == 14, "events\u00a0").otherwise("events").alias("dataset"), anchor.alias("anchor"), candidates.alias("candidates"))
    root = F.when(g == 11, "nobody").otherwise(F.element_at("kinds", 1))
    labels = rows.filter((g != 12) & (g != 2)).select(F.when(g == 13, "x13").otherwise(case_id).alias("case_id"), root.alias("root"))
    return contracts.case_violations(cases).unionByName(contracts.label_violations(cases, labels).distinct())


# --- folds, rankings, metrics ------------------------------------------------------------------------------


@query(A + sql.LABELS + " SELECT case_id, root, fault, replicate, fold FROM labels")
def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_folds(fx.event_labels(spark, sf_dir).drop("fold")).select("case_id", "root", "fault", "replicate", "fold")


@query(
    A + sql.LABELS + " SELECT f.fold, l.case_id, CASE WHEN f.fold = l.fold THEN 'test' ELSE 'train' END AS role FROM labels l, (SELECT DISTINCT fold FROM labels) f"
)
def fold_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.fold_membership(fx.event_labels(spark, sf_dir))


@query(A + sql.LABELS + " SELECT fold, root, fault, count(*) AS n FROM labels GROUP BY ALL")
def fold_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.strata(fx.event_labels(spark, sf_dir))


@query(
    A + sql.LABELS + """, lists AS (SELECT case_id, count(*) AS candidates FROM candidates GROUP BY case_id), sizes AS (SELECT case_id, count(DISTINCT ix) AS dim, count(*) AS cells FROM long GROUP BY case_id)
    SELECT l.case_id, l.root, l.fault, l.fold, s.candidates, z.dim, z.cells FROM labels l JOIN lists s USING (case_id) JOIN sizes z USING (case_id)"""
)
def bundle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, labels and folds side by side; the join loses no case (else the contract's rows would show)."""
    vectors = features.feature_vectors(fx.event_features(spark, sf_dir))
    sizes = vectors.groupBy("case_id").agg(F.count(F.lit(1)).alias("candidates"), F.max(F.size("features")).cast("long").alias("dim"), F.sum(F.size("features")).alias("cells"))
    labels = fx.event_labels(spark, sf_dir)
    return labels.join(sizes, "case_id").select("case_id", "root", "fault", "fold", "candidates", "dim", "cells")


_METRICS = """, metrics AS (
  SELECT l.case_id, l.root, l.fault, l.fold, r.rank, CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END AS "AC@1", CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END AS "AC@3",
         CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END AS "AC@5", greatest(0, 6 - rank) / 5.0::DOUBLE AS "Avg@5", 1.0::DOUBLE / rank AS "MRR"
  FROM labels l JOIN ranked r ON r.case_id = l.case_id AND r.service = l.root)"""
_MEANS = ", ".join(f'round(avg("{m}"), 6) + 0.0 AS "{m}"' for m in ranking.METRICS)


def _case_metrics(spark: SparkSession, sf_dir: str, order: DataFrame | None = None) -> DataFrame:
    labels = fx.event_labels(spark, sf_dir).select("case_id", "root", "fault", "fold")
    if order is not None:
        return ranking.case_metrics(order, labels)
    scores = features.magnitudes(fx.event_features(spark, sf_dir)).withColumn("score", F.round("a", 9))
    return ranking.root_metrics(materialize(scores.select("case_id", "service", "score"), "scores"), labels)  # read twice


@query(A + _RANKED + sql.LABELS + _METRICS + ' SELECT case_id, root, fault, fold, rank, "AC@1", "AC@3", "AC@5", round("Avg@5", 6) + 0.0 AS "Avg@5", round("MRR", 6) + 0.0 AS "MRR" FROM metrics')
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_case_metrics(spark, sf_dir), "Avg@5", "MRR")


@query(
    A + _RANKED + sql.LABELS + _METRICS + f""" SELECT 'overall' AS "grouping", 'all' AS value, count(*) AS n, {_MEANS} FROM metrics
    UNION ALL SELECT 'fault', fault, count(*), {_MEANS} FROM metrics GROUP BY fault UNION ALL SELECT 'root', root, count(*), {_MEANS} FROM metrics GROUP BY root
    UNION ALL SELECT 'fold', CAST(fold AS VARCHAR), count(*), {_MEANS} FROM metrics GROUP BY fold"""
)
def metric_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.metric_groups(_case_metrics(spark, sf_dir)), *ranking.METRICS)


_BY_SUM = f""", by_sum AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, service) AS INT) AS rank
  FROM (SELECT case_id, service, round(sum(mean_impact), 9) AS score FROM dense GROUP BY ALL))"""


def _impact_ranking(dense: DataFrame) -> DataFrame:
    return ranking.ranked(dense.groupBy("case_id", "service").agg(F.round(F.sum("mean_impact"), 9).alias("score")))


@query(
    A + _BY_SUM + """, spoilt AS (SELECT case_id, CASE WHEN service = 'svc1' AND case_id = 'case-03' THEN 'svc2' ELSE service END AS service, rank FROM by_sum WHERE NOT (case_id = 'case-05' AND service = 'svc4')),
    seen AS (SELECT case_id, service, count(*) AS times FROM spoilt GROUP BY ALL)
    SELECT c.case_id, c.candidate AS service, CASE WHEN s.times IS NULL THEN 'missing' ELSE 'repeated' END AS gap FROM candidates c LEFT JOIN seen s ON s.case_id = c.case_id AND s.service = c.candidate
    WHERE s.times IS NULL OR s.times > 1"""
)
def prediction_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking with one candidate left out and one replaced by another: what the contract finds."""
    order = _impact_ranking(fx.event_features(spark, sf_dir))
    swap = (F.col("service") == "svc1") & (F.col("case_id") == "case-03")
    spoilt = order.filter(~((F.col("case_id") == "case-05") & (F.col("service") == "svc4"))).withColumn("service", F.when(swap, "svc2").otherwise(F.col("service")))
    return ranking.prediction_gaps(fx.candidate_rows(fx.event_cases(spark)), spoilt)


@query(
    A + _RANKED + _BY_SUM + """ SELECT count(*) AS n, count(*) FILTER (r.rank IS NULL OR s.rank IS NULL) AS one_sided, round(max(abs(round(r.a, 9) - s.score)), 6) + 0.0 AS max_score_diff,
    bool_and(r.rank IS NOT DISTINCT FROM s.rank) AS same_ranks
    FROM (SELECT * FROM ranked WHERE NOT (case_id = 'case-04' AND service = 'svc2')) r FULL JOIN (SELECT * FROM by_sum WHERE NOT (case_id = 'case-06' AND service = 'svc3')) s ON r.case_id = s.case_id AND r.service = s.service"""
)
def prediction_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings that lack a row each."""
    dense = materialize(fx.event_features(spark, sf_dir), "dense")  # read twice
    left = _magnitude_ranking(spark, dense).select("case_id", "service", F.round("a", 9).alias("score"), "rank")
    lacking = lambda rows, case, service: rows.filter(~((F.col("case_id") == case) & (F.col("service") == service)))
    return rounded(ranking.prediction_diff(lacking(left, "case-04", "svc2"), lacking(_impact_ranking(dense), "case-06", "svc3")), "max_score_diff")


@query(
    A + _BY_SUM + """ SELECT case_id, service, round(exp(score - max(score) OVER w) / sum(exp(score - top)) OVER w, 6) + 0.0 AS p
    FROM (SELECT *, max(score) OVER (PARTITION BY case_id) AS top FROM by_sum) WINDOW w AS (PARTITION BY case_id)"""
)
def event_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.event_softmax(_impact_ranking(fx.event_features(spark, sf_dir))).select("case_id", "service", "p"), "p")


# --- learning and statistics -------------------------------------------------------------------------------


@query(
    A + sql.LABELS + _LONG + """ SELECT fold, ix, n, round(mean, 6) + 0.0 AS mean, round(CASE WHEN sd <= 1e-12 * greatest(abs(mean), 1) THEN 1 ELSE sd END, 6) + 0.0 AS scale FROM (
    SELECT f.fold, v.ix, count(*) AS n, avg(v.value) AS mean, stddev_pop(v.value) AS sd
    FROM flat v JOIN labels l ON l.case_id = v.case_id JOIN (SELECT DISTINCT fold FROM labels) f ON f.fold <> l.fold GROUP BY f.fold, v.ix)"""
)
def scaler_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(condlogit.scaler_stats(_vectors(spark, sf_dir), fx.event_labels(spark, sf_dir)), "mean", "scale")


@query(
    A + sql.LABELS + _LONG + """, sizes AS (SELECT case_id, count(DISTINCT service) AS n FROM flat GROUP BY case_id)
    SELECT v.ix, round(sum(v.value / s.n - CASE WHEN v.service = l.root THEN v.value ELSE 0 END), 6) + 0.0 AS gradient, (SELECT round(sum(ln(n)), 6) FROM sizes) AS loss
    FROM flat v JOIN labels l ON l.case_id = v.case_id JOIN sizes s ON s.case_id = v.case_id GROUP BY v.ix"""
)
def loss_gradient_at_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit's own sums at zero weights over all cases, where the closed form is known: all candidates are equally likely."""
    events = condlogit.event_table(materialize(_vectors(spark, sf_dir), "vectors"), *[fx.event_labels(spark, sf_dir)] * 2)
    flat = {-1: np.zeros(len(FEATURE_NAMES))}  # a fold that no case is of
    loss, gradient, _ = condlogit.evaluate(events, flat, {-1: np.ones(len(FEATURE_NAMES))}, 1.0)[-1]
    found = spark.createDataFrame([(k, float(g), loss) for k, g in enumerate(gradient)], "ix int, gradient double, loss double")
    return rounded(found, "gradient", "loss")


_SCALED = A + sql.LABELS + _LONG + """, stats AS (
  SELECT fold, ix, mean, CASE WHEN sd <= 1e-12 * greatest(abs(mean), 1) THEN 1 ELSE sd END AS scale FROM (
    SELECT f.fold, v.ix, avg(v.value) AS mean, stddev_pop(v.value) AS sd
    FROM flat v JOIN labels l ON l.case_id = v.case_id JOIN (SELECT DISTINCT fold FROM labels) f ON f.fold <> l.fold GROUP BY f.fold, v.ix)),
standard AS (
  SELECT s.fold, l.fold AS own, v.case_id, v.service, v.service = l.root AS is_root, v.ix, (v.value - s.mean) / s.scale AS z, ((v.ix * 7) % 11 - 5) / 50.0::DOUBLE AS weight
  FROM flat v JOIN labels l ON l.case_id = v.case_id JOIN stats s ON s.ix = v.ix),
scores AS (SELECT fold, own, case_id, service, is_root, sum(z * weight) AS score FROM standard GROUP BY ALL)"""
_SHARES = _SCALED + """, shares AS (
  SELECT *, exp(score - top) / sum(exp(score - top)) OVER w AS p, top + ln(sum(exp(score - top)) OVER w) AS mass
  FROM (SELECT *, max(score) OVER (PARTITION BY fold, case_id) AS top FROM scores WHERE fold <> own) WINDOW w AS (PARTITION BY fold, case_id)),
norm AS (SELECT sum(weight * weight) / 2 AS half FROM (SELECT DISTINCT ix, weight FROM standard))"""


def _given_weights(count: int) -> np.ndarray:
    return np.array([((k * 7) % 11 - 5) / 50.0 for k in range(count)])


def _sums_at_given_weights(spark: SparkSession, sf_dir: str):
    """The fit's sums by fold at weights that the SQL knows."""
    return _sums_of(materialize(_vectors(spark, sf_dir), "vectors"), materialize(fx.event_labels(spark, sf_dir), "labels"))


def _sums_of(vectors: DataFrame, labels: DataFrame):
    scales = condlogit.fold_scales(condlogit.scaler_stats(vectors, labels))
    return condlogit.evaluate(condlogit.event_table(vectors, labels, labels), {f: _given_weights(len(s)) for f, s in scales.items()}, scales, 1.0)


@query(
    _SHARES + """ SELECT g.fold, g.ix, round(g.gradient, 6) + 0.0 AS gradient, round(l.loss + norm.half, 6) + 0.0 AS loss FROM norm,
    (SELECT z.fold, z.ix, sum(s.p * z.z) - sum(CASE WHEN z.is_root THEN z.z ELSE 0 END) + min(z.weight) AS gradient
     FROM standard z JOIN shares s ON s.fold = z.fold AND s.case_id = z.case_id AND s.service = z.service GROUP BY z.fold, z.ix) g
    JOIN (SELECT fold, sum(mass - score) AS loss FROM shares WHERE is_root GROUP BY fold) l ON l.fold = g.fold"""
)
def logit_loss_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and gradient of each fold's training cases at given weights."""
    sums = _sums_at_given_weights(spark, sf_dir)
    rows = [(f, k, float(g), loss) for f, (loss, gradient, _) in sums.items() for k, g in enumerate(gradient)]
    return rounded(spark.createDataFrame(rows, "fold int, ix int, gradient double, loss double"), "gradient", "loss")


@query(
    _SHARES + """, around AS (
    SELECT z.fold, z.case_id, z.service, z.ix, s.p, z.z - sum(s.p * z.z) OVER (PARTITION BY z.fold, z.case_id, z.ix) AS d
    FROM standard z JOIN shares s ON s.fold = z.fold AND s.case_id = z.case_id AND s.service = z.service)
    SELECT a.fold, a.ix AS i, b.ix AS j, round(sum(a.p * a.d * b.d) + CASE WHEN a.ix = b.ix THEN 1 ELSE 0 END, 6) + 0.0 AS value
    FROM around a JOIN around b ON b.fold = a.fold AND b.case_id = a.case_id AND b.service = a.service AND b.ix >= a.ix GROUP BY a.fold, a.ix, b.ix"""
)
def logit_hessian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Hessian of each fold's loss at given weights, its upper half."""
    sums = _sums_at_given_weights(spark, sf_dir)
    rows = [(f, i, j, float(h[i, j])) for f, (_, _, h) in sums.items() for i in range(len(h)) for j in range(i, len(h))]
    return rounded(spark.createDataFrame(rows, "fold int, i int, j int, value double"), "value")


def _given_model(spark: SparkSession, vectors: DataFrame, labels: DataFrame) -> DataFrame:
    stats = condlogit.scaler_stats(vectors, labels)
    names = F.array(*(F.lit(n) for n in FEATURE_NAMES))
    weight = ((F.col("ix") * 7) % 11 - 5) / F.lit(50.0)
    return stats.select("fold", "ix", F.get(names, F.col("ix")).alias("name"), weight.alias("weight"), "mean", "scale", F.lit(FEATURE_DIGEST).alias("digest"))


@query(
    _SCALED + """ SELECT case_id, fold, service, round(score, 6) + 0.0 AS score, CAST(row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, service) AS INT) AS rank
    FROM scores WHERE fold = own"""
)
def fold_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case scored and ranked by the model of its own fold, the models having given weights."""
    vectors, labels = materialize(_vectors(spark, sf_dir), "vectors"), fx.event_labels(spark, sf_dir)
    found = condlogit.predict(vectors, labels, _given_model(spark, vectors, labels)).drop("rank").withColumn("score", F.round("score", 9))
    return rounded(ranking.ranked(found), "score")


@query(
    _SHARES + """, rough AS (SELECT fold, own, case_id, service, sum(z * round(weight, 1)) AS score FROM standard WHERE fold = own GROUP BY ALL),
    both_sides AS (
      SELECT a.case_id, a.service, a.score, b.score AS other, row_number() OVER (PARTITION BY a.case_id ORDER BY round(a.score, 9) DESC, a.service) AS rank,
             row_number() OVER (PARTITION BY b.case_id ORDER BY round(b.score, 9) DESC, b.service) AS other_rank
      FROM scores a JOIN rough b ON b.case_id = a.case_id AND b.service = a.service WHERE a.fold = a.own),
    hits AS (SELECT l.fault, l.root, l.fold, b.rank, b.other_rank FROM both_sides b JOIN labels l ON l.case_id = b.case_id AND l.root = b.service),
    worths AS (
      SELECT h.*, g.kind, CASE g.kind WHEN 'overall' THEN 'all' WHEN 'fault' THEN fault WHEN 'root' THEN root ELSE CAST(fold AS VARCHAR) END AS value
      FROM hits h, (VALUES ('overall'), ('fault'), ('root'), ('fold')) g(kind)),
    metric_diffs AS (
      SELECT greatest(abs(avg(greatest(0, 6 - rank) / 5.0::DOUBLE) - avg(greatest(0, 6 - other_rank) / 5.0::DOUBLE)), abs(avg(1.0::DOUBLE / rank) - avg(1.0::DOUBLE / other_rank)),
             abs(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) - avg(CASE WHEN other_rank <= 1 THEN 1.0::DOUBLE ELSE 0 END)),
             abs(avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END) - avg(CASE WHEN other_rank <= 3 THEN 1.0::DOUBLE ELSE 0 END)),
             abs(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) - avg(CASE WHEN other_rank <= 5 THEN 1.0::DOUBLE ELSE 0 END))) AS diff
      FROM worths GROUP BY kind, value)
    SELECT (SELECT max(abs(gradient)) <= 1e-8 FROM (
             SELECT sum(s.p * z.z) - sum(CASE WHEN z.is_root THEN z.z ELSE 0 END) + min(z.weight) AS gradient
             FROM standard z JOIN shares s ON s.fold = z.fold AND s.case_id = z.case_id AND s.service = z.service GROUP BY z.fold, z.ix)) AS converged,
           (SELECT bool_and(rank = other_rank) FROM both_sides) AS same_rankings, (SELECT max(abs(score - other)) <= 0.5 FROM both_sides) AS scores_agree,
           (SELECT max(diff) <= 0.05 FROM metric_diffs) AS metrics_agree, (SELECT round(max(diff), 6) + 0.0 FROM metric_diffs) AS worst_metric, (SELECT round(max(abs(score - other)), 6) + 0.0 FROM both_sides) AS worst_score"""
)
def rounded_model_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on a model stored with weights of one decimal, held against the model as it was, with wide tolerances; its weights are given, not fitted, and the gradient tells."""
    vectors, labels = materialize(_vectors(spark, sf_dir), "vectors"), materialize(fx.event_labels(spark, sf_dir), "labels")
    model = _given_model(spark, vectors, labels)
    path = scratch_path(spark, "rough-model")
    norms = {f: float(np.abs(gradient).max()) for f, (_, gradient, _) in _sums_of(vectors, labels).items()}
    fits = spark.createDataFrame([(f, norm, norm <= 1e-8) for f, norm in norms.items()], "fold int, gradient_norm double, converged boolean")
    condlogit.save_model(model.withColumn("weight", F.round("weight", 1)), fits, path)
    sides = []
    for weights in (model, condlogit.load_model(spark, path)[0]):
        found = condlogit.predict(vectors, labels, weights).drop("rank").withColumn("score", F.round("score", 9))
        sides.append(materialize(ranking.ranked(found), "ranked"))
    groups = [ranking.metric_groups(ranking.case_metrics(s, labels.select("case_id", "root", "fault", "fold"))) for s in sides]
    diff, metrics = ranking.prediction_diff(*sides), ranking.metric_diff(*groups)
    verdict = contracts.integrity_verdict(diff, metrics, fits, 0.5, 0.05).drop("passed")
    worst = metrics.agg(F.max("diff").alias("worst_metric"))
    row = verdict.join(F.broadcast(worst)).join(F.broadcast(diff.select(F.col("max_score_diff").alias("worst_score"))))  # one row each
    return rounded(row, "worst_metric", "worst_score")


def _fitted(spark: SparkSession, sf_dir: str):
    vectors = materialize(features.feature_vectors(fx.event_features(spark, sf_dir)), "vectors")  # read once per Newton step and more
    labels = materialize(fx.event_labels(spark, sf_dir), "labels")
    return vectors, labels, *condlogit.fit_out_of_fold(vectors, labels, labels)


@query()
def oof_fit_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out scores and ranks of all candidates, each case scored by the model of its fold."""
    return ranking.canonical_order(_fitted(spark, sf_dir)[2])


@query()
def model_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted model is written, read back and asked again: the verdict on ranks, scores and all metrics against the fresh predictions."""
    vectors, labels, fresh, weights, fits = _fitted(spark, sf_dir)
    fresh, path = materialize(fresh, "fresh"), scratch_path(spark, "model")
    condlogit.save_model(weights, fits, path)
    stored, stored_fits = condlogit.load_model(spark, path)
    verdict = condlogit.replay_verdict(vectors, labels, fresh, stored, stored_fits)
    broken = contracts.model_violations(stored).agg((F.count(F.lit(1)) == 0).alias("state_valid"))
    return verdict.join(F.broadcast(broken)).withColumn("digest", F.lit(FEATURE_DIGEST))  # one row


_PAIRED = A + _RANKED + sql.LABELS + _METRICS + _BY_SUM + """, others AS (
  SELECT l.case_id, l.fault, greatest(0, 6 - b.rank) / 5.0::DOUBLE AS "Avg@5" FROM labels l JOIN by_sum b ON b.case_id = l.case_id AND b.service = l.root),
deltas AS (SELECT m.case_id, m.fault, m."Avg@5" - o."Avg@5" AS delta FROM metrics m JOIN others o ON o.case_id = m.case_id)"""


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = materialize(fx.event_features(spark, sf_dir), "dense")  # read twice
    left = _case_metrics(spark, sf_dir, _magnitude_ranking(spark, dense))
    return stats.paired_deltas(left, _case_metrics(spark, sf_dir, _impact_ranking(dense)))


@query(_PAIRED + " SELECT fault, count(*) AS n, round(avg(delta), 6) + 0.0 AS mean_delta FROM (SELECT fault, delta FROM deltas UNION ALL SELECT 'all', delta FROM deltas) GROUP BY fault")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.mean_deltas(_deltas(spark, sf_dir)), "mean_delta")


@query(
    _PAIRED + """, pools AS (SELECT fault, list(delta ORDER BY case_id) AS pool FROM deltas GROUP BY fault),
    draws AS (SELECT r AS resample, fault, pool[CAST(CAST('0x' || substr(md5('7:' || r || ':' || fault || ':' || k), 1, 8) AS BIGINT) % len(pool) AS INT) + 1] AS delta
      FROM (SELECT r, fault, pool, unnest(range(len(pool))) AS k FROM pools, range(1, 10001) t(r))),
    means AS (SELECT resample, avg(delta) AS mean FROM draws GROUP BY resample)
    SELECT (SELECT count(*) FROM deltas) AS n, (SELECT round(avg(delta), 6) + 0.0 FROM deltas) AS point, round(quantile_cont(mean, 0.025), 6) + 0.0 AS low, round(quantile_cont(mean, 0.975), 6) + 0.0 AS high FROM means"""
)
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.bootstrap_ci(_deltas(spark, sf_dir)), "point", "low", "high")


_VARIANTS = {"A0": "magnitude", "A1": "mean_impact", "A2": "persistence", "A3": "coverage"}
_FACTORS = A + sql.LABELS + ", variants AS (" + " UNION ALL ".join(
    f"""SELECT '{v}' AS variant, avg(greatest(0, 6 - rank) / 5.0::DOUBLE) AS value, avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS top FROM (
    SELECT case_id, service, row_number() OVER (PARTITION BY case_id ORDER BY round(sum({c}), 9) DESC, service) AS rank FROM dense GROUP BY case_id, service) r
    JOIN labels l ON l.case_id = r.case_id AND l.root = r.service"""
    for v, c in _VARIANTS.items()
) + "), wide AS (SELECT " + ", ".join(f"max(CASE WHEN variant = '{v}' THEN value END) AS {v}, max(CASE WHEN variant = '{v}' THEN top END) AS t{v}" for v in _VARIANTS) + " FROM variants)"


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant, value, top): mean Avg@5 and AC@1 of rankings by four single features."""
    sums = fx.event_features(spark, sf_dir).groupBy("case_id", "service").agg(*(F.round(F.sum(c), 9).alias(v) for v, c in _VARIANTS.items()))
    long = sums.unpivot(["case_id", "service"], list(_VARIANTS), "variant", "score").withColumn("case_id", F.concat_ws("/", "variant", "case_id"))
    order = ranking.ranked(long.drop("variant")).withColumn("parts", F.split("case_id", "/"))
    rows = order.select(F.get("parts", F.lit(0)).alias("variant"), F.get("parts", F.lit(1)).alias("case_id"), F.col("service").alias("root"), "rank")
    joined = rows.join(fx.event_labels(spark, sf_dir).select("case_id", "root"), ["case_id", "root"])
    return joined.groupBy("variant").agg(F.avg(F.greatest(F.lit(0), 6 - F.col("rank")) / 5.0).alias("value"), F.avg((F.col("rank") <= 1).cast("double")).alias("top"))


@query(_FACTORS + " SELECT " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in (("a1_a0", "A1 - A0"), ("a3_a2", "A3 - A2"), ("a2_a0", "A2 - A0"), ("a3_a1", "A3 - A1"), ("interaction", "(A3 - A2) - (A1 - A0)"))) + " FROM wide")
def factorial_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = stats.factorial_effects(_variants(spark, sf_dir))
    return rounded(effects, *effects.columns)


_GATE = A + sql.LABELS + _RANKED + _BY_SUM + """, variants AS (
  SELECT 'A0' AS variant, case_id, service, rank FROM by_sum UNION ALL SELECT 'A1', case_id, service, rank FROM ranked
  UNION ALL SELECT 'A2', case_id, service, row_number() OVER (PARTITION BY case_id ORDER BY round(sum(coverage), 9) DESC, service) FROM dense GROUP BY case_id, service
  UNION ALL SELECT 'A3', case_id, service, row_number() OVER (PARTITION BY case_id ORDER BY round(sum(persistence), 9) DESC, service) FROM dense GROUP BY case_id, service),
worth AS (
  SELECT v.variant, l.case_id, l.fault, greatest(0, 6 - v.rank) / 5.0::DOUBLE AS avg5, CASE WHEN v.rank <= 1 THEN 1.0::DOUBLE ELSE 0 END AS ac1
  FROM variants v JOIN labels l ON l.case_id = v.case_id AND l.root = v.service),
means AS (SELECT variant, avg(avg5) AS avg5, avg(ac1) AS ac1 FROM worth GROUP BY variant),
wide AS (SELECT """ + ", ".join(f"max({m}) FILTER (variant = '{v}') AS {v}_{m}" for v in ("A0", "A1", "A2", "A3") for m in ("avg5", "ac1")) + """ FROM means),
deltas AS (SELECT case_id, fault, sum(CASE WHEN variant IN ('A1', 'A3') THEN avg5 ELSE -avg5 END) / 2 AS delta FROM worth GROUP BY case_id, fault),
pools AS (SELECT fault, list(delta ORDER BY case_id) AS pool FROM deltas GROUP BY fault),
draws AS (
  SELECT r AS resample, fault, pool[CAST(CAST('0x' || substr(md5('7:' || r || ':' || fault || ':' || k), 1, 8) AS BIGINT) % len(pool) AS INT) + 1] AS delta
  FROM (SELECT r, fault, pool, unnest(range(len(pool))) AS k FROM pools, range(1, 10001) t(r))),
ci AS (SELECT quantile_cont(mean, 0.025) AS low FROM (SELECT avg(delta) AS mean FROM draws GROUP BY resample)),
whole AS (
  SELECT count(*) = 4 * (SELECT count(*) FROM candidates) AND count(v.rank) = count(*) AS whole
  FROM (SELECT c.*, t.variant FROM candidates c, (VALUES ('A0'), ('A1'), ('A2'), ('A3')) t(variant)) c LEFT JOIN variants v ON v.variant = c.variant AND v.case_id = c.case_id AND v.service = c.candidate),
checks AS (
  SELECT round(A1_avg5 - A0_avg5, 9) > 0 AS first_delta_positive, round(A3_avg5 - A2_avg5, 9) > 0 AS second_delta_positive,
         round(((A1_avg5 - A0_avg5) + (A3_avg5 - A2_avg5)) / 2, 9) >= 0.01 AS mean_delta_threshold, round(A1_ac1 - A0_ac1, 9) >= -0.01 AND round(A3_ac1 - A2_ac1, 9) >= -0.01 AS ac1_guardrail,
         round(ci.low, 9) > 0 AS ci_low_positive, whole.whole AS integrity FROM wide, ci, whole)"""


@query(_GATE + " SELECT *, first_delta_positive AND second_delta_positive AND mean_delta_threshold AND ac1_guardrail AND ci_low_positive AND integrity AS passed FROM checks")
def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """May magnitude and persistence take the place of impact and coverage? By mean metrics, a bootstrap of both gains, and whole rankings."""
    dense = materialize(fx.event_features(spark, sf_dir), "dense")
    labels = materialize(fx.event_labels(spark, sf_dir).select("case_id", "root", "fault", "fold"), "labels")
    sums = lambda c: dense.groupBy("case_id", "service").agg(F.round(F.sum(c), 9).alias("score"))
    orders = [_impact_ranking(dense), _magnitude_ranking(spark, dense), ranking.ranked(sums("coverage")), ranking.ranked(sums("persistence"))]
    named = [o.select(F.lit(f"A{k}").alias("variant"), "case_id", "service", "rank") for k, o in enumerate(orders)]
    variants = materialize(named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3]), "variants")
    both = F.concat_ws("/", "variant", "case_id")
    known = fx.candidate_rows(fx.event_cases(spark)).withColumn("variant", F.explode(F.array(*(F.lit(f"A{k}") for k in range(4)))))
    gaps = ranking.prediction_gaps(known.select(both.alias("case_id"), "candidate"), variants.select(both.alias("case_id"), "service", "rank"))
    worth = materialize(variants.join(labels, (variants["case_id"] == labels["case_id"]) & (F.col("service") == F.col("root"))).select(
        "variant", labels["case_id"], "fault", (F.greatest(F.lit(0), 6 - F.col("rank")) / 5.0).alias("avg5"), (F.col("rank") <= 1).cast("double").alias("ac1")
    ), "worth")
    wide = worth.groupBy().pivot("variant", ["A0", "A1", "A2", "A3"]).agg(F.avg("avg5").alias("avg5"), F.avg("ac1").alias("ac1"))
    gain = F.sum(F.when(F.col("variant").isin("A1", "A3"), F.col("avg5")).otherwise(-F.col("avg5"))) / 2.0
    low = stats.bootstrap_ci(worth.groupBy("case_id", "fault").agg(gain.alias("delta"))).select(F.round("low", 9).alias("ci_low"))
    less = lambda m, a, b: F.round(F.col(f"A{a}_{m}") - F.col(f"A{b}_{m}"), 9)
    row = wide.select(less("avg5", 1, 0).alias("avg5_first"), less("avg5", 3, 2).alias("avg5_second"), less("ac1", 1, 0).alias("ac1_first"), less("ac1", 3, 2).alias("ac1_second"))
    row = row.join(F.broadcast(low)).join(F.broadcast(gaps.agg((F.count(F.lit(1)) == 0).alias("integrity"))))  # one row each
    return stats.gate_decision(row)


@query(
    f"""WITH {_CONDITION}, indicators AS (
      SELECT DISTINCT CASE event_type WHEN 'signup' THEN 'log' WHEN 'error' THEN 'trace-error' WHEN 'purchase' THEN 'trace-latency' ELSE 'metric' END AS channel,
        CASE user_id % 4 WHEN 0 THEN service || '_latency-50' WHEN 1 THEN 'frontendservice_' || event_type WHEN 2 THEN 'time' ELSE service || '_' || event_type END AS indicator FROM conditions),
    known AS (SELECT channel, indicator, CASE WHEN channel LIKE 'trace%' THEN regexp_replace(indicator, '^frontendservice_', 'frontend_') ELSE indicator END AS alias FROM indicators
      WHERE indicator <> 'time' AND NOT (channel = 'metric' AND ends_with(indicator, '_latency-50'))),
    candidates AS (SELECT DISTINCT service AS candidate FROM conditions UNION SELECT 'frontend')
    SELECT channel, indicator, max_by(candidate, length(candidate)) AS service FROM known JOIN candidates ON starts_with(alias, candidate || '_') GROUP BY channel, indicator"""
)
def indicator_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time column and median latencies of the metric channel go; traces know the front end by another name."""
    rows = _conditions(spark, sf_dir)
    kind, user = F.col("event_type"), F.col("user_id") % 4
    channel = F.when(kind == "signup", "log").when(kind == "error", "trace-error").when(kind == "purchase", "trace-latency").otherwise("metric")
    indicator = (
        F.when(user == 0, F.concat("service", F.lit("_latency-50"))).when(user == 1, F.concat(F.lit("frontendservice_"), kind)).when(user == 2, "time")
        .otherwise(F.concat_ws("_", "service", kind))
    )
    named = rows.select(F.lit("one").alias("case_id"), channel.alias("channel"), indicator.alias("indicator")).distinct()
    known = rows.select(F.col("service").alias("candidate")).distinct().unionByName(spark.createDataFrame([("frontend",)], "candidate string"))
    return telemetry.indicator_services(named, known.select(F.lit("one").alias("case_id"), "candidate")).drop("case_id")


# --- files: derived from the tables, written, and read by the sources ----------------------------------------


@query(
    f"""WITH {_CONDITION} SELECT condition, CAST(replicate AS VARCHAR) AS replicate, string_agg(DISTINCT {_FILES}[CAST(event_id % 8 AS INT) + 1], ',' ORDER BY {_FILES}[CAST(event_id % 8 AS INT) + 1]) AS files
    FROM conditions WHERE NOT condition LIKE '%fire' AND replicate < 4 GROUP BY condition, replicate"""
)
def discovered_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.get(F.array(*(F.lit(f) for f in sorted(ingest.CASE_FILES))), (F.col("event_id") % 8).cast("int"))
    listed = _conditions(spark, sf_dir).select("condition", F.col("replicate").cast("string").alias("replicate"), file.alias("file"))
    return ingest.discover_cases(listed).withColumn("files", F.array_join("files", ","))


@query(
    f"""WITH {_CONDITION} SELECT condition, CAST(replicate AS VARCHAR) AS replicate, CASE WHEN max(user_id) % 5 = 0 THEN 'none' ELSE CAST(min(event_id) AS VARCHAR) END AS anchor
    FROM conditions GROUP BY condition, replicate"""
)
def stored_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor files, one per case directory, a few of them no numbers."""
    path = scratch_path(spark, "anchors")
    text = F.when(F.max("user_id") % 5 == 0, "soon").otherwise(F.concat(F.lit(" "), F.min("event_id").cast("string"), F.lit("\t")))
    rows = _conditions(spark, sf_dir).groupBy("condition", "replicate").agg(text.alias("value"))
    rows.write.partitionBy("condition", "replicate").text(path)
    return ingest.read_anchors(spark, path, "*.txt").withColumn("anchor", F.coalesce(F.col("anchor").cast("string"), F.lit("none")))


@query(
    f"""WITH {_CONDITION}, headers AS (SELECT DISTINCT condition, CAST(replicate AS VARCHAR) AS replicate, service || CASE WHEN user_id % 3 = 0 THEN '_cpu' WHEN user_id % 3 = 1 THEN '_mem' ELSE '_disk' END AS indicator FROM conditions)
    SELECT condition, replicate, string_agg(indicator, ',' ORDER BY indicator) AS indicators, string_agg(CASE WHEN indicator NOT LIKE '%\\_disk' ESCAPE '\\' THEN regexp_extract(indicator, '^(.*)_', 1) END, ',' ORDER BY indicator) AS entities
    FROM headers GROUP BY condition, replicate"""
)
def stored_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files with a header of their own in each case directory; the headers name the candidates."""
    path = scratch_path(spark, "headers")
    indicator = F.concat("service", F.when(F.col("user_id") % 3 == 0, "_cpu").when(F.col("user_id") % 3 == 1, "_mem").otherwise("_disk"))
    header = F.concat(F.lit('"time",'), F.array_join(F.sort_array(F.collect_set(indicator)), ","), F.lit("\n0,1,2\n"))
    rows = _conditions(spark, sf_dir).groupBy("condition", "replicate").agg(header.alias("value"))
    rows.write.partitionBy("condition", "replicate").text(path)
    found = ingest.read_headers(spark, path, "*.txt").withColumn("indicators", F.array_except("indicators", F.array(F.lit("time"))))
    keys = found.withColumn("case_id", F.concat_ws("/", "condition", "replicate"))
    named = ingest.derive_candidates(keys.select("case_id", F.explode("indicators").alias("indicator")))
    entities = named.groupBy("case_id").agg(F.array_join(F.sort_array(F.collect_list("candidate")), ",").alias("entities"))
    return keys.join(entities, "case_id", "left").select("condition", "replicate", F.array_join("indicators", ",").alias("indicators"), "entities")


@query(
    f"""WITH {_CONDITION}, told AS (SELECT condition || '/' || replicate AS relative, event_id, user_id, service || CASE WHEN user_id % 3 = 0 THEN '_cpu' WHEN user_id % 3 = 1 THEN '_mem' ELSE '_disk' END AS indicator FROM conditions),
    own AS (SELECT relative, indicator, count(*) AS n, sum(user_id / 8) AS total FROM told GROUP BY relative, indicator)
    SELECT own.relative, indicator, t.cells, n, round(total, 3) + 0.0 AS total, t.first_ts FROM own
    JOIN (SELECT relative, count(*) AS cells, CAST(min(event_id) + 0.5 AS DOUBLE) AS first_ts FROM told GROUP BY relative) t ON own.relative = t.relative"""
)
def stored_unlike_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide CSV file in each case directory, each with columns of its own; an event fills one cell of its line."""
    path = scratch_path(spark, "unlike")
    keys = ["condition", "replicate"]
    indicator = F.concat("service", F.when(F.col("user_id") % 3 == 0, "_cpu").when(F.col("user_id") % 3 == 1, "_mem").otherwise("_disk"))
    events = _conditions(spark, sf_dir).select(*keys, "event_id", "user_id", indicator.alias("indicator"))
    heads = events.groupBy(*keys).agg(F.sort_array(F.collect_set("indicator")).alias("names"))
    filled = F.transform("names", lambda c: F.when(c == F.col("indicator"), (F.col("user_id") / 8).cast("string")).otherwise(""))
    lines = events.join(heads, keys).select(*keys, F.col("event_id").alias("nr"), F.concat_ws(",", (F.col("event_id") + 0.5).cast("string"), filled).alias("value"))
    first = heads.select(*keys, F.lit(None).cast("long").alias("nr"), F.concat_ws(",", F.lit('"time"'), "names").alias("value"))
    told = materialize(lines.unionByName(first), "lines")  # a union of sides dealt by the same keys would pass for dealt, and a header lie apart
    told.repartition(*keys).sortWithinPartitions(*keys, "nr").drop("nr").write.partitionBy(*keys).text(path)
    long = ingest.read_telemetry(spark, path, files={"*.txt": "metric"})
    return long.groupBy("relative", "indicator").agg(
        F.count(F.lit(1)).alias("cells"), F.count("value").alias("n"), tidy(F.sum("value"), 3).alias("total"), F.min("ts").alias("first_ts")
    )


@query(
    f"WITH {sql.TELEMETRY_B.strip()} SELECT split_part(indicator, '_l_', 1) AS series, 'l_' || split_part(indicator, '_l_', 2) AS indicator, count(*) AS n, round(sum(value), 2) + 0.0 AS total, round(min(ts), 0) + 0.0 AS first_ts FROM telemetry GROUP BY ALL"
)
def stored_wide_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide telemetry written as CSV files of any size and read by the distributed reader."""
    path = scratch_path(spark, "wide")
    fx.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("sup"), (F.col("l_suppkey") % 8).cast("string"), F.lit("_"), F.col("l_returnflag")).alias("series"),
        fx.seconds_since("l_shipdate", "1995-01-01").alias("time"), *fx.MEASURES,
    ).write.csv(path, header=True)
    long = ingest.read_wide_csv(spark, path, ["series"])
    return long.groupBy("series", "indicator").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("value"), 2).alias("total"), tidy(F.min("ts"), 0).alias("first_ts"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total, max(event_id) AS last_id, min(props) AS first_props FROM events GROUP BY event_type")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    ingest.write_jsonl(fx.table(spark, sf_dir, "events").select("event_type", "event_id", "value", "props"), path)
    rows = ingest.read_jsonl(spark, path, "event_id bigint, event_type string, props string, value double")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("value"), 4).alias("total"), F.max("event_id").alias("last_id"), F.min("props").alias("first_props"))


@query(
    """SELECT CAST(s_nationkey AS VARCHAR) AS folder, CAST(sum(strlen(s_name) + 1) AS BIGINT) AS length, sha256(string_agg(s_name || chr(10), '' ORDER BY s_name, s_suppkey)) AS sha256
    FROM supplier GROUP BY s_nationkey"""
)
def file_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file per nation, with its suppliers' names."""
    path = scratch_path(spark, "names")
    rows = fx.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("value"), "s_suppkey")
    rows.repartition("nation").sortWithinPartitions("nation", "value", "s_suppkey").drop("s_suppkey").write.partitionBy("nation").text(path)
    found = ingest.checksums(spark, path).filter(F.col("path").contains("nation="))
    return found.select(F.regexp_extract("path", "nation=([^/]*)/", 1).alias("folder"), "length", "sha256")


_BUNDLE = f"""WITH {_CONDITION}, found AS (
  SELECT condition, replicate, list(DISTINCT service) AS services, min(event_id) AS anchor, 'ds' || replicate AS dataset, regexp_extract(condition, '^(.*)_([^_]*)$', 1) AS root
  FROM conditions WHERE NOT condition LIKE '%fire' GROUP BY condition, replicate),
cases AS (SELECT * FROM found WHERE anchor % 4 <> 0), others AS (SELECT * FROM found WHERE anchor % 4 = 0)"""


def _bundle(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(good cases, excluded cases) of the events' conditions; every fourth anchor is unusable."""
    rows = _conditions(spark, sf_dir).filter(names.known_fault(F.col("condition")))
    found = rows.groupBy("condition", "replicate").agg(F.collect_set("service").alias("candidates"), F.min("event_id").alias("anchor"))
    found = found.withColumn("files", F.array(*(F.lit(f) for f in ingest.CASE_FILES))).withColumn("anchor", F.when(F.col("anchor") % 4 != 0, F.col("anchor")))
    told = materialize(ingest.with_reasons(found).withColumn("relative", F.concat_ws("/", "condition", "replicate")), "told")
    good = told.filter("reason IS NULL").select(
        names.opaque_id("ev", "events", F.col("relative")).alias("case_id"), F.concat(F.lit("ds"), F.col("replicate").cast("string")).alias("dataset"),
        F.col("anchor").cast("double").alias("anchor"), "candidates", F.col("replicate").cast("int").alias("replicate"), "root", "fault", "relative",
    )
    return good, told.filter("reason IS NOT NULL").select("relative", "reason")


@query(
    _BUNDLE + """ SELECT 'inputs' AS part, count(*) AS n, 'anchor,candidates,case_id,dataset' AS columns FROM cases UNION ALL SELECT 'labels', count(*), 'case_id,dataset,fault,root' FROM cases
    UNION ALL SELECT 'sources', count(*), 'case_id,dataset,relative,replicate' FROM cases UNION ALL SELECT 'excluded', count(*), 'reason,relative' FROM others
    UNION ALL SELECT 'registry', count(*), 'dataset,service' FROM (SELECT DISTINCT dataset, unnest(services) FROM cases)"""
)
def bundle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle's tables, as written and read again: labels lie apart from inputs."""
    path = scratch_path(spark, "bundle")
    ingest.write_bundle(*_bundle(spark, sf_dir), path)
    parts = []
    for part in ("inputs", "labels", "sources", "registry", "excluded"):
        rows = spark.read.parquet(f"{path}/{part}")
        parts.append(rows.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n")).withColumn("columns", F.lit(",".join(sorted(rows.columns)))))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found


@query(
    _BUNDLE + """ SELECT dataset, count(DISTINCT condition || '/' || replicate) AS cases, count(DISTINCT service) AS services, string_agg(DISTINCT service, ',' ORDER BY service) AS registry, (SELECT count(*) FROM others) AS excluded
    FROM (SELECT *, unnest(services) AS service FROM cases) GROUP BY dataset"""
)
def bundle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.manifest(*_bundle(spark, sf_dir)).withColumn("registry", F.array_join("registry", ","))


@query(
    A + sql.LABELS + """ SELECT v.case_id, l.root, l.fault, l.fold, count(DISTINCT v.service) AS candidates, count(*) AS cells, round(sum(v.value), 4) + 0.0 AS total
    FROM long v JOIN labels l ON l.case_id = v.case_id GROUP BY ALL"""
)
def stored_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature store, labels and folds, written in buckets of cases and loaded side by side without a shuffle."""
    path = scratch_path(spark, "dataset")
    vectors = features.feature_vectors(fx.event_features(spark, sf_dir))
    labels = materialize(fx.event_labels(spark, sf_dir), "labels")
    ingest.write_bucketed({"features": vectors, "labels": labels, "splits": ranking.canonical_order(labels.select("case_id", "fold"))}, path, 8)
    rows = ingest.load_bucketed(spark, path, 8)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    keys = ("case_id", "root", "fault", "fold")
    return rows.groupBy(*keys).agg(F.count_distinct("service").alias("candidates"), F.sum(F.size("features")).alias("cells"), tidy(F.sum(total), 4).alias("total"))


# --- spoilt tables against their contracts --------------------------------------------------------------------


@query(
    A + _LONG + """, spoilt AS (
    SELECT case_id, service, k, ix, CASE WHEN case_id = 'case-01' AND service = 'svc1' AND ix = 0 THEN NULL ELSE value END AS value FROM flat, range(2) t(k)
    WHERE (k = 0 OR case_id = 'case-02' AND service = 'svc2') AND NOT (case_id = 'case-03' AND service <> 'svc3') AND NOT (case_id = 'case-04' AND service = 'svc4' AND ix = 67)),
    rows AS (SELECT case_id, service, k, count(*) AS dim, count(value) AS there FROM spoilt GROUP BY ALL),
    events AS (SELECT case_id, count(*) AS n, count(DISTINCT service) AS d, bool_and(dim = there) AS finite, min(dim) AS low, max(dim) AS high FROM rows GROUP BY case_id)
    SELECT case_id, unnest(list_concat(CASE WHEN d < 2 THEN ['few candidates'] ELSE [] END, CASE WHEN n <> d THEN ['repeated candidate'] ELSE [] END,
      CASE WHEN NOT finite THEN ['not finite'] ELSE [] END, CASE WHEN low <> 68 OR high <> 68 THEN ['dimension'] ELSE [] END)) AS rule FROM events"""
)
def event_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a number, a candidate or a feature spoilt."""
    vectors = _vectors(spark, sf_dir)
    at = lambda case, service: (F.col("case_id") == case) & (F.col("service") == service)
    spoilt = vectors.filter(~((F.col("case_id") == "case-03") & (F.col("service") != "svc3")))
    nan = F.transform("features", lambda x, k: F.when(k == 0, F.lit(float("nan"))).otherwise(x))
    spoilt = spoilt.withColumn("features", F.when(at("case-01", "svc1"), nan).when(at("case-04", "svc4"), F.slice("features", 1, 67)).otherwise(F.col("features")))
    spoilt = spoilt.withColumn("copy", F.explode(F.when(at("case-02", "svc2"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy")
    return contracts.event_violations(spoilt, 68)


@query(
    _SCALED + f""", model AS (
    SELECT fold, ix, CASE WHEN fold = 1 AND ix = 3 THEN 'other' ELSE {sql.NAMES}[ix + 1] END AS name, {sql.NAMES}[ix + 1] AS wanted, CASE WHEN fold = 2 AND ix = 7 THEN NULL ELSE scale END AS number
    FROM stats WHERE NOT (fold = 0 AND ix = 5)),
    folds AS (SELECT fold, count(*) AS n, count(DISTINCT ix) AS d, bool_and(name = wanted) AS named, count(number) = count(*) AS finite FROM model GROUP BY fold)
    SELECT fold, unnest(list_concat(CASE WHEN n <> 68 OR d <> 68 THEN ['dimension'] ELSE [] END, CASE WHEN NOT named THEN ['names'] ELSE [] END, CASE WHEN NOT finite THEN ['not finite'] ELSE [] END)) AS rule FROM folds"""
)
def model_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model states with a feature lost, renamed or without a number."""
    vectors, labels = materialize(_vectors(spark, sf_dir), "vectors"), fx.event_labels(spark, sf_dir)
    model, ix = _given_model(spark, vectors, labels), F.col("ix")
    spoilt = model.filter(~((F.col("fold") == 0) & (ix == 5))).withColumn("name", F.when((F.col("fold") == 1) & (ix == 3), "other").otherwise(F.col("name")))
    return contracts.model_violations(spoilt.withColumn("scale", F.when((F.col("fold") == 2) & (ix == 7), F.lit(float("inf"))).otherwise(F.col("scale"))))


@query(
    A + sql.LABELS + """, featured AS (SELECT DISTINCT case_id FROM long WHERE case_id <> 'case-01'), named AS (SELECT DISTINCT case_id FROM labels WHERE case_id <> 'case-02'),
    placed AS (SELECT case_id, fold FROM labels WHERE case_id <> 'case-03' UNION ALL SELECT 'case-99', 1),
    every AS (SELECT case_id FROM featured UNION SELECT case_id FROM named UNION SELECT case_id FROM placed),
    told AS (SELECT case_id, unnest(list_concat(CASE WHEN case_id NOT IN (FROM featured) THEN ['no features'] ELSE [] END, CASE WHEN case_id NOT IN (FROM named) THEN ['no label'] ELSE [] END,
      CASE WHEN case_id NOT IN (SELECT case_id FROM placed) THEN ['no fold'] ELSE [] END)) AS rule FROM every)
    SELECT case_id, rule FROM told UNION ALL SELECT CAST(fold AS VARCHAR), 'no training or test cases' FROM (SELECT DISTINCT fold FROM placed WHERE fold = 1)"""
)
def alignment_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, labels and folds that don't name the same cases; and a split whose cases are all in one fold."""
    labels = materialize(fx.event_labels(spark, sf_dir), "labels")
    folds = labels.filter("case_id <> 'case-03'").select("case_id", F.col("fold").cast("int").alias("fold"))
    folds = folds.unionByName(spark.createDataFrame([("case-99", 1)], "case_id string, fold int"))
    vectors = features.feature_vectors(fx.event_features(spark, sf_dir)).filter("case_id <> 'case-01'")
    gaps = contracts.alignment_violations(vectors, labels.filter("case_id <> 'case-02'"), folds)
    alone = contracts.empty_folds(folds.filter("fold = 1"))
    return gaps.unionByName(alone.select(F.col("fold").cast("string").alias("case_id"), "rule"))


@query(
    A + sql.LABELS + """, spoilt AS (
    SELECT case_id, root, fault, fold, CASE WHEN case_id = 'case-04' THEN 4 ELSE replicate END AS replicate FROM labels UNION ALL SELECT case_id, root, fault, fold, replicate FROM labels WHERE case_id = 'case-07'),
    totals_of AS (SELECT count(*) AS n, count(DISTINCT case_id) AS d FROM spoilt)
    SELECT 'repeated case' AS rule, CAST(n AS VARCHAR) AS detail FROM totals_of WHERE n <> d UNION ALL SELECT 'cases', CAST(n AS VARCHAR) FROM totals_of WHERE n <> 18
    UNION ALL SELECT 'replicate', case_id FROM spoilt WHERE replicate NOT IN (1, 2, 3)
    UNION ALL SELECT 'stratum', fold || '/' || root || '/' || fault FROM spoilt GROUP BY fold, root, fault HAVING count(*) > 1
    UNION ALL SELECT 'fold size', fold || '/' || count(*) FROM spoilt GROUP BY fold HAVING count(*) <> 6"""
)
def split_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split with a case twice and a replicate that there is not."""
    labels = materialize(fx.event_labels(spark, sf_dir).select("case_id", "root", "fault", "fold", "replicate"), "labels")
    spoilt = labels.withColumn("replicate", F.when(F.col("case_id") == "case-04", 4).otherwise(F.col("replicate"))).unionByName(labels.filter("case_id = 'case-07'"))
    return splits.split_violations(spoilt, cases=18, per_fold=6)
