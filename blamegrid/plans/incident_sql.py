"""SQL for the incident queries: each step is a common table expression that builds on those before it."""

from __future__ import annotations

from ..functions.grid import BASE, FEATURE_NAMES, MORPHOLOGY

CASES_A = """
cases AS (
  SELECT 'case-' || lpad(CAST(j AS VARCHAR), 2, '0') AS case_id, 864000.0::DOUBLE + 43200 * j AS anchor,
         ['cpu', 'mem', 'disk', 'socket', 'delay', 'loss'][j % 6 + 1] AS fault, CAST(j // 6 + 1 AS INT) AS replicate, CAST(j // 6 AS INT) AS fold
  FROM range(18) t(j)),
candidates AS (
  SELECT case_id, unnest(['svc0', 'svc0_b', 'svc1', 'svc1_b', 'svc2', 'svc2_b', 'svc3', 'svc3_b', 'svc4', 'svc4_b', 'svc5', 'svc5_b', 'svc9_ghost']) AS candidate FROM cases)"""
TELEMETRY_A = """
telemetry AS (
  SELECT service, channel, CASE WHEN user_id % 97 = 0 THEN 'unmapped' ELSE service END || '_' || event_type || '_k' || k AS indicator, ts, value
  FROM (SELECT user_id, event_type, value, 'svc' || (user_id % 6) || CASE WHEN user_id % 12 >= 6 THEN '_b' ELSE '' END AS service,
               CASE event_type WHEN 'signup' THEN 'log' WHEN 'error' THEN 'trace-error' WHEN 'purchase' THEN 'trace-latency' ELSE 'metric' END AS channel,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 2 AS k, epoch(ts - TIMESTAMP '2024-01-01') AS ts
        FROM events))"""
CASES_B = """
cases AS (
  SELECT 'case-' || lpad(CAST(j AS VARCHAR), 2, '0') AS case_id, (43 + 4 * j) * 1296000.0::DOUBLE AS anchor FROM range(18) t(j)),
candidates AS (SELECT case_id, 'sup' || k AS candidate FROM cases, range(8) t(k))"""
TELEMETRY_B = """
telemetry AS (
  SELECT channel, 'sup' || (l_suppkey % 8) || '_' || l_returnflag || '_' || measure AS indicator, epoch(l_shipdate - TIMESTAMP '1995-01-01') AS ts, value
  FROM (SELECT l_suppkey, l_returnflag, l_shipdate, 'metric' AS channel, 'l_quantity' AS measure, l_quantity AS value FROM lineitem
        UNION ALL SELECT l_suppkey, l_returnflag, l_shipdate, 'log', 'l_discount', l_discount FROM lineitem
        UNION ALL SELECT l_suppkey, l_returnflag, l_shipdate, 'trace-error', 'l_tax', l_tax FROM lineitem
        UNION ALL SELECT l_suppkey, l_returnflag, l_shipdate, 'trace-latency', 'l_extendedprice', l_extendedprice FROM lineitem))"""
MAPPED = """
mapped AS (
  SELECT c.case_id, i.channel, i.indicator, max_by(c.candidate, length(c.candidate)) AS service
  FROM (SELECT DISTINCT channel, indicator FROM telemetry) i JOIN candidates c ON starts_with(i.indicator, c.candidate || '_')
  WHERE NOT (i.channel = 'metric' AND i.indicator LIKE '%\\_latency-50' ESCAPE '\\')
  GROUP BY c.case_id, i.channel, i.indicator)"""


def chain(which: str = "a") -> str:
    """All steps up to the cells' features, for fixture a or b."""
    cases, telemetry, width = (CASES_A, TELEMETRY_A, "21600.0") if which == "a" else (CASES_B, TELEMETRY_B, "1296000.0")
    return (
        f"WITH {cases.strip()},{telemetry},{MAPPED},"
        + f"""
binned AS (
  SELECT c.case_id, m.service, t.channel, t.indicator, CAST(floor((t.ts - (c.anchor - 40 * {width}::DOUBLE)) / {width}::DOUBLE) AS INT) AS bin, avg(t.value) AS x
  FROM telemetry t JOIN cases c ON t.ts >= c.anchor - 40 * {width}::DOUBLE AND t.ts < c.anchor + 40 * {width}::DOUBLE
  JOIN mapped m ON m.case_id = c.case_id AND m.channel = t.channel AND m.indicator = t.indicator
  WHERE isfinite(t.value) GROUP BY ALL),
centred AS (
  SELECT *, median(CASE WHEN bin < 40 THEN x END) OVER (PARTITION BY case_id, service, channel, indicator) AS center,
         quantile_cont(CASE WHEN bin < 40 THEN x END, 0.75) OVER (PARTITION BY case_id, service, channel, indicator)
         - quantile_cont(CASE WHEN bin < 40 THEN x END, 0.25) OVER (PARTITION BY case_id, service, channel, indicator) AS iqr
  FROM binned),
scaled AS (
  SELECT case_id, service, channel, indicator, bin, x, center,
         CASE WHEN mad >= 1e-6 THEN mad WHEN iqr / 1.349::DOUBLE >= 1e-6 THEN iqr / 1.349::DOUBLE END AS scale
  FROM (SELECT *, 1.4826::DOUBLE * median(CASE WHEN bin < 40 THEN abs(x - center) END) OVER (PARTITION BY case_id, service, channel, indicator) AS mad FROM centred)),
profile AS (
  SELECT case_id, service, channel, bin, quantile_cont(abs((x - center) / (scale + 1e-6::DOUBLE)), 0.9) AS q
  FROM scaled WHERE scale IS NOT NULL GROUP BY ALL),
shaped AS (
  SELECT *, q / (max(q) OVER w + 1e-6::DOUBLE) AS z, max(q) OVER w AS top, lead(bin) OVER o AS next_bin, lead(q) OVER o AS next_q, lag(bin) OVER o AS last_bin
  FROM profile WINDOW w AS (PARTITION BY case_id, service, channel), o AS (PARTITION BY case_id, service, channel ORDER BY bin)),
stepped AS (SELECT *, lag(z) OVER (PARTITION BY case_id, service, channel ORDER BY bin) AS last_z FROM shaped),
sums AS (
  SELECT case_id, service, channel, count(*) FILTER (bin < 40) AS n_pre, count(*) FILTER (bin >= 40) AS n_post,
         max(q) FILTER (bin >= 40) AS magnitude, avg(q) FILTER (bin >= 40) AS post_mean, avg(q) FILTER (bin < 40) AS pre_mean,
         avg(CASE WHEN q >= 3 THEN 1.0::DOUBLE ELSE 0 END) FILTER (bin >= 40) AS persistence,
         min(bin - 40) FILTER (bin >= 40 AND q >= 3 AND next_bin = bin + 1 AND next_q >= 3) AS onset, max(top) AS top,
         avg(z) FILTER (bin < 40) AS pre_z, avg(z) FILTER (bin >= 40) AS post_z,
         arg_max(bin - 40, row(z, 40 - bin)) FILTER (bin >= 40) AS peak,
         sum((bin - 40) * greatest(z, 0)) FILTER (bin >= 40) AS moment, sum(greatest(z, 0)) FILTER (bin >= 40) AS mass,
         regr_slope(z, (bin - 40) / 39.0::DOUBLE) FILTER (bin >= 40) AS slope,
         avg(abs(z - last_z)) FILTER (bin >= 40 AND last_bin >= 40 AND bin - last_bin = 1) AS wobble,
         avg(CASE WHEN z >= 0.5 THEN 1.0::DOUBLE ELSE 0 END) FILTER (bin >= 40) AS high_share
  FROM stepped GROUP BY ALL),
flagged AS (SELECT *, n_pre > 0 AND n_post > 0 AS there, n_pre > 0 AND n_post > 0 AND top >= 1e-6 AS active FROM sums),
cells AS (
  SELECT case_id, service, channel,
         CASE WHEN there THEN magnitude ELSE 0 END AS magnitude, CASE WHEN there THEN post_mean ELSE 0 END AS mean_impact,
         CASE WHEN there THEN post_mean - pre_mean ELSE 0 END AS pre_post_shift,
         CASE WHEN there THEN coalesce(onset, 40) * {width}::DOUBLE ELSE 0 END AS onset_seconds,
         CASE WHEN there AND onset IS NOT NULL THEN 0.0::DOUBLE ELSE 1 END AS onset_missing,
         CASE WHEN there THEN persistence ELSE 0 END AS persistence, (n_pre + n_post) / 80.0::DOUBLE AS coverage,
         CASE WHEN there THEN 1.0::DOUBLE ELSE 0 END AS channel_available,
         CASE WHEN active THEN pre_z ELSE 0 END AS normalized_pre_mean, CASE WHEN active THEN post_z ELSE 0 END AS normalized_post_mean,
         CASE WHEN active THEN post_z - pre_z ELSE 0 END AS normalized_post_minus_pre_mean,
         CASE WHEN active THEN peak / 39.0::DOUBLE ELSE 0 END AS post_peak_time_fraction,
         CASE WHEN active AND mass > 0 THEN moment / mass / 39.0::DOUBLE ELSE 0 END AS post_amplitude_weighted_centroid_fraction,
         CASE WHEN active AND n_post >= 2 THEN coalesce(slope, 0) ELSE 0 END AS post_ols_slope,
         CASE WHEN active THEN coalesce(wobble, 0) ELSE 0 END AS post_mean_absolute_adjacent_difference,
         CASE WHEN active THEN high_share ELSE 0 END AS post_fraction_z_ge_0_5, CASE WHEN active THEN 1.0::DOUBLE ELSE 0 END AS morphology_active
  FROM flagged),
channels AS (SELECT * FROM (VALUES ('metric', 0), ('log', 1), ('trace-error', 2), ('trace-latency', 3)) v(channel, channel_ix)),
dense AS (
  SELECT g.case_id, g.candidate AS service, h.channel, h.channel_ix, """
        + ", ".join(f"coalesce(f.{n}, {1 if n == 'onset_missing' else 0}) AS {n}" for n in BASE + MORPHOLOGY)
        + """
  FROM candidates g CROSS JOIN channels h LEFT JOIN cells f ON f.case_id = g.case_id AND f.service = g.candidate AND f.channel = h.channel),
magnitudes AS (
  SELECT case_id, service, coalesce(sum(least(magnitude, 20)) / nullif(sum(channel_available), 0), 0) AS a FROM dense GROUP BY ALL),
long AS (
  SELECT case_id, service, channel_ix * 17 + k AS ix, [{values}][k + 1] AS value FROM dense, range(17) t(k))""".replace("{values}", ", ".join(BASE + MORPHOLOGY))
    )


LABELS = """,
totals AS (
  SELECT c.case_id, t.service AS root, sum(t.value) AS total FROM telemetry t JOIN cases c ON t.ts >= c.anchor AND t.ts < c.anchor + 40 * 21600.0::DOUBLE
  WHERE t.indicator NOT LIKE 'unmapped%' GROUP BY ALL),
labels AS (
  SELECT x.case_id, x.root, c.fault, c.fold, c.replicate
  FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY total DESC, root) AS nr FROM totals) x JOIN cases c ON c.case_id = x.case_id WHERE nr = 1)"""
NAMES = "[" + ", ".join(f"'{n}'" for n in FEATURE_NAMES) + "]"


def rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)
