"""Metrics, health and alerts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators import alerts as al
from tidewatch.operators import health as hl
from tidewatch.operators import metrics as mx
from tidewatch.operators.alerts import ErrorRateRule, HealthRule, ThresholdRule
from tidewatch.plans.registry import Registry
from tidewatch.plans.source_queries import metric_points
from tidewatch.plans.views import check_sql, view
from tidewatch.session import materialize, scratch_dir

REG = Registry()
_KEYED = "k AS (SELECT *, concat(name, '{service=', service, ',zone=', zone, '}') AS key FROM metric_point)"


@REG.query("x10_series_key", check_sql("metric_point", "SELECT event_id, key FROM k", _KEYED))
def x10(spark, sf_dir):
    return metric_points(spark, sf_dir).select("event_id", "key")


@REG.query("x11_split_key", check_sql("metric_point", """
    SELECT event_id, name, concat('service=', service, ',zone=', zone) AS labels FROM metric_point"""))
def x11(spark, sf_dir):
    name, labels = mx.split_key(F.col("key"))
    return metric_points(spark, sf_dir).select("event_id", name.alias("name"), labels.alias("labels"))


@REG.query("a08_counters", check_sql("metric_point", """
    SELECT key, round(sum(value), 4) AS value FROM k WHERE kind = 'counter' GROUP BY 1""", _KEYED))
def a08(spark, sf_dir):
    return mx.counters(metric_points(spark, sf_dir)).select("key", F.round("value", 4).alias("value"))


@REG.query("a09_gauges", check_sql("metric_point", """
    SELECT key, value FROM k WHERE kind = 'gauge' QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1""", _KEYED))
def a09(spark, sf_dir):
    return mx.gauges(metric_points(spark, sf_dir))


_SUMMARY = "count(*) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean"


def _rounded(summary):
    return summary.withColumn("sum", F.round("sum", 4)).withColumn("mean", F.round("mean", 6))


@REG.query("a10_histogram_summary", check_sql("metric_point", f"SELECT key, {_SUMMARY} FROM k WHERE kind = 'histogram' GROUP BY 1", _KEYED))
def a10(spark, sf_dir):
    return _rounded(mx.summary(metric_points(spark, sf_dir).where("kind = 'histogram'"), ["key"]))


@REG.query("a11_buckets", check_sql("metric_point", """
    SELECT name, le, count(CASE WHEN value <= le THEN 1 END) AS count
    FROM metric_point, (VALUES (5.0::DOUBLE), (25.0), (100.0), (400.0)) AS b(le) GROUP BY 1, 2"""))
def a11(spark, sf_dir):
    return mx.buckets(view(spark, sf_dir, "metric_point"), ["name"], (5, 25, 100, 400))


@REG.query("a12_percentiles", check_sql("metric_point", """
    SELECT name, v[1 + least(CAST(floor(50 * len(v) / 100.0) AS BIGINT), len(v) - 1)] AS p50,
           v[1 + least(CAST(floor(95 * len(v) / 100.0) AS BIGINT), len(v) - 1)] AS p95,
           v[1 + least(CAST(floor(99 * len(v) / 100.0) AS BIGINT), len(v) - 1)] AS p99
    FROM (SELECT name, list_sort(list(value)) AS v FROM (SELECT name, value FROM metric_point
          QUALIFY row_number() OVER (PARTITION BY name ORDER BY ts DESC, event_id DESC) <= 1000) GROUP BY 1)"""))
def a12(spark, sf_dir):
    return mx.recent_percentiles(view(spark, sf_dir, "metric_point"), ["name"], [F.desc("ts"), F.desc("event_id")], ["event_id"])


def _timers(spark, sf_dir):
    runs = view(spark, sf_dir, "cleanup_run")
    return mx.timer_points(runs, "started_at", "ended_at", ["run_type"]).withColumnRenamed("run_type", "key")


@REG.query("a13_timers", check_sql("cleanup_run", f"""
    SELECT key, {_SUMMARY} FROM (SELECT run_type AS key, (epoch_us(ended_at) - epoch_us(started_at)) / 1e6 AS value FROM cleanup_run) GROUP BY 1"""))
def a13(spark, sf_dir):
    return _rounded(mx.summary(_timers(spark, sf_dir), ["key"]))


_LONG = """
    SELECT '{kind}' AS kind, key, s.stat, round(CASE s.stat WHEN 'count' THEN c WHEN 'sum' THEN t WHEN 'min' THEN lo WHEN 'max' THEN hi ELSE m END, 4) AS value
    FROM (SELECT key, CAST(count(*) AS DOUBLE) AS c, sum(value) AS t, min(value) AS lo, max(value) AS hi, avg(value) AS m FROM {rows} GROUP BY 1),
         (VALUES ('count'), ('sum'), ('min'), ('max'), ('mean')) AS s(stat)"""


@REG.query("a14_snapshot", check_sql("metric_point, cleanup_run", """
    SELECT 'counter' AS kind, key, 'value' AS stat, round(sum(value), 4) AS value FROM k WHERE kind = 'counter' GROUP BY 2
    UNION ALL SELECT 'gauge', key, 'value', round(arg_max(value, event_id), 4) FROM k WHERE kind = 'gauge' GROUP BY 2
    UNION ALL """ + _LONG.format(kind="histogram", rows="(SELECT * FROM k WHERE kind = 'histogram')")
    + " UNION ALL " + _LONG.format(kind="timer", rows="(SELECT run_type AS key, (epoch_us(ended_at) - epoch_us(started_at)) / 1e6 AS value FROM cleanup_run)"), _KEYED))
def a14(spark, sf_dir):
    totals = mx.series(metric_points(spark, sf_dir)).unionByName(mx.timer_series(_timers(spark, sf_dir), "started_at"))
    return mx.snapshot(totals).withColumn("value", F.round("value", 4))


@REG.query("a14_snapshot_distributions", check_sql("metric_point", """
    SELECT 'histogram' AS kind, key, concat('p', p) AS stat, v[1 + least(CAST(floor(p * len(v) / 100.0) AS BIGINT), len(v) - 1)] AS value FROM cut, (VALUES (50), (95), (99)) AS q(p)
    UNION ALL SELECT 'histogram', key, concat('le_', le), CAST(count(CASE WHEN value <= CAST(le AS DOUBLE) THEN 1 END) AS DOUBLE)
      FROM k, (VALUES ('10.0'), ('50.0'), ('250.0')) AS b(le) WHERE kind = 'histogram' GROUP BY 2, 3
    UNION ALL SELECT 'histogram', key, 'le_+Inf', CAST(count(*) AS DOUBLE) FROM k WHERE kind = 'histogram' GROUP BY 2""",
    _KEYED + """, cut AS (SELECT key, list_sort(list(value)) AS v FROM (SELECT key, value FROM k WHERE kind = 'histogram'
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) <= 1000) GROUP BY 1)"""))
def a14_distributions(spark, sf_dir):
    points, bounds = metric_points(spark, sf_dir), (10, 50, 250)
    return mx.distributions(points, mx.series(points, bounds=bounds), bounds).where("kind = 'histogram'")


_LAST = """last_result AS (SELECT * FROM health_result QUALIFY row_number() OVER (PARTITION BY name ORDER BY ts DESC, event_id DESC) = 1)"""
_HEALTH = """count(CASE WHEN status = 'unhealthy' THEN 1 END) AS unhealthy_count, count(CASE WHEN status = 'degraded' THEN 1 END) AS degraded_count,
    count(CASE WHEN status = 'unknown' THEN 1 END) AS unknown_count, count(CASE WHEN status = 'healthy' THEN 1 END) AS healthy_count,
    count(*) AS total_checks, CASE WHEN count(*) = 0 THEN 'unknown' WHEN bool_or(status = 'unhealthy') THEN 'unhealthy'
    WHEN bool_or(status = 'degraded') THEN 'degraded' WHEN bool_or(status = 'unknown') THEN 'unknown' ELSE 'healthy' END AS overall_status"""
_ROUND = """round_result AS (SELECT *, date_trunc('hour', ts) AS round FROM health_result
    QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', ts), name ORDER BY ts DESC, event_id DESC) = 1)"""


@REG.query("w01_latest_per_check", check_sql("health_result", "SELECT name, event_id, ts, status, duration_ms FROM last_result", _LAST))
def w01(spark, sf_dir):
    return hl.last_results(view(spark, sf_dir, "health_result"))


@REG.query("a15_health_summary", check_sql("health_result", f"SELECT {_HEALTH} FROM last_result", _LAST))
def a15(spark, sf_dir):
    return hl.summary(hl.last_results(view(spark, sf_dir, "health_result")))


@REG.query("w02_recent_history", check_sql("health_result", """
    SELECT name, event_id, ts, status, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rn
    FROM health_result) WHERE rn <= 100"""))
def w02(spark, sf_dir):
    return hl.check_history(view(spark, sf_dir, "health_result")).select("name", "event_id", "ts", "status", "rn")


@REG.query("w02_summary_history", check_sql("health_result", f"SELECT round, {_HEALTH} FROM round_result GROUP BY round ORDER BY round DESC LIMIT 100", _ROUND))
def w02_summary(spark, sf_dir):
    return hl.history(view(spark, sf_dir, "health_result"), "1 hour")


@REG.query("w02_metric_history", check_sql("metric_point", """
    SELECT key, event_id, value, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rn FROM k) WHERE rn <= 20""", _KEYED))
def w02_metrics(spark, sf_dir):
    return mx.metric_history(metric_points(spark, sf_dir), 20).select("key", "event_id", "value", "rn")


@REG.query("j13_registered_checks", check_sql("health_result", """
    SELECT r.name, l.status, l.ts FROM (SELECT DISTINCT concat('check_', p_size % 8) AS name FROM part) r LEFT JOIN last_result l ON r.name = l.name""", _LAST))
def j13(spark, sf_dir):
    checks = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("check_"), (F.col("p_size") % 8).cast("string")).alias("name")).distinct()
    return hl.registered_checks(checks, view(spark, sf_dir, "health_result")).select("name", "status", "ts")


def _plain_values(spark, sf_dir):
    points = view(spark, sf_dir, "metric_point").withColumn("key", F.col("name"))
    return al.metric_values(mx.series(points))


THRESHOLDS = (ThresholdRule("many-requests", "warning", "requests_total", 1000.0),
              ThresholdRule("few-connections", "info", "active_connections", 100000.0, "less_than"),
              ThresholdRule("slow", "critical", "request_duration", 10.0),
              ThresholdRule("exact", "warning", "errors_total", -1.0, "equals"),
              ThresholdRule("absent", "critical", "no_such_metric", 0.0))
_RULES = """rules(name, severity, metric, threshold, comparison) AS (VALUES ('many-requests', 'warning', 'requests_total', 1000.0::DOUBLE, 'greater_than'),
    ('few-connections', 'info', 'active_connections', 100000.0, 'less_than'), ('slow', 'critical', 'request_duration', 10.0, 'greater_than'),
    ('exact', 'warning', 'errors_total', -1.0, 'equals'), ('absent', 'critical', 'no_such_metric', 0.0, 'greater_than'))"""
_VALUES = """vals AS (SELECT name AS metric, sum(value) AS value FROM metric_point WHERE kind = 'counter' GROUP BY 1
    UNION ALL SELECT name, arg_max(value, event_id) FROM metric_point WHERE kind = 'gauge' GROUP BY 1
    UNION ALL SELECT name, CAST(count(*) AS DOUBLE) FROM metric_point WHERE kind = 'histogram' GROUP BY 1)"""
_HIT = """CASE comparison WHEN 'greater_than' THEN value > threshold WHEN 'less_than' THEN value < threshold
    WHEN 'equals' THEN value = threshold ELSE FALSE END"""


@REG.query("j11_rule_metric", check_sql("metric_point", """
    SELECT r.name, r.metric, round(v.value, 4) AS value FROM rules r LEFT JOIN vals v ON r.metric = v.metric""", f"{_RULES}, {_VALUES}"))
def j11(spark, sf_dir):
    rows = al.resolve_metrics(THRESHOLDS, _plain_values(spark, sf_dir))
    return rows.select("name", "metric", F.round("value", 4).alias("value"))


@REG.query("x25_comparison", check_sql("metric_point", f"""
    SELECT event_id, r.name, {_HIT} AS triggered FROM metric_point m JOIN (SELECT name, metric, threshold / 20 AS threshold, comparison FROM rules) r ON m.name = r.metric""", _RULES))
def x25(spark, sf_dir):
    points = view(spark, sf_dir, "metric_point").select("event_id", F.col("name").alias("metric"), "value")
    own = F.filter(al.rule_array(THRESHOLDS), lambda r: r["metric"] == F.col("metric"))  # before the rows multiply
    return points.select("*", F.explode(own).alias("r")).select(
        "event_id", "r.name", al.compare(F.col("value"), F.col("r.comparison"), F.col("r.threshold") / 20).alias("triggered"))


HEALTH_RULES = (HealthRule("checks-degraded", "warning", "degraded", ("check_0", "check_1", "check_2", "check_3")),
                HealthRule("checks-healthy", "info", "healthy", ("check_0", "check_1", "check_2", "check_3", "check_4")),
                HealthRule("system-degraded", "critical", "degraded"), HealthRule("system-healthy", "info", "healthy"))
_HEALTH_ALERTS = """
    SELECT name, severity, concat('Health checks failing: ', string_agg(check_name, ', ' ORDER BY check_name)) AS message FROM (
      SELECT r.name, r.severity, l.name AS check_name FROM last_result l JOIN
        (VALUES ('checks-degraded', 'warning', 'degraded', 3), ('checks-healthy', 'info', 'healthy', 4)) AS r(name, severity, target, upto)
        ON l.status = r.target AND CAST(right(l.name, 1) AS INTEGER) <= r.upto) GROUP BY 1, 2
    UNION ALL SELECT r.name, r.severity, concat('System health is ', r.target) FROM
      (VALUES ('system-degraded', 'critical', 'degraded'), ('system-healthy', 'info', 'healthy')) AS r(name, severity, target)
      JOIN health h ON h.overall_status = r.target"""
_HEALTH_CTES = f"{_LAST}, health AS (SELECT {_HEALTH} FROM last_result)"


def _health(spark, sf_dir):
    results = hl.last_results(view(spark, sf_dir, "health_result"))
    return results, hl.summary(results)


@REG.query("j12_health_rules", check_sql("health_result", _HEALTH_ALERTS, _HEALTH_CTES))
def j12(spark, sf_dir):
    return al.health_alerts(HEALTH_RULES, *_health(spark, sf_dir)).select("name", "severity", "message")


@REG.query("a16_failing_checks", check_sql("health_result", """
    SELECT round, string_agg(name, ',' ORDER BY name) AS failing_checks FROM round_result WHERE status IN ('unhealthy', 'degraded') GROUP BY 1""", _ROUND))
def a16(spark, sf_dir):
    failing = hl.rounds(view(spark, sf_dir, "health_result"), "1 hour").where(F.col("status").isin("unhealthy", "degraded"))
    return failing.groupBy("round").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("failing_checks"))


@REG.query("u05_registered_and_failing", check_sql("health_result", """
    SELECT name FROM (SELECT DISTINCT concat('check_', p_size % 4) AS name FROM part) WHERE name IN
    (SELECT name FROM round_result WHERE status IN ('unhealthy', 'unknown'))""", _ROUND))
def u05(spark, sf_dir):
    registered = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("check_"), (F.col("p_size") % 4).cast("string")).alias("name"))
    failing = hl.rounds(view(spark, sf_dir, "health_result"), "1 hour").where(F.col("status").isin("unhealthy", "unknown"))
    return registered.intersect(failing.select("name"))


RATE_RULES = (ErrorRateRule("error-rate", "critical"), ErrorRateRule("error-rate-high", "warning", 5.0))


@REG.query("a19_error_rate", check_sql("metric_point", """
    SELECT round(e, 4) AS errors, round(r, 4) AS requests, round(e / r, 8) AS rate FROM (SELECT
      coalesce(sum(CASE WHEN metric = 'errors_total' THEN value END), 0) AS e, coalesce(sum(CASE WHEN metric = 'requests_total' THEN value END), 0) AS r
      FROM vals) WHERE r <> 0""", _VALUES))
def a19(spark, sf_dir):
    rows = al.error_rate(_plain_values(spark, sf_dir), "errors_total", "requests_total")
    return rows.select(F.round("errors", 4).alias("errors"), F.round("requests", 4).alias("requests"), F.round("rate", 8).alias("rate"))


def _all_alerts(spark, sf_dir):
    rules = al.RuleSet().add_thresholds(*THRESHOLDS).add_health(*HEALTH_RULES).add_error_rates(*RATE_RULES)
    values, results = (materialize(df, "alert-input") for df in (_plain_values(spark, sf_dir), hl.last_results(view(spark, sf_dir, "health_result"))))
    return rules.evaluate(values, results, hl.summary(results))


_ALL = f"""{_HEALTH_CTES}, {_RULES}, {_VALUES}, alert AS (
    SELECT r.name, r.severity, 'metric_threshold' AS alert_type FROM rules r JOIN vals v ON r.metric = v.metric WHERE {_HIT}
    UNION ALL SELECT name, severity, 'health_status' FROM ({_HEALTH_ALERTS})
    UNION ALL SELECT q.name, q.severity, 'error_rate' FROM (VALUES ('error-rate', 'critical', 0.05::DOUBLE), ('error-rate-high', 'warning', 5.0)) AS q(name, severity, limit_)
      WHERE (SELECT sum(value) FROM vals WHERE metric = 'errors_total') / (SELECT sum(value) FROM vals WHERE metric = 'requests_total') > q.limit_)"""


@REG.query("e01_rule_set", check_sql("health_result, metric_point", "SELECT name, severity, alert_type FROM alert", _ALL))
def e01(spark, sf_dir):
    return _all_alerts(spark, sf_dir).select("name", "severity", F.col("labels")["alert_type"].alias("alert_type"))


@REG.query("a17_alert_summary", check_sql("health_result, metric_point", """
    SELECT s.severity, count(a.name) AS n FROM (VALUES ('critical'), ('warning'), ('info')) AS s(severity) LEFT JOIN alert a ON a.severity = s.severity GROUP BY 1
    UNION ALL SELECT 'active', count(*) FROM alert""", _ALL))
def a17(spark, sf_dir):
    return al.alert_summary(_all_alerts(spark, sf_dir))


@REG.query("a18_overall_status", check_sql("health_result, metric_point", """
    SELECT CASE WHEN overall_status IN ('unhealthy', 'degraded') THEN overall_status WHEN critical > 0 THEN 'unhealthy'
           WHEN active > 0 THEN 'degraded' ELSE 'healthy' END AS status, overall_status, active, critical
    FROM health, (SELECT count(*) AS active, count(CASE WHEN severity = 'critical' THEN 1 END) AS critical FROM alert)""", _ALL))
def a18(spark, sf_dir):
    return al.overall_status(_health(spark, sf_dir)[1], _all_alerts(spark, sf_dir))


@REG.query("e03_alert_routing", check_sql("health_result, metric_point", """
    SELECT name, CASE WHEN severity = 'critical' THEN 'ERROR' ELSE 'WARNING' END AS log_level,
           concat('ALERT [', upper(severity), '] ', name, ':') AS head FROM alert""", _ALL))
def e03(spark, sf_dir):
    return al.route(_all_alerts(spark, sf_dir)).select("name", "log_level", F.concat(F.substring_index("line", ": ", 1), F.lit(":")).alias("head"))


@REG.query("e03_alert_table", check_sql("health_result, metric_point", """
    SELECT name, severity, CASE WHEN severity = 'critical' THEN 'ERROR' ELSE 'WARNING' END AS log_level, count(*) AS n FROM alert GROUP BY 1, 2""", _ALL))
def e03_table(spark, sf_dir):
    path = scratch_dir(spark, "alerts")
    al.append_alerts(_all_alerts(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("name", "severity", "log_level").agg(F.count("*").alias("n"))


@REG.query("e02_probe_status", check_sql("request_log", """
    SELECT event_id, CASE WHEN duration_ms > 300 THEN 'unhealthy' WHEN duration_ms >= 180 THEN 'unhealthy'
           WHEN duration_ms >= 90 THEN 'degraded' ELSE 'healthy' END AS status FROM request_log"""))
def e02(spark, sf_dir):
    value = F.col("duration_ms")
    return view(spark, sf_dir, "request_log").select(
        "event_id", hl.probe_status(value, F.lit(90), F.lit(180), value, F.lit(300)).alias("status"))


ROUND_RULES = (ThresholdRule("error-share", "critical", "rate", 0.3), ThresholdRule("busy", "warning", "n", 16.0),
               ThresholdRule("quiet", "info", "n", 9.0, "less_than"))


def _grid(spark, sf_dir):
    audit = view(spark, sf_dir, "audit_log")
    rounds = (audit.groupBy(F.window("ts", "1 hour").getField("start").alias("round"))
              .agg(F.count("*").alias("n"), F.avg((F.col("operation_result") == "failure").cast("double")).alias("rate")))
    return al.firing_grid(rounds, ROUND_RULES, ["n", "rate"])


_GRID = """rounds AS (SELECT date_trunc('hour', ts) AS round, count(*) AS n, avg(CASE WHEN operation_result = 'failure' THEN 1.0::DOUBLE ELSE 0 END) AS rate
      FROM audit_log GROUP BY 1),
    grid AS (SELECT round, 'error-share' AS name, 'critical' AS severity, rate > 0.3 AS firing FROM rounds UNION ALL
      SELECT round, 'busy', 'warning', n > 16 FROM rounds UNION ALL SELECT round, 'quiet', 'info', n < 9 FROM rounds),
    marked AS (SELECT *, coalesce(lag(firing) OVER w, FALSE) AS before, lead(round) OVER w AS next_round FROM grid WINDOW w AS (PARTITION BY name ORDER BY round))"""


@REG.query("w05_transitions", check_sql("audit_log", """
    SELECT round, name, severity, CASE WHEN firing THEN 'firing' ELSE 'resolved' END AS state FROM marked WHERE firing <> before""", _GRID))
def w05(spark, sf_dir):
    return al.transitions(_grid(spark, sf_dir))


@REG.query("w06_episodes", check_sql("audit_log", """
    SELECT name, severity, min(round) AS starts_at, arg_max(coalesce(next_round, TIMESTAMP '9999-01-01'), round) AS ends_at, count(*) AS rounds FROM (
      SELECT *, sum(CASE WHEN firing AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY round) AS episode FROM marked) WHERE firing GROUP BY name, severity, episode""", _GRID))
def w06(spark, sf_dir):
    return al.episodes(_grid(spark, sf_dir)).withColumn("ends_at", F.coalesce("ends_at", F.expr("TIMESTAMP_NTZ '9999-01-01'")))


@REG.query("u02_resolved_set", check_sql("audit_log", """
    SELECT next_round AS round, name FROM marked m WHERE firing AND next_round IS NOT NULL AND NOT EXISTS
    (SELECT 1 FROM grid g WHERE g.name = m.name AND g.round = m.next_round AND g.firing)""", _GRID))
def u02(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    after = F.lead("round").over(W.partitionBy("name").orderBy("round"))
    previous = grid.withColumn("after", after).where("firing AND after IS NOT NULL").select(F.col("after").alias("round"), "name")
    return al.resolved(previous, grid.where("firing"), ("round", "name"))


@REG.query("w08_snapshot_delta", check_sql("metric_point", """
    SELECT name, hour, round(total, 4) AS total, round(total - lag(total) OVER (PARTITION BY name ORDER BY hour), 4) AS step,
           round(last_value(total) OVER w - first_value(total) OVER w, 4) AS overall
    FROM (SELECT name, hour, sum(v) OVER (PARTITION BY name ORDER BY hour) AS total FROM (
      SELECT name, date_trunc('hour', ts) AS hour, sum(value) AS v FROM metric_point WHERE kind = 'counter' GROUP BY 1, 2))
    WINDOW w AS (PARTITION BY name ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""))
def w08(spark, sf_dir):
    points = view(spark, sf_dir, "metric_point").where("kind = 'counter'")
    hourly = points.groupBy("name", F.window("ts", "1 hour").getField("start").alias("hour")).agg(F.sum("value").alias("v"))
    order = W.partitionBy("name").orderBy("hour")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    totals = hourly.select("name", "hour", F.sum("v").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("total"))
    return totals.select("name", "hour", F.round("total", 4).alias("total"),
                         F.round(F.col("total") - F.lag("total").over(order), 4).alias("step"),
                         F.round(F.last("total").over(whole) - F.first("total").over(whole), 4).alias("overall"))
