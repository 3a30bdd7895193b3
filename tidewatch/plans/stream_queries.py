"""Streaming jobs run over everything available (T01-T12), checked against the same result in batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import alerts as al
from tidewatch.operators import metrics as mx
from tidewatch.operators.segments import ordered_events, sessions
from tidewatch.plans.monitor_queries import _HEALTH, _KEYED, _ROUND, ROUND_RULES
from tidewatch.plans.registry import Registry
from tidewatch.plans.sequential_queries import ADMISSION_SQL, BREAKER_SQL, CONFIG, DEBOUNCE_SQL, LIMIT, THROTTLE_SQL
from tidewatch.plans.source_queries import _JSON_ROWS, raw_lines
from tidewatch.plans.views import apply_view, check_sql, view
from tidewatch.session import scratch_dir
from tidewatch.streaming import jobs

REG = Registry()


def _stream(spark, sf_dir, name):
    return apply_view(jobs.stream_table(spark, f"{sf_dir}/events.parquet"), name)


def _standing(spark, sf_dir, name, job):
    """A standing aggregate over everything available, compacted and read."""
    folder = scratch_dir(spark, "standing")
    jobs.keep_standing(_stream(spark, sf_dir, name), folder, job).awaitTermination()
    jobs.compact(spark, folder, job)
    return jobs.read_standing(spark, folder, job)


@REG.query("t01_stream_ingest", check_sql("audit_log", f"""
    SELECT event_id, CASE WHEN {_JSON_ROWS} THEN 'json' WHEN event_id % 17 = 0 THEN 'rejected' ELSE 'text' END AS layout,
           CASE WHEN event_id % 17 <> 0 THEN level END AS level, CASE WHEN event_id % 17 = 0 THEN NULL WHEN {_JSON_ROWS} THEN ts ELSE date_trunc('second', ts) END AS ts FROM audit_log"""))
def t01(spark, sf_dir):
    folder = scratch_dir(spark, "ingest")
    jobs.ingest(raw_lines(_stream(spark, sf_dir, "audit_log")), folder).awaitTermination()
    good = jobs.ingested(spark, folder).select("event_id", "layout", "level", "ts")
    bad = jobs.rejected(spark, folder, ["event_id"]).withColumn("layout", F.lit("rejected"))
    return good.unionByName(bad, allowMissingColumns=True)


@REG.query("t02_stream_hourly_counts", check_sql("audit_log", "SELECT date_trunc('hour', ts) AS period_start, level, count(*) AS n FROM audit_log GROUP BY 1, 2"))
def t02(spark, sf_dir):
    return _standing(spark, sf_dir, "audit_log", jobs.period_counts("1 hour", ["level"]))


_RATE = "count(*) AS requests, count(CASE WHEN operation_result = 'failure' THEN 1 END) AS errors, count(CASE WHEN operation_result = 'failure' THEN 1 END) / count(*) AS rate"


@REG.query("t03_stream_error_rate", check_sql("audit_log", f"SELECT time_bucket(INTERVAL '5' MINUTE, ts) AS window_start, {_RATE} FROM audit_log GROUP BY 1"))
def t03(spark, sf_dir):
    return _standing(spark, sf_dir, "audit_log", jobs.error_rates(F.col("operation_result") == "failure", "5 minutes"))


@REG.query("t04_stream_sliding_rate", check_sql("audit_log", f"""
    SELECT time_bucket(INTERVAL '1' MINUTE, ts) - m * INTERVAL '1' MINUTE AS window_start, {_RATE} FROM audit_log, (SELECT unnest(generate_series(0, 4)) AS m) GROUP BY 1"""))
def t04(spark, sf_dir):
    return _standing(spark, sf_dir, "audit_log", jobs.error_rates(F.col("operation_result") == "failure", "5 minutes", "1 minute"))


_SESSIONS = """SELECT session_id, min(ts) AS started_at, max(ts) AS last_at, count(*) AS events, count(CASE WHEN operation_result = 'failure' THEN 1 END) AS failures FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS visit FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) <= INTERVAL '6' HOUR THEN 0 ELSE 1 END AS fresh FROM audit_log)) GROUP BY session_id, visit"""


@REG.query("t05_sessions", check_sql("audit_log", _SESSIONS))
def t05(spark, sf_dir):
    rows = view(spark, sf_dir, "audit_log")
    return sessions(rows, "session_id", "ts", 6 * 3600, {"failures": F.col("operation_result") == "failure"})


@REG.query("t05_stream_sessions", check_sql("audit_log", _SESSIONS))
def t05_stream(spark, sf_dir):
    return _standing(spark, sf_dir, "audit_log", jobs.sessions("session_id", 6 * 3600, {"failures": F.col("operation_result") == "failure"}))


_ORDERED = check_sql("audit_log", """
    SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS position, event_id, ts, event_type FROM audit_log""")


@REG.query("t05_session_events", _ORDERED)
def t05_events(spark, sf_dir):
    return ordered_events(view(spark, sf_dir, "audit_log"), "session_id", ["ts", "event_id"], ["event_type"])


@REG.query("t06_stream_admission", ADMISSION_SQL)
def t06(spark, sf_dir):
    replay = jobs.admission(scratch_dir(spark, "admission"), ["user_id"], "ts", ["event_id"], F.expr(LIMIT), 86400)
    return replay.run(_stream(spark, sf_dir, "request_log")).select("user_id", "event_id", "admitted")


@REG.query("t07_stream_breaker", BREAKER_SQL)
def t07(spark, sf_dir):
    replay = jobs.breakers(scratch_dir(spark, "breaker"), "name", "ts", ["event_id"], F.col("status") != "healthy", CONFIG)
    return replay.run(_stream(spark, sf_dir, "health_result")).select("name", "event_id", "allowed", "state")


@REG.query("t08_stream_alert_states", check_sql("audit_log", """
    SELECT round, name, severity, CASE WHEN firing THEN 'firing' ELSE 'resolved' END AS state FROM (
      SELECT *, coalesce(lag(firing) OVER (PARTITION BY name ORDER BY round), FALSE) AS before FROM grid) WHERE firing <> before""",
    """rounds AS (SELECT date_trunc('hour', ts) AS round, count(*) AS n, avg(CASE WHEN operation_result = 'failure' THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM audit_log GROUP BY 1),
    grid AS (SELECT round, 'error-share' AS name, 'critical' AS severity, rate > 0.3 AS firing FROM rounds UNION ALL
      SELECT round, 'busy', 'warning', n > 16 FROM rounds UNION ALL SELECT round, 'quiet', 'info', n < 9 FROM rounds)"""))
def t08(spark, sf_dir):
    rates = _standing(spark, sf_dir, "audit_log", jobs.error_rates(F.col("operation_result") == "failure", "1 hour"))
    grid = al.firing_grid(rates.select(F.col("window_start").alias("round"), F.col("requests").alias("n"), "rate"), ROUND_RULES, ["n", "rate"])
    return al.transitions(grid)


@REG.query("t09_stream_throttle", THROTTLE_SQL)
def t09(spark, sf_dir):
    replay = jobs.admission(scratch_dir(spark, "throttle"), ["event_type"], "ts", ["event_id"], 1, 3600)
    return replay.run(_stream(spark, sf_dir, "audit_log")).where("admitted").select("event_type", "event_id")


@REG.query("t10_stream_debounce", DEBOUNCE_SQL)
def t10(spark, sf_dir):
    changes = _stream(spark, sf_dir, "audit_log").withColumn("source", F.coalesce("user_id", F.lit("none")))
    replay = jobs.admission(scratch_dir(spark, "debounce"), ["source"], "ts", ["event_id"], 1, 7200)
    return replay.run(changes).where("admitted").select("source", "event_id")


@REG.query("t11_stream_running_metrics", check_sql("metric_point", """
    SELECT kind, key, count(*) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, arg_max(value, event_id) AS last FROM k GROUP BY 1, 2""", _KEYED))
def t11(spark, sf_dir):
    labels = F.create_map(F.lit("zone"), F.col("zone"), F.lit("service"), F.col("service"))
    points = mx.with_key(_stream(spark, sf_dir, "metric_point").withColumn("labels", labels))
    folder, job = scratch_dir(spark, "metrics"), jobs.running_metrics()
    jobs.keep_standing(points, folder, job).awaitTermination()
    return jobs.read_standing(spark, folder, job).withColumn("sum", F.round("sum", 4))


@REG.query("t12_stream_health_rounds", check_sql("health_result", f"SELECT round, {_HEALTH} FROM round_result GROUP BY 1", _ROUND))
def t12(spark, sf_dir):
    folder, job = scratch_dir(spark, "rounds"), jobs.latest_per_round("1 hour")
    jobs.keep_standing(_stream(spark, sf_dir, "health_result"), folder, job).awaitTermination()
    return jobs.round_summaries(spark, folder, job)
