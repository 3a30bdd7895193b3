"""Streams that answer while rows arrive (T06-T10): rows come out of order in several deliveries, and the stream is
stopped after each one and taken up again from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans.monitor_queries import ROUND_RULES
from tidewatch.plans.registry import Registry
from tidewatch.plans.sequential_queries import ADMISSION_SQL, BREAKER_SQL, CONFIG, DEBOUNCE_SQL, LIMIT, THROTTLE_SQL
from tidewatch.plans.views import apply_view, check_sql
from tidewatch.session import scratch_dir
from tidewatch.streaming import jobs, stateful

REG = Registry()

#: Deliveries of the events, and the longest time in seconds between an event and its arrival.
DELIVERIES, LATENESS = 3, 3600


def _delivered(spark: SparkSession, sf_dir: str, name: str, process: Callable[[DataFrame], None]) -> None:
    """Deliver the events in order of arrival, up to an hour after they happened, and process what is there each time."""
    events, landing = spark.read.parquet(f"{sf_dir}/events.parquet"), scratch_dir(spark, "landing")
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 7 * (LATENESS * 1_000_000 // 6)
    first, last = events.agg(F.min(arrival), F.max(arrival)).first()
    first, last = first or 0, last or 0
    edges = [first + (last + 1 - first) * i // DELIVERIES for i in range(DELIVERIES + 1)]
    for begin, end in zip(edges, edges[1:]):
        events.where((arrival >= begin) & (arrival < end)).write.mode("append").parquet(landing)
        process(apply_view(jobs.stream_table(spark, landing, events.schema), name))


def _live(answers: str, view: str) -> str:
    """Check SQL of the answers, and which of them the stream gives while it runs: those older than its lateness."""
    running = check_sql(view, f"SELECT event_id, ts <= (SELECT max(ts) FROM {view}) - {LATENESS} * INTERVAL '1' SECOND AS while_running FROM {view}")
    return f"SELECT * FROM ({answers}) JOIN ({running}) USING (event_id)"


def _answers(spark: SparkSession, sf_dir: str, name: str, replay: jobs.Replay, change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    _delivered(spark, sf_dir, name, lambda rows: replay.start(change(rows)).awaitTermination())
    replay.finish(spark)
    return replay.outcomes(spark, running="while_running")


@REG.query("t06_stream_live_admission", _live(ADMISSION_SQL, "request_log"))
def t06(spark, sf_dir):
    replay = jobs.admission(scratch_dir(spark, "admission"), ["user_id"], "ts", ["event_id"], F.expr(LIMIT), 86400, lateness=LATENESS)
    return _answers(spark, sf_dir, "request_log", replay).select("user_id", "event_id", "admitted", "while_running")


@REG.query("t07_stream_live_breaker", _live(BREAKER_SQL, "health_result"))
def t07(spark, sf_dir):
    replay = jobs.breakers(scratch_dir(spark, "breaker"), "name", "ts", ["event_id"], F.col("status") != "healthy", CONFIG, lateness=LATENESS)
    return _answers(spark, sf_dir, "health_result", replay).select("name", "event_id", "allowed", "state", "while_running")


_ROUNDS = f"""rounds AS (SELECT date_trunc('hour', ts) AS round, count(*) AS n, avg(CASE WHEN operation_result = 'failure' THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM audit_log GROUP BY 1),
    closed AS (SELECT * FROM rounds WHERE round + INTERVAL '1' HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM audit_log) - {LATENESS} * INTERVAL '1' SECOND),
    grid AS (SELECT round, 'error-share' AS name, 'critical' AS severity, rate > 0.3 AS firing FROM closed UNION ALL
      SELECT round, 'busy', 'warning', n > 16 FROM closed UNION ALL SELECT round, 'quiet', 'info', n < 9 FROM closed),
    changes AS (SELECT * FROM (SELECT *, coalesce(lag(firing) OVER (PARTITION BY name ORDER BY round), FALSE) AS before FROM grid) WHERE firing <> before)"""


@REG.query("t08_stream_live_alerts", check_sql("audit_log", """
    SELECT round, name, severity, CASE WHEN firing THEN 'firing' ELSE 'resolved' END AS state,
           CASE WHEN firing THEN round ELSE lag(round) OVER (PARTITION BY name ORDER BY round) END AS starts_at, CASE WHEN NOT firing THEN round END AS ends_at FROM changes""", _ROUNDS))
def t08(spark, sf_dir):
    session, folder = jobs.stream_session(spark), scratch_dir(spark, "alerts")

    def process(rows: DataFrame) -> None:
        failed = F.col("operation_result") == "failure"
        jobs.run_to_table(stateful.alert_states(rows, failed, ROUND_RULES, "1 hour", f"{LATENESS} seconds"), folder)

    _delivered(session, sf_dir, "audit_log", process)
    return spark.read.parquet(f"{folder}/table").select("round", "name", "severity", "state", "starts_at", "ends_at")


@REG.query("t09_stream_live_throttle", _live(THROTTLE_SQL, "audit_log"))
def t09(spark, sf_dir):
    replay = jobs.admission(scratch_dir(spark, "throttle"), ["event_type"], "ts", ["event_id"], 1, 3600, lateness=LATENESS)
    return _answers(spark, sf_dir, "audit_log", replay).where("admitted").select("event_type", "event_id", "while_running")


@REG.query("t10_stream_live_debounce", _live(DEBOUNCE_SQL, "audit_log"))
def t10(spark, sf_dir):
    replay = jobs.admission(scratch_dir(spark, "debounce"), ["source"], "ts", ["event_id"], 1, 7200, lateness=LATENESS)
    found = _answers(spark, sf_dir, "audit_log", replay, lambda rows: rows.withColumn("source", F.coalesce("user_id", F.lit("none"))))
    return found.where("admitted").select("source", "event_id", "while_running")
