"""Replays in batch (T06, T07, T09, T10), each checked against a row-by-row recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators.sequential import BreakerConfig, admit, replay_breakers
from tidewatch.plans.registry import Registry
from tidewatch.plans.views import check_sql, view

REG = Registry()


def admission_sql(numbered: str, keys: str, width: int) -> str:
    """Row-by-row admission: the list of passed times is carried from each row of a key to the next."""
    return f"""numbered AS ({numbered}), replay AS (
      SELECT k, rn, event_id, lim, TRUE AS admitted, [t] AS recent FROM numbered WHERE rn = 1
      UNION ALL SELECT k, rn, event_id, lim, len(kept) < lim, CASE WHEN len(kept) < lim THEN list_append(kept, t) ELSE kept END FROM (
        SELECT n.*, list_filter(r.recent, lambda x: x > n.t - {width * 1_000_000}) AS kept FROM replay r JOIN numbered n ON n.k = r.k AND n.rn = r.rn + 1))"""


def _recursive(views, body, ctes):
    return check_sql(views, body, ctes).replace("WITH ", "WITH RECURSIVE ", 1)


LIMIT = "CASE role WHEN 'admin' THEN 5 WHEN 'service_broker' THEN 4 ELSE 3 END"
ADMISSION_SQL = _recursive("request_log", "SELECT k AS user_id, event_id, admitted FROM replay", admission_sql(
    f"SELECT user_id AS k, event_id, epoch_us(ts) AS t, {LIMIT} AS lim, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM request_log", "user_id", 86400))


@REG.query("t06_admission", ADMISSION_SQL)
def t06(spark, sf_dir):
    requests = view(spark, sf_dir, "request_log")
    return admit(requests, ["user_id"], "ts", ["event_id"], F.expr(LIMIT), 86400).select("user_id", "event_id", "admitted")


THROTTLE_SQL = _recursive("audit_log", "SELECT k AS event_type, event_id FROM replay WHERE admitted", admission_sql(
    "SELECT event_type AS k, event_id, epoch_us(ts) AS t, 1 AS lim, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM audit_log", "event_type", 3600))


@REG.query("t09_rule_throttle", THROTTLE_SQL)
def t09(spark, sf_dir):
    evaluations = view(spark, sf_dir, "audit_log")
    return admit(evaluations, ["event_type"], "ts", ["event_id"], 1, 3600).where("admitted").select("event_type", "event_id")


DEBOUNCE_SQL = _recursive("audit_log", "SELECT k AS source, event_id FROM replay WHERE admitted", admission_sql(
    "SELECT coalesce(user_id, 'none') AS k, event_id, epoch_us(ts) AS t, 1 AS lim, row_number() OVER (PARTITION BY coalesce(user_id, 'none') ORDER BY ts, event_id) AS rn FROM audit_log", "source", 7200))


@REG.query("t10_change_debounce", DEBOUNCE_SQL)
def t10(spark, sf_dir):
    changes = view(spark, sf_dir, "audit_log").withColumn("source", F.coalesce("user_id", F.lit("none")))
    return admit(changes, ["source"], "ts", ["event_id"], 1, 7200).where("admitted").select("source", "event_id")


CONFIG = BreakerConfig(failure_threshold=2, recovery_seconds=3600.0, success_threshold=2)
BREAKER_SQL = _recursive("health_result", "SELECT k AS name, event_id, allowed, state FROM replay", """
    numbered AS (SELECT name AS k, event_id, epoch_us(ts) AS t, status <> 'healthy' AS bad, row_number() OVER (PARTITION BY name ORDER BY ts, event_id) AS rn FROM health_result),
    replay AS (
      SELECT k, rn, event_id, TRUE AS allowed, 'closed' AS state, CAST(bad AS INTEGER) AS failures, 0 AS successes, CASE WHEN bad THEN t END AS last FROM numbered WHERE rn = 1
      UNION ALL SELECT k, rn, event_id, gate <> 'open',
        CASE WHEN gate = 'open' THEN 'open' WHEN bad THEN CASE WHEN gate = 'half_open' OR failures + 1 >= 2 THEN 'open' ELSE gate END
             WHEN gate = 'half_open' AND tried + 1 >= 2 THEN 'closed' ELSE gate END,
        CASE WHEN gate = 'open' THEN failures WHEN bad THEN failures + 1 WHEN gate = 'closed' THEN 0 WHEN tried + 1 >= 2 THEN 0 ELSE failures END,
        CASE WHEN gate = 'half_open' AND NOT bad THEN tried + 1 ELSE tried END, CASE WHEN gate <> 'open' AND bad THEN t ELSE last END FROM (
        SELECT n.k, n.rn, n.event_id, n.t, n.bad, r.failures, r.last, CASE WHEN r.state = 'open' AND n.t - r.last >= 3600000000 THEN 'half_open' ELSE r.state END AS gate,
               CASE WHEN r.state = 'open' AND n.t - r.last >= 3600000000 THEN 0 ELSE r.successes END AS tried
        FROM replay r JOIN numbered n ON n.k = r.k AND n.rn = r.rn + 1))""")


@REG.query("t07_breaker_replay", BREAKER_SQL)
def t07(spark, sf_dir):
    calls = view(spark, sf_dir, "health_result")
    return replay_breakers(calls, ["name"], "ts", ["event_id"], F.col("status") != "healthy", CONFIG).select("name", "event_id", "allowed", "state")
