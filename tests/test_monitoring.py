"""Metrics, health and alerts on small hand-made rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewatch.operators import alerts as al
from tidewatch.operators import health as hl
from tidewatch.operators import metrics as mx
from tidewatch.streaming import jobs, stateful

START = datetime(2024, 1, 1)
POINTS = "event_id LONG, ts TIMESTAMP_NTZ, kind STRING, name STRING, labels MAP<STRING, STRING>, value DOUBLE"


def points(spark, *data):
    return mx.with_key(spark.createDataFrame([(i, START + timedelta(seconds=i), *d) for i, d in enumerate(data)], POINTS))


@pytest.fixture(scope="module")
def metrics(spark):
    return points(spark,
                  ("counter", "errors_total", None, 4.0), ("counter", "errors_total", None, 6.0), ("counter", "requests_total", {}, 100.0),
                  ("counter", "labeled_counter", {"service": "api"}, 1.0), ("counter", "labeled_counter", {"zone": "b", "service": "api"}, 2.0),
                  ("gauge", "temperature", None, 20.0), ("gauge", "temperature", None, 18.5),
                  ("histogram", "latency", None, 1.0), ("histogram", "latency", None, 2.0), ("histogram", "latency", None, 3.0))


def test_keys_and_counters(metrics):
    assert rows(mx.counters(metrics)) == [("errors_total", 10.0), ("labeled_counter{service=api,zone=b}", 2.0),
                                          ("labeled_counter{service=api}", 1.0), ("requests_total", 100.0)]
    name, labels = mx.split_key(F.col("key"))
    assert rows(metrics.where("event_id IN (3, 5)").select("event_id", name, labels)) == [(3, "labeled_counter", "service=api"), (5, "temperature", "")]
    assert rows(mx.gauges(metrics)) == [("temperature", 18.5)]


def test_histogram(metrics):
    latency = metrics.where("kind = 'histogram'")
    assert rows(mx.summary(latency, ["key"])) == [("latency", 3, 6.0, 1.0, 3.0, 2.0)]
    assert rows(mx.summary(latency.where("value > 9"), [])) == [(0, 0.0, 0.0, 0.0, 0.0)]
    assert rows(mx.buckets(latency, ["key"], (1, 2.5))) == [("latency", 1.0, 1), ("latency", 2.5, 2)]
    got = mx.recent_percentiles(latency, ["key"], [F.desc("ts"), F.desc("event_id")], ["event_id"]).first()
    assert (got["p50"], got["p95"], got["p99"]) == (2.0, 3.0, 3.0)


def test_percentiles_use_the_last_values_only(spark):
    data = points(spark, *[("histogram", "h", None, float(v)) for v in [1000.0] * 5 + list(range(10))])
    got = mx.recent_percentiles(data, ["key"], [F.desc("ts"), F.desc("event_id")], ["event_id"], last=10).first()
    assert (got["p50"], got["p95"], got["p99"]) == (5.0, 9.0, 9.0)


def test_snapshot(metrics):
    got = {(r["kind"], r["key"], r["stat"]): r["value"] for r in mx.snapshot(mx.series(metrics)).collect()}
    assert got[("counter", "errors_total", "value")] == 10.0 and got[("gauge", "temperature", "value")] == 18.5
    assert [got[("histogram", "latency", s)] for s in ("count", "sum", "min", "max", "mean")] == [3.0, 6.0, 1.0, 3.0, 2.0]
    assert len(got) == 10


def test_exposition_text(metrics, tmp_path, spark):
    lines = mx.exposition(mx.series(metrics, bounds=(2,)), {"latency": "Time taken"}, (2,))
    text = [r["line"] for r in lines.orderBy("block", "name", "place").collect()]
    assert text == [
        "# HELP latency Time taken",
        "# TYPE errors_total counter", "errors_total 10.0",
        "# TYPE labeled_counter counter", 'labeled_counter{service="api"} 1.0', 'labeled_counter{service="api",zone="b"} 2.0',
        "# TYPE requests_total counter", "requests_total 100.0",
        "# TYPE temperature gauge", "temperature 18.5",
        "# TYPE latency histogram", "latency_count 3", "latency_sum 6.0", 'latency_bucket{le="2.0"} 2', 'latency_bucket{le="+Inf"} 3']
    from tidewatch.sources.writers import write_lines
    write_lines(lines, str(tmp_path / "text"), ["block", "name", "place"])
    assert spark.read.text(str(tmp_path / "text")).count() == len(text)


RESULTS = [("db", 0, "healthy"), ("disk", 1, "unhealthy"), ("db", 2, "degraded"), ("disk", 3, "healthy"), ("mem", 4, "unknown")]


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame([(i, START + timedelta(seconds=t), n, s) for i, (n, t, s) in enumerate(RESULTS)],
                                 "event_id LONG, ts TIMESTAMP_NTZ, name STRING, status STRING")


def test_health(spark, results):
    last = hl.last_results(results)
    assert rows(last, "name", "status") == [("db", "degraded"), ("disk", "healthy"), ("mem", "unknown")]
    one = hl.summary(last).first()
    assert (one["overall_status"], one["degraded_count"], one["unknown_count"], one["total_checks"]) == ("degraded", 1, 1, 3)
    assert hl.summary(last.where("name = 'none'")).first()["overall_status"] == "unknown"
    assert hl.summary(last.where("name = 'disk'")).first()["overall_status"] == "healthy"
    checks = spark.createDataFrame([("db",), ("net",)], "name STRING")
    assert rows(hl.registered_checks(checks, results), "name", "status") == [("db", "degraded"), ("net", None)]
    assert rows(hl.check_history(results, 1), "name", "event_id", "rn") == [("db", 2, 1), ("disk", 3, 1), ("mem", 4, 1)]


def test_probe_limits(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.85, 1.0), (0.95, 1.0), (0.1, 9.0)], "v DOUBLE, took DOUBLE")
    got = df.select(hl.probe_status(F.col("v"), F.lit(0.8), F.lit(0.9), F.col("took"), F.lit(5.0)).alias("s")).collect()
    assert [r["s"] for r in got] == ["healthy", "degraded", "unhealthy", "unhealthy"]


def test_rules(metrics, results):
    values, last = al.metric_values(mx.series(metrics)), hl.last_results(results)
    rules = al.RuleSet()
    rules.add_thresholds(al.ThresholdRule("hot", "critical", "temperature", 18.0), al.ThresholdRule("cold", "info", "temperature", 18.0, "less_than"),
                         al.ThresholdRule("three", "warning", "latency", 3.0, "equals"), al.ThresholdRule("odd", "info", "latency", 0.0, "near"))
    rules.add_health(al.HealthRule("checks", "warning", "degraded", ("db", "disk")), al.HealthRule("system", "critical", "degraded"), al.HealthRule("bad", "critical", "unhealthy"))
    rules.add_error_rates(al.ErrorRateRule("rate", "critical", 0.05), al.ErrorRateRule("high-rate", "critical", 0.5))
    alerts = rules.evaluate(values, last, hl.summary(last))
    got = {r["name"]: r for r in alerts.collect()}
    assert set(got) == {"hot", "three", "checks", "system", "rate"}
    assert got["hot"]["message"] == "Metric temperature is 18.5 (threshold: 18.0)"
    assert got["checks"]["message"] == "Health checks failing: db" and got["checks"]["annotations"]["failing_checks"] == "db"
    assert got["system"]["message"] == "System health is degraded" and got["system"]["annotations"]["total_checks"] == "3"
    assert got["rate"]["message"] == "High error rate: 10.00% (threshold: 5.00%)"
    assert rows(al.alert_summary(alerts)) == [("active", 5), ("critical", 3), ("info", 0), ("warning", 2)]
    status = al.overall_status(hl.summary(last.where("name = 'disk'")), alerts).first()
    assert (status["status"], status["active"], status["critical"]) == ("unhealthy", 5, 3)
    calm = al.overall_status(hl.summary(last.where("name = 'disk'")), alerts.where("false")).first()
    assert (calm["status"], calm["active"]) == ("healthy", 0)
    assert al.route(alerts.where("name = 'hot'")).first()["line"].startswith("ALERT [CRITICAL] hot: Metric")


def test_no_requests_gives_no_rate(spark):
    values = al.metric_values(mx.series(points(spark, ("counter", "errors_total", None, 3.0))))
    assert al.error_rate(values, "errors_total", "requests_total").count() == 0


GRID = [("r", i, f) for i, f in enumerate([False, True, True, False, True])] + [("s", i, f) for i, f in enumerate([True, False, False, True, False])]


def grid(spark):
    return spark.createDataFrame([(START + timedelta(hours=i), n, "critical", f) for n, i, f in GRID], "round TIMESTAMP_NTZ, name STRING, severity STRING, firing BOOLEAN")


def test_transitions_and_episodes(spark):
    hour = {START + timedelta(hours=i): i for i in range(6)}
    got = sorted((r["name"], hour[r["round"]], r["state"]) for r in al.transitions(grid(spark)).collect())
    assert got == [("r", 1, "firing"), ("r", 3, "resolved"), ("r", 4, "firing"), ("s", 0, "firing"), ("s", 1, "resolved"), ("s", 3, "firing"), ("s", 4, "resolved")]
    found = sorted((r["name"], hour[r["starts_at"]], hour.get(r["ends_at"]), r["rounds"]) for r in al.episodes(grid(spark)).collect())
    assert found == [("r", 1, 3, 2), ("r", 4, None, 1), ("s", 0, 1, 1), ("s", 3, 4, 1)]


def test_alert_stream_equals_transitions(spark, tmp_path):
    session = jobs.stream_session(spark)
    path = str(tmp_path / "grid")
    for at in range(5):
        one = grid(spark).where(F.col("round") == F.lit(START + timedelta(hours=at)).cast("timestamp_ntz")).withColumn("round", F.col("round").cast("timestamp"))
        one.coalesce(1).write.mode("append").parquet(path)
    stream = session.readStream.schema("round TIMESTAMP, name STRING, severity STRING, firing BOOLEAN").option("maxFilesPerTrigger", 1).parquet(path)
    table = jobs.run_to_table(stateful.alert_stream(stream), str(tmp_path / "out"))
    got = spark.read.parquet(table)
    assert rows(got, "round", "name", "state") == rows(al.transitions(grid(spark)), "round", "name", "state")
    closed = {(r["name"], r["ends_at"]): r["starts_at"] for r in got.where("state = 'resolved'").collect()}
    assert closed[("r", START + timedelta(hours=3))] == START + timedelta(hours=1)


def test_alert_states_survive_a_restart(spark, tmp_path):
    session, path, out = jobs.stream_session(spark), str(tmp_path / "events"), str(tmp_path / "out")
    failing = {1: 1, 2: 1, 4: 1}  # hours in which the only event failed
    for part in ([0, 1], [2, 3], [4, 5], [7]):  # the stream ends and starts again between two parts, within an episode too
        rows_of = [(START + timedelta(hours=h, minutes=5), h in failing) for h in part]
        spark.createDataFrame(rows_of, "ts TIMESTAMP, failed BOOLEAN").coalesce(1).write.mode("append").parquet(path)
        stream = session.readStream.schema("ts TIMESTAMP, failed BOOLEAN").parquet(path)
        rules = [al.ThresholdRule("broken", "critical", "rate", 0.5)]
        jobs.run_to_table(stateful.alert_states(stream, F.col("failed"), rules, "1 hour", "10 minutes"), out)
    got = [(r["round"].hour - START.hour, r["state"], r["starts_at"].hour - START.hour) for r in spark.read.parquet(f"{out}/table").orderBy("round").collect()]
    assert got == [(1, "firing", 1), (3, "resolved", 1), (4, "firing", 4), (5, "resolved", 4)]
