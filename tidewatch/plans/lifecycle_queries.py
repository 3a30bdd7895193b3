"""Lifecycle, conflicts, streaks, task statistics and data quality."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.functions import policy as po
from tidewatch.operators import lifecycle as lc
from tidewatch.operators import logquery as lq
from tidewatch.operators import quality as ql
from tidewatch.operators.config import resolve
from tidewatch.operators.segments import last_streak, streak
from tidewatch.plans.registry import Registry
from tidewatch.plans.views import check_sql, view
from tidewatch.session import scratch_dir
from tidewatch.sources import writers

REG = Registry()
OP_TIE = ("seq", "part_id", "supplier_id", "price")
AS_OF = datetime(1998, 6, 1)
_AS_OF = "TIMESTAMP '1998-06-01 00:00:00'"


# --- retention ----------------------------------------------------------------------------------

@REG.query("r01_expired_topics", check_sql("topic", "SELECT name, retention_ms FROM topic WHERE NOT starts_with(name, '__') AND retention_ms < 24 * 3600000"))
def r01(spark, sf_dir):
    return lc.topic_candidates(view(spark, sf_dir, "topic"), "expired", 24).select("name", "retention_ms")


@REG.query("r02_test_topics", check_sql("topic", "SELECT name FROM topic WHERE starts_with(name, 'test-') OR starts_with(name, 'temp-')"))
def r02(spark, sf_dir):
    return lc.topic_candidates(view(spark, sf_dir, "topic"), "test").select("name")


@REG.query("r03_stale_failed_instances", check_sql("service_instance", f"""
    SELECT instance_id, updated_at FROM service_instance WHERE status = 'error' AND updated_at < {_AS_OF} - INTERVAL '24' HOUR"""))
def r03(spark, sf_dir):
    return lc.stale_failed(view(spark, sf_dir, "service_instance"), AS_OF, 24).select("instance_id", "updated_at")


@REG.query("r04_old_audit_rows", check_sql("audit_log", """
    SELECT event_id, ts FROM audit_log WHERE ts < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL '14' DAY"""))
def r04(spark, sf_dir):
    return lc.older_than(view(spark, sf_dir, "audit_log"), "ts", datetime(2024, 1, 30), 14).select("event_id", "ts")


@REG.query("r05_old_rollups", check_sql("audit_log", """
    SELECT date_trunc('day', ts) AS period_start, level AS value, count(*) AS n FROM audit_log
    WHERE date_trunc('day', ts) < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL '7' DAY GROUP BY 1, 2"""))
def r05(spark, sf_dir):
    rollup = lq.rollup(view(spark, sf_dir, "audit_log"), [], "1 day")
    return lc.older_than(rollup, "period_start", datetime(2024, 1, 30), 7).where("section = 'level'").select("period_start", "value", "n")


@REG.query("r06_aged_names", check_sql("audit_log", """
    SELECT concat('aged-topic-', CAST(epoch_us(ts) // 1000000 AS VARCHAR), '-', event_id) AS name FROM audit_log WHERE epoch_us(ts) // 1000000 < 1705000000"""))
def r06(spark, sf_dir):
    name = F.concat(F.lit("aged-topic-"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("string"), F.lit("-"), F.col("event_id").cast("string"))
    return lc.aged_names(view(spark, sf_dir, "audit_log").select(name.alias("name")), "aged-topic-", 1_705_000_000)


_KEY = "CAST(json_extract_string(details, '$.k') AS BIGINT)"


_PURGED = f"""
    SELECT a.event_id, {_KEY} AS topic_id, ts FROM audit_log a LEFT JOIN topic t ON t.topic_id = {_KEY}
    WHERE t.retention_ms IS NULL OR epoch_us(TIMESTAMP '2024-01-03 00:00:00') - epoch_us(ts) <= t.retention_ms * 1000"""


def _messages(spark, sf_dir):
    return view(spark, sf_dir, "audit_log").select("event_id", F.get_json_object("details", "$.k").cast("bigint").alias("topic_id"), "ts")


@REG.query("r07_purge", check_sql("audit_log, topic", _PURGED))
def r07(spark, sf_dir):
    return lc.purge(_messages(spark, sf_dir), view(spark, sf_dir, "topic"), "topic_id", "ts", datetime(2024, 1, 3))


@REG.query("r07_purge_table", check_sql("audit_log, topic", _PURGED))
def r07_table(spark, sf_dir):
    folder = scratch_dir(spark, "messages")
    writers.append_audit(_messages(spark, sf_dir), folder)
    lc.purge_table(spark, folder, view(spark, sf_dir, "topic"), "topic_id", "ts", datetime(2024, 1, 3), "event_date")
    return spark.read.parquet(folder).select("event_id", "topic_id", "ts")


@REG.query("r09_failed_instance_plan", check_sql("service_instance", """
    SELECT instance_id, runtime_provider, runtime_provider IN ('docker', 'kubernetes') AS release FROM service_instance WHERE status = 'error'"""))
def r09(spark, sf_dir):
    instances = view(spark, sf_dir, "service_instance")
    providers = instances.where("status <> 'error' AND runtime_provider <> 'terraform'").select("runtime_provider").distinct()
    return lc.failed_instance_plan(instances, providers).select("instance_id", "runtime_provider", "release")


_A25 = """SELECT count(*) AS topics_evaluated, count(CASE WHEN hit THEN 1 END) AS topics_identified, {cleaned} AS topics_cleaned, {failed} AS topics_failed,
    {dry} AS dry_run FROM (SELECT starts_with(name, 'test-') OR starts_with(name, 'temp-') AS hit, topic_id IN
    (SELECT topic_id FROM partition_detail WHERE leader = -1 AND isr_count = 0) AS bad FROM topic WHERE NOT starts_with(name, '__'))"""


def _report(spark, sf_dir, dry):
    topics = view(spark, sf_dir, "topic")
    lost = view(spark, sf_dir, "partition_detail").where("leader = -1 AND isr_count = 0").select("topic_id").distinct()
    return lc.topic_report(topics, "test", 24, topics.join(lost, "topic_id", "left_semi"), dry, ["cluster_id", "name"])


@REG.query("a25_cleanup_report", check_sql("topic, partition_detail", _A25.format(
    cleaned="count(CASE WHEN hit AND NOT bad THEN 1 END)", failed="count(CASE WHEN hit AND bad THEN 1 END)", dry="FALSE")))
def a25(spark, sf_dir):
    return _report(spark, sf_dir, False)


@REG.query("a25_cleanup_report_dry_run", check_sql("topic, partition_detail", _A25.format(cleaned="CAST(0 AS BIGINT)", failed="CAST(0 AS BIGINT)", dry="TRUE")))
def a25_dry(spark, sf_dir):
    return _report(spark, sf_dir, True)


# --- runs and tasks -----------------------------------------------------------------------------

_TIE = "started_at, order_id, line_id, part_id, price"


def _active(kind, rivals):
    return f"""CASE WHEN r.run_type IN ({rivals}) AND EXISTS (SELECT 1 FROM cleanup_run e WHERE e.cluster_id = r.cluster_id AND e.run_type = '{kind}'
      AND (e.started_at, e.order_id, e.line_id, e.part_id, e.price) < (r.started_at, r.order_id, r.line_id, r.part_id, r.price) AND e.ended_at > r.started_at) THEN '{kind}' END"""


@REG.query("j07_cleanup_conflicts", check_sql("cleanup_run", f"""
    SELECT r.order_id, r.line_id, r.part_id, r.run_type, concat_ws(',', {_active('topic_cleanup', "'topic_cleanup', 'cluster_cleanup'")},
      {_active('cluster_cleanup', "'topic_cleanup', 'cluster_cleanup'")}, {_active('metadata_cleanup', "'metadata_cleanup', 'cluster_cleanup'")}) AS conflicts_with
    FROM cleanup_run r"""))
def j07(spark, sf_dir):
    rows = lc.conflicts(view(spark, sf_dir, "cleanup_run"), ["order_id", "line_id", "part_id", "price"])
    return rows.select("order_id", "line_id", "part_id", "run_type", "conflicts_with")


_STREAK = """numbered AS (SELECT *, sum(CASE WHEN state <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY supplier_id
      ORDER BY started_at, seq, part_id, instance_id, price ROWS UNBOUNDED PRECEDING) AS island FROM operation),
    streaks AS (SELECT *, CAST(sum(CASE WHEN state = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY supplier_id, island
      ORDER BY started_at, seq, part_id, instance_id, price ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM numbered)"""
_RUN_ORDER = ["started_at", "seq", "part_id", "instance_id", "price"]


def _streaks(spark, sf_dir):
    return streak(view(spark, sf_dir, "operation"), ["supplier_id"], _RUN_ORDER, F.col("state") == "failed")


@REG.query("w03_failure_streak", check_sql("operation", "SELECT supplier_id, instance_id, seq, part_id, streak, streak >= 2 AS blocked FROM streaks", _STREAK))
def w03(spark, sf_dir):
    return _streaks(spark, sf_dir).select("supplier_id", "instance_id", "seq", "part_id", "streak", (F.col("streak") >= 2).alias("blocked"))


@REG.query("w04_run_totals", check_sql("operation", "SELECT supplier_id, count(*) AS run_count, max(started_at) AS last_run FROM operation GROUP BY 1"))
def w04(spark, sf_dir):
    return lc.run_totals(view(spark, sf_dir, "operation"), ["supplier_id"], "started_at")


_TASKS = _STREAK + """, last_streak AS (SELECT supplier_id, state, streak FROM streaks QUALIFY row_number() OVER (PARTITION BY supplier_id
      ORDER BY started_at DESC, seq DESC, part_id DESC, instance_id DESC, price DESC) = 1),
    task AS (SELECT CAST(s_suppkey AS BIGINT) AS task_id, s_nationkey % 4 <> 0 AS enabled, s_nationkey % 7 = 1 AS running, coalesce(streak, 0) AS failure_count, 2 AS max_failures,
      CASE s_suppkey % 5 WHEN 0 THEN '0 * * * *' WHEN 1 THEN '0 0 * * *' WHEN 2 THEN '*/15 * * * *' WHEN 3 THEN '*/5 * * * *' ELSE '0 2 * * *' END AS schedule,
      TIMESTAMP '1998-05-31 23:00:00' + s_nationkey * INTERVAL '3' MINUTE + INTERVAL '30' SECOND AS last_end
      FROM supplier LEFT JOIN last_streak ON supplier_id = s_suppkey)"""


def _tasks(spark, sf_dir):
    ends = last_streak(view(spark, sf_dir, "operation"), ["supplier_id"], _RUN_ORDER, F.col("state") == "failed")
    tasks = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(
        "s_suppkey AS task_id", "s_nationkey % 4 <> 0 AS enabled", "s_nationkey % 7 = 1 AS running", "2 AS max_failures",
        """CASE s_suppkey % 5 WHEN 0 THEN '0 * * * *' WHEN 1 THEN '0 0 * * *' WHEN 2 THEN '*/15 * * * *' WHEN 3 THEN '*/5 * * * *' ELSE '0 2 * * *' END AS schedule""",
        "TIMESTAMP_NTZ '1998-05-31 23:00:00' + s_nationkey * INTERVAL '3' MINUTE + INTERVAL '30' SECOND AS last_end")
    joined = tasks.join(ends.withColumnRenamed("supplier_id", "task_id"), "task_id", "left")
    return (joined.withColumn("failure_count", F.coalesce("streak", F.lit(0)))
            .withColumn("next_run", po.next_run(F.col("schedule"), F.col("last_end"))).drop("streak"))


_NEXT = """CASE schedule WHEN '0 * * * *' THEN date_trunc('hour', last_end) + INTERVAL '1' HOUR WHEN '0 0 * * *' THEN date_trunc('day', last_end) + INTERVAL '1' DAY
    WHEN '*/15 * * * *' THEN time_bucket(INTERVAL '15' MINUTE, last_end) + INTERVAL '15' MINUTE
    WHEN '*/5 * * * *' THEN time_bucket(INTERVAL '5' MINUTE, last_end) + INTERVAL '5' MINUTE ELSE last_end + INTERVAL '1' HOUR END"""


@REG.query("a20_task_statistics", check_sql("operation", """
    SELECT count(*) AS total_tasks, count(CASE WHEN enabled THEN 1 END) AS enabled_tasks, count(CASE WHEN running THEN 1 END) AS running_tasks,
           count(CASE WHEN failure_count >= max_failures THEN 1 END) AS failed_tasks FROM task""", _TASKS))
def a20(spark, sf_dir):
    return lc.task_statistics(_tasks(spark, sf_dir))


@REG.query("r08_due_tasks", check_sql("operation", f"""
    SELECT task_id, {_NEXT} AS next_run, failure_count FROM task WHERE enabled AND {_NEXT} <= {_AS_OF} AND failure_count < max_failures AND NOT running""", _TASKS))
def r08(spark, sf_dir):
    tasks = _tasks(spark, sf_dir)
    return lc.due(tasks, AS_OF).select("task_id", "next_run", "failure_count")


@REG.query("a21_cleanup_statistics", check_sql("cleanup_run", """
    SELECT 'total' AS metric, count(*) AS n FROM cleanup_run UNION ALL SELECT 'completed', count(*) FROM cleanup_run WHERE status = 'completed'
    UNION ALL SELECT 'failed', count(*) FROM cleanup_run WHERE status = 'failed'
    UNION ALL SELECT concat('type:', split_part(task_id, '_', 2)), count(*) FROM cleanup_run GROUP BY 1"""))
def a21(spark, sf_dir):
    return lc.cleanup_statistics(view(spark, sf_dir, "cleanup_run"))


# --- data quality -------------------------------------------------------------------------------

def _rules_sql(source, keys, rules):
    return " UNION ALL ".join(f"SELECT {keys}, '{rule}' AS rule_id FROM {source} WHERE {broken}" for rule, broken in rules.items())


@REG.query("v01_topic_config", check_sql("topic", _rules_sql("t", "topic_id", {
    "name_characters": "contains(name, ' ') OR contains(name, '/')", "name_reserved": "starts_with(name, '__')",
    "max_message_bytes_range": "max_message_bytes < 1 OR max_message_bytes > 104857600",
    "retention_infinite": "retention_ms = -1", "retention_range": "retention_ms < 1 AND retention_ms <> -1",
    "insync_over_replication": "min_insync_replicas > replication_factor", "compression_type_domain": "compression_type NOT IN ('none', 'gzip', 'snappy', 'lz4', 'zstd')"}),
    """t AS (SELECT * EXCLUDE (name, retention_ms), CASE topic_id % 23 WHEN 4 THEN concat(name, ' x') WHEN 5 THEN concat('a/', name) ELSE name END AS name,
    CASE WHEN topic_id % 31 = 0 THEN -1 WHEN topic_id % 37 = 1 THEN 0 ELSE retention_ms END AS retention_ms FROM topic)"""))
def v01(spark, sf_dir):
    topics = view(spark, sf_dir, "topic")
    name = (F.when(F.col("topic_id") % 23 == 4, F.concat("name", F.lit(" x"))).when(F.col("topic_id") % 23 == 5, F.concat(F.lit("a/"), "name")).otherwise(F.col("name")))
    retention = F.when(F.col("topic_id") % 31 == 0, -1).when(F.col("topic_id") % 37 == 1, 0).otherwise(F.col("retention_ms"))
    return ql.violations(topics.withColumns({"name": name, "retention_ms": retention}), ["topic_id"], ql.topic_rules()).select("topic_id", "rule_id")


@REG.query("v02_topic_health", check_sql("topic, partition_detail", """
    SELECT name, rule_id, count(*) AS n FROM (
      SELECT name, 'no_leader' AS rule_id FROM partition_detail p JOIN topic t ON t.topic_id = p.topic_id WHERE leader = -1
      UNION ALL SELECT name, 'under_replicated' FROM partition_detail p JOIN topic t ON t.topic_id = p.topic_id WHERE isr_count < replication_factor
      UNION ALL SELECT name, 'low_replication' FROM topic WHERE replication_factor < 2 UNION ALL SELECT name, 'single_partition' FROM topic WHERE partitions = 1
      UNION ALL SELECT name, 'short_retention' FROM topic WHERE retention_ms / 3600000.0 < 1 UNION ALL SELECT name, 'long_retention' FROM topic WHERE retention_ms / 3600000.0 > 8760) GROUP BY 1, 2"""))
def v02(spark, sf_dir):
    return ql.topic_health(view(spark, sf_dir, "topic"), view(spark, sf_dir, "partition_detail")).groupBy("name", "rule_id").agg(F.count("*").alias("n"))


@REG.query("v03_provision_parameters", _rules_sql("orders", "o_orderkey AS instance_id", {
    "cluster_size": "o_orderkey % 13 < 1 OR o_orderkey % 13 > 10", "replication_factor": "o_orderkey % 7 = 0", "retention_hours": "o_orderkey % 9 = 4"}))
def v03(spark, sf_dir):
    text = F.expr("""concat('{"cluster_size": ', o_orderkey % 13, ', "replication_factor": ', CASE WHEN o_orderkey % 7 = 0 THEN '"three"' ELSE '3' END,
        CASE WHEN o_orderkey % 9 = 4 THEN ', "retention_hours": 0.5' WHEN o_orderkey % 9 = 5 THEN '' ELSE ', "retention_hours": 24' END, '}')""")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("instance_id"), F.parse_json(text).alias("parameters"))
    return ql.violations(rows, ["instance_id"], ql.parameter_rules("parameters")).select("instance_id", "rule_id")


@REG.query("v04_cluster_config", _rules_sql("customer", "c_custkey AS cluster_id", {
    "cluster_size_range": "c_custkey % 13 < 1 OR c_custkey % 13 > 10", "replication_factor_range": "c_nationkey % 12 < 1 OR c_nationkey % 12 > 10",
    "partition_count_range": "c_custkey < 1 OR c_custkey > 1000", "retention_hours_range": "c_custkey * 10 < 1 OR c_custkey * 10 > 8760",
    "storage_size_gb_range": "c_nationkey * 45 < 1 OR c_nationkey * 45 > 1000", "replication_over_size": "c_nationkey % 12 > c_custkey % 13",
    "sasl_mechanism_domain": "c_mktsegment NOT IN ('BUILDING')"}))
def v04(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "c_custkey AS cluster_id", "c_custkey % 13 AS cluster_size", "c_nationkey % 12 AS replication_factor", "c_custkey AS partition_count",
        "c_custkey * 10 AS retention_hours", "c_nationkey * 45 AS storage_size_gb", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'PLAIN' ELSE c_mktsegment END AS sasl_mechanism")
    return ql.violations(rows, ["cluster_id"], ql.cluster_rules()).select("cluster_id", "rule_id")


@REG.query("v05_config_update", _rules_sql("part", "p_partkey AS topic_id", {
    "empty": "p_size % 5 = 0", "not_updatable": "p_size % 5 IN (1, 2)"}))
def v05(spark, sf_dir):
    text = "CASE p_size % 5 WHEN 0 THEN map() WHEN 1 THEN map('owner', 'x') WHEN 2 THEN map('retention.ms', '1', 'owner', 'x') ELSE map('retention.ms', '1') END"
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS topic_id", f"CAST({text} AS MAP<STRING, STRING>) AS configs")
    return ql.violations(rows, ["topic_id"], ql.update_rules("configs")).select("topic_id", "rule_id")


@REG.query("v06_required_fields", """
    SELECT event_id, CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN 'partitions' WHEN 'error' THEN 'name,partitions' WHEN 'signup' THEN 'name,partitions' ELSE 'name' END AS missing FROM events""")
def v06(spark, sf_dir):
    body = F.expr("""CASE event_type WHEN 'click' THEN '{"name": "t", "partitions": 3}' WHEN 'view' THEN '{"name": "t"}' WHEN 'error' THEN '{}'
        WHEN 'signup' THEN 'not json' ELSE '{"partitions": 1, "x": null}' END""")
    missing = ql.missing_fields(body, ["name", "partitions"])
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.array_join(missing, ",").alias("missing"))


_RESOLVED = """resolved AS (SELECT entity, key, value, source FROM config_entry QUALIFY row_number() OVER (PARTITION BY entity, key ORDER BY
    CASE source WHEN 'env' THEN 4 WHEN 'cli' THEN 3 WHEN 'file' THEN 2 ELSE 1 END DESC, version DESC, order_id DESC, line_id DESC, part_id DESC, price DESC) = 1)"""
NEWEST = ("version", "order_id", "line_id", "part_id", "price")
CONFIG_KEYS = ("database.type", "database.username", "database.password", "kafka.bootstrap_servers", "api.port", "providers.default_provider")


@REG.query("v07_cross_field_config", check_sql("config_entry", _rules_sql("wide", "entity", {
    "database_username": "type = 'postgresql' AND coalesce(username, '') = ''", "database_password": "type = 'postgresql' AND coalesce(password, '') = ''",
    "bootstrap_servers": "coalesce(servers, '') = ''", "api_port": "CAST(port AS INTEGER) < 1024", "default_provider": "provider NOT IN ('docker', 'kubernetes', 'terraform')"}),
    _RESOLVED + """, wide AS (SELECT entity, max(CASE WHEN key = 'database.type' THEN value END) AS type, max(CASE WHEN key = 'database.username' THEN value END) AS username,
      max(CASE WHEN key = 'database.password' THEN value END) AS password, max(CASE WHEN key = 'kafka.bootstrap_servers' THEN value END) AS servers,
      max(CASE WHEN key = 'api.port' THEN value END) AS port, max(CASE WHEN key = 'providers.default_provider' THEN value END) AS provider FROM resolved GROUP BY 1)"""))
def v07(spark, sf_dir):
    wide = ql.widen(resolve(view(spark, sf_dir, "config_entry"), newest=NEWEST), "entity", CONFIG_KEYS)
    return ql.violations(wide, ["entity"], ql.config_rules()).select("entity", "rule_id")


@REG.query("v08_domains", check_sql("service_instance", _rules_sql("s", "instance_id", {
    "status_domain": "status NOT IN ('pending', 'creating', 'running', 'stopping', 'stopped', 'error')",
    "runtime_provider_domain": "runtime_provider NOT IN ('docker', 'kubernetes', 'terraform')"}),
    "s AS (SELECT instance_id, CASE WHEN instance_id % 17 = 0 THEN 'lost' ELSE status END AS status, CASE WHEN instance_id % 19 = 0 THEN 'nomad' ELSE runtime_provider END AS runtime_provider FROM service_instance)"))
def v08(spark, sf_dir):
    rows = view(spark, sf_dir, "service_instance").select(
        "instance_id", F.when(F.col("instance_id") % 17 == 0, "lost").otherwise(F.col("status")).alias("status"),
        F.when(F.col("instance_id") % 19 == 0, "nomad").otherwise(F.col("runtime_provider")).alias("runtime_provider"))
    return ql.violations(rows, ["instance_id"], [ql.not_in("status", ql.CLUSTER_STATUSES), ql.not_in("runtime_provider", ql.RUNTIME_PROVIDERS)]).select("instance_id", "rule_id")


@REG.query("v08_operation_domains", check_sql("operation", _rules_sql("o", "instance_id, seq, price", {
    "state_domain": "state NOT IN ('in_progress', 'succeeded', 'failed')", "type_domain": "type NOT IN ('provision', 'deprovision', 'update', 'backup', 'restore')"}),
    "o AS (SELECT instance_id, seq, price, CASE WHEN instance_id % 13 = 0 THEN 'stuck' ELSE state END AS state, CASE WHEN instance_id % 11 = 0 THEN 'migrate' ELSE type END AS type FROM operation)"))
def v08_operations(spark, sf_dir):
    rows = view(spark, sf_dir, "operation").select("instance_id", "seq", "price", F.when(F.col("instance_id") % 13 == 0, "stuck").otherwise(F.col("state")).alias("state"),
                                                   F.when(F.col("instance_id") % 11 == 0, "migrate").otherwise(F.col("type")).alias("type"))
    return ql.violations(rows, ["instance_id", "seq", "price"], ql.domain_rules(state="instance_state", type="operation_type")).select("instance_id", "seq", "price", "rule_id")


@REG.query("v08_event_domains", check_sql("audit_log", _rules_sql("a", "event_id", {
    "event_type_domain": "event_id % 23 = 0", "severity_domain": "severity NOT IN ('critical', 'warning', 'info')", "state_domain": "event_id % 7 = 0"}),
    "a AS (SELECT event_id, lower(level) AS severity FROM audit_log)"))
def v08_events(spark, sf_dir):
    rows = view(spark, sf_dir, "audit_log").select(
        "event_id", F.when(F.col("event_id") % 23 == 0, "topic.rename").otherwise(F.col("event_type")).alias("event_type"), F.lower("level").alias("severity"),
        F.when(F.col("event_id") % 7 == 0, "in_progress").otherwise("in progress").alias("state"))
    return ql.violations(rows, ["event_id"], ql.domain_rules(event_type="event_type", severity="severity", state="operation_state")).select("event_id", "rule_id")


@REG.query("v09_cleanup_request", _rules_sql("part", "p_partkey AS request_id", {
    "max_age_hours": "p_size - 3 <= 0", "max_age_days": "p_size % 10 <= 0", "retention_pattern": "p_size % 4 = 3"}))
def v09(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS request_id", "p_size - 3 AS max_age_hours", "p_size % 10 AS max_age_days",
        "CASE p_size % 4 WHEN 0 THEN 'expired' WHEN 1 THEN 'test' WHEN 2 THEN 'all' ELSE 'old' END AS retention_pattern")
    return ql.violations(rows, ["request_id"], ql.cleanup_request_rules()).select("request_id", "rule_id")


@REG.query("v10_service_and_plan", check_sql("service_instance", _rules_sql("service_instance", "instance_id", {
    "service_id_domain": "instance_id % 6 = 0", "plan_id_domain": "instance_id % 8 = 0"})))
def v10(spark, sf_dir):
    rows = view(spark, sf_dir, "service_instance").select(
        "instance_id", F.when(F.col("instance_id") % 6 == 0, "other-service").otherwise(ql.SERVICE_IDS[0]).alias("service_id"),
        F.when(F.col("instance_id") % 8 == 0, "gold").otherwise(F.col("plan_id")).alias("plan_id"))
    return ql.violations(rows, ["instance_id"], [ql.not_in("service_id", ql.SERVICE_IDS), ql.not_in("plan_id", ql.PLAN_IDS)]).select("instance_id", "rule_id")
