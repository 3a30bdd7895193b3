"""Inventory, access, standing views, paging of records and load reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.operators import access as ac
from tidewatch.operators import inventory as inv
from tidewatch.operators import logquery as lq
from tidewatch.operators import quality as ql
from tidewatch.operators.quantiles import load_periods, load_report
from tidewatch.operators.ranking import latest
from tidewatch.operators.segments import trailing_count
from tidewatch.plans.registry import Registry
from tidewatch.plans.source_queries import topic_configs
from tidewatch.plans.views import check_sql, view
from tidewatch.session import materialize

REG = Registry()
AS_OF = datetime(2024, 1, 30, 12, 0, 0)
OP_ORDER = ("started_at", "seq", "part_id", "supplier_id", "price")


@REG.query("j01_audit_to_instance", check_sql("audit_log, service_instance", """
    SELECT a.event_id, a.event_type, s.plan_id, s.status FROM audit_log a LEFT JOIN service_instance s ON a.instance_id = s.instance_id"""))
def j01(spark, sf_dir):
    audit = view(spark, sf_dir, "audit_log").select("event_id", "event_type", "instance_id")
    return audit.join(view(spark, sf_dir, "service_instance"), "instance_id", "left").select("event_id", "event_type", "plan_id", "status")


@REG.query("j02_describe_topics", check_sql("topic, partition_detail", """
    SELECT t.name, t.retention_ms, t.cleanup_policy, count(*) AS partition_count, count(CASE WHEN leader = -1 THEN 1 END) AS leaderless,
           min(isr_count) AS min_isr FROM topic t JOIN partition_detail p ON t.topic_id = p.topic_id GROUP BY 1, 2, 3"""))
def j02(spark, sf_dir):
    topics = topic_configs(view(spark, sf_dir, "topic"))
    rows = inv.describe(topics, view(spark, sf_dir, "partition_detail"))
    return rows.select("name", F.col("configs")["retention.ms"].try_cast("bigint").alias("retention_ms"),
                       F.col("configs")["cleanup.policy"].alias("cleanup_policy"), "partition_count", "leaderless", "min_isr")


@REG.query("j03_availability_gate", check_sql("operation, service_instance", """
    SELECT o.instance_id, o.type, CASE WHEN s.status = 'running' THEN 'ok' ELSE 'CLUSTER_NOT_AVAILABLE' END AS gate, count(*) AS n
    FROM operation o LEFT JOIN (SELECT * FROM service_instance WHERE deleted_at IS NULL) s ON o.instance_id = s.instance_id GROUP BY 1, 2, 3"""))
def j03(spark, sf_dir):
    live = inv.active_instances(view(spark, sf_dir, "service_instance"))
    gated = inv.gate(view(spark, sf_dir, "operation").select("instance_id", "type"), live, "instance_id")
    return gated.groupBy("instance_id", "type", "gate").agg(F.count("*").alias("n"))


def _users(spark, sf_dir):
    roles = F.array_compact(F.array("role", "second_role"))
    return view(spark, sf_dir, "app_user").select("user_id", roles.alias("roles"), F.array_compact(F.array("direct_permission")).alias("direct"))


_GRANTS = "grants(role, permission) AS (VALUES " + ", ".join(
    f"('{role}', '{p}')" for role, names in ac.ROLE_PERMISSIONS.items() for p in names) + """),
    held AS (SELECT user_id, permission FROM app_user u JOIN grants g ON g.role = u.role
      UNION SELECT user_id, permission FROM app_user u JOIN grants g ON g.role = u.second_role
      UNION SELECT user_id, direct_permission FROM app_user WHERE direct_permission IS NOT NULL)"""


@REG.query("j04_effective_permissions", check_sql("app_user", "SELECT user_id, count(*) AS permissions, string_agg(permission, ',' ORDER BY permission) AS names FROM held GROUP BY 1", _GRANTS))
def j04(spark, sf_dir):
    held = ac.effective_permissions(F.col("roles"), F.col("direct"))
    return _users(spark, sf_dir).select("user_id", F.size(held).cast("bigint").alias("permissions"), F.array_join(F.sort_array(held), ",").alias("names"))


@REG.query("u01_permission_union", check_sql("app_user", "SELECT user_id, permission FROM held", _GRANTS))
def u01(spark, sf_dir):
    return ac.permission_rows(_users(spark, sf_dir), "user_id", "roles", "direct")


@REG.query("j05_authorisation", check_sql("app_user", """
    SELECT u.user_id, EXISTS (SELECT 1 FROM held h WHERE h.user_id = u.user_id AND permission = 'topic:purge') AS single,
           EXISTS (SELECT 1 FROM held h WHERE h.user_id = u.user_id AND permission IN ('admin:write', 'broker:bind')) AS any_of,
           (SELECT count(*) FROM held h WHERE h.user_id = u.user_id AND permission IN ('topic:read', 'topic:delete')) = 2 AS all_of,
           coalesce(u.role IN ('admin', 'operator'), FALSE) OR coalesce(u.second_role IN ('admin', 'operator'), FALSE) AS any_role
    FROM app_user u""", _GRANTS))
def j05(spark, sf_dir):
    held = _users(spark, sf_dir).withColumn("held", ac.effective_permissions(F.col("roles"), F.col("direct")))
    p, r = F.col("held"), F.col("roles")
    return held.select("user_id", ac.authorised(p, r, permission="topic:purge").alias("single"),
                       ac.authorised(p, r, any_permissions=["admin:write", "broker:bind"]).alias("any_of"),
                       ac.authorised(p, r, any_permissions=["topic:read", "topic:delete"], require_all=True).alias("all_of"),
                       ac.authorised(p, r, any_roles=["admin", "operator"]).alias("any_role"))


_STORES = """last_op AS (SELECT instance_id, state AS status FROM operation QUALIFY row_number() OVER (PARTITION BY instance_id
    ORDER BY started_at DESC, seq DESC, part_id DESC, supplier_id DESC, price DESC) = 1),
    first_store AS (SELECT instance_id, status FROM service_instance WHERE status = 'error')"""


def _stores(spark, sf_dir):
    first = view(spark, sf_dir, "service_instance").where("status = 'error'").select("instance_id", "status")
    second = latest(view(spark, sf_dir, "operation"), ["instance_id"], OP_ORDER, keep=["state"]).withColumnRenamed("state", "status")
    return first, second


@REG.query("j06_lookup_with_fallback", check_sql("audit_log, service_instance, operation", """
    SELECT a.event_id, CASE WHEN f.instance_id IS NOT NULL THEN f.status ELSE l.status END AS status,
           CASE WHEN f.instance_id IS NOT NULL THEN 'first' WHEN l.instance_id IS NOT NULL THEN 'second' ELSE 'missing' END AS found
    FROM audit_log a LEFT JOIN first_store f ON a.instance_id = f.instance_id LEFT JOIN last_op l ON a.instance_id = l.instance_id""", _STORES))
def j06(spark, sf_dir):
    requests = view(spark, sf_dir, "audit_log").select("event_id", "instance_id")
    return inv.lookup(requests, *_stores(spark, sf_dir), "instance_id", "status").select("event_id", "status", "found")


@REG.query("u03_union_first_wins", check_sql("service_instance, operation", """
    SELECT instance_id, status FROM first_store UNION ALL SELECT instance_id, status FROM last_op WHERE instance_id NOT IN (SELECT instance_id FROM first_store)""", _STORES))
def u03(spark, sf_dir):
    return inv.first_wins(*_stores(spark, sf_dir), "instance_id")


@REG.query("j08_idempotent_requests", check_sql("operation, service_instance", """
    SELECT o.instance_id, CASE WHEN o.type = 'provision' THEN CASE WHEN s.instance_id IS NULL THEN 'create' ELSE 'already_exists' END
           ELSE CASE WHEN s.instance_id IS NULL THEN 'already_gone' ELSE 'delete' END END AS outcome, count(*) AS n
    FROM operation o LEFT JOIN (SELECT instance_id FROM service_instance WHERE deleted_at IS NULL) s ON o.instance_id = s.instance_id
    WHERE o.type <> 'update' GROUP BY 1, 2"""))
def j08(spark, sf_dir):
    requests = view(spark, sf_dir, "operation").where("type <> 'update'").select(
        "instance_id", F.when(F.col("type") == "provision", "create").otherwise("delete").alias("op"))
    existing = inv.active_instances(view(spark, sf_dir, "service_instance"))
    return inv.idempotent(requests, existing, "instance_id").groupBy("instance_id", "outcome").agg(F.count("*").alias("n"))


@REG.query("j10_copy_configs", check_sql("topic", """
    SELECT s.name AS source, t.name AS target, (s.retention_ms IS NOT NULL)::INTEGER + 2 AS settings, s.compression_type AS compression
    FROM topic s JOIN topic t ON t.topic_id = s.topic_id + 3 WHERE s.topic_id % 10 <> 0"""))
def j10(spark, sf_dir):
    topics = topic_configs(view(spark, sf_dir, "topic"))
    after = topics.select((F.col("topic_id") - 3).alias("topic_id"), F.col("name").alias("target"))
    pairs = topics.select("topic_id", F.col("name").alias("source")).join(after, "topic_id").select(
        "source", F.when(F.col("topic_id") % 10 == 0, F.concat(F.lit("missing-"), F.col("target"))).otherwise(F.col("target")).alias("target"))
    copied = inv.copy_configs(pairs, topics, ["cleanup.policy"])
    return copied.select("source", "target", F.size("configs").alias("settings"), F.col("configs")["compression.type"].alias("compression"))


@REG.query("j14_orphans", check_sql("operation, service_instance", """
    SELECT o.instance_id, o.seq, o.type, o.price FROM operation o WHERE NOT EXISTS
    (SELECT 1 FROM service_instance s WHERE s.instance_id = o.instance_id AND s.deleted_at IS NULL)"""))
def j14(spark, sf_dir):
    return inv.orphans(view(spark, sf_dir, "operation"), view(spark, sf_dir, "service_instance"), "instance_id").select("instance_id", "seq", "type", "price")


# --- listings and standing views ----------------------------------------------------------------

@REG.query("f23_instance_listing", check_sql("service_instance", """
    SELECT instance_id, plan_id, created_at FROM service_instance WHERE status = 'error' AND runtime_provider = 'docker'"""))
def f23(spark, sf_dir):
    table = view(spark, sf_dir, "service_instance")
    return inv.select(table, table.columns, status="error", runtime_provider="docker", colour="ignored").select("instance_id", "plan_id", "created_at")


@REG.query("f24_audit_tail", check_sql("audit_log", """
    SELECT event_id, ts, event_type, resource_id FROM audit_log WHERE event_type = 'topic.create' AND resource_id = 'c2/topic2' ORDER BY ts DESC, event_id LIMIT 100"""))
def f24(spark, sf_dir):
    rows = inv.select(view(spark, sf_dir, "audit_log"), ["event_type", "resource_id"], event_type="topic.create", resource_id="c2/topic2")
    return lq.page(rows, [F.desc("ts"), F.asc("event_id")], 100, 0).select("event_id", "ts", "event_type", "resource_id")


@REG.query("f25_without_internal", check_sql("topic", "SELECT name, partitions FROM topic WHERE NOT starts_with(name, '__')"))
def f25(spark, sf_dir):
    return inv.user_topics(view(spark, sf_dir, "topic")).select("name", "partitions")


@REG.query("f26_topic_search", check_sql("topic", r"""
    SELECT 'text' AS mode, name FROM topic WHERE contains(lower(name), 'est-1') UNION ALL
    SELECT 'regex', name FROM topic WHERE regexp_matches(name, '^(test|temp)-\d{2}$')"""))
def f26(spark, sf_dir):
    topics = view(spark, sf_dir, "topic")
    found = inv.search_topics(topics, "EST-1").select(F.lit("text").alias("mode"), "name")
    return found.unionByName(inv.search_topics(topics, r"^(test|temp)-\d{2}$", regex=True).select(F.lit("regex").alias("mode"), "name"))


@REG.query("f27_active_instances", check_sql("service_instance", "SELECT instance_id, status, plan_id FROM service_instance WHERE deleted_at IS NULL"))
def f27(spark, sf_dir):
    return inv.active_instances(view(spark, sf_dir, "service_instance")).select("instance_id", "status", "plan_id")


@REG.query("f28_active_topics", check_sql("topic", "SELECT topic_id, name FROM topic WHERE NOT deleted AND state = 'active'"))
def f28(spark, sf_dir):
    return inv.active_topics(view(spark, sf_dir, "topic")).select("topic_id", "name")


@REG.query("f29_pending_operations", check_sql("operation", "SELECT instance_id, seq, type, price FROM operation WHERE state = 'in_progress'"))
def f29(spark, sf_dir):
    return inv.pending_operations(view(spark, sf_dir, "operation")).select("instance_id", "seq", "type", "price")


@REG.query("f30_recent_audit", check_sql("audit_log", """
    SELECT event_id, ts, event_type FROM audit_log WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL '24' HOUR ORDER BY ts DESC"""))
def f30(spark, sf_dir):
    return inv.recent_audit(view(spark, sf_dir, "audit_log"), AS_OF, tie=["event_id"]).select("event_id", "ts", "event_type")


@REG.query("f31_due_cleanup_jobs", check_sql("cleanup_run", """
    SELECT task_id, line_id, price, started_at AS scheduled_at FROM cleanup_run WHERE status = 'running' AND started_at <= TIMESTAMP '1998-06-01 00:00:00'"""))
def f31(spark, sf_dir):
    jobs = view(spark, sf_dir, "cleanup_run").select("task_id", "line_id", "price", F.col("started_at").alias("scheduled_at"),
                                                     F.when(F.col("status") == "running", "scheduled").otherwise(F.col("status")).alias("state"))
    return inv.due_jobs(jobs, datetime(1998, 6, 1), tie=["task_id", "line_id", "price"]).drop("state")


@REG.query("l04_executions_newest", check_sql("cleanup_run", """
    SELECT task_id, started_at, status FROM cleanup_run WHERE cluster_id = 'c5' ORDER BY started_at DESC, order_id, line_id, part_id, price LIMIT 50"""))
def l04(spark, sf_dir):
    rows = inv.select(view(spark, sf_dir, "cleanup_run"), ["cluster_id"], cluster_id="c5")
    key = ["order_id", "line_id", "part_id", "price"]
    return lq.page(rows, [F.desc("started_at"), *[F.asc(c) for c in key]], 50, 0).select("task_id", "started_at", "status")


@REG.query("l05_instances_newest", check_sql("service_instance", "SELECT instance_id, status, created_at FROM service_instance ORDER BY created_at DESC, instance_id"))
def l05(spark, sf_dir):
    return view(spark, sf_dir, "service_instance").orderBy(F.desc("created_at"), "instance_id").select("instance_id", "status", "created_at")


# --- counts and reports -------------------------------------------------------------------------

@REG.query("a22_bulk_outcome", check_sql("operation", """
    SELECT supplier_id, count(*) AS total, count(CASE WHEN state <> 'failed' THEN 1 END) AS successful, count(CASE WHEN state = 'failed' THEN 1 END) AS failed
    FROM operation GROUP BY 1"""))
def a22(spark, sf_dir):
    return inv.outcome_counts(view(spark, sf_dir, "operation"), ["supplier_id"], F.col("state") != "failed")


@REG.query("a22_bulk_names", check_sql("operation", """
    SELECT supplier_id, instance_id, CASE WHEN state <> 'failed' THEN 'successful' ELSE 'failed' END AS outcome FROM operation"""))
def a22_names(spark, sf_dir):
    return inv.outcome_names(view(spark, sf_dir, "operation"), ["supplier_id"], "instance_id", F.col("state") != "failed")


@REG.query("a23_cluster_totals", check_sql("topic, partition_detail", """
    SELECT t.cluster_id, count(CASE WHEN NOT starts_with(name, '__') THEN 1 END) AS topic_count,
           coalesce((SELECT count(DISTINCT leader) FROM partition_detail p JOIN topic u ON u.topic_id = p.topic_id
                     WHERE u.cluster_id = t.cluster_id AND leader >= 0), 0) AS broker_count FROM topic t GROUP BY 1"""))
def a23(spark, sf_dir):
    return inv.cluster_totals(view(spark, sf_dir, "partition_detail"), view(spark, sf_dir, "topic"))


@REG.query("a23_brokers_of_periods", check_sql("topic, partition_detail", """
    SELECT cluster_id, count(DISTINCT leader) AS broker_count FROM partition_detail p JOIN topic t ON t.topic_id = p.topic_id
    WHERE leader >= 0 AND pkey % 24 >= 6 GROUP BY 1"""))
def a23_periods(spark, sf_dir):
    """Reports arrive in 24 periods, each stored as bitmaps; the count is over the last 18."""
    found = inv.broker_periods(view(spark, sf_dir, "partition_detail"), view(spark, sf_dir, "topic"), F.col("pkey") % 24)
    return inv.brokers_of(materialize(found, "broker_periods").where("period >= 6"))


@REG.query("a24_topic_inventory", check_sql("partition_detail", """
    SELECT topic_id, count(*) AS partition_count, arg_min(replica_count, (partition_id, pkey, supplier_id, price)) AS replication
    FROM partition_detail GROUP BY 1"""))
def a24(spark, sf_dir):
    return inv.partition_totals(view(spark, sf_dir, "partition_detail"), order=("partition_id", "pkey", "supplier_id", "price"))


def _cut(values, i, m):
    j = f"greatest(1, least(CAST(floor({i} * (len({values}) + 1) / {m}.0) AS BIGINT), len({values}) - 1))"
    d = f"({i} * (len({values}) + 1) - {j} * {m})"
    return (f"CASE WHEN len({values}) IS NULL THEN 0.0 WHEN len({values}) = 1 THEN {values}[1] "
            f"ELSE ({values}[{j}] * ({m} - {d}) + {values}[{j} + 1] * {d}) / {m} END")


def _load_sql(source, key, ok, duration, start, quantiles):
    cuts = ", ".join(f"round({_cut('v', i, m)}, 6) AS {name}" for name, (i, m) in quantiles.items())
    return (f"SELECT {key}, operations, successes, round(successes / operations, 6) AS success_rate, round(mean, 6) AS mean, "
            f"round(successes / nullif(span_s, 0), 8) AS throughput, {cuts} FROM (SELECT {key}, count(*) AS operations, "
            f"count(CASE WHEN {ok} THEN 1 END) AS successes, coalesce(avg(CASE WHEN {ok} THEN {duration} END), 0) AS mean, "
            f"(epoch_us(max({start})) - epoch_us(min({start}))) / 1e6 AS span_s, "
            f"list_sort(list({duration}) FILTER (WHERE {ok})) AS v FROM {source} GROUP BY {key})")


def _load(rows):
    return rows.withColumns({"success_rate": F.round("success_rate", 6), "mean": F.round("mean", 6), "throughput": F.round("throughput", 8),
                             **{q: F.round(q, 6) for q in rows.columns if q.startswith("p9")}}).drop("span_s")


P95, P99 = {"p95": (19, 20)}, {"p95": (19, 20), "p99": (99, 100)}


@REG.query("a26_load_report", check_sql("operation", _load_sql("operation", "type", "state <> 'failed'", "duration_s", "started_at", P95)))
def a26(spark, sf_dir):
    rows = view(spark, sf_dir, "operation")
    return _load(load_report(rows, ["type"], F.col("state") != "failed", "duration_s", F.col("started_at"), F.col("started_at"), P95))


@REG.query("a26_load_report_periods", check_sql("operation", _load_sql("operation", "type", "state <> 'failed'", "duration_s", "started_at", P95)))
def a26_periods(spark, sf_dir):
    rows, good, at = view(spark, sf_dir, "operation"), F.col("state") != "failed", F.col("started_at")
    periods = materialize(load_periods(rows, ["type"], F.date_trunc("month", at), good, "duration_s", at, at), "load_periods")
    return _load(load_report(rows, ["type"], good, "duration_s", at, at, P95, periods))


@REG.query("a26_load_report_requests", check_sql("request_log", _load_sql("request_log", "role", "status_code < 400", "duration_ms", "ts", P95)))
def a26_requests(spark, sf_dir):
    rows = view(spark, sf_dir, "request_log")
    return _load(load_report(rows, ["role"], F.col("status_code") < 400, "duration_ms", F.col("ts"), F.col("ts"), P95))


@REG.query("a27_sustained_load", check_sql("request_log", _load_sql("daily", "day", "status_code < 400", "duration_ms", "ts", P99)
           .replace(") AS throughput", ") AS throughput, round(operations / nullif(span_s, 0) * 60, 6) AS per_minute"),
           "daily AS (SELECT *, date_trunc('day', ts) AS day FROM request_log)"))
def a27(spark, sf_dir):
    rows = view(spark, sf_dir, "request_log").withColumn("day", F.window("ts", "1 day").getField("start"))
    report = load_report(rows, ["day"], F.col("status_code") < 400, "duration_ms", F.col("ts"), F.col("ts"), P99)
    rate = F.round(F.col("operations") / F.nullif(F.col("span_s"), F.lit(0.0)) * 60, 6)
    return _load(report.withColumn("per_minute", rate))


@REG.query("a28_best_group", check_sql("service_instance", """
    SELECT arg_min(runtime_provider, (cost, runtime_provider)) AS fastest, arg_min(runtime_provider, (-gain, runtime_provider)) AS most_efficient FROM
    (SELECT runtime_provider, avg(total) AS cost, avg(CASE WHEN status = 'running' THEN 1.0::DOUBLE ELSE 0 END) AS gain FROM service_instance GROUP BY 1)"""))
def a28(spark, sf_dir):
    totals = view(spark, sf_dir, "service_instance").groupBy("runtime_provider").agg(
        F.avg("total").alias("cost"), F.avg((F.col("status") == "running").cast("double")).alias("gain"))
    return inv.best_and_worst(totals, "runtime_provider", "cost", "gain")


@REG.query("a29_latest_metrics", check_sql("metric_point", """
    SELECT service, ts, name, value FROM metric_point QUALIFY row_number() OVER (PARTITION BY service ORDER BY ts DESC, event_id DESC) = 1"""))
def a29(spark, sf_dir):
    return inv.latest_metrics(view(spark, sf_dir, "metric_point"), ["service"], "ts", ["event_id"], ["name", "value"])


@REG.query("w09_trailing_requests", check_sql("request_log", """
    SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '21600' SECOND PRECEDING AND CURRENT ROW) AS recent
    FROM request_log"""))
def w09(spark, sf_dir):
    return trailing_count(view(spark, sf_dir, "request_log"), ["user_id"], "ts", 21600).select("event_id", "user_id", "recent")


@REG.query("u04_not_updatable", check_sql("topic", """
    SELECT name, concat_ws(',', CASE WHEN topic_id % 2 = 0 THEN 'custom.owner' END, CASE WHEN topic_id % 3 = 0 THEN 'file.delete.delay.ms' END) AS keys FROM topic"""))
def u04(spark, sf_dir):
    wanted = F.map_filter(F.create_map(
        F.lit("retention.ms"), F.lit(True), F.lit("custom.owner"), F.col("topic_id") % 2 == 0,
        F.lit("file.delete.delay.ms"), F.col("topic_id") % 3 == 0), lambda k, v: v)
    return view(spark, sf_dir, "topic").select("name", F.array_join(F.sort_array(ql.not_updatable(wanted)), ",").alias("keys"))
