"""Operations-shaped views over the benchmark tables.

A view is a list of (column, expression) pairs that mean the same in Spark SQL and in the check
engine, so both sides start from the same rows. Only the JSON accessor differs; it is written
``{K}`` and filled in per engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPARK = {"K": "CAST(get_json_object(props, '$.k') AS BIGINT)"}
_CHECK = {"K": "CAST(json_extract_string(props, '$.k') AS BIGINT)"}

VIEWS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "audit_log": ("events", [
        ("event_id", "event_id"),
        ("ts", "ts"),
        ("event_type", "CASE event_type WHEN 'signup' THEN 'auth.login' WHEN 'view' THEN 'topic.list' "
                       "WHEN 'click' THEN 'topic.describe' WHEN 'purchase' THEN 'topic.create' ELSE 'api.error' END"),
        ("level", "CASE WHEN event_type = 'error' AND value >= 100 THEN 'CRITICAL' WHEN event_type = 'error' THEN 'ERROR' "
                  "WHEN value >= 150 THEN 'WARNING' ELSE 'INFO' END"),
        ("user_id", "CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('user', user_id) END"),
        ("session_id", "concat('s', user_id)"),
        ("message", "concat('Event ', event_type, ' for key ', {K})"),
        ("resource_type", "CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'topic' "
                          "WHEN event_type = 'error' THEN 'cluster' END"),
        ("resource_id", "CASE WHEN event_type IN ('view', 'click', 'purchase') THEN concat('c', {K} % 5, '/topic', {K}) "
                        "WHEN event_type = 'error' THEN concat('c', {K} % 5) END"),
        ("operation_result", "CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END"),
        ("duration_ms", "value"),
        ("details", "props"),
        ("instance_id", "event_id"),
    ]),
    "health_result": ("events", [
        ("event_id", "event_id"),
        ("ts", "ts"),
        ("name", "concat('check_', {K} % 5)"),
        ("status", "CASE WHEN event_type = 'error' AND {K} % 10 = 0 THEN 'unknown' WHEN value >= 200 THEN 'unhealthy' "
                   "WHEN value >= 120 THEN 'degraded' ELSE 'healthy' END"),
        ("duration_ms", "value"),
    ]),
    "metric_point": ("events", [
        ("event_id", "event_id"),
        ("ts", "ts"),
        ("kind", "CASE event_type WHEN 'signup' THEN 'gauge' WHEN 'purchase' THEN 'histogram' ELSE 'counter' END"),
        ("name", "CASE event_type WHEN 'signup' THEN 'active_connections' WHEN 'purchase' THEN 'request_duration' "
                 "WHEN 'error' THEN 'errors_total' ELSE 'requests_total' END"),
        ("service", "concat('svc', {K} % 4)"),
        ("zone", "concat('z', user_id % 3)"),
        ("value", "value"),
    ]),
    "request_log": ("events", [
        ("event_id", "event_id"),
        ("ts", "ts"),
        ("user_id", "user_id"),
        ("method", "CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'GET' WHEN 'purchase' THEN 'PUT' ELSE 'POST' END"),
        ("path", "concat('/topics/', {K})"),
        ("status_code", "CASE WHEN event_type = 'error' AND value >= 100 THEN 500 WHEN event_type = 'error' THEN 404 "
                        "WHEN event_type = 'signup' THEN 201 ELSE 200 END"),
        ("duration_ms", "value"),
        ("role", "CASE user_id % 10 WHEN 0 THEN 'admin' WHEN 1 THEN 'service_broker' WHEN 2 THEN 'viewer' ELSE 'developer' END"),
    ]),
    "service_instance": ("orders", [
        ("instance_id", "o_orderkey"),
        ("organization_id", "o_custkey"),
        ("plan_id", "CASE WHEN o_totalprice < 100000 THEN 'basic' WHEN o_totalprice < 250000 THEN 'standard' ELSE 'premium' END"),
        ("status", "CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'running' ELSE 'creating' END"),
        ("runtime_provider", "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'docker' "
                             "WHEN o_orderpriority = '3-MEDIUM' THEN 'kubernetes' ELSE 'terraform' END"),
        ("created_at", "o_orderdate"),
        ("updated_at", "o_orderdate + INTERVAL '2' DAY"),
        ("deleted_at", "CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL '30' DAY END"),
        ("total", "o_totalprice"),
    ]),
    "operation": ("lineitem", [
        ("instance_id", "l_orderkey"),
        ("seq", "l_linenumber"),
        ("part_id", "l_partkey"),
        ("supplier_id", "l_suppkey"),
        ("price", "l_extendedprice"),
        ("type", "CASE l_returnflag WHEN 'A' THEN 'provision' WHEN 'N' THEN 'update' ELSE 'deprovision' END"),
        ("state", "CASE WHEN l_discount >= 0.09 THEN 'failed' WHEN l_linestatus = 'O' THEN 'in_progress' ELSE 'succeeded' END"),
        ("started_at", "l_shipdate"),
        ("duration_s", "l_quantity"),
    ]),
    "topic": ("part", [
        ("topic_id", "p_partkey"),
        ("name", "concat(CASE p_size % 5 WHEN 0 THEN 'test-' WHEN 1 THEN 'temp-' WHEN 2 THEN '__' ELSE 'orders-' END, p_partkey)"),
        ("partitions", "p_size"),
        ("replication_factor", "1 + p_partkey % 3"),
        ("retention_ms", "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * 1800000 END"),
        ("cleanup_policy", "CASE p_type WHEN 'ECONOMY' THEN 'compact' WHEN 'STANDARD' THEN 'compact,delete' ELSE 'delete' END"),
        ("compression_type", "CASE WHEN p_brand LIKE 'Brand#1%' THEN 'lz4' WHEN p_brand LIKE 'Brand#2%' THEN 'brotli' ELSE 'none' END"),
        ("max_message_bytes", "CAST(p_size AS BIGINT) * 2500000"),
        ("min_insync_replicas", "1 + p_size % 3"),
        ("cluster_id", "concat('c', p_partkey % 7)"),
        ("state", "CASE WHEN p_partkey % 6 = 0 THEN 'deleting' ELSE 'active' END"),
        ("deleted", "p_partkey % 9 = 0"),
    ]),
    "partition_detail": ("lineitem", [
        ("topic_id", "l_partkey"),
        ("pkey", "l_orderkey"),
        ("partition_id", "l_linenumber"),
        ("supplier_id", "l_suppkey"),
        ("leader", "CASE WHEN l_suppkey % 20 = 0 THEN -1 ELSE l_suppkey % 3 END"),
        ("isr_count", "CAST(l_quantity AS BIGINT) % 4"),
        ("replica_count", "1 + l_suppkey % 3"),
        ("price", "l_extendedprice"),
    ]),
    "config_entry": ("lineitem", [
        ("entity", "concat('cluster', l_suppkey)"),
        ("key", "CASE l_partkey % 8 WHEN 0 THEN 'database.host' WHEN 1 THEN 'database.password' WHEN 2 THEN 'database.type' "
                "WHEN 3 THEN 'api.port' WHEN 4 THEN 'logging.level' WHEN 5 THEN 'kafka.bootstrap_servers' "
                "WHEN 6 THEN 'providers.default_provider' ELSE 'database.username' END"),
        ("source", "CASE WHEN l_linenumber <= 2 THEN 'default' WHEN l_linenumber <= 4 THEN 'file' "
                   "WHEN l_linenumber <= 6 THEN 'cli' ELSE 'env' END"),
        ("value", "CASE l_partkey % 8 WHEN 2 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'postgresql' ELSE 'sqlite' END "
                  "WHEN 3 THEN CAST(CAST(l_quantity AS BIGINT) * 100 AS VARCHAR(20)) "
                  "WHEN 4 THEN CASE WHEN l_orderkey % 3 = 0 THEN 'DEBUG' ELSE 'INFO' END "
                  "WHEN 5 THEN CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE concat('b1:', l_orderkey, ', b2:', l_orderkey) END "
                  "WHEN 6 THEN CASE l_orderkey % 4 WHEN 0 THEN 'docker' WHEN 1 THEN 'kubernetes' WHEN 2 THEN 'terraform' ELSE 'nomad' END "
                  "ELSE CASE l_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'yes' WHEN 2 THEN 'Off' WHEN 3 THEN concat(l_orderkey, '.5') "
                  "ELSE concat('v', l_orderkey) END END"),
        ("version", "l_shipdate"),
        ("order_id", "l_orderkey"),
        ("line_id", "l_linenumber"),
        ("part_id", "l_partkey"),
        ("price", "l_extendedprice"),
    ]),
    "app_user": ("customer", [
        ("user_id", "c_custkey"),
        ("role", "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'admin' WHEN 'BUILDING' THEN 'operator' WHEN 'FURNITURE' THEN 'developer' "
                 "WHEN 'HOUSEHOLD' THEN 'viewer' ELSE 'service_broker' END"),
        ("second_role", "CASE WHEN c_nationkey % 5 = 0 THEN 'viewer' WHEN c_nationkey % 5 = 1 THEN 'operator' END"),
        ("direct_permission", "CASE WHEN c_nationkey % 4 = 0 THEN 'topic:purge' WHEN c_nationkey % 4 = 1 THEN 'cluster:read' END"),
        ("balance", "c_acctbal"),
    ]),
    "cleanup_run": ("lineitem", [
        ("order_id", "l_orderkey"),
        ("line_id", "l_linenumber"),
        ("part_id", "l_partkey"),
        ("price", "l_extendedprice"),
        ("cluster_id", "concat('c', l_suppkey)"),
        ("run_type", "CASE l_returnflag WHEN 'A' THEN 'topic_cleanup' WHEN 'N' THEN 'cluster_cleanup' ELSE 'metadata_cleanup' END"),
        ("task_id", "concat('ondemand_', CASE l_returnflag WHEN 'A' THEN 'topic_cleanup' WHEN 'N' THEN 'cluster_cleanup' "
                    "ELSE 'metadata_cleanup' END, '_c', l_suppkey, '_', l_orderkey)"),
        ("status", "CASE WHEN l_discount >= 0.09 THEN 'failed' WHEN l_linestatus = 'O' THEN 'running' ELSE 'completed' END"),
        ("started_at", "l_shipdate"),
        ("ended_at", "l_shipdate + CAST(l_quantity AS INTEGER) * INTERVAL '2' HOUR"),
    ]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return apply_view(source, name)


def apply_view(source: DataFrame, name: str) -> DataFrame:
    """The view's projection over any batch or streaming DataFrame with the table's columns."""
    columns = VIEWS[name][1]
    if any("{K}" in e for _, e in columns):
        source = source.selectExpr("*", f"{_SPARK['K']} AS _k")
    return source.selectExpr(*[f"{_fill(e, {'K': '_k'})} AS {c}" for c, e in columns])


def check_sql(views: str, body: str, ctes: str = "") -> str:
    """Check SQL: the named views (comma separated) as CTEs, then any further CTEs, then the body."""
    parts = []
    for name in [v.strip() for v in views.split(",") if v.strip()]:
        table, columns = VIEWS[name]
        cols = ", ".join(f"{_fill(e, _CHECK)} AS {c}" for c, e in columns)
        parts.append(f"{name} AS (SELECT {cols} FROM {table})")
    if ctes:
        parts.append(ctes)
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def _fill(expression: str, values: dict[str, str]) -> str:
    return expression.replace("{K}", values["K"])
