"""Configuration and policy expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import policy as po
from tidewatch.functions import texttime as tt
from tidewatch.operators import config as cf
from tidewatch.plans.lifecycle_queries import _RESOLVED, NEWEST
from tidewatch.plans.registry import Registry
from tidewatch.plans.views import check_sql, view

REG = Registry()
_OLD = _RESOLVED.replace("resolved AS (SELECT entity, key, value, source FROM config_entry", "old AS (SELECT entity, key, value, source FROM config_entry WHERE version < TIMESTAMP '2000-01-01 00:00:00'")


def _resolved(spark, sf_dir):
    return cf.resolve(view(spark, sf_dir, "config_entry"), newest=NEWEST)


def _drift(spark, sf_dir):
    return cf.drift(view(spark, sf_dir, "config_entry"), F.col("version") < F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'"), newest=NEWEST)


@REG.query("x09_layered_config", check_sql("config_entry", "SELECT entity, key, value, source FROM resolved", _RESOLVED))
def x09(spark, sf_dir):
    return _resolved(spark, sf_dir)


@REG.query("x05_set_value", check_sql("config_entry", """
    SELECT entity, key, value FROM resolved WHERE key <> 'logging.level' UNION ALL SELECT entity, 'logging.level', 'WARNING' FROM (SELECT DISTINCT entity FROM resolved)
    UNION ALL SELECT entity, 'logging.file.path', concat('/var/log/', entity) FROM (SELECT DISTINCT entity FROM resolved)""", _RESOLVED))
def x05(spark, sf_dir):
    resolved = _resolved(spark, sf_dir)
    new = F.array(F.struct(F.lit("logging.level").alias("key"), F.lit("WARNING").alias("value")),
                  F.struct(F.lit("logging.file.path").alias("key"), F.concat(F.lit("/var/log/"), F.col("entity")).alias("value")))
    changes = resolved.select("entity").distinct().select("entity", F.inline(new))
    return cf.set_values(resolved, changes)


@REG.query("x05_sections", check_sql("config_entry", """
    SELECT entity, split_part(key, '.', 1) AS section, concat('{', string_agg(concat('"', substr(key, strpos(key, '.') + 1), '":"', value, '"'), ',' ORDER BY substr(key, strpos(key, '.') + 1)), '}') AS settings
    FROM resolved GROUP BY 1, 2""", _RESOLVED))
def x05_sections(spark, sf_dir):
    return cf.sections(_resolved(spark, sf_dir))


_ENV = """CASE WHEN lower(value) IN ('true', 'yes', '1', 'on') THEN 'bool' WHEN lower(value) IN ('false', 'no', '0', 'off') THEN 'bool'
    WHEN regexp_full_match(value, '\\s*[+-]?[0-9]+\\s*') THEN 'int' WHEN contains(value, ',') THEN 'list' ELSE 'string' END"""


@REG.query("x06_environment_typing", check_sql("config_entry", f"""
    SELECT order_id, line_id, price, key, {_ENV} AS type, CASE {_ENV} WHEN 'bool' THEN CASE WHEN lower(value) IN ('true', 'yes', '1', 'on') THEN 'true' ELSE 'false' END
      WHEN 'list' THEN concat('["', replace(value, ', ', '","'), '"]') ELSE value END AS value FROM config_entry"""))
def x06(spark, sf_dir):
    return view(spark, sf_dir, "config_entry").select("order_id", "line_id", "price", "key", cf.infer_environment(F.col("value")).alias("t")).select("order_id", "line_id", "price", "key", "t.*")


@REG.query("x07_command_typing", check_sql("config_entry", """
    SELECT order_id, line_id, price, key, CASE WHEN lower(value) IN ('yes', 'off') THEN 'bool' WHEN regexp_full_match(value, '[0-9]+') THEN 'int'
      WHEN regexp_full_match(value, '[0-9]+[.]5') THEN 'float' ELSE 'string' END AS type FROM config_entry"""))
def x07(spark, sf_dir):
    return view(spark, sf_dir, "config_entry").select("order_id", "line_id", "price", "key", cf.infer_command(F.col("value"))["type"].alias("type"))


@REG.query("x08_map_merge", check_sql("topic", """
    SELECT name, CASE WHEN topic_id % 2 = 0 THEN 'compact' ELSE cleanup_policy END AS cleanup_policy, CAST(retention_ms AS VARCHAR) AS retention_ms,
           CASE WHEN topic_id % 2 = 0 THEN 'x' END AS extra FROM topic"""))
def x08(spark, sf_dir):
    base = F.create_map(F.lit("cleanup.policy"), F.col("cleanup_policy"), F.lit("retention.ms"), F.col("retention_ms").cast("string"))
    override = F.when(F.col("topic_id") % 2 == 0, F.create_map(F.lit("cleanup.policy"), F.lit("compact"), F.lit("extra"), F.lit("x")))
    merged = cf.merge_maps(base, override)
    return view(spark, sf_dir, "topic").select("name", merged.alias("m")).select(
        "name", F.col("m")["cleanup.policy"].alias("cleanup_policy"), F.col("m")["retention.ms"].alias("retention_ms"), F.try_element_at("m", F.lit("extra")).alias("extra"))


@REG.query("x12_masked_settings", check_sql("config_entry", """
    SELECT entity, key, CASE WHEN contains(key, 'password') THEN '***MASKED***' ELSE value END AS value FROM resolved""", _RESOLVED))
def x12(spark, sf_dir):
    return _resolved(spark, sf_dir).select("entity", "key", cf.masked(F.col("key"), F.col("value")).alias("value"))


@REG.query("x12_masked_documents", """
    SELECT event_id, 'auth.api_key' AS path, '***MASKED***' AS value FROM events UNION ALL SELECT event_id, 'auth.user', CAST(user_id AS VARCHAR) FROM events
    UNION ALL SELECT event_id, 'items[0].token', '***MASKED***' FROM events UNION ALL SELECT event_id, 'items[0].n', CAST(event_id AS VARCHAR) FROM events
    UNION ALL SELECT event_id, 'items[1]', event_type FROM events UNION ALL SELECT event_id, 'Secrets', '***MASKED***' FROM events UNION ALL SELECT event_id, 'level', 'INFO' FROM events""")
def x12_documents(spark, sf_dir):
    text = F.expr("""concat('{"auth": {"api_key": "k', event_id, '", "user": ', user_id, '}, "items": [{"token": "t", "n": ', event_id, '}, "', event_type,
        '"], "Secrets": {"a": 1, "b": [2]}, "level": "INFO"}')""")
    documents = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.alias("document"))
    return cf.flatten_masked(documents, ["event_id"], "document")


_DEEP = 12


@REG.query("x12_masked_deep_documents", f"""
    SELECT event_id, '{'.'.join(['a'] * _DEEP)}' AS path, event_type AS value FROM events
    UNION ALL SELECT event_id, '{'.'.join(['a'] * (_DEEP - 1))}.token', '***MASKED***' FROM events""")
def x12_deep(spark, sf_dir):
    inner = """concat('{"token": [1, {"x": 2}], "a": "', event_type, '"}')"""
    text = F.expr(f"""concat('{'{"a": ' * (_DEEP - 1)}', {inner}, '{'}' * (_DEEP - 1)}')""")
    documents = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.alias("document"))
    return cf.flatten_masked(documents, ["event_id"], "document")


@REG.query("j09_config_diff", check_sql("config_entry", """
    SELECT coalesce(o.entity, n.entity) AS entity, coalesce(o.key, n.key) AS key, o.value AS old_value, n.value AS new_value
    FROM old o FULL OUTER JOIN resolved n ON o.entity = n.entity AND o.key = n.key WHERE o.value IS DISTINCT FROM n.value""", f"{_OLD}, {_RESOLVED}"))
def j09(spark, sf_dir):
    return _drift(spark, sf_dir)


@REG.query("e04_change_routing", check_sql("config_entry", """
    SELECT n.entity, n.key, CASE WHEN n.key = 'logging.level' THEN 'set_log_level' WHEN starts_with(n.key, 'database.') THEN 'restart_for_database' ELSE 'restart_for_api' END AS action
    FROM old o FULL OUTER JOIN resolved n ON o.entity = n.entity AND o.key = n.key WHERE o.value IS DISTINCT FROM n.value
    AND (n.key = 'logging.level' OR starts_with(n.key, 'database.') OR starts_with(n.key, 'api.'))""", f"{_OLD}, {_RESOLVED}"))
def e04(spark, sf_dir):
    return cf.route_changes(_drift(spark, sf_dir)).select("entity", "key", "action")


_SCHEDULE = "CASE event_id % 6 WHEN 0 THEN '0 * * * *' WHEN 1 THEN '0 0 * * *' WHEN 2 THEN '*/15 * * * *' WHEN 3 THEN '*/5 * * * *' WHEN 4 THEN '0 2 * * *' ELSE ' 5 4  * *' END"


@REG.query("x13_next_run", check_sql("audit_log", f"""
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN date_trunc('hour', ts) + INTERVAL '1' HOUR WHEN 1 THEN date_trunc('day', ts) + INTERVAL '1' DAY
      WHEN 2 THEN time_bucket(INTERVAL '15' MINUTE, ts) + INTERVAL '15' MINUTE WHEN 3 THEN time_bucket(INTERVAL '5' MINUTE, ts) + INTERVAL '5' MINUTE
      ELSE ts + INTERVAL '1' HOUR END AS next_run, event_id % 6 < 4 AS known FROM audit_log"""))
def x13(spark, sf_dir):
    schedule = F.expr(_SCHEDULE)
    return view(spark, sf_dir, "audit_log").select("event_id", po.next_run(schedule, F.col("ts")).alias("next_run"), po.is_known_schedule(schedule).alias("known"))


@REG.query("x14_schedule_parts", check_sql("audit_log", """
    SELECT event_id, event_id % 6 <> 5 AS valid, CASE event_id % 6 WHEN 2 THEN '*/15' WHEN 3 THEN '*/5' WHEN 5 THEN '5' ELSE '0' END AS minute,
           CASE event_id % 6 WHEN 1 THEN '0' WHEN 4 THEN '2' WHEN 5 THEN '4' ELSE '*' END AS hour, CASE WHEN event_id % 6 <> 5 THEN '*' END AS weekday FROM audit_log"""))
def x14(spark, sf_dir):
    schedule = F.expr(_SCHEDULE)
    parts = po.cron_parts(schedule)
    return view(spark, sf_dir, "audit_log").select("event_id", po.is_cron(schedule).alias("valid"), parts["minute"].alias("minute"), parts["hour"].alias("hour"), parts["weekday"].alias("weekday"))


@REG.query("x15_retry_schedule", """
    SELECT event_id, CAST(attempt AS INTEGER) AS attempt, CASE event_id % 3 WHEN 0 THEN least(pow(2.0, attempt - 1), 60.0) WHEN 1 THEN least(attempt * 1.0::DOUBLE, 60.0) ELSE 1.0 END AS delay
    FROM (SELECT event_id, unnest(generate_series(1, 1 + event_id % 8)) AS attempt FROM events)""")
def x15(spark, sf_dir):
    strategy = F.expr("CASE event_id % 3 WHEN 0 THEN 'exponential' WHEN 1 THEN 'linear' ELSE 'fixed' END")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", po.retry_attempts((1 + F.col("event_id") % 8).cast("int")).alias("attempt"))
    return rows.select("event_id", "attempt", po.retry_delay(strategy, F.col("attempt")).alias("delay"))


_CODE = """CASE event_id % 9 WHEN 0 THEN 'VALIDATION_ERROR' WHEN 1 THEN 'KAFKA_TIMEOUT_ERROR' WHEN 2 THEN 'TOPIC_NOT_FOUND' WHEN 3 THEN 'INSTANCE_NOT_FOUND'
    WHEN 4 THEN 'OPERATION_IN_PROGRESS' WHEN 5 THEN 'RATE_LIMIT_EXCEEDED' WHEN 6 THEN 'INSTANCE_ALREADY_EXISTS' WHEN 7 THEN 'MIGRATION_FAILED' END"""


@REG.query("x16_should_retry", f"""
    SELECT event_id, 1 + event_id % 4 < 3 AND NOT coalesce({_CODE} IN ('VALIDATION_ERROR', 'TOPIC_NOT_FOUND', 'INSTANCE_NOT_FOUND', 'INSTANCE_ALREADY_EXISTS'), FALSE) AS retry FROM events""")
def x16(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", po.should_retry(1 + F.col("event_id") % 4, F.expr(_CODE)).alias("retry"))


_MESSAGE = """CASE event_id % 7 WHEN 0 THEN 'Connection Timeout' WHEN 1 THEN 'NETWORK unreachable' WHEN 2 THEN 'SASL handshake' WHEN 3 THEN 'authorization denied by ACL'
    WHEN 4 THEN 'connection: authentication failed' WHEN 5 THEN 'acl' ELSE concat('broken ', event_type) END"""


@REG.query("x17_error_class", """
    SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'KAFKA_TIMEOUT_ERROR' WHEN 1 THEN 'KAFKA_CONNECTION_ERROR' WHEN 2 THEN 'KAFKA_AUTHENTICATION_ERROR'
      WHEN 3 THEN 'KAFKA_AUTHORIZATION_ERROR' WHEN 4 THEN 'KAFKA_CONNECTION_ERROR' WHEN 5 THEN 'KAFKA_AUTHORIZATION_ERROR' ELSE 'INTERNAL_ERROR' END AS code FROM events""")
def x17(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", po.classify_error(F.expr(_MESSAGE)).alias("code"))


@REG.query("x18_http_status", """
    SELECT event_id, CASE event_id % 9 WHEN 0 THEN 400 WHEN 1 THEN 504 WHEN 2 THEN 404 WHEN 3 THEN 404 WHEN 4 THEN 409 WHEN 5 THEN 429 WHEN 6 THEN 409 ELSE 500 END AS status,
           CASE event_id % 9 WHEN 0 THEN 400 WHEN 1 THEN 504 WHEN 2 THEN 404 WHEN 3 THEN 410 WHEN 4 THEN 422 WHEN 5 THEN 429 WHEN 6 THEN 409 ELSE 500 END AS broker_status FROM events""")
def x18(spark, sf_dir):
    code = F.expr(_CODE)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", po.http_status(code).alias("status"), po.http_status(code, broker=True).alias("broker_status"))


@REG.query("x19_operation_state", check_sql("service_instance", """
    SELECT instance_id, CASE status WHEN 'running' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'in progress' END AS state,
           CASE status WHEN 'running' THEN 'Service instance is running' WHEN 'error' THEN 'Service instance failed' ELSE 'Service instance is creating' END AS description FROM service_instance"""))
def x19(spark, sf_dir):
    status = F.col("status")
    return view(spark, sf_dir, "service_instance").select("instance_id", po.operation_state(status).alias("state"), po.operation_description(status).alias("description"))


@REG.query("x20_audit_derivation", check_sql("request_log", """
    SELECT event_id, CASE WHEN status_code < 400 THEN 'info' ELSE 'warning' END AS level, CASE WHEN status_code < 400 THEN 'success' ELSE 'failure' END AS result,
           concat('topic.', CASE method WHEN 'PUT' THEN 'create' WHEN 'POST' THEN 'update' ELSE 'list' END) AS event_type,
           concat('API ', method, ' ', path, ' -> ', status_code) AS message FROM request_log"""))
def x20(spark, sf_dir):
    operation = F.when(F.col("method") == "PUT", "create").when(F.col("method") == "POST", "replace").otherwise("list")
    code = F.col("status_code")
    return view(spark, sf_dir, "request_log").select(
        "event_id", po.request_level(code).alias("level"), po.request_result(code).alias("result"), po.event_type(F.lit("topic"), operation).alias("event_type"),
        po.request_message(F.col("method"), F.col("path"), code, F.lit(None).cast("double")).alias("message"))


@REG.query("x21_plan_defaults", check_sql("service_instance", """
    SELECT instance_id, CASE WHEN instance_id % 3 = 0 THEN CAST(instance_id % 9 AS INTEGER) WHEN plan_id = 'basic' THEN 1 WHEN plan_id = 'premium' THEN 5 ELSE 3 END AS cluster_size,
           CASE plan_id WHEN 'basic' THEN 1 ELSE 3 END AS replication_factor, CASE plan_id WHEN 'basic' THEN 3 WHEN 'premium' THEN 12 ELSE 6 END AS partition_count,
           CASE plan_id WHEN 'basic' THEN 24 WHEN 'premium' THEN 720 ELSE 168 END AS retention_hours, CASE plan_id WHEN 'basic' THEN 5 WHEN 'premium' THEN 100 ELSE 20 END AS storage_size_gb,
           plan_id = 'premium' AS enable_ssl, plan_id = 'premium' OR instance_id % 4 = 0 AS enable_sasl, CASE WHEN plan_id = 'premium' THEN 3 ELSE 0 END AS properties FROM service_instance"""))
def x21(spark, sf_dir):
    overrides = {"cluster_size": F.when(F.col("instance_id") % 3 == 0, (F.col("instance_id") % 9).cast("int")), "enable_sasl": F.when(F.col("instance_id") % 4 == 0, True)}
    plan = F.col("plan_id")
    return view(spark, sf_dir, "service_instance").select("instance_id", *po.effective_cluster(plan, overrides), F.size(po.plan_properties(plan)).alias("properties"))


@REG.query("x22_formatting", check_sql("topic", """
    SELECT name, partitions * CAST(3600000 AS BIGINT) AS as_millis, retention_ms / 3600000.0::DOUBLE AS as_hours, round(max_message_bytes / 1073741824.0::DOUBLE, 2) AS gib, concat(partitions * 2, '.0%') AS share FROM topic"""))
def x22(spark, sf_dir):
    return view(spark, sf_dir, "topic").select(
        "name", tt.hours_to_millis(F.col("partitions")).alias("as_millis"), tt.millis_to_hours(F.col("retention_ms")).alias("as_hours"),
        tt.gibibytes(F.col("max_message_bytes")).alias("gib"), tt.percent(F.col("partitions") * 2 / 100).alias("share"))


@REG.query("x23_durations", check_sql("cleanup_run", """
    SELECT order_id, line_id, price, (epoch_us(ended_at) - epoch_us(started_at)) / 1e6 AS duration_seconds, (epoch_us(TIMESTAMP '2002-01-01 00:00:00') - epoch_us(ended_at)) / 1e6 AS idle_seconds FROM cleanup_run"""))
def x23(spark, sf_dir):
    return view(spark, sf_dir, "cleanup_run").select(
        "order_id", "line_id", "price", tt.seconds_between(F.col("started_at"), F.col("ended_at")).alias("duration_seconds"),
        tt.seconds_between(F.col("ended_at"), F.expr("TIMESTAMP_NTZ '2002-01-01 00:00:00'")).alias("idle_seconds"))


@REG.query("x26_epoch_in_name", check_sql("audit_log", """
    SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) // 1000000 END AS epoch FROM audit_log"""))
def x26(spark, sf_dir):
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("string")
    name = F.when(F.col("event_id") % 3 == 0, "plain-name").otherwise(F.concat(F.lit("aged-topic-"), seconds, F.lit("-"), F.col("event_id").cast("string")))
    return view(spark, sf_dir, "audit_log").select("event_id", tt.epoch_in_name(name).alias("epoch"))
