"""Scans, sinks and table changes (S01-S15) and the text and time functions they use."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import texttime as tt
from tidewatch.operators import logquery as lq
from tidewatch.operators import metrics as mx
from tidewatch.plans.registry import Registry
from tidewatch.plans.views import check_sql, view
from tidewatch.session import scratch_dir
from tidewatch.sources import logs, messages, tables, writers

REG = Registry()


def raw_lines(audit):
    """Audit rows rendered as log lines: mostly JSON, some in the text layout, some unreadable."""
    as_json = logs.json_line(
        timestamp=F.concat(tt.render_iso(F.col("ts")), F.lit("Z")), level=F.col("level"), logger=F.lit("tidewatch.audit"),
        message=F.col("message"), event_type=F.col("event_type"), user_id=F.col("user_id"), session_id=F.col("session_id"),
        resource_type=F.col("resource_type"), resource_id=F.col("resource_id"), operation_result=F.col("operation_result"),
        details=F.from_json("details", "k BIGINT"))
    as_text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.col("level"),
                       F.lit("] tidewatch.audit: "), F.col("message"))
    line = (F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("{unreadable "), F.col("event_id")))
            .when(F.col("event_id") % 5 == 1, as_text).otherwise(as_json))
    return audit.select("event_id", line.alias("line"))


_JSON_ROWS = "event_id % 17 <> 0 AND event_id % 5 <> 1"
_TEXT_ROWS = "event_id % 17 <> 0 AND event_id % 5 = 1"


@REG.query("s01_json_lines", check_sql("audit_log", f"""
    SELECT event_id, ts, level, message, event_type, user_id, resource_type, resource_id, operation_result,
           CAST(json_extract_string(details, '$.k') AS BIGINT) AS k
    FROM audit_log WHERE {_JSON_ROWS}"""))
def s01(spark, sf_dir):
    parsed = logs.parse(raw_lines(view(spark, sf_dir, "audit_log")))
    return (logs.records(parsed).where("layout = 'json'")
            .select("event_id", "ts", "level", "message", "event_type", "user_id", "resource_type", "resource_id",
                    "operation_result", F.get_json_object("details", "$.k").cast("bigint").alias("k")))


@REG.query("s02_text_lines", check_sql("audit_log", f"""
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, level, 'tidewatch.audit' AS logger, message
    FROM audit_log WHERE {_TEXT_ROWS}"""))
def s02(spark, sf_dir):
    parsed = logs.parse(raw_lines(view(spark, sf_dir, "audit_log")))
    return logs.records(parsed).where("layout = 'text'").select("event_id", "timestamp", "level", "logger", "message")


@REG.query("s03_rejected_lines", check_sql("audit_log", """
    SELECT event_id, concat('{unreadable ', event_id) AS line FROM audit_log WHERE event_id % 17 = 0"""))
def s03(spark, sf_dir):
    return logs.rejected(logs.parse(raw_lines(view(spark, sf_dir, "audit_log")))).select("event_id", "line")


@REG.query("s04_table_scan", check_sql("service_instance", """
    SELECT instance_id, plan_id, status, runtime_provider, created_at FROM service_instance"""))
def s04(spark, sf_dir):
    from tidewatch.plans.views import apply_view
    rows = apply_view(tables.read_table(spark, f"{sf_dir}/orders.parquet"), "service_instance")
    return rows.select("instance_id", "plan_id", "status", "runtime_provider", "created_at")


@REG.query("s05_rotated_gzip_scan", check_sql("audit_log", f"""
    SELECT CASE WHEN {_TEXT_ROWS} THEN 'text' ELSE 'json' END AS layout, level, count(*) AS n
    FROM audit_log WHERE event_id % 17 <> 0 GROUP BY 1, 2"""))
def s05(spark, sf_dir):
    folder = scratch_dir(spark, "rotated")
    lines = raw_lines(view(spark, sf_dir, "audit_log"))
    lines.select("line").write.option("compression", "gzip").text(f"{folder}/audit_20240131.log")
    scanned = logs.read_lines(spark, logs.rotated_path(folder, "audit"))
    return logs.records(logs.parse(scanned)).groupBy("layout", "level").agg(F.count("*").alias("n"))


def topic_configs(topic):
    """Topics with their settings as a map, absent settings left out."""
    pairs = F.create_map(
        F.lit("retention.ms"), F.col("retention_ms").cast("string"),
        F.lit("cleanup.policy"), F.col("cleanup_policy"),
        F.lit("compression.type"), F.col("compression_type"),
        F.lit("max.message.bytes"), F.col("max_message_bytes").cast("string"))
    return topic.withColumn("configs", F.map_filter(pairs, lambda k, v: v.isNotNull()))


@REG.query("s06_topic_documents", check_sql("topic", """
    SELECT name, CAST(partitions AS INTEGER) AS partitions, CAST(replication_factor AS INTEGER) AS replication_factor,
           retention_ms, cleanup_policy, CAST(max_message_bytes AS VARCHAR) AS max_message_bytes FROM topic"""))
def s06(spark, sf_dir):
    folder = scratch_dir(spark, "topic-documents")
    spec = F.struct("name", "partitions", "replication_factor", "retention_ms", "cleanup_policy", "compression_type",
                    F.create_map(F.lit("max.message.bytes"), F.col("max_message_bytes").cast("string")).alias("custom_configs"))
    # One document holds a run of at most 500 topic ids, so its array is bounded.
    documents = (view(spark, sf_dir, "topic").groupBy(F.floor(F.col("topic_id") / 500).alias("document"))
                 .agg(F.to_json(F.collect_list(spec)).alias("value")))
    documents.write.partitionBy("document").text(folder)
    return (tables.read_topic_documents(spark, folder)
            .select("name", "partitions", "replication_factor", "retention_ms", "cleanup_policy",
                    F.col("custom_configs")["max.message.bytes"].alias("max_message_bytes")))


BODY = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
                     T.StructField("level", T.StringType()), T.StructField("duration_ms", T.DoubleType())])


@REG.query("s07_message_decode", check_sql("audit_log", """
    SELECT coalesce(user_id, 'none') AS key, event_id, event_type, level, duration_ms FROM audit_log"""))
def s07(spark, sf_dir):
    rows = view(spark, sf_dir, "audit_log").withColumn("user_id", F.coalesce("user_id", F.lit("none")))
    wire = messages.encode(rows, "user_id", BODY.names).select(F.encode("key", "utf-8").alias("key"), F.encode("value", "utf-8").alias("value"))
    return messages.decode_json(wire, BODY).select("key", "body.*")


@REG.query("s08_message_encode", check_sql("audit_log", """
    SELECT user_id AS key, concat('{"event_id":', event_id, ',"event_type":"', event_type, '","level":"', level, '"}') AS value
    FROM audit_log"""))
def s08(spark, sf_dir):
    return messages.encode(view(spark, sf_dir, "audit_log"), "user_id", ["event_id", "event_type", "level"])


@REG.query("s09_append_audit", check_sql("audit_log", """
    SELECT event_id, event_type, level, user_id, strftime(ts, '%Y-%m-%d') AS event_date FROM audit_log"""))
def s09(spark, sf_dir):
    folder = scratch_dir(spark, "audit")
    writers.append_audit(view(spark, sf_dir, "audit_log"), folder)
    return (spark.read.parquet(folder)
            .select("event_id", "event_type", "level", "user_id", F.date_format("event_date", "yyyy-MM-dd").alias("event_date")))


def _changes(spark, sf_dir):
    return view(spark, sf_dir, "operation").select(
        "instance_id", F.when(F.col("type") == "deprovision", "delete").otherwise("upsert").alias("op"),
        F.when(F.col("seq") == 3, None).when(F.col("state") == "failed", "error").when(F.col("state") == "succeeded", "running").otherwise("creating").alias("status"),
        F.col("started_at").alias("version"), "seq", "part_id", "supplier_id", "price")


_LAST_CHANGE = """last_change AS (SELECT instance_id,
      CASE WHEN type = 'deprovision' THEN 'delete' ELSE 'upsert' END AS op,
      CASE WHEN seq = 3 THEN NULL WHEN state = 'failed' THEN 'error' WHEN state = 'succeeded' THEN 'running' ELSE 'creating' END AS status, started_at AS version
    FROM operation QUALIFY row_number() OVER (PARTITION BY instance_id
      ORDER BY started_at DESC, seq DESC, part_id DESC, supplier_id DESC, price DESC) = 1)"""
_TIE = ("seq", "part_id", "supplier_id", "price")


_MERGED = check_sql("service_instance, operation", """
    SELECT coalesce(c.instance_id, b.instance_id) AS instance_id, b.plan_id,
           CASE WHEN c.instance_id IS NOT NULL THEN c.status ELSE b.status END AS status,
           coalesce(c.version, b.updated_at) AS updated_at
    FROM service_instance b FULL OUTER JOIN last_change c ON b.instance_id = c.instance_id
    WHERE c.op IS NULL OR c.op <> 'delete'""", _LAST_CHANGE)


@REG.query("s10_merge_instances", _MERGED)
def s10(spark, sf_dir):
    base = view(spark, sf_dir, "service_instance").select("instance_id", "plan_id", "status", "updated_at")
    return tables.merge(base, _changes(spark, sf_dir), ["instance_id"], "version", touch="updated_at", tie=_TIE)


@REG.query("s10_upsert_buckets", _MERGED)
def s10_partitions(spark, sf_dir):
    """The same merge into a table stored in parts, of which only those with changes are rewritten."""
    path, part = scratch_dir(spark, "instances"), F.pmod("instance_id", F.lit(16)).cast("int").alias("part")
    view(spark, sf_dir, "service_instance").select("instance_id", "plan_id", "status", "updated_at", part).write.partitionBy("part").parquet(path)
    tables.merge_partitions(spark, path, _changes(spark, sf_dir).select("*", part), ["instance_id"], "part", "version", touch="updated_at", tie=_TIE)
    return spark.read.parquet(path).drop("part")


@REG.query("s10_merge_bucketed", _MERGED)
def s10_bucketed(spark, sf_dir):
    base = view(spark, sf_dir, "service_instance").select("instance_id", "plan_id", "status", "updated_at")
    old, new = (f"instances_{uuid.uuid4().hex}" for _ in range(2))
    tables.write_bucketed(base, old, scratch_dir(spark, "instances"), ["instance_id"], 16)
    tables.merge_bucketed(spark, old, new, scratch_dir(spark, "instances"), 16, _changes(spark, sf_dir), ["instance_id"], "version", touch="updated_at", tie=_TIE)
    return spark.table(new)


@REG.query("s10_unmatched_deletes", check_sql("service_instance, operation", """
    SELECT instance_id, seq, price FROM operation o WHERE type = 'deprovision' AND NOT EXISTS
    (SELECT 1 FROM service_instance s WHERE s.instance_id = o.instance_id AND s.deleted_at IS NULL)"""))
def s10_unmatched(spark, sf_dir):
    live = view(spark, sf_dir, "service_instance").where("deleted_at IS NULL")
    return tables.unmatched(live, _changes(spark, sf_dir), ["instance_id"]).select("instance_id", "seq", "price")


@REG.query("s11_cascade_delete", check_sql("service_instance, operation", """
    SELECT 'instance' AS kind, instance_id, count(*) AS n FROM service_instance WHERE deleted_at IS NULL GROUP BY 2
    UNION ALL SELECT 'operation', o.instance_id, count(*) FROM operation o
    WHERE NOT EXISTS (SELECT 1 FROM service_instance s WHERE s.instance_id = o.instance_id AND s.deleted_at IS NOT NULL) GROUP BY 2"""))
def s11(spark, sf_dir):
    instances = view(spark, sf_dir, "service_instance")
    operations = view(spark, sf_dir, "operation")
    rows = max(instances.count(), operations.count())  # from the files' footers
    left = tables.cascade_delete(instances, {"operation": (operations, "instance_id")}, instances.where("deleted_at IS NOT NULL"), "instance_id", rows)
    counts = [left[name].groupBy("instance_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "instance_id", "n")
              for name, kind in (("parent", "instance"), ("operation", "operation"))]
    return counts[0].unionByName(counts[1])


@REG.query("s12_rollup_json", check_sql("audit_log", """
    SELECT strftime(ts, '%Y%m%d_00') AS period_start, 'level' AS section, level AS value, count(*) AS n FROM audit_log GROUP BY 1, 3
    UNION ALL SELECT strftime(ts, '%Y%m%d_00'), 'total', 'all', count(*) FROM audit_log GROUP BY 1"""))
def s12(spark, sf_dir):
    folder = scratch_dir(spark, "rollup-json")
    writers.write_rollup_json(lq.rollup(view(spark, sf_dir, "audit_log"), [], "1 day"), folder, "daily")
    schema = "section STRING, value STRING, n BIGINT, period_kind STRING, period_start STRING"
    return (spark.read.schema(schema).json(folder).where("section IN ('level', 'total')")
            .select("period_start", "section", "value", "n"))


@REG.query("s13_rollup_csv", check_sql("audit_log", """
    SELECT 'event_type' AS section, event_type AS value, count(*) AS count FROM audit_log GROUP BY 2
    UNION ALL SELECT 'total', 'all', count(*) FROM audit_log"""))
def s13(spark, sf_dir):
    folder = scratch_dir(spark, "rollup-csv")
    writers.write_rollup_csv(lq.statistics(view(spark, sf_dir, "audit_log")), folder)
    rows = spark.read.schema("section STRING, value STRING, count BIGINT").option("header", True).csv(folder)
    return rows.where("section IN ('event_type', 'total')")


@REG.query("s14_topic_export", check_sql("topic", """
    SELECT name, partitions, replication_factor, retention_ms, cleanup_policy, compression_type,
           concat('{"max.message.bytes":"', max_message_bytes, '"}') AS custom_configs FROM topic WHERE NOT starts_with(name, '__')"""))
def s14(spark, sf_dir):
    topics = topic_configs(view(spark, sf_dir, "topic").where(~F.col("name").startswith("__")))
    return writers.export_topics(topics).withColumn("custom_configs", F.to_json("custom_configs"))


@REG.query("s15_exposition", check_sql("metric_point", """
    SELECT '# HELP requests_total' AS series, CAST(NULL AS DOUBLE) AS value
    UNION ALL SELECT '# HELP errors_total', NULL
    UNION ALL SELECT DISTINCT concat('# TYPE ', name), CAST(NULL AS DOUBLE) FROM metric_point
    UNION ALL SELECT concat(name, labels), round(sum(value), 4) FROM k WHERE kind = 'counter' GROUP BY 1
    UNION ALL SELECT concat(name, labels), round(arg_max(value, event_id), 4) FROM k WHERE kind = 'gauge' GROUP BY 1
    UNION ALL SELECT concat(name, '_count', labels), CAST(count(*) AS DOUBLE) FROM k WHERE kind = 'histogram' GROUP BY 1
    UNION ALL SELECT concat(name, '_sum', labels), round(sum(value), 4) FROM k WHERE kind = 'histogram' GROUP BY 1
    UNION ALL SELECT concat(name, '_bucket', left(labels, length(labels) - 1), ',le="', le, '"}'),
                     CAST(count(CASE WHEN value <= CAST(le AS DOUBLE) THEN 1 END) AS DOUBLE)
              FROM k, (VALUES ('10.0'), ('50.0'), ('250.0')) AS b(le) WHERE kind = 'histogram' GROUP BY 1
    UNION ALL SELECT concat(name, '_bucket', left(labels, length(labels) - 1), ',le="+Inf"}'), CAST(count(*) AS DOUBLE) FROM k WHERE kind = 'histogram' GROUP BY 1""",
    """k AS (SELECT *, concat('{service="', service, '",zone="', zone, '"}') AS labels FROM metric_point)"""))
def s15(spark, sf_dir):
    helps = {"requests_total": "Requests served", "errors_total": "Requests that failed"}
    bounds = (10, 50, 250)
    lines = mx.exposition(mx.series(metric_points(spark, sf_dir), bounds=bounds), helps, bounds)
    return lines.select("series", F.round("value", 4).alias("value"))


def metric_points(spark, sf_dir):
    """Metric points with a label map and the series key."""
    points = view(spark, sf_dir, "metric_point")
    labels = F.create_map(F.lit("zone"), F.col("zone"), F.lit("service"), F.col("service"))
    return mx.with_key(points.withColumn("labels", labels))


@REG.query("x01_parse_iso", check_sql("audit_log", """
    SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN ts END AS ts FROM audit_log"""))
def x01(spark, sf_dir):
    text = (F.when(F.col("event_id") % 7 == 0, "not a time")
            .when(F.col("event_id") % 2 == 0, F.concat(tt.render_iso(F.col("ts")), F.lit("Z")))
            .otherwise(F.concat(tt.render_iso(F.col("ts") + F.expr("INTERVAL '2' HOUR")), F.lit("+02:00"))))
    return view(spark, sf_dir, "audit_log").select("event_id", tt.parse_iso(text).alias("ts"))


@REG.query("x02_render_iso", check_sql("audit_log", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM audit_log"))
def x02(spark, sf_dir):
    return view(spark, sf_dir, "audit_log").select("event_id", tt.render_iso(F.col("ts")).alias("iso"))


@REG.query("x03_json_round_trip", check_sql("audit_log", """
    SELECT event_id, CAST(json_extract_string(details, '$.k') AS BIGINT) AS k,
           concat('{"level":"', level, '","details":{"k":', json_extract_string(details, '$.k'), '}}') AS document FROM audit_log"""))
def x03(spark, sf_dir):
    details = F.from_json("details", "k BIGINT")
    return view(spark, sf_dir, "audit_log").select(
        "event_id", details["k"].alias("k"), F.to_json(F.struct("level", details.alias("details"))).alias("document"))


@REG.query("x04_nested_get", check_sql("audit_log", """
    SELECT event_id, json_extract_string(details, '$.k') AS k, CAST(NULL AS VARCHAR) AS missing FROM audit_log"""))
def x04(spark, sf_dir):
    rows = view(spark, sf_dir, "audit_log")
    return rows.select("event_id", lq.resolve(rows, "details.k").text.alias("k"), lq.resolve(rows, "details.k.deeper").text.alias("missing"))
