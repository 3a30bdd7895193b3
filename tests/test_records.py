"""Tables, files, lifecycle, access, configuration, policy and data quality on small hand-made rows."""

import gzip
import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.logquery import LogFilter, LogQuery, where
from tests.conftest import rows
from tidewatch.functions import policy as po
from tidewatch.functions import texttime as tt
from tidewatch.operators import access as ac
from tidewatch.operators import config as cf
from tidewatch.operators import inventory as inv
from tidewatch.operators import lifecycle as lc
from tidewatch.operators import quality as ql
from tidewatch.sources import logs, messages, tables, writers

NOW = datetime(2024, 1, 10)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- files and tables ---------------------------------------------------------------------------

def test_rotated_files(spark, tmp_path):
    with gzip.open(tmp_path / "audit_1.log.gz", "wt") as f:
        f.write('{"level": "INFO", "message": "a"}\nbroken\n')
    os.utime(tmp_path / "audit_1.log.gz", (1_700_000_000, 1_700_000_000))
    (tmp_path / "audit_2.log").write_text("2024-01-01 10:00:00 [ERROR] x: b\n")
    (tmp_path / "other.log").write_text("2024-01-01 10:00:00 [ERROR] x: c\n")
    lines = logs.read_lines(spark, logs.rotated_path(str(tmp_path), "audit"))
    assert [r["file_name"] for r in logs.rotated_files(lines).collect()] == ["audit_2.log", "audit_1.log.gz"]
    assert rows(logs.records(logs.parse(lines)), "level", "message") == [("ERROR", "b"), ("INFO", "a")]


def test_topic_documents(spark, tmp_path):
    (tmp_path / "topics.json").write_text(json.dumps([
        {"name": "tide-gauges", "partitions": 9, "replication_factor": 2, "retention_ms": 5400000, "custom_configs": {"max.message.bytes": "4096"}},
        {"name": "buoy-catalog", "partitions": 2, "replication_factor": 2, "retention_ms": -1, "cleanup_policy": "compact"}], indent=2))
    docs = tables.read_topic_documents(spark, str(tmp_path / "topics.json"))
    assert rows(docs, "name", "partitions", "retention_ms", "cleanup_policy") == [("buoy-catalog", 2, -1, "compact"), ("tide-gauges", 9, 5400000, None)]


def test_message_options_and_round_trip(spark):
    assert messages.source_options("b:9092", "t", "g") == {"kafka.bootstrap.servers": "b:9092", "subscribe": "t", "startingOffsets": "earliest", "kafka.group.id": "g"}
    assert messages.sink_options("b:9092", "t")["kafka.acks"] == "all"
    wire = messages.encode(spark.createDataFrame([(1, "ü")], "id INT, name STRING"), "id", ["id", "name"]).select(
        F.encode("key", "utf-8").alias("key"), F.encode("value", "utf-8").alias("value"), F.lit(7).alias("offset"))
    assert rows(messages.decode(wire)) == [("1", '{"id":1,"name":"ü"}', 7)]


def test_merge_and_cascade(spark):
    base = spark.createDataFrame([(1, "a", "running", 0), (2, "b", "running", 0), (3, "c", "error", 0)], "id INT, plan STRING, status STRING, updated INT")
    changes = spark.createDataFrame([(1, "upsert", "error", 5), (1, "upsert", "stopped", 6), (2, "delete", None, 7), (9, "delete", None, 1), (4, "upsert", "creating", 8)],
                                    "id INT, op STRING, status STRING, version INT")
    merged = tables.merge(base, changes, ["id"], "version", touch="updated")
    assert rows(merged) == [(1, "a", "stopped", 6), (3, "c", "error", 0), (4, None, "creating", 8)]
    assert rows(tables.unmatched(base, changes, ["id"]), "id") == [(9,)]
    audit = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "iid INT, op STRING")
    left = tables.cascade_delete(base, {"audit": (audit, "iid")}, base.where("id = 2"), "id")
    assert rows(left["parent"], "id") == [(1,), (3,)] and rows(left["audit"], "op") == [("x",), ("z",)]


def test_cascade_joins_in_parts_that_are_not_merged(spark, monkeypatch):
    base = spark.createDataFrame([(i, i % 11 == 0) for i in range(300)] + [(22, True), (None, True)], "id LONG, dead BOOLEAN")
    audit = spark.createDataFrame([(i % 300, i) for i in range(1200)] + [(None, -1)], "iid LONG, n LONG")
    monkeypatch.setattr(tables, "JOINED_ROWS", 100)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stated, expected in ((None, parts), (1201, max(parts, 13)), (100 * parts + 500, parts + 5)):
            left = tables.cascade_delete(base, {"audit": (audit, "iid")}, base.where("dead"), "id", stated)
            assert left["audit"].rdd.getNumPartitions() == left["parent"].rdd.getNumPartitions() == expected
            assert sorted(r["n"] for r in left["audit"].collect()) == [-1, *(i for i in range(1200) if i % 300 % 11)]
            assert {r["id"] for r in left["parent"].collect()} == {None, *(i for i in range(300) if i % 11)} and left["parent"].count() == 273
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_merge_clears_columns(spark):
    base = spark.createDataFrame([(1, "a", "bad"), (2, "b", "bad")], "id INT, plan STRING, error STRING")
    changes = spark.createDataFrame([(1, "upsert", None, 5)], "id LONG, op STRING, error STRING, version INT")
    assert rows(tables.merge(base, changes, ["id"], "version")) == [(1, "a", None), (2, "b", "bad")]
    assert rows(tables.merge(base, changes, ["id"], "version", null_keeps=True)) == [(1, "a", "bad"), (2, "b", "bad")]


def test_merge_rewrites_named_partitions_only(spark, tmp_path):
    path, part = str(tmp_path / "t"), F.floor(F.col("id") / 10).cast("int").alias("part")
    spark.range(100).select("id", F.concat(F.lit("p"), "id").alias("plan"), F.lit(0).alias("updated"), part).repartition(1).write.partitionBy("part").parquet(path)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    schema = "id INT, op STRING, plan STRING, version INT"  # keys of another integer type
    gone = spark.createDataFrame([(i, "delete", None, 1) for i in range(20, 30)] + [(35, "delete", None, 1)], schema).select("*", part)
    for _ in range(2):
        tables.merge_partitions(spark, path, gone, ["id"], "part", "version", touch="updated")
        assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [i for i in range(100) if not 20 <= i < 30 and i != 35]
    assert sum(f.exists() and f.stat().st_mtime_ns == at for f, at in files.items()) == len(files) - 2
    tables.merge_partitions(spark, path, spark.createDataFrame([(25, "upsert", "new", 2)], schema).select("*", part), ["id"], "part", "version", touch="updated")
    assert rows(spark.read.parquet(path).where("id = 25"), "id", "plan", "updated") == [(25, "new", 2)]


def test_audit_days(spark, tmp_path):
    path = str(tmp_path / "audit")
    events = spark.range(400).select(F.col("id").alias("event_id"), F.expr("CASE WHEN id % 100 > 0 THEN timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, id div 100) END").alias("ts"))
    writers.append_audit(events.repartition(40), path)
    assert len(list((tmp_path / "audit").rglob("*.parquet"))) <= 8
    query = LogQuery(start=datetime(2024, 1, 2), end=datetime(2024, 1, 3))
    found = where(spark.read.parquet(path), query)
    assert found.count() == 4 + 99 + 99
    plan = found._jdf.queryExecution().executedPlan().toString()
    pruned = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "event_date" in pruned and ">=" in pruned and "<=" in pruned
    assert writers.drop_partitions(spark, path, "event_date", "2024-01-03") == ["2024-01-01", "2024-01-02"]
    assert spark.read.parquet(path).count() == 4 + 99 + 99


def test_partition_rewrite_and_rollup_files(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.createDataFrame([(1, "a"), (2, "b")], "v INT, day STRING")
    tables.rewrite_partitions(table, path, "day")
    tables.rewrite_partitions(spark.createDataFrame([(9, "b")], "v INT, day STRING"), path, "day")
    assert rows(spark.read.parquet(path), "v", "day") == [(1, "a"), (9, "b")]
    rollup = spark.createDataFrame([(NOW, "level", "INFO", 3)], "period_start TIMESTAMP_NTZ, section STRING, value STRING, n LONG")
    for _ in range(2):
        writers.write_rollup_json(rollup, str(tmp_path / "r"), "daily")
    assert (tmp_path / "r" / "period_kind=daily" / "period_start=20240110_00").is_dir()
    assert spark.read.json(str(tmp_path / "r")).count() == 1
    writers.append_audit(spark.createDataFrame([(NOW, "x")], "ts TIMESTAMP_NTZ, op STRING"), str(tmp_path / "a"))
    assert (tmp_path / "a" / "event_date=2024-01-10").is_dir()


# --- lifecycle ----------------------------------------------------------------------------------

def test_topic_cleanup(spark):
    topics = spark.createDataFrame([("test-a", 3600000), ("temp-b", None), ("prod", 1000), ("__internal", 1), ("forever", -1), ("my-test-x", 999999999)], "name STRING, retention_ms LONG")
    assert rows(lc.topic_candidates(topics, "test"), "name") == [("temp-b",), ("test-a",)]
    assert rows(lc.topic_candidates(topics, "expired", 24), "name") == [("prod",), ("test-a",)]
    assert lc.topic_candidates(topics, "all").count() == 5
    failed = spark.createDataFrame([("temp-b",)], "name STRING")
    assert rows(lc.topic_report(topics, "test", 24, failed, False)) == [(5, 2, 1, 1, False)]
    assert rows(lc.topic_report(topics, "test", 24, None, True)) == [(5, 2, 0, 0, True)]


def test_stale_and_aged(spark):
    instances = spark.createDataFrame([("old", "error", NOW - timedelta(hours=48)), ("new", "error", NOW - timedelta(hours=1)), ("ok", "running", NOW - timedelta(hours=99))],
                                      "id STRING, status STRING, updated_at TIMESTAMP_NTZ")
    assert rows(lc.stale_failed(instances, NOW, 24), "id") == [("old",)]
    names = spark.createDataFrame([(n,) for n in ("aged-topic-100-0", "aged-topic-300-1", "aged-topic-x-2", "aged-topic", "other-1-1")], "name STRING")
    assert rows(lc.aged_names(names, "aged-topic-", 200)) == [("aged-topic-100-0",)]


def test_merge_of_a_bucketed_table_shuffles_only_the_changes(spark, tmp_path):
    base = spark.createDataFrame([(i, f"v{i}", NOW) for i in range(500)], "id INT, v STRING, at TIMESTAMP_NTZ")
    later = NOW + timedelta(hours=1)
    changes = spark.createDataFrame([(i, "delete" if i % 3 == 0 else "upsert", f"w{i}", later) for i in range(400, 600)] + [(401, "upsert", "old", NOW)],
                                    "id INT, op STRING, v STRING, version TIMESTAMP_NTZ")
    tables.write_bucketed(base, "bucketed_old", str(tmp_path / "old"), ["id"], 8)
    plain = tables.merge(base, changes, ["id"], "version", touch="at")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    for shuffled_to in ("3", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", shuffled_to)
        merged = tables.merge(spark.table("bucketed_old").hint("merge"), changes, ["id"], "version", touch="at", buckets=8)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        old_side, new_side = plan[plan.index("SortMergeJoin"):].split("FileScan", 1)
        assert "Exchange" not in old_side and "Bucketed: true" in new_side and "Exchange hashpartitioning(id" in new_side
    tables.merge_bucketed(spark, "bucketed_old", "bucketed_new", str(tmp_path / "new"), 8, changes, ["id"], "version", touch="at")
    assert rows(spark.table("bucketed_new"), "id", "v", "at") == rows(plain, "id", "v", "at")
    assert len([f for f in os.listdir(tmp_path / "new") if f.endswith(".parquet")]) == 8


def test_brokers_of_periods_are_counted_exactly(spark):
    seen = [(t, (t * 40_000 + i) % 90_000, i % 5) for t in range(4) for i in range(0, 3000, 7)] + [(0, -1, 0), (9, 5, 1)]
    partitions = spark.createDataFrame(seen, "topic_id INT, leader BIGINT, day INT")
    topics = spark.createDataFrame([(t, f"c{t % 2}") for t in range(4)], "topic_id INT, cluster_id STRING")
    periods = inv.broker_periods(partitions, topics, F.col("day"))
    for days in ({0, 1, 2, 3, 4}, {1, 3}):
        want = {}
        for t, leader, day in seen:
            if t < 4 and leader >= 0 and day in days:
                want.setdefault(f"c{t % 2}", set()).add(leader)
        got = inv.brokers_of(periods.where(F.col("period").isin(list(days))))
        assert {r["cluster_id"]: r["broker_count"] for r in got.collect()} == {c: len(v) for c, v in want.items()}


def test_purge(spark):
    sent = spark.createDataFrame([(1, "a", NOW - timedelta(seconds=5)), (2, "a", NOW - timedelta(seconds=1)), (3, "b", NOW - timedelta(days=9)), (4, "c", NOW - timedelta(days=9))],
                                 "id INT, topic STRING, ts TIMESTAMP_NTZ")
    keep = spark.createDataFrame([("a", 1000), ("b", -1)], "topic STRING, retention_ms LONG")
    assert rows(lc.purge(sent, keep, "topic", "ts", NOW), "id") == [(2,), (3,), (4,)]


def test_purge_of_a_stored_table_rewrites_only_the_days_that_lose(spark, tmp_path):
    def at(days):
        return NOW - timedelta(days=days)

    sent = [(1, "a", at(9)), (2, "a", at(1)), (3, "b", at(9)), (4, None, at(9)), (5, "c", at(5)), (6, "c", at(3)), (7, "a", None), (8, "a", at(20)),
            (9, "d", at(40)), (10, "z", at(5))]
    keep = [("a", 2 * 86400000), ("b", -1), ("b", 1000), ("c", 86400000), ("c", 4 * 86400000), ("d", None)]
    messages = spark.createDataFrame(sent, "id INT, topic STRING, ts TIMESTAMP_NTZ")
    retention = spark.createDataFrame(keep, "topic STRING, retention_ms BIGINT")
    path = str(tmp_path / "messages")
    writers.append_audit(messages, path)
    before = {d: set(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if "=" in d}
    lost = lc.purge_table(spark, path, retention, "topic", "ts", NOW, "event_date")
    assert lost == sorted(at(d).date() for d in (20, 9, 5))
    assert rows(spark.read.parquet(path), "id") == sorted([(2,), (3,), (4,), (6,), (7,), (9,), (10,)], key=lambda r: str(r[0]))
    after = {d: set(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if "=" in d}
    assert f"event_date={at(20).date()}" not in after
    assert {d for d in after if after[d] != before[d]} == {f"event_date={at(d).date()}" for d in (9, 5)}
    assert lc.purge_table(spark, path, retention, "topic", "ts", NOW, "event_date") == []
    assert lc.purge_table(spark, path, retention.where("retention_ms = -1"), "topic", "ts", NOW, "event_date") == []


def test_stored_documents_are_read_by_path(spark, tmp_path):
    texts = ['{"k": 1, "o": {"s": "x"}, "pad": "%s"}' % ("p" * 50), '{"k": "1"}', "no json {", None, '{"k": true}', "[1]"]
    table = spark.createDataFrame([(i, NOW, t) for i, t in enumerate(texts)], "id INT, ts TIMESTAMP_NTZ, details STRING")
    path = str(tmp_path / "audit")
    writers.append_audit(table.repartition(1), path, nested=["details"])
    stored = spark.read.parquet(path)
    assert rows(stored.where("details IS NULL"), "id") == [(3,)]
    assert [r[0] for r in stored.where("id = 2").selectExpr("CAST(details AS STRING)").collect()] == ["no json {"]
    for value in (1, "1", True):
        filters = LogQuery(filters=[LogFilter("details.k", "eq", value)])
        assert rows(where(stored, filters), "id") == rows(where(table, filters), "id") != []
    assert rows(where(stored, LogQuery(filters=[LogFilter("details.o.s", "starts_with", "x")])), "id") == [(0,)]
    found = where(stored, LogQuery(filters=[LogFilter("details.k", "eq", 1)])).select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:int,details:struct<0:variant" in plan


def test_big_database_tables_need_bounds(spark):
    with pytest.raises(ValueError, match="lowerBound, upperBound, numPartitions"):
        tables.read_table(spark, {"url": "jdbc:x", "dbtable": "t", "partitionColumn": "id"}, rows=tables.ONE_TASK_ROWS + 1)


def test_conflicts(spark):
    data = [(1, "c1", "topic_cleanup", 0, 10), (2, "c1", "topic_cleanup", 5, 6), (3, "c1", "metadata_cleanup", 6, 20), (4, "c1", "cluster_cleanup", 8, 9),
            (5, "c2", "cluster_cleanup", 8, 9), (6, "c1", "topic_cleanup", 10, 11), (7, "c1", "metadata_cleanup", 10, 11)]
    runs = spark.createDataFrame([(i, c, t, NOW + timedelta(hours=a), NOW + timedelta(hours=b)) for i, c, t, a, b in data],
                                 "id INT, cluster_id STRING, run_type STRING, started_at TIMESTAMP_NTZ, ended_at TIMESTAMP_NTZ")
    for parts in (0, 4):
        got = {r["id"]: r["conflicts_with"] for r in lc.conflicts(runs, ["id"], parts=parts).collect()}
        assert got == {1: "", 2: "topic_cleanup", 3: "", 4: "topic_cleanup,metadata_cleanup", 5: "", 6: "", 7: "metadata_cleanup"}


def test_role_limits(spark):
    from tidewatch.operators.sequential import role_limit
    df = spark.createDataFrame([("admin",), ("service_broker",), ("viewer",), (None,)], "role STRING")
    assert [r["n"] for r in df.select(role_limit(F.col("role")).alias("n")).collect()] == [1000, 500, 100, 100]


def test_due_and_statistics(spark):
    tasks = spark.createDataFrame([("a", True, False, 0, 3, NOW), ("b", False, False, 0, 3, NOW), ("c", True, False, 3, 3, NOW), ("d", True, True, 0, 3, NOW), ("e", True, False, 0, 3, NOW + timedelta(hours=1))],
                                  "task_id STRING, enabled BOOLEAN, running BOOLEAN, failure_count INT, max_failures INT, next_run TIMESTAMP_NTZ")
    assert rows(lc.due(tasks, NOW), "task_id") == [("a",)]
    assert rows(lc.task_statistics(tasks)) == [(5, 4, 1, 1)]
    runs = spark.createDataFrame([("ondemand_topic_cleanup_c1_1", "completed"), ("ondemand_cluster_cleanup_c1_2", "failed"), ("odd", "completed")], "task_id STRING, status STRING")
    assert rows(lc.cleanup_statistics(runs)) == [("completed", 2), ("failed", 1), ("total", 3), ("type:cluster", 1), ("type:topic", 1)]
    assert rows(lc.cleanup_statistics(runs.where("false"))) == [("completed", 0), ("failed", 0), ("total", 0)]


# --- inventory and access -----------------------------------------------------------------------

def test_lookups(spark):
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "k INT")
    first, second = spark.createDataFrame([(1, "a")], "k INT, v STRING"), spark.createDataFrame([(1, "x"), (2, "b")], "k INT, v STRING")
    assert rows(inv.lookup(wanted, first, second, "k", "v")) == [(1, "a", "first"), (2, "b", "second"), (3, None, "missing")]
    assert rows(inv.first_wins(first, second, "k")) == [(1, "a"), (2, "b")]


def test_views(spark):
    instances = spark.createDataFrame([(1, None), (2, NOW)], "id INT, deleted_at TIMESTAMP_NTZ")
    topics = spark.createDataFrame([(1, False, "active"), (2, True, "active"), (3, False, "deleting")], "id INT, deleted BOOLEAN, state STRING")
    operations = spark.createDataFrame([(1, "in_progress"), (2, "failed")], "id INT, state STRING")
    audit = spark.createDataFrame([(1, NOW - timedelta(hours=25)), (2, NOW - timedelta(hours=24)), (3, NOW)], "id INT, ts TIMESTAMP_NTZ")
    jobs = spark.createDataFrame([(1, "scheduled", NOW), (2, "done", NOW), (3, "scheduled", NOW + timedelta(1)), (4, "scheduled", NOW - timedelta(1))], "id INT, state STRING, scheduled_at TIMESTAMP_NTZ")
    inv.register_views(instances, topics, operations, audit, jobs, NOW)
    found = {v: [r["id"] for r in spark.table(v).collect()] for v in ("active_service_instances", "active_topics", "pending_operations", "recent_audit_logs", "scheduled_cleanup_jobs")}
    assert found == {"active_service_instances": [1], "active_topics": [1], "pending_operations": [1], "recent_audit_logs": [3, 2], "scheduled_cleanup_jobs": [4, 1]}


def test_permissions(spark):
    users = spark.createDataFrame([("a", ["viewer", "nobody"], ["topic:purge", "topic:read"]), ("b", [], []), ("c", ["admin"], [])], "id STRING, roles ARRAY<STRING>, direct ARRAY<STRING>")
    assert rows(ac.permission_rows(users, "id", "roles", "direct").where("id = 'a'"), "permission") == [("cleanup:read",), ("cluster:read",), ("topic:purge",), ("topic:read",)]
    held = ac.effective_permissions(F.col("roles"), F.col("direct"))
    got = users.select("id", ac.authorised(held, F.col("roles"), any_permissions=["topic:purge", "admin:write"], require_all=True).alias("all"),
                       ac.authorised(held, F.col("roles"), role="viewer", permission="cluster:read").alias("both"), ac.authorised(held, F.col("roles")).alias("none"))
    assert rows(got) == [("a", False, True, True), ("b", False, False, True), ("c", True, False, True)]


# --- configuration ------------------------------------------------------------------------------

@pytest.mark.parametrize("text, environment, command", [
    ("yes", ("bool", "true"), ("bool", "true")), ("OFF", ("bool", "false"), ("bool", "false")), ("1", ("bool", "true"), ("bool", "true")),
    ("42", ("int", "42"), ("int", "42")), ("-007", ("int", "-7"), ("int", "-7")), (" 1_000 ", ("int", "1000"), ("int", "1000")),
    ("a, b", ("list", '["a","b"]'), ("string", "a, b")), ("plain", ("string", "plain"), ("string", "plain")), ("", ("string", ""), ("string", "")),
    ("1.5", ("string", "1.5"), ("float", "1.5")), (".5", ("string", ".5"), ("float", "0.5")), ("1e3", ("string", "1e3"), ("float", "1000.0")),
    ('{"a":1}', ("string", '{"a":1}'), ("object", '{"a":1}')), ("[1, 2]", ("list", '["[1","2]"]'), ("list", "[1,2]")),
    ('"q"', ("string", '"q"'), ("string", "q")), ("null", ("string", "null"), ("null", "null")), ("{bad", ("string", "{bad"), ("string", "{bad")),
])
def test_value_typing(spark, text, environment, command):
    assert tuple(one(spark, cf.infer_environment(F.lit(text)))) == environment
    assert tuple(one(spark, cf.infer_command(F.lit(text)))) == command


def test_layers_and_drift(spark):
    entries = spark.createDataFrame([("e", "a", "1", "default"), ("e", "a", "2", "env"), ("e", "a", "3", "cli"), ("e", "b", "x", "file")], "entity STRING, key STRING, value STRING, source STRING")
    resolved = cf.resolve(entries)
    assert rows(resolved) == [("e", "a", "2", "env"), ("e", "b", "x", "file")]
    changed = cf.set_values(resolved, spark.createDataFrame([("e", "b", "y"), ("e", "api.port", "80")], "entity STRING, key STRING, value STRING"))
    drift = cf.diff(resolved, changed)
    assert rows(drift) == [("e", "api.port", None, "80"), ("e", "b", "x", "y")]
    assert rows(cf.route_changes(drift), "key", "action") == [("api.port", "restart_for_api")]
    assert rows(cf.sections(changed)) == [("e", "api", '{"port":"80"}')]


def test_drift_in_one_pass(spark, tmp_path):
    data = [("e", "a", "1", "file", 1), ("e", "a", "2", "file", 5), ("e", "a", "0", "env", 3), ("e", "b", "x", "file", 1), ("e", "c", "n", "cli", 9), ("f", "a", "1", "file", 2), ("f", "a", "7", "cli", 8)]
    spark.createDataFrame(data, "entity STRING, key STRING, value STRING, source STRING, v INT").write.parquet(str(tmp_path / "t"))
    entries = spark.read.parquet(str(tmp_path / "t"))
    got = cf.drift(entries, F.col("v") < 4, newest=["v"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    want = cf.diff(cf.resolve(entries.where("v < 4"), newest=["v"]), cf.resolve(entries, newest=["v"]))
    assert rows(got) == rows(want) == [("e", "c", None, "n"), ("f", "a", "1", "7")]


def test_merge_maps(spark):
    base, override = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))
    assert one(spark, cf.merge_maps(base, override)) == {"a": "1", "b": "3"}
    assert one(spark, cf.merge_maps(base, F.lit(None).cast("map<string,string>"))) == {"a": "1", "b": "2"}


def test_masking(spark):
    doc = {"db": {"Password": "p", "host": "h"}, "list": [{"api_key": 1}, [2, {}]], "tokens": {"x": 1}, "n": None, "e": []}
    frame = spark.createDataFrame([(1, json.dumps(doc))], "id INT, d STRING")
    got = {r["path"]: r["value"] for r in cf.flatten_masked(frame, ["id"], "d").collect()}
    assert got == {"db.Password": cf.MASK, "db.host": "h", "list[0].api_key": cf.MASK, "list[1][0]": "2", "list[1][1]": "{}", "tokens": cf.MASK, "n": None, "e": "[]"}
    deep = {"leaf": 1}
    for i in range(25):
        deep = {"a": deep} if i % 2 else {"l": [deep, i]}
    got = {r["path"]: r["value"] for r in cf.flatten_masked(spark.createDataFrame([(1, json.dumps(deep)), (2, '"x"')], "id INT, d STRING"), ["id"], "d").collect()}
    assert len(got) == 15 and got[""] == "x" and sum(p.endswith(".leaf") for p in got) == 1


def test_masking_opens_as_deep_as_the_documents_are(spark, monkeypatch):
    texts = ['{"a":{"b":[]},"s":"x{{[\\"{"}', "5", "[[[1]]]", "{}", None, '"["', '{"n":null,"f":1.50,"t":true}',
             json.dumps({"long": "\\[\"{" * 20000, "l": [[]]})]
    frame = spark.createDataFrame(list(enumerate(texts)), "id INT, d STRING")
    assert [r[0] for r in frame.orderBy("id").select(cf.nesting(F.col("d"))).collect()] == [3, 0, 3, 1, None, 0, 1, 3]

    def leaves():
        return {(r["id"], r["path"], r["value"]) for r in cf.flatten_masked(frame, ["id"], "d").collect()}

    whole = leaves()
    assert {r for r in whole if r[0] < 7} == {(0, "a.b", "[]"), (0, "s", 'x{{["{'), (1, "", "5"), (2, "[0][0][0]", "1"), (3, "", "{}"),
                                              (4, "", None), (5, "", "["), (6, "n", None), (6, "f", "1.5"), (6, "t", "true")}
    assert {r for r in whole if r[0] == 7} == {(7, "long", '\\["{' * 20000), (7, "l[0]", "[]")}
    assert cf.flatten_masked(frame.limit(0), ["id"], "d").collect() == []
    monkeypatch.setattr(cf, "LEVELS", 2)
    assert leaves() == whole



# --- policy -------------------------------------------------------------------------------------

@pytest.mark.parametrize("schedule, at, want", [
    ("0 * * * *", datetime(2025, 3, 4, 8, 41), datetime(2025, 3, 4, 9)), ("0 * * * *", datetime(2025, 12, 31, 23), datetime(2026, 1, 1)),
    ("0 0 * * *", datetime(2024, 2, 28, 6, 2), datetime(2024, 2, 29)), ("*/15 * * * *", datetime(2025, 3, 4, 8, 1), datetime(2025, 3, 4, 8, 15)),
    ("*/15 * * * *", datetime(2025, 3, 4, 23, 46, 9), datetime(2025, 3, 5)), ("*/5 * * * *", datetime(2025, 3, 4, 8, 12), datetime(2025, 3, 4, 8, 15)),
    ("0 2 * * *", datetime(2025, 3, 4, 8, 12), datetime(2025, 3, 4, 9, 12)),
])
def test_next_run(spark, schedule, at, want):
    assert one(spark, po.next_run(F.lit(schedule), F.lit(at).cast("timestamp_ntz"))) == want


def test_retries_and_errors(spark):
    delays = [one(spark, po.retry_delay(F.lit(s), F.lit(n))) for s, n in (("exponential", 1), ("exponential", 4), ("exponential", 9), ("linear", 5), ("fixed", 5))]
    assert delays == [1.0, 8.0, 60.0, 5.0, 1.0]
    assert [one(spark, po.should_retry(F.lit(n), F.lit(c))) for n, c in ((1, None), (2, "VALIDATION_ERROR"), (3, None), (2, "INTERNAL_ERROR"))] == [True, False, False, True]
    assert [one(spark, po.classify_error(F.lit(m))) for m in ("Network timeout", "no connection", "SASL", "ACL", "x")] == [
        "KAFKA_TIMEOUT_ERROR", "KAFKA_CONNECTION_ERROR", "KAFKA_AUTHENTICATION_ERROR", "KAFKA_AUTHORIZATION_ERROR", "INTERNAL_ERROR"]
    assert [one(spark, po.http_status(F.lit("INSTANCE_NOT_FOUND"), b)) for b in (False, True)] == [404, 410]
    assert one(spark, po.is_cron(F.lit("0 * * *"))) is False


def test_audit_fields(spark):
    message = po.request_message(F.lit("GET"), F.lit("/x"), F.lit(404), F.lit(1.26))
    assert one(spark, message) == "API GET /x -> 404 (1.3ms)"
    assert one(spark, po.event_type(F.lit("system"), F.lit("odd"))) == "system.error"
    assert one(spark, tt.parse_iso(F.lit("2024-01-01T10:00:00.5+02:00"))) == datetime(2024, 1, 1, 8, 0, 0, 500000)
    assert one(spark, tt.parse_iso(F.lit("soon"))) is None


# --- data quality -------------------------------------------------------------------------------

def test_topic_rules(spark):
    good = dict(name="ok", partitions=3, replication_factor=3, max_message_bytes=1000, retention_ms=1, min_insync_replicas=2, cleanup_policy="delete", compression_type="none")
    bad = [("name", "", "name_length"), ("name", "x" * 250, "name_length"), ("name", "a b", "name_characters"), ("name", "a\\b", "name_characters"), ("name", "..", "name_dots"),
           ("name", "__x", "name_reserved"), ("partitions", 1001, "partitions_range"), ("replication_factor", 11, "replication_factor_range"), ("max_message_bytes", 0, "max_message_bytes_range"),
           ("retention_ms", 0, "retention_range"), ("retention_ms", -1, "retention_infinite"), ("min_insync_replicas", 4, "insync_over_replication"), ("cleanup_policy", "drop", "cleanup_policy_domain")]
    data = [{"id": 0, **good}] + [{"id": i, **good, c: v} for i, (c, v, _) in enumerate(bad, start=1)]
    schema = "id INT, name STRING, partitions INT, replication_factor INT, max_message_bytes INT, retention_ms LONG, min_insync_replicas INT, cleanup_policy STRING, compression_type STRING"
    df = spark.createDataFrame([tuple(d[c.split()[0]] for c in schema.split(", ")) for d in data], schema)
    got = {r["id"]: r["rule_id"] for r in ql.violations(df, ["id"], ql.topic_rules()).collect()}
    assert got == {i: rule for i, (_, _, rule) in enumerate(bad, start=1)}


def test_parameter_rules_and_fields(spark):
    texts = ['{"cluster_size": 3}', '{"cluster_size": 11}', '{"cluster_size": "3"}', '{"retention_hours": 0}', '{"replication_factor": 1.5}', "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING").withColumn("p", F.parse_json("t"))
    assert rows(ql.violations(df, ["id"], ql.parameter_rules("p")), "id", "rule_id") == [(1, "cluster_size"), (2, "cluster_size"), (3, "retention_hours"), (4, "replication_factor")]
    assert one(spark, ql.missing_fields(F.lit('{"a": null}'), ["a", "b"])) == ["b"]
    assert one(spark, ql.missing_fields(F.lit("nonsense"), ["a"])) == ["a"]


def test_update_rules(spark):
    df = spark.createDataFrame([(1, {"retention.ms": "1"}), (2, {}), (3, {"zzz": "1", "segment.ms": "2", "aaa": "3"}), (4, None)], "id INT, c MAP<STRING, STRING>")
    got = ql.violations(df, ["id"], ql.update_rules("c"))
    assert rows(got, "id", "rule_id", "message") == [(2, "empty", "at least one setting is needed"), (3, "not_updatable", "not updatable: aaa, zzz"), (4, "empty", "at least one setting is needed")]
