"""Log search, statistics, ordering and paging."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.operators import logquery as lq
from tidewatch.operators.logquery import LogFilter as Fl
from tidewatch.operators.logquery import LogQuery
from tidewatch.plans.registry import Registry
from tidewatch.plans.views import check_sql, view
from tidewatch.session import scratch_dir
from tidewatch.sources import textindex, writers

REG = Registry()
COLUMNS = ["event_id", "ts", "event_type", "level", "user_id", "resource_type", "resource_id", "duration_ms"]
LIST = ", ".join(COLUMNS)
AS_OF = datetime(2024, 1, 30, 12, 0, 0)


def _filter(key, spec, condition):
    @REG.query(key, check_sql("audit_log", f"SELECT {LIST} FROM audit_log WHERE {condition}"))
    def run(spark, sf_dir):
        specs = spec if isinstance(spec, tuple) else (spec,)
        return lq.where(view(spark, sf_dir, "audit_log"), LogQuery(filters=specs)).select(*COLUMNS)


_filter("f01_eq", Fl("event_type", "eq", "topic.create"), "event_type = 'topic.create'")
_filter("f02_ne", Fl("user_id", "ne", "user8"), "user_id IS NULL OR user_id <> 'user8'")
_filter("f03_contains", Fl("resource_id", "contains", "/topic1"), "contains(resource_id, '/topic1')")
_filter("f04_not_contains", Fl("resource_id", "not_contains", "topic"), "resource_id IS NOT NULL AND NOT contains(resource_id, 'topic')")
_filter("f05_starts_with", Fl("resource_id", "starts_with", "c3/"), "starts_with(resource_id, 'c3/')")
_filter("f06_ends_with", Fl("event_type", "ends_with", ".list"), "ends_with(event_type, '.list')")
_filter("f07_gt", Fl("duration_ms", "gt", "150"), "duration_ms > 150")
_filter("f08_lt", Fl("duration_ms", "lt", 5.5), "duration_ms < 5.5")
_filter("f09_gte", Fl("details.k", "gte", 90), "CAST(json_extract_string(details, '$.k') AS BIGINT) >= 90")
_filter("f10_lte", Fl("details.k", "lte", "9"), "CAST(json_extract_string(details, '$.k') AS BIGINT) <= 9")
_filter("f11_in", Fl("level", "in", ["ERROR", "CRITICAL"]), "level IN ('ERROR', 'CRITICAL')")
_filter("f12_not_in", Fl("resource_type", "not_in", ["topic"]), "resource_type IS NOT NULL AND resource_type NOT IN ('topic')")
#: 10,000 values each, on a plain and on a nested field.
_filter("f11_in_long_list", (Fl("user_id", "in", [f"user{i}" for i in range(0, 20_000, 2)]), Fl("details.k", "in", list(range(20, 10_020)))),
        "CAST(substr(user_id, 5) AS BIGINT) % 2 = 0 AND CAST(json_extract_string(details, '$.k') AS BIGINT) BETWEEN 20 AND 10019")
_filter("f12_not_in_long_list", (Fl("user_id", "not_in", [f"user{i}" for i in range(0, 20_000, 2)]), Fl("details.k", "not_in", list(range(50, 10_050)))),
        "user_id IS NOT NULL AND CAST(substr(user_id, 5) AS BIGINT) % 2 <> 0 AND CAST(json_extract_string(details, '$.k') AS BIGINT) < 50")
_filter("f13_regex", Fl("resource_id", "regex", r"^c[12]/topic\d$"), r"regexp_matches(resource_id, '^c[12]/topic\d$')")
_filter("f14_nested", Fl("details.k", "eq", 42), "CAST(json_extract_string(details, '$.k') AS BIGINT) = 42")


def _stored(spark, sf_dir):
    """The audit log as ingest stores it: a folder per day, details as shredded VARIANT."""
    folder = scratch_dir(spark, "audit")
    writers.append_audit(view(spark, sf_dir, "audit_log"), folder, nested=["details"])
    return spark.read.parquet(folder)


@REG.query("f14_nested_stored", check_sql("audit_log", f"""SELECT {LIST} FROM audit_log
    WHERE CAST(json_extract_string(details, '$.k') AS BIGINT) IN (7, 42) AND CAST(json_extract_string(details, '$.k') AS BIGINT) >= 9"""))
def f14_stored(spark, sf_dir):
    filters = (Fl("details.k", "in", [7, 42]), Fl("details.k", "gte", 9))
    return lq.where(_stored(spark, sf_dir), LogQuery(filters=filters)).select(*COLUMNS)


@REG.query("a01_count_by_stored_path", check_sql("audit_log", """
    SELECT json_extract_string(details, '$.k') AS value, count(*) AS n FROM audit_log WHERE json_extract_string(details, '$.k') IS NOT NULL GROUP BY 1"""))
def a01_stored(spark, sf_dir):
    rows = _stored(spark, sf_dir)
    value = lq.resolve(rows, "details.k").text
    return rows.select(value.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))


_filter("f15_ignore_case", (Fl("event_type", "contains", "TOPIC.", False), Fl("level", "eq", "warning", False)),
        "contains(event_type, 'topic.') AND level = 'WARNING'")
_filter("f16_and", (Fl("level", "eq", "INFO"), Fl("resource_type", "eq", "topic"), Fl("duration_ms", "gte", 20)),
        "level = 'INFO' AND resource_type = 'topic' AND duration_ms >= 20")


@REG.query("f17_time_range", check_sql("audit_log", f"""SELECT {LIST} FROM audit_log
    WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'"""))
def f17(spark, sf_dir):
    query = LogQuery(start=datetime(2024, 1, 10), end=datetime(2024, 1, 20, 12))
    return lq.where(view(spark, sf_dir, "audit_log"), query).select(*COLUMNS)


_SPAN = "ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL '{h}' HOUR AND ts <= TIMESTAMP '2024-01-30 12:00:00'"


def _built(key, query, hours, condition):
    @REG.query(key, check_sql("audit_log", f"SELECT {LIST} FROM audit_log WHERE {_SPAN.format(h=hours)} {condition}"))
    def run(spark, sf_dir):
        return lq.run(view(spark, sf_dir, "audit_log"), query).select(*COLUMNS)


_built("f18_last_hours", lq.last_hours(24, AS_OF), 24, "")
_built("f19_user_activity", lq.user_activity("user8", 336, AS_OF), 336, "AND user_id = 'user8'")
_built("f20_error_logs", lq.error_logs(48, AS_OF), 48, "AND level IN ('ERROR', 'CRITICAL')")
_built("f21_resource_activity", lq.resource_activity("topic", "c4/topic9", 600, AS_OF), 600,
       "AND resource_type = 'topic' AND resource_id = 'c4/topic9'")


@REG.query("f22_search", check_sql("audit_log", f"""SELECT {LIST} FROM audit_log
    WHERE contains(lower(message), 'key 7') OR contains(lower(user_id), 'key 7')
       OR contains(lower(resource_id), 'key 7') OR contains(lower(event_type), 'key 7')
    ORDER BY ts DESC, event_id LIMIT 100"""))
def f22(spark, sf_dir):
    return lq.search(view(spark, sf_dir, "audit_log"), "KEY 7").select(*COLUMNS)


def _indexed(spark, sf_dir, columns, texts, every=True):
    """The stored audit log without the files that an index of the columns rules out for the texts."""
    folder, index = scratch_dir(spark, "audit"), scratch_dir(spark, "index")
    writers.append_audit(view(spark, sf_dir, "audit_log"), folder)
    textindex.build(spark, folder, columns, index)
    return textindex.narrowed(spark, folder, index, {c: texts for c in columns}, every=every)


@REG.query("f03_contains_indexed", check_sql("audit_log", f"SELECT {LIST} FROM audit_log WHERE contains(resource_id, '/topic1')"))
def f03_indexed(spark, sf_dir):
    query = LogQuery(filters=[Fl("resource_id", "contains", "/topic1")])
    return lq.where(_indexed(spark, sf_dir, ["resource_id"], ["/topic1"]), query).select(*COLUMNS)


@REG.query("f22_search_indexed", check_sql("audit_log", f"""SELECT {LIST} FROM audit_log
    WHERE contains(lower(message), 'key 7') OR contains(lower(user_id), 'key 7')
       OR contains(lower(resource_id), 'key 7') OR contains(lower(event_type), 'key 7')
    ORDER BY ts DESC, event_id LIMIT 100"""))
def f22_indexed(spark, sf_dir):
    return lq.search(_indexed(spark, sf_dir, lq.SEARCH_FIELDS, ["KEY 7"], every=False), "KEY 7").select(*COLUMNS)


@REG.query("f22_search_regex", check_sql("audit_log", f"""SELECT {LIST} FROM audit_log
    WHERE coalesce(regexp_matches(message, 'key 1[0-4]$'), FALSE) OR coalesce(regexp_matches(resource_id, 'key 1[0-4]$'), FALSE)
    ORDER BY ts DESC, event_id LIMIT 50"""))
def f22_regex(spark, sf_dir):
    return lq.search(view(spark, sf_dir, "audit_log"), "key 1[0-4]$", ("message", "resource_id"), True, True, 50).select(*COLUMNS)


@REG.query("a01_count_by_field", check_sql("audit_log", """
    SELECT resource_id AS value, count(*) AS n FROM audit_log WHERE resource_id IS NOT NULL GROUP BY 1"""))
def a01(spark, sf_dir):
    return lq.count_by(view(spark, sf_dir, "audit_log"), "resource_id")


@REG.query("a01_count_by_nested", check_sql("audit_log", """
    SELECT json_extract_string(details, '$.k') AS value, count(*) AS n FROM audit_log GROUP BY 1"""))
def a01_nested(spark, sf_dir):
    return lq.count_by(view(spark, sf_dir, "audit_log"), "details.k")


_STATS = """
    SELECT {p} 'total' AS section, 'all' AS value, count(*) AS n FROM audit_log {g0}
    UNION ALL SELECT {p} 'level', level, count(*) FROM audit_log GROUP BY {g} level
    UNION ALL SELECT {p} 'event_type', event_type, count(*) FROM audit_log GROUP BY {g} event_type
    UNION ALL SELECT {p} 'user_id', coalesce(user_id, 'unknown'), count(*) FROM audit_log GROUP BY {g} coalesce(user_id, 'unknown')
    UNION ALL SELECT {p} 'resource_type', resource_type, count(*) FROM audit_log WHERE resource_type <> '' GROUP BY {g} resource_type"""
_FIELDS = """
    UNION ALL SELECT {p} 'field:operation_result', operation_result, count(*) FROM audit_log GROUP BY {g} operation_result
    UNION ALL SELECT {p} 'field:details.k', json_extract_string(details, '$.k'), count(*) FROM audit_log
    GROUP BY {g} json_extract_string(details, '$.k')"""


def _stats_sql(period, fields):
    p = f"date_trunc('{period}', ts) AS period_start," if period else ""
    g = f"date_trunc('{period}', ts)," if period else ""
    text = (_STATS + (_FIELDS if fields else "")).format(p=p, g=g, g0=f"GROUP BY {g[:-1]}" if g else "")
    return check_sql("audit_log", text)


@REG.query("a02_statistics", _stats_sql(None, False))
def a02(spark, sf_dir):
    return lq.statistics(view(spark, sf_dir, "audit_log"))


@REG.query("a03_time_span", check_sql("audit_log", """
    SELECT min(ts) AS start_ts, max(ts) AS end_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_seconds FROM audit_log"""))
def a03(spark, sf_dir):
    return lq.time_span(view(spark, sf_dir, "audit_log"))


@REG.query("a04_period_rollup", _stats_sql(None, True).replace(
    "FROM events)", "FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-12 00:00:00')"))
def a04(spark, sf_dir):
    rows = lq.where(view(spark, sf_dir, "audit_log"), LogQuery(start=datetime(2024, 1, 5), end=datetime(2024, 1, 12)))
    return lq.rollup(rows, ["operation_result", "details.k"])


@REG.query("a05_daily_rollup", _stats_sql("day", True))
def a05(spark, sf_dir):
    return lq.rollup(view(spark, sf_dir, "audit_log"), ["operation_result", "details.k"], "1 day")


@REG.query("a06_hourly_rollup", _stats_sql("hour", True))
def a06(spark, sf_dir):
    return lq.rollup(view(spark, sf_dir, "audit_log"), ["operation_result", "details.k"], "1 hour")


@REG.query("flagship_hourly_errors", check_sql("audit_log", """
    SELECT date_trunc('hour', ts) AS hour, level, coalesce(resource_type, 'none') AS resource_type, count(*) AS n
    FROM audit_log WHERE level IN ('ERROR', 'CRITICAL') AND ts >= TIMESTAMP '2024-01-02 00:00:00' GROUP BY 1, 2, 3"""))
def flagship(spark, sf_dir):
    query = LogQuery(filters=(Fl("level", "in", ["ERROR", "CRITICAL"]),), start=datetime(2024, 1, 2))
    rows = lq.where(view(spark, sf_dir, "audit_log"), query)
    return (rows.groupBy(F.window("ts", "1 hour").getField("start").alias("hour"), "level",
                         F.coalesce("resource_type", F.lit("none")).alias("resource_type"))
            .agg(F.count("*").alias("n")).orderBy("hour", "level", "resource_type"))


@REG.query("l01_sort_by_field", check_sql("audit_log", """
    SELECT event_id, user_id, resource_id FROM audit_log ORDER BY coalesce(resource_id, ''), event_id"""))
def l01(spark, sf_dir):
    query = LogQuery(sort_field="resource_id", descending=False)
    return lq.run(view(spark, sf_dir, "audit_log"), query).select("event_id", "user_id", "resource_id")


@REG.query("l02_page", check_sql("audit_log", f"SELECT {LIST} FROM audit_log ORDER BY ts DESC, event_id LIMIT 50 OFFSET 200"))
def l02(spark, sf_dir):
    return lq.run(view(spark, sf_dir, "audit_log"), LogQuery(limit=50, offset=200)).select(*COLUMNS)


@REG.query("l02_offset_without_limit", check_sql("audit_log", """
    SELECT event_id, ts, level FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id) AS rn FROM audit_log) WHERE rn > 120"""))
def l02_rest(spark, sf_dir):
    return lq.run(view(spark, sf_dir, "audit_log"), LogQuery(offset=120)).select("event_id", "ts", "level")


@REG.query("l03_newest", check_sql("audit_log", f"SELECT {LIST} FROM audit_log ORDER BY ts DESC, event_id LIMIT 100"))
def l03(spark, sf_dir):
    return lq.run(view(spark, sf_dir, "audit_log"), LogQuery(limit=100)).select(*COLUMNS)
