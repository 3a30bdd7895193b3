"""Log parsing, filters, search and statistics on small hand-made rows."""

import json
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewatch.operators import logquery as lq
from tidewatch.operators.logquery import LogFilter, LogQuery
from tidewatch.sources import logs, textindex, writers

LINES = [
    '{"timestamp": "2024-01-01T10:00:00Z", "level": "INFO", "event_type": "topic.create", "user_id": "user1", "message": "Created topic a", "resource_type": "topic", "resource_id": "a", "details": {"n": 5, "s": "5", "ok": true, "deep": {"x": "y"}}}',
    '{"timestamp": "2024-01-01T11:00:00+01:00", "level": "ERROR", "event_type": "api.error", "user_id": "user2", "message": "Failed 50%_done", "resource_type": "cluster", "resource_id": "c1", "details": {"n": "abc", "s": 5}}',
    '{"timestamp": "2024-01-01T12:00:00Z", "level": "INFO", "event_type": "topic.delete", "message": "Deleted topic b", "details": {"n": null}}',
    "2024-01-01 13:00:00 [WARNING] app.core: disk: nearly full",
    "2024-13-01 13:00:00 [WARNING] app.core: bad month",
    "not a log line", '{"broken": ', "[1, 2]", "",
]


@pytest.fixture(scope="module")
def parsed(spark):
    lines = spark.createDataFrame([(i, text) for i, text in enumerate(LINES)], "id INT, line STRING")
    return logs.parse(lines).cache()


@pytest.fixture(scope="module")
def log(parsed):
    return logs.records(parsed)


@pytest.mark.parametrize("line", ['{"a": 1} {"b": 2}', '{"a": 1}, {"b": 2}', '{"a": 1} tail }', "{'a': 1}", '{"a": 1,}', "{}", "{ }", '"text"', "12", "null"])
def test_not_one_json_object(spark, line):
    parsed = logs.parse(spark.createDataFrame([(line,)], "line STRING"))
    assert logs.records(parsed).count() == 0 and rows(logs.rejected(parsed), "line") == [(line,)]


def test_whole_object_is_kept_on_request(spark):
    parsed = logs.parse(spark.createDataFrame([('{"level": "INFO", "extra": {"x": 7}}',)], "line STRING"), rest=True)
    assert ids_of(lq.where(parsed, LogQuery(filters=(LogFilter("body.extra.x", "gt", 6),)))) == ["INFO"]


def ids_of(df):
    return [r["level"] for r in df.select("level").collect()]


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_parse(parsed, log):
    assert rows(log, "id", "layout", "level") == [(0, "json", "INFO"), (1, "json", "ERROR"), (2, "json", "INFO"), (3, "text", "WARNING")]
    assert ids(logs.rejected(parsed)) == [4, 5, 6, 7, 8]
    text = log.where("id = 3").first()
    assert (text["timestamp"], text["logger"], text["message"]) == ("2024-01-01T13:00:00", "app.core", "disk: nearly full")
    assert {r["id"]: r["ts"] for r in log.collect()}[1] == datetime(2024, 1, 1, 10, 0)


@pytest.mark.parametrize("spec, want", [
    (LogFilter("level", "eq", "INFO"), [0, 2]),
    (LogFilter("level", "eq", "info"), []),
    (LogFilter("level", "eq", "info", False), [0, 2]),
    (LogFilter("user_id", "ne", "user1"), [1, 2, 3]),
    (LogFilter("no_such_field", "ne", 1), [0, 1, 2, 3]),
    (LogFilter("no_such_field", "eq", None), []),
    (LogFilter("message", "contains", "%_"), [1]),
    (LogFilter("message", "contains", "TOPIC", False), [0, 2]),
    (LogFilter("user_id", "not_contains", "1"), [1]),
    (LogFilter("event_type", "starts_with", "topic."), [0, 2]),
    (LogFilter("event_type", "ends_with", "ERROR", False), [1]),
    (LogFilter("details.n", "gt", "4"), [0]),
    (LogFilter("details.n", "lte", 5), [0]),
    (LogFilter("details.n", "lt", "many"), []),
    (LogFilter("details.n", "gte", float("nan")), []),
    (LogFilter("details.n", "eq", 5), [0]),
    (LogFilter("details.s", "eq", 5), [1]),
    (LogFilter("details.s", "eq", "5"), [0]),
    (LogFilter("details.s", "contains", "5"), [0, 1]),
    (LogFilter("details.ok", "eq", True), [0]),
    (LogFilter("details.ok", "contains", "True"), [0]),
    (LogFilter("details.deep.x", "eq", "y"), [0]),
    (LogFilter("details.s", "in", ["5", 7]), [0]),
    (LogFilter("level", "in", ["ERROR", "WARNING", 3]), [1, 3]),
    (LogFilter("level", "in", "ERROR"), []),
    (LogFilter("user_id", "not_in", ["user1"]), [1]),
    (LogFilter("user_id", "not_in", "user1"), [0, 1]),
    (LogFilter("message", "regex", "^(?P<verb>Created|Deleted)"), [0, 2]),
    (LogFilter("message", "regex", "FAILED", False), [1]),
    (LogFilter("message", "regex", "(unclosed"), []),
])
def test_filters(log, spec, want):
    assert ids(lq.where(log, LogQuery(filters=(spec,)))) == want


def test_unknown_operator(log):
    with pytest.raises(ValueError):
        lq.predicate(log, LogFilter("level", "like", "x"))


def test_time_range_is_inclusive_and_passes_missing(spark, log):
    timed = log.withColumn("ts", F.when(F.col("id") != 3, F.col("ts")))
    query = LogQuery(start=datetime(2024, 1, 1, 10), end=datetime(2024, 1, 1, 12))
    assert ids(lq.where(timed, query)) == [0, 1, 2, 3]
    assert ids(lq.where(timed, LogQuery(start=datetime(2024, 1, 1, 12), end=datetime(2024, 1, 1, 12)))) == [2, 3]


def test_order_and_pages(log):
    by_user = LogQuery(sort_field="user_id", descending=False)
    assert [r["id"] for r in lq.run(log, by_user, key=["id"]).collect()] == [2, 3, 0, 1]
    newest = [r["id"] for r in lq.run(log, LogQuery(), key=["id"]).collect()]
    assert newest == [3, 2, 0, 1]
    assert [r["id"] for r in lq.run(log, LogQuery(limit=2, offset=1), key=["id"]).collect()] == newest[1:3]
    assert [r["id"] for r in lq.run(log, LogQuery(limit=0, offset=1), key=["id"]).collect()] == newest[1:]


def test_search_matches_before_it_limits(log):
    assert [r["id"] for r in lq.search(log, "topic", limit=1, key=["id"]).collect()] == [2]
    assert ids(lq.search(log, "C1|USER1", regex=True, key=["id"])) == [0, 1]
    assert ids(lq.search(log, "USER1", case_sensitive=True, key=["id"])) == []


def test_statistics(log):
    got = {(r["section"], r["value"]): r["n"] for r in lq.statistics(log).collect()}
    assert got == {("total", "all"): 4, ("level", "INFO"): 2, ("level", "ERROR"): 1, ("level", "WARNING"): 1,
                   ("event_type", "topic.create"): 1, ("event_type", "topic.delete"): 1, ("event_type", "api.error"): 1, ("event_type", "unknown"): 1,
                   ("user_id", "user1"): 1, ("user_id", "user2"): 1, ("user_id", "unknown"): 2, ("resource_type", "topic"): 1, ("resource_type", "cluster"): 1}
    assert rows(lq.count_by(log, "details.n")) == [("5", 1), ("abc", 1)]
    assert lq.time_span(log).first()["duration_seconds"] == 10800.0


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id AS event_id", "concat('u', id) AS user_id", "concat('c', id) AS other", "id * 1.5D AS value").write.parquet(path)
    table = spark.read.parquet(path)
    for spec, pushed in [(LogFilter("user_id", "starts_with", "u1"), "StringStartsWith(user_id,u1)"),
                         (LogFilter("other", "in", ["c1", "c2"]), "In(other, [c1,c2])"),
                         (LogFilter("value", "gt", 1), "GreaterThan(value,1.0)"),
                         (LogFilter("user_id", "eq", "u1"), "EqualTo(user_id,u1)")]:
        plan = lq.where(table, LogQuery(filters=(spec,))).select("event_id")._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan[plan.index("PushedFilters"):]
        assert spec.field in plan[plan.index("ReadSchema"):] and plan[plan.index("ReadSchema"):].count(":") == 3


@pytest.mark.parametrize("limit, offset", [(7, 3), (None, 5), (500, 0), (100, 333), (None, 2000), (3, 999)])
def test_pages_equal_a_full_sort(spark, limit, offset):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 100).alias("v")).repartition(6)
    order = [F.desc("v"), F.asc("id")]
    want = [r["id"] for r in df.orderBy(*order).collect()][offset:][:limit]
    assert [r["id"] for r in lq.page(df, order, limit, offset).collect()] == want


def test_pages_by_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else i // 10, i) for i in range(100)], "k INT, id INT").repartition(5)
    want = [tuple(r) for r in lq.page(df, [F.asc("k")], None, 0).collect()]
    assert len(set(want)) == 100
    for limit, offset in ((None, 2), (None, 60), (7, 30), (5, 98)):
        assert [tuple(r) for r in lq.page(df, [F.asc("k")], limit, offset).collect()] == want[offset:][:limit]
    assert [tuple(r) for part in range(0, 100, 25) for r in lq.page(df, [F.asc("k")], 25, part).collect()] == want


@pytest.mark.parametrize("pattern", ["{", "a{b", "a{2}", "a{,2}b", "[[]", "[]x]", "[^]x]", "(?P<user_id>z)", "(?P<a_b>z)(?P=a_b)", "[a&&b]", "(z)\\1", "\\w+é", "^b$", "b\\Z", "x.y",
                                     "(?i)Z+", "(bad", "*", "\\{a\\}", "(?P<x>a)(?P<y>z)(?P=y)", "a|", "[\\]a]"])
@pytest.mark.parametrize("fold", [False, True])
def test_patterns_mean_the_same(spark, pattern, fold):
    texts = ["{", "a{b", "aab", "b", "b\n", "[", "]", "z", "zz", "azz", "&", "a&b", "éa", "x\ny", "x\ry", "ZZ", "{a}", "", "\x85"]
    try:
        test = re.compile(pattern, re.IGNORECASE if fold else 0)
        want = [bool(test.search(t)) for t in texts]
    except re.error:
        want = [False] * len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, message STRING")
    got = {r["id"] for r in df.where(lq.predicate(df, LogFilter("message", "regex", pattern, not fold))).collect()}
    assert [i in got for i in range(len(texts))] == want


def test_long_lists_mean_the_same_as_short_ones(spark, monkeypatch):
    """Typed membership on plain and nested fields, by join and in the plan, against a plain loop."""
    nested = ['{"k": 1}', '{"k": "1"}', '{"k": 1.0}', '{"k": 2.5}', '{"k": true}', '{"k": "true"}', '{"k": null}', "{}", "no json", None, '{"k": 9007199254740993}', '{"k": "a"}']
    data = [(i, i % 5, float(i) / 2, ("a", "b", None)[i % 3], i % 2 == 0, d) for i, d in enumerate(nested)]
    df = spark.createDataFrame(data, "id LONG, n INT, x DOUBLE, s STRING, b BOOLEAN, details STRING")
    mixed = [1, "1", 2.5, True, "a", 4, "zzz", 0.5]
    plain = {"n": lambda r: r[1], "x": lambda r: r[2], "s": lambda r: r[3], "b": lambda r: r[4]}

    def nested_value(row):
        try:
            return json.loads(row[5]).get("k")
        except (ValueError, TypeError):
            return None

    same = lambda a, b: type(a) is type(b) and a == b if isinstance(a, (str, bool)) or isinstance(b, (str, bool)) else a == b
    for path, value in [*plain.items(), ("details.k", nested_value)]:
        for op in ("in", "not_in"):
            want = {r[0] for r in data if value(r) is not None and any(same(value(r), v) for v in mixed) == (op == "in")}
            for bound in (0, 200):
                monkeypatch.setattr(lq, "LONG_LIST", bound)
                got = {r["id"] for r in lq.where(df, LogQuery(filters=(LogFilter(path, op, mixed),))).collect()}
                assert got == want, (path, op, bound)
    many = lq.where(df, LogQuery(filters=(LogFilter("details.k", "in", list(range(10_000))),)))
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.count("schema_of_variant") < 10


# --- trigram index ------------------------------------------------------------------------------

@pytest.mark.parametrize("pattern, want", [
    ("topic", ["topic"]), ("^abc.*defg$", ["abc", "defg"]), ("abcd?e", ["abc"]), ("abcd+efg", ["abcd", "efg"]), ("abcd{2,3}x", ["abc"]), ("abc|def", []),
    (r"key \d+ of", ["key ", " of"]), (r"key 1[0-4]$", ["key 1"]), ("(abc)def", []), ("abc[|(x]defg", []), ("abcd*?efg", ["abc", "efg"]), ("", []), ("[]a]xyz", ["xyz"]),
])
def test_literals_of_patterns(pattern, want):
    assert textindex.literals(pattern) == want


def test_index_opens_only_files_that_can_match(spark, tmp_path):
    path, index = str(tmp_path / "log"), str(tmp_path / "index")
    texts = ["orders RETRY 17", "payment failed", None, "", "ab", "\u212aelvin \u0130stanbul", "stra\u00dfe \U0001f600 ok", "broken pipe"]
    day = datetime(2024, 1, 1)
    log = spark.createDataFrame([(i, day + timedelta(days=i), t, "u%d" % i) for i, t in enumerate(texts)], "event_id INT, ts TIMESTAMP_NTZ, message STRING, user_id STRING")
    writers.append_audit(log, path)
    textindex.build(spark, path, ["message", "user_id"], index)
    stored = spark.read.parquet(path)

    def check(needle, files, fold=True, known=None):
        less = textindex.narrowed(spark, path, known or index, {"message": [needle]}, fold)
        test = F.lower("message").contains(needle.lower()) if fold else F.col("message").contains(needle)
        assert rows(less.where(test), "event_id", "event_date") == rows(stored.where(test), "event_id", "event_date")
        assert len(less.inputFiles()) == files, needle

    check("retry 1", 1), check("failed", 1), check("kelvin", 1), check("istan", 1), check("nowhere", 0), check("ab", 8)
    check("stra\u00df", 1, False), check("\U0001f600 ok", 1, False), check("\u00dfe \U0001f600", 8)
    either = textindex.narrowed(spark, path, index, {"message": ["failed"], "user_id": ["failed"]}, every=False)
    assert len(either.inputFiles()) == 1
    pattern = "^bro.*pipe$"
    assert len(textindex.narrowed(spark, path, index, {"message": textindex.literals(pattern)}).inputFiles()) == 1

    # A day that is not indexed yet is read; building it again changes no other day.
    writers.append_audit(spark.createDataFrame([(99, day + timedelta(days=1, hours=2), "late RETRY 1", "u")], log.schema), path)
    stored = spark.read.parquet(path)
    check("retry 1", 2), check("failed", 2)
    textindex.build(spark, path, ["message", "user_id"], index, within=F.col("event_date") == (day + timedelta(days=1)).date())
    check("retry 1", 2), check("failed", 1), check("broken", 1)
