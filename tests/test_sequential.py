"""Replays, windows over segments and quantiles on skewed data, against plain loops."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewatch.operators import sequential
from tidewatch.operators import quantiles
from tidewatch.operators.quantiles import exact_quantiles, load_periods, load_report
from tidewatch.operators.ranking import latest, newest
from tidewatch.operators.segments import PART, last_streak, ordered_events, ordered_parts, running_max, sessions, streak, trailing_count
from tidewatch.operators.sequential import BreakerConfig, admit, replay_breakers
from tidewatch.streaming import jobs

START = datetime(2024, 1, 1)


def skewed(spark, seed, n=1500, span=4000, bursts=True):
    """Events of which one key holds over a third, partly in bursts and with equal times."""
    r = random.Random(seed)
    data, at = [], 0.0
    for i in range(n):
        key = "hot" if r.random() < 0.4 else f"k{r.randrange(6)}"
        at += 0 if r.random() < 0.1 else (r.choice([0.2, 1, 30, 400]) if bursts else span / n)
        data.append((i, key, START + timedelta(seconds=round(at, 1)), r.random() < 0.4, r.choice([1.0, 2.0, r.random() * 100])))
    return data, spark.createDataFrame(data, "id LONG, key STRING, ts TIMESTAMP_NTZ, failed BOOLEAN, value DOUBLE").repartition(5)


def admit_loop(data, limit, window):
    passed, out = {}, {}
    for i, key, ts, *_ in sorted(data, key=lambda d: (d[2], d[0])):
        recent = [t for t in passed.get(key, []) if t > ts - timedelta(seconds=window)]
        out[i] = len(recent) < limit
        passed[key] = recent + [ts] if out[i] else recent
    return out


@pytest.mark.parametrize("seed, limit, window", [(1, 3, 60), (2, 1, 10), (3, 10, 300), (4, 2, 1), (5, 1000, 60)])
def test_admission_equals_loop(spark, seed, limit, window):
    data, df = skewed(spark, seed)
    got = {r["id"]: r["admitted"] for r in admit(df, ["key"], "ts", ["id"], limit, window, parts=seed % 2 * 9).collect()}
    assert got == admit_loop(data, limit, window)


def test_admission_with_null_key(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a", START + timedelta(seconds=i)) for i in range(20)], "id LONG, key STRING, ts TIMESTAMP_NTZ")
    got = [r["id"] for r in admit(df, ["key"], "ts", ["id"], 1, 6).where("admitted").orderBy("id").collect()]
    assert got == [0, 1, 6, 7, 12, 13, 18, 19]


def breaker_loop(data, config):
    state, out = {}, {}
    for i, key, ts, failed, _ in sorted(data, key=lambda d: (d[2], d[0])):
        s = state.setdefault(key, {"mode": "closed", "bad": 0, "good": 0, "last": None})
        if s["mode"] == "open" and ts - s["last"] >= timedelta(seconds=config.recovery_seconds):
            s["mode"], s["good"] = "half_open", 0
        allowed = s["mode"] != "open"
        if allowed and failed:
            s["last"], s["bad"] = ts, s["bad"] + 1
            if s["mode"] == "half_open" or s["bad"] >= config.failure_threshold:
                s["mode"] = "open"
        elif allowed and s["mode"] == "half_open":
            s["good"] += 1
            if s["good"] >= config.success_threshold:
                s["mode"], s["bad"] = "closed", 0
        elif allowed:
            s["bad"] = 0
        out[i] = (allowed, s["mode"])
    return out


@pytest.mark.parametrize("seed, config", [(1, BreakerConfig(2, 60, 2)), (2, BreakerConfig(3, 5, 1)), (3, BreakerConfig(1, 600, 3)), (4, BreakerConfig())])
def test_breaker_equals_loop(spark, seed, config):
    data, df = skewed(spark, seed)
    got = {r["id"]: (r["allowed"], r["state"]) for r in replay_breakers(df, ["key"], "ts", ["id"], F.col("failed"), config, parts=seed % 2 * 9).collect()}
    assert got == breaker_loop(data, config)


def _one_file_at_a_time(spark, data, path, files):
    """The events in files that are not in time order, one micro-batch each."""
    schema = "id LONG, key STRING, ts TIMESTAMP_NTZ, failed BOOLEAN, value DOUBLE"
    for chunk in files(sorted(data, key=lambda d: (d[2], d[0]))):
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(path)
    return lambda: jobs.stream_table(spark, path, max_bytes=1)


def _shuffled(rows, size=200):
    chunks = [rows[i:i + size] for i in range(0, len(rows), size)]
    return [chunks[1], *chunks[3:], chunks[0], chunks[2]]


@pytest.mark.parametrize("lateness", [None, 10 ** 7])
def test_streamed_replays_equal_loops(spark, tmp_path, lateness):
    data, _ = skewed(spark, 11, n=800)
    stream = _one_file_at_a_time(spark, data, str(tmp_path / "events"), _shuffled)
    admitted = jobs.admission(str(tmp_path / "a"), ["key"], "ts", ["id"], 3, 60, lateness=lateness).run(stream())
    assert {r["id"]: r["admitted"] for r in admitted.collect()} == admit_loop(data, 3, 60)
    config = BreakerConfig(2, 60, 2)
    calls = jobs.breakers(str(tmp_path / "b"), "key", "ts", ["id"], F.col("failed"), config, lateness=lateness).run(stream())
    assert {r["id"]: (r["allowed"], r["state"]) for r in calls.collect()} == breaker_loop(data, config)


def test_replay_decides_as_time_passes(spark, tmp_path):
    data, _ = skewed(spark, 13, n=800)
    stream = _one_file_at_a_time(spark, data, str(tmp_path / "events"), lambda rows: [rows[i:i + 200] for i in range(0, 800, 200)])
    replay = jobs.admission(str(tmp_path / "a"), ["key"], "ts", ["id"], 3, 60, lateness=30)
    replay.start(stream()).awaitTermination()
    assert 600 < replay.outcomes(spark).count() < 800
    replay.finish(spark)
    assert {r["id"]: r["admitted"] for r in replay.outcomes(spark).collect()} == admit_loop(data, 3, 60)
    assert replay.late(spark).count() == 0


def test_answers_tell_whether_the_stream_was_running(spark, tmp_path):
    data, _ = skewed(spark, 13, n=800)
    stream = _one_file_at_a_time(spark, data, str(tmp_path / "events"), lambda rows: [rows[i:i + 200] for i in range(0, 800, 200)])
    replay = jobs.admission(str(tmp_path / "a"), ["key"], "ts", ["id"], 3, 60, lateness=30)
    replay.run(stream())
    times = {d[0]: d[2] for d in data}
    edge = max(times.values()) - timedelta(seconds=30)
    found = {r["id"]: r["running"] for r in replay.outcomes(spark, running="running").collect()}
    assert found == {i: t <= edge for i, t in times.items()}


def test_late_rows_are_kept_apart(spark, tmp_path):
    data = [(i, "k", START + timedelta(hours=h), False, 0.0) for i, h in enumerate((0, 10, 5, 20))]
    stream = _one_file_at_a_time(spark, data, str(tmp_path / "events"), lambda rows: [[data[0]], [data[1]], [data[2]], [data[3]]])
    replay = jobs.admission(str(tmp_path / "a"), ["key"], "ts", ["id"], 1, 60, lateness=60)
    assert {r["id"] for r in replay.run(stream()).collect()} == {0, 1, 3}
    assert [r["id"] for r in replay.late(spark).collect()] == [2]


def test_standing_results_do_not_depend_on_batches(spark, tmp_path):
    data, df = skewed(spark, 12, n=800)
    stream = _one_file_at_a_time(spark, data, str(tmp_path / "events"), _shuffled)
    counts = df.groupBy(F.window("ts", "1 hour").getField("start").alias("period_start"), "key").agg(F.count("*").alias("n"))
    runs = sessions(df, "key", "ts", 300, {"failures": F.col("failed")})
    for name, job, want in (("c", jobs.period_counts("1 hour", ["key"]), counts), ("s", jobs.sessions("key", 300, {"failures": F.col("failed")}), runs)):
        folder = str(tmp_path / name)
        jobs.keep_standing(stream(), folder, job).awaitTermination()
        before = rows(jobs.read_standing(spark, folder, job), *want.columns)
        assert before == rows(want, *want.columns)
        jobs.compact(spark, folder, job)
        jobs.compact(spark, folder, job)
        assert rows(jobs.read_standing(spark, folder, job), *want.columns) == before


def test_positions_of_a_hot_key(spark):
    data, df = skewed(spark, 27)
    df = df.withColumn("key", F.lit("only"))
    got = ordered_events(df, "key", ["ts", "id"], ["value"], parts=6)
    assert [r["id"] for r in got.orderBy("position").collect()] == [d[0] for d in sorted(data, key=lambda d: (d[2], d[0]))]
    assert got.agg(F.max("position")).first()[0] == len(data)


def test_streak_equals_plain_window(spark):
    data, df = skewed(spark, 21)
    run, want = {}, {}
    for i, key, ts, failed, _ in sorted(data, key=lambda d: (d[2], d[0])):
        run[key] = run.get(key, 0) + 1 if failed else 0
        want[i] = run[key]
    got = streak(df, ["key"], ["ts", "id"], F.col("failed"), parts=7)
    assert {r["id"]: r["streak"] for r in got.collect()} == want


def test_last_streak_equals_the_end_of_the_streaks(spark):
    _, df = skewed(spark, 27)
    failed = F.col("value") > 1
    want = latest(streak(df, ["key"], ["ts", "id"], failed), ["key"], ["ts", "id"], keep=["streak"])
    assert rows(last_streak(df, ["key"], ["ts", "id"], failed), "key", "streak") == rows(want, "key", "streak")
    odd = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 1, False), (None, 1, False), (None, 2, True), ("n", 1, None), ("u", 1, True), ("u", 2, None), ("u", 3, True)],
                                "key STRING, at INT, failed BOOLEAN")
    got = last_streak(odd, ["key"], ["at"], F.col("failed"))
    assert {r["key"]: r["streak"] for r in got.collect()} == {"a": 2, "b": 0, None: 1, "n": 0, "u": 2}
    assert last_streak(odd.limit(0), ["key"], ["at"], F.col("failed")).collect() == []


@pytest.mark.parametrize("current", [True, False])
def test_running_max_equals_plain_window(spark, current):
    _, df = skewed(spark, 22)
    window = W.partitionBy("key").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0 if current else -1)
    want = df.withColumn("top", F.max("value").over(window))
    got = running_max(df, ["key"], ["ts", "id"], {"top": F.col("value")}, current, parts=7)
    assert rows(got, "id", "top") == rows(want, "id", "top")


@pytest.mark.parametrize("seconds, parts", [(60, 7), (60, 0), (7200, 7)])
def test_trailing_count_equals_plain_window(spark, seconds, parts):
    _, df = skewed(spark, 23)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    want = df.withColumn("recent", F.count("*").over(W.partitionBy("key").orderBy(at).rangeBetween(-seconds * 1_000_000, 0)))
    got = trailing_count(df, ["key"], "ts", seconds, parts=parts)
    assert rows(got, "id", "recent") == rows(want, "id", "recent")


def test_newest_and_latest(spark):
    data, df = skewed(spark, 24)
    want = {}
    for d in sorted(data, key=lambda d: (d[2], d[0]), reverse=True):
        want.setdefault(d[1], []).append(d[0])
    got = newest(df, ["key"], [F.desc("ts"), F.desc("id")], 20, ["id"], salts=7)
    assert rows(got, "key", "rn", "id") == sorted(((k, i + 1, v) for k, ids in want.items() for i, v in enumerate(ids[:20])), key=lambda r: tuple((True, str(v)) for v in r))
    assert rows(latest(df, ["key"], ["ts", "id"]), "key", "id") == sorted((k, ids[0]) for k, ids in want.items())


@pytest.mark.parametrize("margin", [0.002, 0.2, 0.0])
def test_quantiles_equal_statistics(spark, margin):
    data, df = skewed(spark, 25)
    more = spark.createDataFrame([("one", 7.5), ("two", 1.0), ("two", 5.0), (None, 2.0), (None, 4.0), (None, 9.0), ("none", None)], "key STRING, value DOUBLE")
    values = df.select("key", "value").unionByName(more)
    groups = {}
    for r in values.collect():
        groups.setdefault(r["key"], []).append(r["value"])
    got = exact_quantiles(values, ["key"], "value", {"p50": (1, 2), "p95": (19, 20), "p99": (99, 100)}, margin=margin)
    result = {r["key"]: r for r in got.collect()}
    assert set(result) == set(groups)
    for key, v in groups.items():
        v = [x for x in v if x is not None]
        for name, n, at in (("p50", 2, 0), ("p95", 20, 18), ("p99", 100, 98)):
            want = None if not v else v[0] if len(v) == 1 else statistics.quantiles(v, n=n)[at]
            assert result[key][name] == (want if want is None else pytest.approx(want, abs=1e-9)), (key, name)


def test_quantiles_of_ties_and_odd_numbers(spark, monkeypatch):
    """Most values equal one, infinities and NaN; bounds that miss are widened until the ranks are exact."""
    nan, inf = float("nan"), float("inf")
    data = [("t", 5.0)] * 3000 + [("t", float(i)) for i in range(40)] + [("n", x) for x in [nan] * 30 + [inf, -inf] + [float(i % 7) for i in range(400)]]
    values = spark.createDataFrame(data, "key STRING, value DOUBLE").repartition(5)
    at = {"p50": (1, 2), "p95": (19, 20), "p99": (99, 100)}
    plain = {}
    for key, v in data:
        plain.setdefault(key, []).append(v)

    def check():
        got = {r["key"]: r for r in exact_quantiles(values, ["key"], "value", at).collect()}
        for key, v in plain.items():
            v = sorted(v, key=lambda x: (x != x, x))
            for name, (i, m) in at.items():
                j = max(1, min(i * (len(v) + 1) // m, len(v) - 1))
                d = i * (len(v) + 1) - j * m
                want = (v[j - 1] * (m - d) + v[j] * d) / m
                assert got[key][name] == pytest.approx(want, nan_ok=True), (key, name)

    check()
    monkeypatch.setattr(quantiles, "_bounds", lambda cut, fraction, cuts, margin: (
        F.lit(-inf if margin >= 1 else 5.5), F.lit(inf if margin >= 1 else 5.6)))
    check()


def test_load_report_from_periods(spark):
    data, df = skewed(spark, 26)
    ok, at = F.col("value") > 1, F.col("ts")
    whole = load_report(df, ["key"], ok, "value", at, at, {"p95": (19, 20)})
    periods = load_periods(df, ["key"], F.date_trunc("day", at), ok, "value", at, at)
    assert periods.count() > whole.count()
    columns = ["key", "operations", "successes", F.round("mean", 9).alias("mean"), F.round("throughput", 9).alias("throughput"), "p95"]
    assert rows(load_report(df, ["key"], ok, "value", at, at, {"p95": (19, 20)}, periods), *columns) == rows(whole, *columns)


def test_load_report(spark):
    data = [("a", True, 1.0, 0), ("a", True, 3.0, 5), ("a", False, 99.0, 10), ("b", False, 2.0, 0)]
    df = spark.createDataFrame([(k, ok, d, START + timedelta(seconds=s)) for k, ok, d, s in data], "g STRING, ok BOOLEAN, d DOUBLE, ts TIMESTAMP_NTZ")
    got = {r["g"]: r for r in load_report(df, ["g"], F.col("ok"), "d", F.col("ts"), F.col("ts"), {"p95": (19, 20)}).collect()}
    assert (got["a"]["operations"], got["a"]["successes"], got["a"]["mean"], got["a"]["throughput"]) == (3, 2, 2.0, 0.2)
    assert got["a"]["p95"] == pytest.approx(statistics.quantiles([1.0, 3.0], n=20)[18])
    assert (got["b"]["success_rate"], got["b"]["mean"], got["b"]["p95"]) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("gap, parts", [(30, 0), (300, 9), (30, 9), (400, 9), (10 ** 6, 5)])
def test_sessions_equal_loop_and_session_window(spark, gap, parts):
    data, df = skewed(spark, 26)
    want, last = {}, {}
    for i, key, ts, failed, _ in sorted(data, key=lambda d: (d[2], d[0])):
        runs = want.setdefault(key, [])
        if key not in last or ts - last[key] > timedelta(seconds=gap):
            runs.append([ts, ts, 0, 0])
        runs[-1][1:] = [ts, runs[-1][2] + 1, runs[-1][3] + failed]
        last[key] = ts
    expected = sorted((k, *r) for k, runs in want.items() for r in runs)
    got = sessions(df, "key", "ts", gap, {"failures": F.col("failed")}, parts=parts)
    assert sorted(tuple(r) for r in got.select("key", "started_at", "last_at", "events", "failures").collect()) == expected


def test_one_key_in_one_day_is_several_parts(spark):
    """All rows under one key and within minutes: every scan works in more than one part and equals the plain window."""
    n = 3000
    data = [(i, "only", START + timedelta(seconds=i // 3 * 0.2), i % 7 in (0, 3, 4), float(i * 37 % 101)) for i in range(n)]
    df = spark.createDataFrame(data, "id LONG, key STRING, ts TIMESTAMP_NTZ, failed BOOLEAN, value DOUBLE").repartition(4)
    sizes = ordered_parts(df, ["key", "ts", "id"], 8).groupBy(PART).count().collect()
    assert len(sizes) >= 6 and max(r["count"] for r in sizes) < n / 3
    run, want = 0, {}
    for i, _, _, failed, _ in data:
        run = run + 1 if failed else 0
        want[i] = run
    assert {r["id"]: r["streak"] for r in streak(df, ["key"], ["ts", "id"], F.col("failed"), parts=8).collect()} == want
    top = running_max(df, ["key"], ["ts", "id"], {"top": F.col("value")}, parts=8)
    assert {r["id"]: r["top"] for r in top.collect()} == {i: max(d[4] for d in data[:i + 1]) for i in range(n)}
    seconds = 60
    counted = trailing_count(df, ["key"], "ts", seconds, parts=8)
    assert {r["id"]: r["recent"] for r in counted.collect()} == {i: sum(d[2] <= t and d[2] >= t - timedelta(seconds=seconds) for d in data) for i, _, t, *_ in data}
    got = sessions(df, "key", "ts", 0.5, {"failures": F.col("failed")}, parts=8).collect()
    assert [(r["events"], r["failures"], r["started_at"], r["last_at"]) for r in got] == [(n, sum(d[3] for d in data), data[0][2], data[-1][2])]


def one_key(spark, n, seconds, seed=5):
    r = random.Random(seed)
    data = [(i, "only", START + timedelta(seconds=round(i * seconds, 3)), r.random() < 0.5, 0.0) for i in range(n)]
    return data, spark.createDataFrame(data, "id LONG, key STRING, ts TIMESTAMP_NTZ, failed BOOLEAN, value DOUBLE").repartition(5)


def tasks_of(spark, monkeypatch, run):
    """The result of ``run`` and how many segments its contended rows were replayed in."""
    seen = []
    real = sequential.entries
    monkeypatch.setattr(sequential, "entries", lambda *a: seen.append(real(*a)) or seen[-1])
    out = run()
    return out, seen[0].select(sequential.PART).distinct().count()


@pytest.mark.parametrize("limit, rounds", [(1, 6), (3, 6), (3, 0), (40, 1)])
def test_one_key_that_is_always_contended_is_replayed_in_segments(spark, monkeypatch, limit, rounds):
    """Evenly spaced rows, so that a wrong state never comes right by itself; also with no rounds to spare."""
    monkeypatch.setattr(sequential, "ROUNDS", rounds)
    data, df = one_key(spark, 1500, 0.7)
    got, segments = tasks_of(spark, monkeypatch, lambda: admit(df, ["key"], "ts", ["id"], limit, 60, parts=8))
    assert {r["id"]: r["admitted"] for r in got.collect()} == admit_loop(data, limit, 60)
    assert segments >= 6


@pytest.mark.parametrize("rounds", [6, 0])
@pytest.mark.parametrize("config", [BreakerConfig(2, 60, 2), BreakerConfig(3, 5, 1), BreakerConfig(1, 600, 3), BreakerConfig()])
def test_one_breaker_that_keeps_failing_is_replayed_in_segments(spark, monkeypatch, config, rounds):
    monkeypatch.setattr(sequential, "ROUNDS", rounds)
    data, df = one_key(spark, 1200, 0.4)
    got, segments = tasks_of(spark, monkeypatch, lambda: replay_breakers(df, ["key"], "ts", ["id"], F.col("failed"), config, parts=8))
    assert {r["id"]: (r["allowed"], r["state"]) for r in got.collect()} == breaker_loop(data, config)
    assert segments >= 6
    whole = replay_breakers(df, ["key"], "ts", ["id"], F.col("failed"), config, parts=1)
    columns = ["id", "allowed", "state", "failures", "successes", "last_failure"]
    assert rows(got, *columns) == rows(whole, *columns)
