"""Counters, gauges, histograms and timers over metric points, and their text exposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.texttime import seconds_between
from tidewatch.operators.ranking import latest, newest

RECENT_VALUES = 1000
PERCENTILES = (50, 95, 99)


def series_key(name: Column, labels: Column) -> Column:
    """``name{a=1,b=2}`` with labels sorted by name; just the name without labels."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(labels.isNull() | (F.size(labels) == 0), name).otherwise(
        F.concat(name, F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def split_key(key: Column) -> tuple[Column, Column]:
    """Name and label text of a series key."""
    parts = F.split(key, r"\{", 2)
    return parts[0], F.rtrim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.lit("}"))


def with_key(points: DataFrame) -> DataFrame:
    return points.withColumn("key", series_key(F.col("name"), F.col("labels")))


def counters(points: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    return points.where("kind = 'counter'").groupBy(*keys).agg(F.sum("value").alias("value"))


def gauges(points: DataFrame, keys: Sequence[str] = ("key",), order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Last value set per series."""
    return latest(points.where("kind = 'gauge'"), keys, order, keep=["value"])


def summary(points: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Count, sum, min, max and mean; zeros over no rows."""
    zero = F.lit(0.0)
    return points.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.coalesce(F.sum(value), zero).alias("sum"),
        F.coalesce(F.min(value), zero).alias("min"),
        F.coalesce(F.max(value), zero).alias("max"),
        F.coalesce(F.avg(value), zero).alias("mean"))


def buckets(points: DataFrame, keys: Sequence[str], bounds: Sequence[float], value: str = "value") -> DataFrame:
    """Cumulative counts: rows at or below each bound, as (keys, le, count)."""
    counts = [F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(value) <= F.lit(float(b))).alias("count")) for b in bounds]
    return (points.groupBy(*keys).agg(F.array(*counts).alias("_b"))
            .select(*keys, F.explode("_b").alias("_b")).select(*keys, "_b.le", "_b.count"))


def recent_percentiles(points: DataFrame, keys: Sequence[str], order: Sequence[Column], salt_by: Sequence[str],
                       value: str = "value", last: int = RECENT_VALUES, points_at: Sequence[int] = PERCENTILES) -> DataFrame:
    """Percentiles of the last ``last`` values: the sorted value at index int(p/100 * n), at most n - 1.

    The newest values are cut per series first, so no series ever gathers more than ``last`` of them.
    """
    recent = newest(points, keys, order, last, salt_by)
    ordered = recent.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_v"))
    n = F.size("_v")
    at = {p: F.least((F.lit(p) * n / 100).cast("int"), n - 1) for p in points_at}
    return ordered.select(*keys, *[F.get(F.col("_v"), i).alias(f"p{p}") for p, i in at.items()])


def timer_points(runs: DataFrame, start: str, end: str, keys: Sequence[str]) -> DataFrame:
    """Durations in seconds of runs that ended, as histogram values."""
    return (runs.where(F.col(end).isNotNull())
            .select(*keys, start, seconds_between(F.col(start), F.col(end)).alias("value")))


def series(points: DataFrame, order: Sequence[str] = ("ts", "event_id"), bounds: Sequence[float] = (),
           value: str = "value") -> DataFrame:
    """One row per (kind, key) with everything any kind needs, in a single pass over the points."""
    le = F.array(*[F.count_if(F.col(value) <= F.lit(float(b))) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    return points.groupBy("kind", "key").agg(
        F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(value).alias("mean"), F.max_by(value, F.struct(*order)).alias("last"), le.alias("le_counts"))


def timer_series(timers: DataFrame, start: str, bounds: Sequence[float] = ()) -> DataFrame:
    """Timer values (key, start, value) as series of the kind 'timer'."""
    return series(timers.withColumn("kind", F.lit("timer")), [start], bounds)


def snapshot(totals: DataFrame) -> DataFrame:
    """All kinds in long form, (kind, key, stat, value), from ``series`` rows."""
    def stat(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("stat"), value.cast("double").alias("value"))
    stats = [stat(n, F.col(n)) for n in ("count", "sum", "min", "max", "mean")]
    rows = (F.when(F.col("kind") == "counter", F.array(stat("value", F.col("sum"))))
            .when(F.col("kind") == "gauge", F.array(stat("value", F.col("last"))))
            .otherwise(F.array(*stats)))
    return totals.select("kind", "key", F.inline(rows))


def distributions(points: DataFrame, totals: DataFrame, bounds: Sequence[float], order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """What a snapshot adds for histograms and timers: percentiles of the newest values and cumulative buckets up to
    +Inf, as (kind, key, stat, value). ``totals`` are the points' ``series`` with the same bounds."""
    spread = totals.where(~F.col("kind").isin("counter", "gauge"))
    counts = [F.struct(F.lit(f"le_{float(b)}").alias("stat"), F.col("le_counts")[i].cast("double").alias("value")) for i, b in enumerate(bounds)]
    counts.append(F.struct(F.lit("le_+Inf").alias("stat"), F.col("count").cast("double").alias("value")))
    le = spread.select("kind", "key", F.inline(F.array(*counts)))
    recent = recent_percentiles(points.where(~F.col("kind").isin("counter", "gauge")), ["kind", "key"], [F.desc(c) for c in order], [order[-1]])
    cuts = [F.struct(F.lit(f"p{p}").alias("stat"), F.col(f"p{p}").cast("double").alias("value")) for p in PERCENTILES]
    return recent.select("kind", "key", F.inline(F.array(*cuts))).unionByName(le)


def metric_history(points: DataFrame, last: int = RECENT_VALUES) -> DataFrame:
    """The newest ``last`` points of each series, numbered from the newest."""
    return newest(points, ["key"], [F.desc("ts"), F.desc("event_id")], last, ["event_id"])


# Order of the metric blocks in the exposition text.
_BLOCKS = {"counter": 1, "gauge": 2}


def exposition(totals: DataFrame, helps: dict[str, str], bounds: Sequence[float]) -> DataFrame:
    """Exposition lines from ``series`` rows with the same bounds: (block, name, place, series, value, line).

    Sort by the first three and write ``line``. HELP lines come first, then one TYPE line per metric
    name before its samples; timers appear as histograms.
    """
    name, bare = split_key(F.col("key"))
    escaped = F.replace(F.replace(bare, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    labels = F.regexp_replace(escaped, "(^|,)([A-Za-z_][A-Za-z0-9_]*)=([^,]*)", '$1$2="$3"')
    is_plain = F.col("kind").isin(list(_BLOCKS))
    block = F.when(F.col("kind") == "counter", 1).when(F.col("kind") == "gauge", 2).otherwise(3)

    def sample(suffix: str, rank: str, le: str, number: Column, whole: bool) -> Column:
        inner = F.array_join(F.array_compact(F.array(F.nullif(labels, F.lit("")), F.lit(f'le="{le}"' if le else None))), ",")
        text = F.concat(name, F.lit(suffix), F.when(inner != "", F.concat(F.lit("{"), inner, F.lit("}"))).otherwise(""))
        return F.struct(F.concat(F.lit("1"), labels, F.lit(f" {rank}")).alias("place"), text.alias("series"),
                        number.cast("double").alias("value"), (number.cast("bigint") if whole else number).cast("string").alias("number"))

    single = F.when(F.col("kind") == "counter", F.col("sum")).otherwise(F.col("last"))
    histogram = [sample("_count", "a", "", F.col("count"), True), sample("_sum", "b", "", F.col("sum"), False)]
    histogram += [sample("_bucket", f"c{i:06d}", str(float(b)), F.col("le_counts")[i], True) for i, b in enumerate(bounds)]
    histogram.append(sample("_bucket", "d", "+Inf", F.col("count"), True))
    lines = F.when(is_plain, F.array(sample("", "a", "", single, False))).otherwise(F.array(*histogram))
    body = totals.select(block.alias("block"), name.alias("name"), F.inline(lines)).select(
        "block", "name", "place", "series", "value", F.concat("series", F.lit(" "), "number").alias("line"))

    def heading(word: str, text: Column) -> list[Column]:
        title = F.concat(F.lit(f"# {word} "), F.col("name"))
        return [F.lit("0").alias("place"), title.alias("series"), F.lit(None).cast("double").alias("value"), F.concat(title, F.lit(" "), text).alias("line")]

    kind = F.when(is_plain, F.col("kind")).otherwise("histogram")
    types = totals.select(block.alias("block"), name.alias("name"), kind.alias("type")).distinct().select("block", "name", *heading("TYPE", F.col("type")))
    result = body.unionByName(types)
    if helps:
        entries = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(h).alias("help")) for n, h in helps.items()])
        heads = totals.sparkSession.range(1).select(F.inline(entries)).select(F.lit(0).alias("block"), "name", *heading("HELP", F.col("help")))
        result = heads.unionByName(result)
    return result
