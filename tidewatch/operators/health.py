"""Health results: latest per check, worst-first summaries, histories and probe limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ranking import latest, newest

# The status domain, worst first, with healthy when nothing else is present.
STATUSES = ("unhealthy", "degraded", "unknown", "healthy")


def last_results(results: DataFrame, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    return latest(results, ["name"], order)


def registered_checks(checks: DataFrame, results: DataFrame) -> DataFrame:
    """Every registered check with its last result, if it has one."""
    return checks.join(last_results(results), "name", "left")


def overall(counts: dict[str, Column], total: Column) -> Column:
    return (F.when(total == 0, "unknown").when(counts["unhealthy"] > 0, "unhealthy")
            .when(counts["degraded"] > 0, "degraded").when(counts["unknown"] > 0, "unknown").otherwise("healthy"))


def summary(results: DataFrame, *by: str | Column) -> DataFrame:
    """Count per status and the overall status; one row per group, or one row (also for no results) without."""
    counted = results.groupBy(*by).agg(
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in STATUSES], F.count("*").alias("total_checks"))
    counts = {s: F.col(f"{s}_count") for s in STATUSES}
    return counted.withColumn("overall_status", overall(counts, F.col("total_checks")))


def rounds(results: DataFrame, every: str) -> DataFrame:
    """Latest result of each check in each round of length ``every``."""
    per_round = results.withColumn("round", F.window("ts", every).getField("start"))
    return latest(per_round, ["round", "name"], ["ts", "event_id"])


def history(results: DataFrame, every: str, last: int = 100) -> DataFrame:
    """The newest ``last`` round summaries."""
    return summary(rounds(results, every), "round").orderBy(F.desc("round")).limit(last)


def check_history(results: DataFrame, last: int = 100) -> DataFrame:
    """The newest ``last`` results of each check, numbered from the newest."""
    return newest(results, ["name"], [F.desc("ts"), F.desc("event_id")], last, ["event_id"])


def probe_status(value: Column, warning: Column, critical: Column, duration: Column, timeout: Column) -> Column:
    """A probe over its time limit is unhealthy, otherwise its value decides."""
    return (F.when(duration > timeout, "unhealthy").when(value >= critical, "unhealthy")
            .when(value >= warning, "degraded").otherwise("healthy"))
