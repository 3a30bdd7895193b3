"""Retention candidates, clean-up conflicts and reports, schedules and run statistics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.texttime import MILLIS_PER_HOUR, epoch_in_name
from tidewatch.operators.inventory import user_topics
from tidewatch.operators.segments import running_max
from tidewatch.sources.tables import keep_rows

# Name prefixes of test topics, clean-up kinds.
TEST_PREFIXES = ("test-", "temp-")
YEAR_ONE = -62_135_596_800_000_000  # in microseconds, the earliest time a column holds
CLEANUP_KINDS = ("topic_cleanup", "cluster_cleanup", "metadata_cleanup")


def expired(retention_ms: Column, max_age_hours: int) -> Column:
    """Retention shorter than the age limit; -1 means kept for ever and an unset value never expires."""
    return F.coalesce((retention_ms != -1) & (retention_ms < max_age_hours * MILLIS_PER_HOUR), F.lit(False))


def is_test_name(name: Column) -> Column:
    return name.startswith(TEST_PREFIXES[0]) | name.startswith(TEST_PREFIXES[1])


def topic_candidates(topics: DataFrame, pattern: str, max_age_hours: int = 24) -> DataFrame:
    """User topics that a clean-up with the pattern 'expired', 'test' or 'all' selects."""
    return user_topics(topics).where(selected(pattern, max_age_hours))


def selected(pattern: str, max_age_hours: int) -> Column:
    """Whether a clean-up pattern selects a user topic; never null."""
    tests = {"expired": lambda: F.coalesce(expired(F.col("retention_ms"), max_age_hours), F.lit(False)),
             "test": lambda: F.coalesce(is_test_name(F.col("name")), F.lit(False)), "all": lambda: F.lit(True)}
    if pattern not in tests:
        raise ValueError(f"unknown pattern {pattern!r}")
    return tests[pattern]()


def topic_report(topics: DataFrame, pattern: str, max_age_hours: int, failed: DataFrame | None, dry_run: bool, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Evaluated, identified, cleaned and failed counts in one pass; a dry run cleans nothing. ``failed`` lists the deletes
    that failed by ``keys``, which should name a topic fully: its cluster and name."""
    rows = user_topics(topics).select(*keys, selected(pattern, max_age_hours).alias("_hit"))
    if failed is None:
        rows = rows.withColumn("_bad", F.lit(False))
    else:
        rows = rows.join(failed.select(*keys).distinct().withColumn("_bad", F.lit(True)), list(keys), "left")
    hit, lost = F.col("_hit"), F.coalesce("_bad", F.lit(False))
    return rows.agg(F.count("*").alias("topics_evaluated"), F.count_if(hit).alias("topics_identified"),
                    (F.lit(0).cast("bigint") if dry_run else F.count_if(hit & ~lost)).alias("topics_cleaned"),
                    (F.lit(0).cast("bigint") if dry_run else F.count_if(hit & lost)).alias("topics_failed"),
                    F.lit(dry_run).alias("dry_run"))


def stale_failed(instances: DataFrame, as_of: datetime, hours: float) -> DataFrame:
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(int(hours)))
    return instances.where((F.col("status") == "error") & (F.col("updated_at") < cutoff))


def older_than(rows: DataFrame, ts: str, as_of: datetime, days: int) -> DataFrame:
    return rows.where(F.col(ts) < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days)))


def aged_names(topics: DataFrame, prefix: str, cutoff_epoch: int) -> DataFrame:
    return topics.where(F.col("name").startswith(prefix) & (epoch_in_name(F.col("name")) < cutoff_epoch))


def purge(messages: DataFrame, retention: DataFrame, key: str, ts: str, as_of: datetime) -> DataFrame:
    """The messages that stay when each topic of ``retention`` is cut to its ``retention_ms``; -1 keeps all."""
    joined = messages.join(retention.select(key, F.col("retention_ms").alias("_keep")), key, "left")
    age = F.lit(int(as_of.replace(tzinfo=timezone.utc).timestamp() * 1_000_000)) - F.unix_micros(F.col(ts).cast("timestamp"))
    return joined.where(F.col("_keep").isNull() | (F.col("_keep") == -1) | (age <= F.col("_keep") * 1000)).drop("_keep")


def purge_table(spark: SparkSession, path: str, retention: DataFrame, key: str, ts: str, as_of: datetime, partition: str) -> list:
    """``purge`` applied to a stored table with one folder per day of ``ts``; returns the days that lost messages.

    The shortest retention bounds the days that are read at all; of these only days that lose messages are rewritten.
    Of several rows of a topic the longest retention counts; messages without a time stay.
    """
    longest = retention.groupBy(key).agg(F.when(F.bool_or(F.coalesce(F.col("retention_ms") == -1, F.lit(True))), -1)
                                         .otherwise(F.max("retention_ms")).alias("retention_ms"))
    shortest = longest.where("retention_ms <> -1").agg(F.min("retention_ms")).first()[0]
    if shortest is None:
        return []
    # Days are whole: the one in which the shortest retention ends may hold both kinds of messages.
    end = int(as_of.replace(tzinfo=timezone.utc).timestamp() * 1_000_000) - shortest * 1000
    oldest = F.to_date(F.timestamp_micros(F.lit(max(end, YEAR_ONE))))

    def staying(messages: DataFrame) -> DataFrame:
        timeless = messages.where(F.col(ts).isNull())
        return purge(messages.where(F.col(ts).isNotNull()), longest, key, ts, as_of).unionByName(timeless)

    return keep_rows(spark, path, partition, staying, F.col(partition) <= oldest)


def failed_instance_plan(instances: DataFrame, providers: DataFrame) -> DataFrame:
    """Every errored record is removed; its resources are released only where the provider is known."""
    known = providers.select("runtime_provider", F.lit(True).alias("_known")).distinct()
    return (instances.where("status = 'error'").join(known, "runtime_provider", "left")
            .withColumn("release", F.coalesce("_known", F.lit(False))).drop("_known"))


def conflicts(runs: DataFrame, order: Sequence[str], cluster: str = "cluster_id", kind: str = "run_type",
              start: str = "started_at", end: str = "ended_at", parts: int = 0) -> DataFrame:
    """Each run with the kinds of clean-up still active on its cluster when it starts and that exclude it.

    Same kind always conflicts; topic against cluster; cluster against any. Instead of pairing runs, the
    latest end seen so far is carried per kind, so the work stays linear however many runs overlap.
    """
    ends = {f"_end_{k}": F.when(F.col(kind) == k, F.col(end)) for k in CLEANUP_KINDS}
    seen = running_max(runs, [cluster], [start, *order], ends, include_current=False, parts=parts)
    active = {k: F.coalesce(F.col(f"_end_{k}") > F.col(start), F.lit(False)) for k in CLEANUP_KINDS}
    topic, whole, metadata = CLEANUP_KINDS
    rivals = {topic: (F.col(kind) == topic) | (F.col(kind) == whole),
              whole: (F.col(kind) == whole) | (F.col(kind) == topic),
              metadata: (F.col(kind) == metadata) | (F.col(kind) == whole)}
    names = F.array_compact(F.array(*[F.when(active[k] & rivals[k], F.lit(k)) for k in CLEANUP_KINDS]))
    return (seen.withColumn("conflicts_with", F.array_join(names, ",")).drop(*ends)
            .withColumn("conflict", F.col("conflicts_with") != ""))


def task_statistics(tasks: DataFrame) -> DataFrame:
    return tasks.agg(F.count("*").alias("total_tasks"), F.count_if("enabled").alias("enabled_tasks"),
                     F.count_if("running").alias("running_tasks"),
                     F.count_if(F.col("failure_count") >= F.col("max_failures")).alias("failed_tasks"))


def cleanup_statistics(runs: DataFrame) -> DataFrame:
    """Totals and counts per kind, the kind being the first word after ``ondemand_`` in the task id; one pass."""
    kind = F.get(F.split("task_id", "_"), F.lit(1))
    by_kind = runs.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("c"), F.count_if(F.col("status") == "failed").alias("f"))
    totals = by_kind.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("c"), F.lit(0)).alias("completed"),
                         F.coalesce(F.sum("f"), F.lit(0)).alias("failed"))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("n")) for n in ("total", "completed", "failed")]))
    return (totals.select(pairs.alias("p")).select("p.*")
            .unionByName(by_kind.where("kind IS NOT NULL").select(F.concat(F.lit("type:"), F.col("kind")).alias("metric"), "n")))


def run_totals(executions: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    return executions.groupBy(*keys).agg(F.count("*").alias("run_count"), F.max(at).alias("last_run"))


def due(tasks: DataFrame, as_of: datetime) -> DataFrame:
    """Enabled tasks whose next run has come, that are not running and have not failed too often in a row."""
    return tasks.where(F.col("enabled") & (F.col("next_run") <= F.lit(as_of).cast("timestamp_ntz"))
                       & (F.col("failure_count") < F.col("max_failures")) & ~F.coalesce(F.col("running"), F.lit(False)))
