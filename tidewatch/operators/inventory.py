"""Topic, cluster and instance inventory."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.logquery import LogFilter, predicate

INTERNAL_PREFIX = "__"


def user_topics(topics: DataFrame) -> DataFrame:
    return topics.where(~F.col("name").startswith(INTERNAL_PREFIX))


def search_topics(topics: DataFrame, pattern: str, regex: bool = False) -> DataFrame:
    """Names that contain the text in any case, or match the pattern."""
    return topics.where(predicate(topics, LogFilter("name", "regex" if regex else "contains", pattern, case_sensitive=regex)))


def select(table: DataFrame, columns: Sequence[str], **wanted) -> DataFrame:
    """Rows that equal every given value; filters on columns outside ``columns`` and unset ones are ignored."""
    tests = [F.col(k) == v for k, v in wanted.items() if k in columns and v is not None]
    return table.where(reduce(lambda a, b: a & b, tests)) if tests else table


def partition_totals(partitions: DataFrame, keys: Sequence[str] = ("topic_id",), order: Sequence[str] = ("partition_id",)) -> DataFrame:
    """Partitions per topic and the replica count of the first one."""
    first = F.min_by("replica_count", F.struct(*order))
    return partitions.groupBy(*keys).agg(F.count("*").alias("partition_count"), first.alias("replication"))


def describe(topics: DataFrame, partitions: DataFrame) -> DataFrame:
    """Topics with partition totals and health counts in one join; the partitions are reduced before it."""
    detail = partitions.groupBy("topic_id").agg(
        F.count("*").alias("partition_count"), F.count_if(F.col("leader") == -1).alias("leaderless"),
        F.min("isr_count").alias("min_isr"))
    return topics.join(detail, "topic_id")


def gate(requests: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """Each request with ``gate``: ok only if its cluster is known and running."""
    joined = requests.join(clusters.select(key, F.col("status").alias("_status")), key, "left")
    test = F.when(F.col("_status") == "running", "ok").otherwise("CLUSTER_NOT_AVAILABLE")
    return joined.withColumn("gate", test).drop("_status")


def idempotent(requests: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Outcome of create and delete requests against an inventory: repeats are fine and change nothing."""
    known = existing.select(key, F.lit(True).alias("_known")).distinct()
    joined = requests.join(known, key, "left")
    there = F.col("_known").isNotNull()
    outcome = (F.when(F.col("op") == "create", F.when(there, "already_exists").otherwise("create"))
               .otherwise(F.when(there, "delete").otherwise("already_gone")))
    return joined.withColumn("outcome", outcome).drop("_known")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children without a live parent."""
    return children.join(parents.where("deleted_at IS NULL").select(key), key, "left_anti")


def cluster_totals(partitions: DataFrame, topics: DataFrame) -> DataFrame:
    """Brokers and topics that are not internal, per cluster."""
    leaders = partitions.where("leader >= 0").select("topic_id", "leader").distinct()
    brokers = (leaders.join(topics.select("topic_id", "cluster_id"), "topic_id")
               .groupBy("cluster_id").agg(F.count_distinct("leader").alias("broker_count")))
    named = topics.groupBy("cluster_id").agg(F.count_if(~F.col("name").startswith(INTERNAL_PREFIX)).alias("topic_count"))
    return named.join(brokers, "cluster_id", "left").withColumn("broker_count", F.coalesce("broker_count", F.lit(0)))


def broker_periods(partitions: DataFrame, topics: DataFrame, period: Column) -> DataFrame:
    """The leaders seen per cluster and period, to be stored: one bitmap per 32,768 consecutive broker ids, of fixed size."""
    led = partitions.where("leader >= 0").withColumn("period", period)
    return (led.join(topics.select("topic_id", "cluster_id"), "topic_id")
            .groupBy("cluster_id", "period", F.bitmap_bucket_number("leader").alias("block"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("leader")).alias("brokers")))


def brokers_of(periods: DataFrame) -> DataFrame:
    """Exact number of brokers per cluster over any choice of stored periods; the partitions are not read again."""
    blocks = periods.groupBy("cluster_id", "block").agg(F.bitmap_count(F.bitmap_or_agg("brokers")).alias("n"))
    return blocks.groupBy("cluster_id").agg(F.sum("n").alias("broker_count"))


def first_wins(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both tables by key; where both have the key the first table's row is taken whole."""
    tagged = first.withColumn("_rank", F.lit(1)).unionByName(second.withColumn("_rank", F.lit(2)))
    columns = [c for c in first.columns if c != key]
    best = tagged.groupBy(key).agg(F.min_by(F.struct(*columns), "_rank").alias("_b"))
    return best.select(key, *[F.col("_b")[c].alias(c) for c in columns])


def lookup(requests: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """The value of each requested key from the first table, else the second, else nothing, and where it was found."""
    a = first.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = second.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    joined = requests.join(a, key, "left").join(b, key, "left")
    found = F.when(F.col("_in_a"), "first").when(F.col("_in_b"), "second").otherwise("missing")
    return joined.select(*requests.columns, F.when(F.col("_in_a"), F.col("_a")).otherwise(F.col("_b")).alias(value), found.alias("found"))


def copy_configs(pairs: DataFrame, topics: DataFrame, exclude: Sequence[str]) -> DataFrame:
    """Settings to copy for each (source, target) pair of existing topics, without the excluded keys."""
    have = topics.select("name", "configs")
    joined = (pairs.join(have.select(F.col("name").alias("source"), "configs"), "source")
              .join(have.select(F.col("name").alias("target")), "target", "left_semi"))
    kept = F.map_filter("configs", lambda k, v: ~k.isin(list(exclude)))
    return joined.withColumn("configs", kept).where(F.size("configs") > 0)


def latest_metrics(samples: DataFrame, keys: Sequence[str], at: str, tie: Sequence[str], values: Sequence[str]) -> DataFrame:
    best = F.max_by(F.struct(at, *values), F.struct(at, *tie))
    return samples.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col("_b")[c].alias(c) for c in (at, *values)])


def best_and_worst(totals: DataFrame, name: str, cost: str, gain: str) -> DataFrame:
    """The group with the lowest cost and the one with the highest gain; names break ties."""
    return totals.agg(F.min_by(name, F.struct(cost, name)).alias("fastest"),
                      F.min_by(name, F.struct(-F.col(gain), F.col(name))).alias("most_efficient"))


def outcome_counts(results: DataFrame, keys: Sequence[str], ok: Column) -> DataFrame:
    return results.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"))


def outcome_names(results: DataFrame, keys: Sequence[str], name: str, ok: Column) -> DataFrame:
    """The name lists of a bulk operation, one row per name so that no list grows with the request."""
    return results.select(*keys, name, F.when(ok, "successful").otherwise("failed").alias("outcome"))


# --- standing views -----------------------------------------------------------------------------

def active_instances(instances: DataFrame) -> DataFrame:
    return instances.where("deleted_at IS NULL")


def active_topics(topics: DataFrame) -> DataFrame:
    return topics.where("NOT deleted AND state = 'active'")


def pending_operations(operations: DataFrame) -> DataFrame:
    return operations.where("state = 'in_progress'")


def recent_audit(audit: DataFrame, as_of: datetime, ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """The last 24 hours, newest first. ``tie`` orders rows of one time and lets the sort split them."""
    start = F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL '24' HOUR")
    return audit.where(F.col(ts) >= start).orderBy(F.desc(ts), *tie)


def due_jobs(jobs: DataFrame, as_of: datetime, tie: Sequence[str] = ()) -> DataFrame:
    """Scheduled jobs whose time has come, oldest first."""
    due = (F.col("state") == "scheduled") & (F.col("scheduled_at") <= F.lit(as_of).cast("timestamp_ntz"))
    return jobs.where(due).orderBy("scheduled_at", *tie)


def register_views(instances: DataFrame, topics: DataFrame, operations: DataFrame, audit: DataFrame, jobs: DataFrame,
                   as_of: datetime) -> None:
    """The five standing views as temporary views of the session."""
    active_instances(instances).createOrReplaceTempView("active_service_instances")
    active_topics(topics).createOrReplaceTempView("active_topics")
    pending_operations(operations).createOrReplaceTempView("pending_operations")
    recent_audit(audit, as_of).createOrReplaceTempView("recent_audit_logs")
    due_jobs(jobs, as_of).createOrReplaceTempView("scheduled_cleanup_jobs")
