"""Audit appends, roll-up files, topic exports and metric text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import folder_values, remove


def as_variant(text: Column) -> Column:
    """JSON text as VARIANT; text that is not JSON stays, as a VARIANT that is a string."""
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))


def append_audit(events: DataFrame, path: str, ts: str = "ts", nested: Sequence[str] = ()) -> None:
    """Append audit events, one folder per day. Rows are gathered by day first, big days in several files.

    The columns named in ``nested`` hold JSON text and are stored as VARIANT. Spark shreds them when it writes, so a filter or
    a projection of one path reads that path's column and neither the rest of the document nor its text.
    """
    stored = events.withColumns({c: as_variant(F.col(c)) for c in nested})
    (stored.withColumn("event_date", F.to_date(ts)).hint("rebalance", "event_date").write.mode("append")
     .partitionBy("event_date").parquet(path))


def write_rollup_json(rollup: DataFrame, path: str, kind: str) -> None:
    """One folder per period; a re-run replaces only the periods it covers."""
    (rollup.withColumn("period_kind", F.lit(kind))
     .withColumn("period_start", F.date_format("period_start", "yyyyMMdd_HH"))
     .hint("rebalance", "period_kind", "period_start").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("period_kind", "period_start").json(path))


def write_rollup_csv(rollup: DataFrame, path: str) -> None:
    """Long form: section, value, count."""
    (rollup.select("section", "value", F.col("n").alias("count"))
     .write.mode("overwrite").option("header", True).csv(path))


PROMOTED = {"retention.ms": "retention_ms", "cleanup.policy": "cleanup_policy", "compression.type": "compression_type"}


def export_topics(details: DataFrame, configs: str = "configs") -> DataFrame:
    """Three well-known settings become columns of their own and leave the map."""
    promoted = list(PROMOTED)
    rest = F.map_filter(configs, lambda k, v: ~k.isin(promoted))
    return details.select(
        "name", "partitions", "replication_factor",
        F.col(configs)["retention.ms"].try_cast("bigint").alias("retention_ms"),
        F.col(configs)["cleanup.policy"].alias("cleanup_policy"),
        F.col(configs)["compression.type"].alias("compression_type"),
        rest.alias("custom_configs"))


def write_lines(lines: DataFrame, path: str, order: Sequence[str], text: str = "line") -> None:
    """Text files whose concatenation in file order follows ``order`` (a range-partitioned sort)."""
    lines.orderBy(*order).select(text).write.mode("overwrite").text(path)


def drop_partitions(spark: SparkSession, path: str, partition: str, before: str) -> list[str]:
    """Remove the folders ``partition=value`` right under ``path`` whose value is less than ``before``; days and period
    labels sort as text. Only folder names are read; rows without a value stay. Returns the values that went."""
    old = sorted(v for v in folder_values(spark, path, partition) if v < before and v != "__HIVE_DEFAULT_PARTITION__")
    for value in old:
        remove(spark, f"{path.rstrip('/')}/{partition}={value}")
    return old
