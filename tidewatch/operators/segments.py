"""Running values and sessions per key by a distributed ordered scan, so that a hot key is not one task.

Rows are sorted by (key, order) over all tasks, in parts of about equal row counts whatever their keys and times. Each
(key, part) is windowed on its own; what earlier parts contribute is computed on one row per (key, part) and joined back.
Results equal the plain window over the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators.joins import null_safe
from tidewatch.session import materialize

PART = "_part"


def ordered_parts(df: DataFrame, by: Sequence[str], parts: int = 0) -> DataFrame:
    """The rows with their part of the order ``by``, written to the shared folder. Rows that are equal in all of ``by`` share
    a part. ``parts`` 0 leaves their number to the session."""
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return materialize(ranged.withColumn(PART, F.spark_partition_id()), "ordered")


def _earlier(keys: Sequence[str]) -> W:
    return W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
                include_current: bool = True, parts: int = 0) -> DataFrame:
    """Adds, per name, the greatest value over the rows up to (or before) the current one."""
    stored = ordered_parts(df, [*keys, *order], parts)
    upto = W.partitionBy(*keys, PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if include_current else -1)
    totals = stored.groupBy(*keys, PART).agg(*[F.max(v).alias(f"_t_{n}") for n, v in values.items()])
    carry = totals.select(*keys, PART, *[F.max(f"_t_{n}").over(_earlier(keys)).alias(f"_p_{n}") for n in values])
    local = stored.select("*", *[F.max(v).over(upto).alias(f"_l_{n}") for n, v in values.items()])
    joined = null_safe(local, carry, [*keys, PART], "left")
    return joined.select(*df.columns, *[F.greatest(f"_l_{n}", f"_p_{n}").alias(n) for n in values])


def streak(df: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column, name: str = "streak", parts: int = 0) -> DataFrame:
    """Adds the number of consecutive failures up to and including the row; a success resets it to 0.

    With the failures so far counted, a streak is that count less its value at the last success.
    """
    stored = ordered_parts(df.withColumn("_fail", failed.cast("int")), [*keys, *order], parts)
    upto = W.partitionBy(*keys, PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = stored.withColumn("_count", F.sum("_fail").over(upto))
    local = local.withColumn("_base", F.max(F.when(F.col("_fail") == 0, F.col("_count"))).over(upto))
    # Per part: does it hold a success (a base), and how many failures follow the last one.
    ends = local.groupBy(*keys, PART).agg(F.max("_base").alias("_base"), F.max("_count").alias("_count"))
    before = W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, 0)
    ends = (ends.withColumn("_reset", F.count("_base").over(before))
            .withColumn("_trail", F.sum(F.col("_count") - F.coalesce("_base", F.lit(0))).over(
                W.partitionBy(*keys, "_reset").orderBy(PART).rowsBetween(W.unboundedPreceding, 0))))
    carry = ends.select(*keys, PART, F.lag("_trail").over(W.partitionBy(*keys).orderBy(PART)).alias("_carried"))
    joined = null_safe(local, carry, [*keys, PART], "left")
    total = F.col("_count") - F.coalesce("_base", -F.coalesce("_carried", F.lit(0)))
    return joined.withColumn(name, total).drop(PART, "_fail", "_count", "_base", "_carried")


def last_streak(df: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column, name: str = "streak") -> DataFrame:
    """One row per key with the number of failures after its last success; all of them without a success.

    Two aggregates and no order over the rows: where only the streak at the end is wanted, ``streak`` would do too much. Failures
    equal to the last success in all of ``order`` do not count; a row whose outcome is null is neither.
    """
    at = F.struct(*order)
    since = df.groupBy(*keys).agg(F.max(F.when(~failed, at)).alias("_since"))
    after = null_safe(df.where(failed), since, keys).where(F.col("_since").isNull() | (at > F.col("_since")))
    counted = after.groupBy(*keys).agg(F.count("*").alias(name))
    return null_safe(since.select(*keys), counted, keys, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def trailing_count(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, name: str = "recent", parts: int = 0) -> DataFrame:
    """Adds the number of the key's rows in the ``seconds`` up to the row's own time, both ends included.

    That is the rows up to its time less those before its window. Every row asks for the second number at the place in
    the order where its window begins, so rows are counted once, however many windows they are in.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = materialize(df.select(F.monotonically_increasing_id().alias("_id"), F.struct(*df.columns).alias("_row"), *keys, at.alias("_at")), "trailing")
    asks = rows.select("_id", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), *keys, (F.col("_at") - seconds * 1_000_000).alias("_at"), F.lit(0).alias("_kind"))
    stored = ordered_parts(rows.withColumn("_kind", F.lit(1)).unionByName(asks), [*keys, "_at", "_kind"], parts)
    # At the same time a window's beginning comes before the rows, and rows of one time share a part.
    place = F.struct("_at", "_kind")
    local = F.sum("_kind").over(W.partitionBy(*keys, PART).orderBy(place).rangeBetween(W.unboundedPreceding, 0))
    totals = stored.groupBy(*keys, PART).agg(F.sum("_kind").alias("_n"))
    carry = totals.select(*keys, PART, F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)).alias("_before"))
    counted = null_safe(stored.withColumn("_upto", local), carry, [*keys, PART], "left").withColumn("_upto", F.col("_upto") + F.col("_before"))
    both = counted.groupBy("_id").agg(F.max("_row").alias("_row"), F.sum(F.when(F.col("_kind") == 1, F.col("_upto")).otherwise(-F.col("_upto"))).alias(name))
    return both.select("_row.*", name)


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: float, measures: dict[str, Column], parts: int = 0) -> DataFrame:
    """Runs of a key's rows whose pauses stay within the gap: first and last time, rows, summed measures.

    Rows are first joined into runs inside each (key, part). Only a part's first run can go on from an earlier part; where
    it does, it takes the name of the run that it continues.
    """
    gap = F.lit(int(gap_seconds * 1_000_000))
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(key, F.col(ts).alias("_ts"), at.alias("_at"), F.lit(1).alias("events"), *[c.cast("bigint").alias(n) for n, c in measures.items()])
    rows = ordered_parts(rows, [key, "_at"], parts)
    inside = W.partitionBy(key, PART).orderBy("_at")
    fresh = (F.col("_at") - F.lag("_at").over(inside) > gap).cast("int")
    rows = rows.withColumn("_fresh", F.coalesce(fresh, F.lit(0)))
    rows = rows.withColumn("_run", F.sum("_fresh").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    sums = ["events", *measures]
    runs = rows.groupBy(key, PART, "_run").agg(
        F.min("_ts").alias("started_at"), F.max("_ts").alias("last_at"), F.min("_at").alias("_first"), F.max("_at").alias("_last"),
        *[F.sum(c).alias(c) for c in sums])
    order = W.partitionBy(key).orderBy(PART)
    ends = runs.groupBy(key, PART).agg(F.max("_run").alias("_run"), F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    ends = ends.withColumn("_goes_on", F.coalesce(F.col("_first") - F.lag("_last").over(order) <= gap, F.lit(False)))
    # A part's last run begins there, unless it is its only one and goes on.
    begun = F.when((F.col("_run") > 0) | ~F.col("_goes_on"), F.struct(PART, "_run"))
    names = ends.select(key, PART, F.when(F.col("_goes_on"), F.max(begun).over(_earlier([key]))).alias("_name"))
    named = null_safe(runs, names, [key, PART], "left")
    name = F.when((F.col("_run") == 0) & F.col("_name").isNotNull(), F.col("_name")).otherwise(F.struct(PART, "_run"))
    return named.groupBy(key, name.alias("_session")).agg(F.min("started_at").alias("started_at"), F.max("last_at").alias("last_at"),
                                                          *[F.sum(c).alias(c) for c in sums]).drop("_session")


def merge_spans(spans: DataFrame, key: str, first: str, last: str, gap_seconds: float, sums: Sequence[str], parts: int = 0) -> DataFrame:
    """Spans of a key that overlap, or are no further apart than the gap, as one: first and last time, summed measures."""
    gap, micros = F.lit(int(gap_seconds * 1_000_000)), lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ends = running_max(spans, [key], [first, last], {"_before": micros(last)}, include_current=False, parts=parts)
    opens = F.when(F.coalesce(micros(first) - F.col("_before") > gap, F.lit(True)), micros(first))
    named = running_max(ends.withColumn("_opens", opens), [key], [first, last], {"_session": F.col("_opens")}, parts=parts)
    return named.groupBy(key, "_session").agg(F.min(first).alias(first), F.max(last).alias(last), *[F.sum(c).alias(c) for c in sums]).drop("_session")


def ordered_events(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str] = (), parts: int = 0) -> DataFrame:
    """Every row of a key with its position (from 1) in the key's order, as rows and not as a list.

    Rows are sorted by (key, order) over all tasks; a position is the row's number in its task plus the key's rows in
    the tasks before, so a key that holds most rows is not one task.
    """
    stored = ordered_parts(df.select(key, *order, *columns), [key, *order], parts)
    sizes = stored.groupBy(key, PART).agg(F.count("*").alias("_n"))
    before = sizes.select(key, PART, F.coalesce(F.sum("_n").over(_earlier([key])), F.lit(0)).alias("_before"))
    local = stored.withColumn("_nth", F.row_number().over(W.partitionBy(PART, key).orderBy(*order)))
    joined = null_safe(local, before, [key, PART], "left")
    return joined.select(key, (F.col("_nth") + F.col("_before")).cast("long").alias("position"), *order, *columns)
