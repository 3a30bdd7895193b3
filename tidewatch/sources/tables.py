"""Metadata tables, topic documents, and the merge and delete operations on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.ranking import latest
from tidewatch.session import materialize, remove

TOPIC_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("partitions", T.IntegerType()),
    T.StructField("replication_factor", T.IntegerType()),
    T.StructField("retention_ms", T.LongType()),
    T.StructField("cleanup_policy", T.StringType()),
    T.StructField("compression_type", T.StringType()),
    T.StructField("custom_configs", T.MapType(T.StringType(), T.StringType())),
])


#: Rows up to which a database table may be read by one task.
ONE_TASK_ROWS = 1_000_000
#: Rows of a table that one task of a cascading delete joins, about.
JOINED_ROWS = 1_000_000


def read_table(spark: SparkSession, source: str | dict, rows: int | None = None) -> DataFrame:
    """A metadata table: a parquet path, or JDBC options (filters and columns are pushed to the database).

    Without ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` one task reads a whole database table. State the
    table's expected ``rows``: above ``ONE_TASK_ROWS`` the four are required.
    """
    if isinstance(source, dict):
        given = {k.lower() for k in source}
        missing = [k for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions") if k.lower() not in given]
        if rows is not None and rows > ONE_TASK_ROWS and missing:
            raise ValueError(f"a table of {rows} rows needs {', '.join(missing)}")
        return spark.read.format("jdbc").options(**source).load()
    return spark.read.parquet(source)


def read_topic_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one JSON array of topic specifications."""
    return spark.read.schema(TOPIC_SCHEMA).option("multiLine", True).json(path)


def merge(base: DataFrame, changes: DataFrame, keys: Sequence[str], version: str, op: str = "op",
          touch: str | None = None, tie: Sequence[str] = (), null_keeps: bool = False, buckets: int = 0) -> DataFrame:
    """The table after a batch of ``upsert`` / ``delete`` changes; the latest change of each key wins.

    One shuffle join on the keys; ``tie`` orders changes of equal version. An upsert sets every column it carries, to
    null as well, unless ``null_keeps``; ``touch`` names the column set to the change's version. A null key meets
    a null key, but not where the base is stored in ``buckets`` of the keys and is joined where it lies: keys are then compared by
    plain equality, and the latest changes go to that many parts, however many the session shuffles to.
    """
    last = latest(changes, keys, [version, *tie], keep=[c for c in changes.columns if c not in keys]).withColumn("_given", F.lit(True))
    c, b = (last.repartition(buckets, *keys) if buckets else last).alias("c"), base.alias("b")
    condition = [F.col(f"b.{k}") == F.col(f"c.{k}") if buckets else F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    joined = b.join(c, condition, "full_outer")
    joined = joined.where(F.col(f"c.{op}").isNull() | (F.col(f"c.{op}") != "delete"))
    columns = []
    for name in base.columns:
        if name == touch:
            columns.append(F.coalesce(F.col(f"c.{version}"), F.col(f"b.{name}")).alias(name))
        elif name in keys or (name in last.columns and null_keeps):
            columns.append(F.coalesce(F.col(f"c.{name}"), F.col(f"b.{name}")).alias(name))
        elif name in last.columns:
            columns.append(F.when(F.col("c._given"), F.col(f"c.{name}")).otherwise(F.col(f"b.{name}")).alias(name))
        else:
            columns.append(F.col(f"b.{name}").alias(name))
    return joined.select(*columns)


def write_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int) -> None:
    """A catalog table under ``path`` in ``buckets`` buckets of the keys, one file each."""
    _save_bucketed(df.repartition(buckets, *keys), table, path, keys, buckets)


def _save_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int) -> None:
    df.write.mode("errorifexists").format("parquet").option("path", path).bucketBy(buckets, *keys).saveAsTable(table)


def merge_bucketed(spark: SparkSession, table: str, into: str, path: str, buckets: int, changes: DataFrame, keys: Sequence[str], version: str,
                   op: str = "op", touch: str | None = None, tie: Sequence[str] = ()) -> None:
    """Merge changes into a table of ``write_bucketed``, as a new table of the same buckets under ``path``; the old one stays.

    Only the changes are shuffled: they go to the buckets, and every task writes the bucket it has read. Keys are not null.
    """
    merged = merge(spark.table(table).hint("merge"), changes, keys, version, op, touch, tie, buckets=buckets)
    _save_bucketed(merged, into, path, keys, buckets)


def merge_partitions(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], partition: str, version: str,
                     op: str = "op", touch: str | None = None, tie: Sequence[str] = ()) -> None:
    """Merge changes into a stored table, reading and rewriting only the partitions that they name. ``changes`` carry the
    partition column, which a key never changes. Merged rows are written aside first, so a failure leaves the table
    as it was; a partition whose last row was deleted goes."""
    touched = [r[0] for r in changes.select(partition).distinct().collect()]  # at most the table's number of partitions
    base = spark.read.parquet(path).where(F.col(partition).isin(touched))
    rows = materialize(merge(base, changes, [*keys, partition], version, op, touch, tie), "merged")
    left = {r[0] for r in rows.select(partition).distinct().collect()}
    rewrite_partitions(rows, path, partition)
    for value in touched:
        if value not in left:
            remove(spark, f"{path}/{partition}={value}")


def keep_rows(spark: SparkSession, path: str, partition: str, keep: Callable[[DataFrame], DataFrame], within: Column | None = None) -> list:
    """Reduce a stored table to the rows that ``keep`` returns of it, and return the partitions that lost some.

    Only partitions that satisfy ``within`` are read, and only those that lose rows are rewritten; one that loses all goes. What stays
    is written aside first, so a failure leaves the table as it was. ``keep`` selects rows and changes none.
    """
    table = spark.read.parquet(path)
    scope = table if within is None else table.where(within)
    both = scope.select(partition, F.lit(1).alias("n")).unionByName(keep(scope).select(partition, F.lit(-1).alias("n")))
    losing = [r[0] for r in both.groupBy(partition).agg(F.sum("n").alias("lost")).where("lost > 0").collect()]  # at most the partitions
    if not losing:
        return []
    named = F.col(partition).isin([v for v in losing if v is not None])
    rows = materialize(keep(scope.where((named | F.col(partition).isNull()) if None in losing else named)).select(*table.columns), "kept")
    left = {r[0] for r in rows.select(partition).distinct().collect()}
    rewrite_partitions(rows, path, partition)
    for value in losing:
        if value not in left:
            remove(spark, f"{path}/{partition}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}")
    return sorted(losing, key=str)


def unmatched(base: DataFrame, changes: DataFrame, keys: Sequence[str], op: str = "op") -> DataFrame:
    """Deletes whose key is not in the table."""
    return changes.where(F.col(op) == "delete").join(base.select(*keys), list(keys), "left_anti")


def cascade_delete(parent: DataFrame, children: dict[str, tuple[DataFrame, str]], deleted: DataFrame, key: str,
                   rows: int | None = None) -> dict[str, DataFrame]:
    """Parent and children without the deleted keys; children maps a name to (table, foreign key).

    Keys that are too many to be broadcast meet the tables in parts that the runtime does not merge, or a task would sort more
    the larger the tables are: as many parts as the session shuffles to, or one per ``JOINED_ROWS`` if the largest table's ``rows``
    are stated and that is more.
    """
    gone = deleted.select(F.col(key).alias("_gone")).where("_gone IS NOT NULL")
    if rows is None or rows > JOINED_ROWS:
        parts = max(int(deleted.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // JOINED_ROWS))
        gone = gone.repartition(parts, "_gone")  # a repeated key does no harm here, and telling them apart takes memory
    else:
        gone = gone.distinct()
    left = {"parent": parent.join(gone, F.col(key) == F.col("_gone"), "left_anti")}
    for name, (table, foreign) in children.items():
        left[name] = table.join(gone, F.col(foreign) == F.col("_gone"), "left_anti")
    return left


def rewrite_partitions(table: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions present in ``table``."""
    (table.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))
