"""A trigram index beside a stored log: which files can hold a text, as one row of bitmaps per file, column and block.

The index is an ordinary table and optional: files it does not know are read. It can be built anew for single days.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Trigrams are hashed to this many bits per file and column: at most 32 KB, in blocks of 4 KB.
BITS = 1 << 18
_FILE = "([^/]+/[^/]+)$"
#: ASCII capitals and the three letters that equal an ASCII letter, or begin with one, once case is ignored.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\u212a\u0130\u017f"
_LOWER = "abcdefghijklmnopqrstuvwxyzkis"


def _bit(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS))


def _grams(text: Column) -> Column:
    """The distinct three-letter pieces of a text, ASCII letters in lower case."""
    low = F.translate(text, _UPPER, _LOWER)
    starts = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(3))))


def build(spark: SparkSession, path: str, columns: Sequence[str], into: str, partition: str = "event_date", within: Column | None = None) -> None:
    """Index the text columns of a table stored by ``partition``; with ``within`` only those partitions, whose index it replaces."""
    table = spark.read.parquet(path)
    rows = (table if within is None else table.where(within)).withColumn("file", F.regexp_extract("_metadata.file_path", _FILE, 1))
    texts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns])
    long = rows.select(partition, "file", F.inline(texts))
    bits = long.select(partition, "file", "column", F.explode(_grams(F.col("text"))).alias("gram")).withColumn("bit", _bit(F.col("gram")))
    maps = bits.groupBy(partition, "file", "column", F.bitmap_bucket_number("bit").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
    # A file without any trigram is known as well.
    known = long.select(partition, "file", "column").distinct().select("*", F.lit(-1).cast("bigint").alias("block"), F.lit(None).cast("binary").alias("bitmap"))
    (maps.unionByName(known).hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(into))


def literals(pattern: str) -> list[str]:
    """Texts that every match of a regular expression holds; none where that is not plain to see (alternatives, groups, flags)."""
    if re.search(r"[|(\[\\]", pattern):
        pattern = re.sub(r"\\.", "\0", pattern)
        if re.search(r"[|(\\]", pattern):
            return []
        pattern = re.sub(r"\[\^?\]?[^\]]*\]", "\0", pattern)
    pattern = re.sub(r".(?:[?*]|\{[^}]*\})[?+]?", "\0", pattern, flags=re.DOTALL)
    return [run for run in re.split(r"[\0.^$+]+", pattern) if len(run) >= 3]


def excluded(spark: SparkSession, index: DataFrame, column: str, needles: Sequence[str], fold: bool = True) -> list[str]:
    """The indexed files in which no value of the column can hold all the texts. With ``fold`` case does not matter."""
    usable = spark.createDataFrame([(n,) for n in needles], "needle STRING").select(F.explode(_grams(F.col("needle"))).alias("gram"))
    if fold:
        usable = usable.where(~F.col("gram").rlike(r"[^\x00-\x7f]"))
    wanted = usable.select(F.bitmap_bucket_number(_bit(F.col("gram"))).alias("block"), F.bitmap_bit_position(_bit(F.col("gram"))).alias("at")).distinct().collect()
    if not wanted:
        return []

    def has(at: int) -> Column:
        byte = F.conv(F.hex(F.substring("bitmap", at // 8 + 1, 1)), 16, 10).cast("int")
        return byte.bitwiseAND(1 << at % 8) != 0

    hits = [F.max(F.coalesce((F.col("block") == block) & has(at), F.lit(False))) for block, at in wanted]
    found = index.where((F.col("column") == column) & F.col("block").isin([-1, *{b for b, _ in wanted}])).groupBy("file").agg(
        F.array(*hits).alias("_hits"))
    return [r[0] for r in found.where(F.exists("_hits", lambda h: ~h)).select("file").collect()]  # at most the files, which are listed anyway


def narrowed(spark: SparkSession, path: str, index: str, needles: dict[str, Sequence[str]], fold: bool = True, every: bool = True) -> DataFrame:
    """The stored table without files that cannot hold the texts: in every one of the columns, or, without ``every``, in any of them.

    It only leaves files out; the search itself still has to be applied.
    """
    table, known = spark.read.parquet(path), spark.read.parquet(index)
    out = [set(excluded(spark, known, column, texts, fold)) for column, texts in needles.items()]
    gone = set.union(*out) if every else set.intersection(*out)
    files = table.inputFiles()
    left = [f for f in files if "/".join(f.split("/")[-2:]) not in gone]
    if len(left) == len(files):
        return table
    return spark.read.schema(table.schema).option("basePath", path).parquet(*left) if left else table.limit(0)
