"""Latest row and newest rows per key, built so that one hot key never lands in one task unreduced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None,
           first: bool = False) -> DataFrame:
    """One row per key: the one with the greatest (or least) order. An aggregate, so it is reduced before the shuffle."""
    keep = [c for c in df.columns if c not in keys] if keep is None else list(keep)
    pick = F.min_by if first else F.max_by
    best = pick(F.struct(*keep), F.struct(*order) if len(order) > 1 else F.col(order[0]))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, *[F.col("_best")[c].alias(c) for c in keep])


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salt_by: Sequence[str],
           salts: int = 32, rank: str = "rn") -> DataFrame:
    """At most ``n`` rows per key in the given order, numbered from 1.

    Every key is split over ``salts`` groups; each group keeps its own best ``n`` (Spark also cuts to
    ``n`` before the shuffle), so the final pass sees at most ``salts * n`` rows of any key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)))
    part = W.partitionBy(*keys, "_salt").orderBy(*order)
    survivors = salted.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    return survivors.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)
