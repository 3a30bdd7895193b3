"""Joins shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match; the key columns come from the left side only."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in on], *[c for c in right.columns if c not in on])
    return left.join(renamed, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in on], how).drop(*[f"_r_{k}" for k in on])
