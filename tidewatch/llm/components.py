"""Connected components of a graph of links, distributed: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the smallest node it knows."""
    both = edges.select("u", "v").union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node with a link; ``edges`` has long columns u and v, the root is the component's
    smallest node. Each round is written to the shared folder, which cuts the lineage."""
    state = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    seen = state.agg(F.count(F.lit(1)), digest).first()
    if seen[0]:
        for _ in range(rounds):
            state = materialize(_small_star(_large_star(state)), "stars")
            now = state.agg(F.count(F.lit(1)), digest).first()
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select(F.col("v"), F.col("v"))).distinct()
