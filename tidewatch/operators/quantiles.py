"""Exact quantiles and load reports per group without gathering a group, from sketches that may be kept per period."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators.joins import null_safe
from tidewatch.session import materialize

#: Size of a sketch: ranks are right to about 0.0007 of a group's values, in some 70 KB for a group of any size.
SKETCH_K = 8192
#: Distance of the bounds from a wanted rank, and the number of values from which on it leaves room for the sketch's error and the
#: neighbours; groups with fewer take the wider one, and groups with too few for that rank all their values.
MARGIN, ENOUGH = 0.0015, 4000
WIDE, ENOUGH_WIDE = 0.02, 120


def sketch(value: Column) -> Column:
    """Aggregate: a mergeable sketch of the values, for ``exact_quantiles``."""
    return F.kll_sketch_agg_double(value.cast("double"), F.lit(SKETCH_K))


def merged(part: Column) -> Column:
    """Aggregate: the sketch of all values behind sketches."""
    return F.kll_merge_agg_double(part, F.lit(SKETCH_K))


def _bounds(cut: int, fraction: float, cuts: Column, margin: float) -> tuple[Column, Column]:
    """The values between which the wanted rank of a cut should lie, from the four quantiles taken for it."""
    if margin >= 1:
        return F.lit(float("-inf")), F.lit(float("inf"))
    n = F.col("_n")
    return tuple(F.when(n >= ENOUGH, cuts[4 * cut + side]).when(n >= ENOUGH_WIDE, cuts[4 * cut + 2 + side]).otherwise(F.lit(end))
                 for side, end in enumerate((float("-inf"), float("inf"))))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, at: dict[str, tuple[int, int]],
                    totals: dict[str, Column] | None = None, margin: float = MARGIN, sketches: DataFrame | None = None) -> DataFrame:
    """Cut points i/m per group by the exclusive method: with n values, the point i*(n+1)/m between sorted
    neighbours, clamped to the first and last pair; a single value stands for itself; null without values.

    A sketch per group (and any further ``totals``) bounds the values around each wanted rank. One read then counts the values
    outside the bounds per gap and the distinct values inside one by one, about ``2 * margin`` of the rows per cut point, and a running
    count over these rows gives the ranks. Where a wanted rank still falls into a gap of several values, those groups are read again
    with wider bounds: a poor sketch costs time, never exactness. ``sketches`` may bring one row per group, merged from stored periods:
    the keys, ``_n`` values, ``_sketch`` and columns that are handed on. Needs at least one key; groups with a null key are kept.
    """
    v = F.col(value).cast("double")
    if sketches is None:
        sketches = df.groupBy(*keys).agg(F.count(v).alias("_n"), sketch(v).alias("_sketch"), *[c.alias(n) for n, c in (totals or {}).items()])
    fractions = [i / m for i, m in at.values()]
    wide = max(margin, WIDE)
    wanted = [min(max(f + d, 0.0), 1.0) for f in fractions for d in (-margin, margin, -wide, wide)]
    cuts = F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(w) for w in wanted])))
    rows = sketches.withColumn("_cuts", cuts)
    ends = {f"_{side}{k}": b for k, f in enumerate(fractions) for side, b in zip(("lo", "hi"), _bounds(k, f, F.col("_cuts"), margin))}
    bounded = materialize(rows.select(*keys, *[c for c in sketches.columns if c not in (*keys, "_sketch", "_n")], *[b.alias(n) for n, b in ends.items()]), "bounds")

    values = df.select(*keys, v.alias("_v")).where("_v IS NOT NULL")
    near = reduce(lambda a, b: a | b, [F.col("_v").between(F.col(f"_lo{k}"), F.col(f"_hi{k}")) for k in range(len(at))])
    gap = reduce(lambda a, b: a + b, [F.when(F.col("_v") > F.col(f"_hi{k}"), 1).otherwise(0) for k in range(len(at))])
    placed = null_safe(values, bounded.select(*keys, *ends), keys).select(*keys, "_v", near.alias("_near"), gap.alias("_gap"))
    counted = placed.groupBy(*keys, F.when(F.col("_near"), F.col("_v")).alias("_slot"), F.when(~F.col("_near"), F.col("_gap")).alias("_gap")).agg(
        F.min("_v").alias("_v"), F.max("_v").alias("_top"), F.count("*").alias("_c"))
    whole = W.partitionBy(*keys)
    ranked = counted.withColumns({"_n": F.sum("_c").over(whole),
                                  "_last": F.sum("_c").over(whole.orderBy("_v").rowsBetween(W.unboundedPreceding, 0))})
    n, first = F.col("_n"), F.col("_last") - F.col("_c") + 1
    picks, missed, points = [], F.lit(False), []
    for k, (name, (i, m)) in enumerate(at.items()):
        j = F.greatest(F.lit(1), F.least(F.floor(F.lit(i) * (n + 1) / F.lit(m)), n - 1))
        for part, rank in (("a", j), ("b", F.least(j + 1, n))):
            here = (rank >= first) & (rank <= F.col("_last"))
            missed = missed | (here & (F.col("_v") < F.col("_top")))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{part}{k}"))
        picks.append(F.max(F.lit(i) * (n + 1) - j * F.lit(m)).alias(f"_d{k}"))
        low, high, delta = (F.col(f"_{part}{k}") for part in "abd")
        points.append(F.when(F.col("_n") == 1, low).otherwise((low * (F.lit(m) - delta) + high * delta) / F.lit(m)).alias(name))
    found = materialize(ranked.groupBy(*keys).agg(*picks, F.max("_n").alias("_n"), F.bool_or(missed).alias("_missed")), "points")
    result = found.where(~F.col("_missed")).select(*keys, *points)
    again = found.where("_missed").select(*keys)
    if not again.isEmpty():
        wider = 1.0 if margin >= WIDE else WIDE
        redone = exact_quantiles(null_safe(df.select(*keys, value), again, keys, "left_semi"), keys, value, at, margin=wider)
        result = result.unionByName(redone.select(*keys, *at))
    return null_safe(bounded.drop(*ends), result, keys, "left")


def _load_totals(df: DataFrame, keys: Sequence[str], success: Column, duration: str, start: Column, end: Column) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with their successful durations, and what adds up over them."""
    marked = df.withColumn("_ok", success).withColumn("_good", F.when(F.col("_ok"), F.col(duration)))
    return marked, {"operations": F.count("*"), "successes": F.count_if("_ok"), "_total": F.sum(F.col("_good").cast("double")),
                    "_first": F.min(F.unix_micros(start.cast("timestamp"))), "_end": F.max(F.unix_micros(end.cast("timestamp")))}


def load_periods(df: DataFrame, keys: Sequence[str], period: Column, success: Column, duration: str, start: Column, end: Column) -> DataFrame:
    """What a load report needs, per group and period, to be stored: totals that add up and a sketch that merges."""
    marked, totals = _load_totals(df, keys, success, duration, start, end)
    return marked.groupBy(*keys, period.alias("period")).agg(
        F.count("_good").alias("_n"), sketch(F.col("_good")).alias("_sketch"), *[c.alias(n) for n, c in totals.items()])


def load_report(df: DataFrame, keys: Sequence[str], success: Column, duration: str, start: Column, end: Column,
                quantiles: dict[str, tuple[int, int]], periods: DataFrame | None = None) -> DataFrame:
    """Success rate, mean and quantiles of successful durations, and successes per second, per group.

    With ``periods``, stored rows of ``load_periods`` over the same data, the rows are read once, for the exact ranks only.
    """
    marked, totals = _load_totals(df, keys, success, duration, start, end)
    sketches = None
    if periods is not None:
        sums = [F.sum(c).alias(c) for c in ("_n", "operations", "successes", "_total")]
        sketches = periods.groupBy(*keys).agg(*sums, F.min("_first").alias("_first"), F.max("_end").alias("_end"), merged(F.col("_sketch")).alias("_sketch"))
        sketches = sketches.withColumn("_good", F.col("_n"))
    report = exact_quantiles(marked, keys, "_good", quantiles, {**totals, "_good": F.count("_good")}, sketches=sketches)
    span = (F.col("_end") - F.col("_first")) / 1e6
    return report.withColumns({
        "success_rate": F.col("successes") / F.col("operations"), "mean": F.coalesce(F.try_divide("_total", "_good"), F.lit(0.0)),
        "throughput": F.col("successes") / F.nullif(span, F.lit(0.0)), "span_s": span,
        **{q: F.coalesce(q, F.lit(0.0)) for q in quantiles}}).drop("_total", "_good", "_first", "_end")
