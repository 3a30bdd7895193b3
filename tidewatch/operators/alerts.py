"""Alert rules over metrics and health, alert state per round, episodes and routing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Severities and states.
SEVERITIES = ("critical", "warning", "info")
STATES = ("firing", "pending", "resolved")
ALERT_COLUMNS = ("name", "severity", "state", "message", "labels", "annotations")


@dataclass(frozen=True)
class ThresholdRule:
    name: str
    severity: str
    metric: str
    threshold: float
    comparison: str = "greater_than"


@dataclass(frozen=True)
class HealthRule:
    name: str
    severity: str
    target_status: str
    check_names: tuple[str, ...] | None = None


@dataclass(frozen=True)
class ErrorRateRule:
    name: str
    severity: str
    threshold: float = 0.05
    errors: str = "errors_total"
    requests: str = "requests_total"


def compare(value: Column, comparison: Column, threshold: Column) -> Column:
    """The comparison named by the row; an unknown name never triggers."""
    return (F.when(comparison == "greater_than", value > threshold)
            .when(comparison == "less_than", value < threshold)
            .when(comparison == "equals", value == threshold)
            .otherwise(False))


def rule_array(rules: Sequence) -> Column:
    """Rules as an array literal, so that they travel inside the plan instead of as a joined table."""
    def literal(v):
        return F.array(*[F.lit(x) for x in v]) if isinstance(v, tuple) else F.lit(v)
    return F.array(*[F.struct(*[literal(v).alias(k) for k, v in vars(r).items()]) for r in rules])


def metric_values(totals: DataFrame) -> DataFrame:
    """Series rows as (metric, priority, value): counters first, then gauges, then histogram counts; timers are not looked up."""
    priority = F.when(F.col("kind") == "counter", 1).when(F.col("kind") == "gauge", 2).when(F.col("kind") == "histogram", 3)
    value = (F.when(F.col("kind") == "counter", F.col("sum")).when(F.col("kind") == "gauge", F.col("last"))
             .otherwise(F.col("count").cast("double")))
    return totals.where(priority.isNotNull()).select(F.col("key").alias("metric"), priority.alias("priority"), value.alias("value"))


def resolve_metrics(rules: Sequence[ThresholdRule], values: DataFrame) -> DataFrame:
    """Each rule with its metric's value: the counter of that name, else the gauge, else the histogram count."""
    wanted = values.where(F.col("metric").isin([r.metric for r in rules]))
    found = wanted.groupBy("metric").agg(F.min_by("value", "priority").alias("value"))
    listed = values.sparkSession.range(1).select(F.explode(rule_array(rules)).alias("r")).select("r.*")
    return listed.join(found, "metric", "left")


def threshold_alerts(rules: Sequence[ThresholdRule], values: DataFrame) -> DataFrame:
    rows = resolve_metrics(rules, values).where(compare(F.col("value"), F.col("comparison"), F.col("threshold")))
    message = F.concat(F.lit("Metric "), F.col("metric"), F.lit(" is "), F.col("value").cast("string"),
                       F.lit(" (threshold: "), F.col("threshold").cast("string"), F.lit(")"))
    return _alert(rows, message, "metric_threshold", metric_name=F.col("metric"), current_value=F.col("value").cast("string"),
                  threshold=F.col("threshold").cast("string"), comparison=F.col("comparison"))


def health_alerts(rules: Sequence[HealthRule], results: DataFrame, summary: DataFrame) -> DataFrame:
    """Rules over the last result of each check, or over the overall status where no checks are named."""
    named = [r for r in rules if r.check_names is not None]
    general = [r for r in rules if r.check_names is None]
    alerts = []
    if named:
        # A result meets only the rules that it makes fire.
        met = F.filter(rule_array(named), lambda r: F.array_contains(r["check_names"], F.col("name")) & (F.col("status") == r["target_status"]))
        failing = (results.select(F.col("name").alias("check"), F.explode(met).alias("r"))
                   .groupBy("r.name", "r.severity", "r.target_status")
                   .agg(F.array_sort(F.collect_set("check")).alias("failing")))
        alerts.append(_alert(failing, F.concat(F.lit("Health checks failing: "), F.array_join("failing", ", ")), "health_status",
                             failing_checks=F.array_join("failing", ","), target_status=F.col("target_status")))
    if general:
        rows = (summary.select("overall_status", "unhealthy_count", "total_checks", F.explode(rule_array(general)).alias("r"))
                .select("overall_status", "unhealthy_count", "total_checks", "r.name", "r.severity", "r.target_status")
                .where(F.col("overall_status") == F.col("target_status")))
        alerts.append(_alert(rows, F.concat(F.lit("System health is "), F.col("target_status")), "health_status",
                             overall_status=F.col("overall_status"), unhealthy_count=F.col("unhealthy_count").cast("string"),
                             total_checks=F.col("total_checks").cast("string")))
    return reduce(lambda a, b: a.unionByName(b), alerts)


def error_rate(values: DataFrame, errors: str, requests: str) -> DataFrame:
    """Errors over requests as one row, or none when there are no requests."""
    counted = values.where((F.col("priority") == 1) & F.col("metric").isin(errors, requests)).agg(
        F.coalesce(F.sum(F.when(F.col("metric") == errors, F.col("value"))), F.lit(0.0)).alias("errors"),
        F.coalesce(F.sum(F.when(F.col("metric") == requests, F.col("value"))), F.lit(0.0)).alias("requests"))
    return counted.where("requests <> 0").withColumn("rate", F.col("errors") / F.col("requests"))


def error_rate_alerts(rules: Sequence[ErrorRateRule], values: DataFrame) -> DataFrame:
    """All rules over one aggregate of the counters they name; a rule without requests does not fire."""
    names = sorted({n for r in rules for n in (r.errors, r.requests)})
    totals = values.where((F.col("priority") == 1) & F.col("metric").isin(names)).agg(
        F.create_map(*[c for n in names for c in (F.lit(n), F.coalesce(F.sum(F.when(F.col("metric") == n, F.col("value"))), F.lit(0.0)))]).alias("_totals"))
    listed = F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(r.severity).alias("severity"), F.lit(r.errors).alias("e"), F.lit(r.requests).alias("q"),
                                F.lit(float(r.threshold)).alias("limit"), F.lit(f"{r.threshold:.2%}").alias("limit_text")) for r in rules])
    rows = totals.select("_totals", F.inline(listed)).select("name", "severity", "limit", "limit_text", F.col("_totals")[F.col("e")].alias("errors"),
                                                             F.col("_totals")[F.col("q")].alias("requests"))
    rows = rows.where("requests <> 0").withColumn("rate", F.col("errors") / F.col("requests")).where("rate > limit")
    rate = F.format_string("%.2f%%", F.col("rate") * 100)
    return _alert(rows, F.concat(F.lit("High error rate: "), rate, F.lit(" (threshold: "), F.col("limit_text"), F.lit(")")), "error_rate",
                  error_rate=rate, error_count=F.col("errors").cast("string"), request_count=F.col("requests").cast("string"), threshold=F.col("limit_text"))


# Fixed wording: alert messages are matched on by those who receive them, so their sentences stay as they are.
def _alert(rows: DataFrame, message: Column, kind: str, **annotations: Column) -> DataFrame:
    notes = F.create_map(*[c for k, v in annotations.items() for c in (F.lit(k), v)])
    return rows.select("name", "severity", F.lit("firing").alias("state"), message.alias("message"),
                       F.create_map(F.lit("alert_type"), F.lit(kind)).alias("labels"), notes.alias("annotations"))


# A rule is any function of (metric values, last health results, health summary) that returns alert rows.
Rule = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


class RuleSet:
    """Registered alert rules, evaluated together."""

    def __init__(self) -> None:
        self._rules: list[Rule] = []

    def add(self, rule: Rule) -> RuleSet:
        self._rules.append(rule)
        return self

    def add_thresholds(self, *rules: ThresholdRule) -> RuleSet:
        return self.add(lambda values, results, summary: threshold_alerts(rules, values))

    def add_health(self, *rules: HealthRule) -> RuleSet:
        return self.add(lambda values, results, summary: health_alerts(rules, results, summary))

    def add_error_rates(self, *rules: ErrorRateRule) -> RuleSet:
        return self.add(lambda values, results, summary: error_rate_alerts(rules, values))

    def evaluate(self, values: DataFrame, results: DataFrame, summary: DataFrame) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b),
                      [r(values, results, summary).select(*ALERT_COLUMNS) for r in self._rules])


# --- state over rounds --------------------------------------------------------------------------

def firing_grid(rounds: DataFrame, rules: Sequence[ThresholdRule], metric_columns: Sequence[str], by: str = "round") -> DataFrame:
    """(round, name, severity, firing) for every rule in every round.

    ``rounds`` has one row per round with a column per metric: an aggregate, bounded by time and not
    by rows. The rules are exploded from a literal, so there is no join.
    """
    values = F.create_map(*[c for m in metric_columns for c in (F.lit(m), F.col(m).cast("double"))])
    rows = rounds.select(by, values.alias("_values"), F.explode(rule_array(rules)).alias("r"))
    value = F.try_element_at("_values", F.col("r.metric"))
    firing = F.coalesce(compare(value, F.col("r.comparison"), F.col("r.threshold")), F.lit(False))
    return rows.select(by, F.col("r.name").alias("name"), F.col("r.severity").alias("severity"), firing.alias("firing"))


def transitions(grid: DataFrame, by: str = "round") -> DataFrame:
    """Rows on which the state of a rule changes; a rule starts out resolved and that is not reported."""
    before = F.coalesce(F.lag("firing").over(W.partitionBy("name").orderBy(by)), F.lit(False))
    changed = grid.withColumn("_before", before).where(F.col("firing") != F.col("_before"))
    return changed.select(by, "name", "severity", F.when(F.col("firing"), "firing").otherwise("resolved").alias("state"))


def episodes(grid: DataFrame, by: str = "round") -> DataFrame:
    """Firing episodes: first firing round, the round that resolved it (null while open), rounds fired."""
    order = W.partitionBy("name").orderBy(by)
    starts = F.col("firing") & ~F.coalesce(F.lag("firing").over(order), F.lit(False))
    marked = grid.withColumn("_next", F.lead(by).over(order)).withColumn("_start", starts.cast("int"))
    numbered = marked.withColumn("_episode", F.sum("_start").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return (numbered.where("firing").groupBy("name", "severity", "_episode")
            .agg(F.min(by).alias("starts_at"), F.max_by("_next", by).alias("ends_at"), F.count("*").alias("rounds"))
            .drop("_episode"))


def resolved(previous: DataFrame, current: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Alerts that fired before and do not fire now."""
    return previous.join(current.select(*keys), list(keys), "left_anti")


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Firing alerts per severity, zeros included, and over all."""
    active = alerts.where("state = 'firing'").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count("*").alias("active"))
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in (*SEVERITIES, "active")]))
    return active.select(pairs.alias("p")).select("p.*")


def overall_status(health: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: the health status, or what the firing alerts make of it."""
    fired = alerts.where("state = 'firing'").select(F.lit(None).cast("string").alias("overall_status"), F.lit(1).alias("_a"), (F.col("severity") == "critical").alias("_c"))
    given = health.select("overall_status", F.lit(0).alias("_a"), F.lit(False).alias("_c"))
    one = given.unionByName(fired).agg(F.max("overall_status").alias("overall_status"), F.coalesce(F.sum("_a"), F.lit(0)).alias("active"),
                                       F.count_if("_c").alias("critical"))
    status = (F.when(F.col("overall_status").isin("unhealthy", "degraded"), F.col("overall_status"))
              .when(F.col("critical") > 0, "unhealthy").when(F.col("active") > 0, "degraded").otherwise("healthy"))
    return one.select(status.alias("status"), "overall_status", "active", "critical")


def route(alerts: DataFrame) -> DataFrame:
    """Log level and text line of each alert, as written to the alert table."""
    return alerts.select("*", F.when(F.col("severity") == "critical", "ERROR").otherwise("WARNING").alias("log_level"),
                         F.concat(F.lit("ALERT ["), F.upper("severity"), F.lit("] "), F.col("name"), F.lit(": "), F.col("message")).alias("line"))


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Append alerts with their log level and line to an alert table, one folder per log level."""
    route(alerts).write.mode("append").partitionBy("log_level").parquet(path)


def alert_history(changes: DataFrame, last: int = 1000, by: str = "round") -> DataFrame:
    """The newest ``last`` state changes over all rules, numbered from the newest."""
    top = changes.orderBy(F.desc(by), "name").limit(last)  # bounded by ``last``
    return top.withColumn("rn", F.row_number().over(W.orderBy(F.desc(by), "name")))
