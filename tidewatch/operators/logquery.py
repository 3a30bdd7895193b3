"""Log search: filter specifications compiled to one Column, then ordered, paged or counted."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import materialize

OPERATORS = ("eq", "ne", "contains", "not_contains", "starts_with", "ends_with",
             "gt", "lt", "gte", "lte", "in", "not_in", "regex")

SEARCH_FIELDS = ("message", "user_id", "resource_id", "event_type")


#: Values from which on a list is joined instead of compared in the plan.
LONG_LIST = 200


@dataclass(frozen=True)
class LogFilter:
    field: str
    op: str
    value: Any
    case_sensitive: bool = True


@dataclass(frozen=True)
class LogQuery:
    filters: Sequence[LogFilter] = field(default_factory=tuple)
    start: datetime | None = None
    end: datetime | None = None
    limit: int | None = None
    offset: int = 0
    sort_field: str = "ts"
    descending: bool = True


@dataclass(frozen=True)
class _Field:
    """A resolved field: its value as text, its family, and the typed value where there is one."""

    text: Column
    family: str
    value: Column
    variant: bool = False


_NUMERIC_SCHEMAS = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def _family(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "text"


def _as_text(value: Column, family: str) -> Column:
    text = value.cast("string")
    return F.initcap(text) if family == "boolean" else text


def resolve(df: DataFrame, path: str) -> _Field:
    """A top-level column, or a dotted path through structs, maps, VARIANT or JSON text."""
    names = {f.name: f.dataType for f in df.schema.fields}
    if path in names:
        return _Field(_as_text(F.col(f"`{path}`"), _family(names[path])), _family(names[path]), F.col(f"`{path}`"))
    head, _, rest = path.partition(".")
    if not rest or head not in names:
        return _Field(F.lit(None).cast("string"), "text", F.lit(None).cast("string"))
    value, kind, parts = F.col(f"`{head}`"), names[head], rest.split(".")
    while parts and isinstance(kind, (T.StructType, T.MapType)):
        step = parts.pop(0)
        if isinstance(kind, T.MapType):
            value, kind = value[step], kind.valueType
        elif step in kind.names:
            value, kind = value[step], kind[step].dataType
        else:
            return _Field(F.lit(None).cast("string"), "text", F.lit(None).cast("string"))
    if not parts:
        return _Field(_as_text(value, _family(kind)), _family(kind), value)
    node = value if isinstance(kind, T.VariantType) else F.try_parse_json(value.cast("string"))
    json_path = "$" + "".join(f"['{p}']" for p in parts)
    text = F.try_variant_get(node, json_path, "string")
    boolean = F.schema_of_variant(F.try_variant_get(node, json_path, "variant")) == "BOOLEAN"
    return _Field(F.when(boolean, F.initcap(text)).otherwise(text), "variant", F.try_variant_get(node, json_path, "variant"), True)


def _equals(f: _Field, value: Any, fold: bool) -> Column:
    """Typed equality: text never equals a number, whatever it spells."""
    if isinstance(value, bool):
        if f.variant:
            return (F.schema_of_variant(f.value) == "BOOLEAN") & (F.try_variant_get(f.value, "$", "boolean") == value)
        return f.value == value if f.family == "boolean" else F.lit(False)
    if isinstance(value, (int, float)):
        if f.variant:
            number = F.schema_of_variant(f.value).rlike(_NUMERIC_SCHEMAS)
            return number & (F.try_variant_get(f.value, "$", "double") == float(value))
        return f.value == value if f.family == "number" else F.lit(False)
    if isinstance(value, str):
        text = F.lower(f.text) if fold else f.text
        same = text == (value.lower() if fold else value)
        if f.variant:
            return (F.schema_of_variant(f.value) == "STRING") & same
        return same if f.family == "text" else F.lit(False)
    return F.lit(False)


_QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")


def _java_class(pattern: str, i: int) -> tuple[str, int]:
    """A character class that starts at ``i``, in Java syntax, and where it ends: brackets and ``&&`` inside are text."""
    out, i = "[", i + 1
    if pattern[i] == "^":
        out, i = "[^", i + 1
    first = i
    while pattern[i] != "]" or i == first:
        if pattern[i] == "\\":
            out, i = out + pattern[i:i + 2], i + 2
            continue
        out, i = out + ("\\" + pattern[i] if pattern[i] in "[]&" else pattern[i]), i + 1
    return out + "]", i + 1


def java_pattern(pattern: str, fold: bool, spark: SparkSession | None = None) -> str | None:
    """A Python pattern in Java syntax with the same meaning, or None where either language cannot compile it (a bad
    rlike fails the whole query)."""
    try:
        names = re.compile(pattern).groupindex
    except (re.error, OverflowError, RecursionError):
        return None
    out, i = [], 0
    while i < len(pattern):
        named = re.match(r"\(\?P([<=])(\w+)[>)]", pattern[i:])
        count = _QUANTIFIER.match(pattern, i)
        if pattern[i] == "\\":
            out.append("\\z" if pattern[i:i + 2] == "\\Z" else pattern[i:i + 2])
            i += 2
        elif pattern[i] == "[":
            text, i = _java_class(pattern, i)
            out.append(text)
        elif named:
            group = f"g{names[named[2]]}"
            out.append(f"(?<{group}>" if named[1] == "<" else f"\\k<{group}>")
            i += named.end()
        elif pattern[i] == "{" and count and (count[1] or count[3]) and (count[2] or not count[3]):
            out.append(f"{{{count[1] or 0}{count[2]}{count[3]}}}")
            i = count.end()
        else:
            out.append("\\{" if pattern[i] == "{" else pattern[i])
            i += 1
    # Only a line feed ends a line, and classes such as \\w know all letters.
    java = f"(?{'iu' if fold else ''}dU)" + "".join(out)
    spark = spark or SparkSession.getActiveSession()
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except Exception:  # any complaint of the Java compiler
        return None
    return java


def predicate(df: DataFrame, spec: LogFilter) -> Column:
    """One filter as a boolean Column that is never null. A missing value satisfies only ``ne``."""
    if spec.op not in OPERATORS:
        raise ValueError(f"unknown operator {spec.op!r}")
    f = resolve(df, spec.field)
    fold, value = not spec.case_sensitive, spec.value
    text = F.lower(f.text) if fold else f.text
    needle = str(value).lower() if fold and isinstance(value, str) else str(value)
    if spec.op == "ne":
        return f.text.isNull() | ~_equals(f, value, fold)
    if spec.op == "eq":
        test = _equals(f, value, fold)
    elif spec.op == "contains":
        test = text.contains(needle)
    elif spec.op == "not_contains":
        test = ~text.contains(needle)
    elif spec.op == "starts_with":
        test = text.startswith(needle)
    elif spec.op == "ends_with":
        test = text.endswith(needle)
    elif spec.op in ("gt", "lt", "gte", "lte"):
        test = _compare(f, spec.op, value)
    elif spec.op in ("in", "not_in"):
        if not isinstance(value, (list, tuple, set)):
            test = F.lit(spec.op == "not_in")
        else:
            member = _member(f, list(value))
            test = member if spec.op == "in" else ~member
    else:
        pattern = java_pattern(str(value), fold, df.sparkSession)
        test = f.text.rlike(pattern) if pattern is not None else F.lit(False)
    if isinstance(test, Column):
        return f.text.isNotNull() & test
    return test


def _typed(f: _Field, values: Sequence[Any]) -> list[tuple[Column, Column, list[Any]]]:
    """For each type that a nested value may have: whether it has it, its value, and the list's values of that type."""
    kind = F.schema_of_variant(f.value)
    return [(kind == "STRING", f.text, [v for v in values if isinstance(v, str)]),
            (kind.rlike(_NUMERIC_SCHEMAS), F.try_variant_get(f.value, "$", "double"), [float(v) for v in values if _is_number(v)]),
            (kind == "BOOLEAN", F.try_variant_get(f.value, "$", "boolean"), [v for v in values if isinstance(v, bool)])]


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _is_long_list(spec: LogFilter) -> bool:
    return spec.op in ("in", "not_in") and isinstance(spec.value, (list, tuple, set)) and len(spec.value) > LONG_LIST


def _where_listed(df: DataFrame, spec: LogFilter) -> DataFrame:
    """Membership of a long list as a join with its values: semi for ``in``, anti for ``not_in``. Which join it becomes is the
    planner's choice."""
    f, values = resolve(df, spec.field), list(spec.value)
    if f.variant:
        # One text per type and value, so that a text never equals a number.
        key = F.coalesce(*[F.when(own, F.concat(F.lit(f"{i}:"), value.cast("string"))) for i, (own, value, _) in enumerate(_typed(f, values))])
        wanted = [f"{i}:{v if i == 0 else str(v).lower()}" for i, (_, _, found) in enumerate(_typed(f, values)) for v in found if i != 1]
        listed = df.sparkSession.createDataFrame([(v,) for v in wanted], "_listed string")
        numbers = [(float(v),) for v in values if _is_number(v)]
        listed = listed.unionByName(df.sparkSession.createDataFrame(numbers, "_n double").select(F.concat(F.lit("1:"), F.col("_n").cast("string")).alias("_listed")))
    else:
        schema = {"number": "double", "boolean": "boolean", "text": "string"}[f.family]
        whole = f.family == "number" and isinstance(df.select(f.value.alias("v")).schema["v"].dataType, T.IntegralType)
        kept = [v for v in values if {"number": _is_number(v), "boolean": isinstance(v, bool), "text": isinstance(v, str)}[f.family]]
        if whole:
            schema, kept = "bigint", [int(v) for v in kept if v == v and abs(v) < 1 << 63 and int(v) == v]
        elif f.family == "number":
            kept = [float(v) for v in kept]
        key, listed = f.value if whole or f.family != "number" else f.value.cast("double"), df.sparkSession.createDataFrame([(v,) for v in kept], f"_listed {schema}")
    rows = df.where(f.text.isNotNull())
    return rows.join(listed.distinct(), key == F.col("_listed"), "left_semi" if spec.op == "in" else "left_anti")


def _member(f: _Field, values: list[Any]) -> Column:
    """List membership. Plain columns use IN, so that it can reach the scan; VARIANT compares by type."""
    if f.variant:
        return reduce(lambda a, b: a | b, [own & key.isin(found) for own, key, found in _typed(f, values) if found], F.lit(False))
    wanted = {"number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
              "boolean": lambda v: isinstance(v, bool),
              "text": lambda v: isinstance(v, str)}[f.family]
    values = [v for v in values if wanted(v)]
    return f.value.isin(values) if values else F.lit(False)


def _compare(f: _Field, op: str, value: Any) -> Column:
    try:
        bound = float(value)
    except (TypeError, ValueError):
        return F.lit(False)
    if bound != bound:
        return F.lit(False)
    if f.family == "number":
        number = f.value
    else:
        number = F.when(f.text == "True", 1.0).when(f.text == "False", 0.0).otherwise(f.text.try_cast("double"))
    test = {"gt": number > bound, "lt": number < bound, "gte": number >= bound, "lte": number <= bound}[op]
    # NaN sorts above every number here, yet must satisfy no comparison.
    test = test & ~F.isnan(number.cast("double"))
    return test if f.family == "number" else F.coalesce(test, F.lit(False))


def in_range(ts: str, start: datetime | None, end: datetime | None) -> Column | None:
    """Inclusive at both ends; a row without a timestamp passes."""
    tests = []
    if start is not None:
        tests.append(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        tests.append(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return F.col(ts).isNull() | reduce(lambda a, b: a & b, tests) if tests else None


def in_days(day: str, start: datetime | None, end: datetime | None) -> Column | None:
    """The days that a time range touches, and the folder of rows without a time."""
    tests = []
    if start is not None:
        tests.append(F.col(day) >= F.lit(start.date()))
    if end is not None:
        tests.append(F.col(day) <= F.lit(end.date()))
    return F.col(day).isNull() | reduce(lambda a, b: a & b, tests) if tests else None


def where(df: DataFrame, query: LogQuery, ts: str = "ts", day: str = "event_date") -> DataFrame:
    """The matching rows, unordered. Every test sits in one conjunction so that Catalyst can push parts down; a table with
    one folder per ``day`` opens only the days of the time range. Lists of more than ``LONG_LIST`` values are joined."""
    tests = [predicate(df, f) for f in query.filters if not _is_long_list(f)]
    span = in_range(ts, query.start, query.end)
    if span is not None:
        tests.insert(0, span)
        if day in df.columns and isinstance(df.schema[day].dataType, T.DateType):
            tests.insert(0, in_days(day, query.start, query.end))
    kept = df.where(reduce(lambda a, b: a & b, tests)) if tests else df
    return reduce(_where_listed, filter(_is_long_list, query.filters), kept)


def sort_columns(df: DataFrame, field_path: str, descending: bool, tie: Sequence[str]) -> list[Column]:
    """Total order: the field (missing sorts as empty text), then the tie-break columns ascending."""
    f = resolve(df, field_path)
    key = F.coalesce(f.text, F.lit("")) if f.family in ("text", "variant") and not _is_temporal(df, field_path) else f.value
    return [key.desc_nulls_last() if descending else key.asc_nulls_first(), *[F.col(c).asc() for c in tie]]


def _is_temporal(df: DataFrame, name: str) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def page(df: DataFrame, order: list[Column], limit: int | None, offset: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the order; no limit (or 0) means the rest.

    A page is a top-k of ``offset + limit`` rows. Skipping without a limit goes by position in a range-partitioned sort,
    as it would otherwise pull the table through one task. Rows that the order leaves equal follow the rest of their
    plain columns, so that pages of any depth neither repeat nor lose rows.
    """
    order = [*order, *[F.col(f"`{f.name}`").asc() for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]]
    if limit:
        return df.orderBy(*order).offset(max(offset, 0)).limit(limit)
    return _skipped(df, order, offset) if offset > 0 else df.orderBy(*order)


def _skipped(df: DataFrame, order: list[Column], offset: int) -> DataFrame:
    """Sort by range into partitions, count them, and number rows only in the partition in which the skip ends.

    The sorted rows are written first, since a recomputed range partitioning need not cut at the same rows.
    Only one count per partition comes to the driver.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    stored = materialize(ranged, "sorted")
    sizes = sorted((r["_part"], r["n"]) for r in stored.groupBy("_part").agg(F.count("*").alias("n")).collect())
    whole, cut, left = [], None, offset
    for part, n in sizes:
        if left <= 0:
            whole.append(part)
        elif left < n:
            cut = (part, left)
        left -= n
    rows = stored.where(F.col("_part").isin(whole)) if whole else stored.where("false")
    if cut:
        number = F.row_number().over(W.partitionBy("_part").orderBy(*order))
        end = stored.where(F.col("_part") == cut[0]).withColumn("_number", number)
        rows = rows.unionByName(end.where(F.col("_number") > cut[1]).drop("_number"))
    return rows.drop("_part").orderBy(*order)


def run(df: DataFrame, query: LogQuery, key: Sequence[str] = ("event_id",), ts: str = "ts") -> DataFrame:
    matched = where(df, query, ts)
    order = sort_columns(matched, query.sort_field, query.descending, key)
    return page(matched, order, query.limit, query.offset)


def search(df: DataFrame, term: str, fields: Sequence[str] = SEARCH_FIELDS, case_sensitive: bool = False,
           regex: bool = False, limit: int = 100, key: Sequence[str] = ("event_id",), ts: str = "ts") -> DataFrame:
    """Newest rows in which any of the fields matches. Rows are matched first and limited afterwards."""
    tests = [predicate(df, LogFilter(f, "regex" if regex else "contains", term, case_sensitive)) for f in fields]
    matched = df.where(reduce(lambda a, b: a | b, tests))
    return page(matched, sort_columns(matched, ts, True, key), limit, 0)


def last_hours(hours: float, as_of: datetime, *filters: LogFilter, limit: int | None = None) -> LogQuery:
    return LogQuery(filters=filters, start=as_of - timedelta(hours=hours), end=as_of, limit=limit)


def user_activity(user_id: str, hours: float, as_of: datetime) -> LogQuery:
    return last_hours(hours, as_of, LogFilter("user_id", "eq", user_id))


def error_logs(hours: float, as_of: datetime) -> LogQuery:
    return last_hours(hours, as_of, LogFilter("level", "in", ["ERROR", "CRITICAL"]))


def resource_activity(resource_type: str, resource_id: str, hours: float, as_of: datetime) -> LogQuery:
    return last_hours(hours, as_of, LogFilter("resource_type", "eq", resource_type), LogFilter("resource_id", "eq", resource_id))


# --- counting -----------------------------------------------------------------------------------

STATISTIC_FIELDS = ("level", "event_type", "user_id", "resource_type")


def count_by(df: DataFrame, path: str) -> DataFrame:
    """Rows per value of a (nested) field; rows without the field are left out."""
    return (df.select(resolve(df, path).text.alias("value")).where("value IS NOT NULL")
            .groupBy("value").agg(F.count("*").alias("n")))


def statistics(df: DataFrame) -> DataFrame:
    """Total and counts by level, event type, user and resource type, as (section, value, n), in one pass."""
    return _sections(_statistic_columns(df), [], list(STATISTIC_FIELDS), total=True)


def time_span(df: DataFrame, ts: str = "ts") -> DataFrame:
    seconds = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1e6
    return df.agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), seconds.alias("duration_seconds"))


def rollup(df: DataFrame, fields: Sequence[str], period: str | None = None, ts: str = "ts") -> DataFrame:
    """Statistics plus a count per configured field, per period ('1 day', '1 hour') or overall.

    One scan and one shuffle: every section is a grouping set of the same aggregation.
    """
    extra = [resolve(df, f).text.alias(f"field:{f}") for f in fields]
    base = _statistic_columns(df, *extra, *([F.window(ts, period).getField("start").alias("period_start")] if period else []))
    keys = ["period_start"] if period else []
    return _sections(base, keys, [*STATISTIC_FIELDS, *[f"field:{f}" for f in fields]], total=True)


def _statistic_columns(df: DataFrame, *extra: Column) -> DataFrame:
    unknown = [F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in ("level", "event_type", "user_id")]
    resource = F.when(F.col("resource_type") != "", F.col("resource_type")).alias("resource_type")
    return df.select(*unknown, resource, *extra)


def _sections(df: DataFrame, keys: list[str], sections: list[str], total: bool) -> DataFrame:
    quoted = [F.col(f"`{s}`") for s in sections]
    sets = [[*[F.col(k) for k in keys], c] for c in quoted]
    if total:
        sets.append([F.col(k) for k in keys])
    by = [*[F.col(k) for k in keys], *quoted]
    grouped = df.groupingSets(sets, *by).agg(
        F.count("*").alias("n"),
        *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(quoted)])
    section, value = F.lit("total"), F.lit("all")
    for i, name in enumerate(sections):
        section = F.when(F.col(f"_g{i}") == 0, F.lit(name)).otherwise(section)
        value = F.when(F.col(f"_g{i}") == 0, F.col(f"`{name}`")).otherwise(value)
    return (grouped.select(*keys, section.alias("section"), value.alias("value"), "n")
            .where(F.col("value").isNotNull()))
