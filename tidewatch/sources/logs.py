"""Log files: JSON lines with a plain-text fallback, and what could not be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.texttime import parse_iso

# Fixed value: the text log layout, time [LEVEL] logger: message.
TEXT_LAYOUT = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \[(\w+)\] ([^:]+): (.+)"

EMPTY_OBJECT = r"^\{\s*\}$"

JSON_FIELDS = ("level", "logger", "message", "event_type", "user_id", "session_id",
               "resource_type", "resource_id", "operation_result")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files the path matches, compressed or not, with file name and modification time."""
    return spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_modification_time").alias("file_time"))


def rotated_path(folder: str, stem: str, suffix: str = ".log") -> str:
    """Glob for the rotated (and possibly compressed) files of a log."""
    return f"{folder.rstrip('/')}/{stem}_*{suffix}*"


def rotated_files(lines: DataFrame) -> DataFrame:
    """The files behind a scan, newest first."""
    return (lines.groupBy("file_name").agg(F.max("file_time").alias("file_time"), F.count("*").alias("n"))
            .orderBy(F.desc("file_time"), "file_name"))


def parse(lines: DataFrame, line: str = "line", rest: bool = False) -> DataFrame:
    """Adds the parsed fields and ``layout``: 'json', 'text', or null where the line is neither.

    The record is produced by a generator over a one-element array, so each line is parsed once: a
    filter on the outcome cannot be pushed below it and repeat the parsing. With ``rest`` the whole
    JSON object is kept as VARIANT for fields outside the fixed set.
    """
    text = F.trim(F.col(line))
    # Read as the only element of an array, so that anything after the object makes the line malformed.
    fields = T.StructType([T.StructField(f, T.StringType()) for f in ("timestamp", *JSON_FIELDS, "details")])
    wrapped = F.from_json(F.concat(F.lit("["), text, F.lit("]")), T.ArrayType(fields), {"allowSingleQuotes": "false"})
    with_node = lines.withColumn("_node", F.when(text.startswith("{") & text.endswith("}") & ~text.rlike(EMPTY_OBJECT), wrapped))
    n = F.col("_node")[0]
    from_json = F.struct(F.lit("json").alias("layout"), n["timestamp"].alias("timestamp"),
                         *[n[f].alias(f) for f in JSON_FIELDS], n["details"].alias("details"))
    stamp = F.try_to_timestamp(F.regexp_extract(text, TEXT_LAYOUT, 1))
    group = {"level": 2, "logger": 3, "message": 4}
    from_text = F.struct(
        F.lit("text").alias("layout"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        *[(F.regexp_extract(text, TEXT_LAYOUT, group[f]) if f in group else F.lit(None).cast("string")).alias(f)
          for f in JSON_FIELDS],
        F.lit(None).cast("string").alias("details"))
    record = (F.when(F.size("_node") == 1, from_json)
              .when(text.rlike(TEXT_LAYOUT) & stamp.isNotNull(), from_text))
    parsed = with_node.select(*lines.columns, F.inline(F.array(record)))
    return parsed.withColumn("body", F.try_parse_json(F.col(line))) if rest else parsed


def records(parsed: DataFrame) -> DataFrame:
    """The readable lines, with ``ts`` next to the original timestamp text."""
    return parsed.where("layout IS NOT NULL").withColumn("ts", parse_iso(F.col("timestamp")))


def rejected(parsed: DataFrame) -> DataFrame:
    """The lines that could not be read."""
    return parsed.where("layout IS NULL")


def json_line(**fields: Column) -> Column:
    """One JSON log line from columns; null fields are left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
