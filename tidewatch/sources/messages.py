"""Message topics: source and sink options, and the encode and decode stages between rows and messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter


def source_options(servers: str, topic: str, group: str | None = None) -> dict[str, str]:
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"}
    if group:
        options["kafka.group.id"] = group
    return options


def sink_options(servers: str, topic: str, retries: int = 3) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.retries": str(retries)}


def read_messages(spark: SparkSession, servers: str, topic: str, group: str | None = None,
                  streaming: bool = True) -> DataFrame:
    """Needs the Kafka connector on the classpath."""
    reader = spark.readStream if streaming else spark.read
    return decode(reader.format("kafka").options(**source_options(servers, topic, group)).load())


def write_messages(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    return (messages.writeStream.format("kafka").options(**sink_options(servers, topic))
            .option("checkpointLocation", checkpoint))


def decode(rows: DataFrame) -> DataFrame:
    """Binary key and value as UTF-8 text; any other columns of the source row stay."""
    rest = [c for c in rows.columns if c not in ("key", "value")]
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), *rest)


def decode_json(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return decode(rows).withColumn("body", F.from_json("value", schema))


def encode(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows as (key, value) messages: the key as text, the fields as one JSON object."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*fields)).alias("value"))
