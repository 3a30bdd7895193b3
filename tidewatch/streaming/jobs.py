"""Stream sources and exactly-once sinks; standing aggregates and replays whose results do not depend on how the input
was cut into micro-batches or in which order its files arrived."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators import segments
from tidewatch.operators.health import summary
from tidewatch.operators.inventory import first_wins
from tidewatch.operators.ranking import latest
from tidewatch.operators.sequential import STATE_COLUMNS, BreakerConfig, admit, replay_breakers
from tidewatch.session import exists, folder_values, remove
from tidewatch.sources import logs

#: Bounds what one micro-batch reads; results are the same for any value.
MAX_BYTES = 8 << 30


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A sibling session for streams with keyed state, which goes to RocksDB, off the heap; the caller's settings stay
    as they are. A stream keeps its number of state partitions for life: set ``spark.sql.shuffle.partitions`` for the
    keys it will have."""
    sibling = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        sibling.conf.set(name, spark.conf.get(name))
    sibling.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return sibling


def stream_table(spark: SparkSession, path: str, schema: T.StructType | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A table folder or file as a stream; ``max_bytes`` bounds each micro-batch. Times become zoned, as watermarks need."""
    schema = schema or spark.read.parquet(path).schema
    # A plain path must be a folder here; written as a pattern it may also name one file.
    if not any(c in path for c in "*?[{"):
        path = f"{path[:-1]}[{path[-1]}]"
    rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).parquet(path)
    zoned = [F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in schema.fields]
    return rows.select(*zoned)


def stream_lines(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    return spark.readStream.option("maxBytesPerTrigger", max_bytes).text(path).select(F.col("value").alias("line"))


# --- sinks --------------------------------------------------------------------------------------

def start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
          every: str | None = None) -> StreamingQuery:
    """Run a batch function per micro-batch: once over what is there, or continuously with ``every``."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> str:
    """Process everything available into ``folder``/table and wait.

    Each micro-batch overwrites its own epoch folder, so a repeated batch changes nothing.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/epoch={epoch}")

    start(stream, write, f"{folder}/checkpoint", mode).awaitTermination()
    return f"{folder}/table"


# --- ingest -------------------------------------------------------------------------------------

def ingest(lines: DataFrame, folder: str) -> StreamingQuery:
    """Parse a stream of lines, each micro-batch once and in one write; ``ingested`` and ``rejected`` read the parts."""
    def write(batch: DataFrame, epoch: int) -> None:
        good = F.col("layout").isNotNull()
        parsed = logs.parse(batch).withColumn("line", F.when(~good, F.col("line")))
        outcome = F.when(good, "records").otherwise("rejected").alias("outcome")
        parsed.select("*", outcome).write.mode("overwrite").partitionBy("outcome").parquet(f"{folder}/lines/epoch={epoch}")

    return start(lines, write, f"{folder}/checkpoint")


def ingested(spark: SparkSession, folder: str) -> DataFrame:
    return logs.records(spark.read.parquet(f"{folder}/lines").where("outcome = 'records'")).drop("line", "outcome", "epoch")


def rejected(spark: SparkSession, folder: str, keep: Sequence[str] = ("line",)) -> DataFrame:
    return spark.read.parquet(f"{folder}/lines").where("outcome = 'rejected'").select(*keep)


# --- standing aggregates ------------------------------------------------------------------------

@dataclass(frozen=True)
class Standing:
    """An aggregate kept up to date by a stream: ``partial`` reduces a micro-batch, ``merge`` reduces partial results to
    rows of the same columns, ``result`` finishes them. No row is ever too late."""

    partial: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    result: Callable[[DataFrame], DataFrame] = lambda rows: rows


def keep_standing(stream: DataFrame, folder: str, job: Standing, every: str | None = None) -> StreamingQuery:
    def write(batch: DataFrame, epoch: int) -> None:
        job.partial(batch).write.mode("overwrite").parquet(f"{folder}/partials/epoch={epoch}")

    return start(stream, write, f"{folder}/checkpoint", every=every)


def _partials(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """The newest compacted rows with the partial rows after them, and the epoch they reach (-1: none is compacted)."""
    rows, upto = spark.read.parquet(f"{folder}/partials"), -1
    if exists(spark, f"{folder}/compacted"):
        done = spark.read.parquet(f"{folder}/compacted")
        upto = done.agg(F.max("upto")).first()[0]
        upto = -1 if upto is None else upto
        rows = rows.where(F.col("epoch") > upto).drop("epoch").unionByName(done.where(F.col("upto") == upto).drop("upto"))
    else:
        rows = rows.drop("epoch")
    return rows, upto


def read_standing(spark: SparkSession, folder: str, job: Standing) -> DataFrame:
    rows, _ = _partials(spark, folder)
    return job.result(job.merge(rows))


def compact(spark: SparkSession, folder: str, job: Standing) -> None:
    """Merge all partial rows so far into one compacted table and drop what it replaces. Run it between micro-batches or
    beside them: later epochs stay as they are."""
    rows, before = _partials(spark, folder)
    upto = spark.read.parquet(f"{folder}/partials").agg(F.max("epoch")).first()[0]
    if upto is None or upto <= before:
        return
    job.merge(rows).write.mode("overwrite").parquet(f"{folder}/compacted/upto={upto}")
    # The newest epoch stays, so that the table keeps its schema; it is not read again.
    for epoch in range(before, upto):
        remove(spark, f"{folder}/partials/epoch={epoch}")
    remove(spark, f"{folder}/compacted/upto={before}")


def _local(window: str | Column) -> Column:
    return F.col(f"{window}.start").cast("timestamp_ntz")


def period_counts(period: str, by: Sequence[str], ts: str = "ts") -> Standing:
    def partial(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.window(ts, period).alias("w"), *by).agg(F.count("*").alias("n")).select(_local("w").alias("period_start"), *by, "n")

    return Standing(partial, lambda rows: rows.groupBy("period_start", *by).agg(F.sum("n").alias("n")))


def error_rates(failed: Column, size: str, slide: str | None = None, ts: str = "ts") -> Standing:
    """Rows, failures and their rate per tumbling or sliding window."""
    window = (F.window(ts, size, slide) if slide else F.window(ts, size)).alias("w")

    def partial(rows: DataFrame) -> DataFrame:
        counted = rows.groupBy(window).agg(F.count("*").alias("requests"), F.count_if(failed).alias("errors"))
        return counted.select(_local("w").alias("window_start"), "requests", "errors")

    return Standing(partial, lambda rows: rows.groupBy("window_start").agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors")),
                    lambda rows: rows.withColumn("rate", F.col("errors") / F.col("requests")))


def sessions(key: str, gap_seconds: float, measures: dict[str, Column], ts: str = "ts") -> Standing:
    """Runs of a key's rows without a longer pause than the gap, open ones included: first and last time, rows, sums."""
    def partial(rows: DataFrame) -> DataFrame:
        return segments.sessions(rows.withColumn(ts, F.col(ts).cast("timestamp_ntz")), key, ts, gap_seconds, measures)

    return Standing(partial, lambda rows: segments.merge_spans(rows, key, "started_at", "last_at", gap_seconds, ["events", *measures]))


def running_metrics() -> Standing:
    """Running count, sum, extremes and last value per series."""
    def partial(points: DataFrame) -> DataFrame:
        return points.groupBy("kind", "key").agg(
            F.count("*").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"),
            F.max(F.struct("ts", "event_id", "value")).alias("newest"))

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("kind", "key").agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"),
                                               F.max("max").alias("max"), F.max("newest").alias("newest"))

    return Standing(partial, merge, lambda rows: rows.select("kind", "key", "count", "sum", "min", "max", F.col("newest.value").alias("last")))


def latest_per_round(every: str, ts: str = "ts") -> Standing:
    """The last status of each check in each round."""
    def partial(results: DataFrame) -> DataFrame:
        grouped = results.groupBy(F.window(ts, every).alias("w"), "name").agg(F.max(F.struct(ts, "event_id", "status")).alias("newest"))
        return grouped.select(_local("w").alias("round"), "name", "newest")

    return Standing(partial, lambda rows: rows.groupBy("round", "name").agg(F.max("newest").alias("newest")),
                    lambda rows: rows.select("round", "name", F.col("newest.status").alias("status")))


def round_summaries(spark: SparkSession, folder: str, job: Standing) -> DataFrame:
    """Health summary per round from what ``latest_per_round`` keeps."""
    return summary(read_standing(spark, folder, job), "round")


# --- replays ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Replay:
    """A replay in time order over a stream whose rows may come out of order.

    A row is decided once all rows before it must have come: when a row has been seen that is later by ``lateness``
    seconds. Until then it is held. Rows that come after their time was decided go to ``late``. Without a lateness all
    rows are held until ``finish``. ``finish`` ends a bounded run and decides what is held; a run that goes on
    afterwards takes its answers back and decides those rows in their turn.

    ``decide`` gets rows in any order and the carried state, and returns outcomes; ``carry`` gets the outcomes, the
    state before and the decided time (microseconds), and returns the next state.
    """

    folder: str
    ts: str
    decide: Callable[[DataFrame, DataFrame | None], DataFrame]
    carry: Callable[[DataFrame, DataFrame | None, int], DataFrame]
    lateness: float | None = None

    def _state(self, spark: SparkSession, epoch: int) -> tuple[DataFrame | None, DataFrame | None, int | None]:
        """Held rows, carried state and the time up to which all is decided, after an epoch."""
        at = f"{self.folder}/state/epoch={epoch}"
        if epoch < 0:
            return None, None, None
        upto = spark.read.parquet(f"{at}/upto").first()["upto"]
        carried = spark.read.parquet(f"{at}/carried") if upto is not None else None
        return spark.read.parquet(f"{at}/held"), carried, upto

    def start(self, stream: DataFrame, every: str | None = None) -> StreamingQuery:
        remove(stream.sparkSession, f"{self.folder}/closing")
        return start(stream, self._write, f"{self.folder}/checkpoint", every=every)

    def _write(self, batch: DataFrame, epoch: int) -> None:
        spark, micros = batch.sparkSession, F.unix_micros(F.col(self.ts).cast("timestamp"))
        if self.lateness is None:
            batch.write.mode("overwrite").parquet(f"{self.folder}/held/epoch={epoch}")
            return
        held, carried, upto = self._state(spark, epoch - 1)
        fresh = batch
        if upto is not None:
            fresh = batch.where(micros > upto)
            batch.where(micros <= upto).write.mode("overwrite").parquet(f"{self.folder}/late/epoch={epoch}")
        rows = fresh if held is None else fresh.unionByName(held)
        newest = rows.agg(F.max(micros)).first()[0]
        reached = None if newest is None else newest - int(self.lateness * 1_000_000)
        reached = upto if reached is None else reached if upto is None else max(reached, upto)
        at = f"{self.folder}/state/epoch={epoch}"
        if reached is not None:
            self.decide(rows.where(micros <= reached), carried).write.mode("overwrite").parquet(f"{self.folder}/outcomes/epoch={epoch}")
            done = spark.read.parquet(f"{self.folder}/outcomes/epoch={epoch}")
            self.carry(done, carried, reached).write.mode("overwrite").parquet(f"{at}/carried")
            rows = rows.where(micros > reached)
        rows.write.mode("overwrite").parquet(f"{at}/held")
        spark.createDataFrame([(reached,)], "upto LONG").coalesce(1).write.mode("overwrite").parquet(f"{at}/upto")
        remove(spark, f"{self.folder}/state/epoch={epoch - 2}")  # a repeated batch needs the one before only

    def finish(self, spark: SparkSession) -> None:
        held, carried = None, None
        if self.lateness is None:
            if exists(spark, f"{self.folder}/held"):
                held = spark.read.parquet(f"{self.folder}/held").drop("epoch")
        elif exists(spark, f"{self.folder}/state"):
            # A stream that was stopped within a batch leaves that batch's state unfinished.
            epochs = [int(v) for v in folder_values(spark, f"{self.folder}/state", "epoch")]
            whole = [e for e in epochs if exists(spark, f"{self.folder}/state/epoch={e}/upto/_SUCCESS")]
            if whole:
                held, carried, _ = self._state(spark, max(whole))
        if held is not None:
            self.decide(held, carried).write.mode("overwrite").parquet(f"{self.folder}/closing")

    def run(self, stream: DataFrame) -> DataFrame:
        """Process everything available to the end; the outcomes."""
        self.start(stream).awaitTermination()
        self.finish(stream.sparkSession)
        return self.outcomes(stream.sparkSession)

    def outcomes(self, spark: SparkSession, running: str | None = None) -> DataFrame:
        """All answers so far. ``running`` names a column that is true for those given while the stream ran, not by ``finish``."""
        rows = []
        for part in ("outcomes", "closing"):
            if exists(spark, f"{self.folder}/{part}"):
                found = spark.read.parquet(f"{self.folder}/{part}").drop("epoch")
                rows.append(found.withColumn(running, F.lit(part == "outcomes")) if running else found)
        return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])

    def late(self, spark: SparkSession) -> DataFrame | None:
        """Rows that came too late to be decided, or None if there never was one."""
        return spark.read.parquet(f"{self.folder}/late").drop("epoch") if exists(spark, f"{self.folder}/late") else None


def admission(folder: str, keys: Sequence[str], ts: str, tie: Sequence[str], limit: int | Column, window_seconds: float,
              keep: Sequence[str] = (), lateness: float | None = None) -> Replay:
    """Sliding-window admission; what is carried are the passed rows that can still count."""
    def carry(outcome: DataFrame, earlier: DataFrame | None, upto: int) -> DataFrame:
        passed = outcome.where("admitted").select(*keys, ts)
        passed = passed if earlier is None else passed.unionByName(earlier)
        return passed.where(F.unix_micros(F.col(ts).cast("timestamp")) > upto - int(window_seconds * 1_000_000))

    return Replay(folder, ts, lambda rows, earlier: admit(rows, keys, ts, tie, limit, window_seconds, keep, earlier=earlier), carry, lateness)


def breakers(folder: str, key: str, ts: str, tie: Sequence[str], failed: Column, config: BreakerConfig = BreakerConfig(),
             lateness: float | None = None) -> Replay:
    """Circuit breakers; what is carried is one row per circuit."""
    def carry(outcome: DataFrame, earlier: DataFrame | None, upto: int) -> DataFrame:
        now = latest(outcome, [key], [ts, *tie], keep=STATE_COLUMNS)
        return now if earlier is None else first_wins(now, earlier, key)

    return Replay(folder, ts, lambda rows, earlier: replay_breakers(rows, [key], ts, tie, failed, config, initial=earlier), carry, lateness)
