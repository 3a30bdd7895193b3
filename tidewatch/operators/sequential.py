"""Replays whose outcome depends on earlier outcomes: request admission, throttles, circuit breakers.

Both replays first cut every key into runs that cannot influence each other, using only counts per
(key, time bucket). Rows whose outcome follows from the counts stay in the JVM; the other runs are
streamed through Python in time order with a small state, never gathered.

A run may hold most rows of the table, so runs are cut again, into segments of about equal row counts, which are
replayed at the same time. What is missing is the state in which each segment begins (``entries``):

* With a limit of one, a row that passes decides which row passes next. A segment so is a function from the last
  passed time before it to the last one in it, with one row per different result; the functions of a run, one row
  each, are applied one after the other.
* Otherwise segments are replayed from an assumed state. The states they end in are carried along the run; a segment
  whose assumed state turns out to behave differently is replayed again from the carried one, until all agree. A breaker
  that behaves alike from both states hands on counters that the segment left alone. Runs that still differ after
  ``ROUNDS`` rounds are replayed once in order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.joins import null_safe
from tidewatch.operators.segments import PART, ordered_parts
from tidewatch.session import materialize

# Requests allowed per 60 seconds by role.
ROLE_LIMITS = {"admin": 1000, "service_broker": 500}
DEFAULT_LIMIT = 100
WINDOW_SECONDS = 60
#: Times that segments are replayed from better states before a run is replayed in order.
ROUNDS = 6


def role_limit(role: Column) -> Column:
    limit = F.lit(DEFAULT_LIMIT)
    for name, value in ROLE_LIMITS.items():
        limit = F.when(role == name, value).otherwise(limit)
    return limit


def _bucketed(df: DataFrame, ts: str, width: int) -> DataFrame:
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn("_at", at).withColumn("_bucket", F.floor(at / F.lit(width)).cast("bigint"))


def _stretches(new: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """The parts of a batch that belong to one run, and whether the run begins there."""
    starts = np.flatnonzero(new)
    bounds = sorted({0, *starts.tolist(), len(new)})
    for first, last in zip(bounds, bounds[1:]):
        yield first, last, bool(new[first])


def _pass_rows(recent: deque[int], at: np.ndarray, context: np.ndarray, passed: np.ndarray,
               first: int, last: int, limit: int, width: int) -> None:
    """Mark the rows of one stretch that pass. While the window is full, jump to where its oldest entry leaves."""
    known = np.flatnonzero(context[first:last]) + first
    i = first
    while i < last:
        t = int(at[i])
        while recent and recent[0] <= t - width:
            recent.popleft()
        if context[i] or len(recent) < limit:
            recent.append(t)
            passed[i] = True
            i += 1
            continue
        free = i + int(np.searchsorted(at[i:last], recent[0] + width)) if recent else last
        ahead = np.searchsorted(known, i)
        i = min(free, int(known[ahead])) if ahead < len(known) else free


class _Windows:
    """Segments of admission: the state is the times of the rows that passed, oldest first."""

    def __init__(self, width: int) -> None:
        self.width, self.recent = width, deque()

    def begin(self, entry: Sequence[int]) -> None:
        self.recent = deque(entry)

    def feed(self, batch: pd.DataFrame, first: int, last: int) -> None:
        limit = int(batch["_limit"].to_numpy()[first:last].max())
        _pass_rows(self.recent, batch["_at"].to_numpy(), batch["_context"].to_numpy().astype(bool), np.zeros(len(batch), bool), first, last, limit, self.width)

    def state(self) -> list[int]:
        return list(self.recent)

    def result(self) -> dict[str, list[int]]:
        return {"_exit": self.state(), "_from": [], "_to": []}

    def carry(self, segments: list[dict[str, Any]]) -> Iterator[tuple[list[int], bool]]:
        """For each segment of a run in order: the state it begins in, and whether another one was assumed."""
        state = list(segments[0]["_used"])
        for s in segments:
            counts = lambda times: [t for t in times if t > s["_first"] - self.width]  # noqa: B023, E731
            state = counts(state)
            yield state, state != counts(s["_used"])
            state = list(s["_exit"])


class _Chains(_Windows):
    """The same for a limit of one: what a segment makes of every state it may begin in."""

    def begin(self, entry: Sequence[int]) -> None:
        self.at, self.context = [], []

    def feed(self, batch: pd.DataFrame, first: int, last: int) -> None:
        self.at.append(batch["_at"].to_numpy()[first:last])
        self.context.append(batch["_context"].to_numpy().astype(bool)[first:last])

    def state(self) -> list[int]:
        return []

    def result(self) -> dict[str, list[int]]:
        """A row that may pass from ``_from[i]`` on leads to ``_to[i]``; a known row passes whatever came before."""
        at, known = np.concatenate(self.at), np.flatnonzero(np.concatenate(self.context))
        places = np.arange(len(at))
        following = np.append(known, len(at))[np.searchsorted(known, places, side="right")]
        after = np.minimum(np.maximum(np.searchsorted(at, at + self.width), places + 1), following)
        last = np.where(after < len(at), after, places)
        while (further := last[last]).tolist() != last.tolist():
            last = further
        reach = places[:known[0] + 1] if len(known) else places
        ends = at[last[reach]]
        kept = np.append(ends[1:] != ends[:-1], True)
        starts = at[reach][kept].astype(np.int64)
        if len(known):
            starts[-1] = np.iinfo(np.int64).max
        return {"_exit": [], "_from": starts.tolist(), "_to": ends[kept].tolist()}

    def carry(self, segments: list[dict[str, Any]]) -> Iterator[tuple[list[int], bool]]:
        state: list[int] = []
        for s in segments:
            yield state, False
            i = int(np.searchsorted(s["_from"], state[0] + self.width)) if state else 0
            if i < len(s["_to"]):
                state = [int(s["_to"][i])]


def _segmented(rows: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int) -> DataFrame:
    return ordered_parts(rows, [*keys, "_run", *order], parts)


def _marked(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Segments in order, each in one task, with the entry state on its first row."""
    first = F.row_number().over(W.partitionBy(*keys, "_run", PART).orderBy(*order)) == 1
    return rows.withColumn("_new", first).withColumn("_entry", F.when(F.col("_new"), F.col("_entry")))


def _replayed(rows: DataFrame, keys: Sequence[str], kernel: Any, through: bool = False) -> DataFrame:
    """(keys, run, part, _first: first time, _used: entry state, _exit, _from, _to) of marked segments. ``through``: a run's
    segments follow one another in one task, each from the state in which the one before ended."""
    names = [*keys, "_run", PART]

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head: dict[str, Any] | None = None
        for batch in batches:
            done = []
            for first, last, new in _stretches(batch["_new"].to_numpy()):
                if new:
                    if head is not None:
                        done.append({**head, **kernel.result()})
                    row = batch.iloc[first]
                    if not through or row["_opens"]:
                        kernel.begin([] if row["_entry"] is None else [int(v) for v in row["_entry"]])
                    used = kernel.state() if through else [] if row["_entry"] is None else row["_entry"]
                    head = {**{c: row[c] for c in names}, "_first": int(row["_at"]), "_used": list(used)}
                kernel.feed(batch, first, last)
            yield pd.DataFrame(done, columns=[f.name for f in schema])
        if head is not None:
            yield pd.DataFrame([{**head, **kernel.result()}], columns=[f.name for f in schema])

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("_first", T.LongType()), *[T.StructField(c, longs) for c in ("_used", "_exit", "_from", "_to")]])
    return materialize(rows.mapInPandas(replay, schema), "segments")


def entries(rows: DataFrame, keys: Sequence[str], order: Sequence[str], kernel: Any) -> DataFrame:
    """(keys, run, part, _entry): the state in which each segment begins, of the runs that have more than one. ``rows`` has
    ``_entry`` where a state is known. As rows are sorted by run, fewer runs than parts have several segments."""
    names = [*keys, "_run", PART]
    spans = rows.groupBy(*keys, "_run").agg(F.min(PART).alias("_a"), F.max(PART).alias("_b")).where("_a < _b").select(*keys, "_run")
    spans = materialize(spans, "spanning-runs")
    if spans.isEmpty():
        return rows.select(*names, "_entry").limit(0)
    rows = null_safe(rows, spans, [*keys, "_run"], "inner")
    results = _replayed(_marked(rows, keys, order), keys, kernel)
    schema = T.StructType([*results.schema.fields, T.StructField("_entry", T.ArrayType(T.LongType())), T.StructField("_wrong", T.BooleanType())])

    def carry(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values(PART)
        found = list(kernel.carry(run.to_dict("records")))
        return run.assign(_entry=[list(e) for e, _ in found], _wrong=[w for _, w in found])

    for step in range(ROUNDS + 1):
        carried = materialize(results.groupBy(*keys, "_run").applyInPandas(carry, schema), "carried")
        wrong = carried.where("_wrong")
        if wrong.isEmpty():
            break
        bare = rows.drop("_entry")
        if step < ROUNDS:
            again = null_safe(bare, wrong.select(*names, "_entry"), names, "inner")
            done = _replayed(_marked(again, keys, order), keys, kernel)
            results = carried.where("NOT _wrong").select(done.columns).unionByName(done)
            continue
        runs = wrong.select(*keys, "_run").distinct()
        whole = W.partitionBy(*keys, "_run").orderBy(PART, *order)
        again = null_safe(rows, runs, [*keys, "_run"], "inner").withColumn("_opens", F.row_number().over(whole) == 1)
        again = again.withColumn("_new", F.col("_opens") | (F.lag(PART).over(whole) != F.col(PART)))
        done = _replayed(again, keys, kernel, through=True)
        settled = null_safe(carried, runs.withColumn("_redone", F.lit(True)), [*keys, "_run"], "left").where("_redone IS NULL")
        carried = settled.select(*names, "_entry").unionByName(done.select(*names, F.col("_used").alias("_entry")))
    return materialize(carried.select(*names, "_entry"), "entries")


def admit(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], limit: int | Column,
          window_seconds: float, keep: Sequence[str] = (), name: str = "admitted",
          earlier: DataFrame | None = None, parts: int = 0) -> DataFrame:
    """Sliding-window admission per key: a row passes if fewer than ``limit`` rows passed in the window before it.

    Rows that are turned away do not count. The window is open at its old end, so with ``limit`` 1 this is
    also "at most once per interval" and a debounce. ``limit`` must be constant per key. ``earlier`` holds (keys, ts)
    of rows known to have passed before; they count but are not returned. Returns the keys, ``ts``,
    the tie columns, ``keep`` and the outcome. ``parts``: the number of parts into which contended rows are cut (0: the
    session's).
    """
    width = int(window_seconds * 1_000_000)
    columns = list(dict.fromkeys([*keys, ts, *tie, *keep]))
    rows = _bucketed(df.withColumn("_limit", limit if isinstance(limit, Column) else F.lit(limit)), ts, width)
    rows = rows.select(*columns, "_limit", "_at", "_bucket", F.lit(False).alias("_known"))
    if earlier is not None:
        known = _bucketed(earlier.select(*keys, ts).withColumn("_known", F.lit(True)), ts, width)
        rows = rows.unionByName(known, allowMissingColumns=True)

    # A bucket is free when it and its predecessor together stay within the limit: all its rows pass.
    order = W.partitionBy(*keys).orderBy("_bucket")
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"), F.max("_limit").alias("_limit"))
    before = F.when(F.lag("_bucket").over(order) == F.col("_bucket") - 1, F.lag("_n").over(order)).otherwise(0)
    busy = counts.withColumn("_busy", F.col("_n") + before > F.col("_limit")).where("_busy")
    run = F.col("_bucket") - F.row_number().over(order)
    busy = busy.select(*keys, "_bucket", run.alias("_run"))
    # The free bucket just before a run is replayed along with it: its rows all passed and may still count.
    head = busy.groupBy(*keys, "_run").agg((F.min("_bucket") - 1).alias("_bucket")).select(*keys, "_bucket", "_run")
    flags = busy.withColumn("_context", F.lit(False)).unionByName(head.withColumn("_context", F.lit(True)))
    # Usually few buckets are contended; once written their size is known, and small ones are broadcast.
    flagged = null_safe(rows, materialize(flags, "contended"), [*keys, "_bucket"], "left")

    free = flagged.where(~F.col("_known") & F.coalesce("_context", F.lit(True))).select(*columns, F.lit(True).alias(name))
    contended = flagged.where("_run IS NOT NULL").select(
        *columns, *[c for c in ("_run", "_at") if c not in columns], F.coalesce("_limit", F.lit(0)).alias("_limit"), (F.col("_context") | F.col("_known")).alias("_context"))
    stored, order = _segmented(contended, keys, ["_at", *tie], parts), ["_at", *tie]
    kernel = _Chains(width) if not isinstance(limit, Column) and limit == 1 else _Windows(width)
    begun = entries(stored.withColumn("_entry", F.lit(None).cast("array<bigint>")), keys, order, kernel)
    segments = _marked(null_safe(stored, begun, [*keys, "_run", PART], "left"), keys, order)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent: deque[int] = deque()
        for batch in batches:
            at, context = batch["_at"].to_numpy(), batch["_context"].to_numpy().astype(bool)
            allowed, passed = batch["_limit"].to_numpy(), np.zeros(len(batch), dtype=bool)
            for first, last, new in _stretches(batch["_new"].to_numpy()):
                if new:
                    recent = deque([] if batch["_entry"].iloc[first] is None else map(int, batch["_entry"].iloc[first]))
                _pass_rows(recent, at, context, passed, first, last, int(allowed[first:last].max()), width)
            yield batch[columns].assign(**{name: passed})[~context]

    schema = T.StructType([*[rows.schema[c] for c in columns], T.StructField(name, T.BooleanType())])
    return free.unionByName(segments.mapInPandas(replay, schema))


@dataclass(frozen=True)
class BreakerConfig:
    failure_threshold: int = 5
    recovery_seconds: float = 60.0
    success_threshold: int = 3


CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


class Breaker:
    """State of one circuit breaker, replayed over calls in time order."""

    def __init__(self, config: BreakerConfig, state: str = CLOSED, failures: int = 0, successes: int = 0, last_failure: int = 0) -> None:
        self.config, self.state, self.failures = config, state, failures
        self.successes, self.last_failure = successes, last_failure
        self.reset = self.tried = self.failed = False  # which of the numbers no longer depend on how it began

    def snapshot(self) -> tuple[str, int, int, int]:
        return self.state, self.failures, self.successes, self.last_failure

    def step(self, at: np.ndarray, failed: np.ndarray, faults: np.ndarray, i: int, last: int) -> tuple[int, bool]:
        """Handle calls from ``i`` on that share one outcome and one resulting state: where they end, and if they were let through.

        ``faults`` are the positions of failed calls. A closed breaker jumps over successes, an open one over all
        calls before it may try again.
        """
        if self.state == OPEN:
            retry = i + int(np.searchsorted(at[i:last], self.last_failure + int(self.config.recovery_seconds * 1_000_000)))
            if retry > i:
                return retry, False
            self.state, self.successes, self.tried = HALF_OPEN, 0, True
        if failed[i]:
            self.last_failure, self.failures, self.failed = int(at[i]), self.failures + 1, True
            if self.state == HALF_OPEN or self.failures >= self.config.failure_threshold:
                self.state = OPEN
            return i + 1, True
        if self.state == CLOSED:
            self.failures, self.reset = 0, True
            ahead = int(np.searchsorted(faults, i))
            return (min(int(faults[ahead]), last) if ahead < len(faults) else last), True
        self.successes += 1
        if self.successes >= self.config.success_threshold:
            self.state, self.failures, self.reset = CLOSED, 0, True
        return i + 1, True


STATE_COLUMNS = ("state", "failures", "successes", "last_failure")
_STATES = (CLOSED, OPEN, HALF_OPEN)


class _Calls:
    """Segments of a breaker's calls: the state is its state's number, failures, successes and last failure."""

    def __init__(self, config: BreakerConfig) -> None:
        self.config, self.breaker, self._began = config, Breaker(config), 0

    def begin(self, entry: Sequence[int]) -> None:
        state, *numbers = entry or (0, 0, 0, 0)
        self.breaker, self._began = Breaker(self.config, _STATES[state], *numbers), numbers[0]

    def feed(self, batch: pd.DataFrame, first: int, last: int) -> None:
        at, bad = batch["_at"].to_numpy(), batch["_failed"].to_numpy().astype(bool)
        faults = np.flatnonzero(bad)
        while first < last:
            first, _ = self.breaker.step(at, bad, faults, first, last)

    def state(self) -> list[int]:
        state, *numbers = self.breaker.snapshot()
        return [_STATES.index(state), *numbers]

    def result(self) -> dict[str, list[int]]:
        b = self.breaker
        return {"_exit": self.state(), "_from": [int(b.reset), int(b.tried), int(b.failed), self._began], "_to": []}

    @staticmethod
    def _decisive(state: Sequence[int]) -> tuple[int, int]:
        """What later outcomes depend on: failures while closed, the last one while open, successes while half open."""
        return int(state[0]), int((state[1], state[3], state[2])[int(state[0])])

    def carry(self, segments: list[dict[str, Any]]) -> Iterator[tuple[list[int], bool]]:
        state = [int(v) for v in segments[0]["_used"]] or [0, 0, 0, 0]
        for s in segments:
            used = [int(v) for v in s["_used"]] or [0, 0, 0, 0]
            yield state, self._decisive(state) != self._decisive(used)
            (number, failures, successes, last), (reset, tried, failed, began) = map(int, s["_exit"]), map(int, s["_from"])
            state = [number, failures if reset else state[1] + failures - began, successes if tried else state[2], last if failed else state[3]]


def replay_breakers(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], failed: Column,
                    config: BreakerConfig = BreakerConfig(), keep: Sequence[str] = (),
                    initial: DataFrame | None = None, parts: int = 0) -> DataFrame:
    """Which calls a circuit breaker per key would have let through, and its state after each call.

    A bucket as long as the recovery time that is free of failures, follows one free of failures and
    holds enough successes leaves the breaker closed and reset whatever came before, so the next
    bucket starts a run of its own. Runs without failures need no replay. ``initial`` gives breakers
    that do not start out closed, as (keys, state, failures, successes, last_failure).
    """
    width = int(config.recovery_seconds * 1_000_000)
    columns = list(dict.fromkeys([*keys, ts, *tie, *keep]))
    rows = _bucketed(df.withColumn("_failed", failed), ts, width).select(*columns, "_failed", "_at", "_bucket")
    order = W.partitionBy(*keys).orderBy("_bucket")
    counts = rows.groupBy(*keys, "_bucket").agg(F.count_if("_failed").alias("_f"), F.count_if(~F.col("_failed")).alias("_s"))
    if initial is not None:
        # A failure from before counts like a failure at its own time.
        initial = initial.where((F.col("state") != CLOSED) | (F.col("failures") > 0))
        earlier = initial.select(*keys, F.floor(F.col("last_failure") / F.lit(width)).cast("bigint").alias("_bucket"),
                                 F.lit(1).cast("bigint").alias("_f"), F.lit(0).cast("bigint").alias("_s"))
        counts = counts.unionByName(earlier).groupBy(*keys, "_bucket").agg(F.sum("_f").alias("_f"), F.sum("_s").alias("_s"))
    before = F.when(F.lag("_bucket").over(order) == F.col("_bucket") - 1, F.lag("_f").over(order)).otherwise(0)
    calm = (F.col("_f") == 0) & (before == 0) & (F.col("_s") >= config.success_threshold)
    marked = counts.withColumn("_calm", calm.cast("int"))
    run = F.coalesce(F.sum("_calm").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = marked.withColumn("_run", run)
    runs = runs.withColumn("_faulty", F.max(F.col("_f") > 0).over(W.partitionBy(*keys, "_run"))).where("_faulty")
    flagged = null_safe(rows, materialize(runs.select(*keys, "_bucket", "_run"), "faulty"), [*keys, "_bucket"], "left")

    calm_state = [F.lit(CLOSED).alias("state"), F.lit(0).alias("failures"), F.lit(0).alias("successes"), F.lit(None).cast("bigint").alias("last_failure")]
    calm_rows = flagged.where("_run IS NULL").select(*columns, F.lit(True).alias("allowed"), *calm_state)
    faulty = flagged.where("_run IS NOT NULL").select(*columns, *[c for c in ("_run", "_at") if c not in columns], "_failed")
    stored, order = _segmented(faulty, keys, ["_at", *tie], parts), ["_at", *tie]
    if initial is None:
        known = stored.withColumn("_entry", F.lit(None).cast("array<bigint>"))
    else:
        number = F.array_position(F.array(*map(F.lit, _STATES)), F.col("state")) - 1
        given = F.array(number, *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in STATE_COLUMNS[1:]])
        heads = stored.groupBy(*keys, "_run").agg(F.min(PART).alias(PART)).where("_run = 0")
        begins = null_safe(heads, initial.select(*keys, given.alias("_entry")), keys, "inner")
        known = null_safe(stored, materialize(begins, "given"), [*keys, "_run", PART], "left")
    begun = entries(known, keys, order, _Calls(config))
    carried = null_safe(known.withColumnRenamed("_entry", "_given"), begun, [*keys, "_run", PART], "left")
    segments = _marked(carried.withColumn("_entry", F.coalesce("_entry", "_given")), keys, order)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        breaker = Breaker(config)
        for batch in batches:
            at, bad = batch["_at"].to_numpy(), batch["_failed"].to_numpy().astype(bool)
            faults = np.flatnonzero(bad)
            lengths, allowed, states = [], [], []
            for first, last, new in _stretches(batch["_new"].to_numpy()):
                if new:
                    given = batch["_entry"].iloc[first]
                    state, *numbers = (0, 0, 0, 0) if given is None else map(int, given)
                    breaker = Breaker(config, _STATES[state], *numbers)
                while first < last:
                    end, through = breaker.step(at, bad, faults, first, last)
                    lengths.append(end - first)
                    allowed.append(through)
                    states.append(breaker.snapshot())
                    first = end
            spread = np.repeat(np.arange(len(lengths)), lengths)
            done = pd.DataFrame(states, columns=list(STATE_COLUMNS)).iloc[spread].set_index(batch.index)
            yield batch[columns].assign(allowed=np.array(allowed, dtype=bool)[spread], state=done["state"], failures=done["failures"].astype("int32"),
                                        successes=done["successes"].astype("int32"), last_failure=done["last_failure"].astype("int64"))

    schema = T.StructType([*[rows.schema[c] for c in columns], T.StructField("allowed", T.BooleanType()),
                           T.StructField("state", T.StringType()), T.StructField("failures", T.IntegerType()),
                           T.StructField("successes", T.IntegerType()), T.StructField("last_failure", T.LongType())])
    return calm_rows.unionByName(segments.mapInPandas(replay, schema))
