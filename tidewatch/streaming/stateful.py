"""Alert states per rule on transformWithState."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.alerts import ThresholdRule, firing_grid


class AlertProcessor(StatefulProcessor):
    """Emits a row when a rule starts or stops firing, with the episode's start and, once over, its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alert", "firing BOOLEAN, since TIMESTAMP")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        firing, since = self.state.get() if self.state.exists() else (False, None)
        for at, severity, now in sorted((r["round"], r["severity"], r["firing"]) for r in rows):
            if now == firing:
                continue
            firing, since = now, at if now else since
            yield Row(round=at, name=key[0], severity=severity, state="firing" if now else "resolved",
                      starts_at=since, ends_at=None if now else at)
        self.state.update((firing, since))

    def close(self) -> None:
        pass


def alert_stream(grid: DataFrame) -> DataFrame:
    """State changes of (round, name, severity, firing) rows: one row per rule and round, so groups are small."""
    changes = grid.groupBy("name").transformWithState(
        AlertProcessor(), "round TIMESTAMP, name STRING, severity STRING, state STRING, starts_at TIMESTAMP, ends_at TIMESTAMP", "append", "None")
    return changes.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("round", "starts_at", "ends_at")], "name", "severity", "state")


def alert_states(events: DataFrame, failed: Column, rules: Sequence[ThresholdRule], every: str, lateness: str, ts: str = "ts") -> DataFrame:
    """State changes of rules on the rows (``n``) and the failure rate (``rate``) of each round of a stream of events. A
    round is judged once the watermark has passed its end; both operators keep their state in the checkpoint."""
    counted = events.withWatermark(ts, lateness).groupBy(F.window(ts, every).alias("w")).agg(F.count("*").alias("n"), F.count_if(failed).alias("errors"))
    rounds = counted.select(F.col("w.start").alias("round"), "n", (F.col("errors") / F.col("n")).alias("rate"))
    return alert_stream(firing_grid(rounds, rules, ["n", "rate"]))
