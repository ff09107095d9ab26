"""The run ledger on a stream of status events, with keyed state and event-time timers.

A label's state is a map from run to the run's start and first end, so an event rewrites the entry of its
own run and nothing else; state grows with retries, not with events. A timer on event time gives the
label's row out when ``max_minutes`` after its first event have passed the watermark, and a second one,
``keep_minutes`` later, forgets the label. In between late events find it closed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pricelens.operators.ledger import MAX_MINUTES, STILL_RUNNING, TERMINAL

LEDGER = "label STRING, run_id STRING, state STRING, attempts INT"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunLedger(StatefulProcessor):
    """Times are microseconds since the epoch in the state, and milliseconds for the timers."""

    def __init__(self, max_minutes: int, keep_minutes: int):
        self.limit, self.keep_ms = max_minutes * 60_000_000, keep_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "run STRING", "started LONG, ended LONG, status STRING")
        self.label = handle.getValueState("label", "first LONG, closed BOOLEAN")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.label.get() if self.label.exists() else None
        if key[0] is None or (known and known[1]):
            for _ in rows:  # a row without a label moves the clock only, a closed label stays as it is
                pass
            return iter(())
        first = earliest = known[0] if known else None
        for batch in rows:
            # Events are reduced to one start and one end per run first, in pandas.
            events = pd.DataFrame(
                {
                    "run": batch["run_id"].map(lambda run: "" if run is None else f"={run}"),  # a map has no null key
                    "status": batch["status"],
                    "at": batch["event_time"].astype("datetime64[us]").astype("int64"),
                }
            )
            ends = events[events["status"].isin(TERMINAL)].sort_values(["at", "status"]).drop_duplicates("run")
            ended = {run: (int(at), status) for run, at, status in zip(ends["run"], ends["at"], ends["status"])}
            for run, started in events.groupby("run")["at"].min().items():
                self._merge(run, int(started), ended.get(run))
                earliest = int(started) if earliest is None else min(earliest, int(started))
        if earliest is not None and earliest != first:
            if first is not None:
                self.handle.deleteTimer(self._due(first))
            self.handle.registerTimer(self._due(earliest))
            self.label.update((earliest, False))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, closed = self.label.get()
        if closed:
            self.label.clear()
            return iter(())
        runs = sorted((entry[0], run[0], entry[1], entry[2]) for run, entry in self.runs.iterator())
        run_id, state, attempts = self._decide(runs, first + self.limit)
        self.runs.clear()
        self.label.update((first, True))
        self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) + self.keep_ms)
        return iter([pd.DataFrame({"label": [key[0]], "run_id": [run_id], "state": [state], "attempts": [attempts]})])

    def close(self) -> None:
        pass

    def _due(self, first: int) -> int:
        return -(-(first + self.limit) // 1000)

    def _merge(self, run: str, started: int, end: tuple[int, str] | None) -> None:
        """The earlier start, and the earlier end (of equal ones the lesser status)."""
        entry = self.runs.getValue((run,)) if self.runs.containsKey((run,)) else None
        ends = [e for e in (end, (entry[1], entry[2]) if entry and entry[2] is not None else None) if e]
        ended, status = min(ends, default=(None, None))
        self.runs.updateValue((run,), (min(started, entry[0]) if entry else started, ended, status))

    @staticmethod
    def _decide(runs: list[tuple], limit: int) -> tuple[str | None, str, int]:
        """The first run counts, unless it failed in time and a second one was started in time."""
        in_time = [(run, status if status is not None and ended <= limit else None) for started, run, ended, status in runs[:2] if started <= limit]
        retried = len(in_time) == 2 and in_time[0][1] == "failed"
        run, status = in_time[1] if retried else in_time[0]
        return run[1:] if run else None, status or STILL_RUNNING, 2 if retried else 1


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with maps and timers needs this store, which keeps state on disk and uploads what changed."""
    if spark.conf.get(_STORE, "") != _ROCKSDB:
        spark.conf.set(_STORE, _ROCKSDB)


def ledger_stream(
    events: DataFrame, delay: str, max_minutes: int = MAX_MINUTES, keep_minutes: int = 24 * 60
) -> DataFrame:
    """``run_ledger`` on a stream of status events (``label``, ``run_id``, ``status``, ``event_time``): one row per
    label, given out when the watermark passes ``max_minutes`` after the label's first event, whatever the order
    of arrival. Rows without a label belong to no ledger: they only tell that time has passed, as ``clock_rows`` do.

    Sets the session's state store, see ``use_rocksdb``.
    """
    use_rocksdb(events.sparkSession)
    return (
        events.select("label", "run_id", "status", "event_time")
        .withWatermark("event_time", delay)
        .groupBy("label")
        .transformWithStateInPandas(RunLedger(max_minutes, keep_minutes), LEDGER, "append", "EventTime")
    )


def clock_rows(spark: SparkSession, at: str) -> DataFrame:
    """One event without a label that moves the watermark to ``at``: the end of a log that will not go on."""
    return spark.range(1).selectExpr(
        "CAST(NULL AS STRING) AS label", "CAST(NULL AS STRING) AS run_id", "CAST(NULL AS STRING) AS status", f"TIMESTAMP '{at}' AS event_time"
    )
