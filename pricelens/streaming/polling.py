"""Status events of research runs as a stream, in place of a loop that asks again and again.

A service keeps the events of its runs in numbered logs, some runs to a log. The stream's offset is one
place for each log, so it grows with the logs and not with the runs. A trigger asks how far each log goes
and reads what is new, in stretches that tasks read side by side. After a restart Spark knows the places
it had finished, and nothing before them is asked for again. What has been stored is confirmed to the
service, which may then forget it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

EVENTS = "label STRING, run_id STRING, status STRING, event_time TIMESTAMP"
EVENTS_PER_PARTITION = 100_000


class StatusLogs(Protocol):
    """What the caller supplies. It is sent to executors, so it holds addresses rather than connections."""

    def logs(self) -> Sequence[str]:
        """Names of the logs there are; new ones may come."""

    def length(self, log: str) -> int:
        """How many events the log has had so far."""

    def events(self, log: str, start: int, stop: int) -> Iterator[tuple[str | None, str | None, str | None, datetime]]:
        """The events from place ``start`` up to ``stop``, the same at every call until they are confirmed."""

    def confirm(self, log: str, stop: int) -> None:
        """Everything before ``stop`` has been stored."""


@dataclass
class Stretch(InputPartition):
    log: str
    start: int
    stop: int


class StatusReader(DataSourceStreamReader):
    def __init__(self, service: StatusLogs, events_per_partition: int):
        self.service, self.most = service, events_per_partition

    def initialOffset(self) -> dict[str, int]:
        return {}

    def latestOffset(self) -> dict[str, int]:
        return {log: self.service.length(log) for log in sorted(self.service.logs())}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[InputPartition]:
        return [
            Stretch(log, first, min(first + self.most, stop))
            for log, stop in sorted(end.items())
            for first in range(start.get(log, 0), stop, self.most)
        ]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        yield from self.service.events(partition.log, partition.start, partition.stop)

    def commit(self, end: dict[str, int]) -> None:
        for log, stop in end.items():
            self.service.confirm(log, stop)


def status_source(
    service: StatusLogs, events_per_partition: int = EVENTS_PER_PARTITION, name: str = "run_status"
) -> type[DataSource]:
    """A stream source ``name`` over the logs of a service, for ``run_state.ledger_stream``."""

    class Status(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return EVENTS

        def streamReader(self, schema: Any) -> DataSourceStreamReader:
            return StatusReader(service, events_per_partition)

    return Status


def follow(rows: DataFrame, path: str, checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
    """Asks at this interval and appends what comes of it to the Parquet folder at ``path``, until it is stopped.

    ``availableNow`` would not do: with a Python source it ends before the timers that the last events let pass.
    ``processAllAvailable`` on the query waits until nothing is left to ask for or to give out.
    """
    writer = rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start(path)


def register(spark: SparkSession, *sources: type[DataSource]) -> None:
    for source in sources:
        spark.dataSource.register(source)
