"""Live answers as Spark data sources, read with ``spark.read.format(...).load(requests)``.

A source asks for each row of a table of requests and adds the answer's columns to it. The table is a
Parquet folder of text columns, usually partitioned by retailer or agent. Filters on those columns reach
the reader: folders and row groups that cannot match are not opened, and rows that do not match are not
asked. A partition is a stretch of the table, so a lost executor repeats the requests of its stretches
only, and answers leave a task a few at a time. Request files are opened with pyarrow, which knows local
paths, the usual object stores and HDFS, but not file systems that are set up in Spark alone.

What asks is a plain function that the caller supplies; this package holds no network code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
)

from pricelens.sources.fetch import Fetcher, attempt

#: Requests of a partition, and answers handed on at a time.
ROWS_PER_PARTITION, ROWS_AT_ONCE = 1000, 8
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

#: From the values of a request to those of its answer, each in the order of its columns.
Ask = Callable[..., Sequence[str | None]]


@dataclass
class Stretch(InputPartition):
    """Rows ``first`` to ``stop`` of a row group, with the values that its folders stand for."""

    file: str
    folders: pc.Expression
    row_group: int
    first: int
    stop: int


class RequestReader(DataSourceReader):
    def __init__(self, path: str, requests: Sequence[str], answers: Sequence[str], ask: Ask, rows: int):
        self.path, self.ask, self.rows = path, ask, rows
        self.requests = pa.schema([(name, pa.string()) for name in requests])
        self.schema = pa.schema([(name, pa.string()) for name in [*requests, *answers]])
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps the filters that say which requests are wanted and gives the others back to Spark."""
        for f in filters:
            known = isinstance(f, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull))
            if known and len(f.attribute) == 1 and f.attribute[0] in self.requests.names:
                self.wanted.append(f)
            else:
                yield f

    def _condition(self) -> pc.Expression | None:
        def holds(f: Filter) -> pc.Expression:
            column = pc.field(f.attribute[0])
            if isinstance(f, (IsNull, IsNotNull)):
                return column.is_null() if isinstance(f, IsNull) else column.is_valid()
            if isinstance(f, In):
                return column.isin([value for value in f.value if value is not None])
            if f.value is None:  # equals nothing, unless nulls are asked for
                return column.is_null() if isinstance(f, EqualNullSafe) else pc.scalar(False)
            return column == f.value

        return reduce(lambda a, b: a & b, map(holds, self.wanted)) if self.wanted else None

    def partitions(self) -> list[InputPartition]:
        filesystem, path = fs.FileSystem.from_uri(self.path)
        folders = ds.partitioning(self.requests, flavor="hive")
        files = ds.dataset(path, schema=self.requests, format="parquet", filesystem=filesystem, partitioning=folders)
        condition = self._condition()
        return [
            Stretch(group.path, group.partition_expression, info.id, first, min(first + self.rows, info.num_rows))
            for fragment in files.get_fragments(condition)
            for group in fragment.split_by_row_group(condition, schema=self.requests)
            for info in group.row_groups
            for first in range(0, info.num_rows, self.rows)
        ]

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to say that there are none
            return
        filesystem, _ = fs.FileSystem.from_uri(self.path)
        group = ds.ParquetFileFormat().make_fragment(
            partition.file, filesystem, partition_expression=partition.folders, row_groups=[partition.row_group]
        )
        asked = group.to_table(schema=self.requests).slice(partition.first, partition.stop - partition.first)
        condition = self._condition()
        if condition is not None:
            asked = asked.filter(condition)
        for start in range(0, len(asked), ROWS_AT_ONCE):
            rows = [tuple(row.values()) for row in asked.slice(start, ROWS_AT_ONCE).to_pylist()]
            answered = [(*row, *self.ask(*row)) for row in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*answered, strict=True)], schema=self.schema)


def live_source(
    name: str, requests: Sequence[str], answers: Sequence[str], ask: Ask, rows: int = ROWS_PER_PARTITION
) -> type[DataSource]:
    """A data source ``name`` that reads a folder of ``requests`` and adds the ``answers`` that ``ask`` gives."""

    class Live(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ", ".join(f"{column} STRING" for column in [*requests, *answers])

        def reader(self, schema: Any) -> DataSourceReader:
            return RequestReader(self.options["path"], requests, answers, ask, rows)

    return Live


def payload_source(
    fetcher: Fetcher, retries: int = 1, pause: float = 3.0, error_length: int = 300, name: str = "shelf_payloads"
) -> type[DataSource]:
    """Retailer searches: the columns of ``expand_requests`` but the error, with ``payload`` and ``error``. A request
    without a template is not sent and says so, as there."""

    def ask(retailer, keyword, template, params_json):
        if template is None:
            return None, f"unknown retailer: {'NULL' if retailer is None else retailer}"
        return attempt(fetcher, template, params_json, retries, pause, error_length)

    return live_source(name, ["retailer", "keyword", "template", "params_json"], ["payload", "error"], ask)


def run_source(
    read_run: Callable[[str, str], tuple[str, str | None]], error_length: int = 300, name: str = "run_results"
) -> type[DataSource]:
    """Research runs: ``agent_id`` and ``run_id`` with ``status``, ``envelope`` and ``error``. ``read_run`` gives the
    status, and the envelope of a run that has one; where it raises the status is ``error``."""

    def ask(agent_id, run_id):
        try:
            return (*read_run(agent_id, run_id), None)
        except Exception as failure:
            return "error", None, str(failure)[:error_length]

    return live_source(name, ["agent_id", "run_id"], ["status", "envelope", "error"], ask)


def register(spark: SparkSession, *sources: type[DataSource]) -> None:
    """Makes the sources known to the session, and lets filters reach Python sources in it."""
    spark.conf.set(_PUSHDOWN, "true")
    for source in sources:
        spark.dataSource.register(source)
