"""The feed, its alerts and its trend on Structured Streaming.

The row-wise operators are the batch functions themselves. Queries run with ``availableNow``: they
process what has arrived, stop, and go on from their checkpoint at the next start, so a rerun of a
daily job adds nothing twice. Checkpoints and outputs belong on storage that all executors share.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from pricelens.operators.shelf import normalise_shelf
from pricelens.plans.reports import mean_price, shelf_alerts
from pricelens.schemas import TREND_BRANDS
from pricelens.sources.payloads import unwrap_items


def shelf_stream(payloads: DataFrame, captured_at: Column) -> DataFrame:
    """Feed rows from a stream of payloads; stateless, as in a batch."""
    return normalise_shelf(unwrap_items(payloads), captured_at)


def append_stream(rows: DataFrame, path: str, checkpoint: str, partition: str | None = None) -> StreamingQuery:
    """Appends what has arrived to the Parquet folder at ``path``, each row once."""
    writer = rows.writeStream.outputMode("append").format("parquet")
    if partition:
        writer = writer.partitionBy(partition)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def alert_stream(
    rows: DataFrame, path: str, checkpoint: str, find_alerts: Callable[[DataFrame], DataFrame] = shelf_alerts
) -> StreamingQuery:
    """Alerts on each batch of new feed rows.

    A batch writes a folder of its own and replaces it if the batch is run again, so a restart
    leaves no alert twice.
    """

    def write_alerts(batch: DataFrame, batch_id: int) -> None:
        find_alerts(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        rows.writeStream.foreachBatch(write_alerts)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_results(results: DataFrame, keys: Sequence[str], at: str, delay: str) -> DataFrame:
    """One result per search and run where retried searches arrive more than once, as long as the
    repeats arrive within ``delay``; the state is dropped behind the watermark."""
    return results.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def daily_price_trend(
    rows: DataFrame, at: str, delay: str, brands: Sequence[str] = TREND_BRANDS
) -> DataFrame:
    """Average price by day and brand, each day given out once it is closed by the watermark."""
    return (
        rows.withWatermark(at, delay)
        .filter(F.col("brand").isin(list(brands)))
        .groupBy(F.window(at, "1 day").alias("window"), "brand")
        .agg(mean_price("price").alias("avg_price"))
        .select(F.to_date("window.start").alias("day"), "brand", "avg_price")
    )


class LateRows(StreamingQueryListener):
    """Counts the rows that came behind the watermark and were dropped, over every batch of the queries
    that run while it is added to ``spark.streams``. Spark keeps the progress of recent batches only."""

    def __init__(self) -> None:
        self.rows = self.batches = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += sum(state.numRowsDroppedByWatermark for state in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
