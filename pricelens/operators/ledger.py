"""State of research runs from a log of status events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ["completed", "failed", "cancelled"]
STILL_RUNNING = "still running"
MAX_MINUTES = 45


def run_ledger(events: DataFrame, max_minutes: int = MAX_MINUTES) -> DataFrame:
    """Per ``label``: the run that counts, its state and the number of attempts.

    ``events`` holds ``label``, ``run_id``, ``status`` and ``event_time``. The first run of a label
    counts unless it fails and a second was started; then the second does. A run is in the state of
    its first terminal event; without one within ``max_minutes`` of the label's first event it is
    still running.

    Events are aggregated per run before the shuffle and only the two earliest runs of a label go
    on, so a label with very many events costs no more than another.
    """
    ended = F.when(F.col("status").isin(TERMINAL), F.struct("event_time", "status"))
    runs = events.groupBy("label", "run_id").agg(
        F.min("event_time").alias("started_at"), F.min(ended).alias("ended")
    )
    by_start = Window.partitionBy("label").orderBy("started_at", "run_id")
    run = F.struct("run_id", "started_at", "ended")
    nth = F.col("nth")
    attempts = (
        runs.withColumn("nth", F.row_number().over(by_start))
        .filter(nth <= 2)
        .groupBy("label")
        .agg(
            F.first(F.when(nth == 1, run), ignorenulls=True).alias("first"),
            F.first(F.when(nth == 2, run), ignorenulls=True).alias("second"),
        )
    )
    limit = F.col("first.started_at") + F.make_dt_interval(mins=F.lit(max_minutes))
    first_end = F.when(F.col("first.ended.event_time") <= limit, F.col("first.ended.status"))
    second_end = F.when(F.col("second.ended.event_time") <= limit, F.col("second.ended.status"))
    retried = F.coalesce((first_end == "failed") & (F.col("second.started_at") <= limit), F.lit(False))
    return attempts.select(
        "label",
        F.when(retried, F.col("second.run_id")).otherwise(F.col("first.run_id")).alias("run_id"),
        F.coalesce(F.when(retried, second_end).otherwise(first_end), F.lit(STILL_RUNNING)).alias("state"),
        F.when(retried, 2).otherwise(1).alias("attempts"),
    )


def not_completed(ledger: DataFrame) -> DataFrame:
    """Runs to report: those that gave no rows."""
    return ledger.filter(F.col("state") != "completed")


def completed(ledger: DataFrame) -> DataFrame:
    """Runs whose result is read."""
    return ledger.filter(F.col("state") == "completed")
