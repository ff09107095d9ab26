"""The price trend as sums per day that late rows correct.

Every batch is reduced to one sum and one count per day and brand, in a folder of its own that a repeated
batch replaces. Sums of different batches merge, so the trend is an aggregate over all of them, a row that
comes late changes its day, and nothing waits for a watermark. What a batch leaves does not grow with its
rows. Rows of a day that was over, by the newest row of the batches before and the allowed delay, are kept
apart as well, so that a reader sees what was corrected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricelens.schemas import TREND_BRANDS

_DAYS = "day DATE, brand STRING, price_sum DECIMAL(38, 4), prices BIGINT, newest TIMESTAMP, batch_id BIGINT"


def _days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_DAYS).parquet(f"{path}/days")


def trend_stream(
    rows: DataFrame, at: str, path: str, checkpoint: str, delay: str, brands: Sequence[str] = TREND_BRANDS
) -> StreamingQuery:
    """Adds what has arrived (``brand``, ``price`` and the time ``at``) to the sums under ``path``, and rows of days that
    were over to the late rows there. ``path`` belongs to one checkpoint. ``delay`` is an interval such as ``2 days``."""
    wanted = rows.filter(F.col("brand").isin(list(brands)))

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        days = batch.groupBy(F.to_date(at).alias("day"), "brand").agg(
            F.sum(F.col("price").cast("decimal(18,4)")).cast("decimal(38,4)").alias("price_sum"),
            F.count("price").alias("prices"),
            F.max(F.col(at).cast("timestamp")).alias("newest"),
        )
        if batch_id:
            before = _days(spark, path).filter(F.col("batch_id") < batch_id).agg(F.max("newest").alias("newest"))
            over = before.select(F.expr(f"newest - INTERVAL {delay}").alias("over")).scalar()
            late = batch.filter(F.to_date(at).cast("timestamp") + F.expr("INTERVAL 1 DAY") <= over)
            late.write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        # Written last: a batch with sums is complete.
        days.write.mode("overwrite").parquet(f"{path}/days/batch_id={batch_id}")

    return wanted.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def corrected_trend(spark: SparkSession, path: str) -> DataFrame:
    """Average price by day and brand over everything that has arrived, equal to ``reports.price_trend``."""
    return (
        _days(spark, path)
        .groupBy("day", "brand")
        .agg((F.sum("price_sum").cast("double") / F.sum("prices")).alias("avg_price"))
    )


def late_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that corrected a day which was over, with the batch they came in."""
    try:
        return spark.read.schema(f"{schema}, batch_id BIGINT").parquet(f"{path}/late")
    except AnalysisException:  # no batch but the first has been written
        return spark.createDataFrame([], f"{schema}, batch_id BIGINT")
