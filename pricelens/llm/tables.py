"""Reading the tables the operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.session import shared_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only, so that no further column of the caller's can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; fold 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def stored(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: what is read twice is computed once, and a
    lost executor costs a read instead of the jobs before. ``folders`` are columns to partition by."""
    path = shared_dir(df.sparkSession, label)
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Estimates over this many bytes are Spark's way to say that it does not know.
UNKNOWN_SIZE = 1 << 54


def buckets_for(df: DataFrame, mb_each: float) -> int:
    """How many buckets hold the frame's data: one for each ``mb_each`` of its input by the optimizer's
    estimate, and at least the session's shuffle partitions, which also stand in for an unknown size."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size > UNKNOWN_SIZE else max(least, int(size / (mb_each * 1e6)) + 1)
