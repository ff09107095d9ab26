"""Fetching payloads on executors with a fetcher the caller supplies.

This package holds no network code. A fetcher is any function ``(template, params) -> payload``,
where the payload is JSON text or something ``json.dumps`` can write; it may raise.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.sources.payloads import is_object, with_items

Fetcher = Callable[[str, dict[str, Any]], Any]


def attempt(
    fetcher: Fetcher, template: str, params_json: str, retries: int, pause: float, error_length: int
) -> tuple[str | None, str | None]:
    """Payload and error of one request, tried again after a pause while it fails."""
    error = None
    for tried in range(retries + 1):
        if tried:
            time.sleep(pause)
        try:
            payload = fetcher(template, json.loads(params_json))
            return (payload if isinstance(payload, str) else json.dumps(payload)), None
        except Exception as failure:
            error = str(failure)[:error_length]
    return None, error


def fetch(
    requests: DataFrame,
    fetcher: Fetcher,
    parallelism: int = 10,
    retries: int = 1,
    pause: float = 3.0,
    error_length: int = 300,
    rows_at_once: int = 8,
) -> DataFrame:
    """``requests`` (``template``, ``params_json``) with ``payload`` and ``error`` added.

    ``parallelism`` is how many requests may be under way at once, so the number of partitions is
    fixed and the rows are dealt round-robin, whatever their keys. A request that keeps failing is a
    row with the start of the last error and no payload. Requests that already carry an ``error``
    are passed through and not sent. Rows leave a task ``rows_at_once`` at a time, so no more payloads
    than that are held in memory.

    A lost task is fetched again, and so is everything when the result is read twice: write it to a
    table before reading it more than once, as ``fetch_twice`` does.
    """

    def fetch_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), rows_at_once):
                batch = whole.iloc[start : start + rows_at_once]
                sent = batch["error"].isna()
                outcome = [
                    attempt(fetcher, template, params, retries, pause, error_length) if send else (None, error)
                    for template, params, error, send in zip(
                        batch["template"], batch["params_json"], batch["error"], sent
                    )
                ]
                yield batch.assign(
                    payload=[payload for payload, _ in outcome], error=[error for _, error in outcome]
                )

    if "error" not in requests.columns:
        requests = requests.withColumn("error", F.lit(None).cast("string"))
    shaped = requests.select(
        *[name for name in requests.columns if name != "error"],
        F.lit(None).cast("string").alias("payload"),
        "error",
    )
    return shaped.repartition(parallelism).mapInPandas(fetch_partition, shaped.schema)


def with_item_count(results: DataFrame) -> DataFrame:
    """Adds ``item_count``, unless it is there. The explode over one element keeps a later filter on the count where it
    is: pushed below, it would repeat the whole parse once per place the items are used in."""
    if "item_count" in results.columns:
        return results
    counted = with_items(results).withColumn("_count", F.size("items"))
    return counted.select(*results.columns, F.explode(F.array("_count")).alias("item_count"))


def empty_results(results: DataFrame) -> DataFrame:
    """Results whose payload holds no item at all."""
    return with_item_count(results).filter("item_count = 0").drop("item_count")


def answered_results(results: DataFrame) -> DataFrame:
    """Results whose payload holds at least one item."""
    return with_item_count(results).filter("item_count > 0").drop("item_count")


def refetch_empty(
    results: DataFrame, fetcher: Fetcher, path: str, parallelism: int = 5, retries: int = 1, pause: float = 3.0
) -> DataFrame:
    """Results with items, and a second, gentler try at those without.

    ``results`` must be a written table, so that reading its two halves fetches nothing; written with
    ``with_item_count`` it is filtered by that column and its payloads are not parsed again. The second
    pass is written under ``path`` for the same reason.
    """
    spark = results.sparkSession
    empty, sent = F.col("item_count") == 0, F.col("template").isNotNull()
    counted = with_item_count(results)
    again = counted.filter(empty & sent).drop("payload", "error", "item_count")
    fetch(again, fetcher, parallelism, retries, pause).write.parquet(path)
    return counted.filter(~(empty & sent)).drop("item_count").unionByName(spark.read.parquet(path))


def fetch_twice(
    requests: DataFrame,
    fetcher: Fetcher,
    path: str,
    parallelism: tuple[int, int] = (10, 5),
    retries: int = 1,
    pause: float = 3.0,
) -> DataFrame:
    """Both passes over all requests, each written under ``path``: the feed's payload table.

    A change to the parsing replays from there without fetching.
    """
    spark = requests.sparkSession
    first, second = f"{path}/first_pass", f"{path}/second_pass"
    with_item_count(fetch(requests, fetcher, parallelism[0], retries, pause)).write.parquet(first)
    return refetch_empty(spark.read.parquet(first), fetcher, second, parallelism[1], retries, pause)


def fetch_coverage(results: DataFrame) -> DataFrame:
    """Per retailer: products found, searches made, searches with results and without."""
    items = F.col("items")
    return (
        with_items(results.select("retailer", "payload"))
        .select(
            "retailer",
            F.size(F.filter(items, is_object)).alias("products"),
            (F.size(items) > 0).alias("answered"),
        )
        .groupBy("retailer")
        .agg(
            F.sum("products").alias("products"),
            F.count(F.lit(1)).alias("searches"),
            F.count_if("answered").alias("searches_with_results"),
            F.count_if(~F.col("answered")).alias("empty_searches"),
        )
    )


def empty_searches(results: DataFrame) -> DataFrame:
    """The searches without results, one row each, as ``retailer / keyword`` and the error if any."""
    return empty_results(results).select(
        F.concat_ws(" / ", "retailer", "keyword").alias("search"), "error"
    )
