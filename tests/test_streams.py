"""Streams give what the batch operators give, once."""

import datetime
import pathlib
import random
import time

import pytest
from pyspark.sql import functions as F
from test_research import LEDGER, LOG, T0, status_events

from pricelens.operators import ledger
from pricelens.operators.shelf import normalise_shelf
from pricelens.plans.reports import shelf_alerts
from pricelens.sources.payloads import unwrap_items
from pricelens.streaming import feeds, run_state, trend
from workload import standins


def arriving(spark, df, folder, files=3):
    df.repartition(files).write.mode("append").parquet(f"{folder}/source")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/source")


def test_stream_equals_batch_and_a_rerun_adds_nothing(spark, sf_dir, folder):
    captured_at = F.lit("2025-01-01").cast("timestamp")
    payloads = standins.payloads(spark, sf_dir).drop(*standins.ROW_KEY)
    stream = arriving(spark, payloads, folder)
    for _ in range(2):
        rows = feeds.shelf_stream(stream, captured_at)
        feeds.append_stream(rows, f"{folder}/feed", f"{folder}/checkpoint").awaitTermination()
    batch = normalise_shelf(unwrap_items(spark.read.parquet(f"{folder}/source")), captured_at)
    streamed = spark.read.parquet(f"{folder}/feed").select(batch.columns)
    assert streamed.count() == batch.count() > 3000
    assert streamed.exceptAll(batch).isEmpty()


def test_alerts_are_written_once(spark, sf_dir, folder):
    feed = standins.shelf(spark, sf_dir).drop(*standins.ROW_KEY)
    stream = arriving(spark, feed, folder)

    def find(rows):
        return shelf_alerts(rows, your_brand="economy", watched_product="widget", discount_pct=5)

    for _ in range(2):
        feeds.alert_stream(stream, f"{folder}/alerts", f"{folder}/checkpoint", find).awaitTermination()
    assert spark.read.parquet(f"{folder}/alerts").count() == find(feed).count() > 0


def ledger_of(spark, folder, batches):
    """What the stream itself gives, one start for each list of events and one for the end of the log."""
    schema = "label STRING, run_id STRING, status STRING, event_time TIMESTAMP"
    end = run_state.clock_rows(spark, "2100-01-01 00:00:00")
    for batch in [*(spark.createDataFrame(b, schema) for b in batches), end]:
        batch.coalesce(1).write.mode("append").parquet(f"{folder}/source")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/source")
        feeds.append_stream(
            run_state.ledger_stream(stream, "400 days"), f"{folder}/ledger", f"{folder}/checkpoint"
        ).awaitTermination()
    return sorted(tuple(row) for row in spark.read.schema(run_state.LEDGER).parquet(f"{folder}/ledger").collect())


def test_ledger_stream_equals_batch_whatever_the_order(spark, folder):
    events = status_events(spark)
    rows = sorted((tuple(row) for row in events.collect()), key=lambda r: r[3], reverse=True)
    got = ledger_of(spark, folder, [rows[k::4] for k in range(4)])
    assert got == sorted(LEDGER)
    assert {tuple(row) for row in ledger.run_ledger(events).collect()} == LEDGER
    assert len(LOG) == events.count()


@pytest.mark.parametrize("seed", range(2))
def test_ledger_stream_equals_batch_on_random_logs(spark, folder, seed):
    rng = random.Random(seed)
    states = ["running", "running", "failed", "failed", "completed", "cancelled"]
    rows = [
        (f"l{rng.randint(0, 60)}", rng.choice(["a", "b", "c", None]), rng.choice(states), T0 + datetime.timedelta(minutes=rng.randint(0, 90)))
        for _ in range(400)
    ]
    events = spark.createDataFrame(rows, "label STRING, run_id STRING, status STRING, event_time TIMESTAMP")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(row) for row in ledger.run_ledger(events.filter("run_id IS NOT NULL")).collect()), key=key)
    got = ledger_of(spark, folder, [[r for r in rows[k::2] if r[1]] for k in range(2)])
    assert sorted(got, key=key) == want


def test_a_closed_label_ignores_late_events_until_it_is_forgotten(spark, folder):
    minute = lambda n: T0 + datetime.timedelta(minutes=n)
    schema = "label STRING, run_id STRING, status STRING, event_time TIMESTAMP"
    for rows in (
        [("a", "r1", "running", minute(0)), ("a", "r1", "completed", minute(3))],
        [(None, None, None, minute(200))],
        [("a", "r1", "failed", minute(190)), ("b", "r2", "cancelled", minute(195))],
        [(None, None, None, minute(5000))],
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/source")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/source")
        rows = run_state.ledger_stream(stream, "20 minutes")
        feeds.append_stream(rows, f"{folder}/ledger", f"{folder}/checkpoint").awaitTermination()
    got = sorted(tuple(row) for row in spark.read.schema(run_state.LEDGER).parquet(f"{folder}/ledger").collect())
    assert got == [("a", "r1", "completed", 1), ("b", "r2", "cancelled", 1)]


def test_late_rows_correct_their_day(spark, folder):
    day = datetime.datetime
    schema = "at TIMESTAMP, brand STRING, price DOUBLE"

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{folder}/source")
        trend.trend_stream(stream, "at", f"{folder}/trend", f"{folder}/checkpoint", "1 hour", ["Nike"]).awaitTermination()
        days = {(row.day.day, row.avg_price) for row in trend.corrected_trend(spark, f"{folder}/trend").collect()}
        late = trend.late_rows(spark, f"{folder}/trend", schema).collect()
        return days, sorted((row.at, row.price, row.batch_id) for row in late)

    def add(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{folder}/source")

    add((day(2025, 1, 1, 1), "Nike", 10.0), (day(2025, 1, 1, 2), "Nike", 20.0), (day(2025, 1, 3), "Nike", None), (day(2025, 1, 9), "Other", 5.0))
    assert run() == ({(1, 15.0), (3, None)}, [])
    add((day(2025, 1, 1, 3), "Nike", 99.0), (day(2025, 1, 2, 23), "Nike", 4.0), (day(2025, 1, 5), "Nike", 1.0))
    want = ({(1, 43.0), (2, 4.0), (3, None), (5, 1.0)}, [(day(2025, 1, 1, 3), 99.0, 1)])
    assert run() == want
    # A batch that is run again, as after a lost driver, replaces what it wrote.
    for name in ("1", ".1.crc"):
        (pathlib.Path(folder) / "checkpoint/commits" / name).unlink(missing_ok=True)
    assert run() == want


def test_late_rows_are_dropped_and_counted(spark, folder):
    day = datetime.datetime
    schema = "at TIMESTAMP, brand STRING, price DOUBLE"
    path = f"{folder}/source"

    def run():
        stream = spark.readStream.schema(schema).parquet(path)
        trend = feeds.daily_price_trend(stream, "at", "1 hour", ["Nike"])
        late = feeds.LateRows()
        spark.streams.addListener(late)
        feeds.append_stream(trend, f"{folder}/trend", f"{folder}/checkpoint").awaitTermination()
        deadline = time.time() + 20  # progress events arrive a little after the query has ended
        while not late.batches and time.time() < deadline:
            time.sleep(0.2)
        time.sleep(1)
        spark.streams.removeListener(late)
        return late.rows

    def add(*rows):
        spark.createDataFrame(list(rows), schema).write.mode("append").parquet(path)

    add((day(2025, 1, 1, 1), "Nike", 10.0), (day(2025, 1, 1, 2), "Nike", 20.0), (day(2025, 1, 3), "Nike", 1.0))
    assert run() == 0
    add((day(2025, 1, 1, 3), "Nike", 99.0), (day(2025, 1, 5), "Nike", 1.0))
    assert run() == 1
    trend = {(row.day, row.avg_price) for row in spark.read.parquet(f"{folder}/trend").collect()}
    assert (datetime.date(2025, 1, 1), 15.0) in trend and (datetime.date(2025, 1, 3), 1.0) in trend


def test_repeated_results_are_kept_once(spark, folder):
    rows = [("a", "k", T0), ("a", "k", T0 + datetime.timedelta(minutes=5)), ("b", "k", T0)]
    df = spark.createDataFrame(rows, "retailer STRING, keyword STRING, at TIMESTAMP")
    first = feeds.first_results(arriving(spark, df, folder), ["retailer", "keyword"], "at", "1 hour")
    feeds.append_stream(first, f"{folder}/first", f"{folder}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{folder}/first").count() == 2
