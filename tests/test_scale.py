"""What the plans must not hold, and what hot keys must not change."""

import importlib
import json

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from pricelens.operators import ledger, research
from pricelens.plans import reports
from pricelens.sources import tables
from workload import standins
from workload.queries import QUERIES as REGISTERED

entry = importlib.import_module("__spark_entry__")

# These write tables or run streams while they are built; what they return is a plain read.
WRITING = {"append_snapshot", "upsert", "refetch_empty"}
QUERIES = sorted(n for n in REGISTERED if n not in WRITING and not n.startswith(("stream_", "poll_")))
# What asks a service runs the caller's function in Python workers.
ASKING = {"fetch_requests", "live_payloads", "live_run_results", "fetch_web_function", "post_run_function", "fetch_run_function"}


@pytest.mark.parametrize("name", QUERIES)
def test_plans_hold_no_pairing_and_no_python(spark, sf_dir, name):
    plan = plan_of(entry.queries()[name](spark, sf_dir))
    if name != "seed_searches":
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in ASKING:
        assert "Python" not in plan and "InPandas" not in plan


LATEST = [
    *["latest_snapshot", "brand_scoreboard", "shelf_counters", "price_by_brand_retailer", "sponsored_by_brand"],
    *["discount_by_brand", "facets", "filtered_shelf", "detail_page", "shelf_alerts", "alert_state"],
    *["q_most_on_sale", "q_margin_vs_discount"],
]


@pytest.mark.parametrize("name", LATEST)
def test_latest_reports_read_one_folder(spark, sf_dir, name):
    plan = plan_of(REGISTERED[name](spark, sf_dir))
    feed = [line for line in plan.splitlines() if "FileScan" in line and "shelf_history" in line]
    assert any("captured_on" in line.split("PartitionFilters: [")[1].split("]")[0] and "ubquery" in line for line in feed)


def test_bucketed_feeds_are_compared_without_a_shuffle(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(REGISTERED["feed_compare_bucketed"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("SortMergeJoin") and plan.count("Bucketed: true") == 2


def rows_scanned(df):
    """Rows that the scans of an executed query gave out."""
    df._jdf.collectToPython()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = (plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan).collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_a_look_up_skips_row_groups(spark, folder):
    rows = spark.range(200_000).select(
        (F.col("id") * 7919 % 50_021).cast("string").alias("product_id"),
        F.col("id").alias("n"),
        F.md5(F.col("id").cast("string")).alias("filling"),
        F.lit("2025-01-01").cast("date").alias("captured_on"),
    )
    plain, sorted_path = f"{folder}/plain", f"{folder}/sorted"
    tables.append_snapshot(rows, plain)
    written = tables.append_snapshot(rows, sorted_path, look_up_by=["product_id"], row_group_bytes=1 << 19)
    assert written == 200_000
    found = [tables.read_history(spark, path, rows.schema).filter("product_id = '4711'") for path in (plain, sorted_path)]
    scanned = [rows_scanned(df) for df in found]
    assert sorted(map(tuple, found[0].collect())) == sorted(map(tuple, found[1].collect())) and found[1].count() == 4
    assert 10 * scanned[1] < scanned[0]
    missing = tables.read_history(spark, sorted_path, rows.schema).filter("product_id = '4711x'")
    assert rows_scanned(missing) < scanned[0] / 10 and missing.isEmpty()


def test_newest_per_retailer_does_not_deal_out_the_feed(spark, sf_dir):
    plan = plan_of(REGISTERED["latest_snapshot_per_retailer"](spark, sf_dir))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("view", ["shelf", "payloads", "searches"])
def test_line_items_are_not_dealt_out_by_supplier(spark, sf_dir, view):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(getattr(standins, view)(spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(l_partkey" in plan and "hashpartitioning(l_suppkey" not in plan


@pytest.mark.parametrize("view", ["payloads", "envelopes"])
def test_views_hold_no_method_that_is_too_long_to_compile(spark, sf_dir, view):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = getattr(standins, view)(spark, sf_dir)._jdf.queryExecution().debug().codegenToSeq()
        sizes = [stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) <= 8000


def test_envelopes_are_put_together_from_pieces(spark, sf_dir):
    plan = plan_of(standins.envelopes(spark, sf_dir))
    # Rows in the two shapes that hold several, and claims; none of them twice.
    assert (plan.count(" transform(") + plan.count("(transform("), plan.count("zip_with(")) == (2, 1)
    run = json.loads(standins.envelopes(spark, sf_dir).filter("run_id = 'run_1'").first().envelope)["output"]
    customer = next(r.o_custkey for r in standins.table(spark, sf_dir, "orders").collect() if r.o_orderkey == 1)
    count = customer % 12 + 1
    assert [row["gross_margin_pct"] for row in run["content"]["rows"]] == [0.5 + i for i in range(count)]
    assert [row.get("company") for row in run["content"]["rows"]] == [None if (1 + i) % 7 == 0 else f"Company {(customer + i) % 50}" for i in range(count)]
    cited = [[url["url"] for url in one["citations"]] for one in run["trust"]["claims"]]
    assert cited == [[f"https://a.example.com/{(customer + n) % 5}", "", f"https://b.example.com/{n % 3}"] for n in range(3 * count + 6)]


def test_sources_of_rows_do_not_parse_all_claims_as_texts(spark):
    runs = spark.createDataFrame([("r", "completed", "{}")], "run_id string, status string, envelope string")
    plan = plan_of(research.run_result(runs).select("run_id", "source_urls", "high_confidence_share"))
    assert "mixed_texts" in plan and "claim_texts" not in plan


def test_the_history_is_dealt_out_while_its_rows_are_narrow(spark, sf_dir, folder):
    feed = standins.shelf(spark, sf_dir, by_day=True)
    plan = plan_of(feed)
    assert plan.count("REBALANCE") == 1 and plan.index("https://shop.example.com/") < plan.index("REBALANCE")
    assert tables.append_snapshot(feed, folder, dealt=True) == feed.count()
    history = tables.read_history(spark, folder, feed.schema).select(feed.columns)
    assert history.exceptAll(standins.shelf(spark, sf_dir)).isEmpty()


def hot_third(spark, rows=30_000):
    """A key that holds a third of all rows, in many partitions."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    return spark.range(0, rows, 1, 16).select("id", key.alias("key"))


def test_hot_run_in_the_ledger(spark):
    events = hot_third(spark).select(
        F.col("key").cast("string").alias("label"),
        F.concat_ws("_", "key", F.lit("run")).alias("run_id"),
        F.when(F.col("id") == 15_000, "completed").otherwise("running").alias("status"),
        F.timestamp_seconds(F.col("id") / 100).alias("event_time"),
    )
    result = ledger.run_ledger(events)
    plan = plan_of(result)
    assert plan.index("WindowGroupLimit") < plan.index("partial_min")
    assert tuple(result.filter("label = '0'").first()) == ("0", "0_run", "completed", 1)
    assert result.count() == 20_001


def test_hot_row_among_the_claims(spark):
    claims = hot_third(spark).select(
        F.col("key").alias("run_id"),
        F.col("id").alias("claim_pos"),
        F.lit("$[0].a").alias("path"),
        F.when(F.col("id") % 2 == 0, "high").otherwise("low").alias("confidence"),
        F.concat(F.lit("u"), (F.col("id") % 100).cast("string")).alias("url"),
    )
    matched = research.claim_match(claims)
    assert "partial_count" in plan_of(matched)
    hot = matched.filter("run_id = 0").first()
    assert (hot.claims, hot.graded, hot.high, hot.sources) == (10_000, 10_000, 5_000, 100)
    sources = research.row_sources(claims)
    assert "partial_min" in plan_of(sources)
    first = {row.url: row.first_seen for row in sources.filter("run_id = 0").collect()}
    assert first == {f"u{n % 100}": n for n in range(297, -1, -3)}


def test_hot_brand_on_the_scoreboard(spark, sf_dir):
    shelf = standins.shelf(spark, sf_dir).withColumn(
        "brand", F.when(F.col("position") <= 3, "Brand#1").otherwise(F.col("brand"))
    )
    board = reports.brand_scoreboard(shelf, standins.BRANDS)
    assert "partial_avg" in plan_of(board)
    counted = sum(row.products for row in board.collect())
    assert counted == shelf.filter(F.col("brand").isin(standins.BRANDS)).count()
