"""Reports, feed comparison, questions and audit on small tables."""

import datetime
import random

from conftest import plan_of
from pyspark.sql import functions as F

from pricelens.plans import audit, compare, questions, reports

DAY = datetime.datetime
SHELF = (
    "retailer STRING, search_keyword STRING, position INT, brand STRING, product_name STRING, price DOUBLE, "
    "list_price DOUBLE, discount_pct DOUBLE, rating DOUBLE, review_count INT, sponsored BOOLEAN, "
    "product_url STRING, captured_at TIMESTAMP"
)


def shelf(spark, *rows):
    defaults = dict.fromkeys([part.split()[0] for part in SHELF.split(", ")])
    full = [tuple({**defaults, **row}.values()) for row in rows]
    return spark.createDataFrame(full, SHELF)


def test_alerts_give_a_row_per_reason_and_take_names_literally(spark):
    latest = shelf(
        spark,
        dict(position=1, brand="Puma", product_name="PEGASUS 41 x", search_keyword="Nike shoes", sponsored=True, discount_pct=15.0),
        dict(position=2, brand="Jordan", product_name="Pegasus 41", search_keyword="nike shoes", sponsored=True, discount_pct=14.9),
        dict(position=3, brand=None, product_name="pegasus_41", search_keyword="nike shoes", sponsored=True, discount_pct=50.0),
        dict(position=4, brand="Puma", product_name="p", search_keyword="nike", sponsored=None),
    )
    alerts = reports.shelf_alerts(latest)
    got = sorted((row.position, row.reason) for row in alerts.collect())
    assert got == [(1, "deep discount"), (1, "rival sponsored on your search")]
    literal = reports.shelf_alerts(latest, watched_product="pegasus_41")
    assert [row.position for row in literal.collect() if row.reason == "deep discount"] == [3]
    state = reports.evaluate_alert(alerts, F.count(F.lit(1))).first()
    assert (state.value, state.fires) == (2, True)
    assert reports.evaluate_alert(alerts.limit(0), F.count(F.lit(1))).first().fires is False


def test_counters_skip_unnamed_products_and_unknown_brands(spark):
    latest = shelf(
        spark,
        dict(brand="A", product_name="x", price=1.0, list_price=2.0),
        dict(brand="A", product_name=None, price=2.0),
        dict(brand=None, product_name="y", price=100.0),
    )
    assert tuple(reports.shelf_counters(latest).first()) == (1, 1.5, 50.0)


def test_facets_count_rows_that_pass_the_other_filters(spark):
    rng = random.Random(3)
    rows = [
        dict(retailer=rng.choice("ab"), search_keyword=rng.choice("xyz"), brand=rng.choice(["p", "q", None]))
        for _ in range(200)
    ]
    selections = {"retailer": ["a"], "search_keyword": ["x", "y"], "brand": ["p"]}
    got = {(r.facet, r["value"]): r.matching_rows for r in reports.facets(shelf(spark, *rows), selections).collect()}
    for (facet, value), count in got.items():
        others = {name: chosen for name, chosen in selections.items() if name != facet}
        assert count == sum(
            row[facet] == value and all(row[name] in chosen for name, chosen in others.items()) for row in rows
        )
    assert len(got) == 2 + 3 + 3
    everything = reports.apply_filters(shelf(spark, *rows), {"retailer": [], "brand": ["p"]})
    assert everything.count() == sum(row["brand"] == "p" for row in rows)


def test_pages_follow_each_other(spark):
    rows = [dict(retailer="r", search_keyword="k", position=n, brand="b", product_url=f"u{n:03}") for n in range(60)]
    latest, order = shelf(spark, *rows), ["retailer", "position"]
    seen, after = [], None
    while True:
        page = reports.detail_page(latest, order, after)
        found = page.collect()
        if not found:
            break
        assert "TakeOrderedAndProject" in plan_of(page)
        seen += [row.position for row in found]
        after = [found[-1][name] for name in order]
    assert seen == list(range(60))


def test_feed_compare(spark):
    feed = "retailer STRING, product_id STRING, price DOUBLE, captured_at TIMESTAMP"
    old, new, now = DAY(2025, 1, 1), DAY(2025, 1, 2), DAY(2025, 1, 3)
    vendor = spark.createDataFrame(
        [("A", "1", 100.0, new), ("A", "1", 1.0, old), ("a", "2", 100.0, new), ("A", "3", None, new), ("A", "4", 9.0, new), ("a", None, 9.0, new)],
        feed,
    )
    ours = spark.createDataFrame([("a", "1", 98.0, new), ("a", "2", 97.9, old), ("a", "3", 5.0, new)], feed)
    result = compare.feed_compare(vendor, ours, F.lit(now).cast("timestamp"))
    row = result.first()
    assert (row.vendor_products, row.found_by_us, row.coverage_pct) == (5, 3, 60.0)
    assert row.price_match_pct == 33.3
    assert (row.vendor_age_hours, row.our_age_hours) == (24.0, 32.0)
    shuffles = plan_of(result).count("Exchange hashpartitioning")
    assert shuffles <= 3


EARNINGS = "company STRING, fiscal_quarter_label STRING, quarter_end_date DATE, revenue_growth_yoy_pct DOUBLE, gross_margin_pct DOUBLE"


def earnings(spark):
    d = datetime.date
    rows = [
        ("Nike", "Q1", d(2025, 3, 31), 90.0, 10.0),
        ("NIKE", "Q2", d(2025, 6, 30), 1.0, 45.0),
        ("Puma", "Q1", d(2025, 3, 31), 5.0, 40.0),
        ("On", "Q1", d(2025, 3, 31), None, 60.0),
    ]
    return spark.createDataFrame(rows, EARNINGS)


def test_growth_and_margin_questions(spark):
    assert questions.fastest_growth(earnings(spark)).first().company == "Puma"
    brands = spark.createDataFrame([("on", "On"), ("nike", "Nike")], "company_key STRING, brand STRING")
    latest = shelf(
        spark,
        dict(retailer="amazon", brand="On", list_price=10.0, discount_pct=20.0, product_url="u1"),
        dict(retailer="amazon", brand="On", product_url="u2"),
        dict(retailer="target", brand="On", list_price=10.0, product_url="u3"),
        dict(retailer="amazon", brand="Nike", list_price=10.0, product_url="u4"),
    )
    (row,) = questions.margin_vs_discount(earnings(spark), latest, brands, "amazon").collect()
    assert (row.company, row.products, row.pct_on_sale, row.avg_discount_pct, row.product_url) == ("On", 2, 50.0, 20.0, "u1")


def test_audit_window_and_server_name(spark):
    log = spark.createDataFrame(
        [
            (DAY(2025, 1, 31, 9), datetime.date(2025, 1, 31), "mcpCall", "gateway", None, "c", "s"),
            (DAY(2025, 1, 1, 9), datetime.date(2025, 1, 1), "mcpToolInvocation", "gateway", "m", "c", "s"),
            (DAY(2024, 12, 31, 9), datetime.date(2024, 12, 31), "mcpCall", "gateway", "m", "c", "s"),
            (DAY(2025, 1, 31, 9), datetime.date(2025, 1, 31), "getSecret", "secrets", None, None, "s"),
            (DAY(2025, 1, 31, 9), datetime.date(2025, 1, 31), "getSecret", "secrets", None, None, "other"),
        ],
        "event_time TIMESTAMP, event_date DATE, action_name STRING, service_name STRING, m STRING, c STRING, scope STRING",
    ).select(
        "event_time",
        "event_date",
        "action_name",
        "service_name",
        F.struct(F.lit("u").alias("email")).alias("user_identity"),
        F.struct(
            F.lit("t").alias("tool_name"),
            F.lit("call").alias("json_rpc_method"),
            F.col("m").alias("mcp_server_name"),
            F.col("c").alias("connection_name"),
            "scope",
        ).alias("request_params"),
        F.struct(F.lit(200).alias("status_code")).alias("response"),
    )
    as_of = datetime.date(2025, 1, 31)
    calls = audit.tool_calls(log, as_of)
    assert [row.server for row in calls.collect()] == ["c", "m"]
    assert "TakeOrderedAndProject" in plan_of(calls)
    assert [tuple(row) for row in audit.key_reads(log, as_of, "s").collect()] == [(as_of, "u", 1)]
