"""The two readings of shelf items, brands and unwrapping."""

import json

from conftest import plan_of
from pyspark.sql import functions as F

from pricelens.functions.brands import brand_of
from pricelens.functions import brands
from pricelens.operators.shelf import normalise_shelf, shelf_search
from pricelens.sources import payloads


def now():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


def normalised(spark, cases):
    """Feed rows of ``[(retailer, item), ...]`` in order."""
    rows = [(i, retailer, "shoes", json.dumps(item)) for i, (retailer, item) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i INT, retailer STRING, keyword STRING, item STRING")
    return normalise_shelf(df, now()).orderBy("i").collect()


def searched(spark, cases):
    """Live-search rows of ``[(retailer, item), ...]`` in order."""
    rows = [(i, retailer, json.dumps(item)) for i, (retailer, item) in enumerate(cases)]
    return shelf_search(spark.createDataFrame(rows, "i INT, retailer STRING, item STRING")).orderBy("i").collect()


BRANDS = [
    ("Nike Air Jordan 1", None, None, "Jordan"),
    ("Air Zoom Pegasus", "nike", None, "Nike"),
    ("Mens Shoe", None, "https://www.amazon.com/Under-Armour-Charged/dp/B0X", "Under Armour"),
    ("On Cloudmonster 2", None, None, "On"),
    ("Come on Running", None, None, "On"),
    ("Shoe on sale", None, None, None),
    ("Shoe", "Men's", None, None),
    ("Shoe", " Altra ", None, "Altra"),
    ("Shoe", "   ", None, ""),
    ("Shoe", "", None, None),
    ("On", None, None, "On"),
    ("on-ly", None, None, "On"),
    ("éon cloud", None, None, None),
    ("Shoe", "new-balance", None, "New Balance"),
    ("Shoe", None, "https://www.amazon.com/on-shoe/dp/B0X", None),
    ("Shoe", None, "https://www.other.com/nike-shoe/dp/B0X", None),
    (None, None, None, None),
]


def test_brand_of(spark):
    rows = [(i, *case[:3]) for i, case in enumerate(BRANDS)]
    df = spark.createDataFrame(rows, "i INT, name STRING, given STRING, url STRING")
    brand = brand_of(F.col("name"), F.col("given"), F.col("url")).alias("brand")
    assert [row.brand for row in df.select("i", brand).orderBy("i").collect()] == [case[3] for case in BRANDS]


def test_sale_rule(spark):
    cases = [(80, 100, 100.0, 20.0), (100, 100, None, None), (120, 100, None, None), (None, 100, 100.0, None), (0, 100, 100.0, None)]
    rows = normalised(spark, [("amazon", {"price": price, "original_price": listed}) for price, listed, _, _ in cases])
    assert [(row.list_price, row.discount_pct) for row in rows] == [case[2:] for case in cases]


def test_in_stock(spark):
    cases = [
        ("walmart", {"product_out_of_stock": False}, True),
        ("walmart", {"product_out_of_stock": True}, False),
        ("walmart", {"product_out_of_stock": None}, True),
        ("walmart", {}, None),
        ("target", {"availability": "in_stock"}, True),
        ("target", {"availability": "OUT"}, False),
        ("target", {"availability": ""}, None),
        ("target", {"availability": 0}, None),
        ("amazon", {"availability": "IN_STOCK", "product_out_of_stock": False}, None),
    ]
    rows = normalised(spark, [case[:2] for case in cases])
    assert [row.in_stock for row in rows] == [case[2] for case in cases]


def test_product_ids_and_fallback_urls(spark):
    cases = [
        ("footlocker", {"tcin": "A1"}, "A1", "https://www.footlocker.com/product/~/A1.html"),
        ("footlocker", {"tcin": "A1", "url": "u"}, "A1", "u"),
        ("footlocker", {"product_id": 0}, "0", None),
        ("amazon", {"asin": "A1"}, "A1", None),
        ("target", {"tcin": 123}, "123", None),
    ]
    rows = normalised(spark, [case[:2] for case in cases])
    assert [(row.product_id, row.product_url) for row in rows] == [case[2:] for case in cases]


# One line of the flavour table each: item, column, feed value, live-search value.
FLAVOURS = [
    ({"price": "", "product_price": "9.5"}, "price", 9.5, None),
    ({"title": "T"}, "product_name", "T", None),
    ({"url": "U"}, "product_url", "U", None),
    ({"brand": "Zed"}, "brand", "Zed", None),
    ({"price": 5, "list_price": "10"}, "list_price", 10.0, None),
    ({"item_stack_position": 3}, "position", 3, None),
    ({"price": 10, "original_price": 8}, "list_price", None, 8.0),
    ({"review_count": "4.0"}, "review_count", 4, 40),
    ({"position": "4.0"}, "position", 4, None),
    ({"position": 4.0}, "position", 4, None),
    ({"sponsored": "Sponsored"}, "sponsored", False, None),
    ({"price": -5}, "price", -5.0, 5.0),
    ({"product_brand": "NIKE"}, "brand", "Nike", "NIKE"),
]


def test_the_two_readings_differ(spark):
    cases = [("amazon", case[0]) for case in FLAVOURS]
    columns = [case[1] for case in FLAVOURS]
    feed = [row[column] for row, column in zip(normalised(spark, cases), columns)]
    live = [row[column] for row, column in zip(searched(spark, cases), columns)]
    assert list(zip(feed, live)) == [case[2:] for case in FLAVOURS]


def test_live_search_echoes_the_retailer(spark):
    (row,) = searched(spark, [("FootLocker", {"product_id": "A1", "asin": "B1"})])
    assert (row.retailer, row.product_id) == ("FootLocker", "B1")
    assert row.product_url == "https://www.footlocker.com/product/~/A1.html"


PAYLOADS = [
    ('{"data":{"parsing":{"entities":3,"products":[{"x":1}]}}}', ['{"x":1}']),
    ('{"data":{"parsing":{"entities":[],"products":[{"x":1}]}}}', []),
    ('{"data":{"parsing":{"a":1}}}', ['{"a":1}']),
    ('{"data":{"parsing":[{"x":1},{"y":2}]}}', ['{"x":1}', '{"y":2}']),
    ('{"data":{"parsing":{}}}', ["{}"]),
    ('{"data":{"parsing":"text"}}', []),
    ('{"data":{}}', []),
    ('{"data":null}', []),
    ('{"data":{"parsing":[{"x":1},3,"t",null,[1]]}}', ['{"x":1}']),
    (' {"data":{"parsing":{"items":[{"p":4.0,"p":5.0}]}}}', ['{"p":4.0,"p":5.0}']),
    ("gateway timeout", []),
    ("", []),
    (None, []),
]


def test_unwrap_items(spark):
    df = spark.createDataFrame([(i, case[0]) for i, case in enumerate(PAYLOADS)], "id INT, payload STRING")
    found = {i: [] for i in range(len(PAYLOADS))}
    for row in payloads.unwrap_items(df).orderBy("id", "item_index").collect():
        found[row.id].append(row.item)
    assert list(found.values()) == [case[1] for case in PAYLOADS]


def test_malformed_item_gives_nulls(spark):
    df = spark.createDataFrame([("amazon", "k", "{broken")], "retailer STRING, keyword STRING, item STRING")
    row = normalise_shelf(df, now()).first()
    assert row.product_name is None and row.price is None and row.retailer == "amazon"


def test_search_results(spark):
    hits = [
        {"title": "a", "description": "d" * 400, "url": "u", "content": ""},
        {"title": "b", "content": "c"},
    ]
    df = spark.createDataFrame([(json.dumps({"results": hits}),), ("no json",)], "payload STRING")
    first, second = payloads.search_results(df).orderBy("result_index").collect()
    assert (len(first.description), first.content) == (300, "d" * 400)
    assert (second.description, second.content, second.url) == ("", "c", None)


def test_normalising_is_native(spark):
    """No Python, no shuffle, and each item parsed once as text and once with types."""
    df = spark.createDataFrame([("amazon", "k", "{}")], "retailer STRING, keyword STRING, item STRING")
    plan = plan_of(normalise_shelf(df, now()))
    assert "Python" not in plan and "Exchange" not in plan
    assert plan.count("from_json") == 2


def test_unwrapping_parses_the_usual_shape_once(spark, folder):
    """The list size must not come back as a filter at the scan with the parsing inside."""
    spark.createDataFrame([("{}",)], "payload STRING").write.parquet(f"{folder}/payloads")
    plan = plan_of(payloads.unwrap_items(spark.read.parquet(f"{folder}/payloads")))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "from_json" not in scan
    assert plan.count("from_json") == 3


def test_patterns_of_plain_words_are_searched_for_before_they_are_matched(spark):
    names = ["nike", "snikers", "On", "salmon on toast", "on-board", "new-balance", "x new-balance", "axxb", "ab", "q(c"]
    patterns = [*brands.BRAND_PATTERNS, ("X", r"ax+b"), ("Q", r"q\(c|zz")]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    none = F.lit(None).cast("string")
    got = [r[0] for r in df.select(brands.brand_of(F.col("n"), none, none, patterns)).collect()]
    assert got == ["Nike", None, "On", None, "On", "New Balance", None, "X", None, "Q"]
    assert brands._words_of(r"\bon cloud|^on-|^on$") == ["on cloud", "on-", "on"]
    assert not brands._words_of(r"ax+b") and not brands._words_of(r"\bnike\b|q\(c")
