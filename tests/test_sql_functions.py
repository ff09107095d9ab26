"""The operators as SQL table functions."""

import json

from conftest import plan_of

from pricelens.sources import sql_functions as sql


def rows(df):
    return [tuple(row) for row in df.collect()]


def test_search_web_has_defaults(spark):
    hits = [{"title": f"t{n}", "url": "u"} for n in range(8)]
    payload = json.dumps({"results": hits})
    table = [("q", None, payload), ("q", "news", payload)]
    sql.register_search_web(spark, spark.createDataFrame(table, "query STRING, focus STRING, payload STRING"))
    assert len(rows(spark.sql("SELECT * FROM search_web('q')"))) == 5
    assert len(rows(spark.sql("SELECT * FROM search_web('q', max_results => 7, focus => 'news')"))) == 7
    assert len(rows(spark.sql("SELECT * FROM search_web('q', 0)"))) == 5
    assert rows(spark.sql("SELECT * FROM search_web('other')")) == []


def test_search_shelf_filters_the_payload_table(spark, folder):
    payload = json.dumps({"data": {"parsing": {"entities": [{"product_name": "Shoe", "price": "$5", "product_id": "A"}]}}})
    table = spark.createDataFrame(
        [("footlocker", "shoes", payload), ("amazon", "shoes", payload)], "retailer STRING, keyword STRING, payload STRING"
    )
    table.write.partitionBy("retailer").parquet(f"{folder}/payloads")
    sql.register_search_shelf(spark, spark.read.parquet(f"{folder}/payloads"))
    one = spark.sql("SELECT retailer, product_name, price, product_url FROM search_shelf('FootLocker', 'shoes')")
    assert rows(one) == [("footlocker", "Shoe", 5.0, "https://www.footlocker.com/product/~/A.html")]
    scan = next(line for line in plan_of(one).splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(retailer" in scan
    table.select("retailer", "keyword").createOrReplaceTempView("wanted")
    joined = spark.sql("SELECT w.retailer, f.price FROM wanted w, LATERAL search_shelf(w.retailer, w.keyword) f")
    assert sorted(rows(joined)) == [("amazon", 5.0), ("footlocker", 5.0)]
    assert "NestedLoop" not in plan_of(joined)


def test_product_page(spark):
    item = {"asin": "B1", "web_price": 9.5, "number_of_reviews": "12", "review_mentions_with_positive_sentiment": ["fit", "grip"]}
    payload = json.dumps({"data": {"parsing": item}})
    sql.register_product_page(spark, spark.createDataFrame([("B1", payload)], "requested_asin STRING, payload STRING"))
    found = spark.sql("SELECT asin, price, review_count, positive_mentions FROM product_page('B1')")
    assert rows(found) == [("B1", 9.5, 12, "fit, grip")]


def test_runs(spark):
    started = spark.createDataFrame(
        [("a", "task", None, "high", 200, '{"id":"r1","status":"queued"}', None)],
        "agent_id STRING, input STRING, input_data_json STRING, effort STRING, http_code INT, body STRING, exception STRING",
    )
    sql.register_start_run(spark, started)
    assert rows(spark.sql("SELECT * FROM start_run('a', 'task', effort => 'high')")) == [("r1", "queued", None)]
    envelope = {"output": {"content": [{"n": 1}], "trust": {"confidence": "high", "claims": [{"path": "$[0]", "citations": [{"url": "u"}]}]}}}
    runs = spark.createDataFrame(
        [("a", "r1", "completed", json.dumps(envelope)), ("a", "r2", "running", None)],
        "agent_id STRING, run_id STRING, status STRING, envelope STRING",
    )
    sql.register_read_run(spark, runs)
    assert rows(spark.sql("SELECT * FROM read_run('a', 'r1')")) == [
        ("r1", "completed", "high", 0, '{"n":1}', '["u"]')
    ]
    assert rows(spark.sql("SELECT * FROM read_run('a', 'r2')")) == [("r2", "running", None, None, None, None)]
