"""Requests, fetching with an injected fetcher, and run starts."""

import json

from conftest import plan_of
from pyspark.sql import functions as F

from pricelens import schemas
from pricelens.sources import fetch, payloads, requests

SEARCHES = "retailer STRING, keyword STRING"


def searches(spark, *rows):
    return requests.expand_requests(spark.createDataFrame(list(rows), SEARCHES), requests.retailer_templates(spark))


def test_requests_name_the_parameter_of_the_retailer(spark):
    rows = searches(spark, ("amazon", 'say "hi"'), ("footlocker", "k"), ("nowhere", "k")).collect()
    got = {row.retailer: (row.template, row.params_json and json.loads(row.params_json), row.error) for row in rows}
    assert got == {
        "amazon": ("amazon_serp", {"keyword": 'say "hi"'}, None),
        "footlocker": ("footlocker_serp", {"keywords": "k"}, None),
        "nowhere": (None, None, "unknown retailer: nowhere"),
    }


def test_starter_control_table(spark):
    retailers = requests.retailer_templates(spark)
    keywords = spark.createDataFrame([(k,) for k in ["trail shoes", "road shoes"]], "keyword STRING")
    seeded = requests.seed_searches(retailers, keywords)
    assert (seeded.count(), seeded.filter("enabled").count()) == (10, 10)
    assert seeded.columns == [part.split()[0] for part in schemas.SEARCHES_DDL.split(", ")]


def test_fetch_retries_once_and_turns_failures_into_rows(spark, folder):
    def fetcher(template, params):
        import os

        keyword = params["keyword"]
        if keyword == "flaky" and not os.path.exists(f"{folder}/tried"):
            open(f"{folder}/tried", "w").close()
            raise TimeoutError("first try")
        if keyword == "broken":
            raise TimeoutError("x" * 1000)
        return {"data": {"parsing": [{"title": keyword}]}}

    wanted = searches(spark, ("amazon", "fine"), ("amazon", "flaky"), ("amazon", "broken"), ("nowhere", "k"))
    fetched = fetch.fetch(wanted, fetcher, parallelism=2, pause=0)
    got = {row.keyword: row for row in fetched.collect()}
    assert got["fine"].error is None and json.loads(got["fine"].payload)
    assert got["flaky"].error is None and got["flaky"].payload
    assert got["broken"].payload is None and got["broken"].error == "x" * 300
    assert got["k"].payload is None and got["k"].error == "unknown retailer: nowhere"
    assert "RoundRobinPartitioning(2)" in plan_of(fetched)


def test_second_pass_fetches_only_empty_results_once(spark, folder):
    def fetcher(template, params):
        import os
        import uuid

        keyword = params["keyword"]
        open(f"{folder}/{keyword}-{uuid.uuid4().hex}", "w").close()
        second = len([name for name in os.listdir(folder) if name.startswith(f"{keyword}-")]) > 1
        return {"data": {"parsing": [{"title": keyword}] if keyword == "full" or second else []}}

    wanted = searches(spark, ("amazon", "full"), ("amazon", "later"), ("nowhere", "k"))
    results = fetch.fetch_twice(wanted, fetcher, f"{folder}/payloads", pause=0)
    assert results.count() == 3
    coverage = {row.retailer: tuple(row)[1:] for row in fetch.fetch_coverage(results).collect()}
    assert coverage == {"amazon": (2, 2, 2, 0), "nowhere": (0, 1, 0, 1)}
    assert [row.search for row in fetch.empty_searches(results).collect()] == ["nowhere / k"]
    import os

    calls = sorted(name.split("-")[0] for name in os.listdir(folder) if "-" in name)
    assert calls == ["full", "later", "later"]


def test_search_requests(spark):
    df = spark.createDataFrame(
        [("q", None, None), ("q", 0, "news"), ("q", 7, "")], "query STRING, max_results INT, focus STRING"
    )
    bodies = [json.loads(row.body_json) for row in requests.search_requests(df).collect()]
    assert [(b["max_results"], b["search_depth"], b.get("focus")) for b in bodies] == [
        (5, "standard", None),
        (5, "lite", "news"),
        (7, "standard", None),
    ]
    assert all((b["country"], b["locale"], b["query"]) == ("US", "en", "q") for b in bodies)


def test_run_requests_leave_out_what_is_not_set(spark):
    df = spark.createDataFrame(
        [('a "b"\n', None, None), ("x", "high", '[{"brand":"N"}]'), ("x", "", "")],
        "input STRING, effort STRING, input_data_json STRING",
    )
    bodies = [json.loads(row.body_json) for row in requests.run_requests(df).collect()]
    assert bodies == [{"input": 'a "b"\n'}, {"input": "x", "effort": "high", "input_data": [{"brand": "N"}]}, {"input": "x"}]


def test_run_start_rows(spark):
    df = spark.createDataFrame(
        [
            (200, '{"id":"r1","status":"queued"}', None),
            (404, '{"detail":"' + "x" * 600 + '"}', None),
            (None, None, "e" * 600),
            (200, "<html>", None),
        ],
        "http_code INT, body STRING, exception STRING",
    )
    ok, refused, raised, unreadable = payloads.run_start_rows(df).collect()
    assert tuple(ok) == ("r1", "queued", None)
    assert (refused.run_id, refused.status, len(refused.error)) == (None, "http_404", 500)
    assert (raised.status, len(raised.error)) == ("error", 500)
    assert (unreadable.run_id, unreadable.status) == (None, "error")


def test_no_batch_holds_more_rows_than_asked_for(spark):
    rows = spark.range(0, 1000, 1, 3).select(F.when(F.col("id") > 300, 0).otherwise(F.col("id")).alias("n"))
    batches = requests.task_input(rows, batch_size=64).collect()
    assert max(batch.rows for batch in batches) <= 64
    held = sorted(row["n"] for batch in batches for row in json.loads(batch.input_data_json))
    assert held == sorted(row.n for row in rows.collect())


def test_tasks_name_the_company(spark):
    companies = spark.createDataFrame([(c,) for c in ["Acme", "Puma"]], "company STRING")
    tasks = {row.label: row.task for row in requests.expand_tasks(companies, 3).collect()}
    assert len(tasks) == 2 and tasks["Puma"].startswith("List the last 3 quarters of Puma, one row each")
    asked = requests.expand_tasks(companies, 2, "%s: %d quarters").orderBy("label").collect()
    assert [row.task for row in asked] == ["Acme: 2 quarters", "Puma: 2 quarters"]


def test_rows_leave_a_task_before_all_requests_are_sent(spark, folder):
    def fetcher(template, params):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return {"data": {}}

    wanted = spark.range(0, 3000, 1, 1).selectExpr("'t' AS template", "to_json(map('k', id)) AS params_json")
    fetched = fetch.fetch(wanted, fetcher, parallelism=1, pause=0, rows_at_once=4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert len(fetched.limit(1).collect()) == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    import os

    assert len(os.listdir(folder)) < 3000


def test_written_item_counts_spare_the_second_parse(spark, folder):
    rows = [("amazon", "k", "t", "{}", '{"data":{"parsing":{"entities":[{"a":1}]}}}', None), ("amazon", "l", "t", "{}", "{}", None)]
    table = spark.createDataFrame(rows, "retailer STRING, keyword STRING, template STRING, params_json STRING, payload STRING, error STRING")
    fetch.with_item_count(table).write.parquet(f"{folder}/first")
    merged = fetch.refetch_empty(spark.read.parquet(f"{folder}/first"), lambda t, p: {"data": {}}, f"{folder}/second", pause=0)
    assert "from_json" not in plan_of(merged) and merged.columns == table.columns and merged.count() == 2
