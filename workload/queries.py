"""One query per operator, each over whole tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions import brands, json_values
from pricelens.operators import dictionaries, keyed, ledger, research, shelf, spec_rules
from pricelens.plans import audit, compare, questions, reports
from pricelens.schemas import EARNINGS_SPEC, REVIEWS_BLOCKED_DOMAINS, REVIEWS_SPEC
from pricelens.session import shared_dir
from pricelens.sources import fetch, live, payloads, requests, sql_functions, table_functions, tables
from pricelens.streaming import feeds, polling, run_state, trend
from workload import services
from workload import standins as data

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RUN_AT = "2002-01-01 00:00:00"
OLD_LAYOUT_UNTIL = "2000-01-01"
FACETS = {
    "retailer": ["asia", "europe"],
    "search_keyword": ["economy", "promo"],
    "brand": ["Brand#1", "Brand#2", "Brand#3"],
}
DETAIL_ORDER = ["retailer", "search_keyword", "position", *data.ROW_KEY[:1], *data.ROW_KEY[2:]]
DETAIL_AFTER = ["america", "economy", 4, 0, 0, 0, "1990-01-01"]
BLOCKED = ["example.net", "thther.example.org"]
LOOKED_UP = ["7", "42", "133", "no such product"]
BUCKETS = 16
LEDGER_MINUTES = 2 * 24 * 60
STREAM_DELAY = "2 days"
LOG_END = "2100-01-01 00:00:00"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _run_at() -> Column:
    return F.lit(RUN_AT).cast("timestamp")


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.latest_snapshot(data.shelf_history(spark, sf_dir), at="captured_on", day="captured_on")


# Sources


@query
def enabled_searches(spark, sf_dir):
    return requests.enabled_searches(data.searches(spark, sf_dir))


@query
def keywords_per_retailer(spark, sf_dir):
    return reports.keywords_per_retailer(data.searches(spark, sf_dir))


@query
def seed_searches(spark, sf_dir):
    retailers = data.table(spark, sf_dir, "region").select(F.lower("r_name").alias("retailer"))
    names = data.table(spark, sf_dir, "part").select(F.lower("p_name").alias("keyword")).distinct()
    return requests.seed_searches(retailers, names)


@query
def expand_requests(spark, sf_dir):
    expanded = requests.expand_requests(data.searches(spark, sf_dir), requests.retailer_templates(spark))
    parameter = F.get(F.json_object_keys("params_json"), F.lit(0))
    values = F.map_values(F.from_json("params_json", "MAP<STRING, STRING>"))
    return expanded.select(
        "retailer",
        "keyword",
        "template",
        parameter.alias("parameter"),
        F.get(values, F.lit(0)).alias("value"),
        "error",
    )



def _fixture_fetcher(answered: Callable[[int], int]):
    """A fetcher without a network: the brand number in the keyword decides what comes back."""

    def fetcher(template, params):
        (keyword,) = params.values()
        number = int(keyword.split("#")[1].split()[0])
        found = answered(number)
        if found < 0:
            raise TimeoutError(f"{template} timed out on {keyword}")
        return {"data": {"parsing": {"entities": [{"title": keyword, "position": n} for n in range(found)]}}}

    return fetcher


def _requests(spark, sf_dir):
    searches = requests.enabled_searches(data.searches(spark, sf_dir))
    return requests.expand_requests(searches, requests.retailer_templates(spark))


def _fetched(results: DataFrame) -> DataFrame:
    counted = payloads.with_items(results).withColumn("items", F.size("items"))
    return counted.select("retailer", "keyword", "items", "error")


@query
def fetch_requests(spark, sf_dir):
    fetcher = _fixture_fetcher(lambda number: -1 if number % 5 == 0 else number % 5 - 1)
    return _fetched(fetch.fetch(_requests(spark, sf_dir), fetcher, parallelism=8, pause=0))


@query
def refetch_empty(spark, sf_dir):
    folder = shared_dir(spark, "refetch")
    first = _fixture_fetcher(lambda number: -1 if number % 5 == 0 else number % 5 - 1)
    second = _fixture_fetcher(lambda number: 2 if number % 10 == 0 else 0)
    answers = fetch.fetch(_requests(spark, sf_dir), first, parallelism=8, pause=0)
    fetch.with_item_count(answers).write.parquet(f"{folder}/first")
    results = spark.read.parquet(f"{folder}/first")
    return _fetched(fetch.refetch_empty(results, second, f"{folder}/second", pause=0))


@query
def fetch_coverage(spark, sf_dir):
    return fetch.fetch_coverage(data.stored(spark, sf_dir, data.payloads))


@query
def empty_searches(spark, sf_dir):
    results = data.stored(spark, sf_dir, data.payloads).withColumn("error", F.lit(None).cast("string"))
    return fetch.empty_searches(results).groupBy("search").agg(F.count(F.lit(1)).alias("times"))


@query
def unwrap_items(spark, sf_dir):
    name = F.coalesce(F.get_json_object("item", "$.title"), F.get_json_object("item", "$.product_name"))
    return payloads.unwrap_items(data.stored(spark, sf_dir, data.payloads)).select(
        *data.ROW_KEY, "retailer", "keyword", "item_index", name.alias("name")
    )


@query
def search_results(spark, sf_dir):
    return payloads.search_results(data.search_payloads(spark, sf_dir))


@query
def search_requests(spark, sf_dir):
    doc = F.col("doc_id")
    asked = data.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("query"),
        F.when(doc % 7 != 0, doc % 4).alias("max_results"),
        F.when(doc % 3 == 0, "news").when(doc % 3 == 1, "").alias("focus"),
    )
    body = requests.search_requests(asked)
    fields = ["query", "max_results", "search_depth", "country", "locale", "focus"]
    return body.select(
        "doc_id", *[F.get_json_object("body_json", f"$.{name}").alias(name) for name in fields]
    )


@query
def shelf_search(spark, sf_dir):
    return shelf.shelf_search(data.stored(spark, sf_dir, data.items).drop("keyword"))


@query
def search_shelf_function(spark, sf_dir):
    responses = data.stored(spark, sf_dir, data.payloads)
    sql_functions.register_search_shelf(spark, responses)
    searches = responses.select("retailer", "keyword").distinct()
    return spark.sql(
        """SELECT f.retailer, count(*) AS products, count(f.price) AS priced, count(f.list_price) AS listed
           FROM {searches} s, LATERAL search_shelf(s.retailer, s.keyword) f GROUP BY f.retailer""",
        searches=searches,
    )


@query
def product_page(spark, sf_dir):
    return payloads.product_page(data.product_pages(spark, sf_dir))


@query
def run_requests(spark, sf_dir):
    part = F.col("p_partkey")
    tasks = data.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit('Read "'), "p_name", F.lit('"')).alias("input"),
        F.when(part % 3 == 0, "high").when(part % 3 == 1, "").alias("effort"),
        F.when(part % 2 == 0, F.to_json(F.array(F.struct("p_brand", "p_type")))).alias("input_data_json"),
    )
    body = F.col("body_json")
    return requests.run_requests(tasks).select(
        "p_partkey",
        F.get_json_object(body, "$.input").alias("input"),
        F.get_json_object(body, "$.effort").alias("effort"),
        F.get_json_object(body, "$.input_data[0].p_brand").alias("first_brand"),
        F.array_size(F.json_object_keys(body)).alias("fields"),
    )


@query
def run_start_rows(spark, sf_dir):
    return payloads.run_start_rows(data.run_responses(spark, sf_dir))


@query
def task_input(spark, sf_dir):
    batches = requests.task_input(data.watchlist(spark, sf_dir), batch_size=50)
    row = "ARRAY<STRUCT<brand: STRING, model: STRING, category: STRING>>"
    return (
        batches.select(F.explode(F.from_json("input_data_json", row)).alias("row"))
        .groupBy("row.brand", "row.model", "row.category")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@query
def expand_tasks(spark, sf_dir):
    companies = data.table(spark, sf_dir, "customer").select(F.col("c_name").alias("company"))
    return requests.expand_tasks(companies)


@query
def search_web_function(spark, sf_dir):
    documents = data.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query"))
    asked = documents.withColumn("focus", F.when(F.col("doc_id") % 3 == 0, "news"))
    sql_functions.register_search_web(spark, data.search_payloads(spark, sf_dir).join(asked, "doc_id"))
    return spark.sql(
        """SELECT a.doc_id, f.title, length(f.description) AS snippet, f.url
           FROM {asked} a, LATERAL search_web(a.query, 1, a.focus) f""",
        asked=asked,
    )


@query
def product_page_function(spark, sf_dir):
    asin = F.concat(F.lit("B0"), F.col("p_partkey").cast("string"))
    wrapped = F.concat(F.lit('{"data":{"parsing":'), "item", F.lit("}}"))
    pages = data.product_pages(spark, sf_dir).select(asin.alias("requested_asin"), wrapped.alias("payload"))
    sql_functions.register_product_page(spark, pages)
    return spark.sql(
        """SELECT f.asin, f.price, f.review_count, f.five_star_pct
           FROM {asked} a, LATERAL product_page(a.requested_asin) f""",
        asked=pages.select("requested_asin"),
    )


@query
def start_run_function(spark, sf_dir):
    none = F.lit(None).cast("string")
    asked = data.run_responses(spark, sf_dir).select(
        F.concat(F.lit("agent_"), (F.col("o_orderkey") % 3).cast("string")).alias("agent_id"),
        F.col("o_orderkey").cast("string").alias("input"),
        none.alias("input_data_json"),
        F.when(F.col("o_orderkey") % 2 == 0, "high").alias("effort"),
        "http_code",
        "body",
        "exception",
    )
    sql_functions.register_start_run(spark, asked)
    return spark.sql(
        """SELECT a.input, f.run_id, f.status
           FROM {asked} a, LATERAL start_run(a.agent_id, a.input, a.input_data_json, a.effort) f""",
        asked=asked.select("agent_id", "input", "input_data_json", "effort"),
    )


@query
def read_run_function(spark, sf_dir):
    runs = data.stored(spark, sf_dir, data.envelopes).withColumn("agent_id", F.lit("agent"))
    sql_functions.register_read_run(spark, runs)
    return spark.sql(
        """SELECT f.run_id, f.status, f.confidence, f.item_index, json_array_length(f.source_urls) AS sources
           FROM {asked} a, LATERAL read_run(a.agent_id, a.run_id) f""",
        asked=runs.select("agent_id", "run_id"),
    )


# Live sources and functions


def _answering(number: int) -> int:
    return -1 if number % 5 == 0 else number % 5 - 1


LIVE_RETAILERS = ["amazon", "walmart", "corner shop"]


@query
def live_payloads(spark, sf_dir):
    """Three retailers of a request table, read through the data source; the others are not asked."""
    folder = shared_dir(spark, "requests")
    asked = _requests(spark, sf_dir).select("retailer", "keyword", "template", "params_json")
    asked.write.partitionBy("retailer").parquet(folder)
    live.register(spark, live.payload_source(_fixture_fetcher(_answering), pause=0))
    answers = spark.read.format("shelf_payloads").load(folder).filter(F.col("retailer").isin(LIVE_RETAILERS))
    return _fetched(answers)


def _run_ids(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey")
    return data.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("agent_"), (key % 3).cast("string")).alias("agent_id"),
        F.concat(F.lit("run_"), key.cast("string")).alias("run_id"),
    )


@query
def live_run_results(spark, sf_dir):
    """One agent's results, read through the data source."""
    folder = shared_dir(spark, "run_ids")
    _run_ids(spark, sf_dir).write.partitionBy("agent_id").parquet(folder)
    live.register(spark, live.run_source(services.read_run))
    answers = spark.read.format("run_results").load(folder).filter("agent_id = 'agent_1'")
    rows = research.run_result(answers.select("run_id", "status", "envelope", "error"))
    return rows.select("run_id", "status", "confidence", "item_index", "error")


@query
def fetch_payload_function(spark, sf_dir):
    """Searches sent by a table function in the query, and its written answers read by the typed SQL function."""
    folder = shared_dir(spark, "responses")
    table_functions.register_fetch_payload(spark, _fixture_fetcher(_answering))
    asked = _requests(spark, sf_dir).filter("template IS NOT NULL").select("retailer", "keyword", "template", "params_json")
    responses = spark.sql("SELECT retailer, keyword, payload FROM fetch_payload(TABLE({asked}))", asked=asked)
    responses.write.parquet(folder)
    sql_functions.register_search_shelf(spark, spark.read.parquet(folder))
    return spark.sql(
        """SELECT s.retailer, s.keyword, count(*) AS products, max(f.position) AS last
           FROM {asked} s, LATERAL search_shelf(s.retailer, s.keyword) f GROUP BY s.retailer, s.keyword""",
        asked=asked,
    )


@query
def fetch_web_function(spark, sf_dir):
    table_functions.register_fetch_web(spark, services.search_web)
    asked = data.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("query"), (F.col("doc_id") % 4).alias("max_results"), F.lit(None).cast("string").alias("focus")
    )
    answers = spark.sql(
        "SELECT doc_id, payload FROM fetch_web(TABLE({asked}))", asked=requests.search_requests(asked).select("doc_id", "body_json")
    )
    return payloads.search_results(answers)


@query
def post_run_function(spark, sf_dir):
    table_functions.register_post_run(spark, services.post_run)
    tasks = data.table(spark, sf_dir, "orders").select(
        F.lit("agent").alias("agent_id"),
        F.col("o_orderkey").cast("string").alias("input"),
        F.lit(None).cast("string").alias("effort"),
        F.lit(None).cast("string").alias("input_data_json"),
    )
    asked = requests.run_requests(tasks).select("agent_id", "input", "body_json")
    return payloads.run_start_rows(
        spark.sql("SELECT input, http_code, body, exception FROM post_run(TABLE({asked}))", asked=asked)
    ).drop("error")


@query
def fetch_run_function(spark, sf_dir):
    table_functions.register_fetch_run(spark, services.read_run)
    answers = spark.sql("SELECT run_id, status, envelope FROM fetch_run(TABLE({asked}))", asked=_run_ids(spark, sf_dir))
    return research.run_result(answers).select("run_id", "status", "confidence", "item_index")


# Sinks


def _table_name(spark) -> str:
    return f"pricelens_{uuid.uuid4().hex}"


@query
def seed_watchlist(spark, sf_dir):
    """Seeded once: the second start finds the table and keeps it. The starter rows are a short list in
    real life; here they are one brand's, so that the driver holds a few rows only."""
    name, watched = _table_name(spark), data.watchlist(spark, sf_dir)
    starters = [tuple(row) for row in watched.select("brand", "category").distinct().orderBy("brand").collect()]
    tables.seed_table(spark, name, starters, "brand STRING, category STRING", "brands to watch")
    seeded = tables.seed_table(spark, name, [("other", "x")], "brand STRING, category STRING")
    return watched.join(seeded, ["brand", "category"]).groupBy("brand").agg(F.count(F.lit(1)).alias("models"))


@query
def create_earnings_table(spark, sf_dir):
    """Created empty, filled, found again with its rows, its comment and its partition column."""
    name, rows = _table_name(spark), data.earnings_candidates(spark, sf_dir)
    ddl = "company STRING, fiscal_quarter_label STRING, revenue_millions DOUBLE, run_id STRING"
    tables.create_table(spark, name, ddl, "earnings by company", ["run_id"])
    rows.select("company", "fiscal_quarter_label", "revenue_millions", "run_id").write.insertInto(name)
    kept = tables.create_table(spark, name, ddl)
    comment = spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Comment'").first().data_type
    return kept.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("comment", F.lit(comment))


@query
def appended_rows(spark, sf_dir):
    """Row counts that two appends report, with the second day's schema checked against the first's."""
    path, feed = shared_dir(spark, "appended"), data.shelf(spark, sf_dir)
    first = tables.append_snapshot(feed.filter(F.col("captured_on") < OLD_LAYOUT_UNTIL).drop("rating"), path)
    known = feed.drop("rating").schema
    second = tables.append_snapshot(feed.filter(F.col("captured_on") >= OLD_LAYOUT_UNTIL), path, history=known)
    read = tables.read_history(spark, path, feed.schema).agg(F.count(F.lit(1)).alias("rows"))
    return read.withColumns({"first": F.lit(first), "second": F.lit(second)})


@query
def append_snapshot(spark, sf_dir):
    path = shared_dir(spark, "history")
    feed = data.shelf(spark, sf_dir)
    tables.append_snapshot(feed.filter(F.col("captured_on") < OLD_LAYOUT_UNTIL).drop("rating"), path)
    tables.append_snapshot(feed.filter(F.col("captured_on") >= OLD_LAYOUT_UNTIL), path)
    return (
        tables.read_history(spark, path, feed.schema)
        .groupBy("captured_on")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("list_price").alias("on_sale"),
            F.count("rating").alias("rated"),
        )
    )


def _earnings_ties() -> list[Column]:
    return [F.col(name) for name in data.EARNINGS_TIES]


def _best_first() -> list[Column]:
    return [F.col("high_confidence_share").desc_nulls_last(), *_earnings_ties()]


@query
def dedupe_best(spark, sf_dir):
    keys = [F.lower("company"), F.col("quarter_end_date")]
    return keyed.best_per_key(data.earnings_candidates(spark, sf_dir), keys, _best_first())


@query
def upsert(spark, sf_dir):
    folder = shared_dir(spark, "earnings")
    keys = [F.lower("company"), F.col("quarter_end_date")]
    source = f"{folder}/source"
    data.earnings_candidates(spark, sf_dir).write.parquet(source)
    rows = spark.read.parquet(source)
    late = rows.filter("run_id >= '3'")
    # The second load touches one quarter of each year, the third lacks a column of the table.
    loads = [
        rows.filter("run_id < '3'"),
        late.filter("fiscal_quarter_label = 'Q3'"),
        late.filter("fiscal_quarter_label <> 'Q3'").drop("revenue_growth_yoy_pct"),
    ]
    table = None
    for number, load in enumerate(loads):
        known = None if table is None else table.schema  # so that no file is opened to learn it
        table = tables.upsert_table(
            load, f"{folder}/table", f"{folder}/staging_{number}", keys, "quarter_end_date", _best_first(), schema=known
        )
    return table


# Normalisation


def _values(spark, sf_dir):
    fields = [json_values.field(F.col("raw"), key) for key in "abc"]
    return (
        data.value_items(spark, sf_dir)
        .withColumn("raw", json_values.read_fields("item", "abc"))
        .select(*data.ROW_KEY, json_values.first_present(*fields).alias("v"))
    )


@query
def first_present(spark, sf_dir):
    return _values(spark, sf_dir).select(*data.ROW_KEY, json_values.text(F.col("v")).alias("value"))


@query
def to_number(spark, sf_dir):
    return _values(spark, sf_dir).select(*data.ROW_KEY, json_values.to_number(F.col("v")).alias("value"))


@query
def to_integer(spark, sf_dir):
    return _values(spark, sf_dir).select(*data.ROW_KEY, json_values.to_integer(F.col("v")).alias("value"))


@query
def to_boolean(spark, sf_dir):
    return _values(spark, sf_dir).select(*data.ROW_KEY, json_values.to_boolean(F.col("v")).alias("value"))


@query
def brand_of(spark, sf_dir):
    name, given, slug = data.product_words()
    url = F.concat(F.lit("https://www.amazon.com/"), slug, F.lit("/dp/B0X"))
    words = data.table(spark, sf_dir, "part").select(
        "p_partkey", name.alias("name"), given.alias("given"), url.alias("url")
    )
    return words.select(
        "p_partkey", brands.brand_of(F.col("name"), F.col("given"), F.col("url")).alias("brand")
    )


@query
def brand_by_dictionary(spark, sf_dir):
    """The known brands and one for each customer, as a table."""
    name, given, slug = data.product_words()
    url = F.concat(F.lit("https://www.amazon.com/"), slug, F.lit("/dp/B0X"))
    customers = data.table(spark, sf_dir, "customer").select(
        (F.lit(1000) + F.col("c_custkey")).cast("int").alias("entry"),
        F.col("c_name").alias("brand"),
        F.lit("words").alias("kind"),
        F.lower("c_name").alias("phrase"),
    )
    entries = dictionaries.brand_dictionary(spark).unionByName(customers)
    rows = data.table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), given.alias("given"), url.alias("url"))
    return dictionaries.with_brand(rows, F.col("name"), F.col("given"), F.col("url"), entries).select("p_partkey", "brand")


@query
def normalise_shelf(spark, sf_dir):
    items = payloads.unwrap_items(data.stored(spark, sf_dir, data.payloads)).drop("item_index")
    feed = shelf.normalise_shelf(items, _run_at())
    return feed.withColumn("captured_at", F.date_format("captured_at", "yyyy-MM-dd"))


@query
def type_research_rows(spark, sf_dir):
    rows = research.run_result(data.stored(spark, sf_dir, data.envelopes))
    typed = research.type_earnings(rows, _run_at())
    return typed.select(
        "run_id",
        "company",
        "fiscal_quarter_label",
        "revenue_millions",
        "gross_margin_pct",
        "quarter_end_date",
        "run_confidence",
        F.size("source_urls").alias("sources"),
    )


@query
def type_review_rows(spark, sf_dir):
    typed = research.type_reviews(data.review_items(spark, sf_dir), _run_at())
    return typed.select(
        "run_id",
        "brand",
        "model",
        "rating",
        "review_count",
        F.array_join("top_praise", "|").alias("top_praise"),
        F.size("top_complaints").alias("complaints"),
    )


# Research


@query
def run_result(spark, sf_dir):
    return research.run_result(data.stored(spark, sf_dir, data.envelopes)).select(
        "run_id",
        "status",
        "confidence",
        "item_index",
        F.get_json_object("item_json", "$.company").alias("company"),
        F.array_join("source_urls", "|").alias("sources"),
        "high_confidence_share",
        F.json_array_length("claims_json").alias("claims"),
    )


@query
def validate_rows(spark, sf_dir):
    rows = research.run_result(data.stored(spark, sf_dir, data.envelopes)).filter("item_index IS NOT NULL")
    return research.validate_rows(rows, EARNINGS_SPEC).select(
        "run_id", "item_index", F.array_join("violations", "; ").alias("violations")
    )


@query
def validate_reviews(spark, sf_dir):
    return research.validate_rows(data.review_items(spark, sf_dir), REVIEWS_SPEC).select(
        "run_id", F.array_join("violations", "; ").alias("violations")
    )


def _specs(spark) -> DataFrame:
    """Both specifications in a table, as the JSON text an agent's file holds."""
    path = shared_dir(spark, "specs")
    texts = []
    for name, spec in (("earnings", EARNINGS_SPEC), ("reviews", REVIEWS_SPEC)):
        properties = {field: {"type": types} for field, types in spec["types"].items()}
        row = {"type": "object", "required": spec["required"], "properties": properties}
        texts.append((name, json.dumps({"output_schema": {"type": "array", "items": row}})))
    spark.createDataFrame(texts, "name STRING, spec STRING").write.parquet(path)
    return spark.read.parquet(path)


@query
def validate_rows_by_spec(spark, sf_dir):
    rows = research.run_result(data.stored(spark, sf_dir, data.envelopes)).filter("item_index IS NOT NULL")
    return spec_rules.validate_by_spec(rows, _specs(spark), "earnings").select(
        "run_id", "item_index", F.array_join("violations", "; ").alias("violations")
    )


@query
def validate_reviews_by_spec(spark, sf_dir):
    return spec_rules.validate_by_spec(data.review_items(spark, sf_dir), _specs(spark), "reviews").select(
        "run_id", F.array_join("violations", "; ").alias("violations")
    )


@query
def claim_match(spark, sf_dir):
    return research.claim_match(data.claims(spark, sf_dir))


@query
def row_sources(spark, sf_dir):
    return research.row_sources(data.claims(spark, sf_dir))


@query
def high_confidence_share(spark, sf_dir):
    return research.high_confidence_share(data.claims(spark, sf_dir))


@query
def run_ledger(spark, sf_dir):
    events = data.run_events(data.table(spark, sf_dir, "events"))
    return ledger.run_ledger(events, LEDGER_MINUTES)


@query
def not_completed_runs(spark, sf_dir):
    events = data.run_events(data.table(spark, sf_dir, "events"))
    return ledger.not_completed(ledger.run_ledger(events, LEDGER_MINUTES)).select("label", "state")


@query
def completed_runs(spark, sf_dir):
    events = data.run_events(data.table(spark, sf_dir, "events"))
    return ledger.completed(ledger.run_ledger(events, LEDGER_MINUTES)).select("label", "run_id")


@query
def blocked_review_sources(spark, sf_dir):
    """Every page, and the same page below a domain that reviews must not cite."""
    page = F.col("page_id")
    host = F.when(page % 3 == 0, REVIEWS_BLOCKED_DOMAINS[0]).when(page % 3 == 1, f"www.{REVIEWS_BLOCKED_DOMAINS[1]}")
    url = F.coalesce(F.concat(F.lit("https://"), host, F.lit("/p")), F.col("url"))
    pages = data.table(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    return research.flag_blocked_sources(pages, "url", REVIEWS_BLOCKED_DOMAINS)


@query
def blocked_sources(spark, sf_dir):
    pages = data.table(spark, sf_dir, "pages").select("page_id", "url")
    return research.flag_blocked_sources(pages, "url", BLOCKED)


@query
def blocked_by_domain_table(spark, sf_dir):
    """Domains as a table: those to block, and one for each order."""
    more = data.table(spark, sf_dir, "orders").select(F.format_string("site%d.example.com", F.col("o_orderkey")).alias("domain"))
    domains = spark.createDataFrame([(d,) for d in BLOCKED], "domain STRING").unionByName(more)
    pages = data.table(spark, sf_dir, "pages").select("page_id", "url")
    return dictionaries.with_blocked(pages, "url", domains)


# Reports


@query
def latest_snapshot(spark, sf_dir):
    return _latest(spark, sf_dir).drop("captured_at")


@query
def latest_snapshot_per_retailer(spark, sf_dir):
    newest = keyed.latest_snapshot(data.shelf_history(spark, sf_dir), at="captured_on", per="retailer")
    return newest.groupBy("retailer", "captured_on").agg(F.count(F.lit(1)).alias("products"))


@query
def latest_per_key(spark, sf_dir):
    latest = keyed.latest_per_key(
        data.shelf(spark, sf_dir), ["retailer", "product_id"], "captured_at", data.tie_break()
    )
    return latest.select("retailer", "product_id", "price", "captured_on", *data.ROW_KEY)


@query
def brand_scoreboard(spark, sf_dir):
    return reports.brand_scoreboard(_latest(spark, sf_dir), data.BRANDS)


@query
def shelf_counters(spark, sf_dir):
    return reports.shelf_counters(_latest(spark, sf_dir))


@query
def price_by_brand_retailer(spark, sf_dir):
    return reports.price_by_brand_retailer(_latest(spark, sf_dir))


@query
def sponsored_by_brand(spark, sf_dir):
    return reports.sponsored_by_brand(_latest(spark, sf_dir))


@query
def discount_by_brand(spark, sf_dir):
    return reports.discount_by_brand(_latest(spark, sf_dir))


@query
def price_trend(spark, sf_dir):
    return reports.price_trend(data.shelf(spark, sf_dir), F.to_date("captured_at"), data.BRANDS)


@query
def facets(spark, sf_dir):
    return reports.facets(_latest(spark, sf_dir), FACETS)


@query
def filtered_shelf(spark, sf_dir):
    rows = reports.apply_filters(_latest(spark, sf_dir), {**FACETS, "brand": []})
    return rows.select("retailer", "search_keyword", "brand", "product_name", *data.ROW_KEY)


@query
def detail_page(spark, sf_dir):
    return reports.detail_page(_latest(spark, sf_dir), DETAIL_ORDER, DETAIL_AFTER)


def _alerts(latest: DataFrame) -> DataFrame:
    return reports.shelf_alerts(
        latest.withColumn("search_keyword", F.concat_ws(" ", F.lower("brand"), "search_keyword")),
        your_brand=data.OWN_BRAND,
        sub_brands=[data.SUB_BRAND],
        watched_product=data.WATCHED,
        discount_pct=5,
        extra=data.ROW_KEY,
    )


@query
def shelf_alerts(spark, sf_dir):
    return _alerts(_latest(spark, sf_dir)).drop("captured_at")


@query
def alert_state(spark, sf_dir):
    return reports.evaluate_alert(_alerts(_latest(spark, sf_dir)), F.count(F.lit(1)), ">", 0)


@query
def feed_compare(spark, sf_dir):
    feed = data.shelf(spark, sf_dir)
    vendor = feed.filter("position <= 3").withColumn("retailer", F.upper("retailer"))
    ours = feed.filter("position >= 3")
    return compare.feed_compare(
        vendor, ours, F.lit(data.AS_OF).cast("timestamp"), tie_break=data.tie_break()
    )


@query
def feed_compare_bucketed(spark, sf_dir):
    """The comparison over tables bucketed by its keys, which are not shuffled."""
    feed = data.shelf(spark, sf_dir)
    names = [_table_name(spark) for _ in range(2)]
    vendor = compare.with_keys(feed.filter("position <= 3").withColumn("retailer", F.upper("retailer")))
    vendor, ours = (
        tables.save_bucketed(rows, name, compare.KEYS, BUCKETS) for rows, name in zip((vendor, feed.filter("position >= 3")), names)
    )
    return compare.feed_compare(vendor, ours, F.lit(data.AS_OF).cast("timestamp"), tie_break=data.tie_break(), keyed=True)


@query
def product_lookup(spark, sf_dir):
    """All snapshots of a few products, from files that are sorted by product and have Bloom filters."""
    feed, path = data.shelf(spark, sf_dir, by_day=True), shared_dir(spark, "lookup_history")
    tables.append_snapshot(feed, path, look_up_by=["product_id"], row_group_bytes=1 << 20, dealt=True)
    history = tables.read_history(spark, path, feed.schema)
    return history.filter(F.col("product_id").isin(LOOKED_UP)).select("product_id", "retailer", "price", "captured_on", *data.ROW_KEY)


# Runs and questions


@query
def latest_run(spark, sf_dir):
    return keyed.latest_run(data.reviews(spark, sf_dir)).select(
        "brand", "model", "rating", "run_id", "loaded_at"
    )


@query
def latest_run_per_product(spark, sf_dir):
    rows = keyed.latest_run_per_key(data.reviews(spark, sf_dir), ["brand", "model"])
    return rows.select("brand", "model", "rating", "run_id", "loaded_at")


@query
def q_fastest_growth(spark, sf_dir):
    return questions.fastest_growth(data.earnings_candidates(spark, sf_dir), _earnings_ties())


@query
def q_well_rated(spark, sf_dir):
    return questions.well_rated(data.watchlist(spark, sf_dir), data.reviews(spark, sf_dir))


@query
def q_most_on_sale(spark, sf_dir):
    return questions.most_on_sale(_latest(spark, sf_dir), data.OWN_BRAND)


@query
def q_margin_vs_discount(spark, sf_dir):
    brand = F.concat(F.lit("Brand#"), (F.col("n_nationkey") % 25 + 1).cast("string"))
    company_brands = data.table(spark, sf_dir, "nation").select(
        F.lower("n_name").alias("company_key"), brand.alias("brand")
    )
    return questions.margin_vs_discount(
        data.earnings_candidates(spark, sf_dir),
        _latest(spark, sf_dir),
        company_brands,
        "asia",
        _earnings_ties(),
    )


@query
def earnings_listing(spark, sf_dir):
    earnings = data.earnings_candidates(spark, sf_dir).withColumns(
        {"currency": F.lit("USD"), "source_url": F.lit(None).cast("string")}
    )
    return questions.earnings_listing(earnings)


@query
def reviews_latest_run(spark, sf_dir):
    rows = questions.reviews_of_latest_run(data.reviews(spark, sf_dir))
    return rows.withColumns(
        {name: F.array_join(name, "|") for name in ("top_praise", "top_complaints")}
    )


# Audit


@query
def tool_calls(spark, sf_dir):
    return audit.tool_calls(
        data.access_log(spark, sf_dir),
        data.AUDIT_DAY,
        data.AUDIT_DAYS,
        data.AUDIT_ACTIONS,
        tie_break=[F.col("event_id")],
    )


@query
def key_reads(spark, sf_dir):
    return audit.key_reads(
        data.access_log(spark, sf_dir), data.AUDIT_DAY, data.AUDIT_SCOPE, data.AUDIT_DAYS, action="error"
    )


# Streams


@query
def stream_snapshots(spark, sf_dir):
    folder = shared_dir(spark, "stream_snapshots")
    arriving = data.payloads(spark, sf_dir, data.stream(spark, sf_dir, "lineitem"))
    rows = feeds.shelf_stream(arriving, _run_at())
    for _ in range(2):  # the second start finds nothing new and adds nothing
        feeds.append_stream(rows, f"{folder}/rows", f"{folder}/checkpoint", "retailer").awaitTermination()
    return (
        spark.read.parquet(f"{folder}/rows")
        .groupBy("retailer", "brand")
        .agg(
            F.count(F.lit(1)).alias("products"),
            F.count("list_price").alias("on_sale"),
            F.count_if("sponsored").alias("sponsored"),
            F.sum("review_count").alias("reviews"),
        )
    )


@query
def stream_alerts(spark, sf_dir):
    folder = shared_dir(spark, "stream_alerts")
    arriving = data.shelf(spark, sf_dir, data.stream(spark, sf_dir, "lineitem"))
    for _ in range(2):
        feeds.alert_stream(
            arriving, f"{folder}/alerts", f"{folder}/checkpoint", _alerts
        ).awaitTermination()
    alerts = spark.read.parquet(f"{folder}/alerts")
    return alerts.groupBy("reason", "retailer").agg(F.count(F.lit(1)).alias("alerts"))


@query
def stream_dedupe(spark, sf_dir):
    folder = shared_dir(spark, "stream_dedupe")
    results = data.stream(spark, sf_dir, "events").select(
        "event_type",
        F.get_json_object("props", "$.k").alias("keyword"),
        F.col("ts").cast("timestamp").alias("at"),
    )
    first = feeds.first_results(results, ["event_type", "keyword"], "at", "60 days")
    feeds.append_stream(
        first.select("event_type", "keyword"), f"{folder}/rows", f"{folder}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


@query
def stream_ledger(spark, sf_dir):
    """The stream's own rows. A first start leaves labels open, then the log ends and a second one closes them."""
    folder = shared_dir(spark, "stream_ledger")
    clock = run_state.clock_rows(spark, LOG_END)
    clock.limit(0).write.parquet(f"{folder}/clock")
    ending = spark.readStream.schema(clock.schema).parquet(f"{folder}/clock")
    events = data.run_events(data.stream(spark, sf_dir, "events")).unionByName(ending)
    for _ in range(2):
        ledger_rows = run_state.ledger_stream(events, STREAM_DELAY, LEDGER_MINUTES)
        feeds.append_stream(ledger_rows, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
        clock.write.mode("append").parquet(f"{folder}/clock")
    return spark.read.schema(run_state.LEDGER).parquet(f"{folder}/rows")


@query
def poll_ledger(spark, sf_dir):
    """The ledger from a service's status logs instead of a table. The second start finds a log that has come since
    and asks the others for nothing."""
    folder = shared_dir(spark, "poll_ledger")
    events = data.run_events(data.table(spark, sf_dir, "events"))
    in_logs = events.withColumn("log", F.pmod(F.xxhash64("label"), F.lit(8)))
    in_logs.write.partitionBy("log").parquet(f"{folder}/logs")
    polling.register(spark, polling.status_source(services.FileLogs(f"{folder}/logs")))
    arriving = spark.readStream.format("run_status").load()
    for _ in range(2):
        ledger_rows = run_state.ledger_stream(arriving, STREAM_DELAY, LEDGER_MINUTES)
        polled = polling.follow(ledger_rows, f"{folder}/rows", f"{folder}/checkpoint", every="0 seconds")
        try:
            polled.processAllAvailable()
        finally:
            polled.stop()
        run_state.clock_rows(spark, LOG_END).withColumn("log", F.lit("end")).write.mode("append").partitionBy("log").parquet(f"{folder}/logs")
    return spark.read.schema(run_state.LEDGER).parquet(f"{folder}/rows")


def _trend_in_two_halves(spark, sf_dir) -> str:
    """The shelf arrives in two halves, so most of the second one is late."""
    folder = shared_dir(spark, "stream_price_trend")
    lines = data.table(spark, sf_dir, "lineitem")
    for half in range(2):
        lines.filter(F.col("l_orderkey") % 2 == half).write.mode("append").parquet(f"{folder}/lines")
        arriving = data.shelf(spark, sf_dir, spark.readStream.schema(lines.schema).parquet(f"{folder}/lines"))
        trend.trend_stream(
            arriving, "captured_at", f"{folder}/trend", f"{folder}/checkpoint", STREAM_DELAY, data.BRANDS
        ).awaitTermination()
    return f"{folder}/trend"


@query
def stream_price_trend(spark, sf_dir):
    return trend.corrected_trend(spark, _trend_in_two_halves(spark, sf_dir))


@query
def stream_late_rows(spark, sf_dir):
    rows = trend.late_rows(spark, _trend_in_two_halves(spark, sf_dir), "brand STRING, captured_at TIMESTAMP, l_orderkey BIGINT")
    return rows.groupBy("brand", F.to_date("captured_at").alias("day")).agg(F.count(F.lit(1)).alias("rows"))
