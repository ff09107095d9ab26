"""Table functions for SQL users, over tables of what was fetched.

The functions keep names, defaults and typed columns of a live call, but read payload tables instead
of the network. Their arguments become filters on those tables, so a table partitioned by retailer
or run is read in part only. In a LATERAL join they become an ordinary join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.operators.research import run_result
from pricelens.operators.shelf import shelf_search
from pricelens.sources.payloads import product_page, run_start_rows, search_results, unwrap_items


def register_search_web(spark: SparkSession, responses: DataFrame) -> None:
    """``search_web(query, max_results, focus)`` over ``query``, ``focus`` and ``payload``."""
    search_results(responses).createOrReplaceTempView("search_web_hits")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION search_web(
            query STRING COMMENT 'search text as it was sent',
            max_results INT DEFAULT 5 COMMENT 'at most so many hits',
            focus STRING DEFAULT NULL COMMENT 'focus the search was sent with')
        RETURNS TABLE (title STRING, description STRING, url STRING, content STRING)
        RETURN SELECT h.title, h.description, h.url, h.content FROM search_web_hits h
               WHERE h.query = search_web.query AND h.focus <=> search_web.focus
                 AND h.result_index < coalesce(nullif(search_web.max_results, 0), 5)
    """)


def register_search_shelf(spark: SparkSession, responses: DataFrame) -> None:
    """``search_shelf(retailer, keyword)`` over ``retailer`` (lower case), ``keyword``, ``payload``.

    The retailer comes back as the table has it. Giving back the argument instead would turn the
    LATERAL join into a nested loop over all pairs.
    """
    items = unwrap_items(responses.select("retailer", "keyword", "payload")).drop("item_index")
    shelf_search(items).createOrReplaceTempView("search_shelf_items")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION search_shelf(
            retailer STRING COMMENT 'retailer in any case',
            keyword STRING COMMENT 'search term as it was sent')
        RETURNS TABLE (retailer STRING, position INT, product_name STRING, brand STRING, price DOUBLE,
                       list_price DOUBLE, rating DOUBLE, review_count INT, sponsored BOOLEAN,
                       product_id STRING, product_url STRING)
        RETURN SELECT i.retailer, i.position, i.product_name, i.brand, i.price, i.list_price, i.rating,
                      i.review_count, i.sponsored, i.product_id, i.product_url
               FROM search_shelf_items i
               WHERE i.retailer = lower(search_shelf.retailer) AND i.keyword = search_shelf.keyword
    """)


def register_product_page(spark: SparkSession, responses: DataFrame) -> None:
    """``product_page(asin)`` over ``requested_asin`` and ``payload``."""
    items = unwrap_items(responses.select("requested_asin", "payload")).drop("item_index")
    product_page(items).createOrReplaceTempView("product_page_rows")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION product_page(asin STRING COMMENT 'product the page was asked for')
        RETURNS TABLE (asin STRING, product_title STRING, price DOUBLE, rating DOUBLE, review_count INT,
                       five_star_pct STRING, positive_mentions STRING, neutral_mentions STRING,
                       review_summary STRING, product_url STRING)
        RETURN SELECT p.asin, p.product_title, p.price, p.rating, p.review_count, p.five_star_pct,
                      p.positive_mentions, p.neutral_mentions, p.review_summary, p.product_url
               FROM product_page_rows p WHERE p.requested_asin = product_page.asin
    """)


def register_start_run(spark: SparkSession, responses: DataFrame) -> None:
    """``start_run(agent_id, input, input_data_json, effort)`` over the request's columns of the same
    names and its ``http_code``, ``body`` and ``exception``."""
    run_start_rows(responses).createOrReplaceTempView("start_run_outcomes")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION start_run(
            agent_id STRING, input STRING, input_data_json STRING DEFAULT NULL, effort STRING DEFAULT NULL)
        RETURNS TABLE (run_id STRING, status STRING, error STRING)
        RETURN SELECT o.run_id, o.status, o.error FROM start_run_outcomes o
               WHERE o.agent_id = start_run.agent_id AND o.input = start_run.input
                 AND o.input_data_json <=> start_run.input_data_json AND o.effort <=> start_run.effort
    """)


def register_read_run(spark: SparkSession, envelopes: DataFrame) -> None:
    """``read_run(agent_id, run_id)`` over ``agent_id``, ``run_id``, ``status``, ``envelope``."""
    rows = run_result(envelopes).withColumn("source_urls", F.to_json("source_urls"))
    rows.createOrReplaceTempView("read_run_rows")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION read_run(agent_id STRING, run_id STRING)
        RETURNS TABLE (run_id STRING, status STRING, confidence STRING, item_index INT, item_json STRING,
                       source_urls STRING)
        RETURN SELECT r.run_id, r.status, r.confidence, r.item_index, r.item_json, r.source_urls
               FROM read_run_rows r
               WHERE r.agent_id = read_run.agent_id AND r.run_id = read_run.run_id
    """)
