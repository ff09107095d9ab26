"""Rows inside fetched JSON payloads.

Every function parses a payload once, with a declared schema, and never raises: what is malformed
gives no rows or NULL fields.

Lists are opened with the outer form of explode, and the rows of empty lists are filtered out
afterwards: for the plain form Spark adds a filter on the list's size and pushes it down to the
scan, which parses every payload a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.json_values import FLOAT_TEXT, may_mislead

ITEM_LISTS = ["entities", "products", "results", "items"]

_PARSING = "STRUCT<" + ", ".join(f"{name}: ARRAY<STRING>" for name in ITEM_LISTS) + ">"
_ENVELOPE = f"status STRING, data STRUCT<parsing: {_PARSING}>"
_AS_TEXT = "data STRUCT<parsing: STRING>"

_SEARCH = "results ARRAY<STRUCT<title: STRING, description: STRING, url: STRING, content: STRING>>"
SNIPPET_LENGTH = 300

FIVE_STAR_FIELD = "5_star"
_PRODUCT_PAGE = (
    "asin STRING, product_title STRING, web_price STRING, average_of_reviews STRING, "
    "number_of_reviews STRING, "
    f"reviews_statistics_percentage_five_to_zero STRUCT<`{FIVE_STAR_FIELD}`: STRING>, "
    "review_mentions_with_positive_sentiment ARRAY<STRING>, "
    "review_mentions_with_neutral_sentiment ARRAY<STRING>, "
    "reviews_ai_summary STRING, product_url STRING"
)


def _object_only(text: Column) -> Column:
    """The text where it can be a JSON object, else NULL: a parse that fails costs an exception."""
    return F.when(text.rlike(r"^\s*\{"), text)


def with_items(payloads: DataFrame) -> DataFrame:
    """Adds ``items``: the parsed items of a template payload as JSON texts, empty without any.

    An object under ``data.parsing`` holds the items in the first of the known lists that really is
    a list, or is itself the one item; a list is the items. One parse is enough for the usual shape;
    the others are parsed once more, as text, to see what is there. A payload in which a string looks
    like a list or an object is parsed as VARIANT too, and such a string stays one: among the items it
    keeps its quotes. Each parse is a select of its own, because its result is used several times.
    """
    listed, parsing, kinds = F.col("_listed"), F.col("_parsing"), F.col("_kinds")
    is_text = F.coalesce(F.schema_of_variant(kinds) == "STRING", F.lit(False))
    json = _object_only(F.col("payload"))
    as_text = F.when(F.col("_items").isNull(), F.from_json(json, _AS_TEXT)["data"]["parsing"])
    items = F.coalesce(
        "_items",
        F.when(parsing.startswith("[") & ~is_text, F.from_json(parsing, "ARRAY<STRING>")),
        F.when(parsing.startswith("{") & ~is_text, F.array(parsing)),
        F.array().cast("array<string>"),
    )
    variant = F.try_variant_get(F.try_parse_json(json), "$.data.parsing", "variant")
    members = F.coalesce(
        *[F.when(listed[name].isNotNull(), _variants(kinds, f"$.{name}")) for name in ITEM_LISTS],
        _variants(kinds, "$"),
    )
    told_apart = F.transform(
        "items",
        lambda item, at: F.when(
            F.schema_of_variant(F.get(F.col("_members"), at)) == "STRING", F.concat(F.lit('"'), item, F.lit('"'))
        ).otherwise(item),
    )
    return (
        payloads.withColumn("_listed", F.from_json(json, _ENVELOPE)["data"]["parsing"])
        .withColumn("_items", F.coalesce(*[listed[name] for name in ITEM_LISTS]))
        .withColumn("_parsing", as_text)
        .withColumn("_kinds", F.when(may_mislead(F.col("payload")), variant))
        .withColumn("items", items)
        .withColumn("_members", F.when(kinds.isNotNull(), members))
        .withColumn("items", F.when(F.col("_members").isNotNull(), told_apart).otherwise(F.col("items")))
        .drop("_listed", "_items", "_parsing", "_kinds", "_members")
    )


def _variants(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def is_object(item: Column) -> Column:
    """True for the JSON text of an object."""
    return item.startswith("{")


def unwrap_items(payloads: DataFrame) -> DataFrame:
    """One row per item that is an object: the payload's other columns, ``item_index``, ``item``."""
    kept = [name for name in payloads.columns if name != "payload"]
    exploded = with_items(payloads).select(
        *kept, F.posexplode_outer("items").alias("item_index", "item")
    )
    return exploded.filter(is_object(F.col("item")))


def search_results(payloads: DataFrame) -> DataFrame:
    """Web search hits: title, the first 300 characters of the description, URL and content.

    Without content the full description stands in for it; without a description the snippet is
    empty text.
    """
    kept = [name for name in payloads.columns if name != "payload"]
    results = F.from_json(_object_only(F.col("payload")), _SEARCH)["results"]
    hits = payloads.select(*kept, F.posexplode_outer(results).alias("result_index", "hit")).filter(
        "result_index IS NOT NULL"
    )
    hit = F.col("hit")
    full_content = F.when(hit["content"] != "", hit["content"])
    return hits.select(
        *kept,
        "result_index",
        hit["title"].alias("title"),
        F.substring(F.coalesce(hit["description"], F.lit("")), 1, SNIPPET_LENGTH).alias("description"),
        hit["url"].alias("url"),
        F.coalesce(full_content, hit["description"]).alias("content"),
    )


def product_page(items: DataFrame) -> DataFrame:
    """Typed product page from ``item``: numbers that do not read as they stand are NULL, the
    mention lists become comma-joined text."""
    kept = [name for name in items.columns if name != "item"]
    page = F.col("page")
    return items.select(*kept, F.from_json("item", _PRODUCT_PAGE).alias("page")).select(
        *kept,
        page["asin"].alias("asin"),
        page["product_title"].alias("product_title"),
        _number(page["web_price"]).alias("price"),
        _number(page["average_of_reviews"]).alias("rating"),
        page["number_of_reviews"].try_cast("int").alias("review_count"),
        page["reviews_statistics_percentage_five_to_zero"][FIVE_STAR_FIELD].alias("five_star_pct"),
        F.array_join(page["review_mentions_with_positive_sentiment"], ", ").alias("positive_mentions"),
        F.array_join(page["review_mentions_with_neutral_sentiment"], ", ").alias("neutral_mentions"),
        page["reviews_ai_summary"].alias("review_summary"),
        page["product_url"].alias("product_url"),
    )


def _number(text: Column) -> Column:
    return F.when(text.rlike(FLOAT_TEXT), text.try_cast("double"))


def run_start_rows(responses: DataFrame, error_length: int = 500) -> DataFrame:
    """Outcome of starting a research run from ``http_code``, ``body`` and ``exception``.

    An exception is a row with status ``error``; so is a body that is no JSON object. A code of 300
    or more is a row with status ``http_<code>`` and the start of the body.
    """
    kept = [name for name in responses.columns if name not in ("http_code", "body", "exception")]
    reply = F.from_json("body", "id STRING, status STRING")
    raised = F.col("exception").isNotNull()
    refused = ~raised & (F.col("http_code") >= 300)
    unreadable = ~raised & F.get_json_object("body", "$").isNull()
    started = ~raised & ~refused & ~unreadable
    return responses.select(
        *kept,
        F.when(started, reply["id"]).alias("run_id"),
        F.when(raised | unreadable, "error")
        .when(refused, F.concat(F.lit("http_"), F.col("http_code").cast("string")))
        .otherwise(reply["status"])
        .alias("status"),
        F.when(raised, F.substring("exception", 1, error_length))
        .when(unreadable, F.lit("response is not JSON"))
        .when(refused, F.substring("body", 1, error_length))
        .alias("error"),
    )
