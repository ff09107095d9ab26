"""Search-result items of any retailer in one row shape.

``normalise_shelf`` is the shape of the feed. ``shelf_search`` is the plainer, SQL-like reading of
the same items for a live look at one search; the two differ on purpose in empty values, list
prices, signs, counts and the sponsored flag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.brands import BRAND_PATTERNS, brand_from, brand_texts
from pricelens.functions.json_values import (
    field,
    first_present,
    is_truthy,
    read_digits,
    text,
    text_struct,
    to_boolean,
    to_integer,
    to_number,
    variant_struct,
)

# The names under which the retailers send each field, in the order they are tried.
ALIASES = {
    "position": ["position", "item_stack_position"],
    "product_name": ["product_name", "title"],
    "given_brand": ["product_brand", "brand"],
    "price": ["price", "product_price", "price_current"],
    "list_price": ["original_price", "product_price_original", "list_price"],
    "rating": ["rating", "product_rating"],
    "review_count": ["review_count", "product_reviews_count"],
    "sponsored": ["sponsored", "is_sponsored", "is_promotion"],
    "product_id": ["asin", "tcin", "product_id"],
    "product_url": ["product_url", "url"],
    "image_url": ["image_url", "product_image"],
}
OUT_OF_STOCK = "product_out_of_stock"
AVAILABILITY = "availability"

# The retailer whose product pages follow from the id, and how.
URL_RETAILER = "footlocker"
URL_START = "https://www.footlocker.com/product/~/"
URL_END = ".html"

_FIELDS = [name for names in ALIASES.values() for name in names] + [OUT_OF_STOCK, AVAILABILITY]


NUMBERS = ["position", "price", "list_price", "rating", "review_count"]
#: Values that read differently as a text and as another JSON value, by what the field is: a signed number or one
#: with an exponent, zero, false and the empty object where presence counts, and the empty list anywhere.
_UNCLEAR = {
    "number": r"\[\]|-[0-9.]+|-?[0-9.]+[eE][+-]?[0-9]+",
    "presence": r"\[\]|\{\}|false|-?[0.]+",
    "other": r"\[\]",
}


def _needs_kinds(texts: Column) -> Column:
    """Whether some value of an item reads differently as a text and as another JSON value: one of ``_UNCLEAR``, or a
    stock flag that is null or missing. All texts are searched at once; each sort has a separator of its own, and the
    pattern begins with any of them, so that most places are passed over at a glance."""
    named = [alias for names in ALIASES.values() for alias in names]
    numbers = [alias for name in NUMBERS for alias in ALIASES[name]]
    presence = [*ALIASES["product_id"], AVAILABILITY]
    sorts = {"number": numbers, "presence": presence, "other": [n for n in named if n not in numbers + presence]}
    joined, patterns = [], []
    for sort, mark in zip(sorts, "\x01\x02\x03"):
        joined += [F.lit(mark), F.concat_ws(mark, *[texts[name] for name in sorts[sort]]), F.lit(mark)]
        patterns.append(f"(?<={mark})(?:{_UNCLEAR[sort]}){mark}")
    unknown_stock = texts[OUT_OF_STOCK].isNull() & F.col("item").contains(f'"{OUT_OF_STOCK}"')
    return F.concat(*joined).rlike(f"[\x01-\x03](?:{'|'.join(patterns)})") | unknown_stock


def _page_from_id(product_id: Column) -> Column:
    return F.concat(F.lit(URL_START), product_id, F.lit(URL_END))


def normalise_shelf(
    items: DataFrame,
    captured_at: Column,
    patterns: Sequence[tuple[str, str]] = BRAND_PATTERNS,
) -> DataFrame:
    """Feed rows from ``retailer``, ``keyword`` and ``item`` (JSON text); other columns are kept.

    ``captured_at`` is the one time of the run. Five projections: parse, see whether texts are enough,
    pick the first present alias, convert, look up the brand. Each is a step of its own because its
    columns are used more than once in the next. Values are read as text; only an item with a value
    whose text can mean two things is parsed as VARIANT as well. There is no shuffle and no Python in
    it, so it serves batches and streams alike.
    """
    kept = [name for name in items.columns if name not in ("retailer", "keyword", "item")]
    texts, raw, unclear = F.col("texts"), F.col("raw"), F.col("raw.json").isNotNull()
    parsed = items.select(
        *kept, "retailer", "keyword", "item", F.from_json("item", text_struct(_FIELDS)).alias("texts")
    )
    kinds = F.when(_needs_kinds(texts), F.from_json("item", variant_struct(_FIELDS)))
    known = parsed.select(
        *kept, "retailer", "keyword", F.struct(texts.alias("text"), kinds.alias("json")).alias("raw")
    )

    def pick(names: Sequence[str]) -> Column:
        plain = F.coalesce(*[F.nullif(raw["text"][alias], F.lit("")) for alias in names])
        loose = F.struct(plain.alias("text"), F.lit(None).cast("variant").alias("json"))
        return F.when(unclear, first_present(*[field(raw, alias) for alias in names])).otherwise(loose)

    picked = known.select(
        *kept,
        "retailer",
        "keyword",
        *[pick(names).alias(name) for name, names in ALIASES.items()],
        field(raw, OUT_OF_STOCK).alias("out_of_stock"),
        field(raw, AVAILABILITY).alias("availability"),
    )
    retailer = F.col("retailer")
    given_url = text(F.col("product_url"))
    from_id = F.when(
        (retailer == URL_RETAILER) & is_truthy(F.col("product_id")),
        _page_from_id(text(F.col("product_id"))),
    )
    in_stock = F.when(
        (retailer == "walmart") & (F.col("out_of_stock.text").isNotNull() | F.col("out_of_stock.json").isNotNull()),
        ~F.coalesce(to_boolean(F.col("out_of_stock")), F.lit(False)),
    ).when(
        (retailer == "target") & is_truthy(F.col("availability")),
        F.upper(text(F.col("availability"))) == "IN_STOCK",
    )
    typed = picked.select(
        *kept,
        "retailer",
        F.col("keyword").alias("search_keyword"),
        to_integer(F.col("position")).alias("position"),
        text(F.col("product_name")).alias("product_name"),
        text(F.col("given_brand")).alias("given_brand"),
        to_number(F.col("price")).alias("price"),
        to_number(F.col("list_price")).alias("_listed"),
        to_number(F.col("rating")).alias("rating"),
        to_integer(F.col("review_count")).alias("review_count"),
        to_boolean(F.col("sponsored")).alias("sponsored"),
        in_stock.alias("in_stock"),
        text(F.col("product_id")).alias("product_id"),
        F.coalesce(given_url, from_id).alias("product_url"),
        text(F.col("image_url")).alias("image_url"),
    )
    named = typed.withColumns(
        {
            "texts": brand_texts(F.col("product_name"), F.col("given_brand"), F.col("product_url")),
            "list_price": F.when(F.col("_listed") <= F.col("price"), F.lit(None)).otherwise(F.col("_listed")),
        }
    )
    on_sale = (F.col("list_price") != 0) & (F.col("price") != 0)
    discount = F.round(100 * (F.col("list_price") - F.col("price")) / F.col("list_price"), 1)
    return named.select(
        *kept,
        "retailer",
        "search_keyword",
        "position",
        "product_name",
        brand_from(F.col("texts"), patterns).alias("brand"),
        "price",
        "list_price",
        F.when(on_sale, discount).alias("discount_pct"),
        "rating",
        "review_count",
        "sponsored",
        "in_stock",
        "product_id",
        "product_url",
        "image_url",
        captured_at.alias("captured_at"),
    )


_PLAIN_FIELDS = [
    "position",
    "product_name",
    "product_brand",
    *["price", "product_price", "price_current"],
    *["original_price", "product_price_original"],
    *["rating", "product_rating"],
    *["review_count", "product_reviews_count"],
    *["sponsored", "is_sponsored", "is_promotion"],
    *["asin", "tcin", "product_id"],
    "product_url",
]


def shelf_search(items: DataFrame) -> DataFrame:
    """Eleven typed columns from ``retailer`` and ``item``; other columns are kept.

    Each value is the first alias that is not null, empty text included, stripped of all that is not
    a digit (or point) and cast; what does not read is NULL. ``retailer`` is echoed as given.
    """
    kept = [name for name in items.columns if name not in ("retailer", "item")]
    plain = F.from_json("item", ", ".join(f"{name} STRING" for name in _PLAIN_FIELDS))
    raw = F.col("raw")

    def first(*names: str) -> Column:
        return F.coalesce(*[raw[name] for name in names])

    from_id = F.when(F.lower("retailer") == URL_RETAILER, _page_from_id(raw["product_id"]))
    return items.select(*kept, "retailer", plain.alias("raw")).select(
        *kept,
        "retailer",
        raw["position"].try_cast("int").alias("position"),
        raw["product_name"].alias("product_name"),
        raw["product_brand"].alias("brand"),
        read_digits(first("price", "product_price", "price_current")).alias("price"),
        read_digits(first("original_price", "product_price_original")).alias("list_price"),
        read_digits(first("rating", "product_rating")).alias("rating"),
        F.regexp_replace(first("review_count", "product_reviews_count"), "[^0-9]", "")
        .try_cast("int")
        .alias("review_count"),
        first("sponsored", "is_sponsored", "is_promotion").try_cast("boolean").alias("sponsored"),
        first("asin", "tcin", "product_id").alias("product_id"),
        F.coalesce(raw["product_url"], from_id).alias("product_url"),
    )
