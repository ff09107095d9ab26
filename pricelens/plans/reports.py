"""Reports on the shelf feed.

Rows come in as a DataFrame, usually ``latest_snapshot`` of the history. Shares and averages are
plain aggregates, so Spark sums per input partition before it shuffles and a brand or retailer with
most of the rows is no burden. Sorting is left to whoever shows the result.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.schemas import SCOREBOARD_BRANDS, TREND_BRANDS

PAGE_SIZE = 25
DETAIL_COLUMNS = [
    "product_url",
    "retailer",
    "search_keyword",
    "position",
    "brand",
    "product_name",
    "price",
    "list_price",
    "rating",
    "review_count",
    "sponsored",
]


def _percent_of_rows(condition: Column) -> Column:
    """Share of rows for which the condition is true; NULL counts as not true."""
    return F.avg(F.when(condition, 100).otherwise(0))


def mean_price(price: str) -> Column:
    """Average price. The sum goes through DECIMAL, so it does not depend on the order of the rows."""
    return F.sum(F.col(price).cast("decimal(18,4)")).cast("double") / F.count(price)


def keywords_per_retailer(control: DataFrame) -> DataFrame:
    """Enabled keywords per retailer."""
    return control.filter("enabled").groupBy("retailer").agg(F.count(F.lit(1)).alias("keywords"))


def brand_scoreboard(latest: DataFrame, brands: Sequence[str] = SCOREBOARD_BRANDS) -> DataFrame:
    """Brand by retailer: products, average price, share on sale, average discount, sponsored share."""
    return (
        latest.filter(F.col("brand").isin(list(brands)))
        .groupBy("brand", "retailer")
        .agg(
            F.count(F.lit(1)).alias("products"),
            F.round(mean_price("price"), 2).alias("avg_price"),
            F.round(_percent_of_rows(F.col("list_price").isNotNull()), 1).alias("pct_on_sale"),
            F.round(F.avg("discount_pct"), 1).alias("avg_discount_pct"),
            F.round(_percent_of_rows(F.col("sponsored")), 1).alias("pct_sponsored"),
        )
    )


def with_brand(latest: DataFrame) -> DataFrame:
    """Rows whose brand is known: what the dashboard looks at."""
    return latest.filter(F.col("brand").isNotNull())


def shelf_counters(latest: DataFrame) -> DataFrame:
    """Products with a name, average price and share on sale, for rows with a brand."""
    return with_brand(latest).agg(
        F.count("product_name").alias("products_on_the_shelf"),
        mean_price("price").alias("average_price"),
        _percent_of_rows(F.col("list_price").isNotNull()).alias("share_on_sale"),
    )


def price_by_brand_retailer(latest: DataFrame) -> DataFrame:
    """Average price by brand and retailer."""
    return with_brand(latest).groupBy("brand", "retailer").agg(mean_price("price").alias("avg_price"))


def sponsored_by_brand(latest: DataFrame) -> DataFrame:
    """Sponsored slots by brand."""
    return with_brand(latest).groupBy("brand").agg(F.count_if("sponsored").alias("sponsored_slots"))


def discount_by_brand(latest: DataFrame) -> DataFrame:
    """Average discount of the items on sale; a brand without any has NULL."""
    return with_brand(latest).groupBy("brand").agg(F.avg("discount_pct").alias("avg_discount_pct"))


def price_trend(history: DataFrame, day: Column, brands: Sequence[str] = TREND_BRANDS) -> DataFrame:
    """Average price by day and brand. ``day`` is the partition column, or a date of the time."""
    return (
        history.filter(F.col("brand").isin(list(brands)))
        .groupBy(day.alias("day"), "brand")
        .agg(mean_price("price").alias("avg_price"))
    )


def apply_filters(df: DataFrame, selections: Mapping[str, Sequence]) -> DataFrame:
    """Rows that satisfy every selection; no values means no restriction."""
    return df.filter(_all_of(_selection_conditions(selections)))


def facets(df: DataFrame, selections: Mapping[str, Sequence]) -> DataFrame:
    """Per filter and value: the rows that satisfy the other filters.

    One scan: each row gives one entry per filter, and entries are counted before the shuffle.
    """
    conditions = _selection_conditions(selections)
    entries = [
        F.struct(
            F.lit(name).alias("facet"),
            F.col(name).cast("string").alias("value"),
            _all_of({other: c for other, c in conditions.items() if other != name}).alias("passes"),
        )
        for name in selections
    ]
    return (
        df.select(F.explode(F.array(*entries)).alias("entry"))
        .select("entry.*")
        .groupBy("facet", "value")
        .agg(F.count_if("passes").alias("matching_rows"))
    )


def _selection_conditions(selections: Mapping[str, Sequence]) -> dict[str, Column]:
    return {
        name: F.coalesce(F.col(name).isin(list(values)), F.lit(False)) if values else F.lit(True)
        for name, values in selections.items()
    }


def _all_of(conditions: Mapping[str, Column]) -> Column:
    return reduce(operator.and_, conditions.values(), F.lit(True))


def detail_page(
    latest: DataFrame,
    order: Sequence[str],
    after: Sequence | None = None,
    columns: Sequence[str] = DETAIL_COLUMNS,
    size: int = PAGE_SIZE,
) -> DataFrame:
    """The next ``size`` rows in ``order`` behind the key ``after`` of the last row shown.

    ``order`` should identify a row. Starting behind a key instead of skipping rows keeps a late
    page as cheap as the first: Spark holds only ``size`` rows per partition.
    """
    rows = with_brand(latest)
    if after is not None:
        types = {field.name: field.dataType for field in rows.schema}
        last = F.struct(*[F.lit(v).cast(types[name]).alias(name) for name, v in zip(order, after)])
        rows = rows.filter(F.struct(*order) > last)
        if after[0] is not None:
            rows = rows.filter(F.col(order[0]) >= F.lit(after[0]))
    shown = [*columns, *[name for name in order if name not in columns]]
    return rows.select(*shown).orderBy(*order).limit(size)


# The reasons an alert names, and whose alerts they are unless the caller says otherwise.
DEEP_DISCOUNT, RIVAL_SPONSORED = "deep discount", "rival sponsored on your search"
YOUR_BRAND, SUB_BRANDS, WATCHED_PRODUCT, DISCOUNT_PCT = "Nike", ("Jordan",), "pegasus 41", 15


def shelf_alerts(
    latest: DataFrame,
    your_brand: str = YOUR_BRAND,
    sub_brands: Sequence[str] = SUB_BRANDS,
    watched_product: str = WATCHED_PRODUCT,
    discount_pct: float = DISCOUNT_PCT,
    extra: Sequence[str] = (),
) -> DataFrame:
    """What is worth a look: a watched product far below its list price, or a rival brand in a
    sponsored slot on a search for your brand.

    A row with both reasons appears twice. One scan tests both. Names are compared as literal text.
    """
    deep = F.lower("product_name").contains(watched_product.lower()) & (
        F.col("discount_pct") >= discount_pct
    )
    rival = (
        F.lower("search_keyword").contains(your_brand.lower())
        & F.col("sponsored")
        & F.col("brand").isNotNull()
        & ~F.col("brand").isin([your_brand, *sub_brands])
    )
    reasons = F.array_compact(F.array(F.when(deep, DEEP_DISCOUNT), F.when(rival, RIVAL_SPONSORED)))
    shown = [
        "retailer",
        "search_keyword",
        "position",
        "brand",
        "product_name",
        "price",
        "list_price",
        "discount_pct",
        "product_url",
        "captured_at",
        *extra,
    ]
    return latest.select(F.explode(reasons).alias("reason"), *shown)


COMPARISONS = {
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
    "=": operator.eq,
    "<>": operator.ne,
}


def evaluate_alert(df: DataFrame, measure: Column, comparison: str = ">", threshold: float = 0) -> DataFrame:
    """One row: the measure, the threshold and whether the alert fires."""
    value = F.col("value")
    return df.agg(measure.alias("value")).select(
        "value",
        F.lit(threshold).alias("threshold"),
        COMPARISONS[comparison](value, F.lit(threshold)).alias("fires"),
    )
