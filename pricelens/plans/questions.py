"""Questions people ask of the research and shelf tables.

Companies report in different currencies, so growth and margin are compared, never revenue.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.operators.keyed import best_per_key, latest_run, latest_run_per_key


def latest_quarters(earnings: DataFrame, tie_break: Sequence[Column] = ()) -> DataFrame:
    """Latest quarter of each company, whatever the case of its name."""
    order = [F.col("quarter_end_date").desc_nulls_last(), *tie_break]
    return best_per_key(earnings, [F.lower("company")], order)


def fastest_growth(earnings: DataFrame, tie_break: Sequence[Column] = ()) -> DataFrame:
    """The company that grew fastest in its latest quarter, with its gross margin."""
    return (
        latest_quarters(earnings, tie_break)
        .orderBy(F.col("revenue_growth_yoy_pct").desc_nulls_last(), F.lower("company"))
        .select(
            "company",
            "fiscal_quarter_label",
            "quarter_end_date",
            "revenue_growth_yoy_pct",
            "gross_margin_pct",
        )
        .limit(1)
    )


def well_rated(
    watchlist: DataFrame, reviews: DataFrame, above: float = 4.5, loaded: str = "loaded_at"
) -> DataFrame:
    """Watchlist products rated above a threshold in their latest run, one row per complaint."""
    current = latest_run_per_key(reviews, ["brand", "model"], loaded).filter(F.col("rating") > above)
    return current.join(watchlist.select("brand", "model"), ["brand", "model"], "left_semi").select(
        "brand", "model", "rating", "run_id", F.explode_outer("top_complaints").alias("complaint")
    )


def most_on_sale(latest: DataFrame, brand: str) -> DataFrame:
    """The retailer with the most items of a brand on sale, and the share that is."""
    on_sale = F.col("list_price").isNotNull()
    return (
        latest.filter(F.col("brand") == brand)
        .groupBy("retailer")
        .agg(
            F.count_if(on_sale).alias("items_on_sale"),
            F.round(100 * F.avg(F.when(on_sale, 1).otherwise(0)), 1).alias("pct_on_sale"),
        )
        .orderBy(F.desc("items_on_sale"), F.desc("pct_on_sale"), "retailer")
        .limit(1)
    )


def margin_vs_discount(
    earnings: DataFrame,
    latest: DataFrame,
    company_brands: DataFrame,
    retailer: str,
    tie_break: Sequence[Column] = (),
) -> DataFrame:
    """The company with the best gross margin in its latest quarter, and how its brand is discounted
    at one retailer: one row per item on sale, with the brand's share on sale and average discount.

    Companies without a brand are left out before the best is picked. The items are listed, not collected into one value. ``company_brands`` maps a lower-case
    ``company_key`` to a ``brand``.
    """
    best = (
        latest_quarters(earnings, tie_break)
        .withColumn("company_key", F.lower("company"))
        .join(company_brands, "company_key")
        .orderBy(F.col("gross_margin_pct").desc_nulls_last(), "company_key", "brand")
        .limit(1)
        .select("company", "fiscal_quarter_label", "gross_margin_pct", "brand")
    )
    on_sale = F.col("list_price").isNotNull()
    # ``best`` is one row, so it and the shares of its one brand can be broadcast at any scale.
    items = latest.filter(F.col("retailer") == retailer).join(F.broadcast(best), "brand")
    shares = items.groupBy("brand").agg(
        F.count(F.lit(1)).alias("products"),
        F.round(100 * F.avg(F.when(on_sale, 1).otherwise(0)), 1).alias("pct_on_sale"),
        F.round(F.avg("discount_pct"), 1).alias("avg_discount_pct"),
    )
    listed = items.filter(on_sale).select(
        "company", "fiscal_quarter_label", "gross_margin_pct", "brand", "product_url", "discount_pct"
    )
    return listed.join(F.broadcast(shares), "brand")


def earnings_listing(earnings: DataFrame) -> DataFrame:
    """Earnings by company, newest quarter first."""
    return earnings.select(
        "company",
        "fiscal_quarter_label",
        "quarter_end_date",
        "revenue_millions",
        "currency",
        "revenue_growth_yoy_pct",
        "gross_margin_pct",
        "high_confidence_share",
        "source_url",
    ).orderBy("company", F.desc("quarter_end_date"))


def reviews_of_latest_run(reviews: DataFrame, loaded: str = "loaded_at") -> DataFrame:
    """Reviews of the run loaded last, best rating first."""
    return (
        latest_run(reviews, loaded)
        .select(
            "brand",
            "model",
            "rating",
            "review_count",
            "price_usd",
            "retailer",
            "top_praise",
            "top_complaints",
            "product_url",
        )
        .orderBy(F.desc("rating"))
    )
