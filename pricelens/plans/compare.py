"""Coverage, price match and freshness of a vendor's feed against ours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.operators.keyed import latest_per_key

PRICE_TOLERANCE_PCT = 2


KEYS = ["retailer", "product_id"]


def with_keys(vendor: DataFrame) -> DataFrame:
    """The vendor's rows with retailer and product as ours are written."""
    return vendor.withColumns({"retailer": F.lower("retailer"), "product_id": F.col("product_id").cast("string")})


def feed_compare(
    vendor: DataFrame,
    ours: DataFrame,
    as_of: Column,
    tolerance_pct: float = PRICE_TOLERANCE_PCT,
    tie_break: Sequence[Column] = (),
    keyed: bool = False,
) -> DataFrame:
    """Per retailer: vendor products, how many of them we found, the share of those whose prices
    agree within the tolerance, and the mean age of both feeds in hours at ``as_of``.

    A found product with a price missing on either side counts as a mismatch. The latest rows and
    the join use the same two columns, so each feed is shuffled once, after it has been reduced to
    one row per product and input partition; two tables that ``save_bucketed`` wrote by these columns
    are not shuffled at all. ``keyed`` says that ``vendor`` has gone through ``with_keys``.
    """
    theirs = vendor if keyed else with_keys(vendor)
    keys = KEYS
    v = latest_per_key(theirs, keys, "captured_at", tie_break).select(*keys, "price", "captured_at")
    n = latest_per_key(ours, keys, "captured_at", tie_break).select(*keys, "price", "captured_at")
    joined = v.alias("v").join(
        n.alias("n"),
        (F.col("n.retailer") == F.col("v.retailer")) & (F.col("n.product_id") == F.col("v.product_id")),
        "left",
    )
    found = F.col("n.product_id").isNotNull()
    agrees = F.abs(F.col("n.price") - F.col("v.price")) <= F.col("v.price") * tolerance_pct / 100
    return joined.groupBy(F.col("v.retailer").alias("retailer")).agg(
        F.count(F.lit(1)).alias("vendor_products"),
        F.count("n.product_id").alias("found_by_us"),
        F.round(100 * F.count("n.product_id") / F.count(F.lit(1)), 1).alias("coverage_pct"),
        F.round(100 * F.avg(F.when(found, F.when(agrees, 1).otherwise(0))), 1).alias("price_match_pct"),
        F.round(F.avg(_hours(as_of, F.col("v.captured_at"))), 1).alias("vendor_age_hours"),
        F.round(F.avg(_hours(as_of, F.col("n.captured_at"))), 1).alias("our_age_hours"),
    )


def _hours(later: Column, earlier: Column) -> Column:
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 3600
