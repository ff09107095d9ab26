"""Latest snapshot, best row per key, upsert.

A key may hold a large part of all rows. ``row_number() = 1`` is safe for it: Spark keeps only the
first row per key of each input partition before the shuffle (WindowGroupLimit), so a hot key
arrives as one row per partition. Every ordering should end in columns that make it total, since
ties are otherwise broken at random.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Groups whose newest times are sent to all tasks; beyond it Spark chooses the join.
SMALL = 100_000


def best_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order. NULL keys form groups of their own."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def latest_per_key(
    df: DataFrame, keys: Sequence[str | Column], at: str, tie_break: Sequence[Column] = ()
) -> DataFrame:
    """Newest row per key."""
    return best_per_key(df, keys, [F.col(at).desc(), *tie_break])


def latest_snapshot(
    df: DataFrame, at: str = "captured_at", day: str | None = None, per: str | None = None
) -> DataFrame:
    """Rows of the newest snapshot.

    ``at`` is the time of the snapshot. ``day`` names the partition column that holds its date: the
    newest day is then found from the folders and only that day is read. By default there is one
    newest snapshot for the whole table, so a retailer that is missing from it is missing here;
    ``per="retailer"`` takes each retailer's own newest. The newest times are an aggregate; counted to
    be at most ``SMALL`` rows they are broadcast, so that the rows are not dealt out by retailer.
    """
    if per is not None:
        newest = df.groupBy(per).agg(F.max(at).alias("_newest"))
        if newest.limit(SMALL + 1).count() <= SMALL:
            newest = F.broadcast(newest)
        same = F.col(f"rows.{per}").eqNullSafe(F.col(f"newest.{per}"))
        return (
            df.alias("rows")
            .join(newest.alias("newest"), same & (F.col(f"rows.{at}") == F.col("newest._newest")))
            .select("rows.*")
        )
    if day is not None:
        df = df.filter(F.col(day) == df.agg(F.max(day)).scalar())
        if day == at:
            return df
    return df.filter(F.col(at) == df.agg(F.max(at)).scalar())


def latest_run(df: DataFrame, loaded: str = "loaded_at") -> DataFrame:
    """Rows of the run that was loaded last; one run for the whole table."""
    newest = df.agg(F.max(F.struct(loaded, "run_id")).alias("last")).select("last.run_id").scalar()
    return df.filter(F.col("run_id") == newest)


def latest_run_per_key(df: DataFrame, keys: Sequence[str], loaded: str = "loaded_at") -> DataFrame:
    """Rows of each key's own last run.

    The last run per key is an aggregate, so a hot key is reduced before the shuffle; the join back
    has one row per key on its right side.
    """
    newest = df.groupBy(*keys).agg(F.max(F.struct(loaded, "run_id")).alias("_last"))
    newest = newest.select(*keys, F.col("_last.run_id").alias("run_id"))
    matched = [F.col(f"rows.{name}").eqNullSafe(F.col(f"newest.{name}")) for name in [*keys, "run_id"]]
    on = matched[0]
    for condition in matched[1:]:
        on = on & condition
    return df.alias("rows").join(newest.alias("newest"), on, "left_semi")


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[Column],
    order: Sequence[Column],
    null_safe_keys: bool = False,
) -> DataFrame:
    """New state of ``target`` after the best source row per key has replaced or joined it.

    ``keys`` are expressions over the common columns, such as a lower-cased name. A NULL in a key
    matches nothing, so such a source row is added at every run; ``null_safe_keys`` makes NULL equal
    to NULL. The result has one row per matched key even where the target had several.
    """
    named = [key.alias(f"_key{i}") for i, key in enumerate(keys)]
    names = [f"_key{i}" for i in range(len(named))]
    fresh = best_per_key(source.select("*", *named), names, order)
    current = target.select("*", *named)

    on = F.lit(True)
    for name in names:
        left, right = F.col(f"current.{name}"), F.col(f"fresh.{name}")
        on = on & (left.eqNullSafe(right) if null_safe_keys else left == right)
    kept = current.alias("current").join(fresh.select(*names).alias("fresh"), on, "left_anti")
    return kept.drop(*names).unionByName(fresh.drop(*names))
