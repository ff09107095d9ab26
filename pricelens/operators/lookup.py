"""Looking rows up in a table whose keys are unique, where the rows' keys may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that a hot key's rows are dealt to, where Spark does not broadcast the table.
SALTS = 16


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], salts: int = SALTS) -> DataFrame:
    """All ``rows`` with the other columns of ``table``, NULL without a match.

    The table is repeated once for each salt and the rows are dealt to the salts in turn, so the rows of
    one key meet in that many tasks instead of one. It should be small beside the rows.
    """
    dealt = rows.withColumn("_salt", (F.monotonically_increasing_id() % salts).cast("int"))
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*keys, "_salt"], "left").select(*rows.columns, *[c for c in table.columns if c not in keys])


#: A key with more than one row in so many is hot, unless it has fewer rows than the second number.
HOT_SHARE, HOT_ROWS = 1000, 1000


def hot_lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``lookup`` in a table that may be as long as the rows.

    Hot keys are counted first. There are at most ``HOT_SHARE`` of them, so what the table says of them is
    broadcast and their rows stay where they are; the rest is joined, and no key of it is large. ``rows`` is
    read several times and should be a written table.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    hot = F.broadcast(counts.where(F.col("_rows") > F.greatest(total / HOT_SHARE, F.lit(HOT_ROWS))).select(key))
    columns = [*rows.columns, *[c for c in table.columns if c != key]]
    often = rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key, "left")
    rest = rows.join(hot, key, "left_anti").join(table, key, "left")
    return often.select(columns).union(rest.select(columns))
