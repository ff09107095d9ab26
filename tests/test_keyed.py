"""Latest rows, upsert, snapshots, and what they do to the plan."""

import datetime

import pytest
from conftest import plan_of
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricelens.operators import keyed
from pricelens.sources import tables

D1, D2 = datetime.date(2025, 3, 31), datetime.date(2025, 6, 30)
EARNINGS = "company STRING, share DOUBLE, note STRING, quarter DATE"


def company_keys():
    return [F.lower("company"), F.col("quarter")]


def best_first():
    return [F.col("share").desc_nulls_last(), F.col("note")]


def earnings(spark, *rows):
    return spark.createDataFrame(list(rows), EARNINGS)


def as_set(df):
    return {tuple(row) for row in df.collect()}


def test_upsert_replaces_joins_and_dedupes(spark):
    target = earnings(spark, ("Nike", 0.5, "old", D1), ("Puma", 0.5, "kept", D1))
    source = earnings(
        spark, ("NIKE", None, "no share", D1), ("nike", 0.0, "zero beats null", D1), ("Asics", 1.0, "new", D2)
    )
    assert as_set(keyed.upsert(target, source, company_keys(), best_first())) == {
        ("nike", 0.0, "zero beats null", D1),
        ("Puma", 0.5, "kept", D1),
        ("Asics", 1.0, "new", D2),
    }


def test_upsert_is_idempotent_except_for_null_keys(spark):
    source = earnings(spark, ("Nike", 0.5, "a", D1), ("Nike", 0.4, "b", None))
    once = keyed.upsert(source.limit(0), source, company_keys(), best_first())
    twice = keyed.upsert(once, source, company_keys(), best_first())
    safe = keyed.upsert(once, source, company_keys(), best_first(), null_safe_keys=True)
    assert (once.count(), twice.count(), safe.count()) == (2, 3, 2)


def test_upsert_leaves_one_row_per_matched_key(spark):
    target = earnings(spark, ("Nike", 0.5, "a", D1), ("nike", 0.5, "b", D1))
    assert keyed.upsert(target, earnings(spark, ("NIKE", 1.0, "c", D1)), company_keys(), best_first()).count() == 1


def test_upsert_table_touches_only_its_partitions(spark, folder):
    def load(number, *rows):
        earnings(spark, *rows).write.parquet(f"{folder}/source_{number}")
        source = spark.read.parquet(f"{folder}/source_{number}")
        staging = f"{folder}/staging_{number}"
        return tables.upsert_table(source, f"{folder}/table", staging, company_keys(), "quarter", best_first())

    load(1, ("Nike", 0.5, "a", D1), ("Puma", 0.5, "b", D2), ("Asics", 0.1, "c", None))
    before = {f for f in spark.read.parquet(f"{folder}/table").inputFiles() if str(D2) in f}
    table = load(2, ("NIKE", 0.9, "d", D1), ("Asics", 0.2, "e", None))
    after = {f for f in spark.read.parquet(f"{folder}/table").inputFiles() if str(D2) in f}
    assert before == after and before
    assert as_set(table.select("company", "share", "note", "quarter")) == {
        ("NIKE", 0.9, "d", D1),
        ("Puma", 0.5, "b", D2),
        ("Asics", 0.1, "c", None),
        ("Asics", 0.2, "e", None),
    }


SHELF = "retailer STRING, price DOUBLE, captured_at TIMESTAMP, captured_on DATE"


def shelf_rows(spark):
    day = datetime.datetime
    rows = [
        ("a", 1.0, day(2025, 1, 1, 6), datetime.date(2025, 1, 1)),
        ("b", 2.0, day(2025, 1, 2, 6), datetime.date(2025, 1, 2)),
        ("b", 3.0, day(2025, 1, 2, 9), datetime.date(2025, 1, 2)),
    ]
    return spark.createDataFrame(rows, SHELF)


def test_latest_snapshot_reads_one_day(spark, folder):
    assert tables.append_snapshot(shelf_rows(spark), f"{folder}/history") == 3
    history = tables.read_history(spark, f"{folder}/history", SHELF)
    latest = keyed.latest_snapshot(history, day="captured_on")
    assert [row.price for row in latest.collect()] == [3.0]
    scan = next(line for line in plan_of(latest).splitlines() if "FileScan" in line and "price" in line)
    assert "PartitionFilters: [isnotnull(captured_on" in scan and "subquery" in scan


def test_latest_snapshot_is_global_unless_asked(spark):
    rows = shelf_rows(spark)
    assert {r.retailer for r in keyed.latest_snapshot(rows).collect()} == {"b"}
    per_retailer = keyed.latest_snapshot(rows, per="retailer").collect()
    assert {(r.retailer, r.price) for r in per_retailer} == {("a", 1.0), ("b", 3.0)}


def test_history_takes_new_columns_but_no_new_types(spark, folder):
    path = f"{folder}/history"
    tables.append_snapshot(shelf_rows(spark), path)
    wider = shelf_rows(spark).withColumn("rating", F.lit(4.5))
    tables.append_snapshot(wider, path, history=StructType.fromDDL(SHELF))
    for schema in (None, wider.schema):
        rated = tables.read_history(spark, path, schema).agg(F.count("rating"), F.count(F.lit(1))).first()
        assert tuple(rated) == (3, 6)
    with pytest.raises(ValueError, match="price"):
        tables.append_snapshot(
            shelf_rows(spark).withColumn("price", F.lit("1")), path, history=StructType.fromDDL(SHELF)
        )


def test_a_type_change_is_refused_without_being_told_the_history(spark, folder):
    path = f"{folder}/history"
    tables.append_snapshot(shelf_rows(spark), path)
    tables.append_snapshot(shelf_rows(spark).drop("price").withColumn("rating", F.lit(4.5)), path)
    for column, value in (("price", "1"), ("rating", 4)):
        with pytest.raises(ValueError, match=column):
            tables.append_snapshot(shelf_rows(spark).withColumn(column, F.lit(value)), path)
    known = tables.known_schema(spark, path)
    assert [f.name for f in known][-1] == "captured_on" and "rating" in known.names and "price" in known.names
    history = tables.read_history(spark, path)
    assert history.schema == known and tuple(history.agg(F.count("rating"), F.count("price"), F.count(F.lit(1))).first()) == (3, 3, 6)
    assert tables.known_schema(spark, f"{folder}/nothing") is None


def test_a_table_written_without_a_kept_schema_is_merged(spark, folder):
    path, rows = f"{folder}/t", [(1, "d1", 5.0)]
    spark.createDataFrame(rows, "k INT, day STRING, v DOUBLE").write.partitionBy("day").parquet(path)
    more = spark.createDataFrame([(2, "d1", "x")], "k INT, day STRING, w STRING")
    after = tables.upsert_table(more, path, f"{folder}/s", [F.col("k"), F.col("day")], "day", [F.col("k")])
    assert sorted(map(tuple, after.select("k", "v", "w", "day").collect())) == [(1, 5.0, None, "d1"), (2, None, "x", "d1")]
    assert tables.known_schema(spark, path).names == ["k", "v", "w", "day"]


def test_a_hot_key_is_reduced_before_the_shuffle(spark):
    rows = spark.range(0, 30000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("product_id"),
        F.lit("r").alias("retailer"),
        F.col("id").alias("captured_at"),
    )
    latest = keyed.latest_per_key(rows, ["retailer", "product_id"], "captured_at")
    lines = [line for line in plan_of(latest).splitlines() if "WindowGroupLimit" in line or "Exchange" in line]
    assert "Final" in lines[0] and "Exchange" in lines[1] and "Partial" in lines[2]
    assert latest.filter("product_id = 'hot'").first().captured_at == 29997
    assert latest.count() == 20001


def test_latest_runs_differ_by_table_and_product(spark):
    rows = spark.createDataFrame(
        [("x", "m", 1, "r1"), ("x", "m", 2, "r2"), ("y", "m", 1, "r1"), (None, "m", 0, "r0")],
        "brand STRING, model STRING, loaded_at INT, run_id STRING",
    )
    assert as_set(keyed.latest_run(rows)) == {("x", "m", 2, "r2")}
    per_product = keyed.latest_run_per_key(rows, ["brand", "model"])
    assert as_set(per_product) == {("x", "m", 2, "r2"), ("y", "m", 1, "r1"), (None, "m", 0, "r0")}


def test_catalog_tables(spark):
    ddl = "brand STRING, model STRING"
    tables.seed_table(spark, "watch", [("a", "b")], ddl, "it's a list")
    kept = tables.seed_table(spark, "watch", [("other", "row")], ddl)
    assert as_set(kept) == {("a", "b")}
    comment = spark.sql("DESCRIBE TABLE EXTENDED watch").filter("col_name = 'Comment'").first().data_type
    assert comment == "it's a list"
    assert tables.create_table(spark, "empty", EARNINGS, partitioned_by=["quarter"]).count() == 0
    assert tables.create_table(spark, "empty", EARNINGS).columns == ["company", "share", "note", "quarter"]
    for name in ("watch", "empty"):
        spark.sql(f"DROP TABLE {name}")


def test_upsert_keeps_columns_that_the_source_lacks(spark, folder):
    keys, order = [F.col("k"), F.col("day")], [F.col("v")]
    wide = spark.createDataFrame([("a", "d1", 1, "x"), ("b", "d1", 2, "y"), ("c", "d2", 3, "z"), ("n", None, 4, "w")], "k STRING, day STRING, v INT, extra STRING")
    tables.upsert_table(wide, f"{folder}/t", f"{folder}/s0", keys, "day", order)
    narrow = spark.createDataFrame([("a", "d1", 10), ("d", "d1", 11)], "k STRING, day STRING, v INT")
    after = tables.upsert_table(narrow, f"{folder}/t", f"{folder}/s1", keys, "day", order)
    rows = {(r.k, r.day, r.v, r.extra) for r in after.collect()}
    assert rows == {("a", "d1", 10, None), ("d", "d1", 11, None), ("b", "d1", 2, "y"), ("c", "d2", 3, "z"), ("n", None, 4, "w")}
    more = spark.createDataFrame([("c", "d2", 5, 1.5)], "k STRING, day STRING, v INT, score DOUBLE")
    after = tables.upsert_table(more, f"{folder}/t", f"{folder}/s2", keys, "day", order)
    assert {(r.k, r.v, r.extra, r.score) for r in after.collect()} == {("a", 10, None, None), ("d", 11, None, None), ("b", 2, "y", None), ("c", 5, None, 1.5), ("n", 4, "w", None)}
    changed = spark.createDataFrame([("c", "d2", "five")], "k STRING, day STRING, v STRING")
    with pytest.raises(ValueError, match="v"):
        tables.upsert_table(changed, f"{folder}/t", f"{folder}/s3", keys, "day", order)


def test_upsert_leaves_other_partitions_untouched(spark, folder):
    import os

    rows = spark.createDataFrame([("a", "d1", 1), ("b", "d5", 2), ("c", "d9", 3)], "k STRING, day STRING, v INT")
    tables.upsert_table(rows, f"{folder}/t", f"{folder}/s0", [F.col("k"), F.col("day")], "day", [F.col("v")])
    before = {d: sorted(os.listdir(f"{folder}/t/{d}")) for d in os.listdir(f"{folder}/t") if d.startswith("day")}
    tables.upsert_table(rows.filter("day <> 'd5'"), f"{folder}/t", f"{folder}/s1", [F.col("k"), F.col("day")], "day", [F.col("v")])
    after = {d: sorted(os.listdir(f"{folder}/t/{d}")) for d in before}
    assert [d for d in before if before[d] == after[d]] == ["day=d5"]


def test_newest_of_each_retailer(spark):
    feed = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1), (None, 5), (None, 4)], "retailer STRING, captured_at INT")
    newest = keyed.latest_snapshot(feed, per="retailer")
    assert sorted(map(str, newest.collect())) == sorted(map(str, feed.filter("captured_at IN (2, 5) OR retailer = 'b'").collect()))
