"""Reads and writes of the tables: Parquet folders and catalog tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pricelens.operators.keyed import upsert

DAY = "captured_on"
#: Folder of a table's schema, which readers of the table pass over.
_SCHEMA = "_schema"


def seed_table(
    spark: SparkSession, name: str, rows: Sequence[tuple], ddl: str, comment: str | None = None
) -> DataFrame:
    """The catalog table ``name``, created with the starter ``rows`` when it does not exist.

    Later runs keep what users changed in it.
    """
    if not spark.catalog.tableExists(name):
        spark.createDataFrame(list(rows), ddl).write.format("parquet").saveAsTable(name)
        if comment:
            comment_table(spark, name, comment)
    return spark.table(name)


def create_table(
    spark: SparkSession,
    name: str,
    ddl: str,
    comment: str | None = None,
    partitioned_by: Sequence[str] = (),
) -> DataFrame:
    """The catalog table ``name``, created empty with the declared columns when it does not exist."""
    partitioning = f" PARTITIONED BY ({', '.join(partitioned_by)})" if partitioned_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet{partitioning}")
    if comment:
        comment_table(spark, name, comment)
    return spark.table(name)


def comment_table(spark: SparkSession, name: str, comment: str) -> None:
    quoted = comment.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"COMMENT ON TABLE {name} IS '{quoted}'")


def append_snapshot(
    snapshot: DataFrame,
    path: str,
    day: str = DAY,
    history: StructType | None = None,
    look_up_by: Sequence[str] = (),
    row_group_bytes: int | None = None,
    dealt: bool = False,
) -> int:
    """Adds a snapshot to the history at ``path``, one folder per day, and returns its row count.

    Columns may be added over time but not change their type: a change against the schema kept beside the
    files is refused, or against that of the ``history`` where it is given. The count comes from the
    write itself, not from a second read.
    The rebalance puts a day's rows together and splits a day that is too large for one file. A ``dealt``
    snapshot has had one, as where it is made of narrower rows, and is not shuffled again.

    ``look_up_by`` names columns that rows will be looked up by: the rows of a file are sorted by the
    first one, so that a row group holds a narrow range of it, and each gets a Bloom filter, so that a
    row group without a value is skipped. ``row_group_bytes`` makes row groups smaller than Parquet's
    own, for look-ups of few rows.
    """
    _keep_schema(snapshot.sparkSession, path, history or known_schema(snapshot.sparkSession, path), snapshot.schema, day)
    counted = Observation()
    rows = snapshot if dealt else snapshot.hint("rebalance", F.col(day))
    if look_up_by:
        # Partitioned writes sort by the folder; to come after that, the sort has to begin with it.
        rows = rows.sortWithinPartitions(day, *look_up_by)
    writer = rows.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("append").partitionBy(day)
    for name in look_up_by:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", str(row_group_bytes))
    writer.parquet(path)
    return counted.get["rows"]


def save_bucketed(rows: DataFrame, name: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """The catalog table ``name`` with the rows dealt to ``buckets`` files by the hash of ``keys``, sorted by them.

    Operators by the same keys, and joins with a table of as many buckets by the same keys, read it
    without a shuffle. The rows are dealt out before the write, so that each bucket is one file; a key with
    very many rows makes its bucket long, as it would a shuffle partition.
    """
    dealt = rows.repartition(buckets, *keys)
    dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return rows.sparkSession.table(name)


def read_history(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """All snapshots at ``path``; a column that a snapshot does not have yet is NULL.

    With the ``schema`` of the newest writer, or that kept beside the files, no file has to be opened to
    plan the read. Without either Spark merges the schemas of all files, which on a long history is a
    job of its own.
    """
    schema = schema or known_schema(spark, path)
    if schema is None:
        return spark.read.option("mergeSchema", "true").parquet(path)
    return spark.read.schema(schema).parquet(path)


def known_schema(spark: SparkSession, path: str) -> StructType | None:
    """The schema that the writers of the table at ``path`` have kept beside its files, None without one."""
    try:
        kept = spark.read.text(f"{path}/{_SCHEMA}", wholetext=True).take(1)
    except AnalysisException:
        return None
    return StructType.fromJson(json.loads(kept[0].value)) if kept else None


def _keep_schema(spark: SparkSession, path: str, known: StructType | None, new: StructType, partition: str) -> None:
    """Refuses a change of type, and keeps the columns of both, the partition last. Written before the rows: a
    reader finds NULL in a column that no file has yet, but would not find one that is not in the schema."""
    if known is not None:
        _check_additive(known, new)
    columns = {field.name: StructField(field.name, field.dataType) for field in [*(known or []), *new]}
    merged = StructType([*[f for name, f in columns.items() if name != partition], columns[partition]])
    if merged != known_schema(spark, path):
        text = spark.createDataFrame([(merged.json(),)], "value STRING").coalesce(1)
        text.write.mode("overwrite").text(f"{path}/{_SCHEMA}")


def _check_additive(existing: StructType, new: StructType) -> None:
    known = {field.name: field.dataType for field in existing}
    changed = [f.name for f in new if f.name in known and known[f.name] != f.dataType]
    if changed:
        raise ValueError(f"columns change their type: {', '.join(changed)}")


def _schema_so_far(spark: SparkSession, path: str, partition: StructField) -> StructType | None:
    """The merged schema of a table's files, None without any. The partition column's type is given: the
    names of its folders do not tell it."""
    try:
        merged = spark.read.option("mergeSchema", "true").parquet(path).schema
    except AnalysisException as failure:
        if failure.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return None
    return StructType([partition if field.name == partition.name else field for field in merged])


def upsert_table(
    source: DataFrame,
    path: str,
    staging: str,
    keys: Sequence[Column],
    partition: str,
    order: Sequence[Column],
    null_safe_keys: bool = False,
    schema: StructType | None = None,
) -> DataFrame:
    """Upserts ``source`` into the Parquet table at ``path``, which is partitioned by ``partition``.

    ``partition`` has to be one of the matched columns, so a source row can only touch the partition
    it lies in: only those partitions are replaced, the others are left as they are. The folders to
    read are narrowed to the source's range of values, which Spark finds before it lists files; the
    values themselves are a join, so nothing is collected. ``source`` is read several times and should
    be a written table.

    The table keeps every column it has: what the source lacks is NULL in its rows, what the table
    lacks is added, and a column that changes its type is refused. ``schema`` is the table's; without
    it the one kept beside the files counts, and without that Spark merges the schemas of all files.
    The columns are returned with the partition last.

    The new state is written to ``staging`` first, as a folder cannot be replaced while it is read;
    if the job dies while the partitions are being replaced, ``staging`` still holds them complete.
    Each partition is swapped by itself, so a reader may see some of them new and others old.
    """
    spark = source.sparkSession
    # Makes the folder where there is none yet, and does nothing otherwise.
    spark.createDataFrame([], source.schema).write.mode("ignore").partitionBy(partition).parquet(path)
    if schema is None:
        schema = known_schema(spark, path) or _schema_so_far(spark, path, source.schema[partition]) or source.schema
    _keep_schema(spark, path, schema, source.schema, partition)
    known = {field.name for field in schema}
    added = [field for field in source.schema if field.name not in known]
    own = [field for field in [*schema, *added] if field.name != partition]
    schema = StructType([*own, source.schema[partition]])

    bounds = source.agg(F.min(partition).alias("low"), F.max(partition).alias("high"))
    in_range = F.col(partition).between(bounds.select("low").scalar(), bounds.select("high").scalar())
    touched = source.select(F.col(partition).alias("_touched")).distinct()
    target = spark.read.schema(schema).parquet(path).filter(in_range | F.col(partition).isNull())
    target = target.join(touched, F.col(partition).eqNullSafe(F.col("_touched")), "left_semi")
    given = source.columns
    aligned = source.select(*(F.col(f.name) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    merged = upsert(target, aligned, keys, order, null_safe_keys)
    merged.write.parquet(staging)
    (
        spark.read.schema(schema)
        .parquet(staging)
        .hint("rebalance", F.col(partition))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
    return spark.read.schema(schema).parquet(path)
