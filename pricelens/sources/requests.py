"""From control tables to requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.schemas import RETAILER_TEMPLATES, TASK_WORDING

DEFAULT_RESULTS = 5


def enabled_searches(control: DataFrame) -> DataFrame:
    """Searches that are switched on."""
    return control.filter("enabled").select("retailer", "keyword")


def seed_searches(retailers: DataFrame, keywords: DataFrame) -> DataFrame:
    """Every retailer with every keyword, switched on: the product is the control table asked for."""
    return (
        retailers.select("retailer")
        .crossJoin(keywords.select("keyword"))
        .withColumn("enabled", F.lit(True))
    )


def retailer_templates(spark: SparkSession) -> DataFrame:
    """The five retailers with their search template and the name of its search parameter."""
    return spark.createDataFrame(RETAILER_TEMPLATES, "retailer STRING, template STRING, param STRING")


def expand_requests(searches: DataFrame, templates: DataFrame) -> DataFrame:
    """One request per search: template name and its parameters as JSON.

    A retailer without a template keeps its row, with the reason in ``error``; one bad control row
    does not stop the feed. ``templates`` carries no broadcast hint: Spark broadcasts it when its
    size allows.
    """
    known = F.col("template").isNotNull()
    return searches.join(templates, "retailer", "left").select(
        *searches.columns,
        "template",
        F.when(known, F.to_json(F.create_map("param", "keyword"))).alias("params_json"),
        F.when(~known, F.concat(F.lit("unknown retailer: "), F.coalesce("retailer", F.lit("NULL")))).alias("error"),
    )


def search_requests(queries: DataFrame) -> DataFrame:
    """Body of a web search from ``query``, ``max_results`` and ``focus``.

    No or zero results asked for means five; a focus works with the lite depth only.
    """
    focus = F.when(F.col("focus") != "", F.col("focus"))
    wanted = F.when(F.col("max_results") != 0, F.col("max_results"))
    body = F.struct(
        "query",
        F.coalesce(wanted, F.lit(DEFAULT_RESULTS)).alias("max_results"),
        F.when(focus.isNotNull(), "lite").otherwise("standard").alias("search_depth"),
        F.lit("US").alias("country"),
        F.lit("en").alias("locale"),
        focus.alias("focus"),
    )
    return queries.withColumn("body_json", F.to_json(body))


def run_requests(tasks: DataFrame) -> DataFrame:
    """Body that starts a research run from ``input``, ``input_data_json`` and ``effort``.

    The input rows are JSON already, so they are put in as they are; fields that are not set are
    left out.
    """
    fields = F.filter(
        F.array(
            F.concat(F.lit('"input":'), _json_text(F.col("input"))),
            F.when(F.col("effort") != "", F.concat(F.lit('"effort":'), _json_text(F.col("effort")))),
            F.when(
                F.col("input_data_json") != "", F.concat(F.lit('"input_data":'), F.col("input_data_json"))
            ),
        ),
        lambda field: field.isNotNull(),
    )
    return tasks.withColumn("body_json", F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")))


def _json_text(value: Column) -> Column:
    """JSON literal of a text: the one element of a JSON array, without the brackets."""
    array = F.to_json(F.array(value))
    return F.coalesce(F.substring(array, F.lit(2), F.length(array) - 2), F.lit("null"))


def expand_tasks(companies: DataFrame, quarters: int = 4, wording: str = TASK_WORDING) -> DataFrame:
    """One research task per company, as ``label`` and the text of the ``task``. In the wording, ``%d`` stands
    for the number of quarters and ``%s`` for the company."""
    wording = wording.replace("%d", str(quarters))
    return companies.select(
        F.col("company").alias("label"), F.format_string(wording, F.col("company")).alias("task")
    )


def task_input(rows: DataFrame, batch_size: int = 100, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows to enrich as JSON arrays of at most ``batch_size`` rows.

    A batch is a run of consecutive rows of one partition, so all of it is built before the shuffle
    and no value of the data, however frequent, decides how large a batch gets. The shuffle then
    moves one row per batch.
    """
    columns = list(columns or rows.columns)
    row_id = F.monotonically_increasing_id()
    partition_bits = 33
    numbered = rows.select(
        F.to_json(F.struct(*columns)).alias("_row"),
        F.shiftright(row_id, partition_bits).alias("partition"),
        F.floor(row_id.bitwiseAND(F.lit((1 << partition_bits) - 1)) / batch_size).alias("batch"),
    )
    return (
        numbered.groupBy("partition", "batch")
        .agg(F.collect_list("_row").alias("_rows"))
        .select(
            "partition",
            "batch",
            F.size("_rows").alias("rows"),
            F.concat(F.lit("["), F.array_join("_rows", ","), F.lit("]")).alias("input_data_json"),
        )
    )
