"""Connected components of links between rows, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.tables import stored
from pricelens.operators.lookup import hot_lookup


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id`` and ``label``, the least id reachable, from ``nodes`` (``id``) and ``links`` (``a``, ``b``).

    Each round takes the least label among a node and its neighbours and then follows that label to its
    own label, which doubles the distance labels travel. Rounds are written to the shared folder.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = nodes.select("id", F.col("id").alias("label"))
    while True:
        # A node with very many links, and a label with very many nodes, are looked up where their rows are.
        near = hot_lookup(both, labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        best = stored(labels.join(near, "id", "left").select("id", "label", F.least("label", "near").alias("best")), "best")
        jump = labels.select(F.col("id").alias("best"), F.col("label").alias("far"))
        fresh = stored(hot_lookup(best, jump, "best").select("id", F.least("best", "far").alias("label"), (F.least("best", "far") != F.col("label")).alias("moved")), "labels")
        labels = fresh.select("id", "label")
        if fresh.where("moved").isEmpty():
            return labels
