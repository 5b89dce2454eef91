"""Connected components of an edge table, as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Tasks over which the rows of one value are spread when they look it up.
SALTS = 64


def looked_up(rows: DataFrame, on: str, by: str, table: DataFrame, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined on ``on`` with ``table``, which has one row for each value of it (``how="left"``: or none).

    Each value is asked for once by every one of ``salts`` groups of rows (dealt by ``by``, which should
    differ from row to row, and not be null), so the
    rows of a value that most of them share meet in as many tasks, never in one.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    answers = salted.select(on, "__salt").distinct().join(table, on, how)
    return salted.join(answers, [on, "__salt"]).drop("__salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the long columns ``a`` and ``b``; the root is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours (combined on the map side) and
    then follows the label's own label, which halves path lengths; it ends when no label changes.
    Neither a hub's edges nor the nodes of one large component meet in one task.  Labels are cut
    from their lineage by a checkpoint each round.  Self-loops and repeated edges change nothing;
    an empty table gives an empty table.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpointed(both.distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("root")))
    while True:
        near = looked_up(both, "b", "a", labels.withColumnRenamed("node", "b")).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "near").alias("low"), F.col("root").alias("old"))
        lower = checkpointed(lower)
        above = lower.select(F.col("node").alias("low"), F.col("low").alias("root"))
        labels = checkpointed(looked_up(lower, "low", "node", above).select("node", "root", "old"))
        if not labels.where(F.col("root") != F.col("old")).head(1):
            return labels.select("node", "root")
