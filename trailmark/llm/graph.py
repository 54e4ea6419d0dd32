"""Connected components by contraction, for edges between narrow keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, label for the nodes of edges (a, b): the label is one node of the component, the same for all its nodes.

    Each round maps every node to the least of itself and its neighbours and replaces the ends of edges by what they map
    to; edges whose ends meet go. A star is done in one round, a path of n nodes in about log n. Each round is written
    to the shared folder, so lineage stays short. No edges: no rows.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("b").alias("node"), F.col("a").alias("least")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("least")))
        step = materialise(both.groupBy("node").agg(F.min("least").alias("least")), "contraction")
        if labels is None:
            labels = step.select("node", F.col("least").alias("label"))
        else:
            labels = labels.join(step.select(F.col("node").alias("label"), "least"), "label", "left").select("node", F.coalesce("least", "label").alias("label"))
            labels = materialise(labels, "labels")
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("least").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("least").alias("y")), "b")
        edges = materialise(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
