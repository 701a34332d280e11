"""Connected components of an undirected graph, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import staged


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the smallest node that can be reached. Every round is written to the
    shared folder, so lineage stays short; nothing is collected but one count a round."""
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    for _ in range(most_rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        low = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        # jump: the label of the label (every label is a node)
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = staged(low.join(jump, "root").select("node", "old", F.least("root", "far").alias("root")), "labels")
        labels = new.select("node", "root")
        if new.filter("root <> old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
