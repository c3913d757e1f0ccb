"""Connected components of an edge table by contraction; no component or link list leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``a, b``); nodes share a label if and only if a path joins them.

    Each round every label takes the smallest label next to it, and the edges are drawn anew between
    the remaining labels, at most half as many; so the rounds grow with the logarithm of the nodes.
    """
    edges = edges.where("a != b")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.distinct(), "edges")
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    while not both.isEmpty():
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = stored(least, "least")
        labels = stored(labels.join(least, labels["label"] == least["a"], "left")
                        .select("node", F.coalesce("m", "label").alias("label")), "labels")
        one = both.join(least, "a").select(F.col("m").alias("p"), "b")
        two = one.join(least.withColumnsRenamed({"a": "b", "m": "q"}), "b").where("p != q")
        both = stored(two.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), "edges")
    return labels
