"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.arrowtext import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """Columns ``node`` and ``label``, the smallest node of its component, for every node of ``edges`` (a, b).

    Each round a node takes the smallest label among its own and its
    neighbours', then the label of that label's node; both are aggregates that
    combine before the shuffle and joins that Spark can split at a hub. The
    rounds grow with the logarithm of the diameter on chains and are two or
    three on stars. Nulls are no nodes; loops and repeated edges are harmless.
    """
    pairs = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    both = checkpointed(pairs.union(pairs.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    weight = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("t")).first()["t"]
    while weight is not None:
        heard = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        best = heard.union(labels).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        labels = checkpointed(best.join(jump, best["label"] == jump["at"]).select("node", F.least("label", "far").alias("label")))
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("t")).first()["t"]
        if now == weight:
            break
        weight = now
    return labels
