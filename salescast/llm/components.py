"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescast.llm.scratch import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (a, b): node, label.

    Each round a node takes the smallest label among its neighbours, and then the
    label of that label, so that long chains shorten by halves. Sums are made
    map-side before the shuffle; each round's labels are a written table.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = both.union(both.select(F.col("other"), F.col("node"))).where("node != other").distinct()
    both = stored(both, "component-edges")
    labels = both.groupBy("node").agg(F.least("node", F.min("other")).alias("label"))
    labels = stored(labels, "component-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other")
        near = near.groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        step = step.alias("s").join(labels.alias("l"), F.col("s.next") == F.col("l.node"), "left")
        step = step.select("s.node", F.col("s.label").alias("old"), F.least("s.next", "l.label").alias("label"))
        step = stored(step, "component-labels")
        labels = step.select("node", "label")
        if step.where("label != old").isEmpty():
            return labels
