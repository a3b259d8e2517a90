"""Connected components as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """Columns node, component (its smallest node) for every node of ``edges`` (a, b).

    Every round takes the smallest label among the neighbours and then the label's own label, so the
    number of rounds grows with the logarithm of a component's width in ordinary graphs. Each round is
    written, which cuts the lineage. Null ends are left out.
    """
    pairs = edges.select(F.col("a"), F.col("b")).filter("a <> b")
    both = staged(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("_new"))
        step = staged(step, "labels")
        if step.filter("_old <> _new").isEmpty():
            return labels
        # The label's label: one row for each label on the right.
        hop = step.select(F.col("node").alias("_new"), F.col("_new").alias("_hop"))
        labels = staged(step.select("node", "_new").join(hop, "_new").select(
            "node", F.least("_new", "_hop").alias("component")), "labels")
