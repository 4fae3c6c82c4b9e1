"""Connected components of link tables that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.common import drop_durable, durable


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Rounds of two steps on a durable label table: a node takes the least label around it, then the label of its
    label, so labels travel twice as far each round. Ends when no label changes. Edges with a null end are
    void; loops and repeated edges do no harm. Both joins look up unique nodes, so that a label which a third
    of all nodes share is a skewed side that adaptive execution can split.
    """
    pairs = edges.select(F.col(a).alias("_u"), F.col(b).alias("_v")).where("_u IS NOT NULL AND _v IS NOT NULL")
    both = durable(pairs.union(pairs.select("_v", "_u")).distinct(), "edges")
    labels = durable(both.groupBy(F.col("_u").alias("node")).agg(F.least(F.min("_v"), F.col("node")).alias("component")), "labels")
    while True:
        around = both.join(labels, both["_v"] == labels["node"]).groupBy(F.col("_u").alias("node")).agg(F.min("component").alias("_around"))
        near = durable(labels.join(around, "node").select("node", F.col("component").alias("_old"), F.least("component", "_around").alias("_near")), "labels")
        of = near.select(F.col("node").alias("_root"), F.col("_near").alias("_far"))
        jumped = durable(near.join(of, near["_near"] == of["_root"], "left").select("node", "_old", F.least("_near", "_far").alias("component")), "labels")
        changed = jumped.where("component <> _old").limit(1).count()
        drop_durable(labels)
        drop_durable(near)
        labels = jumped.select("node", "component")
        if not changed:
            drop_durable(both)
            return labels
