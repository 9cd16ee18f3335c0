"""Connected components of an edge table, without the driver seeing an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, unshipped


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, label (least node that is reachable) for every node of an edge.

    Rounds of least label among neighbours, then a jump to the label's own label; paths halve in each round. A
    round's labels are written to the shared folder. An empty table gives none; loops and repeated edges do not
    matter.
    """
    both = edges.select(F.col(left).alias("a"), F.col(right).alias("b"))
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(unshipped(labels), F.col("b") == F.col("node")).groupBy(F.col("a").alias("of")).agg(F.min("label").alias("near"))
        step = labels.join(unshipped(near), F.col("node") == F.col("of"), "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = step.select(F.col("node").alias("at"), F.col("label").alias("top"))
        nxt = cut(step.join(unshipped(up), F.col("label") == F.col("at"), "left").select("node", "was", F.coalesce(F.least("top", "label"), F.col("label")).alias("label")), "labels")
        changed = nxt.where("label <> was").limit(1).count()
        labels = nxt.select("node", "label")
        if not changed:
            return labels
