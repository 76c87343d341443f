"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Label every node with the smallest node of its component.

    ``nodes`` has a column ``node``, ``edges`` has ``a`` and ``b``. In each round a node takes
    the smallest label among its neighbours and passes it on to the node that it was labelled
    with, and then every label is replaced by its own label, so the number of rounds grows with
    the logarithm of the longest chain. Messages to a node are combined before the shuffle. Each
    round is written to the shared folder; only a yes or no comes to the driver.
    """
    both = cut_lineage(
        edges.select("a", "b").union(edges.select("b", "a")).distinct().filter("a <> b")
    )
    labels = cut_lineage(nodes.select("node").distinct().withColumn("label", F.col("node")))
    while True:
        heard = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("label").alias("heard"))
        )
        closer = labels.join(heard, F.col("node") == F.col("a"), "left").select(
            "node", F.col("label").alias("old"), F.least("label", "heard").alias("via")
        )
        passed = closer.groupBy(F.col("old").alias("to")).agg(F.min("via").alias("passed"))
        closer = closer.join(passed, F.col("node") == F.col("to"), "left").select(
            "node", "old", F.least("via", "passed").alias("via")
        )
        roots = closer.select(F.col("node").alias("root"), F.col("via").alias("of_root"))
        jumped = cut_lineage(
            closer.join(roots, F.col("via") == F.col("root")).select(
                "node", "old", F.least("via", "of_root").alias("label")
            )
        )
        if jumped.filter("label <> old").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")
