"""Bounding boxes of point clusters, padded crop rectangles, and the whole chain per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.dbscan import dbscan
from tallyframe.operators.features import standardise
from tallyframe.operators.linkage import linkage
from tallyframe.session import cut_lineage


def cluster_boxes(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """The box around the points of each cluster, as bounds and as four corners in turn."""
    bounds = df.groupBy(*by).agg(
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")
    )
    turns = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    corners = F.array(*[F.array(F.col(a), F.col(b)) for a, b in turns])
    return bounds.withColumn("corners", corners)


def crop_rects(boxes: DataFrame, margin: int = 20) -> DataFrame:
    """A rectangle around each box, wider by one ``margin``-th at every side, in whole pixels.

    Numbers are cut off toward zero.
    """
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return boxes.withColumns(
        {
            "left": (F.col("x0") - width / margin).cast("int"),
            "top": (F.col("y0") - height / margin).cast("int"),
            "width": (width + width * 2 / margin).cast("int"),
            "height": (height + height * 2 / margin).cast("int"),
        }
    )


def point_regions(
    df: DataFrame,
    by: str,
    key: str,
    x: str,
    y: str,
    eps: float = 0.25,
    min_samples: int = 10,
) -> DataFrame:
    """Regions of points per group: (group, cluster, points, box, crop rectangle).

    The number of density clusters of the standardised points says how many clusters average
    linkage makes of the raw points, noise included. A group without a density cluster has no
    region.
    """
    scaled = standardise(df.select(by, key, x, y), [x, y], [by])
    dense = dbscan(scaled, key, x, y, eps, min_samples, by)
    k = cut_lineage(dense.groupBy(by).agg(F.countDistinct("cluster").alias("k")))
    labelled, _ = linkage(df.select(by, key, x, y), key, [x, y], "average", k, by)
    sizes = labelled.groupBy(by, "cluster").agg(F.count(F.lit(1)).alias("points"))
    boxes = cluster_boxes(labelled, [by, "cluster"], x, y)
    return crop_rects(boxes).join(sizes, [by, "cluster"])
