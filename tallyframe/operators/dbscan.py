"""Density clustering of points in the plane, per group.

Points lie in square cells whose diagonal is just under ``eps``, so all points of a cell are
neighbours of each other. A cell with at least ``min_samples`` points is dense: all its points
are core points of one cluster, whatever their number, and no pair inside it is ever looked at.
A cell that is not dense has fewer than ``min_samples`` points; only those are compared with the
points of the 24 cells around. Whether two cells touch is decided on the bounding boxes of ever
smaller squares: a pair of boxes is certainly within ``eps``, certainly not, or split further.
The result is exact, and the work grows with the number of points, also where one cell or one
group holds a large part of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.graph import components
from tallyframe.session import cut_lineage

_SPLIT = 4  # a square is cut into 4 × 4
_AROUND = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
_FORWARD = [o for o in _AROUND if o > (0, 0)]


def _distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def _moved(offsets: list[tuple[int, int]], cx: str, cy: str) -> Column:
    """The cells around a cell, one row each, as columns tx and ty."""
    return F.inline(
        F.array(
            *[
                F.struct((F.col(cx) + i).alias("tx"), (F.col(cy) + j).alias("ty"))
                for i, j in offsets
            ]
        )
    )


def _near(probes: DataFrame, points: DataFrame, eps: float) -> DataFrame:
    """Pairs of a probe (px, py) and a point (x, y) of a cell around it, within ``eps``."""
    sent = probes.select("grp", "px", "py", _moved(_AROUND, "cx", "cy"))
    right = points.withColumnsRenamed({"cx": "tx", "cy": "ty"})
    return right.join(sent, ["grp", "tx", "ty"]).filter(
        _distance(F.col("x") - F.col("px"), F.col("y") - F.col("py")) <= eps
    )


def _touching(core: DataFrame, side: float, eps: float) -> DataFrame:
    """Pairs of neighbouring cells with core points within ``eps`` of each other, as (a, b)."""

    def square(level: int, axis: str, cell: str) -> Column:
        inside = F.col(axis) - F.col(cell) * side
        return F.floor(inside / (side / _SPLIT**level)).cast("bigint")

    def boxes(level: int, wanted: DataFrame | None) -> DataFrame:
        keys = {
            "sx": square(level, "x", "cx"),
            "sy": square(level, "y", "cy"),
            "ox": square(max(level - 1, 0), "x", "cx"),
            "oy": square(max(level - 1, 0), "y", "cy"),
        }
        points = core.withColumns(keys)
        if wanted is not None:
            points = points.join(wanted, ["grp", "cx", "cy", "ox", "oy"], "left_semi")
        return points.groupBy("grp", "cx", "cy", "ox", "oy", "sx", "sy").agg(
            F.min("x").alias("x0"),
            F.max("x").alias("x1"),
            F.min("y").alias("y0"),
            F.max("y").alias("y1"),
        )

    pair = ["grp", "a_cx", "a_cy", "b_cx", "b_cy"]
    ends = {s: ["cx", "cy", "ox", "oy"] for s in ("a", "b")}

    def judged(open_pairs: DataFrame, box: DataFrame) -> DataFrame:
        for s, keys in ends.items():
            named = box.withColumnsRenamed(
                {c: f"{s}_{c}" for c in box.columns if c != "grp"}
            )
            open_pairs = open_pairs.join(named, ["grp", *[f"{s}_{k}" for k in keys]])

        def gap(axis: str) -> Column:
            return F.greatest(
                F.lit(0.0),
                F.col(f"a_{axis}0") - F.col(f"b_{axis}1"),
                F.col(f"b_{axis}0") - F.col(f"a_{axis}1"),
            )

        def reach(axis: str) -> Column:
            return F.greatest(
                F.col(f"a_{axis}1") - F.col(f"b_{axis}0"), F.col(f"b_{axis}1") - F.col(f"a_{axis}0")
            )

        return open_pairs.select(
            *pair,
            *[f"{s}_{k}" for s in ends for k in ("sx", "sy")],
            (_distance(reach("x"), reach("y")) <= eps).alias("sure"),
        ).filter(_distance(gap("x"), gap("y")) <= eps)

    cells = core.select("grp", "cx", "cy").distinct()
    ahead = cells.select(
        "grp", F.col("cx").alias("a_cx"), F.col("cy").alias("a_cy"), _moved(_FORWARD, "cx", "cy")
    ).withColumnsRenamed({"tx": "b_cx", "ty": "b_cy"})
    there = cells.select("grp", F.col("cx").alias("b_cx"), F.col("cy").alias("b_cy"))
    zero = {f"{s}_{o}": F.lit(0).cast("bigint") for s in ends for o in ("ox", "oy")}
    open_pairs = ahead.join(there, ["grp", "b_cx", "b_cy"], "left_semi").withColumns(zero)
    linked = None
    level, wanted = 0, None
    while True:
        tried = cut_lineage(judged(open_pairs, boxes(level, wanted)))
        sure = tried.filter("sure").select(*pair).distinct()
        linked = sure if linked is None else linked.union(sure)
        rest = tried.join(sure, pair, "left_anti")
        open_pairs = cut_lineage(
            rest.select(
                *pair,
                *[F.col(f"{s}_s{d}").alias(f"{s}_o{d}") for s in ends for d in ("x", "y")],
            ).distinct()
        )
        if open_pairs.isEmpty():
            return linked
        wanted = open_pairs.select("grp", *[F.col(f"a_{k}").alias(k) for k in ends["a"]]).union(
            open_pairs.select("grp", *[F.col(f"b_{k}").alias(k) for k in ends["b"]])
        ).distinct()
        level += 1


def dbscan(
    df: DataFrame,
    key: str,
    x: str,
    y: str,
    eps: float,
    min_samples: int,
    by: str | None = None,
) -> DataFrame:
    """Add ``cluster`` and ``is_core``; a cluster is named by its smallest core key, noise is null.

    A point's neighbours include itself. A border point goes to the neighbouring cluster with
    the smallest name. Coordinates must not be null.
    """
    side = eps / math.sqrt(2) * (1 - 1e-9)
    rows = df.select(
        "*",
        (F.col(by) if by else F.lit(0)).alias("__grp"),
        F.col(x).cast("double").alias("__x"),
        F.col(y).cast("double").alias("__y"),
    )
    # Copies of a point shrink to one row with a weight.
    points = rows.groupBy(F.col("__grp").alias("grp"), F.col("__x").alias("x"), F.col("__y").alias("y")).agg(
        F.count(F.lit(1)).alias("w"), F.min(key).alias("key")
    )
    points = points.withColumns(
        {
            "cx": F.floor(F.col("x") / side).cast("bigint"),
            "cy": F.floor(F.col("y") / side).cast("bigint"),
        }
    )
    points = cut_lineage(points)
    cells = points.groupBy("grp", "cx", "cy").agg(F.sum("w").alias("n"))
    sparse_cells = cells.filter(F.col("n") < min_samples).select("grp", "cx", "cy")
    sparse = cut_lineage(points.join(sparse_cells, ["grp", "cx", "cy"], "left_semi"))
    probes = sparse.select("grp", "cx", "cy", F.col("x").alias("px"), F.col("y").alias("py"))
    crowded = (
        _near(probes, points, eps)
        .groupBy("grp", F.col("px").alias("x"), F.col("py").alias("y"))
        .agg(F.sum("w").alias("near"))
        .filter(F.col("near") >= min_samples)
        .select("grp", "x", "y")
    )
    dense = points.join(sparse_cells, ["grp", "cx", "cy"], "left_anti")
    core = cut_lineage(dense.unionByName(sparse.join(crowded, ["grp", "x", "y"], "left_semi")))

    def name(prefix: str = "") -> Column:
        # the key of a cell as text, since a component label needs an order and nothing more
        parts = [F.col("grp").cast("string"), *[F.col(f"{prefix}{c}").cast("string")
                                                for c in ("cx", "cy")]]
        return F.concat_ws(":", *parts)

    touching = _touching(core, side, eps).select(name("a_").alias("a"), name("b_").alias("b"))
    cell_label = components(core.select(name().alias("node")), touching)
    core_cells = core.groupBy("grp", "cx", "cy").agg(F.min("key").alias("key"))
    labelled = core_cells.join(cell_label, name() == F.col("node")).select(
        "grp", "cx", "cy", "key", "label"
    )
    smallest = labelled.groupBy("label").agg(F.min("key").alias("cluster"))
    cell_cluster = cut_lineage(
        labelled.join(smallest, "label").select("grp", "cx", "cy", "cluster")
    )

    in_core = core.join(cell_cluster, ["grp", "cx", "cy"]).select(
        "grp", "x", "y", "cluster", F.lit(True).alias("is_core")
    )
    loose = sparse.join(crowded, ["grp", "x", "y"], "left_anti").select(
        "grp", "cx", "cy", F.col("x").alias("px"), F.col("y").alias("py")
    )
    border = (
        _near(loose, core, eps)
        .join(cell_cluster.withColumnsRenamed({"cx": "tx", "cy": "ty"}), ["grp", "tx", "ty"])
        .groupBy("grp", F.col("px").alias("x"), F.col("py").alias("y"))
        .agg(F.min("cluster").alias("cluster"))
        .withColumn("is_core", F.lit(False))
    )
    labels = in_core.unionByName(border).withColumnsRenamed(
        {"grp": "__grp", "x": "__x", "y": "__y"}
    )
    out = rows.join(labels, ["__grp", "__x", "__y"], "left")
    return out.select(*df.columns, "cluster", F.coalesce("is_core", F.lit(False)).alias("is_core"))
