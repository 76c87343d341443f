"""Density clustering of points in any dimension, per group, exact.

A space tree deals the points into leaves of bounded size. Every point also visits the leaves
whose box is within ``eps`` of it, so a leaf sees all neighbours of its own points. A leaf with
many visitors is spread over several blocks. Neighbours are counted first; then each block links
the core points that it sees by the components of its own small graph, so a dense spot sends one
link per point and never its pairs. Components over all links are the clusters.

Where ``eps`` is so wide, as it is in many dimensions, that a point would visit many leaves, leaves
are dealt into strips instead, and each pair of strips is compared in one task. A point is then sent
to as many tasks as there are strips, whose number does not grow with the table until a strip would
hold more than ``STRIP`` points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.graph import components
from tallyframe.operators.space_tree import SpaceTree, box_gap, grow, leaf_boxes, visits
from tallyframe.session import cut_lineage

LEAF = 2_000  # points of a leaf
BLOCK = 8_000  # visitors that a leaf's points are compared with at a time
MOST_VISITS = 6  # leaves that a point may visit on average before strips are compared
STRIPS = 12  # strips of a table; more only where they would outgrow STRIP
STRIP = 100_000  # points of a strip
TILE = 1_000  # points of a strip that are compared at a time
SAMPLE = 20_000  # points whose visits are counted to choose the way


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("c").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which points of ``a`` and ``b`` are at most ``eps`` apart.

    A matrix product settles all but the pairs next to ``eps``; those are measured by their
    differences, coordinate by coordinate.
    """
    shift = a.mean(axis=0)
    p, q = a - shift, b - shift
    pp, qq = (p * p).sum(axis=1), (q * q).sum(axis=1)
    square = (-2 * p) @ q.T
    square += pp[:, None]
    square += qq[None, :]
    slack = 1e-9 * (pp.max(initial=0.0) + qq.max(initial=0.0) + eps * eps)
    near = square < eps * eps - slack
    i, j = np.nonzero((square <= eps * eps + slack) ^ near)
    for start in range(0, len(i), 1 << 16):
        s, t = i[start : start + (1 << 16)], j[start : start + (1 << 16)]
        total = np.zeros(len(s))
        for k in range(a.shape[1]):
            total += (a[s, k] - b[t, k]) ** 2
        near[s, t] = np.sqrt(total) <= eps
    return near


def _count(eps: float):
    def run(own: pa.Table, seen: pa.Table) -> pa.Table:
        if own.num_rows and seen.num_rows:
            near = within(_matrix(own), _matrix(seen), eps)
            total = near @ seen.column("w").to_numpy().astype(np.float64)
        else:
            total = np.zeros(own.num_rows)
        return pa.table({"id": own.column("id"), "near": pa.array(total.astype(np.int64))})

    return run


def _block_components(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component numbers of the rows and the columns of a bipartite graph."""
    rows, cols = np.full(near.shape[0], -1), np.full(near.shape[1], -1)
    for first in range(near.shape[0]):
        if rows[first] >= 0:
            continue
        rows[first] = first
        front = np.array([first])
        while len(front):
            reached = np.flatnonzero(near[front].any(axis=0) & (cols < 0))
            cols[reached] = first
            front = np.flatnonzero(near[:, reached].any(axis=1) & (rows < 0)) if len(reached) else reached
            rows[front] = first
    lone = np.flatnonzero(cols < 0)
    cols[lone] = near.shape[0] + np.arange(len(lone))
    return rows, cols


def _link(eps: float):
    """Links (a, b) between core points, and from other points to a core point within reach."""

    def run(own: pa.Table, seen: pa.Table) -> pa.Table:
        a, b, core = [], [], []
        if own.num_rows and seen.num_rows:
            ids, seen_ids = (np.array(t.column("id").to_pylist(), object) for t in (own, seen))
            is_core = own.column("is_core").to_numpy(zero_copy_only=False).astype(bool)
            near = within(_matrix(own), _matrix(seen), eps)  # only core points visit here
            rows, cols = _block_components(near[is_core])
            heads: dict[int, str] = {}
            for number, name in [*zip(rows, ids[is_core]), *zip(cols, seen_ids)]:
                heads[number] = min(heads.get(number, name), name)
            head_of_col = np.array([heads[c] for c in cols], object)
            for name, number in [*zip(ids[is_core], rows), *zip(seen_ids, cols)]:
                if heads[number] != name:
                    a.append(name)
                    b.append(heads[number])
            core = [True] * len(a)
            for at in np.flatnonzero(~is_core):
                for head in sorted(set(head_of_col[near[at]])):
                    a.append(ids[at])
                    b.append(head)
                    core.append(False)
        return pa.table(
            {
                "a": pa.array(a, pa.string()),
                "b": pa.array(b, pa.string()),
                "core": pa.array(core, pa.bool_()),
            }
        )

    return run


def _meet(own: DataFrame, seen: DataFrame, run, schema: str) -> DataFrame:
    """Hand every leaf's points and visitors to ``run``, in blocks of bounded size."""
    counts = seen.groupBy("grp", "node").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    right = seen.join(counts, ["grp", "node"]).withColumn("block", block).drop("blocks")
    left = own.join(counts, ["grp", "node"]).select(
        *[F.col(c).alias(c) for c in own.columns],
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
    )
    keys = ["grp", "node", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _many_visits(tree: SpaceTree, ranged: DataFrame, boxes: DataFrame, reach: float) -> bool:
    """Whether a point visits more than ``MOST_VISITS`` leaves on average, judged by some points.

    The answer chooses the way to the result and not the result.
    """
    sums = boxes.agg(F.sum("n").alias("points"), F.count(F.lit(1)).alias("leaves")).first()
    if sums["leaves"] <= MOST_VISITS:
        return False
    every = -(-sums["points"] // SAMPLE)
    some = cut_lineage(ranged.filter(F.pmod(F.xxhash64("id", F.lit("visits")), F.lit(every)) == 0), "some")
    made = visits(tree, some).join(boxes, ["grp", "node"])
    made = made.filter(box_gap("c", "c", "box_low", "box_high") <= reach)
    return made.count() > MOST_VISITS * some.count()


def _strips(placed: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points of all groups, each with the pairs (i, j) of strips that its own strip is in.

    Leaves go to strips whole, by the running number of the points of their group.
    """
    ahead = Window.partitionBy("grp").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(ahead), F.lit(0))
    whole = Window.partitionBy("grp")
    total = F.sum("n").over(whole)
    count = F.greatest(F.lit(STRIPS), F.ceil(total / STRIP)).cast("int")
    count = F.least(count, F.count(F.lit(1)).over(whole).cast("int"))
    leaves = boxes.select(
        "grp",
        "node",
        count.alias("strips"),
        F.floor(before * count / total).cast("int").alias("strip"),
    )
    strip = F.col("strip")
    return placed.join(leaves, ["grp", "node"]).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("strips") - 1))
    ).withColumns({"i": F.least(strip, "other"), "j": F.greatest(strip, "other")}).drop("strips", "other")


def _tiles(table: pa.Table) -> list[np.ndarray]:
    """Rows of a strip by leaf, in runs of at most ``TILE``."""
    order = np.argsort(np.array(table.column("node").to_pylist(), object), kind="stable")
    return [order[k : k + TILE] for k in range(0, len(order), TILE)]


def _near_tiles(table: pa.Table, c: np.ndarray, eps: float):
    """Pairs of tiles of a pair of strips within reach, as rows (a, b), and whether they are one.

    A tile meets itself once; a strip's own tiles meet in the pair of the strip with itself.
    """
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    strip = table.column("strip").to_numpy()
    sides = []
    for one in sorted({i, j}):
        rows = np.flatnonzero(strip == one)
        if len(rows):
            sides.append([rows[t] for t in _tiles(table.take(pa.array(rows)))])
    if len(sides) < len({i, j}):
        return
    boxes = [[(c[t].min(axis=0), c[t].max(axis=0)) for t in tiles] for tiles in sides]
    for p, a in enumerate(sides[0]):
        for q, b in enumerate(sides[-1]):
            if i == j and q < p:
                continue
            gap = np.maximum(boxes[0][p][0] - boxes[-1][q][1], boxes[-1][q][0] - boxes[0][p][1])
            if np.sqrt((np.maximum(gap, 0) ** 2).sum()) <= eps * (1 + 1e-9):
                yield a, b, i == j and p == q


def _count_strips(eps: float):
    def run(table: pa.Table) -> pa.Table:
        weight = table.column("w").to_numpy().astype(np.float64)
        total = np.zeros(table.num_rows)
        c = _matrix(table)
        for a, b, same in _near_tiles(table, c, eps):
            near = within(c[a], c[b], eps)
            total[a] += near @ weight[b]
            if not same:
                total[b] += weight[a] @ near
        met = np.flatnonzero(total)
        return pa.table({"id": table.column("id").take(pa.array(met)), "near": total[met].astype(np.int64)})

    return run


def _root(head: np.ndarray, k: int) -> int:
    while head[k] != k:
        head[k] = head[head[k]]
        k = head[k]
    return k


def _unite(head: np.ndarray, rows: np.ndarray, others: np.ndarray) -> None:
    """Join the components of ``rows[k]`` and ``others[k]``, named by their smallest row."""
    for k, m in zip(rows.tolist(), others.tolist()):
        k, m = _root(head, k), _root(head, m)
        head[max(k, m)] = min(k, m)


def _link_strips(eps: float):
    """As ``_link``; one link per core point and pair of strips, and those of border points."""

    def run(table: pa.Table) -> pa.Table:
        core = table.column("is_core").to_numpy(zero_copy_only=False).astype(bool)
        head = np.arange(table.num_rows)
        c = _matrix(table)
        border = []
        for a, b, _ in _near_tiles(table, c, eps):
            for x, y in ((a[~core[a]], b[core[b]]), (b[~core[b]], a[core[a]])):
                if len(x) and len(y):
                    at, to = np.nonzero(within(c[x], c[y], eps))
                    border.append(np.stack([x[at], y[to]]))
            rows, cols = a[core[a]], b[core[b]]
            joined = np.concatenate([rows, cols])
            # core points that are known to be of one cluster need no distances
            if not len(rows) or not len(cols) or (head[joined] == head[joined[0]]).all():
                continue
            near = within(c[rows], c[cols], eps)
            if not near.any():
                continue
            _, first, number = np.unique(
                np.concatenate(_block_components(near)), return_index=True, return_inverse=True
            )
            others = joined[first][number]
            apart = head[joined] != head[others]
            _unite(head, joined[apart], others[apart])
            while (head[joined] != head[head[joined]]).any():
                head[joined] = head[head[joined]]
        for k in range(len(head)):
            head[k] = _root(head, k)
        ids = table.column("id")
        own = np.flatnonzero(head != np.arange(len(head)))
        edge = np.unique(np.concatenate([np.empty((2, 0), np.int64), *border], axis=1), axis=1)
        return pa.table(
            {
                "a": pa.concat_arrays([*ids.take(pa.array(own)).chunks, *ids.take(pa.array(edge[0])).chunks]),
                "b": pa.concat_arrays([*ids.take(pa.array(head[own])).chunks, *ids.take(pa.array(edge[1])).chunks]),
                "core": pa.array([True] * len(own) + [False] * edge.shape[1], pa.bool_()),
            }
        )

    return run


def dbscan_space(
    df: DataFrame,
    key: str,
    columns: list[str] | str,
    eps: float,
    min_samples: int,
    by: str | None = None,
    leaf: int = LEAF,
) -> DataFrame:
    """Add ``cluster`` and ``is_core``; a cluster is named by its smallest core key, noise is null.

    ``columns`` are numeric columns or one array column; every row of a group needs as many
    coordinates. A point's neighbours include itself; copies of a point weigh as many points. A
    border point goes to the neighbouring cluster with the smallest name. Rows with a missing
    coordinate, or one that is not finite, are noise and nobody's neighbours. How much a point is
    replicated depends on how ``eps`` compares with the leaves: where it spans the whole table,
    every strip sees every point, and all pairs are compared, which no exact method avoids.
    """
    vector = F.col(columns) if isinstance(columns, str) else F.array(*columns)
    rows = df.select(
        "*",
        (F.col(by).cast("string") if by else F.lit("")).alias("__grp"),
        vector.cast("array<double>").alias("__c"),
    )
    bad = F.exists("__c", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("__c").isNotNull() & (F.size("__c") > 0) & ~bad
    group = F.coalesce("__grp", F.lit("\0"))
    name = F.md5(F.concat_ws(",", group, F.array_join("__c", ",")).cast("binary"))
    rows = rows.withColumn("__id", F.when(fine, name))
    points = (
        rows.filter(fine)
        .groupBy("__id")
        .agg(
            F.first(group).alias("grp"),
            F.first("__c").alias("c"),
            F.count(F.lit(1)).alias("w"),
            F.min(key).alias("key"),
        )
        .withColumnRenamed("__id", "id")
    )
    tree = grow(points, leaf)
    placed = tree.points
    sizes = placed.groupBy("grp", "node").agg(F.count(F.lit(1)).alias("n"))
    boxes = cut_lineage(leaf_boxes(placed).join(sizes, ["grp", "node"]), "boxes")
    # a little farther than eps, as the boxes' edges are rounded
    reach = eps * (1 + 1e-9)
    ranged = placed.drop("node").withColumns(
        {
            "low": F.transform("c", lambda x: x - F.lit(reach)),
            "high": F.transform("c", lambda x: x + F.lit(reach)),
        }
    )
    seen = visits(tree, ranged).join(boxes.drop("n"), ["grp", "node"])
    seen = seen.filter(box_gap("c", "c", "box_low", "box_high") <= reach)
    seen = seen.select("grp", "node", "id", "w", "c")
    if _many_visits(tree, ranged, boxes, reach):
        paired = ["grp", "i", "j"]
        strips = _strips(placed.select("grp", "node", "id", "w", "c"), boxes)
        counted = strips.groupBy(*paired).applyInArrow(_count_strips(eps), "id string, near long")
    else:
        seen = cut_lineage(seen, "visits")
        counted = _meet(placed.select("grp", "node", "id", "c"), seen, _count(eps), "id string, near long")
        strips = None
    core_ids = cut_lineage(
        counted.groupBy("id").agg(F.sum("near").alias("near")).filter(F.col("near") >= min_samples).select("id"),
        "core",
    )
    marked = placed.join(core_ids.withColumn("is_core", F.lit(True)), "id", "left").select(
        "grp", "node", "id", "c", F.coalesce("is_core", F.lit(False)).alias("is_core")
    )
    schema = "a string, b string, core boolean"
    if strips is not None:
        linked = _strips(marked, boxes).groupBy(*paired).applyInArrow(_link_strips(eps), schema)
    else:
        linked = _meet(marked, seen.join(core_ids, "id", "left_semi"), _link(eps), schema)
    links = cut_lineage(linked, "links")
    labels = components(core_ids.select(F.col("id").alias("node")), links.filter("core"))
    labels = labels.withColumnsRenamed({"node": "id"})
    keyed = labels.join(placed.select("id", "key"), "id")
    named = keyed.groupBy("label").agg(F.min("key").alias("cluster"))
    in_core = cut_lineage(
        labels.join(named, "label").select("id", "cluster", F.lit(True).alias("is_core")), "named"
    )
    border = (
        links.filter(~F.col("core"))
        .join(in_core.select(F.col("id").alias("b"), "cluster"), "b")
        .groupBy(F.col("a").alias("id"))
        .agg(F.min("cluster").alias("cluster"))
        .withColumn("is_core", F.lit(False))
    )
    found = in_core.unionByName(border).withColumnsRenamed({"id": "__id"})
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("cluster", "is_core")]
    out = rows.drop("cluster", "is_core").join(found, "__id", "left")
    return out.select(*kept, "cluster", F.coalesce("is_core", F.lit(False)).alias("is_core"))

