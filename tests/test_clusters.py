"""Clustering against brute force on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators.boxes import point_regions
from tallyframe.operators.dbscan import dbscan
from tallyframe.operators.features import principal_pair, standardise
from tallyframe.operators.graph import components
from tallyframe.operators.kmeans import elbow, kmeans, nearest
from tallyframe.operators.linkage import linkage

EPS, MIN_SAMPLES = 0.25, 10


def _density(points):
    """Labels by smallest core index and core flags, from all distances."""
    n = len(points)
    dx = points[:, None, 0] - points[None, :, 0]
    dy = points[:, None, 1] - points[None, :, 1]
    near = np.sqrt(dx * dx + dy * dy) <= EPS
    core = near.sum(1) >= MIN_SAMPLES
    label = [None] * n
    for i in range(n):
        if core[i] and label[i] is None:
            stack, label[i] = [i], i
            while stack:
                for v in np.flatnonzero(near[stack.pop()] & core):
                    if label[v] is None:
                        label[v] = i
                        stack.append(v)
    for i in range(n):
        if not core[i]:
            around = [label[v] for v in np.flatnonzero(near[i] & core)]
            label[i] = min(around) if around else None
    return label, core


def test_density_clusters_are_exact(spark):
    rng = np.random.default_rng(3)
    groups = [
        rng.normal(size=(300, 2)),
        np.concatenate(
            [
                rng.normal(size=(150, 2)) * 0.1,
                rng.normal(size=(100, 2)) * 0.1 + [1, 0.5],
                rng.uniform(-2, 2, size=(80, 2)),
                np.repeat([[0.3, 0.3]], 60, 0),
            ]
        ),
        np.round(rng.uniform(-1, 1, size=(300, 2)), 1),
        rng.uniform(-5, 5, size=(40, 2)),
    ]
    rows, want, base = [], {}, 0
    for g, points in enumerate(groups):
        label, core = _density(points)
        for i, (x, y) in enumerate(points):
            rows.append((g, base + i, float(x), float(y)))
            want[base + i] = (None if label[i] is None else base + label[i], bool(core[i]))
        base += len(points)
    df = spark.createDataFrame(rows, "g int, id long, x double, y double")
    out = dbscan(df.repartition(5), "id", "x", "y", EPS, MIN_SAMPLES, "g")
    assert {r.id: (r.cluster, r.is_core) for r in out.collect()} == want


def _greedy(points, method, k):
    """Clusters by smallest index when k are left, and all heights."""
    groups = {i: [i] for i in range(len(points))}
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    heights, cut = [], {}

    def distance(a, b):
        p, q = groups[a], groups[b]
        if method == "average":
            return apart[np.ix_(p, q)].mean()
        factor = 2 * len(p) * len(q) / (len(p) + len(q))
        return np.sqrt(factor) * np.linalg.norm(points[p].mean(0) - points[q].mean(0))

    while True:
        if len(groups) == k:
            cut = {i: min(m) for m in groups.values() for i in m}
        if len(groups) == 1:
            return cut, sorted(heights)
        h, a, b = min((distance(a, b), a, b) for a in groups for b in groups if a < b)
        groups[a] += groups.pop(b)
        heights.append(h)


@pytest.mark.parametrize("method", ["ward", "average"])
@pytest.mark.parametrize("max_local", [14])
def test_linkage_with_ties_is_the_same_at_every_size(spark, method, max_local):
    """Grids, corners of a cube at equal distances and copies; many pairs are equally close."""
    grid = [(float(x), float(y), 0.0) for x in range(4) for y in range(3)]
    corners = [tuple(float(i == k) * 9 for k in range(3)) for i in range(3)] + [(9.0, 9.0, 9.0)]
    points = [*grid, *corners, *grid[:5], *[(x / 3, 7.0, 1 / 3) for x in range(5)]]
    order = np.random.default_rng(8).permutation(len(points))
    rows = [("a", int(i), *points[k]) for i, k in enumerate(order)]
    schema = "g string, id long, x double, y double, z double"

    def tree(local, parts):
        df = spark.createDataFrame(rows, schema).repartition(parts)
        labelled, merges = linkage(
            df, "id", ["x", "y", "z"], method, 5, "g", max_local=local, chunk=6
        )
        found = sorted((r.lo, r.hi, r.height, r.size) for r in merges.collect())
        return {r.id: r.cluster for r in labelled.collect()}, found

    labels, merges = tree(2000, 1)
    assert len(merges) == len(points) - 1 and len(set(labels.values())) == 5
    assert tree(max_local, 4) == (labels, merges)


@pytest.mark.parametrize("method", ["ward", "average"])
@pytest.mark.parametrize("max_local", [2000, 16])
def test_linkage_is_the_greedy_tree(spark, method, max_local):
    rng = np.random.default_rng(5)
    points = np.concatenate(
        [rng.normal(size=(14, 3)), rng.normal(size=(10, 3)) + 3, np.repeat([[1.0, 1, 1]], 3, 0)]
    )
    small = rng.normal(size=(7, 3))
    rows = [("a", i, *map(float, p)) for i, p in enumerate(points)]
    rows += [("b", 100 + i, *map(float, p)) for i, p in enumerate(small)]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double, z double")
    labelled, merges = linkage(
        df.repartition(3), "id", ["x", "y", "z"], method, 4, "g", max_local=max_local, chunk=8
    )
    got = {r.id: r.cluster for r in labelled.collect()}
    tree = merges.collect()
    for group, base, data in (("a", 0, points), ("b", 100, small)):
        cut, heights = _greedy(data, method, 4)
        assert {i: got[base + i] - base for i in cut} == cut
        found = sorted(r.height for r in tree if r.grp == group)
        assert np.allclose(found, heights)
    assert len(got) == len(rows)


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70)]
    nodes = [(i,) for i in [*range(31), 50, 70, 100, 200]]
    out = components(
        spark.createDataFrame(nodes, "node long"), spark.createDataFrame(edges, "a long, b long")
    )
    label = {r.node: r.label for r in out.collect()}
    assert {label[i] for i in range(31)} == {0}
    assert (label[50], label[70], label[100], label[200]) == (50, 50, 50, 200)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(9)
    centres = np.array([[0, 0, 0], [20, 0, 0], [0, 30, 0]])
    points = np.concatenate([rng.normal(size=(20, 3)) + c for c in centres])
    rows = [(i, *map(float, p), 4.0) for i, p in enumerate(points)]
    return points, spark.createDataFrame(
        rows, "id long, x double, y double, z double, same double"
    ).persist()


def test_standardised_columns(blobs):
    points, df = blobs
    out = standardise(df, ["x", "same"]).agg(
        F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.max(F.abs("same")).alias("c")
    ).first()
    assert (out.m, out.s, out.c) == (pytest.approx(0, abs=1e-12), pytest.approx(1), 0)


def test_kmeans_and_elbow(blobs):
    points, df = blobs
    found = kmeans(df, "id", ["x", "y", "z"], 3).collect()
    assert {r.id: r.cluster for r in found} == {i: i // 20 for i in range(60)}
    costs = {r.k: r.inertia for r in elbow(df, "id", ["x", "y", "z"], 4).collect()}
    assert costs[1] == pytest.approx(((points - points.mean(0)) ** 2).sum())
    within = sum(((p - p.mean(0)) ** 2).sum() for p in points.reshape(3, 20, 3))
    assert costs[3] == pytest.approx(within)


def test_kmeans_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in p], "t") for i, p in enumerate(rng.normal(size=(200, 4)))]
    rows += [(900, None, "t"), (901, [1.0, None, 0.0, 0.0], "t"), (902, [float("nan")] * 4, "t")]
    df = spark.createDataFrame(rows, "id long, at array<double>, x string")

    def labels(parts):
        found = kmeans(df.repartition(parts), "id", "at", 5)
        assert found.columns == ["id", "at", "x", "cluster"]
        return {r.id: r.cluster for r in found.collect()}

    one = labels(1)
    assert one == labels(7)
    assert {one[900], one[901], one[902]} == {None} and set(one.values()) == {None, *range(5)}
    costs = [r.inertia for r in elbow(df, "id", "at", 6).orderBy("k").collect()]
    assert len(costs) == 6 and costs == sorted(costs, reverse=True)


def test_kmeans_of_few_points_and_none(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 5.0)], "id long, a double")
    assert {r.id: r.cluster for r in kmeans(df, "id", ["a"], 4).collect()} == {1: 0, 2: 0, 3: 1}
    assert [r.inertia for r in elbow(df, "id", ["a"], 3).orderBy("k").collect()] == [6.0, 0.0, 0.0]
    assert kmeans(df.limit(0), "id", ["a"], 2).collect() == []
    assert elbow(df.limit(0), "id", ["a"], 2).collect() == []


def test_nearest_takes_the_first_of_equally_near_centres():
    x = np.array([[0.5, 0.0], [1e8 + 0.5, 0.0]])
    centres = np.array([[1.0, 0.0], [0.0, 0.0], [1e8 + 1, 0.0], [1e8, 0.0]])
    assert nearest(x, centres)[0].tolist() == [0, 2]


def test_principal_components(blobs):
    points, df = blobs
    centred = points - points.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:2] * np.array([[1 if abs(a.max()) >= abs(a.min()) else -1] for a in axes[:2]])
    got = principal_pair(df, ["x", "y", "z"]).orderBy("id").select("pca1", "pca2").collect()
    assert np.allclose(np.array(got), centred @ axes.T)


def test_regions_of_two_images(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(30, 2)), rng.normal(size=(30, 2)) + 40])
    rows = [("one", i, *map(float, p)) for i, p in enumerate(points)]
    rows += [("none", 100 + i, float(i * i), float(i % 3)) for i in range(8)]
    df = spark.createDataFrame(rows, "image string, id long, x double, y double")
    found = point_regions(df, "image", "id", "x", "y").orderBy("cluster").collect()
    assert [(r.image, r.cluster, r.points) for r in found] == [("one", 0, 30), ("one", 30, 30)]
    low, high = points[:30].min(0), points[:30].max(0)
    assert found[0].left == int(low[0] - (high[0] - low[0]) / 20)
    assert found[0].width == int((high[0] - low[0]) * 1.1)
