"""Density clusters in space against a plain search."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.operators import density
from tallyframe.operators.density import dbscan_space, within
from tallyframe.operators.space_tree import grow, leaf_boxes, visits


def plain(points, eps, least):
    """{key: (cluster, is_core)} of points [(key, group, coordinates)]."""
    fine = [p for p in points if all(c is not None and math.isfinite(c) for c in p[2])]
    near = {p[0]: [q[0] for q in fine if q[1] == p[1] and math.dist(p[2], q[2]) <= eps] for p in fine}
    core = {k for k, v in near.items() if len(v) >= least}
    name = {k: k for k in core}
    changed = True
    while changed:
        changed = False
        for k in core:
            low = min(name[j] for j in near[k] if j in core)
            if low < name[k]:
                name[k], changed = low, True
    found = {p[0]: (None, False) for p in points}
    for k, v in near.items():
        if k in core:
            found[k] = (name[k], True)
        elif any(j in core for j in v):
            found[k] = (min(name[j] for j in v if j in core), False)
    return found


def run(spark, points, eps, least, by=None, **more):
    df = spark.createDataFrame(points, "key long, g string, at array<double>").repartition(5)
    found = dbscan_space(df, "key", "at", eps, least, by, **more).collect()
    return {r.key: (r.cluster, r.is_core) for r in found}


def cloud(n, d, seed):
    r = random.Random(seed)
    centres = [[r.uniform(0, 10) for _ in range(d)] for _ in range(6)]
    points = []
    for k in range(n):
        c = r.choice(centres)
        at = [x + r.gauss(0, 0.6) for x in c] if k % 5 else [r.uniform(0, 10) for _ in range(d)]
        points.append((k, "ab"[k % 3 == 0], at))
    return points


@pytest.mark.parametrize("leaf,eps", [(10, 0.7), (25, 0.5), (2000, 0.7)])
def test_three_dimensions(spark, leaf, eps):
    points = cloud(400, 3, leaf)
    expected = plain([(k, "", c) for k, _, c in points], eps, 5)
    assert run(spark, points, eps, 5, leaf=leaf) == expected
    assert len({c for c, _ in expected.values()}) > 3
    assert any(c is not None and not core for c, core in expected.values())


def test_groups_copies_ties_and_bad_rows(spark):
    points = cloud(150, 3, 1) + [(1000 + k, "a", [5.0, 5.0, 5.0]) for k in range(60)]
    # a grid whose steps are exactly the radius, and a group that is null
    points += [(2000 + k, "grid", [k % 4 * 0.5, k // 4 % 4 * 0.5, k // 16 * 0.5]) for k in range(48)]
    points += [(3000 + k, None, [0.1 * k, 0.0, 0.0]) for k in range(20)]
    points += [(4000, "a", [None, 1.0, 1.0]), (4001, "a", [float("nan"), 0.0, 0.0])]
    assert run(spark, points, 0.5, 4, by="g", leaf=12) == plain(points, 0.5, 4)


def test_radius_over_everything_and_no_rows(spark):
    points = [(k, "a", [float(k % 7), float(k % 5), 0.0]) for k in range(60)]
    assert set(run(spark, points, 100.0, 5, leaf=8).values()) == {(0, True)}
    assert set(run(spark, points, 1e-3, 5, leaf=8).values()) == {(None, False)}
    assert run(spark, [], 1.0, 5) == {}


def test_tree_leaves_are_bounded_and_visited(spark):
    r = random.Random(2)
    rows = [("g", str(k), [r.gauss(0, 1) for _ in range(4)]) for k in range(3000)]
    rows += [("h", str(k), [1.0, 2.0, 3.0, float(k == 0)]) for k in range(50)]
    points = spark.createDataFrame(rows, "grp string, id string, c array<double>")
    tree = grow(points, 40)
    assert tree.points.count() == 3050
    largest = tree.points.filter("grp = 'g'").groupBy("node").count().agg({"count": "max"}).first()[0]
    assert largest <= 40 and len(tree.rounds) >= 2
    # a point reaches its own leaf, and only that if its box is the point
    boxes = tree.points.selectExpr("grp", "id", "node as own", "c as low", "c as high")
    seen = visits(tree, boxes)
    assert seen.filter("node = own").count() == 3050 == seen.count()
    assert leaf_boxes(tree.points).count() == tree.points.select("grp", "node").distinct().count()


def test_pairs_next_to_the_radius():
    import numpy as np

    a = np.array([[1e6, 0.1], [0.3, 0.0]])
    b = np.array([[1e6 + 0.5, 0.1], [0.1 + 0.2, 0.5]])
    assert within(a, b, 0.5).tolist() == [[True, False], [False, math.dist(a[1], b[1]) <= 0.5]]


@pytest.mark.parametrize("strips,most", [(12, 1 << 20), (3, 1), (5, 0), (2, 0)])
def test_strips_and_visits_give_the_same(spark, monkeypatch, strips, most):
    monkeypatch.setattr(density, "STRIPS", strips)
    monkeypatch.setattr(density, "MOST_VISITS", most)
    points = cloud(300, 5, 8) + [(k + 1000, g, c) for k, g, c in cloud(40, 5, 8)]
    points += [(5000, "a", [1.0, None, 2.0, 0.0, 0.0]), (5001, None, [0.0] * 5)]
    assert run(spark, points, 2.2, 6, "g", leaf=20) == plain(points, 2.2, 6)


def test_wide_reach_ships_a_point_once_a_strip(spark, monkeypatch):
    """In many dimensions a point is near all leaves; it is not sent to each of them."""
    points = [(k, "", [random.Random(k * 64 + d).gauss(0, 1) for d in range(16)]) for k in range(400)]
    sent = []

    def counted(one):
        def seen(*args):
            made = one(*args)
            sent.append(made.count())
            return made

        return seen

    monkeypatch.setattr(density, "STRIPS", 4)
    monkeypatch.setattr(density, "_strips", counted(density._strips))
    monkeypatch.setattr(density, "_meet", None)  # leaves and their visitors don't meet
    assert run(spark, points, 3.5, 5, leaf=10) == plain(points, 3.5, 5)
    assert sent == [1600, 1600]


@pytest.mark.parametrize("same", [True, False])
def test_pairs_of_strips_by_tiles(monkeypatch, same):
    monkeypatch.setattr(density, "TILE", 7)
    draw = np.random.default_rng(4)
    at = np.concatenate([draw.normal(0, 1, (40, 2)), draw.normal(6, 1, (40, 2))])
    strip = np.zeros(80, int) if same else np.arange(80) % 2
    core = draw.random(80) < 0.7
    ids = [f"p{k:02}" for k in range(80)]
    table = pa.table(
        {
            "id": ids, "node": [f"n{k % 5}" for k in range(80)], "c": at.tolist(), "w": np.arange(1, 81),
            "strip": strip, "is_core": core, "i": [0] * 80, "j": [0 if same else 1] * 80,
        }
    )
    near = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2)) <= 0.8
    if not same:
        near &= strip[:, None] != strip[None]
    counts = density._count_strips(0.8)(table).to_pydict()
    wanted = {k: n for k, n in zip(ids, (near @ np.arange(1, 81)).tolist()) if n}
    assert dict(zip(counts["id"], counts["near"])) == wanted
    links = density._link_strips(0.8)(table).to_pylist()
    edges = {(r["a"], r["b"]) for r in links if not r["core"]}
    assert edges == {(ids[k], ids[m]) for k, m in zip(*np.nonzero(near)) if core[m] and not core[k]}
    joined = np.eye(80, dtype=bool)
    for r in links:
        if r["core"]:
            joined[ids.index(r["a"]), ids.index(r["b"])] = joined[ids.index(r["b"]), ids.index(r["a"])] = True
    both = np.eye(80, dtype=bool) | (near & core[:, None] & core[None])
    assert (np.linalg.matrix_power(joined.astype(float), 80) > 0).tolist() == (
        np.linalg.matrix_power(both.astype(float), 80) > 0
    ).tolist()
