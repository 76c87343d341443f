"""Hard negatives against a plain search, in one block and in many."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.llm.hard_negatives import mine_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, SCORE string, anchor string"


def mine(spark, rows, **more):
    df = spark.createDataFrame([(*r, "s", "a") for r in rows], SCHEMA).repartition(3)
    found = mine_hard_negatives(df, F.col("vec_id") % 10 == 0, **more)
    return sorted(tuple(r) for r in found.collect())


def plain(rows, k=5, n=5, lowest=80, highest=100):
    taken = set()
    for i, v, label in rows:
        if i is not None and label is not None and v and all(c is not None and math.isfinite(c) for c in v):
            taken.add((i, label, tuple(math.floor(256 * c) for c in v)))
    out = []
    for i, label, x in taken:
        if i % 10:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, l) for j, l, y in taken)
        for minus, j, _ in [s for s in scored if s[2] == label and s[1] != i][:k]:
            fits = [s for s in scored if s[2] != label and lowest * -minus <= 100 * -s[0] <= highest * -minus]
            out += [(i, j, r, s[1], -minus, -s[0]) for r, s in enumerate(fits[:n], 1)]
    return sorted(out)


def some(n, d=3, labels=3, seed=1, size=2.0):
    r = random.Random(seed)
    return [(k, [r.uniform(-size, size) for _ in range(d)], r.randrange(labels)) for k in range(n)]


@pytest.mark.parametrize("block", [50_000, 7])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_search(spark, block, seed):
    rows = some(120, seed=seed)
    found = mine(spark, rows, block_rows=block)
    assert found == plain(rows) and len(found) > 100


def test_ties_copies_and_hot_label(spark):
    rows = [(k, [1.0, 0.5], 0) for k in range(60)] + [(100 + k, [1.0, 0.25 * (k % 3)], 1) for k in range(60)]
    rows += rows[:20] + [(10, [0.5, 0.5], 2), (10, [1.0, 1.0], 0), (70, [1.0, 0.5], 0)]
    found = mine(spark, rows, block_rows=16)
    assert found == plain(rows) and found


def test_other_shares_and_counts(spark):
    rows = some(90, seed=5)
    found = mine(spark, rows, positives=3, negatives=2, lowest=10, highest=50)
    assert found == plain(rows, 3, 2, 10, 50) and found


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = some(40, seed=9)
    odd = [(None, [1.0, 1.0, 1.0], 0), (200, None, 0), (210, [1.0, None, 2.0], 1), (220, [nan, 0.0, 0.0], 1)]
    odd += [(230, [inf, 0.0, 0.0], 1), (240, [1.0, 1.0, 1.0], None), (250, [], 1)]
    assert mine(spark, rows + odd) == plain(rows + odd)
    # another dimension than most takes no part
    assert mine(spark, rows + [(300, [1.0, 1.0], 0)]) == plain(rows)
    # too few rows, one label only, opposite positives, no rows
    few = [(0, [1.0], 0), (1, [1.0], 0), (2, [0.9], 1)]
    assert mine(spark, few) == plain(few) == [(0, 1, 1, 2, 65536, 58880)]
    assert mine(spark, [r for r in rows if r[2] == 0]) == []
    away = [(0, [1.0], 0), (1, [-1.0], 0), (2, [-1.0], 1)]
    assert mine(spark, away) == plain(away) == []
    assert mine(spark, []) == []


def test_entries_near_the_ends(spark):
    rows = [(0, [1e300, 1.0], 0), (1, [1e300, -1.0], 0), (2, [9e299, 3.0], 1), (3, [1e5, 1e5], 1)]
    found = mine(spark, rows)
    # held at the largest entry whose inner products fit: rows 0 to 2 then differ in one entry
    assert [(r[0], r[1]) for r in found] in ([], [(0, 1)])
    big = [(k, [c * 2.0**18 for c in v], label) for k, v, label in some(60, seed=4)]
    assert mine(spark, big) == plain(big)
