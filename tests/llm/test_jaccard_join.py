"""Jaccard components against brute force, with regions that pivots divide again and again."""

import random
import time

import numpy as np
import pytest

from tallyframe.llm import jaccard_join
from tallyframe.llm.jaccard_join import jaccard_components


def shingle_sets(rows):
    found = {}
    for doc_id, text in rows:
        listed = (text or "").lower().split()
        n = max(len(listed) - 2, 1) if listed else 0
        found.setdefault(doc_id, []).append({tuple(listed[p : p + 3]) for p in range(n)})
    return found


def brute_force(rows, num, den):
    sets = [(d, s) for d, each in shingle_sets(rows).items() for s in each]
    label = {d: d for d, _ in sets}
    links = [
        (a, b)
        for i, (a, x) in enumerate(sets)
        for b, y in sets[:i]
        if x and y and den * len(x & y) >= num * len(x | y)
    ]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def families(seed, groups=5, members=30):
    """Texts that drift away from a few origins, all with one passage in common."""
    rng = random.Random(seed)
    passage = " ".join(f"shared{i}" for i in range(12))
    rows = []
    for g in range(groups):
        origin = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([40, 80, 120]))]
        last = origin
        for _ in range(members):
            near = list(rng.choice([origin, last]))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                near[rng.randrange(len(near))] = f"w{rng.randrange(10**6)}"
            last = near
            rows.append((len(rows), " ".join(near) + " " + passage))
    rows += [(10_000, None), (10_001, ""), (10_002, "two words"), (10_003, "TWO words")]
    return rows


@pytest.mark.parametrize(("num", "den"), [(90, 100), (60, 100), (1, 3)])
@pytest.mark.parametrize("frequent", [False, True])
def test_divided_regions_keep_every_link(spark, monkeypatch, num, den, frequent):
    if frequent:  # every text is sampled, shingles of two texts are frequent
        monkeypatch.setattr(jaccard_join, "SAMPLE", 1)
        monkeypatch.setattr(jaccard_join, "LEAST", 2)
    turns = []
    cut = jaccard_join.cut_lineage

    def counted(df, name="step"):
        turns.append(name)
        return cut(df, name)

    monkeypatch.setattr(jaccard_join, "cut_lineage", counted)
    rows = families(num)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = jaccard_components(df, num=num, den=den, pivots=6, block=8)
    found = {r.doc_id: r.component_id for r in made.collect()}
    assert found == brute_force(rows, num, den)
    if frequent and num == 90:
        assert turns.count("divided") >= 3


def test_ids_with_several_texts_and_repeated_rows(spark):
    rows = families(7, groups=2, members=12)
    rows = [(d // 2, t) for d, t in rows] + rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in jaccard_components(df, pivots=3, block=4).collect():
        found.setdefault(r.doc_id, set()).add(r.component_id)
    expected = brute_force(rows, 90, 100)
    assert {d: {c} for d, c in expected.items()} == found


def test_long_texts(spark):
    rng = random.Random(3)
    rows = []
    for size in (1_100, 2_040, 2_200, 9_000):
        origin = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for share in (0, 0.01, 0.012, 0.03, 0.05, 0.5):
            near = list(origin) + ["more"] * int(size * share)
            for p in rng.sample(range(size), int(size * share)):
                near[p] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(near)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard_components(df).collect()}
    assert found == brute_force(rows, 90, 100)
    assert 4 < len(set(found.values())) < len(rows)


def test_first_shingles_are_the_rarest_of_the_sample():
    found = np.arange(1, 41, dtype=np.uint64)
    counted, numbers = np.array([1, 2, 3, 4, 50], np.uint64), np.array([2, 9, 9, 3, 9], np.int32)
    n, _, _, rare, often, _, _ = jaccard_join._described(counted, numbers, 9, 90, 100)(found)
    assert (n, rare, often) == (40, [5, 6, 7, 8, 9], 0)
    few = found[:4]  # of four, all count where a quarter links: two rare, two frequent ones
    n, _, _, rare, often, _, _ = jaccard_join._described(counted, numbers, 9, 25, 100)(few)
    assert (n, rare, often) == (4, [1, 4], 2)


def test_describing_a_set_does_not_sort_the_frequent_shingles():
    rng = np.random.default_rng(0)
    counted = np.unique(rng.integers(0, 2**63, 1 << 19, dtype=np.uint64))
    row = jaccard_join._described(counted, np.full(len(counted), 9, np.int32), 9, 90, 100)
    sets = [np.sort(rng.choice(counted, 500, replace=False, shuffle=False)) for _ in range(40)]
    began = time.process_time()
    assert all(row(found)[4] == 51 for found in sets)
    assert time.process_time() - began < 1.0
