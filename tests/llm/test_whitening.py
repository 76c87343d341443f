"""Exact spectra and whitening against plain arithmetic and NumPy."""

import random

import numpy as np
import pytest

from tallyframe.llm.charpoly import (
    charpoly_mod,
    coefficient_bound,
    combine,
    isolate,
    null_vectors,
    primes_below,
    roots_above,
)
from tallyframe.llm.whitening import characteristic_polynomial, whiten


def plain_charpoly(a):
    """Faddeev-LeVerrier in whole numbers."""
    d = len(a)
    m, coefficients = [[0] * d for _ in range(d)], [1]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + coefficients[-1] * (i == j) for j in range(d)] for i in range(d)]
        am = [[sum(a[i][t] * m[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        coefficients.append(-sum(am[i][i] for i in range(d)) // k)
    return coefficients[::-1]


def gram(d, rank, size, seed):
    r = random.Random(seed)
    b = [[r.randint(-size, size) for _ in range(d)] for _ in range(rank)]
    return [[sum(row[i] * row[j] for row in b) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("d,rank,size", [(1, 1, 9), (2, 1, 5), (5, 5, 10**12), (9, 4, 50), (12, 12, 1)])
def test_charpoly_is_exact(spark, d, rank, size):
    a = gram(d, rank, size, d)
    assert characteristic_polynomial(spark, a) == plain_charpoly(a)


def test_charpoly_where_pivots_vanish():
    a = [[0, 0, 2, 0], [0, 0, 0, 3], [2, 0, 0, 0], [0, 3, 0, 0]]
    primes = primes_below(1 << 31, 4)
    assert combine({p: charpoly_mod(np.array(a), p) for p in primes}) == plain_charpoly(a)
    assert coefficient_bound(a) >= max(map(abs, plain_charpoly(a)))
    assert primes_below(30, 5) == [29, 23, 19, 17, 13]


def test_roots_and_their_spaces():
    poly = [-6 * 4, 6 + 4 * 11, -(11 + 4 * 6), 6 + 4, -1]  # (1-x)(2-x)(3-x)(x-4), sign apart
    assert [roots_above(poly, 5 * k, 1) for k in range(3)] == [4, 2, 0]
    a = [[7 * (i == j) for j in range(4)] for i in range(4)]
    a[3][3] = 2
    poly = plain_charpoly(a)
    numerator, bits, first, last = isolate(poly, 2)
    assert (round(numerator / 2**bits, 9), first, last) == (7.0, 1, 3)
    space = np.array(null_vectors(a, numerator, bits, 3))
    assert np.abs(space @ space.T - np.eye(3)).max() < 1e-15
    assert np.abs(space @ np.array(a) - 7 * space).max() < 1e-15


def check(spark, x, rows=None):
    df = spark.createDataFrame(rows or [(k, list(map(float, v))) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    return whiten(df.repartition(3)).collect()


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) / 7
    rows = check(spark, x)
    whole = np.floor(1024 * x).astype(np.int64) + 100_000
    n, sums = len(x), whole.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(whole.T, bias=True))
    assert len(rows) == 300 * 8
    for r in rows:
        e, v = values[-r.component], vectors[:, -r.component]
        centred = whole[r.vec_id] - sums / n
        assert r.n == n and r.deviation == int(((n * whole[r.vec_id] - sums) ** 2).sum())
        assert abs(abs(r.whitened) - abs(centred @ v) / np.sqrt(e)) < 1e-8
        assert r.explained == pytest.approx(e / values.sum(), rel=1e-10)
        assert r.identity_error < 1e-9
    white = np.zeros((300, 8))
    for r in rows:
        white[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(np.cov(white.T, bias=True) - np.eye(8)).max() < 1e-9


def test_equal_eigenvalues(spark):
    x = np.vstack([np.eye(4), -np.eye(4)])
    rows = check(spark, x)
    assert len(rows) == 32 and all(r.explained == pytest.approx(0.25) for r in rows)
    assert all(r.identity_error < 1e-9 for r in rows)


def test_given_embeddings_are_whitened(spark):
    rows = whiten(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")).collect()
    assert rows and all(r.identity_error < 1e-9 for r in rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [k * 0.5, k % 3 * 1.0]) for k in range(6)]
    bad = [(10, None), (11, [1.0, None]), (12, [nan, 1.0]), (13, [inf, 1.0]), (14, [1.0]), (15, [])]
    rows = check(spark, None, good + [(0, [0.0, 0.0]), (None, [1.0, 2.0])] + bad)
    assert len(rows) == 8 * 2 and {r.n for r in rows} == {8}
    assert sum(r.vec_id is None for r in rows) == 2 and sum(r.vec_id == 0 for r in rows) == 4
    alone = check(spark, None, [(1, [1.0, 2.0])])
    assert [(r.deviation, r.whitened, r.explained) for r in alone] == [(0, None, None)] * 2
    flat = check(spark, None, [(1, [1.0, 2.0]), (2, [2.0, 2.0])])
    assert [r.whitened is None for r in sorted(flat, key=lambda r: r.component)] == [False] * 2 + [True] * 2
    huge = check(spark, None, [(1, [1e300, 2.0]), (2, [-1e300, 1.0]), (3, [5.0, 1e12])])
    assert len(huge) == 6 and all(r.deviation is None for r in huge)
    assert all(r.identity_error < 1e-6 for r in huge)
    assert check(spark, None, [(1, None)]) == [] and check(spark, None, [(1, [])]) == []


def test_clashing_columns_and_types(spark):
    df = spark.sql(
        "select cast(id as string) as vec_id, array(float(id), float(id * id % 7)) as embedding, "
        "1 as id, 'x' as N, 2 as y, 3 as component from range(9) as t(id)"
    )
    found = whiten(df)
    assert found.columns == "vec_id component n deviation whitened explained identity_error".split()
    assert found.count() == 18 and dict(found.dtypes)["vec_id"] == "string"
