"""Whitened principal components of integer vectors, from an exact characteristic polynomial."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.charpoly import (
    charpoly_mod,
    coefficient_bound,
    combine,
    isolate,
    null_vectors,
    primes_below,
    reduce_matrix,
)

LONGEST = (1 << 63) - 1
MOST = 1 << 50  # scaled entries are held within this, far from where a long ends
EXACT_ROWS, EXACT_ENTRY = 1 << 12, 1 << 20  # sums of so many such squares are exact in a double
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> tuple[DataFrame, int]:
    """Rows that take part as ``id`` and ``y = floor(scale * entry)``, and their dimension.

    Left out: vectors that are null, hold a null or a number that is not finite, or differ in
    dimension from most vectors (of equally many, from the longest).
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = df.filter(vector.isNotNull()).filter(~bad)
    sizes = whole.groupBy(F.size(vector).alias("d")).count()
    top = sizes.orderBy(F.col("count").desc(), F.col("d").desc()).first()
    d = int(top.d) if top else 0
    scaled = F.transform(
        vector,
        lambda c: F.floor(F.greatest(F.least(c * float(scale), F.lit(float(MOST))), F.lit(-float(MOST)))),
    )
    kept = whole.filter(F.size(vector) == d)
    return kept.select(F.col(f"`{id_col}`").alias("id"), scaled.alias("y")), d


def matrix_of(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _products(y: np.ndarray) -> np.ndarray:
    """The sum of outer products as whole Python numbers."""
    d = y.shape[1]
    total = np.zeros((d, d), object)
    large = np.abs(y).max(axis=1, initial=0) >= EXACT_ENTRY
    plain = y[~large].astype(np.float64)
    for start in range(0, len(plain), EXACT_ROWS):
        part = plain[start : start + EXACT_ROWS]
        total += (part.T @ part).astype(np.int64).astype(object)
    if large.any():
        rest = y[large].astype(object)
        total += rest.T @ rest
    return total


def _moments(d: int):
    """Per task: the count at (-1, -1), sums at (-1, j), products at (i, j) for i <= j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            if batch.num_rows:
                y = matrix_of(batch.column("y"), d)
                n += len(y)
                sums += y.astype(object).sum(axis=0) if np.abs(y).max() > MOST >> 20 else y.sum(axis=0)
                products += _products(y)
        if n:
            rows = [(-1, -1, n)] + [(-1, j, int(sums[j])) for j in range(d)]
            rows += [(i, j, int(products[i, j])) for i in range(d) for j in range(i, d)]
            i, j, values = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(i, pa.int32()),
                    pa.array(j, pa.int32()),
                    pa.array([str(v) for v in values]),
                ],
                names=["i", "j", "value"],
            )

    return run


def moments(vectors: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums and sums of products, exact; what reaches the driver depends on ``d`` alone."""
    parts = vectors.select("y").mapInArrow(_moments(d), "i int, j int, value string")
    whole = parts.groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    n, sums, products = 0, [0] * d, [[0] * d for _ in range(d)]
    for i, j, value in whole.collect():
        if j < 0:
            n = int(value)
        elif i < 0:
            sums[j] = int(value)
        else:
            products[i][j] = products[j][i] = int(value)
    return n, sums, products


def _residues(matrix: list[list[int]], primes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                p = primes[k]
                reduced = np.array([[v % p for v in row] for row in matrix], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p]), pa.array([charpoly_mod(reduced, p)], pa.list_(pa.int64()))],
                    names=["p", "residues"],
                )

    return run


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(xI - A), lowest first, for an integer matrix; one task per few primes."""
    bits = (2 * coefficient_bound(matrix)).bit_length()
    primes = primes_below(1 << 31, bits // 30 + 1)
    tasks = min(len(primes), max(spark.sparkContext.defaultParallelism, 1))
    found = spark.range(0, len(primes), 1, tasks).mapInArrow(
        _residues(matrix, primes), "p long, residues array<long>"
    )
    return combine({r.p: list(r.residues) for r in found.collect()})


def _components(matrix: list[list[int]], poly: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rank in batch.column(0).to_pylist():
                numerator, bits, first, _ = isolate(poly, rank)
                if numerator == 0:
                    continue
                vectors = null_vectors(matrix, numerator, bits, rank - first + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rank]),
                        pa.array([str(numerator)]),
                        pa.array([bits]),
                        pa.array([vectors[-1].tolist()], pa.list_(pa.float64())),
                    ],
                    names=["rank", "numerator", "bits", "vector"],
                )

    return run


def principal_components(
    spark: SparkSession, scatter: list[list[int]], count: int
) -> list[tuple[Fraction, list[float]]]:
    """The ``count`` largest positive eigenvalues with their unit vectors, a task each.

    Equal eigenvalues take orthonormal vectors of their space. The sign of a vector makes its
    largest entry positive. Eigenvalues of zero are left out.
    """
    reduced, divisor = reduce_matrix(scatter)
    if not divisor:
        return []
    poly = characteristic_polynomial(spark, reduced)
    tasks = spark.range(1, count + 1, 1, count)
    found = tasks.mapInArrow(
        _components(reduced, poly), "rank long, numerator string, bits long, vector array<double>"
    )
    rows = sorted(found.collect(), key=lambda r: r["rank"])
    return [(Fraction(int(r.numerator) * divisor, 1 << r.bits), list(r.vector)) for r in rows]


def _project(n: int, sums: list[int], axes: np.ndarray, total: int):
    """Deviation and whitened coordinates of every row."""
    d = len(sums)
    largest_sum = max(abs(s) for s in sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = matrix_of(batch.column("y"), d)
            reach = int(np.abs(y).max()) * n + largest_sum
            kind = np.int64 if reach * reach * d <= LONGEST else object
            apart = y.astype(kind) * n - np.array(sums, kind)
            squares = [int(v) for v in (apart * apart).sum(axis=1)]
            white = apart.astype(np.float64) @ axes
            coordinates = [row.tolist() + [None] * (total - len(row)) for row in white]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([v if v <= LONGEST else None for v in squares], pa.int64()),
                    pa.array(coordinates, pa.list_(pa.float64())),
                ],
                names=["id", "deviation", "white"],
            )

    return run


def whiten(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = 8,
    scale: int = 1024,
) -> DataFrame:
    """Whitened coordinates of every row on the leading principal components.

    An entry c becomes x = floor(scale * c), plus any constant: sums of squares around the mean do
    not see it, so none is added here. Counts, sums and products of x are added up exactly; the scatter
    matrix n * sum(x x') - S S' holds whole numbers, so its characteristic polynomial is exact, its
    roots are isolated to 160 bits and its null vectors iterated with 320. Returns ``id_col`` and
    per component (from 1, largest first; as many as there are dimensions, ``components`` at most)
    ``n``, ``deviation`` (sum over dimensions of (n x - S)**2), ``whitened``, ``explained`` and
    ``identity_error``, the largest entry of the whitened covariance minus the identity, measured
    in a pass of its own over the whitened rows.

    The data are read four times (dimension, moments, error, result) and shuffle only moments of a
    size set by the dimension; the polynomial's primes and the components are tasks of their own.

    Rows whose vector is null, holds a null or non-finite entry, or differs in dimension from most
    take no part. Null ids and repeated rows: rows like any other. Entries beyond 2**50 / scale
    count as that. A deviation beyond a long is null. A component without variance (equal rows, a
    single row) has null ``whitened``; ``explained`` is null where no component has any, and so is
    ``identity_error``. Empty tables, and vectors of no dimension: no rows. Other columns are not
    returned, whatever their names.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    vectors, d = integer_vectors(df, id_col, vector_col, scale)
    named = F.col("id").alias(id_col)
    if d == 0:
        return spark.createDataFrame([], f"`{id_col}` {id_type}, {RESULT}")
    n, sums, products = moments(vectors, d)
    scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    total = min(components, d)
    found = principal_components(spark, scatter, total)
    trace = sum(scatter[i][i] for i in range(d))
    axes = np.zeros((d, len(found)))
    for k, (value, vector) in enumerate(found):
        # the square root of a whole number of many bits, so that it is right to the last place
        root = isqrt((value.numerator << 256) // value.denominator)
        axes[:, k] = np.array(vector) / float(Fraction(root, 1 << 128))
    share = [float(value / trace) for value, _ in found]
    share += [0.0 if trace else None] * (total - len(found))
    white = vectors.mapInArrow(
        _project(n, sums, axes, total), f"id {id_type}, deviation long, white array<double>"
    )
    error = None
    if found:
        entries = [
            F.abs(F.covar_pop(F.col("white")[i], F.col("white")[j]) - float(i == j))
            for i in range(len(found))
            for j in range(i, len(found))
        ]
        error = white.agg(F.array_max(F.array(*entries)).alias("error")).first().error
    explained = F.array(*[F.lit(s).cast("double") for s in share])
    return white.select(
        named, "deviation", F.posexplode("white").alias("at", "whitened")
    ).select(
        F.col(f"`{id_col}`"),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("at")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
