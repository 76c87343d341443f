"""Exact spectra of symmetric integer matrices.

The characteristic polynomial comes from Hessenberg reductions modulo word-size primes, put
together by the Chinese remainder theorem. All its roots are real, so Descartes' rule of signs
counts the roots above a point exactly, by the signs of the shifted polynomial; halving intervals
by that count isolates a root to any number of bits. Unit vectors come from inverse iteration with
fixed-point numbers of many bits.
"""

from __future__ import annotations

from math import gcd, isqrt

import numpy as np


def primes_below(start: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``start`` (at most 2**31, so that products fit 64 bits)."""
    found, n = [], start - 1
    while len(found) < count:
        if n % 2 and _is_prime(n):
            found.append(n)
        n -= 1
    return found


def _is_prime(n: int) -> bool:
    # 2, 3, 5 and 7 as bases settle every number below 3,215,031,751
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def charpoly_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(xI - A) modulo ``p``, lowest first; ``matrix`` is reduced modulo ``p``."""
    h = matrix.astype(np.int64) % p
    d = len(h)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        pivot = k + int(below[0])
        if pivot != k:  # a similarity swaps rows and columns alike
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        factor = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - factor[:, None] * h[k][None, :] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factor[None, :] % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        weights = np.zeros(k, np.int64)  # of the k smaller polynomials
        product = 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * product % p
            if i:
                product = product * int(h[i, i - 1]) % p
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - (weights[:, None] * polys[:k] % p).sum(axis=0)) % p
    return [int(c) for c in polys[d]]


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient exceeds this: minors are at most the product of their rows' lengths."""
    bound = 1
    for row in matrix:
        bound *= 1 + isqrt(sum(v * v for v in row)) + 1
    return bound


def reduce_matrix(matrix: list[list[int]]) -> tuple[list[list[int]], int]:
    """The matrix without the common divisor of its entries, and that divisor."""
    divisor = gcd(*[v for row in matrix for v in row])
    return ([[v // divisor for v in row] for row in matrix], divisor) if divisor else (matrix, 0)


def combine(residues: dict[int, list[int]]) -> list[int]:
    """Integers of least absolute value with the given remainders, by prime."""
    whole = 1
    for p in residues:
        whole *= p
    degree = len(next(iter(residues.values())))
    totals = [0] * degree
    for p, values in residues.items():
        others = whole // p
        lift = others * pow(others % p, -1, p)
        for k in range(degree):
            totals[k] += values[k] * lift
    return [t % whole - whole if 2 * (t % whole) > whole else t % whole for t in totals]


def roots_above(poly: list[int], numerator: int, bits: int) -> int:
    """How many roots (by multiplicity) exceed ``numerator / 2**bits``; all must be real."""
    d = len(poly) - 1
    shifted = [c << (bits * (d - k)) for k, c in enumerate(poly)]  # roots times 2**bits
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            shifted[k] += numerator * shifted[k + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def isolate(poly: list[int], rank: int, precision: int = 160) -> tuple[int, int, int, int]:
    """The root of a rank (from 1, largest first): ``(numerator, bits, first, last)``.

    The root lies in (numerator - 1, numerator] over 2**bits, an interval of about
    2**-precision of the largest root, and is the one of ranks ``first`` to ``last`` there.
    A root of zero gives numerator 0.
    """
    # roots are not negative, so their sum bounds the largest
    trace = -poly[-2] if len(poly) > 1 else 0
    top = max(trace, 1).bit_length()
    if roots_above(poly, 0, 0) < rank:
        return 0, 0, roots_above(poly, 0, 0) + 1, len(poly) - 1
    low, high, bits = 0, 1 << top, 0
    while high - low > 1:  # roots_above(low) >= rank > roots_above(high)
        middle = (low + high) // 2
        if roots_above(poly, middle, 0) >= rank:
            low = middle
        else:
            high = middle
    for bits in range(1, max(precision - top, 40) + 1):
        low, high = 2 * low, 2 * high
        if roots_above(poly, low + 1, bits) >= rank:
            low += 1
        else:
            high -= 1
    return high, bits, roots_above(poly, high, bits) + 1, roots_above(poly, low, bits)


def null_vectors(
    matrix: list[list[int]], numerator: int, bits: int, count: int, precision: int = 320
) -> list[np.ndarray]:
    """``count`` orthonormal vectors for the root ``numerator / 2**bits``, to double precision.

    Inverse iteration with fixed-point numbers of ``precision`` bits below the point; starts are
    fixed, and vectors of one root are made orthogonal to those before.
    """
    d = len(matrix)
    one = 1 << precision
    # entries are scaled so that the matrix has entries of about one
    scale = max(max(abs(v) for row in matrix for v in row), 1).bit_length()
    root = (numerator << precision) >> (bits + scale) if bits + scale >= 0 else 0
    a = np.array([[(v << precision) >> scale for v in row] for row in matrix], dtype=object)
    for k in range(d):
        a[k, k] -= root
    order = np.arange(d)
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[[k, pivot]] = order[[pivot, k]]
        if a[k, k] == 0:
            a[k, k] = 1  # the smallest step: an exact root
        if k + 1 < d:
            a[k + 1 :, k] = np.array([(v << precision) // a[k, k] for v in a[k + 1 :, k]], object)
            step = a[k + 1 :, k][:, None] * a[k, k + 1 :][None, :]
            a[k + 1 :, k + 1 :] -= step >> precision

    def solve(b: np.ndarray) -> np.ndarray:
        y = b[order].copy()
        for k in range(d):
            if k:
                y[k] -= int(a[k, :k] @ y[:k]) >> precision
        for k in range(d - 1, -1, -1):
            if k + 1 < d:
                y[k] -= int(a[k, k + 1 :] @ y[k + 1 :]) >> precision
            y[k] = (int(y[k]) << precision) // a[k, k]
        return y

    def unit(v: np.ndarray) -> np.ndarray:
        most = max(abs(int(x)) for x in v)
        v = np.array([(int(x) << precision) // most for x in v], object) if most else v
        length = isqrt(int(v @ v))
        return np.array([(int(x) << precision) // length for x in v], object)

    found: list[np.ndarray] = []
    for turn in range(count):
        # fixed starts that share no direction with each other
        v = np.array([one // (1 + (k * (2 * turn + 1) + turn) % (d + 1)) for k in range(d)], object)
        for _ in range(3):
            for _ in range(2):
                for other in found:
                    v = v - (int(v @ other) >> precision) * other // one
                v = unit(v)
            v = unit(solve(v))
        for _ in range(2):
            for other in found:
                v = v - (int(v @ other) >> precision) * other // one
            v = unit(v)
        found.append(v)
    out = []
    for v in found:
        vector = np.array([int(x) / one for x in v])
        largest = vector[np.argmax(np.abs(vector))]
        out.append(vector if largest > 0 else -vector)
    return out
