"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes are signs of rotated principal components (iterative quantisation), several rotations side by
side. A code is split into substrings and each is indexed. Codes within Hamming radius r of a query
agree with it, by the pigeonhole principle, within r // m (or one less, beyond the first r % m + 1)
in one of the m substrings, so probing these finds every code in the radius. Inner products of the
original vectors rank what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage

SUB = 8  # bits of a substring
POPCOUNT = np.array([bin(v).count("1") for v in range(256)])


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, int, float]:
    """Rows that take part, their number, dimension, and largest squared length.

    Left out: null ids; vectors that are null, zero, hold a null or a number that is not finite,
    or differ in dimension from most vectors (of equally many, from the longest).
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    whole = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    whole = whole.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).filter(~bad)
    whole = whole.withColumn("length", length).filter("length > 0")
    sizes = whole.groupBy(F.size("vector").alias("d")).agg(
        F.count("*").alias("n"), F.max("length").alias("most")
    )
    top = sizes.orderBy(F.col("n").desc(), F.col("d").desc()).first()
    if top is None:
        return whole.select("id", "vector"), 0, 0, 0.0
    kept = whole.filter(F.size("vector") == top.d).select("id", "vector")
    return kept, int(top.n), int(top.d), float(top.most)


def augment(x: np.ndarray, most: float, query: bool) -> np.ndarray:
    """One more component that turns the largest inner product into the smallest distance."""
    if query:
        more = np.zeros(len(x))
    else:
        more = np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0.0))
    return np.column_stack([x, more])


def _fit(bits: int, rounds: int, k: int, total: int, most: float, sure: float):
    """Mean, rotations and radius from a bounded sample, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [v for b in batches for v in b.column("vector").to_pylist()]
        x = augment(np.array(rows), most, False)
        rng = np.random.default_rng(7)
        mean = x.mean(axis=0)
        centred = x - mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1]
        parts, have = [], 0
        while have < bits:
            width = min(x.shape[1], bits - have)
            base = centred @ axes[:, :width]
            turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
            for _ in range(rounds):
                a, _, b = np.linalg.svd(np.where(base @ turn > 0, 1.0, -1.0).T @ base)
                turn = (a @ b).T
            parts.append(axes[:, :width] @ turn)
            have += width
        rotation = np.hstack(parts)
        queries = np.arange(min(len(x), 1000))
        asked = augment(np.array([rows[i] for i in queries]), most, True)
        own = ((asked - mean) @ rotation > 0).astype(np.float64)
        code = (centred @ rotation > 0).astype(np.float64)
        apart = own.sum(1)[:, None] + code.sum(1)[None] - 2 * own @ code.T
        near = asked @ x.T
        near[queries, queries] = -np.inf
        take = min(max(1, -(-k * len(x) // max(total, 1))), max(len(x) - 1, 1))
        best = np.argpartition(-near, take - 1, axis=1)[:, :take]
        radius = int(np.ceil(np.quantile(np.take_along_axis(apart, best, axis=1), sure)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([mean.tobytes()]), pa.array([rotation.tobytes()]), pa.array([radius])],
            names=["mean", "rotation", "radius"],
        )

    return run


class Codes:
    def __init__(self, mean: bytes, rotation: bytes, bits: int, most: float):
        self.mean = np.frombuffer(mean)
        self.rotation = np.frombuffer(rotation).reshape(-1, bits)
        self.most = most

    def of(self, x: np.ndarray, query: bool) -> np.ndarray:
        signs = (augment(x, self.most, query) - self.mean) @ self.rotation > 0
        return np.packbits(signs, axis=1)


def _encode(codes: Codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist())
                for name, query in (("row", False), ("query", True)):
                    if query:
                        keep = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
                    else:
                        keep = np.ones(len(x), bool)
                    if not keep.any():
                        continue
                    made = codes.of(x[keep], query)
                    at = pa.array(np.flatnonzero(keep))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(at),
                            pa.array([v.tobytes() for v in x[keep]], pa.binary()),
                            pa.array([v.tobytes() for v in made], pa.binary()),
                            pa.array([query] * len(at)),
                        ],
                        names=["id", "vector", "code", "query"],
                    )

    return run


class MultiIndex:
    """A block of codes, indexed by each of its substrings."""

    def __init__(self, code: np.ndarray, radius: int):
        self.code = code
        m = code.shape[1]
        self.reach = [radius // m if j <= radius % m else radius // m - 1 for j in range(m)]
        self.order = [np.argsort(code[:, j], kind="stable") for j in range(m)]
        self.starts = [
            np.searchsorted(code[o, j], np.arange(257)) for j, o in enumerate(self.order)
        ]
        self.radius = radius
        self.found: dict[tuple[int, int], np.ndarray] = {}

    def probe(self, j: int, value: int) -> np.ndarray:
        """Rows whose j-th substring is within reach of ``value``."""
        rows = self.found.get((j, value))
        if rows is None:
            near = np.flatnonzero(POPCOUNT[np.arange(256) ^ value] <= self.reach[j])
            starts, order = self.starts[j], self.order[j]
            rows = np.concatenate([order[starts[v] : starts[v + 1]] for v in near])
            self.found[j, value] = rows
        return rows

    def within(self, query: np.ndarray, least: int) -> np.ndarray:
        """Rows within the radius; with fewer than ``least``, the nearest by Hamming distance."""
        met = np.zeros(len(self.code), bool)
        for j, value in enumerate(query.tolist()):
            if self.reach[j] >= 0:
                met[self.probe(j, value)] = True
        rows = np.flatnonzero(met)
        apart = POPCOUNT[self.code[rows] ^ query].sum(axis=1)
        rows = rows[apart <= self.radius]
        if len(rows) < min(least, len(self.code)):
            apart = POPCOUNT[self.code ^ query].sum(axis=1)
            rows = np.argsort(apart, kind="stable")[:least]
        return rows


def _search(k: int, radius: int):
    def run(key, block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        code = np.frombuffer(b"".join(block["code"]), np.uint8).reshape(len(block), -1)
        index = MultiIndex(code, radius)
        vectors = np.frombuffer(b"".join(block["vector"])).reshape(len(block), -1)
        ids = block["id"].to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for own, raw, query in zip(asked["id"], asked["vector"], asked["code"]):
            rows = index.within(np.frombuffer(query, np.uint8), k + 1)
            rows = rows[ids[rows] != own]
            score = (vectors[rows] * np.frombuffer(raw)).sum(axis=1)
            best = np.lexsort((ids[rows], -score))[:k]
            out.append((np.full(len(best), own), ids[rows[best]], score[best]))
        a, b, c = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    return run


def nearest(
    vectors: DataFrame,
    queries,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    bits: int = 128,
    sample: int = 16_384,
    sure: float = 0.98,
    block: int = 8192,
    least_blocks: int = 36,
    query_block: int = 8192,
) -> DataFrame:
    """The ``k`` rows of largest inner product found for each row on which ``queries`` holds.

    Returns ``query_id``, ``rank`` (from 1, ties to the smaller id), ``vec_id`` and ``score`` (in
    double precision on the original vectors). The codes are learned on at most about ``sample``
    rows, chosen by hash, and the radius is what holds the share ``sure`` of the sample's own
    neighbours; every row is indexed. Rows of the query's own id are no candidates. A block that
    holds fewer than ``k`` codes in the radius gives its nearest ones by code, so a query lacks
    results only if there are no more rows.

    The index is dealt by hash into blocks of about ``block`` rows, whatever their vectors, so a
    vector that repeats in a third of all rows spreads; the queries go to each block. Vectors that
    take no part: see ``valid_vectors``. Other columns are not read.
    """
    marked = vectors.withColumn("__asked", queries)
    asked_ids = marked.filter("__asked").select(F.col(f"`{id_col}`").cast("long").alias("q")).distinct()
    kept, total, _, most = valid_vectors(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if total < 2:
        return spark.createDataFrame([], schema)
    parts = -(-total // sample)
    chosen = kept.filter(F.pmod(F.xxhash64("id", "vector"), F.lit(parts)) == 0)
    if chosen.isEmpty():
        chosen = kept.limit(sample)
    fitted = (
        chosen.repartition(1)
        .mapInArrow(_fit(bits, 25, k, total, most, sure), "mean binary, rotation binary, radius long")
        .first()
    )
    codes = Codes(bytes(fitted.mean), bytes(fitted.rotation), bits, most)
    flagged = kept.join(asked_ids, F.col("id") == F.col("q"), "left").select(
        "id", "vector", F.col("q").isNotNull().alias("asked")
    )
    index = cut_lineage(
        flagged.mapInArrow(_encode(codes), "id long, vector binary, code binary, query boolean"),
        "codes",
    )
    blocks = max(least_blocks, -(-total // block))
    number = index.filter("query").count()
    if not number:
        return spark.createDataFrame([], schema)
    query_blocks = -(-number // query_block)
    spread = F.pmod(F.xxhash64("id", "vector", F.lit(1)), F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(query_blocks)).cast("int")
    rows = index.filter("not query").select(
        spread.alias("i"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("j"),
        "id", "vector", "code",
    )
    asked = index.filter("query").select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"),
        group.alias("j"),
        "id", "vector", "code",
    )
    found = (
        rows.groupBy("i", "j")
        .cogroup(asked.groupBy("i", "j"))
        .applyInPandas(_search(k, int(fitted.radius)), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
