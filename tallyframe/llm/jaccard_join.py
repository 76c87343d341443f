"""Exact Jaccard self-join of documents on word shingles, as components, in metric space.

Link: intersection over union of the shingle sets is at least ``num / den``, that is, a Jaccard
distance of at most ``r = 1 - num / den``. Equal sets are one class from the start.

Two kinds of pivots make the regions. Single shingles come first: in an order of all shingles (by
their number in a sample, the rarest first, then by hash) linked sets share one of their first
``n - ceil(n * num / den) + 1``, so a set belongs to the regions of these. In a region, sizes and a projection of the sets (numbers
of shingles in 64 buckets, modulo 16, whose distance bounds the true one from below) leave the pairs
that may be linked; long sets have more buckets, looked at once per pair. What they connect is a region of the second kind; so is what may meet only in
frequent shingles, the large families of near copies.

A region of more than ``block`` sets is divided around pivot documents of its own. With ``m`` as
the distance of a set to its nearest pivot, a partner has a nearest pivot within ``m + r`` of its
own, and so, by the triangle inequality, the set meets all its partners in the regions of the
pivots within ``m + 2 r``. Sets further than ``REACH`` from every pivot are a region of their own;
their partners that are nearer meet them around pivots, in windows of ``REACH + r``. Regions are
divided again until they fit in a block; where pivots can't tell the sets apart, blocks meet
blocks, but sets linked with one pivot are one component and are not compared with one another. Texts never come to the driver, and a set is shipped once a region.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.llm.common import pieces, schema_of, utf8
from tallyframe.llm.hashing import Runs, WordHashes
from tallyframe.operators.graph import components
from tallyframe.session import cut_lineage

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BUCKETS, LEVELS, REACH = 64, 16, 0.5
SAMPLE, SHARE, LEAST = 64, 5000, 8  # one text in 64; frequent: 8 and one in 5000 of these, or more
COUNTED = 1 << 20  # shingles of the sample whose number is told, those that occur most often
FAMILIES = -(2**63)  # the region of all sets with a frequent shingle among their first ones


def shingles(text: bytes | None, k: int, known: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct ``k``-word shingles; fewer words are one shingle."""
    listed = text.translate(LOWER).split() if text else []
    if not listed:
        return np.zeros(0, np.uint64)
    begin = np.arange(max(len(listed) - k + 1, 1))
    return np.unique(Runs(known.of(listed)).of(begin, np.minimum(begin + k, len(listed))))


def _sets(k: int, schema: pa.Schema, row):
    """Runs ``row`` on the shingle set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in pieces(batches, 256):
            known.trim()
            rows = [row(shingles(t, k, known)) for t in utf8(batch.column(1))]
            made = [pa.array(c, schema.field(1 + i).type) for i, c in enumerate(zip(*rows))]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(schema.field(0).type), *made], schema=schema
                )

    return run


def _sketch(found: np.ndarray, bits: int) -> bytes:
    """Numbers of shingles by their first ``bits`` bits, modulo ``LEVELS``, two in a byte."""
    bucket = (found >> np.uint64(64 - bits)).astype(np.int64)
    level = (np.bincount(bucket, minlength=1 << bits) % LEVELS).astype(np.uint8)
    return (level[::2] | level[1::2] << 4).tobytes()


def _numbers(found: np.ndarray, counted: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """How often the sample holds each of ``found``; 0 for what is not among the sorted ``counted``."""
    if not len(counted):
        return np.zeros(len(found), np.int64)
    at = np.minimum(np.searchsorted(counted, found), len(counted) - 1)
    return np.where(counted[at] == found, numbers[at], 0)


def _described(counted: np.ndarray, numbers: np.ndarray, least: int, num: int, den: int):
    """Size, digest, first shingles and sketches of a set; ``least`` makes a shingle frequent."""

    def row(found: np.ndarray) -> tuple:
        n = len(found)
        digest = xxhash.xxh3_128_digest(found.tobytes())
        one, two = np.frombuffer(digest, np.int64).tolist()
        if not n:
            return 0, one, two, [], 0, bytes(BUCKETS // 2), b""
        keep = n - -(-num * n // den) + 1
        seen = _numbers(found, counted, numbers)
        first = np.argsort(seen, kind="stable")[:keep]
        rare = found[first[seen[first] < least]]
        often = first[seen[first] >= least]
        fine = _sketch(found, int(n // 8).bit_length() - 1) if n > BUCKETS * LEVELS else b""
        return n, one, two, rare.view(np.int64).tolist(), len(often), _sketch(found, 6), fine

    return row


def _regions(num: int, den: int):
    """Pairs of one region (rows sorted by shingle, then size) that may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            numbers = (batch.column(i).to_numpy().astype(np.int64, copy=False) for i in range(3))
            rows = (*numbers, _levels(batch.column(3)))
            if tail is not None:
                rows = tuple(np.concatenate(both) for both in zip(tail, rows))
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            tail = tuple(column[cut:] for column in rows)
            yield from _pairs(*(column[:cut] for column in rows), num, den)
        if tail is not None:
            yield from _pairs(*tail, num, den)

    return run


def _levels(column: pa.Array) -> np.ndarray:
    """One row of bucket levels per sketch."""
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BUCKETS // 2)
    return np.stack([packed & 15, packed >> 4], axis=2).reshape(-1, BUCKETS).view(np.int8)


def _pairs(e, c, n, level, num: int, den: int) -> Iterator[pa.RecordBatch]:
    found: set[tuple[int, int]] = set()
    active = np.arange(len(e) - 1)
    step = 1
    while len(active):  # rows that still have a partner ``step`` places on
        a, b = active, active + step
        ok = (e[a] == e[b]) & (n[b] * num <= n[a] * den)
        a, b = a[ok], b[ok]
        for at in range(0, len(a), 50_000):
            x, y = a[at : at + 50_000], b[at : at + 50_000]
            apart = np.abs(level[x] - level[y])
            apart = np.minimum(apart, LEVELS - apart).sum(axis=1, dtype=np.int64)
            # |A| + |B| = union + intersection, apart <= union - intersection
            total = n[x] + n[y]
            near = ((total + apart) * num <= (total - apart) * den) & (c[x] != c[y])
            low, high = np.minimum(c[x], c[y])[near], np.maximum(c[x], c[y])[near]
            found.update(zip(low.tolist(), high.tolist()))
        active = a[a + step + 1 < len(e)]
        step += 1
        if len(found) > 200_000:
            yield _batch(found)
            found = set()
    if found:
        yield _batch(found)


def _batch(found) -> pa.RecordBatch:
    a, b = zip(*found)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
    )


def _unpacked(sketch: bytes) -> np.ndarray:
    packed = np.frombuffer(sketch, np.uint8)
    return np.stack([packed & 15, packed >> 4], axis=1).ravel().astype(np.int64)


def _finer(num: int, den: int):
    """Keeps pairs that may be linked by the long sketches of long sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            ok = []
            for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                if not x or not y:
                    ok.append(True)
                    continue
                x, y = _unpacked(x), _unpacked(y)
                size = min(len(x), len(y))  # neighbouring buckets add up to one of fewer bits
                x, y = (v.reshape(size, -1).sum(axis=1) % LEVELS for v in (x, y))
                apart = np.abs(x - y)
                apart = int(np.minimum(apart, LEVELS - apart).sum())
                ok.append((n + m + apart) * num <= (n + m - apart) * den)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(
                pa.array(ok, pa.bool_())
            )

    return run


class Pivots:
    """Distances of a set to a bounded number of pivot sets, by one lookup per element."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.ids = [r[0] for r in rows]
        sets = [np.frombuffer(r[1], np.uint64) for r in rows]
        self.sizes = np.array([len(s) for s in sets])
        element = np.concatenate(sets)
        order = np.argsort(element, kind="stable")
        self.element = element[order]
        self.of = np.repeat(np.arange(len(sets)), self.sizes)[order]

    def shared(self, found: np.ndarray) -> np.ndarray:
        left = np.searchsorted(self.element, found, side="left")
        right = np.searchsorted(self.element, found, side="right")
        span = right - left
        at = np.repeat(left - np.r_[0, np.cumsum(span)[:-1]], span) + np.arange(span.sum())
        return np.bincount(self.of[at], minlength=len(self.ids))


def _voronoi(num: int, den: int):
    """The pivots in whose windows each set of a region lies; null for sets far from all."""

    def run(key, sets, pivots):
        import pandas as pd

        rows = []
        if len(sets) and len(pivots):
            index = Pivots(list(zip(pivots["pivot"], pivots["pivot_elements"])))
            for cid, raw in zip(sets["cid"], sets["elements"]):
                found = np.frombuffer(raw, np.uint64)
                both = index.shared(found)
                union = len(found) + index.sizes - both
                linked = both * den >= union * num
                # distances times den, with room for rounding: a wider window loses nothing
                distance = den * (1.0 - both / union)
                room, least = den - num + 1e-6 * den, distance.min()
                window = distance <= min(least + 2 * room, REACH * den + room)
                if least > REACH * den:
                    rows.append((key[0], cid, None, False))
                for k in np.flatnonzero(window | linked):
                    rows.append((key[0], cid, index.ids[k], bool(linked[k])))
        return pd.DataFrame(rows, columns=["region", "cid", "pivot", "linked"]).astype(
            {"region": "int64", "cid": "int64", "pivot": "Int64", "linked": "bool"}
        )

    return run


class _Forest:
    """Links that connect what was not connected yet."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[a] = b
            self.links.append((x, y))

    def table(self):
        import pandas as pd

        return pd.DataFrame(self.links, columns=["a", "b"]).astype("int64")


def _meet(index: Pivots, ids, elements, num: int, den: int, forest: _Forest) -> None:
    for cid, raw in zip(ids, elements):
        found = np.frombuffer(raw, np.uint64)
        both = index.shared(found)
        for k in np.flatnonzero(both * den >= (len(found) + index.sizes - both) * num):
            forest.link(index.ids[k], cid)


def _finish(num: int, den: int):
    """Links within one region, thinned to a forest with the same components."""

    def run(sets):
        forest = _Forest()
        index = Pivots(list(zip(sets["cid"], sets["elements"])))
        _meet(index, sets["cid"], sets["elements"], num, den, forest)
        return forest.table()

    return run


def _tile(num: int, den: int):
    """Links between two blocks, thinned to a forest with the same components."""

    def run(key, left, right):
        forest = _Forest()
        if len(left) and len(right):
            index = Pivots(list(zip(left["cid"], left["elements"])))
            _meet(index, right["open_cid"], right["open_elements"], num, den, forest)
        return forest.table()

    return run


def _blocks(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links in regions that pivots can't divide: sets not linked with the pivot meet all."""
    own = F.abs(F.xxhash64("cid"))
    every = rows.filter("open > 0").select(
        "region",
        "cid",
        "elements",
        (own % F.col("all")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("open") - 1)).alias("j"),
    )
    opened = rows.filter("not linked").select(
        F.col("region").alias("at"),
        F.col("cid").alias("open_cid"),
        F.col("elements").alias("open_elements"),
        F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("k"),
        (own % F.col("open")).cast("int").alias("l"),
    )
    tiles = every.groupBy("region", "i", "j").cogroup(opened.groupBy("at", "k", "l"))
    return tiles.applyInPandas(_tile(num, den), "a long, b long")


def _divide(
    sets: DataFrame, regions: DataFrame, num: int, den: int, pivots: int, block: int
) -> DataFrame:
    """Links among the ``sets`` (cid, elements) of each of the ``regions`` (region, cid)."""
    links, turn = [], 0
    todo = regions
    while True:
        sizes = todo.groupBy("region").agg(F.count("*").alias("size"))
        parts = cut_lineage(todo.join(sizes, "region"), "parts")
        done = parts.filter((F.col("size") > 1) & (F.col("size") <= block))
        links.append(
            done.select("region", "cid")
            .join(sets, "cid")
            .groupBy("region")
            .applyInPandas(_finish(num, den), "a long, b long")
        )
        large = parts.filter(F.col("size") > block)
        if large.isEmpty():
            break
        slots = F.ceil(F.col("size") / block).cast("int")
        order = Window.partitionBy("region").orderBy(F.xxhash64("cid", F.lit(turn)), "cid")
        chosen = large.withColumn("place", F.row_number().over(order)).filter(
            F.col("place") <= pivots
        )
        chosen = chosen.join(sets, "cid").select(
            F.col("region").alias("at"),
            F.col("cid").alias("pivot"),
            F.col("elements").alias("pivot_elements"),
            F.explode(F.sequence(F.lit(0), slots - 1)).alias("k"),
        )
        members = large.join(sets, "cid").select(
            "region",
            "cid",
            "elements",
            (F.abs(F.xxhash64("cid")) % slots).cast("int").alias("slot"),
        )
        dealt = cut_lineage(
            members.groupBy("region", "slot")
            .cogroup(chosen.groupBy("at", "k"))
            .applyInPandas(_voronoi(num, den), "region long, cid long, pivot long, linked boolean")
            .groupBy("region", "cid", "pivot")
            .agg(F.min("linked").alias("linked"), F.max("linked").alias("meets")),
            "regions",
        )
        links.append(
            dealt.filter("meets").select(F.col("pivot").alias("a"), F.col("cid").alias("b"))
        )
        around = dealt.groupBy("region", "pivot").agg(
            F.count("*").alias("n"), F.count(F.when(F.col("linked"), 1)).alias("close")
        )
        outcome = (
            around.groupBy("region")
            .agg(
                F.sum("n").alias("sum"),
                F.max("n").alias("most"),
                F.max(F.struct("close", "pivot")).alias("center"),
            )
            .join(sizes, "region")
            .withColumn("apart", F.expr("4 * most <= 3 * size and sum <= 2 * size"))
        )
        outcome = cut_lineage(
            outcome.select("region", "size", "apart", "center.close", "center.pivot"), "outcome"
        )
        # blocks where nothing is won by more pivots
        close = dealt.filter("linked").select(
            "region", "pivot", "cid", F.col("linked").alias("near_center")
        )
        together = (
            large.select("region", "cid")
            .join(outcome.filter("not apart"), "region")
            .join(close, ["region", "pivot", "cid"], "left")
            .withColumn("linked", F.coalesce("near_center", F.lit(False)))
            .withColumn("all", F.ceil(F.col("size") / block).cast("int"))
            .withColumn("open", F.ceil((F.col("size") - F.col("close")) / block).cast("int"))
            .join(sets, "cid")
        )
        links.append(_blocks(together, num, den))
        todo = cut_lineage(
            dealt.join(outcome.filter("apart").select("region"), "region")
            .select(F.xxhash64("region", "pivot", F.lit(turn)).alias("region"), "cid")
            .distinct(),
            "divided",
        )
        turn += 1
    return reduce(DataFrame.union, links).filter("a <> b")


def _counted(several: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent of the shingles (e, count), sorted by hash, and their numbers."""
    kinds = several.groupBy(F.least("count", F.lit(least)).alias("count")).agg(
        F.count("*").alias("kinds")
    )
    total, lowest = 0, least
    for count, kind in sorted(kinds.collect(), reverse=True):
        total += kind
        if total > COUNTED:
            break
        lowest = min(lowest, count)
    found = several.filter(F.col("count") >= lowest).toArrow()
    counted = found.column("e").to_numpy().view(np.uint64)
    order = np.argsort(counted)
    numbers = np.minimum(found.column("count").to_numpy(), least).astype(np.int32)
    return counted[order], numbers[order]


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    num: int = 90,
    den: int = 100,
    pivots: int = 16,
    block: int = 1024,
) -> DataFrame:
    """``n_shingles`` and ``component_id``, the smallest id reachable by links, per document.

    Words are lower-cased in A-Z. Ids are whole numbers, other columns are not read. Null and empty texts
    have no shingles and are their own component. Rows with a null id link with nothing and have
    a null component. Rows with one id are one document, with the links of all its texts. The
    frequent shingles, from a sample of one text in 64 that only decides the order of pivots, are
    at most 5000 times the mean size of a set; they and the next most frequent ones, ``COUNTED`` in
    all where the frequent ones are fewer, are told apart by their numbers. Nothing is capped: pairs
    are compared exactly.
    """
    part = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("cid"), F.col(f"`{text_col}`").alias("text")
    )
    usable = part.filter("cid is not null")
    sample = usable.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    sample = cut_lineage(sample.dropDuplicates(["text"]), "sample")
    least = max(LEAST, sample.count() // SHARE)
    shingled = sample.mapInArrow(
        _sets(words, pa.schema([("cid", pa.int64()), ("e", pa.list_(pa.int64()))]),
              lambda s: (s.view(np.int64).tolist(),)),
        "cid long, e array<long>",
    )
    several = cut_lineage(
        shingled.select(F.explode("e").alias("e")).groupBy("e").count().filter("count > 1"),
        "counted",
    )
    counted, numbers = _counted(several, least)
    more = "n int, one long, two long, rare array<long>, often int, sketch binary, fine binary"
    schema = schema_of(part, ["cid"], more)
    described = cut_lineage(
        part.mapInArrow(
            _sets(words, to_arrow_schema(schema), _described(counted, numbers, least, num, den)), schema
        ),
        "sets",
    )
    classes = cut_lineage(
        described.filter("n > 0 and cid is not null")
        .groupBy("one", "two")
        .agg(
            F.min("cid").alias("cid"),
            *[F.first(c).alias(c) for c in ("n", "rare", "often", "sketch", "fine")],
        ),
        "classes",
    )
    postings = classes.select(F.explode("rare").alias("e"), "cid", "n", "sketch")
    pairs = (
        postings.repartition("e")
        .sortWithinPartitions("e", "n", "cid")
        .mapInArrow(_regions(num, den), "a long, b long")
        .distinct()
    )
    first = classes.select(F.col("cid").alias("a"), "n", F.col("fine").alias("x"))
    second = classes.select(F.col("cid").alias("b"), F.col("n").alias("m"), F.col("fine").alias("y"))
    near = cut_lineage(
        pairs.join(first, "a")
        .join(second, "b")
        .select("a", "b", "n", "m", "x", "y")
        .mapInArrow(_finer(num, den), "a long, b long")
        .distinct(),
        "pairs",
    )
    met = components(near.select(F.col("a").alias("node")).union(near.select("b")), near)
    regions = cut_lineage(
        met.select(F.col("label").alias("region"), F.col("node").alias("cid")).union(
            classes.filter("often > 0").select(F.lit(FAMILIES).alias("region"), "cid").distinct()
        ),
        "met",
    )
    sets = cut_lineage(
        usable.join(regions.select("cid").distinct(), "cid")
        .select("cid", "text")
        .dropDuplicates(["cid", "text"])
        .mapInArrow(
            _sets(
                words,
                pa.schema([("cid", pa.int64()), ("elements", pa.binary())]),
                lambda s: (s.tobytes(),),
            ),
            "cid long, elements binary",
        )
        .filter("length(elements) > 0"),
        "elements",
    )
    links = _divide(sets, regions, num, den, pivots, block)
    heads = cut_lineage(
        described.select("cid", "n", "one", "two")
        .join(classes.select("one", "two", F.col("cid").alias("head")), ["one", "two"], "left")
        .select(
            "cid", "n", F.when(F.col("cid").isNotNull(), F.coalesce("head", "cid")).alias("head")
        ),
        "heads",
    )
    several = (
        heads.filter("cid is not null")
        .groupBy("cid")
        .agg(F.min("head").alias("low"), F.max("head").alias("high"))
        .filter("low < high")
    )
    own = several.join(heads, "cid").select(F.col("cid").alias("a"), F.col("head").alias("b"))
    links = cut_lineage(links.union(own), "links")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b"))
    labels = components(nodes, links)
    return heads.join(labels, F.col("head") == F.col("node"), "left").select(
        F.col("cid").alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("label", "head").alias("component_id"),
    )
