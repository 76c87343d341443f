"""Substring dedup: repeated long runs of words, found in a compacted De Bruijn graph.

A sparse De Bruijn graph stands for the corpus. Of each window of ``length`` words the k-mer with
the smallest hash is a node (equal windows choose equal nodes), and the words from a node to the
next one of its document are an edge, known by their hash. Joined and grouped over all documents,
a node says in which document it occurs first, and whether all its occurrences share the edge
before it and the edge after it. Stretches of nodes that do not branch are one path: all
occurrences of one node run through the whole path, so every window inside has the same documents,
and its coordinates (document and position) settle it without looking at single windows. Windows
that touch a branch are compared one by one, by 128-bit hashes at their coordinates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyframe.llm.common import pieces, schema_of, utf8, without, words
from tallyframe.llm.hashing import Runs, WordHashes, sliding
from tallyframe.session import cut_lineage

K = 10
RESULT = ("n_words", "n_removed", "removed", "kept_text", "kept_sha256")


def nodes_of(hashes: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Node positions of texts laid end to end (``ends``: where each ends), and k-mer hashes.

    Also the smallest k-mer hash of each window, 0 where no window of one text begins.
    """
    n = len(hashes)
    runs = Runs(hashes)
    begin = np.arange(n - K + 1)
    grams = runs.of(begin, begin + K)
    end_of = np.repeat(ends, np.diff(ends, prepend=0))
    grams[begin + K > end_of[: len(begin)]] = np.iinfo(np.uint64).max
    least = sliding(grams, length - K + 1, np.minimum)
    inside = np.arange(len(least)) + length <= end_of[: len(least)]
    least = np.where(inside, least, np.uint64(0))
    padded = np.zeros(len(least) + 2 * (length - K), np.uint64)
    padded[length - K : length - K + len(least)] = least
    chosen = np.flatnonzero((sliding(padded, length - K + 1, np.maximum) == grams) & (grams > 0))
    chosen = chosen[chosen + K <= end_of[chosen]]
    # of a stretch of equal k-mers the first, the last, and one in twenty: each window meets one
    after = np.r_[grams[1:], 0][chosen] == grams[chosen]
    before = np.r_[0, grams[:-1]][chosen] == grams[chosen]
    first = np.repeat(np.r_[0, ends[:-1]], np.diff(ends, prepend=0))[chosen]
    chosen = chosen[~(after & before) | ((chosen - first) % 20 == 0)]
    return chosen, grams, least


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _nodes(length: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in pieces(batches, 256):
            known.trim()
            texts = [words(t) for t in utf8(batch.column(2))]
            keep = [i for i, t in enumerate(texts) if len(t) >= length]
            if not keep:
                continue
            hashes = np.concatenate([known.of(texts[i]) for i in keep])
            ends = np.cumsum([len(texts[i]) for i in keep])
            at, grams, _ = nodes_of(hashes, ends, length)
            doc = np.searchsorted(ends, at, side="right")
            first = ends[doc] - np.array([len(texts[i]) for i in keep])[doc]
            opens = np.r_[True, doc[1:] != doc[:-1]]
            closes = np.r_[doc[1:] != doc[:-1], True]
            edges = Runs(hashes, 1)
            left = edges.of(np.where(opens, first, np.r_[0, at[:-1]]), at + K)
            right = edges.of(at, np.where(closes, ends[doc], np.r_[at[1:] + K, 0]))
            # the end of a text is a branch of its own
            left ^= opens.astype(np.uint64)
            right ^= closes.astype(np.uint64)
            rows = pa.array(np.array(keep)[doc])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows).cast(schema.field(0).type),
                    batch.column(1).take(rows),
                    pa.array((at - first).astype(np.int32)),
                    _signed(grams[at]),
                    _signed(left),
                    _signed(right),
                ],
                schema=schema,
            )

    return run


def _spans(marks: np.ndarray) -> np.ndarray:
    """Begin and end of the runs of true values, as pairs."""
    return np.flatnonzero(np.diff(np.r_[False, marks, False].astype(np.int8)))


def _covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change)[:n] > 0


def _settle(texts: list[bytes], known: WordHashes, length: int, own, flags):
    """Windows of one text that are repeats for sure, and those that need a comparison.

    ``flags``: position, first document, and branching of the text's repeated nodes.
    """
    hashes = known.of(texts)
    n = len(texts)
    at, grams, least = nodes_of(hashes, np.array([n]), length)
    position, low, straight = flags
    position, once = np.unique(position, return_index=True)
    low, straight = low[once], straight[once]
    where = np.searchsorted(at, position)
    repeated = np.zeros(len(at), bool)
    repeated[where] = True
    earlier = np.zeros(len(at), bool)
    earlier[where] = low < own
    bent_left = np.ones(len(at), np.int64)
    bent_right = np.ones(len(at), np.int64)
    bent_left[where] = (straight & 1) == 0
    bent_right[where] = (straight & 2) == 0
    before_left = np.r_[0, np.cumsum(bent_left)]
    before_right = np.r_[0, np.cumsum(bent_right)]
    p = np.arange(n - length + 1)
    # the first node of the window whose k-mer is the smallest one
    smallest = np.searchsorted(at, p)
    wanted = least[: len(p)]
    while len(miss := np.flatnonzero(grams[at[smallest]] != wanted)):
        smallest[miss] += 1
    first = np.searchsorted(at, p)
    first += at[first] == p
    last = np.searchsorted(at, p + length - K, side="right") - 1
    last -= at[last] == p + length - K
    left_ok = before_left[smallest + 1] - before_left[np.minimum(first, smallest + 1)] == 0
    right_ok = before_right[np.maximum(last + 1, smallest)] - before_right[smallest] == 0
    sure = left_ok & right_ok
    removed = np.flatnonzero(repeated[smallest] & sure & earlier[smallest])
    unsure = np.flatnonzero(repeated[smallest] & ~sure)
    one, two = (Runs(hashes, f).of(unsure, unsure + length) for f in (0, 1))
    # each different window once; those whose node is nowhere earlier can only be sources
    _, once, which = np.unique(one, return_index=True, return_inverse=True)
    later = earlier[smallest[unsure[once]]]
    return removed, unsure, which, one[once], two[once], later


def _outcome(raw: bytes | None, starts: np.ndarray, length: int, with_text: bool) -> tuple:
    """What is left of a text when the windows at ``starts`` go."""
    texts = words(raw)
    n = len(texts)
    if len(starts):
        marks = _covered(starts, n, length)
        kept = b" ".join([w for w, m in zip(texts, marks.tolist()) if not m])
        removed, spans = int(marks.sum()), _spans(marks).tolist()
    else:
        kept, removed, spans = b" ".join(texts), 0, []
    digest = hashlib.sha256(kept).hexdigest()
    left = kept if removed else raw
    return n, removed, spans, left.decode() if with_text and raw is not None else None, digest


def _first_pass(length: int, with_text: bool, width: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in pieces(batches, 256):
            known.trim()
            columns = batch.columns
            owns = columns[0].to_pylist()
            lists = columns[-1]
            rows = []
            for i, raw in enumerate(utf8(columns[2])):
                texts = words(raw)
                starts, unsure, which, one, two, later = [np.zeros(0, np.int64)] * 6
                if lists[i].is_valid:
                    found = lists[i].values
                    parts = [found.field(k).to_numpy(zero_copy_only=False) for k in range(3)]
                    starts, unsure, which, one, two, later = _settle(
                        texts, known, length, owns[i], parts
                    )
                if len(unsure):
                    rows.append(
                        (
                            len(texts),
                            None,
                            starts.tolist(),
                            raw.decode(),
                            None,
                            unsure.tolist(),
                            which.tolist(),
                            later.tolist(),
                            one.view(np.int64).tolist(),
                            two.view(np.int64).tolist(),
                        )
                    )
                else:
                    rows.append((*_outcome(raw, starts, length, with_text), *[None] * 5))
            made = [
                pa.array(c, schema.field(width + k).type) for k, c in enumerate(zip(*rows))
            ]
            kept = [*columns[:2], *columns[3:-1]]
            yield pa.RecordBatch.from_arrays(
                [c.cast(schema.field(k).type) for k, c in enumerate(kept)] + made, schema=schema
            )

    return run


def _second_pass(length: int, with_text: bool, width: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            names = ("removed", "__unsure", "__which", "__hits")
            rows = []
            for raw, *lists in zip(
                utf8(batch.column("kept_text")), *(batch.column(n).to_pylist() for n in names)
            ):
                sure, unsure, which, hits = (np.array(x or (), np.int64) for x in lists)
                starts = np.union1d(sure, unsure[np.isin(which, hits)])
                rows.append(_outcome(raw, starts, length, with_text))
            made = [
                pa.array(c, schema.field(width + k).type) for k, c in enumerate(zip(*rows))
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], schema=schema)

    return run


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 50,
    with_text: bool = True,
) -> DataFrame:
    """Remove every word in a run of ``length`` words that also begins in a smaller document id.

    Keeps the input columns but the text and adds ``n_words``, ``n_removed``, ``removed`` (begin
    and end of each removed stretch, in words, one after the other), ``kept_text`` (the
    text if it loses nothing, else its kept words joined by a blank; null unless ``with_text``)
    and ``kept_sha256`` (of the kept words joined by a blank).

    Only nodes, about one word in twenty, are shuffled for all texts; texts are shuffled once to
    meet their repeated nodes, and again only where windows touch a branch. Counts per node
    combine before the shuffle, and the joins are on node and document keys with one side unique,
    so a passage in a third of all documents is split by adaptive execution.

    Null and empty texts have no words; a text shorter than ``length`` loses none. Rows with a
    null id are kept whole and take nothing from others. Rows with one id are copies of one
    document: none is smaller than the other, so they don't remove each other's words. Columns
    called like a result column are replaced.
    """
    docs = without(docs, *[r for r in RESULT if r not in (id_col, text_col)])
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    keyed = docs.select(
        ident.alias("__id"),
        F.xxhash64(ident, text).alias("__key"),
        text.alias("__text"),
        *[F.col(f"`{c}`") for c in rest],
    )
    node_schema = schema_of(keyed, ["__id", "__key"], "pos int, node long, before long, after long")
    source = keyed.select("__id", "__key", "__text").filter("__id is not null and __text is not null")
    # found twice rather than kept: the table of nodes would take more room than its making time
    nodes = source.mapInArrow(_nodes(length, to_arrow_schema(node_schema)), node_schema)
    shared = (
        nodes.groupBy("node")
        .agg(
            F.min("__id").alias("low"),
            F.max("__id").alias("high"),
            (F.min("before") == F.max("before")).cast("int").alias("one_before"),
            (F.min("after") == F.max("after")).cast("int").alias("one_after"),
        )
        .filter("low < high")
        .select("node", "low", (F.col("one_before") + 2 * F.col("one_after")).alias("straight"))
    )
    flags = (
        nodes.select("__id", "__key", "pos", "node")
        .join(shared, "node")
        .groupBy(F.col("__id").alias("__i"), F.col("__key").alias("__k"))
        .agg(F.collect_list(F.struct("pos", "low", "straight")).alias("__flags"))
    )
    met = keyed.join(
        flags, (F.col("__id") == F.col("__i")) & (F.col("__key") == F.col("__k")), "left"
    ).drop("__i", "__k")
    more = (
        "n_words long, n_removed long, removed array<int>, kept_text string, kept_sha256 string, "
        "__unsure array<int>, __which array<int>, __later array<boolean>, __one array<long>, "
        "__two array<long>"
    )
    schema = schema_of(keyed, ["__id", "__key", *rest], more)
    width = 2 + len(rest)
    run = _first_pass(length, with_text, width, to_arrow_schema(schema))
    partial = cut_lineage(met.mapInArrow(run, schema), "settled")
    inner = ("__unsure", "__which", "__later", "__one", "__two")
    done = partial.filter("__unsure is null").drop(*inner)
    pending = partial.filter("__unsure is not null")
    windows = pending.select(
        "__id", "__key", F.posexplode(F.arrays_zip("__later", "__one", "__two")).alias("at", "w")
    ).select("__id", "__key", "at", "w.__later", "w.__one", "w.__two")
    sources = (
        windows.groupBy("__one", "__two")
        .agg(F.min("__id").alias("low"), F.max("__id").alias("high"))
        .filter("low < high")
        .select("__one", "__two", "low")
    )
    hits = (
        windows.filter("__later")
        .join(sources, ["__one", "__two"])
        .filter(F.col("__id") > F.col("low"))
        .groupBy(F.col("__id").alias("__i"), F.col("__key").alias("__k"))
        .agg(F.collect_list("at").alias("__hits"))
    )
    left = pending.drop("__later", "__one", "__two").join(
        hits, (F.col("__id") == F.col("__i")) & (F.col("__key") == F.col("__k")), "left"
    )
    out = StructType([f for f in schema.fields if f.name not in inner])
    settled = left.drop("__i", "__k").mapInArrow(
        _second_pass(length, with_text, width, to_arrow_schema(out)), out
    )
    return (
        done.unionByName(settled)
        .withColumnRenamed("__id", id_col)
        .drop("__key")
    )
