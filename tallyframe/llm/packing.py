"""Packing token pieces into sequences by cutting-stock column generation."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.llm.common import pieces, schema_of
from tallyframe.session import cut_lineage

SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
MORE = (
    "start long, length long, ids_crc32 long, doc_tokens long, width int, part int, rank long, "
    "ids binary"
)


# Fixed value: the public byte-level pattern that cuts a text into units before merging.
UNITS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabulary files write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenBytes:
    """Token ids of texts as little-endian 32-bit numbers, remembered word by word.

    In a text without two white-space characters in a row, a blank begins a unit of the
    byte-level pattern and a line break is one, so the ids of the text are those of its stretches
    between them. Other texts are encoded whole. ``keep`` bounds the stretches
    remembered. The vocabulary file is that of the ``tokenizers`` library. Where its merges are
    in the order of their ids, which makes the file equal to a table of ranks, ``tiktoken`` does
    the merging, about three times as fast; ``tokenizers`` does it otherwise.
    """

    beside = re.compile(r"\s\s")

    def __init__(self, path: str, keep: int = 800_000):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary, merges = content["model"]["vocab"], content["model"]["merges"]
        joined = ("".join(m.split(" ") if isinstance(m, str) else m) for m in merges)
        if all(vocabulary.get(t) == 256 + i for i, t in enumerate(joined)):
            import tiktoken

            letters = _byte_letters()
            special = {t["content"] for t in content.get("added_tokens", ())}
            ranks = {
                bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special
            }
            self.encoding = tiktoken.Encoding(
                "ranks", pat_str=UNITS, mergeable_ranks=ranks, special_tokens={}
            )
            self.encode = self.encoding.encode_ordinary
        else:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = True
            self.encode = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.keep = keep
        self.known: dict[str, bytes] = {}

    def _learn(self, stretch: str) -> bytes:
        """Ids of a stretch not met before; letters and the signs after them are units apart."""
        known = self.known
        head = stretch.rstrip(SIGNS)
        if len(head) < len(stretch) and head[1:].isalpha() and (head[0] == " " or head[0].isalpha()):
            tail = stretch[len(head) :]
            found = []
            for unit in (head, tail):
                ids = known.get(unit)
                if ids is None:
                    ids = known[unit] = array("I", self.encode(unit)).tobytes()
                found.append(ids)
            return b"".join(found)
        ids = known[stretch] = array("I", self.encode(stretch)).tobytes()
        return ids

    def __call__(self, text: str) -> bytes:
        if self.beside.search(text):
            return array("I", self.encode(text)).tobytes()
        known, learn, out = self.known, self._learn, []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(known.get("\n") or learn("\n"))
            first, *rest = line.split(" ")
            for s in (first, *[" " + r for r in rest]):
                out.append(known.get(s) or learn(s))
        if len(known) > self.keep:
            self.known = {}
        return b"".join(out)


def _rests(length: int, grain: int) -> list[int]:
    """Cut a rest into powers of two times ``grain``, the widest first."""
    cuts = []
    units = length // grain
    while units:
        part = 1 << (units.bit_length() - 1)
        cuts.append(part * grain)
        units -= part
    if cuts:
        cuts[-1] += length - sum(cuts)
    return cuts or [length]


def _tokenise(
    tokenizer: str, capacity: int, grain: int, filler: int, with_ids: bool, schema: pa.Schema
):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TokenBytes(tokenizer)
        part = TaskContext.get().partitionId()
        ranks = np.zeros(capacity // grain + 2, dtype=np.int64).tolist()
        full = capacity // grain + 1
        turn = 0
        for batch in pieces(batches, 256):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            of: list[int] = []
            for i, ids in enumerate(map(encode, texts)):
                ids += b"\0\0\0\0"
                total = len(ids) // 4
                whole, rest = divmod(total, capacity)
                cuts = [capacity] * whole
                if rest:
                    cuts += _rests(rest, grain) if turn % filler == 0 else [rest]
                    turn += 1
                start = 0
                for length in cuts:
                    piece = ids[4 * start : 4 * (start + length)]
                    width = full if length == capacity else -(-length // grain)
                    rows.append(
                        (
                            start,
                            length,
                            zlib.crc32(piece),
                            total,
                            width,
                            part,
                            ranks[width],
                            piece if with_ids else None,
                        )
                    )
                    ranks[width] += 1
                    of.append(i)
                    start += length
            arrays = [batch.column(0).take(pa.array(of, pa.int64())).cast(schema.field(0).type)]
            for k, column in enumerate(zip(*rows), start=1):
                arrays.append(pa.array(column, schema.field(k).type))
            if rows:
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _price(values: np.ndarray, widths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack dynamic programme: the pattern of the largest value that fits, and that value."""
    good = values > 1e-12
    items, worth = widths[good], values[good]
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    order = np.argsort(items)
    items, worth, back = items[order], worth[order], np.flatnonzero(good)[order]
    for room in range(1, capacity + 1):
        fits = np.searchsorted(items, room, side="right")
        best[room] = best[room - 1]
        if fits:
            gain = best[room - items[:fits]] + worth[:fits]
            k = int(gain.argmax())
            if gain[k] > best[room] + 1e-12:
                best[room], last[room] = gain[k], k
    pattern = np.zeros(len(widths))
    room = capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            pattern[back[last[room]]] += 1
            room -= items[last[room]]
    return float(best[capacity]), pattern


def _greedy(left: dict[int, float], capacity: int) -> dict[int, int]:
    """A pattern filled from the widest piece left to the narrowest."""
    room, uses = capacity, {}
    for w in sorted((w for w, n in left.items() if n > 0), reverse=True):
        if take := int(min(-(-left[w] // 1), room // w)):
            uses[w] = take
            room -= take * w
    return uses


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination, free of the thread pools of linear algebra libraries."""
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0.0
        work -= np.outer(factor, work[k])
    return work[:, n:]


def cutting_stock(
    demand: dict[int, int], capacity: int, gap: float = 1e-3, rounds: int = 4000
) -> list[tuple[int, dict[int, int]]]:
    """Patterns and how often each is used, so that every piece is placed.

    The linear programme min sum(x), A x = demand starts from greedy patterns, each of which uses
    up a width and so adds a column to a triangular basis; the knapsack prices new columns
    against the duals. The value of the best column bounds how far the programme is from its
    optimum, and pricing stops within ``gap`` of it (or after ``rounds`` pivots, when the
    patterns are still feasible). Solutions are rounded down, and the pieces left, fewer than the
    patterns hold once, are filled up greedily. Works on the histogram only, so its size is that
    of the capacity.
    """
    widths = np.array(sorted(w for w, n in demand.items() if n > 0), dtype=np.int64)
    if not len(widths):
        return []
    row = {int(w): i for i, w in enumerate(widths)}
    rest = {int(w): float(demand[int(w)]) for w in widths}
    patterns = np.zeros((len(widths), len(widths)))  # a column per basic pattern
    amount = np.zeros(len(widths))
    for k in range(len(widths)):
        uses = _greedy(rest, capacity)
        amount[k] = min(rest[w] / a for w, a in uses.items())
        used_up = min(uses, key=lambda w: rest[w] / uses[w])
        for w, a in uses.items():
            patterns[row[w], k] = a
            rest[w] = max(rest[w] - a * amount[k], 1e-9)
        rest[used_up] = 0.0
    inverse = _inverse(patterns)
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        value, pattern = _price(duals, widths, capacity)
        if value <= 1.0 + gap:
            break
        direction = (inverse * pattern).sum(axis=1)
        able = np.flatnonzero(direction > 1e-9)
        ratio = amount[able] / direction[able]
        out = able[int(ratio.argmin())]
        step = amount[out] / direction[out]
        amount = np.maximum(amount - step * direction, 0.0)
        amount[out] = step
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        patterns[:, out] = pattern
    left = {int(w): int(demand[int(w)]) for w in widths}
    result: list[tuple[int, dict[int, int]]] = []
    for column in np.argsort(-amount, kind="stable"):
        uses = {int(w): int(a) for w, a in zip(widths, patterns[:, column]) if a}
        times = min([int(amount[column] + 1e-6), *(left[w] // a for w, a in uses.items())])
        if times > 0:
            result.append((times, uses))
            for w, a in uses.items():
                left[w] -= a * times
    while any(left.values()):
        uses = _greedy(left, capacity)
        times = min(left[w] // a for w, a in uses.items())
        result.append((times, uses))
        for w, a in uses.items():
            left[w] -= a * times
    return result


class Slots:
    """Places of ranked pieces: the n-th piece of a width goes to the plan's n-th slot for it."""

    def __init__(self, plan: list[tuple[int, dict[int, int]]]):
        found: dict[int, list[tuple[int, int, int]]] = {}
        counts: dict[int, int] = {}
        self.sequences = 0
        for times, uses in plan:
            for width, each in uses.items():
                begin = counts.get(width, 0)
                found.setdefault(width, []).append((begin, self.sequences, each))
                counts[width] = begin + each * times
            self.sequences += times
        self.table = {w: np.array(rows, dtype=np.int64).T for w, rows in found.items()}

    def place(self, widths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence of each piece, and its place among the pieces of its width there."""
        sequence = np.empty(len(widths), dtype=np.int64)
        place = np.empty(len(widths), dtype=np.int64)
        for width in np.unique(widths):
            begin, first, each = self.table[int(width)]
            at = np.flatnonzero(widths == width)
            k = np.searchsorted(begin, ranks[at], side="right") - 1
            inside = ranks[at] - begin[k]
            sequence[at] = first[k] + inside // each[k]
            place[at] = inside % each[k]
        return sequence, place


def _placing(slots: Slots, full: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("width").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            sequence = slots.sequences + rank
            place = np.zeros(len(rank), dtype=np.int64)
            part = np.flatnonzero(width != full)
            if len(part):
                sequence[part], place[part] = slots.place(width[part], rank[part])
            more = [pa.array(sequence), pa.array(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], schema=schema)

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    grain: int = 4,
    gap: float = 1e-3,
    filler: int = 8,
    with_ids: bool = True,
) -> DataFrame:
    """Pack the tokens of all documents into sequences of at most ``capacity`` tokens.

    A document is its token ids and a closing id 0. It is cut into full sequences and one rest;
    every ``filler``-th rest is cut on into powers of two, small pieces that fill what the wide
    ones leave. Rests, measured in widths of ``grain`` tokens, are the pieces of a cutting-stock problem that
    is solved on their histogram (see ``cutting_stock``); at most ``grain - 1`` tokens of room a
    piece are lost to the rounding. Pieces are ranked within their width by task and by place in
    the task, and the rank decides the pattern, sequence and slot. Only the histogram (capacity /
    grain numbers) comes to the driver; only the plan, of that size too, goes back. A width that
    holds a third of all pieces is ranked like any other, as counts per task are added up.

    One row per piece: the id column, ``start``, ``length``, ``ids_crc32`` (of the ids as
    unsigned little-endian 32-bit numbers), ``doc_tokens``, ``sequence_id``, ``offset`` (gapless
    from 0 in a sequence) and, unless ``with_ids`` is false, ``ids`` (those bytes). Null and empty
    texts are the closing id alone. Null ids and repeated rows are documents of their own; other
    input columns are not read. Empty table: no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("__text"))
    cut_schema = schema_of(docs, [id_col], MORE)
    run = _tokenise(tokenizer, capacity, grain, filler, with_ids, to_arrow_schema(cut_schema))
    cut = cut_lineage(docs.mapInArrow(run, cut_schema), "pieces")
    full = capacity // grain + 1
    counts = cut.groupBy("width", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("width").orderBy("part")
    before = counts.select(
        F.col("width").alias("w"),
        F.col("part").alias("p"),
        (F.sum("n").over(earlier) - F.col("n")).alias("before"),
    )
    histogram = {r.width: r.n for r in counts.groupBy("width").agg(F.sum("n").alias("n")).collect()}
    histogram.pop(full, None)
    slots = Slots(cutting_stock(histogram, capacity // grain, gap))
    ranked = cut.join(before, (F.col("width") == F.col("w")) & (F.col("part") == F.col("p"))).drop(
        "w", "p"
    )
    placed_schema = schema_of(docs, [id_col], MORE + ", sequence_id long, place long")
    placed = ranked.mapInArrow(_placing(slots, full, to_arrow_schema(placed_schema)), placed_schema)
    inside = (
        Window.partitionBy("sequence_id")
        .orderBy(F.col("width").desc(), "place")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    shared = placed.filter(F.col("width") != full).withColumn(
        "offset", F.sum("length").over(inside) - F.col("length")
    )
    alone = placed.filter(F.col("width") == full).withColumn("offset", F.lit(0).cast("long"))
    ids = ["ids"] if with_ids else []
    return shared.unionByName(alone).select(
        id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *ids
    )
