"""Language identification by rank-order profiles of n-grams and out-of-place distance."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.llm.common import pieces, schema_of, utf8
from tallyframe.llm.quality import word_counts

LONGEST = 4
CHARS = 1 << 18  # signs of text whose n-grams are held at a time
_LACKS = 1 << 40  # rank of an n-gram that a profile lacks
_LETTERS = re.compile(r"[^\W\d_]+")


def grams(word: bytes) -> list[str]:
    """N-grams of one to ``LONGEST`` signs of the letter runs of a word, with a mark at the ends."""
    out = []
    for run in _LETTERS.findall(word.decode("utf-8").lower()):
        marked = f"_{run}_"
        out += [
            marked[i : i + n]
            for n in range(1, LONGEST + 1)
            for i in range(len(marked) - n + 1)
            if n > 1 or marked[i] != "_"
        ]
    return out


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, Counter] = {}

    def flush():
        for lang, counter in found.items():
            if counter:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(counter)),
                        pa.array(list(counter)),
                        pa.array(list(counter.values()), pa.int64()),
                    ],
                    names=["lang", "gram", "n"],
                )
        found.clear()

    for batch in pieces(batches, 4096):
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            counter = found.setdefault(lang, Counter())
            for gram in grams(word):
                counter[gram] += n
        if sum(map(len, found.values())) > 500_000:
            yield from flush()
    yield from flush()


def learn_profiles(
    labelled: DataFrame, text_col: str, lang_col: str, size: int = 400
) -> dict[str, list[str]]:
    """The ``size`` most frequent n-grams of each language, ties by the n-gram.

    Words are counted first and combine before they are shuffled. What comes to the driver is
    ``size`` n-grams a language.
    """
    counts = word_counts(
        labelled.filter(F.col(f"`{text_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull()),
        text_col,
        lang_col,
    )
    table = (
        counts.mapInArrow(_gram_counts, "lang string, gram string, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .persist()
    )
    try:
        found = {}
        for lang in sorted(r.lang for r in table.select("lang").distinct().collect()):
            top = table.filter(F.col("lang") == lang).orderBy(F.col("n").desc(), "gram").limit(size)
            found[lang] = [r.gram for r in top.collect()]
        return found
    finally:
        table.unpersist()


def _hash(gram: str) -> int:
    return xxhash.xxh3_64_intdigest(gram.encode("utf-8", "surrogatepass")) >> 1


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter, for all of them."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    letters = np.zeros(sys.maxunicode + 1, bool)
    for run in _LETTERS.finditer(every):
        letters[run.start() : run.end()] = True
    return letters


class _Alphabet:
    """Small numbers for letters, and hashes of n-grams written in them."""

    def __init__(self):
        self.number = np.zeros(sys.maxunicode + 1, np.uint64)
        self.signs = ["", "_"]  # places 0 and 1 are no letters: nothing, and the mark
        self.hashes: dict[int, int] = {}

    def learn(self, signs: np.ndarray) -> bool:
        """Number these code points; False if there are too many for 16 bits."""
        new = np.unique(signs[self.number[signs] == 0])
        if len(self.signs) + len(new) > 1 << 16:
            return False
        self.number[new] = np.arange(len(self.signs), len(self.signs) + len(new), dtype=np.uint64)
        self.signs += map(chr, new.tolist())
        return True

    def hashed(self, codes: list[int]) -> np.ndarray:
        found = self.hashes
        for code in codes:
            if code not in found:
                places = (code >> 48, code >> 32 & 0xFFFF, code >> 16 & 0xFFFF, code & 0xFFFF)
                found[code] = _hash("".join([self.signs[k] for k in places]))
        return np.fromiter(map(found.__getitem__, codes), np.int64, len(codes))


class Profiles:
    def __init__(self, profiles: dict[str, list[str]], size: int):
        self.size = size
        self.langs = sorted(profiles)
        self.keys, self.ranks = [], []
        for lang in self.langs:
            keys = np.array([_hash(g) for g in profiles[lang]], np.int64)
            order = np.argsort(keys)
            self.keys.append(keys[order])
            self.ranks.append(np.arange(len(keys))[order])
        self.alphabet = _Alphabet()

    def predict(self, text: bytes | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        """Predictions of several texts; what is held at a time is bounded by ``CHARS`` of text."""
        out, group, held = [], [], 0
        for text in texts:
            text = (text or b"").decode("utf-8").lower()
            if group and held + len(text) > CHARS:
                out += self._group(group)
                group, held = [], 0
            group.append(text)
            held += len(text)
        return out + self._group(group) if group else out

    def _group(self, texts: list[str]) -> list[tuple[str, float]]:
        if len(texts) == 1 and len(texts[0]) > CHARS:
            return [self._long(texts[0])]
        counted = self._grams(texts)
        if counted is None:  # more letters than numbers
            return [self._long(t) for t in texts]
        keys, parts = counted
        table = self._places(keys)
        out = []
        for k in range(len(texts)):
            times = np.bincount(np.concatenate([g[at[k] : at[k + 1]] for g, at in parts]))
            met = np.flatnonzero(times)
            out.append(self._nearest(met, times[met], table))
        return out

    def _grams(self, texts: list[str]):
        """Sorted hashes of all n-grams, and per length their places there with each text's bounds."""
        if len(self.alphabet.hashes) > 500_000 or len(self.alphabet.signs) > 1 << 15:
            self.alphabet = _Alphabet()
        joined = "\n" + "\n".join(texts) + "\n"
        signs = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[signs]
        if not self.alphabet.learn(signs[letter]):
            return None
        # whatever stands between two runs shrinks to one mark
        kept = letter.copy()
        kept[0] = True
        kept[1:] |= letter[:-1]
        kept = np.flatnonzero(kept)
        is_letter = letter[kept]
        seq = np.where(is_letter, self.alphabet.number[signs[kept]], np.uint64(1))
        # the mark behind a text is the line end behind it, or comes earlier
        ends = np.cumsum([len(t) + 1 for t in texts])
        last = np.searchsorted(kept, ends, side="right")
        bounds = np.concatenate([[1], last])
        pieces_, limits = [], []
        code = seq
        for n in range(1, LONGEST + 1):
            if n > 1:
                code = (code[:-1] << np.uint64(16)) | seq[n - 1 :]
            # an n-gram has marks at its ends only; it belongs to the text of its second sign
            fine = np.ones(len(code), bool)
            if n == 1:
                fine = is_letter
            for k in range(1, n - 1):
                fine &= is_letter[k : k + len(code)]
            at = np.flatnonzero(fine)
            pieces_.append(code[at])
            shift = 0 if n == 1 else 1
            limits.append(np.searchsorted(at + shift, bounds))
        encoded = pa.array(np.concatenate(pieces_)).dictionary_encode()
        hashes = self.alphabet.hashed(encoded.dictionary.to_pylist())
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        numbers = place[encoded.indices.to_numpy()]
        cuts = np.cumsum([len(p) for p in pieces_])[:-1]
        return hashes[order], list(zip(np.split(numbers, cuts), limits))

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each n-gram in each profile, out of reach where the profile lacks it."""
        table = np.full((len(self.langs), len(keys)), _LACKS, np.int64)
        for row, profile, ranks in zip(table, self.keys, self.ranks):
            if len(profile):
                at = np.minimum(np.searchsorted(profile, keys), len(profile) - 1)
                there = profile[at] == keys
                row[there] = ranks[at[there]]
        return table

    def _nearest(self, met: np.ndarray, times: np.ndarray, table: np.ndarray) -> tuple[str, float]:
        """The nearest profile to n-grams given in the order of their hashes."""
        if not len(met) or not self.langs:
            return "und", 0.0
        if len(met) > self.size:  # drop what is rarer than the last place; ties stay in
            enough = times >= -np.partition(-times, self.size - 1)[self.size - 1]
            met, times = met[enough], times[enough]
        top = met[np.argsort(-times, kind="stable")[: self.size]]
        apart = np.abs(table[:, top] - np.arange(len(top)))
        far = np.minimum(apart, self.size).sum(axis=1).astype(float)
        best = int(far.argmin())
        near = np.exp((far[best] - far) / (0.02 * self.size * len(top)))
        return self.langs[best], float(1.0 / near.sum())

    def _long(self, text: str) -> tuple[str, float]:
        """A text counted word by word, which holds its different words and n-grams only."""
        times: Counter = Counter()
        for word, n in Counter(m.group() for m in _LETTERS.finditer(text)).items():
            for gram in grams(word.encode()):
                times[gram] += n
        keys = np.fromiter(map(_hash, times), np.int64, len(times))
        order = np.argsort(keys)
        counts = np.fromiter(times.values(), np.int64, len(times))[order]
        return self._nearest(np.arange(len(keys)), counts, self._places(keys[order]))


def _predict(profiles: dict[str, list[str]], size: int, width: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, size)
        for batch in pieces(batches, 512):
            rows = model.predict_all(utf8(batch.column(0)))
            if rows:
                made = [
                    pa.array(c, schema.field(width + k).type) for k, c in enumerate(zip(*rows))
                ]
                kept = [c.cast(schema.field(k).type) for k, c in enumerate(batch.columns[1:])]
                yield pa.RecordBatch.from_arrays([*kept, *made], schema=schema)

    return run


def identify(
    docs: DataFrame,
    profiles: dict[str, list[str]],
    text_col: str = "text",
    size: int = 400,
) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1, the share of the nearest profile); drops the text.

    A document's ``size`` most frequent n-grams are compared with each profile: the distance is
    the sum of how far each is out of place, ``size`` if the profile lacks it. Ties go to the
    language first by name. Null texts, texts without a letter, and a library without profiles
    give `und` and 0. Repeated rows are predicted alike. Columns called like a result column are
    replaced.
    """
    keep = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    ready = docs.select(F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    schema = schema_of(ready, keep, "lang_pred string, score double")
    return ready.mapInArrow(_predict(profiles, size, len(keep), to_arrow_schema(schema)), schema)
