"""Quality rules: modified Kneser-Ney perplexity with bands per language.

The model runs over the characters of a text, one blank between two words, one before the first and
one after the last. Its n-grams cross the blanks: those inside a word and its blanks are counted
from the distinct words, weighted by their counts, and those from the end of a word to the begin of
the next from the distinct borders. Both combine well before the shuffle. Each code point is a sign
of its own, so three of them are one number below 2 ** 63 without any hashing; the model of a
language holds its different n-grams, which grow with its alphabet and hardly with the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.llm.common import pieces, schema_of, utf8, without
from tallyframe.session import cut_lineage

BITS = 21  # of a code point
LAST = (1 << BITS) - 1
BLANK = 32
SYMBOLS = "#*$%&|<>"  # fixed value: the characters that count as symbols
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
RESULT = (*BASE, "log_perplexity", "low", "high", "kept")


def _lang(value: str | None) -> str:
    return value or "und"


def _counts(most: int, borders: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        crossed: dict[str, Counter] = {}

        def flush():
            for lang, counter in found.items():
                if counter:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(counter)),
                            pa.array(list(counter), pa.binary()),
                            pa.nulls(len(counter), pa.int64()),
                            pa.array(list(counter.values()), pa.int64()),
                        ],
                        names=["lang", "word", "gram", "n"],
                    )
            for lang, counter in crossed.items():
                if counter:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(counter)),
                            pa.nulls(len(counter), pa.binary()),
                            pa.array(list(counter), pa.int64()),
                            pa.array(list(counter.values()), pa.int64()),
                        ],
                        names=["lang", "word", "gram", "n"],
                    )
            found.clear()
            crossed.clear()

        for batch in pieces(batches, 512):
            of: dict[str, list[list[bytes]]] = {}
            for text, lang in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                if text:
                    of.setdefault(_lang(lang), []).append(text.split())
            for lang, listed in of.items():
                counter = found.setdefault(lang, Counter())
                for words in listed:
                    counter.update(words)
                if borders:
                    grams, n = np.unique(border_grams(listed)[0], return_counts=True)
                    more = crossed.setdefault(lang, Counter())
                    more.update(dict(zip(grams.tolist(), n.tolist())))
            if sum(map(len, found.values())) + sum(map(len, crossed.values())) > most:
                yield from flush()
        yield from flush()

    return run


def _counted(docs: DataFrame, text: str, lang: str, most: int, borders: bool) -> DataFrame:
    part = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").cast("string").alias("l"))
    counted = part.mapInArrow(
        _counts(most, borders), "lang string, word binary, gram long, n long"
    )
    return counted.groupBy("lang", "word", "gram").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame, text: str, lang: str, most: int = 300_000) -> DataFrame:
    """(lang, word, n) over all texts; a task holds at most ``most`` words before it passes on."""
    return _counted(docs, text, lang, most, False).drop("gram")


def sign_counts(docs: DataFrame, text: str, lang: str, most: int = 300_000) -> DataFrame:
    """(lang, word, gram, n): the words of all texts, and the n-grams across their borders.

    One of ``word`` and ``gram`` is null. A task holds at most about ``most`` of both.
    """
    return _counted(docs, text, lang, most, True)


def codes_of(text: bytes) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)


def word_grams(listed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every three signs of each word between its blanks, and the place of the word."""
    if not listed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = codes_of(b" " + b" ".join(listed) + b" ")
    end = np.flatnonzero(codes == BLANK)
    word = np.repeat(np.arange(len(listed)), np.diff(end))  # of the sign before the blank too
    keep = codes[1:-1] != BLANK  # no n-gram has its second sign between two words
    three = (codes[:-2] << 2 * BITS) | (codes[1:-1] << BITS) | codes[2:]
    return three[keep], word[1:][keep]


def border_grams(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The last sign before each word, its blank and its first sign, and the place of the text.

    Nothing, 0, is before the blank of a text's first word.
    """
    texts_ = [(i, words) for i, words in enumerate(texts) if words]
    if not texts_:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = codes_of(b"".join([b"\n" + b" ".join(words) for _, words in texts_]))
    at = np.flatnonzero((codes == BLANK) | (codes == 10))
    opens = codes[at] == 10
    before = np.where(opens, 0, codes[at - 1])
    text = np.array([i for i, _ in texts_])[np.cumsum(opens) - 1]
    return (before << 2 * BITS) | (BLANK << BITS) | codes[at + 1], text


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 20_000):
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        listed, crossed = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        n = batch.column(3).to_numpy()
        inside = np.array([w is not None for w in listed], bool)
        for lang in dict.fromkeys(langs):
            at = np.flatnonzero((langs == lang) & inside)
            own, word = word_grams([listed[i] for i in at])
            other = np.flatnonzero((langs == lang) & ~inside)
            borders = np.array([crossed[i] for i in other], np.int64)
            found, where = np.unique(np.r_[own, borders], return_inverse=True)
            sums = np.zeros(len(found), np.int64)
            np.add.at(sums, where, np.r_[n[at][word], n[other]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found)), pa.array(found), pa.array(sums)],
                names=["lang", "gram", "n"],
            )


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts for counts of 0, 1, 2 and more, from the counts of counts."""
    t = [max(int((counts == k).sum()), 1) for k in range(1, 5)]
    y = t[0] / (t[0] + 2 * t[1])
    d = [k - (k + 1) * y * t[k] / t[k - 1] for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, start=1))])


def _level(grams: np.ndarray, counts: np.ndarray):
    """Discounted share of each n-gram in its context, and the mass each context keeps back."""
    d = _discounts(counts)[np.minimum(counts, 3)]
    contexts, where = np.unique(grams >> BITS, return_inverse=True)
    total = np.bincount(where, counts)
    return (counts - d) / total[where], contexts, np.bincount(where, d) / total


class KneserNey:
    """Interpolated modified Kneser-Ney of one language, in sorted arrays of n-grams."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        self.three, n3 = grams[order], counts[order]
        # lower orders count the different signs before
        self.two, n2 = np.unique(self.three & (1 << 2 * BITS) - 1, return_counts=True)
        self.one, n1 = np.unique(self.two & LAST, return_counts=True)
        share, _, back = _level(self.one, n1)
        # all signs that the language never showed are one more
        self.unseen = (float(back[0]) if len(back) else 1.0) / (len(self.one) + 1)
        self.p1 = share + self.unseen
        share, self.contexts1, self.back1 = _level(self.two, n2)
        self.p2 = share + self._lower(self.contexts1, self.back1, self.two >> BITS) * self._one(
            self.two & LAST
        )
        share, self.contexts2, self.back2 = _level(self.three, n3)
        self.p3 = share + self._lower(self.contexts2, self.back2, self.three >> BITS) * self._two(
            self.three & (1 << 2 * BITS) - 1
        )

    @staticmethod
    def _of(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other) -> np.ndarray:
        if not len(keys):
            return np.broadcast_to(other, wanted.shape)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], other)

    def _lower(self, contexts: np.ndarray, back: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        return self._of(contexts, back, wanted, 1.0)

    def _one(self, one: np.ndarray) -> np.ndarray:
        return self._of(self.one, self.p1, one, self.unseen)

    def _two(self, two: np.ndarray) -> np.ndarray:
        unseen = self._lower(self.contexts1, self.back1, two >> BITS) * self._one(two & LAST)
        return self._of(self.two, self.p2, two, unseen)

    def probabilities(self, three: np.ndarray) -> np.ndarray:
        """Of the last sign of each n-gram after the two before it."""
        unseen = self._lower(self.contexts2, self.back2, three >> BITS) * self._two(
            three & (1 << 2 * BITS) - 1
        )
        return self._of(self.three, self.p3, three, unseen)

    def log(self, listed: list[bytes]) -> np.ndarray:
        """Natural logarithm of what each word adds after its first sign, the blank included."""
        three, word = word_grams(listed)
        return np.bincount(word, np.log(self.probabilities(three)), len(listed))

    def log_borders(self, texts: list[list[bytes]]) -> np.ndarray:
        """Natural logarithm of the first signs of each text's words after the words before."""
        three, text = border_grams(texts)
        different, where = np.unique(three, return_inverse=True)
        return np.bincount(text, np.log(self.probabilities(different))[where], len(texts))


def fit(counts: DataFrame) -> dict[str, KneserNey]:
    """A model per language from ``sign_counts``; its different n-grams come to the driver."""
    rows = (
        counts.mapInArrow(_gram_counts, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    langs = np.array(rows.column("lang").to_pylist(), dtype=object)
    grams_, n = rows.column("gram").to_numpy(), rows.column("n").to_numpy()
    return {str(x): KneserNey(grams_[langs == x], n[langs == x]) for x in dict.fromkeys(langs)}


def base_features(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    listed = text.split()
    n = len(listed)
    chars = len(text.decode("utf-8")) - sum(map(text.count, b" \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS.encode()))
    lines = [x for x in text.split(b"\n") if x.split()]
    repeats = 0
    if n >= 3:
        ids: dict[bytes, int] = {}
        at = np.fromiter((ids.setdefault(w, len(ids)) for w in listed), np.int64, n)
        _, pairs = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)
        _, where, times = np.unique(
            pairs[:-1] * len(ids) + at[2:], return_inverse=True, return_counts=True
        )
        again = times[where] >= 2
        marks = np.zeros(n, bool)
        for k in range(3):
            marks[k : k + n - 2] |= again
        repeats = int(marks.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


def _score(models: dict[str, KneserNey], width: int, schema: pa.Schema, most: int = 300_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[bytes, float]] = {}
        for batch in pieces(batches, 256):
            texts, langs = utf8(batch.column(0)), batch.column(1).to_pylist()
            of: dict[str, list[int]] = {}
            for i, lang in enumerate(langs):
                of.setdefault(_lang(lang), []).append(i)
            perplexity: list[float | None] = [None] * len(texts)
            for lang, at in of.items():
                own = known.setdefault(lang, {})
                if len(own) > most:
                    own.clear()
                listed = {i: (texts[i] or b"").split() for i in at}
                borders = models[lang].log_borders(list(listed.values())) if any(listed.values()) else ()
                new = list({w for ws in listed.values() for w in ws}.difference(own))
                if new:
                    own.update(zip(new, models[lang].log(new).tolist()))
                for k, (i, ws) in enumerate(listed.items()):
                    if ws:
                        inside = sum(map(own.__getitem__, ws))
                        perplexity[i] = -float(inside + borders[k]) / sign_number(ws)
            rows = []
            for i, text in enumerate(texts):
                base = base_features(text)
                failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
                rows.append((*base, failed, perplexity[i]))
            made = [
                pa.array(c, schema.field(width + k).type) for k, c in enumerate(zip(*rows))
            ]
            if rows:
                kept = [c.cast(schema.field(k).type) for k, c in enumerate(batch.columns[2:])]
                yield pa.RecordBatch.from_arrays([*kept, *made], schema=schema)

    return run


def sign_number(listed: list[bytes]) -> int:
    """Signs that the words of a text ask the model for: their characters and a blank after each."""
    return len(b"".join(listed).decode("utf-8")) + len(listed)


def bands(scored: DataFrame, spread: float, step: float = 1e-3) -> dict[str, tuple[float, float]]:
    """Lower and upper log-perplexity per language: median -/+ ``spread`` robust deviations.

    From a histogram in steps of a thousandth over all documents that pass the base rules, which
    combines before the shuffle and comes to the driver as a few thousand counts a language.
    """
    rows = (
        scored.filter("not base_failed")
        .groupBy("__lang", F.round(F.col("log_perplexity") / step).cast("long").alias("b"))
        .agg(F.count("*").alias("n"))
        .collect()
    )
    found = {}
    for lang in {r["__lang"] for r in rows}:
        at = np.array([(r["b"], r["n"]) for r in rows if r["__lang"] == lang])
        middle = _median(at[:, 0], at[:, 1])
        off = 1.4826 * max(_median(np.abs(at[:, 0] - middle), at[:, 1]), 1)
        found[lang] = ((middle - spread * off) * step, (middle + spread * off) * step)
    return found


def _median(values: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(values)
    sums = np.cumsum(n[order])
    return float(values[order][np.searchsorted(sums, (sums[-1] + 1) / 2)])


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    spread: float = 4.0,
    with_text: bool = True,
) -> DataFrame:
    """Base counts, perplexity under a model of the document's language, and the verdict.

    Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed`` (fewer than 50 words, or over half of them in repeated 3-word windows),
    ``log_perplexity`` (natural, per sign), the band ``low``, ``high`` of the language, and
    ``kept``. The text column is left out unless ``with_text``.

    The models and bands are learned from all texts. Null or empty language: the language `und`.
    Null and empty texts have no words and fail the base rules; a language without any document
    that passes them has no band, and none of it is kept. Repeated rows count as often as they
    occur. Columns called like a result column are replaced.
    """
    docs = without(docs, *[r for r in RESULT if r not in (text_col, lang_col)])
    models = fit(sign_counts(docs, text_col, lang_col))
    rest = [c for c in docs.columns if with_text or c != text_col]
    lang = F.coalesce(
        F.when(F.col(f"`{lang_col}`") != "", F.col(f"`{lang_col}`")), F.lit("und")
    )
    ready = docs.select(
        F.col(f"`{text_col}`").alias("__text"),
        lang.alias("__own"),
        lang.alias("__lang"),
        *[F.col(f"`{c}`") for c in rest],
    )
    more = (
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, log_perplexity double"
    )
    schema = schema_of(ready, ["__lang", *rest], more)
    run = _score(models, 1 + len(rest), to_arrow_schema(schema))
    scored = cut_lineage(ready.mapInArrow(run, schema), "scored")
    limits = bands(scored, spread)
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(k, a, b) for k, (a, b) in limits.items()], "__l string, low double, high double"
    )
    verdict = ~F.col("base_failed") & F.col("log_perplexity").between(F.col("low"), F.col("high"))
    return (
        scored.join(F.broadcast(table), F.col("__lang") == F.col("__l"), "left")
        .withColumn("kept", F.coalesce(verdict, F.lit(False)))
        .drop("__lang", "__l")
    )
