"""Toxicity: a learned lexicon as a trie, intersected with Levenshtein automata of the words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.llm.common import pieces, schema_of, without

_LETTERS = re.compile(r"[^\W_]+")
#: Leet signs read as letters, so that a term with signs inside is still one word.
PLAIN = str.maketrans("013457@$", "oieastas")
RESERVED = str.maketrans("$*>", "\0\0\0")  # keys of a trie node that are not letters
QUOTES = "\"'“”„«»‘’"
#: Words that report what others say.
REPORTS = frozenset("said says say wrote writes quote quoted quotes called calls told".split())
FEATURES = ("exact", "fuzzy", "quoted", "density")
SHORTEST, LONGEST = 3, 8  # letters of a stem


def _tokens(text: str) -> set[str]:
    return set(_LETTERS.findall(text.lower()))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each word ("word" and an end mark) and each stem, by label."""
    found: tuple[Counter, Counter] = (Counter(), Counter())

    def flush():
        terms = list(found[0].keys() | found[1].keys())
        if terms:
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms), *[pa.array([c[t] for t in terms], pa.int64()) for c in found]],
                names=["term", "clean", "toxic"],
            )
        for c in found:
            c.clear()

    for batch in pieces(batches, 256):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            terms = set()
            for w in _tokens(text or ""):
                terms.add(w + "$")
                terms.update(w[:n] for n in range(SHORTEST, min(LONGEST, len(w)) + 1))
            found[1 if label else 0].update(terms)
        if len(found[0]) + len(found[1]) > 400_000:
            yield from flush()
    yield from flush()


def labelled_texts(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    bound: int = 200_000,
) -> DataFrame:
    """Text and label of labelled documents, of about ``bound`` by hash of the id where there are more.

    An id with several labels is toxic if any of them is. The bound keeps the labels small enough
    to be broadcast (some 24 bytes each), so no text is shuffled; the lexicon and the weights are
    fitted on these rows.
    """
    known = labels.select(
        F.col(f"`{id_col}`").alias(id_col), F.col(f"`{label_col}`").cast("int").alias(label_col)
    ).filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    parts = max(1, -(-known.select(id_col).distinct().count() // bound))
    few = known.filter(F.pmod(F.xxhash64(id_col), F.lit(parts)) == 0)
    few = few.groupBy(id_col).agg(F.max(label_col).alias(label_col))
    texts = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col))
    return texts.join(F.broadcast(few), id_col).select(text_col, label_col)


def learn_lexicon(
    labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", support: int = 5,
    purity: float = 0.6,
) -> list[str]:
    """Terms of toxic documents: words (ending in "$") and stems, from all rows given.

    A term counts if at least ``support`` toxic documents have it and the lower bound of its
    share of toxic documents (Wilson, 95 %) is at least ``purity``. A stem stands for all words
    that begin with it, so terms behind a stem that counts are dropped. The lexicon comes to the
    driver; ``labelled_texts`` bounds the rows and with them the lexicon.
    """
    known = labelled.select(
        F.col(f"`{text_col}`").alias("t"), F.col(f"`{label_col}`").cast("int").alias("l")
    ).filter("l is not null and t is not null")
    share, z = F.col("toxic") / (F.col("toxic") + F.col("clean")), 1.96
    n = F.col("toxic") + F.col("clean")
    lower = (share + z * z / (2 * n) - z * F.sqrt((share * (1 - share) + z * z / (4 * n)) / n)) / (
        1 + z * z / n
    )
    rows = (
        known.mapInArrow(_term_counts, "term string, clean long, toxic long")
        .groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter((F.col("toxic") >= support) & (lower >= purity))
        .collect()
    )
    kept: set[str] = set()
    for term in sorted((r.term for r in rows), key=len):
        if not any(term[:n] in kept for n in range(SHORTEST, len(term))):
            kept.add(term)
    return sorted(kept)


class Lexicon:
    """A trie of terms, searched by the Levenshtein automaton of a word.

    A state of the automaton is a place in the word and the edits that are left; the walk runs it
    along the trie, so of the trie it visits only what some state allows. An exact hit is a word
    of the lexicon or a word behind a stem; a fuzzy hit is within one edit of a whole term of five
    or more letters (signs read as letters first), or behind a stem of six or more with one edit.
    """

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for term in terms:
            node = self.root
            for c in term.removesuffix("$"):
                node = node.setdefault(c, {})
            node["$" if term.endswith("$") else "*"] = len(term.removesuffix("$"))
        # each node's children by the one or two letters that may follow them; "" for those where
        # a term ends, and one letter where it ends behind that letter
        work = [self.root]
        while work:
            node = work.pop()
            after: dict[str, list] = {"": []}
            for c, child in node.items():
                if c in "$*":
                    continue
                work.append(child)
                for d, grandchild in child.items():
                    for e in grandchild if d not in "$*" else [""]:
                        letters = "" if d in "$*" else d if e in "$*" else d + e
                        after.setdefault(letters, []).append((c, child))
            node[">"] = after
        self.known: dict[str, int] = {}
        # One edit leaves the first three letters of a term as they are, or the next three, in
        # their place or one beside; a word of over six letters is near none of under six.
        long = [t for t in (term.removesuffix("$") for term in terms) if len(t) >= 6]
        self.heads, self.tails = {t[:3] for t in long}, {t[3:6] for t in long}

    def exact(self, word: str) -> bool:
        return self._exact(word.translate(RESERVED))

    def _exact(self, word: str) -> bool:
        node = self.root
        for c in word:
            if "*" in node:
                return True
            node = node.get(c)
            if node is None:
                return False
        return "*" in node or "$" in node

    def fuzzy(self, word: str, edits: int = 1) -> bool:
        return self._reaches(self.root, word.translate(RESERVED), 0, edits)

    @staticmethod
    def _follows(node: dict, word: str, at: int) -> bool:
        """Whether a term ends below ``node`` for the rest of the word as it is."""
        n = len(word)
        while True:
            if node.get("*", 0) >= 6 or (at == n and node.get("$", 0) >= 5):
                return True
            if at == n:
                return False
            node = node.get(word[at])
            if node is None:
                return False
            at += 1

    def _reaches(self, node: dict, word: str, at: int, left: int) -> bool:
        """Whether a term ends below ``node`` for the rest of the word with at most ``left`` edits."""
        if not left:
            return self._follows(node, word, at)
        n = len(word)
        while True:
            if node.get("*", 0) >= 6 or (n - at <= left and node.get("$", 0) >= 5):
                return True
            if left == 1:  # the last edit: of the children, those that the next letters allow
                after = node[">"]
                for rest in (at, at + 1) if at < n else (at,):
                    two, one = word[rest : rest + 2], word[rest : rest + 1]
                    for letters in {two, one, ""}:
                        for c, child in after.get(letters, ()):
                            # a letter too many in the term, or another one in its place
                            if (rest == at or c != word[at]) and self._follows(child, word, rest):
                                return True
                if at < n and self._follows(node, word, at + 1):
                    return True
            else:
                for c, child in node.items():
                    if c in "$*>":
                        continue
                    if at < n and c != word[at] and self._reaches(child, word, at + 1, left - 1):
                        return True
                    if self._reaches(child, word, at, left - 1):
                        return True
                if at < n and self._reaches(node, word, at + 1, left - 1):
                    return True
            if at == n:
                return False
            node = node.get(word[at])
            if node is None:
                return False
            at += 1

    def grade(self, word: str) -> int:
        """2 for an exact hit, 1 for a misspelled one, else 0, of letters and digits."""
        if self._exact(word):
            return 2
        plain = word if word.isalpha() else word.translate(PLAIN)
        if plain is not word and self._exact(plain):
            return 1
        tails = self.tails
        if len(plain) <= 6 or plain[:3] in self.heads or (
            plain[3:6] in tails or plain[2:5] in tails or plain[4:7] in tails
        ):
            return int(self._reaches(self.root, plain, 0, 1))
        return 0

    def of(self, written: str) -> int:
        """The grade of what stands between two blanks: of it, its parts, or its letters joined."""
        got = self.known.get(written)
        if got is None:
            if len(self.known) > 1_000_000:
                self.known = {}
            if written.isalpha():
                got = self.known[written] = self.grade(written)
                return got
            if written.isalnum():
                parts = {written, *_LETTERS.findall(written)}
            else:
                parts = set(_LETTERS.findall(written))
            got = max((self.of(p) if p.isalpha() else self.grade(p) for p in parts), default=0)
            if not got and not written.isalnum():
                joined = "".join(c for c in written.translate(PLAIN) if c.isalnum())
                got = 1 if joined and self.exact(joined) else 0
            self.known[written] = got
        return got


def describe(lexicon: Lexicon, text: str | None, window: int = 5) -> tuple[float, ...]:
    """Features of a text. A hit is quoted if its window has a quotation mark or a reporting word."""
    words = text.lower().split() if text else []
    exact = fuzzy = quoted = 0.0
    for i, grade in enumerate(map(lexicon.of, words)):
        if not grade:
            continue
        near = words[max(0, i - window) : i + window + 1]
        if any(x.strip(".,:;!?") in REPORTS or any(q in x for q in QUOTES) for x in near):
            quoted += 1
        elif grade == 2:
            exact += 1
        else:
            fuzzy += 1
    hits = exact + fuzzy + quoted
    return (
        math.log1p(exact),
        math.log1p(fuzzy),
        math.log1p(quoted),
        math.log1p(100 * hits / max(len(words), 1)),
    )


def _features(terms: list[str], width: int, schema: pa.Schema, weights=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for batch in pieces(batches, 512):
            rows = [describe(lexicon, t) for t in batch.column(0).to_pylist()]
            if not rows:
                continue
            if weights is not None:
                scores = [_sigmoid(weights[0] + sum(a * b for a, b in zip(weights[1:], r))) for r in rows]
                rows = [(*r, s, int(s >= 0.5)) for r, s in zip(rows, scores)]
            made = [pa.array(c, schema.field(width + k).type) for k, c in enumerate(zip(*rows))]
            kept = [c.cast(schema.field(k).type) for k, c in enumerate(batch.columns[1:])]
            yield pa.RecordBatch.from_arrays([*kept, *made], schema=schema)

    return run


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-min(max(x, -30.0), 30.0)))


def fit_weights(
    labelled: DataFrame, terms: list[str], text_col: str = "text", label_col: str = "toxic",
    steps: int = 600,
) -> list[float]:
    """Logistic regression on the features of all rows given, equal features combined."""
    known = labelled.filter(F.col(f"`{label_col}`").isNotNull())
    sample = known.select(
        F.col(f"`{text_col}`").alias("t"), F.col(f"`{label_col}`").cast("int").alias("label")
    )
    schema = schema_of(sample, ["label"], ", ".join(f"{f} double" for f in FEATURES))
    rows = sample.mapInArrow(_features(terms, 1, to_arrow_schema(schema)), schema)
    # equal rows of features are one row with a weight
    table = rows.groupBy("label", *FEATURES).count().toPandas()
    if table.empty or table["label"].nunique() < 2:
        rate = float(table["label"].iloc[0]) if len(table) else 0.0
        return [8.0 * rate - 4.0] + [1.0] * len(FEATURES)
    y, n = table["label"].to_numpy(float), table["count"].to_numpy(float)
    x = np.column_stack([np.ones(len(y)), *[table[f].to_numpy() for f in FEATURES]])
    w, speed, size = np.zeros(x.shape[1]), np.zeros(x.shape[1]), n.sum()
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip((x * w).sum(axis=1), -30, 30)))
        slope = (x * (n * (p - y))[:, None]).sum(axis=0) / size + 1e-4 * np.r_[0.0, w[1:]]
        speed = 0.9 * speed - slope
        w = w + speed
    return w.tolist()


def score_toxicity(
    docs: DataFrame, terms: list[str], weights: list[float], text_col: str = "text"
) -> DataFrame:
    """Adds the features, ``score`` (0 to 1) and ``predicted`` (1 from 0.5); drops the text.

    Null and empty texts have no hits and get the score of such texts. Repeated rows score alike.
    Columns called like a result column, in any case, are replaced.
    """
    keep = without(docs, text_col, *FEATURES, "score", "predicted").columns
    ready = docs.select(F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    more = ", ".join(f"{f} double" for f in FEATURES) + ", score double, predicted int"
    schema = schema_of(ready, keep, more)
    return ready.mapInArrow(_features(terms, len(keep), to_arrow_schema(schema), weights), schema)
