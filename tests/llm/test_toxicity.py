"""The automaton against plain edit distances, and edges of the toxicity scores."""

import random

import pytest

from tallyframe.llm.toxicity import FEATURES, Lexicon, describe, fit_weights, labelled_texts, learn_lexicon, score_toxicity


def distances(a, b):
    """The row of distances of ``b`` to every prefix of ``a``."""
    row = list(range(len(a) + 1))
    for j, c in enumerate(b, 1):
        new = [j]
        for i, own in enumerate(a):
            new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (own != c)))
        row = new
    return row


def plain_fuzzy(terms, word, edits):
    for term in terms:
        t = term.removesuffix("$")
        row = distances(word, t)
        if term.endswith("$") and len(t) >= 5 and row[-1] <= edits:
            return True
        if not term.endswith("$") and len(t) >= 6 and min(row) <= edits:
            return True
    return False


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_automaton_is_edit_distance(edits):
    r = random.Random(edits)
    terms = ["".join(r.choices("abc", k=r.randint(3, 8))) + r.choice(["", "$"]) for _ in range(12)]
    terms += ["abcabc", "abcabca$", "ccccc$"]
    lexicon, hits = Lexicon(terms), 0
    for _ in range(4000):
        word = "".join(r.choices("abcd", k=r.randint(0, 9)))
        if r.random() < 0.5:
            word = r.choice(terms).removesuffix("$")
            for _ in range(r.randint(0, 3)):
                at = r.randint(0, len(word))
                word = word[:at] + r.choice(["", "a", "d"]) + word[at + r.randint(0, 1) :]
        found = lexicon.fuzzy(word, edits)
        assert found == plain_fuzzy(terms, word, edits), word
        if edits == 1 and word and not lexicon.exact(word):
            assert lexicon.grade(word) == int(found), word
        hits += found
    assert 100 < hits < 3900


def test_empty_lexicon_and_signs():
    assert describe(Lexicon([]), "any word")[0] == 0
    lexicon = Lexicon(["scoundrel$", "vileness"])
    assert [lexicon.of(w) for w in ("scoundrel", "sc0undrel", "s.c.o.u.n.d.r.e.l", "scoundre!", "scound")] == [2, 1, 1, 1, 0]
    assert [lexicon.of(w) for w in ("vilenesses", "v1leness,", "(scoundrel)", "")] == [2, 1, 2, 0]
    assert [(lexicon.exact(w), lexicon.fuzzy(w)) for w in ("$", "*>", "scoundre>")] == [
        (False, False), (False, False), (False, True)
    ]


def test_edges(spark):
    rows = [(k, "plain words here" if k % 2 else "plain scoundrelish words", (k + 1) % 2) for k in range(60)]
    known = spark.createDataFrame([*rows, (99, None, 1), (98, "x", None)], "doc_id long, text string, toxic int")
    terms = learn_lexicon(known)
    assert terms == ["sco"]
    weights = fit_weights(known, terms)
    docs = spark.createDataFrame(
        [(1, "scoundrelish", "a", 5.0), (1, "scoundrelish", "a", 5.0), (2, None, "b", None), (None, "", "c", 1.0),
         (3, "x " * 200_000 + "scoundrelish", "d", 2.0)],
        "doc_id long, text string, SCORE string, Exact double",
    )
    found = score_toxicity(docs, terms, weights)
    assert set(found.columns) == {"doc_id", *FEATURES, "score", "predicted"}
    got = sorted((r.doc_id or 0, r.score, r.predicted) for r in found.select("doc_id", "score", "predicted").collect())
    assert [g[0] for g in got] == [0, 1, 1, 2, 3] and got[1] == got[2] and got[0][1] == got[3][1]
    assert [g[2] for g in got[:4]] == [0, 1, 1, 0] and all(0 <= g[1] <= 1 for g in got)
    none = docs.limit(0)
    assert score_toxicity(none, learn_lexicon(known.limit(0)), fit_weights(known.limit(0), [])).collect() == []


def test_labels_are_joined_once_and_bounded(spark):
    docs = spark.createDataFrame([(k, f"t{k}", "x") for k in range(400)] + [(None, "n", "x")], "doc_id long, text string, Toxic string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)] + [(2, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    found = {r.text: r.toxic for r in labelled_texts(docs, labels).collect()}
    assert found == {f"t{k}": 1 if k == 2 else k % 2 for k in range(400)}
    assert 20 < labelled_texts(docs, labels, bound=50).count() < 90
