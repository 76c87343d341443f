"""The language model of the quality rules: whole texts, real signs, probabilities that add up."""

import numpy as np
import pytest

from tallyframe.llm.quality import KneserNey, border_grams, quality_rules, word_grams


def _model(texts):
    listed = [t.encode().split() for t in texts]
    inside = word_grams([w for words in listed for w in words])[0]
    return KneserNey(*np.unique(np.r_[inside, border_grams(listed)[0]], return_counts=True))


def test_probabilities_add_up_and_signs_are_told_apart():
    model = _model(["the cat sat on the mat", "une forêt ā ŀ", "a"])
    for context in [*model.contexts2.tolist(), (122 << 21) | 122]:
        after = (context << 21) | np.r_[model.one, 0x10FFFF]
        assert model.probabilities(after).sum() == pytest.approx(1.0, abs=1e-9)
    # code points that are equal modulo 64 are different signs
    assert ord("ŀ") % 64 == ord("Ā") % 64
    seen, other = (word_grams([w.encode()])[0] for w in ("ŀ", "Ā"))
    assert model.probabilities(seen)[0] > model.probabilities(other)[0]


def test_texts_are_scored_sign_by_sign_across_their_words():
    texts = ["ab cd é ab", "x"]
    model = _model(texts)
    listed = [t.encode().split() for t in texts]
    for words, borders in zip(listed, model.log_borders(listed)):
        signs = [0, 32, *map(ord, " ".join(w.decode() for w in words)), 32]
        three = [(a << 42) | (b << 21) | c for a, b, c in zip(signs, signs[1:], signs[2:])]
        whole = np.log(model.probabilities(np.array(three))).sum()
        assert model.log(words).sum() + borders == pytest.approx(whole)


def test_order_of_words_counts(spark):
    rng = np.random.default_rng(5)
    endings, begins = ["ba", "bo", "bi"], ["kan", "kon", "kin"]
    rows = []
    for k in range(40):
        words = []
        for _ in range(40):  # vowels are followed by k, n by b
            words += [str(rng.choice(endings)), str(rng.choice(begins))]
        rows.append((k, " ".join(words), "l"))
    rows.append((40, " ".join(sorted(rows[0][1].split())), "l"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.log_perplexity for r in quality_rules(df).collect()}
    again = {r.doc_id: r.log_perplexity for r in quality_rules(df.repartition(7)).collect()}
    assert found[40] > found[0] + 0.01
    assert found == pytest.approx(again)
