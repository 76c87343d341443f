"""Language predictions of whole batches against n-grams counted one by one."""

import random
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm import language_id
from tallyframe.llm.language_id import Profiles, _hash, grams

SIZE = 40


def learned(texts):
    found = Counter(g for t in texts for w in t.encode().split() for g in grams(w))
    return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:SIZE]]


def by_hand(text, profiles):
    times = Counter(g for w in (text or b"").split() for g in grams(w))
    if not times:
        return "und", 0.0
    top = sorted(times, key=lambda g: (-times[g], _hash(g)))[:SIZE]
    far = []
    for lang in sorted(profiles):
        ranks = {g: k for k, g in enumerate(profiles[lang])}
        far.append(sum(min(abs(ranks.get(g, 10**9) - k), SIZE) for k, g in enumerate(top)))
    near = np.exp((min(far) - np.array(far, float)) / (0.02 * SIZE * len(top)))
    return sorted(profiles)[far.index(min(far))], float(1.0 / near.sum())


@pytest.fixture(scope="module")
def profiles():
    return {"aa": learned(["the cat and the hat", "that is it"]), "bb": learned(["le chat est là", "l'été"])}


def texts():
    draw = random.Random(3)
    signs = "abthe  _1\n\t\x1cİΣéß²'中\U0001d400\U0001d7d8́"
    made = ["", " ", "12 _", "a", "THE Hat", "ΣΑΣ Σ", "the " * 90]
    made += ["".join(draw.choice(signs) for _ in range(draw.randrange(120))) for _ in range(400)]
    return [t.encode() for t in made] + [None]


@pytest.mark.parametrize("chars", [1 << 18, 300, 20])
def test_like_one_by_one(profiles, monkeypatch, chars):
    monkeypatch.setattr(language_id, "CHARS", chars)
    found = Profiles(profiles, SIZE).predict_all(texts())
    assert found == [by_hand(t, profiles) for t in texts()]


def test_words_are_not_taken_one_by_one(profiles, monkeypatch):
    wanted = [by_hand(t, profiles) for t in texts()]
    calls = []
    monkeypatch.setattr(language_id, "grams", lambda w: calls.append(w) or grams(w))
    model = Profiles(profiles, SIZE)
    assert [model.predict(t) for t in texts()] == wanted
    assert not calls


def test_more_letters_than_numbers(profiles):
    letters = [chr(c) for c in range(0x3400, 0x1FFFF) if chr(c).isalpha()]
    letters += [chr(c) for c in range(0x20000, 0x33000) if chr(c).isalpha()]
    assert len(letters) > 1 << 16
    model = Profiles(profiles, SIZE)
    every = [" ".join(letters[k : k + 30_000]).encode() for k in range(0, len(letters), 30_000)]
    assert model.predict_all([*every, b"the hat"]) == [by_hand(t, profiles) for t in [*every, b"the hat"]]
