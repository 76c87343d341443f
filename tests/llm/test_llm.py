"""The dealt operators against brute force, round trips and held-out labels, on small tables."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallyframe.llm.queries import tokenizer_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, score double, n_words string"


def words(text):
    return WORDS.findall(text or "")


def corpus():
    """Copies, near copies, shared passages, nulls, empty texts, one very long text, rare marks."""
    r = random.Random(7)
    vocabulary = ["w%d" % k for k in range(300)]

    def some(n):
        return [r.choice(vocabulary) for _ in range(n)]

    shared, texts = some(70), []
    for k in range(60):
        body = some(r.randint(5, 160))
        if k % 6 == 0:
            at = r.randint(0, len(body))
            body = body[:at] + shared + body[at:]
        texts.append(" ".join(body))
    long = some(150)
    near = list(long)
    near[75] = "changed"
    texts += [" ".join(long), " ".join(near), " ".join(long), " ".join(long).upper()]
    texts += [None, "", " \t\n", "one", "one two", "One  two", "a b   c", "##$ |\n##$ |"]
    texts += ["x y " * 400, " ".join(some(4000)), " ".join(shared) + "\n" + " ".join(shared)]
    sources = ["web", "web", "web", "book", None, "code", ""]
    return [(k, t, ["en", "de", None][k % 3], sources[k % 7], 1.5, "clash") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), COLUMNS).repartition(5)


def by_id(df, id_col="doc_id"):
    return {row[id_col]: row for row in df.collect()}


def test_substring_dedup_is_exact(docs):
    from tallyframe.llm.substring_dedup import substring_dedup

    found = by_id(substring_dedup(docs))
    rows = corpus()
    lowest = {}
    for doc_id, text, *_ in rows:
        listed = words(text)
        for p in range(len(listed) - 49):
            key = tuple(listed[p : p + 50])
            lowest[key] = min(lowest.get(key, doc_id), doc_id)
    removed = 0
    for doc_id, text, *_ in rows:
        listed = words(text)
        gone = set()
        for p in range(len(listed) - 49):
            if lowest[tuple(listed[p : p + 50])] < doc_id:
                gone.update(range(p, p + 50))
        kept = " ".join(w for i, w in enumerate(listed) if i not in gone)
        row = found[doc_id]
        assert (row.n_words, row.n_removed) == (len(listed), len(gone))
        assert row.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        removed += len(gone)
    assert removed > 700 and len(found) == len(rows)


def test_jaccard_components_are_exact(docs):
    from tallyframe.llm.jaccard_join import jaccard_components

    found = by_id(jaccard_components(docs))
    sets = {}
    for doc_id, text, *_ in corpus():
        listed = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        n = max(len(listed) - 2, 1) if listed else 0
        sets[doc_id] = {tuple(listed[p : p + 3]) for p in range(n)}
    component = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    low = min(component[a], component[b])
                    if component[a] != low or component[b] != low:
                        component[a] = component[b] = low
                        changed = True
    assert {d: (len(s), component[d]) for d, s in sets.items()} == {
        d: (r.n_shingles, r.component_id) for d, r in found.items()
    }
    assert len(set(component.values())) < len(component)


def test_mix_comes_near_its_targets_and_agrees(docs):
    from tallyframe.llm.mixing import emit, mix_sources

    mixed = mix_sources(docs)
    found = by_id(mixed)
    again = by_id(mix_sources(docs.repartition(3)))
    assert {d: r.taken for d, r in found.items()} == {d: r.taken for d, r in again.items()}
    total = sum(len(words(t)) for _, t, *_ in corpus())
    assert sum({r.source: r.target for r in found.values()}.values()) == pytest.approx(total)
    for doc_id, text, *_ in corpus():
        assert found[doc_id].size == len(words(text))
        assert found[doc_id].taken <= 3 * found[doc_id].size
    largest = max(r.size for r in found.values())
    for source in {r.source for r in found.values()}:
        mine = [r for r in found.values() if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 3 * largest
    assert emit(mixed).count() == sum(r.copies for r in found.values())


def test_packing_loses_no_token(docs):
    from tokenizers import Tokenizer

    from tallyframe.llm.packing import pack

    rows = pack(docs, tokenizer_path()).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for doc_id, text, *_ in corpus():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted(pieces[doc_id], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in mine) == np.array(ids, "<u4").tobytes()
        assert [r.start for r in mine] == np.cumsum([0, *[r.length for r in mine]])[:-1].tolist()
        assert {r.doc_tokens for r in mine} == {len(ids)}
    for mine in sequences.values():
        mine = sorted(mine, key=lambda r: r.offset)
        assert [r.offset for r in mine] == np.cumsum([0, *[r.length for r in mine]])[:-1].tolist()
        assert sum(r.length for r in mine) <= 1024


def test_base_features_of_quality_rules(docs):
    from tallyframe.llm.quality import quality_rules

    found = by_id(quality_rules(docs))
    for doc_id, text, *_ in corpus():
        listed, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
        windows = [tuple(listed[p : p + 3]) for p in range(len(listed) - 2)]
        repeated = {
            p + k for p, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)
        } if len(windows) < 1000 else None
        row = found[doc_id]
        assert row.n_words == len(listed) and row.word_chars == sum(map(len, listed))
        assert row.n_symbols == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert row.n_dup_lines == len(lines) - len(set(lines))
        if repeated is not None:
            assert row.n_repeat_words == len(repeated)
        failed = row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words
        assert row.base_failed == failed and not (failed and row.kept)


def test_language_model_base_scores(docs):
    from collections import Counter
    from math import log10

    from pyspark.sql import functions as F

    from tallyframe.llm.lm_scoring import score_texts

    found = by_id(score_texts(docs, F.col("doc_id") % 7 != 2))

    def tokens(text):
        return [*words(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), None]

    counts = Counter(t for d, text, *_ in corpus() if d % 7 != 2 for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    for doc_id, text, *_ in corpus():
        row, listed = found[doc_id], tokens(text)
        base = sum(log10((counts[t] + 1) / (n + v + 1)) for t in listed)
        assert row.n_tokens == len(listed) and row.train_tokens == n
        assert row.n_known == sum(counts[t] > 0 for t in listed)
        assert row.base_score == pytest.approx(base, rel=1e-9)
        assert np.isfinite(row["score"]) and row["score"] < 0


def test_nearest_reaches_its_recall(spark):
    from pyspark.sql import functions as F

    from tallyframe.llm.ann import nearest

    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 24))
    x[700:720] = x[700]
    rows = [(k, v.tolist(), "clash") for k, v in enumerate(x)]
    rows += [(5000, None, ""), (5020, [0.0] * 24, ""), (5040, [float("nan")] * 24, "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    found = nearest(table, F.col("vec_id") % 20 == 0).collect()
    hits = total = 0
    for q in range(0, 1500, 20):
        inner = x @ x[q]
        order = [k for k in np.lexsort((np.arange(1500), -inner)) if k != q][:20]
        mine = sorted((f for f in found if f.query_id == q), key=lambda f: f.rank)
        assert [f.rank for f in mine] == list(range(1, 21))
        assert all(f["score"] == pytest.approx(inner[f.vec_id]) for f in mine)
        hits += len({f.vec_id for f in mine} & set(order))
        total += 20
    assert hits >= 0.9 * total and not {f.query_id for f in found} & {5000, 5020, 5040}


def test_archives_round_trip(spark, tmp_path):
    from tallyframe.llm.warc import assemble, read_records, write_archives

    pages = [(1, "http://a/", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "v", "<p>é</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    write_archives(df, str(tmp_path / "out"))
    found = by_id(assemble(read_records(spark, str(tmp_path / "out"))), "page_id")
    for page_id, _, html in pages:
        payload = (html or "").encode()
        row = found[page_id]
        assert row.payload_bytes == len(payload)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert row.response.payload_digest == digest
    assert [found[k].response.type for k in (1, 2, 3, 4)] == ["response", "response", "revisit", "revisit"]
    assert [found[k].refers_to_page for k in (3, 4)] == [2, 1]


def test_languages_are_told_apart(spark):
    from tallyframe.llm.language_id import identify, learn_profiles

    r = random.Random(1)
    stock = {
        "en": "the house of my friend stands near with these other things and they think".split(),
        "de": "das haus von meinem freund steht nahe mit diesen anderen dingen und sie denken".split(),
    }
    rows = [(k, " ".join(r.choices(stock[lang], k=40)), lang) for k in range(40) for lang in stock]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = learn_profiles(known.filter("doc_id % 4 <> 2"), "text", "lang")
    found = identify(known.filter("doc_id % 4 = 2"), profiles).collect()
    assert len(found) == 20 and all(f.lang_pred == f.lang and 0 <= f["score"] <= 1 for f in found)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !")], "doc_id long, text string")
    assert {f.lang_pred for f in identify(odd, profiles).collect()} == {"und"}


def test_misspelled_terms_are_toxic(spark):
    from tallyframe.llm.toxicity import fit_weights, learn_lexicon, score_toxicity

    r = random.Random(2)
    plain = ["word%s" % c for c in "abcdefghijklmnop"]
    rows = []
    for k in range(200):
        body = r.choices(plain, k=30)
        if k % 2:
            body[r.randrange(30)] = "scoundrelish"
        rows.append((k, " ".join(body), k % 2))
    known = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    terms = learn_lexicon(known)
    weights = fit_weights(known, terms)
    fresh = [(1, "worda wordb scoundrelish wordc"), (2, "worda wordb wordc wordd"), (3, None), (4, "")]
    found = by_id(score_toxicity(spark.createDataFrame(fresh, "doc_id long, text string"), terms, weights))
    assert [found[k].predicted for k in (1, 2, 3, 4)] == [1, 0, 0, 0]
    assert all(0 <= f["score"] <= 1 for f in found.values())


def test_empty_tables(spark):
    from pyspark.sql import functions as F

    from tallyframe.llm.jaccard_join import jaccard_components
    from tallyframe.llm.lm_scoring import score_texts
    from tallyframe.llm.mixing import mix_sources
    from tallyframe.llm.packing import pack
    from tallyframe.llm.quality import quality_rules
    from tallyframe.llm.substring_dedup import substring_dedup

    none = spark.createDataFrame([], COLUMNS)
    for df in (
        substring_dedup(none), jaccard_components(none), mix_sources(none),
        pack(none, tokenizer_path()), quality_rules(none), score_texts(none, F.lit(True)),
    ):
        assert df.count() == 0


def test_null_ids_and_repeated_rows(spark):
    from tallyframe.llm.jaccard_join import jaccard_components
    from tallyframe.llm.substring_dedup import substring_dedup

    text = " ".join("t%d" % k for k in range(80))
    rows = [(None, text), (1, text), (1, text), (2, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = substring_dedup(df).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in cut) == [(0, 0), (1, 0), (1, 0), (2, 80)]
    joined = {(r.doc_id, r.component_id) for r in jaccard_components(df).collect()}
    assert joined == {(None, None), (1, 1), (2, 1)}
