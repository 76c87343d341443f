"""The stage that drops near duplicates: which rows stay, and what is shuffled for it."""

import random

import corpus_pipeline


def _docs(spark, rows):
    return spark.createDataFrame(
        [(d, t, "l", "s", len(t)) for d, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )


def _text(seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(900)}" for _ in range(80))


def test_near_duplicates_keep_one_row_an_id_and_all_without(spark):
    rows = [(5, _text(1)), (3, _text(1)), (3, _text(1)), (7, _text(2)), (7, _text(2)), (8, _text(3))]
    rows += [(None, _text(1)), (None, _text(1))]
    docs = _docs(spark, rows)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    found = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert found == sorted(
        [(0, _text(1)), (0, _text(1)), (3, _text(1)), (7, _text(2)), (8, _text(3))]
    )


def test_texts_with_ids_of_their_own_are_not_shuffled(spark):
    docs = _docs(spark, [(k, _text(k)) for k in range(50)])
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.count() == 50
    kept.collect()
    plan = kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "hashpartitioning(doc_id" not in plan
