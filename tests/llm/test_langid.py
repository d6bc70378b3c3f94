import random

import numpy as np
import pytest

from panelwatch.llm import langid

SYLLABLES = {"aa": "ka lo mi ten sur", "bb": "zhe prk vno dru tsch", "cc": "éa oue ñon ção íu"}


def sentence(r, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus(seed=2, n=200):
    r = random.Random(seed)
    return [(i, sentence(r, lang := r.choice(list(SYLLABLES)), r.randint(3, 60)), lang) for i in range(n)]


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    return docs, langid.train(docs.where(~langid.held_out()), sample=50)


def test_held_out_accuracy_and_scores(spark, trained):
    docs, model = trained
    rows = langid.classify(docs, model).where(langid.held_out()).select("lang", "_lang.*").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 and not r.rejected for r in rows)
    assert 3 <= len(model.centroids) <= 9


def test_far_texts_are_rejected_and_letterless_ones_undetermined(spark, trained):
    _, model = trained
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "123 +-* ..."), (4, "qqqq xwxw qxqx wwww jjjj " * 20), (4, "kalo miten")], "doc_id long, text string")
    got = sorted((r.doc_id, r._lang.lang_pred if r.doc_id < 4 else None, r._lang.rejected) for r in langid.classify(rows, model).collect())
    assert got == [(1, "und", True), (2, "und", True), (3, "und", True), (4, None, False), (4, None, True)]


def test_document_frequencies_cover_all_rows(spark):
    rows = corpus(3, 120)
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), sample=5)
    df = sum((langid.counts(t) > 0).astype(int) for _, t, _ in rows)
    assert np.allclose(model.idf, np.log((1 + len(rows)) / (1 + df)) + 1)


def test_steps_do_not_change_counts(monkeypatch):
    text = sentence(random.Random(1), "cc", 300)
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "STEP", 37)
    assert (langid.counts(text) == whole).all()


def test_no_labels_and_empty_table(spark):
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(1, "kalo", None), (None, "miten", None)], schema)
    for d in (docs, spark.createDataFrame([], schema)):
        model = langid.train(d)
        assert {r._lang.lang_pred for r in langid.classify(docs, model).collect()} == {"und"}
    same = spark.createDataFrame([(None, "kalo miten", "aa")] * 3 + [(7, "zhe", "bb")], schema)
    assert {r._lang.lang_pred for r in langid.classify(same, langid.train(same)).collect()} == {"aa", "bb"}
