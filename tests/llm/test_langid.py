import numpy as np
from pyspark.sql import functions as F

from conftest import SF_DIR
from foliospark.llm import langid
from foliospark.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    found = QUERIES["op3_langid"](spark, SF_DIR)
    truth = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    joined = found.join(truth, "doc_id")
    held = joined.filter("held_out AND lang IS NOT NULL")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count() > 0
    assert joined.filter("score < 0 OR score > 1").isEmpty()


def brute_ngrams(text):
    """n-grams of 1 to 3 characters inside words, with boundaries."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    found = []
    for word in words:
        for size in (1, 2, 3):
            padded = word if size == 1 else f" {word} "
            found += [padded[k : k + size] for k in range(len(padded) - size + 1)]
    return [g for g in found if g.strip()]


def test_ngrams_against_a_plain_list():
    texts = ["Ab, cd-e", "", "x", "12 !", "éa ß"]
    codes, bounds, lettered = langid.characters(texts, langid.character_kinds())
    counts = np.zeros(len(texts), int)
    for bucket, text in langid.hashed_ngrams(codes, bounds):
        counts += np.bincount(text, minlength=len(texts))[: len(texts)]
    assert counts.tolist() == [len(brute_ngrams(t)) for t in texts]
    assert lettered.tolist() == [True, False, True, False, True]


def test_slices_give_the_same_ngrams(monkeypatch):
    codes, bounds, _ = langid.characters(["some words " * 30] * 3, langid.character_kinds())
    whole = sorted(zip(*map(np.concatenate, zip(*langid.hashed_ngrams(codes, bounds)))))
    monkeypatch.setattr(langid, "SLICE", 17)
    assert sorted(zip(*map(np.concatenate, zip(*langid.hashed_ngrams(codes, bounds))))) == whole


def test_odd_rows(odd_documents):
    model = langid.fit(odd_documents, "text", "lang")
    assert model.languages == ["de", "en", "fr"]
    found = langid.predict(odd_documents, model)
    assert sorted(found.columns) == sorted({*odd_documents.columns, "lang_pred", "score"})
    for row in found.collect():
        if not row.text or not any(c.isalpha() for c in row.text):
            assert (row.lang_pred, row.score) == ("und", 0.0)
        else:
            assert row.lang_pred in model.languages


def test_nothing_learned_and_nothing_asked(odd_documents):
    empty = odd_documents.filter(F.lit(False))
    model = langid.fit(empty, "text", "lang")
    assert {r.lang_pred for r in langid.predict(odd_documents, model).collect()} == {"und"}
    assert langid.predict(empty, model).isEmpty()
