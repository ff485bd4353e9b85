import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_DIR
from foliospark.llm import rules
from foliospark.llm.queries import QUERIES


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    marked = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            marked |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, dup, len(marked)


@settings(max_examples=300, deadline=None)
@given(st.text("ab é\n\t\x0b \xa0#|", max_size=80))
def test_measures_of_any_text(text):
    assert rules.measure(text.encode())[:5] == brute(text)


def test_query_against_brute_force(spark):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    rows = QUERIES["op10_rules"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        wanted = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == wanted
        assert r.base_failed == (wanted[0] < 50 or 100 * wanted[4] > 50 * wanted[0])
        assert not (r.base_failed and r.kept)


def test_list_agrees_with_held_out_labels(spark):
    larger = SF_DIR.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    documents = spark.read.parquet(f"{larger}/documents.parquet")
    learned = labels.filter("doc_id % 2 = 0")
    judged = rules.judge(documents, learned).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    judged = judged.filter("NOT base_failed")
    assert judged.filter("kept = (quality = 1)").count() >= 0.95 * judged.count() > 50


def test_learning_finds_a_conjunction():
    rng = np.random.RandomState(0)
    rows = rng.rand(3000, 3)
    bad = (rows[:, 0] > 0.6) & (rows[:, 2] <= 0.3)
    found = rules.learn(rows, bad, ["a", "b", "c"])
    hit = np.zeros(len(rows), bool)
    for rule in found:
        hit |= rules.covered(rows, ["a", "b", "c"], rule)
    assert (hit == bad).mean() > 0.98
    assert (hit & ~bad).sum() <= 0.05 * hit.sum()


def test_noise_teaches_no_rule():
    rng = np.random.RandomState(1)
    assert rules.learn(rng.rand(500, 2), rng.rand(500) < 0.2, ["a", "b"]) == []


def test_odd_rows(spark, odd_documents):
    labels = spark.createDataFrame(
        [(0, 1), (0, None), (None, 0), (99, 0), (5, 0)], "doc_id long, quality int"
    )
    judged = rules.judge_rows(odd_documents, labels, "doc_id", "text", odd_documents.columns)
    rows = judged.collect()
    assert len(rows) == odd_documents.count()
    assert {r.row.kept for r in rows} == {None}
    assert all(r.base_failed and not r.kept for r in rows if not r.row.text)
    empty = odd_documents.filter(F.lit(False))
    assert rules.judge(empty, labels).isEmpty()
    nothing = labels.filter(F.lit(False))
    assert rules.judge(odd_documents, nothing).filter("NOT base_failed AND NOT kept").isEmpty()
