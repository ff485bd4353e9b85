import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_DIR
from foliospark.llm import minhash
from foliospark.llm.queries import QUERIES


def shingles(text):
    words = (text or "").encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_classes(rows, threshold=0.8):
    """Class of each row (key, text) by comparing all pairs."""
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(k) for k in range(len(rows))]


def partition(labels):
    groups = defaultdict(list)
    for k, label in enumerate(labels):
        groups[label].append(k)
    return sorted(map(tuple, groups.values()))


def near_copies(base, copies, seed):
    """Texts that differ from ``base`` in one word each."""
    rng = random.Random(seed)
    words = base.split()
    found = []
    for k in range(copies):
        changed = list(words)
        changed[rng.randrange(len(words))] = f"changed{seed}x{k}"
        found.append(" ".join(changed))
    return found


def test_signatures_estimate_weighted_similarity():
    rng = np.random.RandomState(0)
    a = rng.randint(1, 5, 400).astype(float)
    b = a.copy()
    b[:80] = rng.randint(0, 5, 80)
    wanted = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    element = minhash.mixed(np.arange(400, dtype=np.uint64), 1)
    text = np.repeat([0, 1], 400)
    weight = np.concatenate([a, b])
    kept = weight > 0
    found = minhash.signatures(
        text[kept], np.tile(element, 2)[kept], weight[kept], 2, coordinates=2048
    )
    assert abs((found[0] == found[1]).mean() - wanted) < 0.04


def test_small_and_large_texts_fill_every_coordinate():
    element = minhash.mixed(np.arange(100_001, dtype=np.uint64), 1)
    text = np.array([0, *[1] * 100_000])
    found = minhash.signatures(text, element, np.ones(len(text)), 2)
    assert (found != 0).all()
    alone = minhash.signatures(np.zeros(1, int), element[:1], np.ones(1), 1)
    assert (alone[0] == found[0]).all()


def test_query_against_all_pairs(spark):
    found = {r.doc_id: r for r in QUERIES["op6_neardup"](spark, SF_DIR).collect()}
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in table.collect())
    assert len(found) == len(rows)
    labels = [found[key].class_id for key, _ in rows]
    assert partition(labels) == partition(brute_classes(rows))
    assert all(found[r.class_id].stays for r in found.values())
    assert sum(r.stays for r in found.values()) == len(set(labels))


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(1)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))
    other = " ".join(f"v{rng.randrange(10**6)}" for _ in range(120))
    texts = near_copies(base, 150, 1) + near_copies(other, 40, 2) + [base] * 30
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = minhash.near_duplicates(frame).collect()
    labels = [r.class_id for r in sorted(found, key=lambda r: r.doc_id)]
    assert partition(labels) == partition(brute_classes(list(enumerate(texts))))


def test_classes_inside_a_shared_large_bucket_are_compared(spark, monkeypatch):
    # One signature for all: every text lands in the same buckets.
    real = minhash.signatures
    monkeypatch.setattr(minhash, "signatures", lambda t, e, w, n: real(t, e, w, n) * np.uint64(0))
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 3)
    rng = random.Random(2)
    texts = []
    for group in range(4):
        base = " ".join(f"g{group}w{rng.randrange(10**6)}" for _ in range(90))
        texts += near_copies(base, 4, group)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = minhash.near_duplicates(frame).collect()
    labels = [r.class_id for r in sorted(found, key=lambda r: r.doc_id)]
    assert partition(labels) == partition(brute_classes(list(enumerate(texts))))


def test_counted_shingles(spark):
    text = "a b c d e f g h i j k l m n o p q r s t " * 2
    frame = spark.createDataFrame([(1, text), (2, text + text)], "doc_id long, text string")
    as_set = minhash.near_duplicates(frame).select("class_id").distinct().count()
    counted = minhash.near_duplicates(frame, weighting="count").select("class_id").distinct().count()
    assert (as_set, counted) == (1, 2)


def test_odd_rows(odd_documents):
    found = minhash.near_duplicates(odd_documents, kept=["doc_id", "text", "row_id"]).collect()
    assert len(found) == odd_documents.count()
    for row in found:
        if not (row.text or "").split():
            assert (row.class_id, row.class_size, row.stays) == (row.doc_id, 1, True)
    copies = [r for r in found if r.doc_id == 0]
    assert [r.class_size for r in copies] == [2, 2]
    assert sum(r.stays for r in copies) == 1
    assert minhash.near_duplicates(odd_documents.filter(F.lit(False))).isEmpty()
