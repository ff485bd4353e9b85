import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from foliospark.llm import ann
from foliospark.llm.queries import QUERIES


def brute(ids, vectors, query, k):
    """The k nearest ids of one row by inner product, ties to the smaller id."""
    scores = vectors @ vectors[query]
    others = [n for n in range(len(ids)) if ids[n] != ids[query]]
    others.sort(key=lambda n: (-scores[n], ids[n]))
    return [(ids[n], scores[n]) for n in others[:k]]


def lists(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(found.setdefault(r.query_id, [])) + 1
        found[r.query_id].append((r.vec_id, r.score))
    return found


def recall(spark, frame, ids, vectors, k, every):
    found = lists(ann.search(frame, F.col("id") % every == 0, k).collect())
    hits = 0
    asked = [n for n in range(len(ids)) if ids[n] % every == 0]
    assert sorted(found) == sorted({ids[n] for n in asked})
    for n in asked:
        wanted = brute(ids, vectors, n, k)
        got = found[ids[n]]
        assert len(got) == len(wanted)
        hits += len({i for i, _ in got} & {i for i, _ in wanted})
        assert [s for _, s in got] == sorted((s for _, s in got), reverse=True)
        for i, score in got:
            assert math.isclose(score, vectors[ids.index(i)] @ vectors[n], abs_tol=1e-12)
    return hits / (k * len(asked))


def frame_of(spark, ids, vectors):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_query_against_brute_force(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").orderBy("vec_id").collect()
    ids = [r.vec_id for r in table]
    vectors = np.array([r.embedding for r in table], float)
    found = lists(QUERIES["op5_ann"](spark, SF_DIR).collect())
    hits = 0
    for n in range(0, len(ids), 20):
        wanted = {i for i, _ in brute(ids, vectors, n, 20)}
        hits += len(wanted & {i for i, _ in found[ids[n]]})
    assert hits >= 0.9 * 20 * len(range(0, len(ids), 20))


def test_descent_and_greedy_search_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 60)
    rng = np.random.RandomState(0)
    vectors = rng.standard_normal((900, 16))
    vectors *= rng.uniform(0.5, 1.5, 900)[:, None]  # norms of all sizes
    ids = list(range(900))
    assert recall(spark, frame_of(spark, ids, vectors), ids, vectors, 10, 25) >= 0.9


def test_a_hot_vector_and_ties(spark):
    rng = np.random.RandomState(1)
    vectors = np.round(10 * rng.standard_normal((300, 4)))  # exact in any order of summing
    vectors[50:250] = vectors[50]
    ids = list(range(300))
    found = lists(ann.search(frame_of(spark, ids, vectors), F.col("id") % 10 == 0, 7).collect())
    for n in range(0, 300, 10):
        assert [i for i, _ in found[n]] == [i for i, _ in brute(ids, vectors, n, 7)]


@pytest.mark.parametrize("noise", [1e-2, 1e-3, 1e-4])
def test_near_copies_are_told_apart(spark, noise):
    rng = np.random.RandomState(2)
    vectors = rng.standard_normal((1200, 64))
    vectors[200:900] = vectors[200] + noise * rng.standard_normal((700, 64))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[1000] *= 1e7  # takes the scale of the others from none of them
    ids = list(range(1200))
    assert recall(spark, frame_of(spark, ids, vectors), ids, vectors, 20, 30) >= 0.9


def test_outliers_on_the_far_side_of_a_cone(spark):
    rng = np.random.RandomState(3)
    vectors = 3 + rng.standard_normal((1500, 32))
    vectors[30] = -3  # alone in its cell
    vectors[60] = vectors[90] = -3 + rng.standard_normal(32)
    vectors[90, 0] += 0.1
    ids = list(range(1500))
    frame = frame_of(spark, ids, vectors)
    found = lists(ann.search(frame, F.col("id") % 30 == 0, 20).collect())
    hits = {}
    for n in range(0, 1500, 30):
        assert len(found[n]) == 20
        hits[n] = len({i for i, _ in found[n]} & {i for i, _ in brute(ids, vectors, n, 20)})
    assert sum(hits.values()) >= 0.9 * 20 * len(hits)
    assert {30, 60} <= {i for i, _ in found[90]} and {60, 90} <= {i for i, _ in found[30]}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], "x", 1),
        (20, [0.5, 0.5], None, None),
        (1, [0.0, 2.0], "x", 1),
        (1, [0.0, 2.0], "x", 1),
        (2, None, None, None),
        (3, [0.0, 0.0], "x", 1),
        (4, [nan, 1.0], "x", 1),
        (5, [inf, 1.0], "x", 1),
        (6, [None, 1.0], "x", 1),
        (7, [], "x", 1),
        (8, [1.0, 2.0, 3.0], "x", 1),
        (None, [1.0, 1.0], "x", 1),
        (40, None, "x", 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int")
    found = lists(ann.search(frame, F.col("id") % 20 == 0, 20).collect())
    assert found == {
        0: [(20, 0.5), (1, 0.0), (1, 0.0)],
        20: [(1, 1.0), (1, 1.0), (0, 0.5)],
    }
    empty = ann.search(frame.filter(F.lit(False)), F.col("id") % 20 == 0, 20)
    assert empty.isEmpty() and empty.columns == ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("count", [1, 2, 3])
def test_hardly_any_rows(spark, count):
    frame = frame_of(spark, range(count), np.eye(3)[:count])
    found = lists(ann.search(frame, F.lit(True), 5).collect())
    assert {q: len(v) for q, v in found.items()} == (
        {} if count == 1 else {n: count - 1 for n in range(count)}
    )
