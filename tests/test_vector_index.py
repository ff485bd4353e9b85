"""The inverted file: recall, pruning, bounds, filters and additions."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import search, vector_index
from foliospark.operators.search import SearchRequest


def clustered(seed, rows, groups=40, size=16):
    draw = np.random.RandomState(seed)
    centers = draw.normal(size=(groups, size))
    return centers[draw.randint(0, groups, rows)] + 0.35 * draw.normal(size=(rows, size))


def chunk_rows(spark, vectors):
    rows = [
        (k, k // 5, f"p{k % 3}", k // 2, k % 5, None if v is None else [float(x) for x in v])
        for k, v in enumerate(vectors)
    ]
    return spark.createDataFrame(
        rows,
        "id long, file_id long, project_id string, content_id long, chunk_number int, "
        "embedding array<float>",
    )


def ids(df):
    return [row.chunk_id for row in df.collect()]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    chunks = chunk_rows(spark, clustered(1, 3000)).cache()
    centroids = vector_index.fit_centroids(chunks, 48, rounds=4)
    path = f"{tmp_path_factory.mktemp('index')}/i"
    return chunks, vector_index.create_index(chunks, centroids, path)


def test_recall_and_exact_search(spark, indexed):
    chunks, index = indexed
    found = 0
    for query in clustered(2, 8):
        expected = ids(search.similarity_hits(chunks, None, SearchRequest(query.tolist(), limit=10)))
        near = ids(vector_index.search_index(spark, index, query, 10, probes=6))
        found += len(set(near) & set(expected))
        assert ids(vector_index.search_index(spark, index, query, 10, probes=1, exact=True)) == expected
    assert found >= 0.9 * 8 * 10


def test_rounds_bring_vectors_closer_to_their_centroids(spark, indexed):
    chunks, index = indexed
    first = vector_index.fit_centroids(chunks, 48, rounds=0)

    def closeness(centroids):
        placed = vector_index.nearest_list(F.col("embedding"), centroids)
        return chunks.select(F.avg(placed["cosine"])).first()[0]

    assert closeness(index.centroids) > closeness(first) + 0.02


def test_unprobed_lists_are_never_opened(spark, indexed, tmp_path):
    chunks, index = indexed
    own = vector_index.create_index(chunks, index.centroids, f"{tmp_path}/i")
    query = index.centroids[7]
    expected = ids(vector_index.search_index(spark, own, query, 5, probes=1))
    for part in Path(own.path, "vectors").glob("batch=*/list=*/part-*"):
        if part.parent.name != "list=7":
            part.write_bytes(b"no parquet")
    for crc in Path(own.path, "vectors").glob("batch=*/list=*/.part-*.crc"):
        crc.unlink()
    assert ids(vector_index.search_index(spark, own, query, 5, probes=1)) == expected
    with pytest.raises(Exception):
        vector_index.search_index(spark, own, query, 5, probes=2)
    plan = own.rows(spark).filter(F.col("list").isin([7]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [(list" in plan


def test_bounds_hold_for_every_vector(spark, indexed):
    chunks, index = indexed
    stats = {r["list"]: r["least_cosine"] for r in index.lists(spark).collect()}
    rows = index.rows(spark).select("list", "embedding").collect()
    for query in clustered(3, 5):
        target = query / np.linalg.norm(query)
        lists = sorted(stats)
        bounds = vector_index.score_bounds(
            index.centroids[lists] @ target, np.array([stats[n] for n in lists])
        )
        most = dict(zip(lists, bounds))
        for row in rows:
            vector = np.array(row.embedding)
            assert vector @ target / np.linalg.norm(vector) <= most[row["list"]]


@pytest.mark.parametrize("exact", [False, True])
def test_filters_and_threshold_match_the_exact_search(spark, indexed, exact):
    chunks, index = indexed
    query = clustered(4, 1)[0].tolist()
    for project, files, threshold in [("p1", None, None), (None, (1, 2, 77), None), ("p2", None, 0.6)]:
        request = SearchRequest(query, limit=12, score_threshold=threshold, file_ids=files)
        expected = ids(search.similarity_hits(chunks, project, request))
        found = ids(
            vector_index.search_index(
                spark, index, query, 12, project, files, threshold, probes=48 if not exact else 1, exact=exact
            )
        )
        assert found == expected


def test_odd_vectors_and_additions(spark, tmp_path):
    vectors = [[1.0, 0.0], None, [0.0, 0.0], [0.0, 2.0], [1.0, 0.0], [-1.0, 0.0]]
    chunks = chunk_rows(spark, vectors)
    index = vector_index.create_index(chunks, [[1.0, 0.0], [0.0, 5.0]], f"{tmp_path}/i")
    assert ids(vector_index.search_index(spark, index, [1, 0], 9, probes=1)) == [0, 4, 3, 5, 2]
    assert ids(vector_index.search_index(spark, index, [1, 0], 9, score_threshold=-2.0)) == [0, 4, 3, 5]
    more = chunk_rows(spark, vectors[:1]).withColumn("id", F.lit(9).cast("long"))
    for _ in range(2):
        vector_index.add_to_index(index, more, "more")
    opened = vector_index.open_index(spark, index.path)
    assert ids(vector_index.search_index(spark, opened, [1, 0], 3, probes=1)) == [0, 4, 9]
    empty = vector_index.create_index(chunks.filter("id < 0"), [[1.0, 0.0]], f"{tmp_path}/empty")
    vector_index.add_to_index(empty, chunks.filter("id = 3"), "late")
    assert ids(vector_index.search_index(spark, empty, [1, 0], 3)) == [3]
    for wrong in ([0.0, 0.0], [1.0, 0.0, 0.0]):
        with pytest.raises(ValueError):
            vector_index.search_index(spark, index, wrong, 3)
