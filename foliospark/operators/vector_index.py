"""K7: an inverted file over centroids, written once and searched by pruned reads.

Every vector belongs to the list of its nearest centroid. The vectors are written in
folders by list, so that a search opens only the lists it probes. Each list keeps the
angle of its farthest vector from the centroid; by the triangle inequality no vector of
a list can score above the cosine of what is left of the query's angle. So lists that
cannot reach a threshold, or the score of the k-th hit, are never opened, and an exact
search ends as soon as no list left can change its result.

Centroids are fitted on a sample of at most ``SAMPLE_ROWS`` vectors, those with the
least hash of their id; every vector is indexed. The centroids, ``MAX_LISTS`` at most,
are a constant of the plan.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.vectors import cosine_to, unit
from foliospark.operators.search import ranking
from foliospark.session import materialise

SAMPLE_ROWS = 65_536
MAX_LISTS = 4_096
ROUNDS = 8
ZERO_LIST = -1  # vectors of length zero, whose score is NULL
ROUNDED = 9  # decimals of a cosine that decide which centroid is nearest
SLACK = 1e-6  # what rounding may add to a score bound

HIT_COLUMNS = ("chunk_id", "file_id", "project_id", "content_id", "chunk_number")


@dataclass(frozen=True)
class VectorIndex:
    """An index on disk, its centroids, unit vectors numbered by their row, and its schema."""

    path: str
    centroids: np.ndarray
    schema: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/vectors")

    def lists(self, spark: SparkSession) -> DataFrame:
        """Vectors and least cosine to the centroid of each list."""
        stats = spark.read.parquet(f"{self.path}/lists")
        return stats.groupBy("list").agg(
            F.sum("n_rows").alias("n_rows"), F.min("least_cosine").alias("least_cosine")
        )


def nearest_list(embedding: Column, centroids: np.ndarray) -> Column:
    """The number of the nearest centroid, of equal ones the first, and the cosine to it."""
    matrix = np.ascontiguousarray(centroids.T, dtype=np.float64)

    @F.arrow_udf("struct<list:int,cosine:double>")
    def place(vectors: pa.Array) -> pa.Array:
        present = vectors.is_valid().to_numpy(zero_copy_only=False)
        flat = vectors.drop_null().flatten().to_numpy(zero_copy_only=False)
        rows = int(present.sum())
        if flat.size != rows * matrix.shape[0]:
            raise ValueError(f"expected vectors of {matrix.shape[0]} dimensions")
        lists = np.full(len(vectors), ZERO_LIST, np.int32)
        cosines = np.full(len(vectors), np.nan)
        if rows:
            given = flat.reshape(rows, -1).astype(np.float64)
            lengths = np.sqrt(np.einsum("ij,ij->i", given, given))
            whole = lengths > 0
            scores = (given @ matrix) / np.where(whole, lengths, 1.0)[:, None]
            chosen = np.argmax(np.round(scores, ROUNDED), axis=1)
            lists[present] = np.where(whole, chosen, ZERO_LIST)
            cosines[present] = np.where(whole, scores[np.arange(rows), chosen], np.nan)
        return pa.StructArray.from_arrays(
            [pa.array(lists), pa.array(cosines, from_pandas=True)], ["list", "cosine"]
        )

    return place(embedding)


def unit_rows(vectors: Sequence[Sequence[float]]) -> np.ndarray:
    """Vectors as the rows of a matrix, scaled to length one."""
    matrix = np.asarray(vectors, dtype=np.float64)
    if matrix.ndim != 2 or not len(matrix):
        raise ValueError("an index needs one centroid at least, all of one dimension")
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    if not lengths.all():
        raise ValueError("a centroid has length zero")
    return matrix / lengths


def fit_centroids(chunks: DataFrame, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of ``chunks`` by Lloyd rounds on the sphere.

    Each round is one aggregate: the sample's vectors are summed by their nearest
    centroid, combined in every task first. A centroid without vectors stays.
    """
    if not 1 <= lists <= MAX_LISTS:
        raise ValueError(f"an index has 1 to {MAX_LISTS} lists")
    vectors = chunks.filter(F.col("embedding").isNotNull()).select("id", "embedding")
    vectors = vectors.filter(F.exists("embedding", lambda x: x != 0))
    order = [F.xxhash64("id"), F.col("id")]
    sample = materialise(vectors.orderBy(*order).limit(SAMPLE_ROWS), "index-sample")
    seeds = sample.orderBy(*order).limit(lists).select("embedding").collect()
    centroids = unit_rows([row.embedding for row in seeds])
    for _ in range(rounds):
        placed = sample.select(
            nearest_list(F.col("embedding"), centroids)["list"].alias("list"),
            array_to_vector(unit(F.col("embedding"))).alias("vector"),
        )
        means = placed.groupBy("list").agg(Summarizer.mean(F.col("vector")).alias("mean"))
        for row in means.select("list", vector_to_array("mean").alias("mean")).collect():
            mean = np.asarray(row["mean"])
            if np.any(mean):
                centroids[row["list"]] = mean / np.linalg.norm(mean)
    return centroids


def create_index(chunks: DataFrame, centroids: np.ndarray, path: str) -> VectorIndex:
    """Write the centroids and index all vectors of ``chunks``."""
    centroids = unit_rows(centroids)
    schema = ", ".join(
        f"`{field.name}` {field.dataType.simpleString()}"
        for field in placed_rows(chunks, centroids, "").schema
    )
    spark = chunks.sparkSession
    rows = [(k, row.tolist(), schema) for k, row in enumerate(centroids)]
    spark.createDataFrame(rows, "list int, centroid array<double>, schema string").coalesce(
        1
    ).write.mode("errorifexists").parquet(f"{path}/centroids")
    index = VectorIndex(path, centroids, schema)
    add_to_index(index, chunks)
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    return VectorIndex(path, unit_rows([row.centroid for row in rows]), rows[0].schema)


def placed_rows(chunks: DataFrame, centroids: np.ndarray, batch: str) -> DataFrame:
    """What the index keeps of each chunk that has a vector."""
    return (
        chunks.filter(F.col("embedding").isNotNull())
        .withColumn("_place", nearest_list(F.col("embedding"), centroids))
        .select(
            F.col("id").alias("chunk_id"),
            *HIT_COLUMNS[1:],
            "embedding",
            F.col("_place.cosine").alias("cosine"),
            F.col("_place.list").alias("list"),
            F.lit(batch).alias("batch"),
        )
    )


def add_to_index(index: VectorIndex, chunks: DataFrame, batch: str | None = None) -> None:
    """Index more chunks; chunks without vector are left out.

    ``batch`` names the addition: adding it again under the same name replaces what
    an interrupted run has left. Rebalancing splits the folder of a list that many
    vectors share.
    """
    batch = batch or uuid.uuid4().hex
    placed = placed_rows(chunks, index.centroids, batch)
    placed.hint("rebalance", "list").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch", "list").parquet(f"{index.path}/vectors")
    stats = (
        index.rows(chunks.sparkSession)
        .filter(F.col("batch") == batch)
        .groupBy("batch", "list")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("cosine").alias("least_cosine"))
    )
    stats.coalesce(1).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch").parquet(f"{index.path}/lists")


def score_bounds(to_centroid: np.ndarray, least_cosine: np.ndarray) -> np.ndarray:
    """The most that a vector of each list can score.

    ``to_centroid`` is the query's cosine to each centroid.
    """
    angle = np.arccos(np.clip(to_centroid, -1, 1))
    radius = np.arccos(np.clip(least_cosine, -1, 1))
    return np.cos(np.clip(angle - radius, 0, np.pi)) + SLACK


def search_index(
    spark: SparkSession,
    index: VectorIndex,
    query: Sequence[float],
    k: int,
    project_id: object | None = None,
    file_ids: Sequence | None = None,
    score_threshold: float | None = None,
    probes: int = 8,
    exact: bool = False,
) -> DataFrame:
    """The ``k`` best chunks in scope, best first, ties by id.

    The ``probes`` lists nearest to the query are read; while fewer than ``k`` chunks
    are in scope, as many lists again as have been read, and so on. ``exact`` goes
    on until no list left can hold a better chunk. Project and file filters reach the
    scan. Without a threshold, vectors of length zero come last, with a NULL score.
    """
    if k < 1 or probes < 1:
        raise ValueError("k and probes are at least 1")
    target = unit_rows([query])[0]
    if len(target) != index.centroids.shape[1]:
        raise ValueError(f"expected a vector of {index.centroids.shape[1]} dimensions")
    stats = {row["list"]: row for row in index.lists(spark).collect()}
    filled = [n for n in sorted(stats) if n != ZERO_LIST]
    closeness = index.centroids[filled] @ target
    bounds = score_bounds(closeness, np.array([stats[n]["least_cosine"] for n in filled]))
    order = np.lexsort((filled, -np.round(closeness, ROUNDED)))
    left = [(int(filled[at]), float(bounds[at])) for at in order]
    if score_threshold is not None:
        left = [(n, bound) for n, bound in left if bound > score_threshold]

    def read(numbers: list[int]) -> DataFrame:
        rows = index.rows(spark).filter(F.col("list").isin(numbers))
        if project_id is not None:
            rows = rows.filter(F.col("project_id") == F.lit(project_id))
        if file_ids is not None:
            rows = rows.filter(F.col("file_id").isin(list(file_ids)))
        scored = rows.select(
            *HIT_COLUMNS, cosine_to(F.col("embedding"), target).alias("score")
        )
        if score_threshold is not None:
            scored = scored.filter(F.col("score") > score_threshold)
        return scored

    best, taken = read([]), 0
    while left:
        many = probes if taken == 0 else taken
        now, left = left[:many], left[many:]
        found = read([n for n, _ in now])
        found = best.unionByName(found) if taken else found
        best = materialise(found.orderBy(*ranking("score")).limit(k), "index-hits")
        taken += len(now)
        last = best.agg(F.count(F.lit(1)), F.min("score")).first()
        if last[0] < k:
            continue
        if not exact:
            break
        # With k hits, only lists that can beat the last one matter, all of them.
        left = [(n, bound) for n, bound in left if bound > last[1]]
        taken = max(taken, len(left))
    if score_threshold is None and ZERO_LIST in stats and best.count() < k:
        best = best.unionByName(read([ZERO_LIST]))
    return best.orderBy(*ranking("score")).limit(k)
