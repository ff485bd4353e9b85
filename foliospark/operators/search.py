"""Similarity search with neighbouring context, at chunk or page level."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.vectors import cosine_to
from foliospark.operators.scale import join_by_key, range_frame

# --- fixed values: retrieval defaults ---------------------------------------
DEFAULT_THRESHOLD = 0.3
DEFAULT_LIMIT = 10
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class SearchRequest:
    """What to search for and how to return it.

    ``file_ids`` None searches all files of the project. ``limit`` counts
    matching chunks, also when whole pages are returned.
    """

    query_embedding: Sequence[float]
    limit: int | None = None
    score_threshold: float | None = None
    when_match_return: str = "chunk"
    before_neighbor_count: int = 0
    after_neighbor_count: int = 0
    order_by: str = "score"
    file_ids: tuple | None = None

    def __post_init__(self) -> None:
        if self.when_match_return not in ("chunk", "content"):
            raise ValueError("when_match_return is chunk or content")
        if self.order_by not in ("score", "chunk"):
            raise ValueError("order_by is score or chunk")
        if self.before_neighbor_count < 0 or self.after_neighbor_count < 0:
            raise ValueError("neighbour counts are not negative")


def retrieval_request(
    query_embedding: Sequence[float],
    score_threshold: float | None = None,
    limit: int | None = None,
    file_ids: tuple | None = None,
) -> SearchRequest:
    """The assistant's policy. A threshold above the default brings one
    neighbouring page on each side and score order, else plain page order."""
    threshold = DEFAULT_THRESHOLD if score_threshold is None else score_threshold
    strict = threshold > DEFAULT_THRESHOLD
    return SearchRequest(
        query_embedding=query_embedding,
        limit=DEFAULT_LIMIT if limit is None else limit,
        score_threshold=threshold,
        when_match_return="content",
        before_neighbor_count=int(strict),
        after_neighbor_count=int(strict),
        order_by="score" if strict else "chunk",
        file_ids=file_ids,
    )


def scored_chunks(
    chunks: DataFrame, project_id: object | None, request: SearchRequest
) -> DataFrame:
    """Score the chunks in scope; project and file filters are
    pushed to the scan, before any vector is read into a score."""
    scope = chunks.filter(F.col("embedding").isNotNull())
    if project_id is not None:
        scope = scope.filter(F.col("project_id") == F.lit(project_id))
    if request.file_ids is not None:
        scope = scope.filter(F.col("file_id").isin(list(request.file_ids)))
    scored = scope.select(
        F.col("id").alias("chunk_id"),
        "file_id",
        "content_id",
        "chunk_number",
        cosine_to(F.col("embedding"), request.query_embedding).alias("score"),
    )
    if request.score_threshold is not None:
        scored = scored.filter(F.col("score") > request.score_threshold)
    return scored


def ranking(order_by: str) -> list[Column]:
    """O1: a total order of hits."""
    best = F.col("score").desc_nulls_last()
    if order_by == "score":
        return [best, F.col("chunk_id").asc()]
    return [F.col("chunk_number").asc(), best, F.col("chunk_id").asc()]


def similarity_hits(
    chunks: DataFrame, project_id: object | None, request: SearchRequest
) -> DataFrame:
    """K5, O2: matching chunks in order; with a limit each task keeps its top k
    and only those are merged, nothing is shuffled."""
    hits = scored_chunks(chunks, project_id, request).orderBy(*ranking(request.order_by))
    return hits if request.limit is None else hits.limit(request.limit)


def with_neighbors(
    hits: DataFrame, rows: DataFrame, before: int, after: int
) -> DataFrame:
    """Hits together with the rows around them.

    ``hits`` has (hit_id, file_id, hit_number, score), ``rows`` has (row_id,
    file_id, row_number). Each hit is unfolded into the numbers it wants, which
    makes the value range an equi-join on (file, number): no nested loop, and
    a hot file is spread over its numbers.
    """
    number = F.col("hit_number").cast("long")
    wanted = hits.withColumn(
        "row_number", F.explode(F.sequence(number - before, number + after))
    )
    candidates = rows.withColumn("row_number", F.col("row_number").cast("long"))
    joined = join_by_key(
        candidates, wanted, ["file_id", "row_number"], unfolded=before + after + 1
    )
    is_neighbor = F.col("row_id") != F.col("hit_id")
    if before == 0 and after == 0:
        joined = joined.filter(~is_neighbor)
    return joined.select(
        "row_id",
        "file_id",
        "row_number",
        F.when(is_neighbor, F.lit(0.0)).otherwise(F.col("score")).alias("score"),
        is_neighbor.alias("is_neighbor"),
        F.when(is_neighbor, F.col("hit_id")).alias("neighbor_from"),
        F.col("hit_number"),
        F.col("score").alias("hit_score"),
        *[c for c in wanted.columns if c not in _HIT_COLUMNS],
    )


_HIT_COLUMNS = ("hit_id", "file_id", "hit_number", "row_number", "score")


def similarity_chunks(
    chunks: DataFrame, project_id: object | None, request: SearchRequest
) -> DataFrame:
    """K5, chunk mode: hits and the chunks around them, one row each.

    A chunk that is a hit and also lies next to another hit appears in both
    roles. Neighbours may be chunks without a vector.
    """
    hits = similarity_hits(chunks, project_id, request).select(
        F.col("chunk_id").alias("hit_id"),
        "file_id",
        F.col("chunk_number").alias("hit_number"),
        "score",
    )
    rows = chunks.select(
        F.col("id").alias("row_id"), "file_id", F.col("chunk_number").alias("row_number")
    )
    found = with_neighbors(
        hits, rows, request.before_neighbor_count, request.after_neighbor_count
    )
    order = (
        [F.col("row_number").asc()]
        if request.order_by == "chunk"
        else [F.col("score").desc_nulls_last()]
    )
    return found.withColumnRenamed("row_id", "chunk_id").withColumnRenamed(
        "row_number", "chunk_number"
    ).orderBy(*order, "chunk_id", "neighbor_from")


def similarity_pages(
    chunks: DataFrame, pages: DataFrame, project_id: object | None, request: SearchRequest
) -> DataFrame:
    """J8, J10, page mode: the page of each matching chunk and the pages around
    it, one row per page and matching chunk."""
    hits = similarity_hits(chunks, project_id, request)
    owners = pages.select(
        F.col("id").alias("hit_id"), "file_id", F.col("content_number").alias("hit_number")
    )
    # the page's own file decides what lies around it
    located = join_by_key(
        owners,
        hits.withColumnRenamed("content_id", "hit_id").drop("file_id", "chunk_number"),
        ["hit_id"],
    )
    rows = pages.select(
        F.col("id").alias("row_id"), "file_id", F.col("content_number").alias("row_number")
    )
    found = with_neighbors(
        located, rows, request.before_neighbor_count, request.after_neighbor_count
    )
    order = (
        [F.col("row_number").asc()]
        if request.order_by == "chunk"
        else [F.col("score").desc_nulls_last()]
    )
    return found.withColumnRenamed("row_id", "content_id").withColumnRenamed(
        "row_number", "content_number"
    ).orderBy(*order, "content_id", "neighbor_from", "chunk_id")


def similarity_search(
    chunks: DataFrame, pages: DataFrame, project_id: object | None, request: SearchRequest
) -> DataFrame:
    """K5: rows in the mode the request asks for."""
    if request.when_match_return == "chunk":
        return similarity_chunks(chunks, project_id, request)
    return similarity_pages(chunks, pages, project_id, request)


def nest_chunk_neighbors(rows: DataFrame) -> DataFrame:
    """One row per hit with its chunks before and after it.

    Arrays hold at most the neighbours asked for, plus peers of equal number.
    """
    hit = F.coalesce("neighbor_from", "chunk_id").alias("hit_id")
    item = F.struct("chunk_number", "chunk_id")
    number, at = F.col("chunk_number"), F.col("hit_number")
    neighbor = F.col("is_neighbor")
    return rows.groupBy(hit).agg(
        F.max("hit_number").alias("chunk_number"),
        F.max("hit_score").alias("score"),
        F.sort_array(F.collect_list(F.when(neighbor & (number < at), item))).alias(
            "before_neighbors"
        ),
        F.sort_array(F.collect_list(F.when(neighbor & (number > at), item))).alias(
            "after_neighbors"
        ),
    )


def nest_page_matches(rows: DataFrame) -> DataFrame:
    """One row per matching page with its chunks, best first, and the
    pages around it. Pages come in the order of their best chunk."""
    page = F.coalesce("neighbor_from", "content_id").alias("hit_id")
    number, at = F.col("content_number"), F.col("hit_number")
    neighbor = F.col("is_neighbor")
    around = F.struct("content_number", "content_id")
    match = F.struct(F.negative("hit_score").alias("_rank"), "chunk_id", "hit_score")
    nested = rows.groupBy(page).agg(
        F.max("hit_number").alias("content_number"),
        F.max("hit_score").alias("score"),
        F.sort_array(F.collect_set(F.when(~neighbor, match))).alias("_matches"),
        F.sort_array(F.collect_set(F.when(neighbor & (number < at), around))).alias(
            "before_neighbors"
        ),
        F.sort_array(F.collect_set(F.when(neighbor & (number > at), around))).alias(
            "after_neighbors"
        ),
    )
    return (
        nested.withColumn(
            "match_chunks",
            F.transform(
                "_matches",
                lambda m: F.struct(m.chunk_id.alias("chunk_id"), m.hit_score.alias("score")),
            ),
        )
        .drop("_matches")
        .orderBy(F.col("score").desc(), "hit_id")
    )


def page_matches(rows: DataFrame) -> DataFrame:
    """A13, flat: best score and number of matching chunks of each page."""
    return (
        rows.filter(~F.col("is_neighbor"))
        .groupBy("content_id", "content_number")
        .agg(
            F.max("score").alias("score"),
            F.count_distinct("chunk_id").alias("n_chunks"),
        )
    )


def neighbor_window(
    rows: DataFrame,
    before: int,
    after: int,
    number: str = "chunk_number",
    bucket_width: int = 4096,
) -> DataFrame:
    """Ids around every row of a file, by value range of its number."""
    return range_frame(
        rows, ["file_id"], number, before, after, "id", "neighbor_ids", bucket_width
    )
