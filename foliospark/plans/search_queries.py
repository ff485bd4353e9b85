"""Boolean search and similarity search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.vectors import cosine_to
from foliospark.operators import search, vector_index
from foliospark.operators.embedding import build_lsh_index, similarity_lsh
from foliospark.operators.filters import (
    Condition,
    Group,
    files_matching,
    nest_answers,
    search_files,
)
from foliospark.operators.search import SearchRequest
from foliospark.plans.driver_tables import DriverTables
from foliospark.plans.registry import query
from foliospark.session import scratch_path

PROJECT = "src1"
# Questions of project src1: 11 quality, 12 toxic, 13 language.
QUALITY, TOXIC, LANGUAGE = 11, 12, 13


def _exists(evaluation: int, test: str = "") -> str:
    return (
        "EXISTS (SELECT 1 FROM p_answers a WHERE a.file_id = f.id "
        f"AND a.evaluation_id = {evaluation} {test})"
    )


def _files_sql(condition: str) -> str:
    return f"SELECT f.id, f.name, f.project_id FROM p_files f WHERE {condition}"


def _files(t: DriverTables, tree: Group, neq_mode: str = "intended") -> DataFrame:
    return files_matching(t.files, t.answers, tree, neq_mode).select(
        "id", "name", "project_id"
    )


@query("search_eq", _files_sql(_exists(LANGUAGE, "AND a.response = 'en'")))
def search_eq(t: DriverTables) -> DataFrame:
    return _files(t, Group("and", (Condition(LANGUAGE, "en"),)))


@query(
    "search_neq",
    _files_sql(
        _exists(LANGUAGE, "AND a.response <> 'en'") + " OR NOT " + _exists(QUALITY)
    ),
)
def search_neq(t: DriverTables) -> DataFrame:
    tree = Group(
        "or", (Condition(LANGUAGE, "en", "neq"), Condition(QUALITY, None, "neq"))
    )
    return _files(t, tree)


@query("search_neq_as_eq", _files_sql(_exists(LANGUAGE, "AND a.response = 'en'")))
def search_neq_as_eq(t: DriverTables) -> DataFrame:
    tree = Group("and", (Condition(LANGUAGE, "en", "neq"),))
    return _files(t, tree, neq_mode="reference")


@query(
    "search_group_and",
    _files_sql(_exists(QUALITY, "AND a.response = 'true'") + " AND " + _exists(LANGUAGE)),
)
def search_group_and(t: DriverTables) -> DataFrame:
    return _files(t, Group("and", (Condition(QUALITY, "true"), Condition(LANGUAGE, ""))))


@query(
    "search_group_or",
    _files_sql(
        _exists(QUALITY, "AND a.response = 'false'")
        + " OR "
        + _exists(LANGUAGE, "AND a.response = 'fr'")
    ),
)
def search_group_or(t: DriverTables) -> DataFrame:
    return _files(t, Group("or", (Condition(QUALITY, "false"), Condition(LANGUAGE, "fr"))))


NESTED = Group(
    "or",
    (
        Condition(LANGUAGE, "de"),
        Group(
            "and",
            (
                Condition(QUALITY, "true"),
                Condition(TOXIC, "true", "neq"),
                Group("or", ()),
            ),
        ),
    ),
)
NESTED_SQL = (
    "("
    + _exists(LANGUAGE, "AND a.response = 'de'")
    + " OR ("
    + _exists(QUALITY, "AND a.response = 'true'")
    + " AND "
    + _exists(TOXIC, "AND a.response <> 'true'")
    + "))"
)


@query("search_group_nested", _files_sql(NESTED_SQL))
def search_group_nested(t: DriverTables) -> DataFrame:
    return _files(t, NESTED)


SEARCH_SQL = f"""SELECT f.id AS file_id, f.name AS file_name, a.id AS answer_id,
         e.title, a.response, p.content_number
       FROM p_files f JOIN p_answers a ON a.file_id = f.id
       JOIN p_evaluations e ON e.id = a.evaluation_id
       JOIN p_pages p ON p.id = a.content_id
       WHERE f.project_id = '{PROJECT}' AND f.name ILIKE '%doc%' AND {NESTED_SQL}"""


def _search(t: DriverTables) -> DataFrame:
    return search_files(
        t.files, t.answers, t.evaluations, t.pages, PROJECT, "doc", NESTED
    )


@query("search_files", SEARCH_SQL)
def search_project_files(t: DriverTables) -> DataFrame:
    return _search(t).select(
        "file_id", "file_name", "answer_id", "title", "response", "content_number"
    )


@query(
    "search_all_files",
    """SELECT f.id AS file_id, f.name AS file_name, a.id AS answer_id, e.title, a.response
       FROM p_files f JOIN p_answers a ON a.file_id = f.id
       JOIN p_evaluations e ON e.id = a.evaluation_id
       JOIN p_pages p ON p.id = a.content_id""",
)
def search_all_files(t: DriverTables) -> DataFrame:
    """Every answer of every file: no project, text or predicate."""
    return search_files(t.files, t.answers, t.evaluations, t.pages).select(
        "file_id", "file_name", "answer_id", "title", "response"
    )


@query(
    "search_files_nested",
    f"""SELECT file_id, file_name, (content_number - 1) // 2 AS part, count(*) AS n_answers,
          string_agg(title || '=' || response, ';'
                     ORDER BY content_number, answer_id) AS evaluations
        FROM ({SEARCH_SQL}) GROUP BY ALL""",
)
def search_files_nested(t: DriverTables) -> DataFrame:
    listed = F.transform(
        "evaluations", lambda a: F.concat(a.title, F.lit("="), a.response)
    )
    """Nested in parts of two pages, so that files have several of them."""
    return nest_answers(_search(t), pages_per_part=2).select(
        "file_id",
        "file_name",
        "part",
        F.size("evaluations").alias("n_answers"),
        F.array_join(listed, ";").alias("evaluations"),
    )


# --- similarity -----------------------------------------------------------------

SIMILAR_PROJECT = "src2"
ROUNDED = "round(score, 6) AS score"


@query(
    "cosine_scores",
    f"SELECT chunk_id, file_id, {ROUNDED} FROM p_scored",
)
def cosine_scores(t: DriverTables) -> DataFrame:
    chunks = t.chunks.filter(F.col("embedding").isNotNull())
    return chunks.select(
        F.col("id").alias("chunk_id"),
        "file_id",
        F.round(cosine_to(F.col("embedding"), t.query_vector()), 6).alias("score"),
    )


@query(
    "similarity_topk",
    f"""SELECT chunk_id, file_id, chunk_number, {ROUNDED} FROM p_scored
        ORDER BY p_scored.score DESC, chunk_id LIMIT 10""",
)
def similarity_topk(t: DriverTables) -> DataFrame:
    request = SearchRequest(t.query_vector(), limit=10)
    return _hits(t, None, request)


@query(
    "similarity_threshold",
    f"""SELECT chunk_id, file_id, chunk_number, {ROUNDED} FROM p_scored
        WHERE project_id = '{SIMILAR_PROJECT}' AND p_scored.score > 0.05""",
)
def similarity_threshold(t: DriverTables) -> DataFrame:
    request = SearchRequest(t.query_vector(), score_threshold=0.05)
    return _hits(t, SIMILAR_PROJECT, request)


def _hits(t: DriverTables, project: str | None, request: SearchRequest) -> DataFrame:
    return search.similarity_hits(t.chunks, project, request).select(
        "chunk_id", "file_id", "chunk_number", F.round("score", 6).alias("score")
    )


HITS_SQL = """(SELECT * FROM p_scored WHERE score > 0.1
               ORDER BY score DESC, chunk_id LIMIT 8)"""

CHUNK_NEIGHBORS_SQL = f"""SELECT c.id AS chunk_id, c.chunk_number,
         round(CASE WHEN c.id <> h.chunk_id THEN 0.0 ELSE h.score END, 6) AS score,
         c.id <> h.chunk_id AS is_neighbor,
         CASE WHEN c.id <> h.chunk_id THEN h.chunk_id END AS neighbor_from
       FROM {HITS_SQL} h JOIN p_chunks c ON c.file_id = h.file_id
        AND c.chunk_number BETWEEN h.chunk_number - 2 AND h.chunk_number + 1"""


def _neighbors(t: DriverTables) -> DataFrame:
    request = SearchRequest(
        t.query_vector(),
        limit=8,
        score_threshold=0.1,
        before_neighbor_count=2,
        after_neighbor_count=1,
    )
    return search.similarity_chunks(t.chunks, None, request)


@query("similarity_neighbors", CHUNK_NEIGHBORS_SQL)
def similarity_neighbors(t: DriverTables) -> DataFrame:
    return _neighbors(t).select(
        "chunk_id",
        "chunk_number",
        F.round("score", 6).alias("score"),
        "is_neighbor",
        "neighbor_from",
    )


@query(
    "similarity_neighbors_nested",
    f"""SELECT h.chunk_id AS hit_id, h.chunk_number,
          coalesce(string_agg(CAST(c.id AS VARCHAR), ',' ORDER BY c.chunk_number, c.id)
                   FILTER (c.chunk_number < h.chunk_number), '') AS before_ids,
          coalesce(string_agg(CAST(c.id AS VARCHAR), ',' ORDER BY c.chunk_number, c.id)
                   FILTER (c.chunk_number > h.chunk_number), '') AS after_ids
        FROM {HITS_SQL} h JOIN p_chunks c ON c.file_id = h.file_id
         AND c.chunk_number BETWEEN h.chunk_number - 2 AND h.chunk_number + 1
        GROUP BY ALL""",
)
def similarity_neighbors_nested(t: DriverTables) -> DataFrame:
    def ids(column: str):
        return F.array_join(F.transform(column, lambda n: n.chunk_id.cast("string")), ",")

    return search.nest_chunk_neighbors(_neighbors(t)).select(
        "hit_id",
        "chunk_number",
        ids("before_neighbors").alias("before_ids"),
        ids("after_neighbors").alias("after_ids"),
    )


@query(
    "similarity_content",
    f"""SELECT p.id AS content_id, p.content_number, round(max(h.score), 6) AS score,
          count(*) AS n_chunks
        FROM {HITS_SQL} h JOIN p_search_pages p ON p.id = h.content_id GROUP BY ALL""",
)
def similarity_content(t: DriverTables) -> DataFrame:
    request = SearchRequest(
        t.query_vector(), limit=8, score_threshold=0.1, when_match_return="content"
    )
    rows = search.similarity_search(t.chunks, t.search_pages, None, request)
    return search.page_matches(rows).withColumn("score", F.round("score", 6))


PAGE_NEIGHBORS_SQL = f"""SELECT p.id AS content_id, p.content_number, h.chunk_id,
         round(CASE WHEN p.id <> h.content_id THEN 0.0 ELSE h.score END, 6) AS score,
         p.id <> h.content_id AS is_neighbor,
         CASE WHEN p.id <> h.content_id THEN h.content_id END AS neighbor_from
       FROM {HITS_SQL} h JOIN p_search_pages o ON o.id = h.content_id
       JOIN p_search_pages p ON p.file_id = o.file_id
        AND p.content_number BETWEEN o.content_number - 1 AND o.content_number + 1"""


def _page_neighbors(t: DriverTables) -> DataFrame:
    request = SearchRequest(
        t.query_vector(),
        limit=8,
        score_threshold=0.1,
        when_match_return="content",
        before_neighbor_count=1,
        after_neighbor_count=1,
    )
    return search.similarity_search(t.chunks, t.search_pages, None, request)


@query("similarity_content_neighbors", PAGE_NEIGHBORS_SQL)
def similarity_content_neighbors(t: DriverTables) -> DataFrame:
    return _page_neighbors(t).select(
        "content_id",
        "content_number",
        "chunk_id",
        F.round("score", 6).alias("score"),
        "is_neighbor",
        "neighbor_from",
    )


@query(
    "similarity_content_nested",
    f"""WITH hits AS {HITS_SQL},
          own AS (SELECT content_id, round(max(score), 6) AS score,
                    string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY score DESC, chunk_id) AS chunk_ids
                  FROM hits GROUP BY content_id)
        SELECT o.content_id AS hit_id, own.score, own.chunk_ids,
          coalesce(string_agg(CAST(p.id AS VARCHAR), ',' ORDER BY p.content_number)
                   FILTER (p.content_number < o.content_number), '') AS before_ids,
          coalesce(string_agg(CAST(p.id AS VARCHAR), ',' ORDER BY p.content_number)
                   FILTER (p.content_number > o.content_number), '') AS after_ids
        FROM own JOIN (SELECT id AS content_id, file_id, content_number FROM p_search_pages) o
          USING (content_id)
        JOIN p_search_pages p ON p.file_id = o.file_id
         AND p.content_number BETWEEN o.content_number - 1 AND o.content_number + 1
        GROUP BY ALL""",
)
def similarity_content_nested(t: DriverTables) -> DataFrame:
    def ids(column: str, name: str):
        return F.array_join(F.transform(column, lambda n: n[name].cast("string")), ",")

    return search.nest_page_matches(_page_neighbors(t)).select(
        "hit_id",
        F.round("score", 6).alias("score"),
        ids("match_chunks", "chunk_id").alias("chunk_ids"),
        ids("before_neighbors", "content_id").alias("before_ids"),
        ids("after_neighbors", "content_id").alias("after_ids"),
    )


@query(
    "retrieve_policy",
    """SELECT p.id AS content_id, round(h.score, 6) AS score, h.chunk_id
       FROM (SELECT * FROM p_scored WHERE score > 0.2
             ORDER BY chunk_number, score DESC, chunk_id LIMIT 10) h
       JOIN p_search_pages p ON p.id = h.content_id""",
)
def retrieve_policy(t: DriverTables) -> DataFrame:
    request = search.retrieval_request(t.query_vector(), score_threshold=0.2)
    rows = search.similarity_search(t.chunks, t.search_pages, None, request)
    return rows.select("content_id", F.round("score", 6).alias("score"), "chunk_id")


@query(
    "retrieve_policy_strict",
    """WITH hits AS (
         SELECT s.chunk_id, s.file_id, s.score, p.id AS page_id, p.content_number
         FROM p_scored s JOIN p_search_pages p ON p.id = s.content_id
         WHERE s.score > 0.31 ORDER BY s.score DESC, s.chunk_id LIMIT 10)
       SELECT p.id AS content_id, p.id <> h.page_id AS is_neighbor,
         CASE WHEN p.id <> h.page_id THEN h.page_id END AS neighbor_from
       FROM hits h JOIN p_search_pages p ON p.file_id = h.file_id
        AND p.content_number BETWEEN h.content_number - 1 AND h.content_number + 1""",
)
def retrieve_policy_strict(t: DriverTables) -> DataFrame:
    """A threshold above the default brings the pages around each hit."""
    request = search.retrieval_request(t.query_vector(), score_threshold=0.31)
    rows = search.similarity_search(t.chunks, t.search_pages, None, request)
    return rows.select("content_id", "is_neighbor", "neighbor_from")


@query(
    "neighbor_window",
    """SELECT c.id, string_agg(CAST(n.id AS VARCHAR), ',' ORDER BY n.id) AS neighbor_ids
       FROM p_chunks c JOIN p_chunks n ON n.file_id = c.file_id
        AND n.chunk_number BETWEEN c.chunk_number - 1 AND c.chunk_number + 2
       GROUP BY c.id""",
)
def neighbor_window(t: DriverTables) -> DataFrame:
    rows = search.neighbor_window(t.chunks.select("id", "file_id", "chunk_number"), 1, 2)
    ids = F.transform(F.sort_array("neighbor_ids"), lambda i: i.cast("string"))
    return rows.select("id", F.array_join(ids, ",").alias("neighbor_ids"))


@query("similarity_lsh_topk")
def similarity_lsh_topk(t: DriverTables) -> DataFrame:
    """The approximate index; its recall against the exact search is tested."""
    vector = t.query_vector()
    return similarity_lsh(build_lsh_index(t.chunks, len(vector)), vector, 10)


GIVEN_LISTS, GIVEN_PROBES, INDEX_LIMIT = 16, 3, 10

# Each chunk with its list, where the centroids are given: some chunks' own vectors.
PLACED_SQL = f"""seeds AS (
         SELECT row_number() OVER (ORDER BY id) - 1 AS list, embedding AS centroid
         FROM p_chunks WHERE id % 25 = 1 AND embedding IS NOT NULL
         ORDER BY id LIMIT {GIVEN_LISTS}),
       placed AS (
         SELECT c.id, s.list, list_cosine_similarity(c.embedding, s.centroid) AS cosine
         FROM p_chunks c, seeds s WHERE c.embedding IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY
           round(list_cosine_similarity(c.embedding, s.centroid), 9) DESC, s.list) = 1)"""


def _given_index(t: DriverTables, label: str) -> vector_index.VectorIndex:
    seeds = t.chunks.filter("id % 25 = 1 AND embedding IS NOT NULL").orderBy("id")
    vectors = [row.embedding for row in seeds.limit(GIVEN_LISTS).select("embedding").collect()]
    return vector_index.create_index(t.chunks, vectors, scratch_path(t.spark, label))


def _fitted_index(t: DriverTables, label: str) -> vector_index.VectorIndex:
    centroids = vector_index.fit_centroids(t.chunks, 24)
    return vector_index.create_index(t.chunks, centroids, scratch_path(t.spark, label))


def _index_hits(hits: DataFrame) -> DataFrame:
    return hits.select("chunk_id", "file_id", "chunk_number", F.round("score", 6).alias("score"))


@query(
    "index_lists",
    f"""WITH {PLACED_SQL}
        SELECT list, count(*) AS n_rows, round(min(cosine), 6) AS least_cosine
        FROM placed GROUP BY list""",
)
def index_lists(t: DriverTables) -> DataFrame:
    """The lists of an index over given centroids, filled in two additions."""
    seeds = t.chunks.filter("id % 25 = 1 AND embedding IS NOT NULL").orderBy("id")
    vectors = [row.embedding for row in seeds.limit(GIVEN_LISTS).select("embedding").collect()]
    even = F.col("id") % 2 == 0
    index = vector_index.create_index(
        t.chunks.filter(even), vectors, scratch_path(t.spark, "index-lists")
    )
    for _ in range(2):  # once more, as after an interruption
        vector_index.add_to_index(index, t.chunks.filter(~even), "odd")
    return index.lists(t.spark).withColumn("least_cosine", F.round("least_cosine", 6))


@query(
    "similarity_index_topk",
    f"""WITH {PLACED_SQL},
       near AS (
         SELECT list, row_number() OVER (ORDER BY
           round(list_cosine_similarity(centroid, CAST(q.embedding AS DOUBLE[])), 9) DESC, list) AS place
         FROM seeds, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
         WHERE list IN (SELECT list FROM placed)),
       scoped AS (
         SELECT s.*, n.place FROM p_scored s JOIN placed p ON p.id = s.chunk_id
         JOIN near n USING (list) WHERE s.project_id = '{SIMILAR_PROJECT}'),
       upto AS (
         SELECT coalesce(min(m), 1000) AS m
         FROM (SELECT unnest([{", ".join(str(GIVEN_PROBES << n) for n in range(6))}]) AS m)
         WHERE (SELECT count(*) FROM scoped WHERE place <= m) >= {INDEX_LIMIT})
       SELECT chunk_id, file_id, chunk_number, {ROUNDED}
       FROM scoped p_scored, upto WHERE place <= m
       ORDER BY p_scored.score DESC, chunk_id LIMIT {INDEX_LIMIT}""",
)
def similarity_index_topk(t: DriverTables) -> DataFrame:
    """One project's best chunks in the nearest lists, and in further ones until there are ten."""
    index = _given_index(t, "index-topk")
    return _index_hits(
        vector_index.search_index(
            t.spark,
            index,
            t.query_vector(),
            INDEX_LIMIT,
            project_id=SIMILAR_PROJECT,
            probes=GIVEN_PROBES,
        )
    )


@query(
    "similarity_index_exact",
    f"""SELECT chunk_id, file_id, chunk_number, {ROUNDED} FROM p_scored
        ORDER BY p_scored.score DESC, chunk_id LIMIT 20""",
)
def similarity_index_exact(t: DriverTables) -> DataFrame:
    """Fitted centroids; lists are read until none left can hold a better chunk."""
    index = vector_index.open_index(t.spark, _fitted_index(t, "index-exact").path)
    return _index_hits(
        vector_index.search_index(t.spark, index, t.query_vector(), 20, probes=2, exact=True)
    )


@query(
    "similarity_index_filtered",
    f"""SELECT chunk_id, file_id, chunk_number, {ROUNDED} FROM p_scored
        WHERE project_id = '{SIMILAR_PROJECT}' AND file_id % 2 = 0 AND file_id < 400
          AND p_scored.score > 0.05
        ORDER BY p_scored.score DESC, chunk_id LIMIT 15""",
)
def similarity_index_filtered(t: DriverTables) -> DataFrame:
    """Project, files and threshold; lists below the threshold are never read."""
    return _index_hits(
        vector_index.search_index(
            t.spark,
            _fitted_index(t, "index-filtered"),
            t.query_vector(),
            15,
            project_id=SIMILAR_PROJECT,
            file_ids=range(0, 400, 2),
            score_threshold=0.05,
            probes=4,
            exact=True,
        )
    )
