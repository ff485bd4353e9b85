"""Changes to the platform tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators import maintenance as m
from foliospark.plans.driver_tables import DriverTables, seconds_after_base
from foliospark.plans.registry import query


def _incoming(t: DriverTables) -> DataFrame:
    """A later run: the language question again for every file, by its MIME type,
    and question 6 for the first time."""
    index = F.regexp_extract("project_id", r"(\d+)$", 1).cast("long")
    again = F.array(
        F.struct(F.lit(3).cast("long").alias("k"), F.col("type").alias("response")),
        F.struct(F.lit(6).cast("long").alias("k"), F.col("status").alias("response")),
    )
    rows = t.files.select(F.col("id").alias("file_id"), index.alias("_index"), F.inline(again))
    later = seconds_after_base(F.col("file_id") + 1_000_000)
    return rows.select(
        (F.col("file_id") * 100 + F.col("k") * 10 + 9).alias("id"),
        "file_id",
        (F.col("_index") * 10 + F.col("k")).alias("evaluation_id"),
        (F.col("file_id") * 100_000 + 1).alias("content_id"),
        "response",
        F.lit("completed").alias("status"),
        F.lit(None).cast("string").alias("error"),
        later.alias("created_at"),
        later.alias("updated_at"),
    )


UPSERT_SQL = """WITH incoming AS (
         SELECT f.id * 100 + k * 10 + 9 AS id, f.id AS file_id, p.idx * 10 + k AS evaluation_id,
           f.id * 100000 + 1 AS content_id,
           CASE WHEN k = 3 THEN f.type ELSE f.status END AS response,
           1704067200 + f.id + 1000000 AS updated_at
         FROM p_files f JOIN p_projects p ON p.id = f.project_id, (VALUES (3), (6)) v(k)),
       both_tables AS (
         SELECT 0 AS arrival, id, file_id, evaluation_id, content_id, response, updated_at,
           updated_at AS created_at FROM p_answers
         UNION ALL SELECT 1, id, file_id, evaluation_id, content_id, response, updated_at,
           updated_at FROM incoming)
       SELECT evaluation_id, content_id, arg_min(id, (arrival, created_at, id)) AS id,
         arg_min(created_at, (arrival, created_at, id)) AS created_at,
         arg_max(response, (arrival, updated_at, id)) AS response,
         max(updated_at) AS updated_at
       FROM both_tables GROUP BY ALL"""

UPSERT_COLUMNS = ("evaluation_id", "content_id", "id", "created_at", "response", "updated_at")


@query("upsert_answers", UPSERT_SQL)
def upsert_answers(t: DriverTables) -> DataFrame:
    return m.upsert_answers(t.answers, _incoming(t)).select(*UPSERT_COLUMNS)


@query(
    "update_rows",
    """SELECT id, name, CASE WHEN id IN (SELECT doc_id FROM labels) THEN 'evaluated'
         ELSE status END AS status FROM p_files""",
)
def update_rows(t: DriverTables) -> DataFrame:
    """Every labelled file changes its status."""
    changes = t.read("labels").select(
        F.col("doc_id").alias("id"), F.lit("evaluated").alias("status")
    )
    return m.update_rows(t.files, changes).select("id", "name", "status")


@query(
    "delete_file_cascade",
    """WITH gone AS (SELECT id FROM p_files WHERE status = 'failed')
       SELECT 'files' AS table_name, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum
       FROM p_files WHERE id NOT IN (FROM gone)
       UNION ALL SELECT 'file_contents', count(*), CAST(sum(id) AS BIGINT)
       FROM p_pages WHERE file_id NOT IN (FROM gone)
       UNION ALL SELECT 'file_embeddings', count(*), CAST(sum(id) AS BIGINT)
       FROM p_chunks WHERE file_id NOT IN (FROM gone)
       UNION ALL SELECT 'file_evaluations', count(*), CAST(sum(id) AS BIGINT)
       FROM p_answers WHERE file_id NOT IN (FROM gone)""",
)
def delete_file_cascade(t: DriverTables) -> DataFrame:
    tables = {
        "files": t.files,
        "file_contents": t.pages,
        "file_embeddings": t.chunks,
        "file_evaluations": t.answers,
    }
    left = m.delete_files(tables, t.files.filter("status = 'failed'").select("id"))
    return _remaining(left, tuple(tables))


def _remaining(tables: dict[str, DataFrame], names: tuple[str, ...]) -> DataFrame:
    result = None
    for name in names:
        part = tables[name].agg(
            F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum")
        ).select(F.lit(name).alias("table_name"), "n", "id_sum")
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "delete_evaluation_cascade",
    """WITH RECURSIVE gone AS (
         SELECT id FROM p_evaluations WHERE title = 'toxic'
         UNION SELECT e.id FROM p_evaluations e JOIN gone g ON e.parent_evaluation_id = g.id)
       SELECT 'evaluations' AS table_name, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum
       FROM p_evaluations WHERE id NOT IN (FROM gone)
       UNION ALL SELECT 'file_evaluations', count(*), CAST(sum(id) AS BIGINT)
       FROM p_answers WHERE evaluation_id NOT IN (FROM gone)""",
)
def delete_evaluation_cascade(t: DriverTables) -> DataFrame:
    tables = {"evaluations": t.evaluations, "file_evaluations": t.answers}
    ids = t.evaluations.filter("title = 'toxic'").select("id")
    return _remaining(m.delete_evaluations(tables, ids), tuple(tables))


@query(
    "delete_project_cascade",
    """SELECT 'files' AS table_name, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum
       FROM p_files WHERE project_id <> 'src5'
       UNION ALL SELECT 'evaluations', count(*), CAST(sum(id) AS BIGINT)
       FROM p_evaluations WHERE project_id <> 'src5'
       UNION ALL SELECT 'evaluation_categories', count(*), CAST(sum(id) AS BIGINT)
       FROM p_categories WHERE project_id <> 'src5'
       UNION ALL SELECT 'file_embeddings', count(*), CAST(sum(id) AS BIGINT)
       FROM p_chunks WHERE project_id <> 'src5'
       UNION ALL SELECT 'file_evaluations', count(*), CAST(sum(a.id) AS BIGINT)
       FROM p_answers a JOIN p_files f ON f.id = a.file_id WHERE f.project_id <> 'src5'""",
)
def delete_project_cascade(t: DriverTables) -> DataFrame:
    tables = {
        "projects": t.projects,
        "files": t.files,
        "evaluations": t.evaluations,
        "evaluation_categories": t.categories,
        "file_embeddings": t.chunks,
        "file_evaluations": t.answers,
    }
    gone = t.projects.filter("id = 'src5'").select("id")
    left = m.delete_projects(tables, gone, cascade=True)
    return _remaining(left, tuple(n for n in tables if n != "projects"))


@query(
    "find_or_create_categories",
    """SELECT w.name, w.project_id, coalesce(c.description, 'Category: ' || w.name) AS description,
         c.id IS NULL AS is_new
       FROM (SELECT DISTINCT lang AS name, source AS project_id FROM documents
             UNION SELECT 'Quality', source FROM documents) w
       LEFT JOIN p_categories c ON c.name = w.name AND c.project_id = w.project_id""",
)
def find_or_create_categories(t: DriverTables) -> DataFrame:
    none = F.lit(None).cast("string").alias("description")
    project = F.col("source").alias("project_id")
    wanted = t.documents.select(F.col("lang").alias("name"), project, none).unionByName(
        t.documents.select(F.lit("Quality").alias("name"), project, none)
    )
    return m.find_or_create_categories(t.categories, wanted).drop("id")


@query(
    "ensure_default_category",
    """SELECT p.id AS project_id, 'default' AS name,
         coalesce(c.description, 'Default evaluation category') AS description,
         c.id IS NULL AS is_new
       FROM p_projects p LEFT JOIN p_categories c
         ON c.project_id = p.id AND c.name = 'default' AND c.project_id <> 'src_empty'""",
)
def ensure_default_category(t: DriverTables) -> DataFrame:
    """The empty project has lost its categories."""
    present = t.categories.filter("project_id <> 'src_empty'")
    return m.ensure_default_category(present, t.projects).drop("id")


@query(
    "seed_examples",
    """SELECT p.id AS project_id, v.title, v.evaluation_type, v.options
       FROM p_projects p, (VALUES ('Pizza Mention Detector', 'text', NULL),
                                  ('Joke Finder', 'enum_choice', 'good,bad,none'))
         v(title, evaluation_type, options)""",
)
def seed_examples(t: DriverTables) -> DataFrame:
    _, new = m.seed_examples(t.categories, t.evaluations, t.projects)
    return new.select(
        "project_id",
        "title",
        "evaluation_type",
        F.array_join("evaluation_options", ",").alias("options"),
    )


@query(
    "resolve_categories",
    """WITH requests AS (
         SELECT doc_id, source, idx,
           CASE WHEN doc_id // 20 % 4 IN (0, 3) THEN idx * 10 + 2 END AS category_id,
           CASE WHEN doc_id // 20 % 4 IN (1, 3) THEN lang WHEN doc_id // 20 % 8 = 2 THEN 'Quality' END
             AS category_name FROM p_docs)
       SELECT doc_id, CASE WHEN category_id IS NULL AND category_name IS NULL THEN 'no category given'
                           WHEN category_id IS NOT NULL AND category_name IS NOT NULL
                           THEN 'category given twice' END AS reject_reason,
         CASE WHEN category_name IS NULL THEN category_id
              WHEN category_id IS NULL AND category_name = 'Quality' THEN idx * 10 + 2 END
           AS known_id,
         category_id IS NULL AND coalesce(category_name, 'Quality') <> 'Quality' AS is_new
       FROM requests""",
)
def resolve_categories(t: DriverTables) -> DataFrame:
    """Creation requests by id, by new name, by known name, by both and by none.

    Every project holds all kinds; a refused request names what another creates.
    """
    doc = F.floor(F.col("doc_id") / 20)
    index = F.regexp_extract("source", r"(\d+)$", 1).cast("long")
    requests = t.documents.select(
        "doc_id",
        F.col("source").alias("project_id"),
        F.when((doc % 4).isin(0, 3), index * 10 + 2).alias("category_id"),
        F.when((doc % 4).isin(1, 3), F.col("lang"))
        .when(doc % 8 == 2, "Quality")
        .alias("category_name"),
        F.lit(None).cast("string").alias("category_description"),
    )
    resolved = m.resolve_categories(requests, t.categories)
    return resolved.select(
        "doc_id",
        "reject_reason",
        F.expr("try_cast(resolved_category_id AS BIGINT)").alias("known_id"),
        "is_new",
    )


@query(
    "exclusive_default",
    """SELECT id, category_id, id % 10 = 2 AS is_default FROM p_templates""",
)
def exclusive_default(t: DriverTables) -> DataFrame:
    """Both templates of each category claim to be the default."""
    claimed = t.templates.withColumn("default", F.lit(True))
    return m.exclusive_default(claimed).select(
        "id", "category_id", F.col("default").alias("is_default")
    )


@query(
    "backfill_category",
    """SELECT e.id, CASE WHEN e.evaluation_type = 'text' THEN c.id ELSE e.category_id END AS category_id
       FROM p_evaluations e JOIN p_categories c
         ON c.project_id = e.project_id AND c.name = 'default'""",
)
def backfill_category(t: DriverTables) -> DataFrame:
    """Text questions come from before the categories."""
    old = t.evaluations.withColumn(
        "category_id", F.when(F.col("evaluation_type") != "text", F.col("category_id"))
    )
    return m.backfill_category(old, t.categories).select("id", "category_id")


@query(
    "backfill_chunk_status",
    "SELECT id, status FROM p_chunks",
)
def backfill_chunk_status(t: DriverTables) -> DataFrame:
    """Chunks without a vector come from before the status column."""
    old = t.chunks.withColumn("status", F.when(F.col("status") == "EMBEDDED", F.col("status")))
    return m.backfill_chunk_status(old).select("id", "status")
