"""Lookups, filters, joins and statistics over the platform tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark import schemas
from foliospark.functions import text
from foliospark.operators import maintenance, reads, reports
from foliospark.operators.scale import first_per_key
from foliospark.plans.driver_tables import DriverTables
from foliospark.plans.registry import query
from foliospark.session import materialise


def detail(t: DriverTables) -> DataFrame:
    return reports.answers_detail(t.answers, t.files, t.evaluations, t.pages)


@query(
    "project_stats",
    """SELECT p.id, p.name, count(DISTINCT f.id) AS total_files_count,
         count(DISTINCT f.id) FILTER (f.status = 'pending') AS pending_files_count,
         count(DISTINCT f.id) FILTER (f.status = 'completed') AS completed_files_count,
         count(DISTINCT f.id) FILTER (f.status = 'failed') AS failed_files_count,
         CAST(coalesce((SELECT sum(size) FROM p_files g WHERE g.project_id = p.id), 0)
              AS DOUBLE) AS total_size,
         count(a.id) AS total_evaluations
       FROM p_projects p LEFT JOIN p_files f ON f.project_id = p.id
       LEFT JOIN p_answers a ON a.file_id = f.id GROUP BY p.id, p.name""",
)
def project_stats(t: DriverTables) -> DataFrame:
    return reports.project_stats(t.projects, t.files, t.answers).drop(
        "description", "created_at", "updated_at"
    )


@query(
    "scan_ordered",
    "SELECT id, name, status, size, created_at FROM p_files ORDER BY size DESC, id",
)
def scan_ordered(t: DriverTables) -> DataFrame:
    return reads.scan_ordered(
        t.files.select("id", "name", "status", "size", "created_at"), "size", "desc"
    )


@query("lookup", "SELECT id, name, status FROM p_files WHERE id = 7")
def lookup(t: DriverTables) -> DataFrame:
    return reads.lookup(t.files, 7).select("id", "name", "status")


@query(
    "read_view",
    """SELECT id, file_id, chunk_number, content, status, project_id, content_id FROM p_chunks""",
)
def read_view(t: DriverTables) -> DataFrame:
    """Chunks as the read side sees them, without vectors."""
    seen = schemas.read_view(t.chunks)
    assert "embedding" not in seen.columns
    return seen.select(
        "id", "file_id", "chunk_number", "content", "status", "project_id", "content_id"
    )


@query(
    "stable_ids",
    """SELECT doc_id, sha256(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id || '|'
                             || length(source) || ':' || source || '|0:') AS id
       FROM documents""",
)
def stable_ids(t: DriverTables) -> DataFrame:
    """Ids that follow from their parts, a missing part included."""
    parts = (F.col("doc_id"), F.col("source"), F.lit(None).cast("string"))
    return t.documents.select("doc_id", text.stable_id(*parts).alias("id"))


@query(
    "lookup_many",
    """SELECT p.id, p.file_id, p.content_number, p.content FROM p_pages p
       WHERE (file_id, content_number) IN (SELECT doc_id, 1 + doc_id % 3 FROM documents)""",
)
def lookup_many(t: DriverTables) -> DataFrame:
    wanted = t.documents.select(
        F.col("doc_id").alias("file_id"),
        (F.col("doc_id") % 3 + 1).cast("int").alias("content_number"),
    )
    return reads.lookup_many(t.pages, wanted).select(
        "id", "file_id", "content_number", "content"
    )


@query(
    "pages_by_file",
    "SELECT id, file_id, content_number, content FROM p_pages WHERE file_id = 0",
)
def pages_by_file(t: DriverTables) -> DataFrame:
    return reads.pages_by_file(t.pages, 0).select(
        "id", "file_id", "content_number", "content"
    )


@query(
    "files_by_project",
    """SELECT id, name, type, size, url, status, created_at FROM p_files
       WHERE project_id = 'src3' ORDER BY created_at DESC""",
)
def files_by_project(t: DriverTables) -> DataFrame:
    return reads.by_project(t.files, "src3", newest_first=True).select(
        "id", "name", "type", "size", "url", "status", "created_at"
    )


@query(
    "file_owned_by_project",
    "SELECT id, name, project_id FROM p_files WHERE id = 3 AND project_id = 'src3'",
)
def file_owned_by_project(t: DriverTables) -> DataFrame:
    return reads.owned_by(t.files, 3, "src3").select("id", "name", "project_id")


@query(
    "page_range",
    """SELECT p.id, p.file_id, p.content_number FROM p_pages p
       JOIN documents d ON d.doc_id = p.file_id
       WHERE content_number >= 2 AND (d.lang = 'en' OR content_number <= 4)""",
)
def page_range(t: DriverTables) -> DataFrame:
    """Pages 2 to 4 of every file, and all from 2 on of English ones."""
    requests = t.documents.select(
        F.col("doc_id").alias("file_id"),
        F.lit(2).alias("from_page"),
        F.when(F.col("lang") != "en", 4).alias("to_page"),
    )
    return reads.page_ranges(t.pages, requests).select("id", "file_id", "content_number")


@query(
    "evaluations_by_parent",
    """SELECT DISTINCT e.id, e.title, e.project_id, e.parent_evaluation_id,
         e.parent_evaluation_option
       FROM p_evaluations e JOIN p_evaluations w
         ON e.project_id = w.project_id
        AND e.parent_evaluation_id IS NOT DISTINCT FROM w.parent_evaluation_id
        AND e.parent_evaluation_option IS NOT DISTINCT FROM w.parent_evaluation_option
       WHERE w.evaluation_type <> 'boolean'""",
)
def evaluations_by_parent(t: DriverTables) -> DataFrame:
    """Everything that is asked together with a question that is not boolean."""
    parents = t.evaluations.filter(F.col("evaluation_type") != "boolean").select(
        "project_id", "parent_evaluation_id", "parent_evaluation_option"
    )
    return reads.evaluations_for_parents(t.evaluations, parents).select(
        "id", "title", "project_id", "parent_evaluation_id", "parent_evaluation_option"
    )


@query(
    "evaluations_by_category",
    """SELECT id, title, created_at FROM p_evaluations
       WHERE project_id = 'src4' AND category_id = 42 ORDER BY created_at DESC""",
)
def evaluations_by_category(t: DriverTables) -> DataFrame:
    return reads.evaluations_by_category(t.evaluations, "src4", 42).select(
        "id", "title", "created_at"
    )


@query(
    "templates_by_project",
    """SELECT id, category_id, is_default FROM p_templates
       WHERE project_id = 'src4' ORDER BY created_at""",
)
def templates_by_project(t: DriverTables) -> DataFrame:
    return reads.by_project(t.templates, "src4").select(
        "id", "category_id", F.col("default").alias("is_default")
    )


@query(
    "category_by_name",
    "SELECT id, name, project_id FROM p_categories WHERE name = 'Quality' AND project_id = 'src4'",
)
def category_by_name(t: DriverTables) -> DataFrame:
    return reads.category_by_name(t.categories, "Quality", "src4").select(
        "id", "name", "project_id"
    )


@query(
    "default_templates",
    """SELECT e.id AS evaluation_id, coalesce(e.template_id, t.id) AS template_id
       FROM p_evaluations e
       LEFT JOIN (SELECT * FROM p_templates WHERE is_default) t USING (category_id)""",
)
def default_templates(t: DriverTables) -> DataFrame:
    return reads.with_default_template(t.evaluations, t.templates).select(
        F.col("id").alias("evaluation_id"), "template_id"
    )


@query(
    "file_name_search",
    "SELECT id, name FROM p_files WHERE name ILIKE '%OC-%7_.T%'",
)
def file_name_search(t: DriverTables) -> DataFrame:
    from foliospark.operators.filters import name_contains

    return name_contains(t.files, "OC-%7_.T").select("id", "name")


@query(
    "evaluation_text_search",
    """SELECT id, title FROM p_evaluations
       WHERE contains(CAST(id AS VARCHAR), 'to') OR contains(title, 'to')
          OR contains(prompt, 'to') OR contains(description, 'to')""",
)
def evaluation_text_search(t: DriverTables) -> DataFrame:
    return reads.search_evaluations(t.evaluations, "to").select("id", "title")


@query(
    "category_search",
    """SELECT c.id, c.name, count(e.id) AS n_evaluations, lower(c.name) = 'default' AS is_exact
       FROM p_categories c LEFT JOIN p_evaluations e ON e.category_id = c.id
       WHERE contains(lower(c.name), 'default') GROUP BY ALL
       HAVING lower(c.name) <> 'default' OR count(e.id) > 0""",
)
def category_search(t: DriverTables) -> DataFrame:
    return reads.search_categories(t.categories, t.evaluations, "Default").select(
        "id", "name", "n_evaluations", "is_exact"
    )


@query(
    "categories_with_evals",
    """SELECT id, name, project_id FROM p_categories c WHERE EXISTS (
         SELECT 1 FROM p_evaluations e
         WHERE e.category_id = c.id AND e.project_id = c.project_id)""",
)
def categories_with_evals(t: DriverTables) -> DataFrame:
    return reads.categories_in_use(t.categories, t.evaluations, True).select(
        "id", "name", "project_id"
    )


@query(
    "categories_without_evals",
    """SELECT id, name, project_id FROM p_categories c WHERE NOT EXISTS (
         SELECT 1 FROM p_evaluations e
         WHERE e.category_id = c.id AND e.project_id = c.project_id)""",
)
def categories_without_evals(t: DriverTables) -> DataFrame:
    return reads.categories_in_use(t.categories, t.evaluations, False).select(
        "id", "name", "project_id"
    )


@query(
    "deletable_categories",
    """SELECT id, name FROM p_categories
       WHERE id NOT IN (SELECT category_id FROM p_evaluations)""",
)
def deletable_categories(t: DriverTables) -> DataFrame:
    return reads.deletable_categories(t.categories, t.evaluations).select("id", "name")


@query(
    "file_display",
    """SELECT id, CASE type WHEN 'application/pdf' THEN 'PDF' ELSE 'TXT' END AS type_label,
         CASE WHEN size < 1000 THEN size || ' B'
              ELSE regexp_replace(CAST(floor(CAST(size AS DOUBLE) / 1000 * 100 + 0.5) / 100
                                       AS VARCHAR), '\\.0$', '') || ' kB' END AS size_label
       FROM p_files""",
)
def file_display(t: DriverTables) -> DataFrame:
    return t.files.select(
        "id",
        text.file_type_label(F.col("type")).alias("type_label"),
        text.human_size(F.col("size")).alias("size_label"),
    )


@query(
    "mime_types",
    """SELECT doc_id, key, CASE lower(regexp_extract(key, '\\.[^./]*$'))
         WHEN '.pdf' THEN 'application/pdf' WHEN '.txt' THEN 'text/plain' END AS mime,
         CASE lower(regexp_extract(key, '\\.[^./]*$'))
         WHEN '.pdf' THEN 'application/pdf' WHEN '.txt' THEN 'text/plain'
         ELSE 'application/octet-stream' END AS upload_mime
       FROM p_objects""",
)
def mime_types(t: DriverTables) -> DataFrame:
    from foliospark.sources.landing import decode_landing_events, readable

    return readable(decode_landing_events(t.landing_messages)).select(
        "doc_id",
        "key",
        text.mime_type(F.col("key")).alias("mime"),
        text.upload_mime_type(F.col("key")).alias("upload_mime"),
    )


@query(
    "object_urls",
    """SELECT id, url, 'landing' AS bucket,
         project_id || '/' || id || regexp_extract(name, '\\.[^.]*$') AS key,
         's3://uploads/' || project_id || '/' || id || regexp_extract(name, '\\.[^.]*$') AS upload_url,
         'pending' AS upload_status, type AS upload_type FROM p_files""",
)
def object_urls(t: DriverTables) -> DataFrame:
    uploads = maintenance.register_uploads(t.files, "uploads").select(
        "id",
        F.col("url").alias("upload_url"),
        F.col("status").alias("upload_status"),
        F.col("type").alias("upload_type"),
    )
    urls = t.files.select(
        "id",
        "url",
        text.url_bucket(F.col("url")).alias("bucket"),
        text.url_key(F.col("url")).alias("key"),
    )
    return urls.join(uploads, "id")


@query(
    "callback_urls",
    """SELECT conv_id, turn,
         'https://callback?taskToken=' || url_encode(text) AS url, text AS token
       FROM conversations""",
)
def callback_urls(t: DriverTables) -> DataFrame:
    from foliospark.operators.evaluation import callback_url

    encoded = t.read("conversations").select(
        "conv_id", "turn", callback_url("https://callback", F.col("text")).alias("url")
    )
    token = F.substring_index("url", "taskToken=", -1)
    return encoded.withColumn("token", text.percent_decode(token))


@query(
    "answers_detail",
    """SELECT answer_id, file_id, file_name, evaluation_id, title, content_number, content,
         response FROM p_detail""",
)
def answers_detail(t: DriverTables) -> DataFrame:
    return detail(t).select(
        "answer_id",
        "file_id",
        "file_name",
        "evaluation_id",
        "title",
        "content_number",
        "content",
        "response",
    )


@query(
    "answers_by_file",
    """SELECT answer_id, content_number, title, response FROM p_detail
       WHERE file_id = 0 AND project_id = 'src0' ORDER BY content_number, title""",
)
def answers_by_file(t: DriverTables) -> DataFrame:
    return reports.answers_by_file(detail(t), "src0", 0).select(
        "answer_id", "content_number", "title", "response"
    )


@query(
    "answers_by_evaluation",
    """SELECT answer_id, file_id, response FROM p_detail
       WHERE evaluation_id = 53 AND project_id = 'src5' AND response = 'en'""",
)
def answers_by_evaluation(t: DriverTables) -> DataFrame:
    return reports.answers_by_evaluation(detail(t), "src5", 53, "en").select(
        "answer_id", "file_id", "response"
    )


@query(
    "answers_by_page",
    """SELECT a.file_id, p.content_number, count(*) AS n_answers,
         string_agg(a.evaluation_id || '=' || a.response, ';'
                    ORDER BY a.evaluation_id, a.response, a.id) AS answers
       FROM p_answers a JOIN p_pages p ON p.id = a.content_id GROUP BY ALL""",
)
def answers_by_page(t: DriverTables) -> DataFrame:
    listed = F.transform(
        "answers",
        lambda a: F.concat(a.evaluation_id.cast("string"), F.lit("="), a.response),
    )
    return reports.answers_by_page(t.answers, t.pages).withColumn(
        "answers", F.array_join(listed, ";")
    )


@query(
    "file_answer_summary",
    """SELECT a.file_id, count(*) AS n_answers, max(p.content_number) AS last_page
       FROM p_answers a JOIN p_pages p ON p.id = a.content_id GROUP BY a.file_id""",
)
def file_answer_summary(t: DriverTables) -> DataFrame:
    return reports.file_answer_summary(t.answers, t.pages)


@query(
    "evaluations_grouped",
    """SELECT c.id AS category_id, c.name AS category_name, e.id AS item_id
       FROM p_categories c LEFT JOIN p_evaluations e ON e.category_id = c.id
       WHERE e.id IS NOT NULL OR lower(c.name) <> 'default'""",
)
def evaluations_grouped(t: DriverTables) -> DataFrame:
    return reports.grouped_by_category(t.categories, t.evaluations).select(
        "category_id", "category_name", "item_id"
    )


@query(
    "templates_grouped",
    """SELECT c.id AS category_id, c.name AS category_name, t.id AS item_id
       FROM p_categories c JOIN p_templates t ON t.category_id = c.id""",
)
def templates_grouped(t: DriverTables) -> DataFrame:
    return reports.grouped_by_category(t.categories, t.templates).select(
        "category_id", "category_name", "item_id"
    )


@query(
    "dedupe_latest",
    "SELECT id, file_id, evaluation_id, content_id, response, updated_at FROM p_latest",
)
def dedupe_latest(t: DriverTables) -> DataFrame:
    return maintenance.latest_answers(
        t.answers.select("id", "file_id", "evaluation_id", "content_id", "response", "updated_at")
    )


@query(
    "distinct_on",
    """SELECT DISTINCT ON (source, lang) source AS project_id, lang, doc_id, n_chars
       FROM documents ORDER BY source, lang, n_chars, doc_id""",
)
def distinct_on(t: DriverTables) -> DataFrame:
    rows = t.documents.select(F.col("source").alias("project_id"), "lang", "doc_id", "n_chars")
    return first_per_key(rows, ["project_id", "lang"], [F.col("n_chars"), F.col("doc_id")])


@query(
    "answer_display",
    """SELECT answer_id, response, CASE WHEN evaluation_type = 'boolean'
         THEN CASE WHEN response = 'true' THEN 'Yes' ELSE 'No' END
         ELSE response END AS answer FROM p_detail""",
)
def answer_display(t: DriverTables) -> DataFrame:
    return detail(t).select(
        "answer_id",
        "response",
        reads.displayed_answer(F.col("evaluation_type"), F.col("response")).alias("answer"),
    )


RESULTS_SQL = """SELECT l.id AS answer_id, d.category_id, d.file_name, d.title, d.response,
         coalesce(nullif(d.page_label, ''), CAST(d.content_number AS VARCHAR)) AS page_label,
         d.content, d.response = 'true' AS is_match
       FROM p_latest l JOIN p_detail d ON d.answer_id = l.id"""


def _results(t: DriverTables) -> DataFrame:
    return reports.results_table(t.answers, t.files, t.evaluations, t.pages).select(
        "answer_id",
        "category_id",
        "file_name",
        "title",
        "response",
        "page_label",
        "content",
        "is_match",
    )


@query("results_table", RESULTS_SQL)
def results_table(t: DriverTables) -> DataFrame:
    return _results(t)


@query(
    "results_match_filter",
    f"SELECT * FROM ({RESULTS_SQL}) WHERE response = 'true' AND contains(lower(content), 'the')",
)
def results_match_filter(t: DriverTables) -> DataFrame:
    return reads.match_filter(_results(t), "match", "the")


@query(
    "results_page",
    f"""SELECT answer_id, file_name, title, response FROM ({RESULTS_SQL})
        ORDER BY title DESC, answer_id LIMIT 10 OFFSET 20""",
)
def results_page(t: DriverTables) -> DataFrame:
    return reads.page_of_rows(
        _results(t), [F.col("title").desc(), F.col("answer_id").asc()], 2
    ).select("answer_id", "file_name", "title", "response")


@query(
    "results_page_after",
    f"""SELECT CAST((n - 1) // 10 AS BIGINT) AS page, answer_id, file_name, title, page_label
        FROM (SELECT *, row_number() OVER (ORDER BY page_label DESC NULLS LAST, title, answer_id) AS n
              FROM ({RESULTS_SQL}))
        WHERE n <= 30""",
)
def results_page_after(t: DriverTables) -> DataFrame:
    """The first three pages, each found from the last row of the one before."""
    keys = [reads.SortKey("page_label", descending=True), reads.SortKey("title"), reads.SortKey("answer_id")]
    table, last, pages = materialise(_results(t), "results"), None, None
    for number in range(3):
        page = reads.page_after(table, keys, last).withColumn("page", F.lit(number))
        end = page.orderBy(*[k.order() for k in keys]).select(*[k.column for k in keys]).tail(1)
        if not end:
            break
        last = tuple(end[0])
        pages = page if pages is None else pages.unionByName(page)
    return pages.select("page", "answer_id", "file_name", "title", "page_label")


FILE_STATUS_SQL = """SELECT f.id, f.status AS registered_status, coalesce(c.n, 0) AS n_chunks,
         coalesce(c.e, 0) AS n_embedded, coalesce(a.n, 0) AS n_answers, x.error,
         CASE WHEN x.error IS NOT NULL OR a.failed > 0 THEN 'failed'
              WHEN a.done >= 2 THEN 'completed' WHEN a.n > 0 THEN 'evaluating'
              WHEN c.n > 0 AND c.e = c.n THEN 'embedded' WHEN c.e > 0 THEN 'embedding'
              WHEN c.n > 0 THEN 'chunked' ELSE f.status END AS status
       FROM p_files f
       LEFT JOIN (SELECT file_id, count(*) AS n, count(*) FILTER (status = 'EMBEDDED') AS e
                  FROM p_chunks GROUP BY file_id) c ON c.file_id = f.id
       LEFT JOIN (SELECT file_id, count(*) AS n, count(*) FILTER (best = 2) AS done,
                         count(*) FILTER (best = 1) AS failed
                  FROM (SELECT file_id, evaluation_id, content_id,
                               max(CASE WHEN evaluation_id % 10 <> 2 THEN 2 WHEN file_id % 3 = 0 THEN 0
                                        WHEN file_id % 3 = 1 AND file_id % 2 = 0 THEN 1 ELSE 2 END) AS best
                        FROM p_answers WHERE response IN ('true', 'false')
                        GROUP BY file_id, evaluation_id, content_id)
                  GROUP BY file_id) a ON a.file_id = f.id
       LEFT JOIN (SELECT doc_id, min(reject_reason) AS error FROM p_checked
                  WHERE reject_reason IS NOT NULL GROUP BY doc_id) x ON x.doc_id = f.id"""


def file_status_inputs(t: DriverTables) -> tuple[DataFrame, ...]:
    """Files, chunks, answers, failures and the number of answers due."""
    from foliospark.plans.ingest_queries import checked_objects

    failures = checked_objects(t).filter("reject_reason IS NOT NULL AND delivery < 2").select(
        F.col("doc_id").alias("file_id"), F.col("reject_reason").alias("error")
    )
    # Two answers are due for each file; of the second some are open, some failed.
    kind, file = F.col("evaluation_id") % 10, F.col("file_id")
    status = (
        F.when(kind != 2, "completed")
        .when(file % 3 == 0, "processing")
        .when((file % 3 == 1) & (file % 2 == 0), "failed")
        .otherwise("completed")
    )
    answered = t.answers.filter(F.col("response").isin("true", "false"))
    expected = t.files.select(F.col("id").alias("file_id"), F.lit(2).alias("n_expected"))
    return t.files, t.chunks, answered.withColumn("status", status), failures, expected


@query("file_status_rollup", FILE_STATUS_SQL)
def file_status_rollup(t: DriverTables) -> DataFrame:
    return reports.file_status_rollup(*file_status_inputs(t))

