"""Requests, answers, question trees and cascades."""

from __future__ import annotations

import asyncio
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators import evaluation as ev
from foliospark.operators import hierarchy
from foliospark.operators.scale import join_dimension, spread_evenly
from foliospark.plans.driver_tables import DriverTables
from foliospark.plans.registry import query
from foliospark.session import materialise, scratch_path
from foliospark.sources import manifests, sinks
from foliospark.streaming import attempts

ROOTS_SQL = """SELECT * FROM p_stub WHERE parent_evaluation_id IS NULL
               AND parent_evaluation_option IS NULL"""


@query(
    "apply_templates",
    """SELECT id, CASE WHEN template_id % 10 = 1 THEN 'You review pages for ' || title || '.' END
           AS system_prompt,
         CASE WHEN prompt <> '' THEN prompt
              WHEN template_id % 10 = 1 THEN 'You review pages for ' || title || '. Answer: '
                   || description || ' (' || evaluation_type || ')'
              ELSE 'Say it: ' || title END AS prompt
       FROM p_evaluations""",
)
def apply_templates(t: DriverTables) -> DataFrame:
    return ev.apply_templates(t.evaluations, t.templates).select(
        "id", "system_prompt", "prompt"
    )


def _root_requests(t: DriverTables, pages: DataFrame) -> DataFrame:
    # Written first: a join is planned with the product of its sides' sizes.
    questions = materialise(ev.apply_templates(t.evaluations, t.templates), "questions")
    tasks = ev.tasks_for_pages(pages, ev.first_level(questions), carry_text=True)
    return ev.build_requests(tasks, pages, questions)


@query(
    "evaluation_requests",
    f"""SELECT s.file_id, s.content_id, s.evaluation_id,
          CASE WHEN s.evaluation_type = 'boolean' THEN 3 ELSE 2 END AS n_messages,
          CASE WHEN s.evaluation_type = 'boolean' THEN 'boolean_answer' ELSE 'enum_answer' END
            AS tool_choice,
          'Document Page: ' || p.content || chr(10) || chr(10) || 'Metadata: '
            || CASE WHEN page_label IS NULL THEN '{{}}'
                    ELSE '{{"page_label":"' || page_label || '"}}' END AS page_message,
          CASE WHEN s.evaluation_type = 'boolean'
               THEN 'You review pages for quality. Answer: About quality (boolean)'
               ELSE 'Say it: lang' END AS user_message,
          CASE WHEN s.evaluation_type = 'boolean' THEN '' ELSE 'en,fr,de,es' END AS options
        FROM ({ROOTS_SQL}) s JOIN p_pages p ON p.id = s.content_id""",
)
def evaluation_requests(t: DriverTables) -> DataFrame:
    messages = F.col("messages")
    return _root_requests(t, t.pages).select(
        "file_id",
        "content_id",
        "evaluation_id",
        F.size(messages).alias("n_messages"),
        "tool_choice",
        F.element_at(messages, -2)["content"].alias("page_message"),
        F.element_at(messages, -1)["content"].alias("user_message"),
        F.array_join(
            F.coalesce(
                F.from_json(
                    F.get_json_object(
                        "tools", "$[0].function.parameters.properties.answer.enum"
                    ),
                    "array<string>",
                ),
                F.array().cast("array<string>"),
            ),
            ",",
        ).alias("options"),
    )


@query(
    "requests_sink",
    f"""SELECT content_id, evaluation_id,
          CASE WHEN evaluation_type = 'boolean' THEN 3 ELSE 2 END AS n_messages
        FROM ({ROOTS_SQL})""",
)
def requests_sink(t: DriverTables) -> DataFrame:
    path = scratch_path(t.spark, "requests")
    sinks.write_requests(_root_requests(t, t.pages).select("metadata", "messages", "tools"), path)
    schema = (
        "metadata STRUCT<evaluation_id: STRING, file_content_id: STRING>, "
        "messages ARRAY<STRUCT<role: STRING, content: STRING>>"
    )
    return t.spark.read.schema(schema).json(path).select(
        F.col("metadata.file_content_id").cast("long").alias("content_id"),
        F.col("metadata.evaluation_id").cast("long").alias("evaluation_id"),
        F.size("messages").alias("n_messages"),
    )


def _answered_roots(t: DriverTables) -> DataFrame:
    tasks = ev.tasks_for_pages(t.pages, ev.first_level(t.evaluations), carry_text=True)
    return ev.respond_stub(tasks, t.pages, t.evaluations)


@query("respond_stub", f"SELECT content_id, evaluation_id, response FROM ({ROOTS_SQL})")
def respond_stub(t: DriverTables) -> DataFrame:
    return _answered_roots(t).select("content_id", "evaluation_id", "response")


@query("respond_in_tasks", f"SELECT content_id, evaluation_id, response FROM ({ROOTS_SQL})")
def respond_in_tasks(t: DriverTables) -> DataFrame:
    """The same answers from a Python responder that reads the messages."""

    def responder(requests: list[dict]) -> list[str]:
        return [answer_of(request) for request in requests]

    return ev.respond(_root_requests(t, t.pages), responder).select(
        "content_id", "evaluation_id", "response"
    )


@query(
    "respond_concurrent",
    f"""SELECT content_id, evaluation_id,
          CASE WHEN content_id % 11 = 5 THEN 3 WHEN content_id % 7 = 3 THEN 2 ELSE 1 END AS attempts,
          CASE WHEN content_id % 11 = 5 THEN 'failed' ELSE 'completed' END AS status,
          CASE WHEN content_id % 11 <> 5 THEN response END AS response
        FROM ({ROOTS_SQL})""",
)
def respond_concurrent(t: DriverTables) -> DataFrame:
    """Replies come in any order, some too late or not at first; only these are asked again."""
    root = scratch_path(t.spark, "respond-concurrent")

    async def ask(request: dict) -> str:
        page, attempt = int(request["metadata"]["file_content_id"]), int(request["metadata"]["attempt"])
        if page % 11 == 5:
            raise ConnectionError("the model is away")
        if page % 7 == 3 and attempt == 0:
            await asyncio.sleep(60)
        await asyncio.sleep(0.001 * (page % 5))
        return answer_of(request)

    def work(tasks: DataFrame) -> DataFrame:
        metadata = F.struct(
            F.col("evaluation_id").cast("string").alias("evaluation_id"),
            F.col("content_id").cast("string").alias("file_content_id"),
            F.col("attempts").cast("string").alias("attempt"),
        )
        requests = tasks.withColumn("metadata", metadata)
        return ev.respond_concurrently(requests, ask, timeout=0.5).drop("metadata")

    pages = spread_evenly(t.pages)  # before they are asked, so that a text is dealt once
    asked = _root_requests(t, pages).select("content_id", "evaluation_id", "messages", "tool_choice")
    start = datetime(2024, 1, 1)
    attempts.attempt(asked, 0, root, work, now=start)
    attempts.finish_waiting(t.spark, root, 0, work, wait=lambda due: due)
    keys = ["content_id", "evaluation_id"]
    replies = t.spark.read.parquet(f"{root}/done").select(*keys, "response")
    ended = attempts.outcomes(t.spark, root, keys).drop("error")
    return ended.join(replies, keys, "left")


def answer_of(request: dict) -> str:
    """The stub's answer, from the text of the page in a request's messages."""
    page = request["messages"][-2]["content"]
    text = page[len(ev.PAGE_HEAD) : page.rindex(ev.METADATA_HEAD)]
    number = len(text) + int(request["metadata"]["evaluation_id"])
    if request["tool_choice"] == ev.BOOLEAN_TOOL:
        return "true" if number % 2 == 0 else "false"
    return ("en", "fr", "de", "es")[number % 4]


def _callbacks(t: DriverTables) -> DataFrame:
    """One JSON completion per root request, a few of them faulty by page id."""
    variant = F.col("content_id") % 11
    kind = F.when(F.col("response").isin("true", "false"), ev.BOOLEAN_TOOL).otherwise(
        ev.ENUM_TOOL
    )
    arguments = F.when(
        kind == ev.BOOLEAN_TOOL, F.concat(F.lit('{"answer":'), F.col("response"), F.lit("}"))
    ).otherwise(F.concat(F.lit('{"answer":"'), F.col("response"), F.lit('"}')))
    call = F.struct(
        F.struct(
            F.when(variant == 2, "other_tool").otherwise(kind).alias("name"),
            arguments.alias("arguments"),
        ).alias("function")
    )
    calls = F.when(variant == 1, F.array().cast(
        "array<struct<function:struct<name:string,arguments:string>>>"
    )).otherwise(F.array(call))
    body = F.struct(
        F.lit("ITEM_UPDATE").alias("event"),
        F.struct(
            F.when(variant == 3, "FAILED").otherwise("COMPLETED").alias("status"),
            F.when(variant == 3, "model error").alias("error"),
            F.struct(
                F.struct(
                    F.col("evaluation_id").cast("string").alias("evaluation_id"),
                    F.when(variant == 5, "-1")
                    .otherwise(F.col("file_id").cast("string"))
                    .alias("file_id"),
                    F.col("content_id").cast("string").alias("file_content_id"),
                ).alias("metadata")
            ).alias("request"),
            F.when(variant != 4, F.struct(F.lit("").alias("message"), calls.alias("tool_calls"))).alias(
                "response"
            ),
        ).alias("payload"),
    )
    return _answered_roots(t).select(F.to_json(body).alias("value"))


CALLBACK_SQL = f"""SELECT content_id, evaluation_id, file_id, evaluation_type,
         CASE WHEN content_id % 11 = 5 THEN 'unknown file' WHEN content_id % 11 = 4 THEN 'no response'
              WHEN content_id % 11 = 1 THEN 'no tool call' WHEN content_id % 11 = 2 THEN 'wrong tool call'
         END AS reject_reason, response,
         CASE WHEN content_id % 11 = 3 THEN 'failed' ELSE 'completed' END AS status,
         CASE WHEN content_id % 11 = 3 THEN 'model error' END AS payload_error
       FROM ({ROOTS_SQL})"""


def _parsed(t: DriverTables) -> DataFrame:
    return ev.parse_answers(ev.decode_callbacks(_callbacks(t)), t.files, t.evaluations)


@query(
    "parse_answers",
    f"""SELECT content_id, evaluation_id, response, status, payload_error
        FROM ({CALLBACK_SQL}) WHERE reject_reason IS NULL""",
)
def parse_answers(t: DriverTables) -> DataFrame:
    return _parsed(t).filter("reject_reason IS NULL").select(
        F.col("content_id").cast("long").alias("content_id"),
        F.col("evaluation_id").cast("long").alias("evaluation_id"),
        "response",
        "status",
        "payload_error",
    )


@query(
    "parse_answer_errors",
    f"""SELECT content_id, evaluation_id, reject_reason FROM ({CALLBACK_SQL})
        WHERE reject_reason IS NOT NULL""",
)
def parse_answer_errors(t: DriverTables) -> DataFrame:
    return _parsed(t).filter("reject_reason IS NOT NULL").select(
        F.col("content_id").cast("long").alias("content_id"),
        F.col("evaluation_id").cast("long").alias("evaluation_id"),
        "reject_reason",
    )


@query(
    "store_answers",
    f"""WITH usable AS (
         SELECT *, evaluation_type = 'boolean' AS flag,
           CASE WHEN evaluation_type = 'boolean' THEN response
                ELSE '\\"' || response || '\\"' END AS argument
         FROM ({CALLBACK_SQL}) WHERE reject_reason IS NULL),
       incoming AS (
         SELECT evaluation_id, content_id, response, status, payload_error AS error,
           '{{"metadata":{{"evaluation_id":"' || evaluation_id || '","file_id":"' || file_id
             || '","file_content_id":"' || content_id || '"}}}}' AS llm_request,
           '{{"message":"","tool_calls":[{{"function":{{"name":"'
             || CASE WHEN flag THEN 'boolean_answer' ELSE 'enum_answer' END
             || '","arguments":"{{\\"answer\\":' || argument || '}}"}}}}]}}' AS llm_response
         FROM usable),
       before AS (
         SELECT evaluation_id, content_id, arg_max(response, (updated_at, id)) AS response
         FROM p_answers WHERE file_id % 2 = 0 GROUP BY ALL)
       SELECT evaluation_id, content_id, coalesce(i.response, b.response) AS response,
         coalesce(i.status, 'completed') AS status, i.error, i.llm_request, i.llm_response
       FROM before b FULL JOIN incoming i USING (evaluation_id, content_id)""",
)
def store_answers(t: DriverTables) -> DataFrame:
    """From callbacks to the answers table, which holds half of the files' answers."""
    none = F.lit(None).cast("string")
    ids = ("id", "file_id", "evaluation_id", "content_id")
    existing = t.answers.filter("file_id % 2 = 0").select(
        *[F.col(c).cast("string").alias(c) for c in ids],
        "response",
        "status",
        "error",
        none.alias("llm_request"),
        none.alias("llm_response"),
        "created_at",
        "updated_at",
    )
    stored = ev.store_answers(existing, _parsed(t), F.lit("2030-01-01").cast("timestamp"))
    return stored.select(
        F.col("evaluation_id").cast("long").alias("evaluation_id"),
        F.col("content_id").cast("long").alias("content_id"),
        "response",
        "status",
        "error",
        "llm_request",
        "llm_response",
    )


@query(
    "correlate_callbacks",
    f"""SELECT content_id, evaluation_id, CASE WHEN content_id % 11 = 3 THEN 'FAILED'
          ELSE 'COMPLETED' END AS payload_status FROM ({ROOTS_SQL})""",
)
def correlate_callbacks(t: DriverTables) -> DataFrame:
    callbacks = ev.decode_callbacks(_callbacks(t)).select(
        F.col("evaluation_id").cast("long").alias("evaluation_id"),
        F.col("content_id").cast("long").alias("content_id"),
        "payload_status",
    )
    requests = ev.tasks_for_pages(t.pages, ev.first_level(t.evaluations))
    return ev.correlate(requests, callbacks).select(
        "content_id", "evaluation_id", "payload_status"
    )


@query(
    "batch_completion",
    f"""SELECT file_id, count(*) AS expected,
          count(*) FILTER (content_id % 11 NOT IN (1, 2, 4, 5)) AS finished,
          count(*) = count(*) FILTER (content_id % 11 NOT IN (1, 2, 4, 5)) AS is_complete
        FROM ({ROOTS_SQL}) GROUP BY file_id""",
)
def batch_completion(t: DriverTables) -> DataFrame:
    """Usable answers of each file against the requests sent for it."""
    requests = ev.tasks_for_pages(t.pages, ev.first_level(t.evaluations))
    expected = requests.groupBy("file_id").agg(F.count(F.lit(1)).alias("expected"))
    usable = _parsed(t).filter("reject_reason IS NULL").select(
        F.col("file_id").cast("long").alias("file_id"), "content_id", "evaluation_id"
    )
    return ev.batch_completion(
        usable.unionByName(usable), expected, ["file_id"], ["content_id", "evaluation_id"]
    )


@query(
    "next_level_tasks",
    f"""SELECT DISTINCT r.file_id, r.content_id, c.evaluation_id,
          r.evaluation_id AS parent_evaluation_id, r.response AS parent_evaluation_option
        FROM ({ROOTS_SQL}) r JOIN p_stub c ON c.content_id = r.content_id
         AND c.parent_evaluation_id = r.evaluation_id
         AND c.parent_evaluation_option = r.response""",
)
def next_level_tasks(t: DriverTables) -> DataFrame:
    """Answers written as result items, read back and turned into follow-ups."""
    item = F.struct(
        F.col("file_id").cast("string").alias("file_id"),
        F.struct(
            F.struct(
                F.col("evaluation_id").cast("string").alias("evaluation_id"),
                F.col("content_id").cast("string").alias("file_content_id"),
            ).alias("metadata")
        ).alias("llm_request"),
        F.struct(F.col("response").alias("result")).alias("store_evaluation_response"),
    )
    items = _answered_roots(t).select(F.to_json(F.array(item, item)).alias("value"))
    answers = manifests.flatten_answer_results(items).select(
        F.col("file_id").cast("long").alias("file_id"),
        F.col("content_id").cast("long").alias("content_id"),
        F.col("evaluation_id").cast("long").alias("evaluation_id"),
        "response",
    )
    owners = t.evaluations.select(F.col("id").alias("evaluation_id"), "project_id")
    owned = join_dimension(answers, owners, ["evaluation_id"], spread=["content_id"])
    return ev.next_level_tasks(owned, t.evaluations).drop("project_id")


def _new_evaluation() -> dict:
    return {
        "id": 18,
        "project_id": "src1",
        "parent_evaluation_id": 13,
        "parent_evaluation_option": "en",
    }


@query(
    "files_to_evaluate_new",
    """SELECT file_id FROM p_answers WHERE evaluation_id = 13 AND response = 'en'
       UNION SELECT id FROM p_files WHERE project_id = 'src1' AND status = 'completed'""",
)
def files_to_evaluate_new(t: DriverTables) -> DataFrame:
    return ev.files_to_evaluate(t.files, t.answers, _new_evaluation())


@query(
    "files_to_evaluate_update",
    """SELECT file_id FROM p_answers WHERE evaluation_id = 11 AND response = 'true'
       UNION SELECT file_id FROM p_answers WHERE evaluation_id = 12""",
)
def files_to_evaluate_update(t: DriverTables) -> DataFrame:
    """The option of question 12 changes from true to false."""
    old = {
        "id": 12,
        "project_id": "src1",
        "parent_evaluation_id": 11,
        "parent_evaluation_option": "true",
    }
    return ev.files_to_evaluate(
        t.files, t.answers, {**old, "parent_evaluation_option": "false"}, old
    )


TREE_SQL = """WITH RECURSIVE tree AS (
         SELECT id, project_id, title, 0 AS depth, id AS root_id, CAST(id AS VARCHAR) AS path
         FROM p_evaluations WHERE parent_evaluation_id IS NULL
         UNION ALL
         SELECT e.id, e.project_id, e.title, t.depth + 1, t.root_id, t.path || '/' || e.id
         FROM p_evaluations e JOIN tree t ON e.parent_evaluation_id = t.id)"""


@query("evaluation_tree", TREE_SQL + " SELECT * FROM tree")
def evaluation_tree(t: DriverTables) -> DataFrame:
    tree = hierarchy.evaluation_tree(t.evaluations)
    path = F.array_join(F.transform("path", lambda i: i.cast("string")), "/")
    return tree.select("id", "project_id", "title", "depth", "root_id", path.alias("path"))


CASCADE_SQL = """WITH RECURSIVE walk AS (
         SELECT file_id, content_id, evaluation_id, response, 0 AS level FROM p_stub
         WHERE {start}
         UNION ALL
         SELECT c.file_id, c.content_id, c.evaluation_id, c.response, w.level + 1
         FROM walk w JOIN p_stub c ON c.content_id = w.content_id
          AND c.parent_evaluation_id = w.evaluation_id
          AND (c.parent_evaluation_option = w.response {any_option}))
       SELECT * FROM walk"""


@query(
    "cascade_answers",
    CASCADE_SQL.format(
        start="parent_evaluation_id IS NULL AND parent_evaluation_option IS NULL",
        any_option="",
    ),
)
def cascade_answers(t: DriverTables) -> DataFrame:
    return ev.evaluate_pages(t.pages, t.evaluations, _stub(t)).select(
        "file_id", "content_id", "evaluation_id", "response", "level"
    )


def _stub(t: DriverTables):
    return lambda tasks: ev.respond_stub(tasks, t.pages, t.evaluations)


@query(
    "cascade_any_option",
    CASCADE_SQL.format(
        start="parent_evaluation_id IS NULL AND parent_evaluation_option IS NULL",
        any_option="OR c.parent_evaluation_option IS NULL",
    ),
)
def cascade_any_option(t: DriverTables) -> DataFrame:
    return ev.evaluate_pages(t.pages, t.evaluations, _stub(t), any_option=True).select(
        "file_id", "content_id", "evaluation_id", "response", "level"
    )


@query(
    "update_cascade",
    CASCADE_SQL.format(
        start="evaluation_id = 13 AND file_id IN (SELECT file_id FROM p_answers "
        "WHERE evaluation_id = 13)",
        any_option="",
    ),
)
def update_cascade(t: DriverTables) -> DataFrame:
    """Question 13 is asked again of the files that have an answer to it."""
    files = t.answers.filter(F.col("evaluation_id") == 13).select("file_id")
    return ev.update_cascade(t.pages, files, 13, t.evaluations, _stub(t)).select(
        "file_id", "content_id", "evaluation_id", "response", "level"
    )


def _parents_changed(t: DriverTables, kind: int, parent, option=None) -> DataFrame:
    """Evaluations in which question ``kind`` of each project hangs elsewhere."""
    here = F.col("id") % 10 == kind
    changed = t.evaluations.withColumn(
        "parent_evaluation_id", F.when(here, parent).otherwise(F.col("parent_evaluation_id"))
    )
    if option is None:
        return changed
    return changed.withColumn(
        "parent_evaluation_option",
        F.when(here, F.lit(option)).otherwise(F.col("parent_evaluation_option")),
    )


@query(
    "update_cascade_orphan",
    CASCADE_SQL.format(start="evaluation_id = 12", any_option=""),
)
def update_cascade_orphan(t: DriverTables) -> DataFrame:
    """Question 12 hangs on an evaluation that is gone; its follow-ups are asked."""
    orphans = _parents_changed(t, 2, F.lit(-1).cast("long"))
    files = t.files.select(F.col("id").alias("file_id"))
    stub = lambda tasks: ev.respond_stub(tasks, t.pages, orphans)
    return ev.update_cascade(t.pages, files, 12, orphans, stub).select(
        "file_id", "content_id", "evaluation_id", "response", "level"
    )


@query(
    "cascade_cycle",
    """WITH RECURSIVE ring AS (
         SELECT file_id, content_id, evaluation_id, response,
           CASE WHEN evaluation_id % 10 = 1 THEN evaluation_id + 1
                ELSE parent_evaluation_id END AS parent_id,
           CASE WHEN evaluation_id % 10 = 1 THEN 'false'
                ELSE parent_evaluation_option END AS option
         FROM p_stub),
       walk AS (
         SELECT file_id, content_id, evaluation_id, response FROM ring WHERE evaluation_id = 11
         UNION
         SELECT c.file_id, c.content_id, c.evaluation_id, c.response
         FROM walk w JOIN ring c ON c.content_id = w.content_id
          AND c.parent_id = w.evaluation_id AND c.option = w.response)
       SELECT * FROM walk""",
)
def cascade_cycle(t: DriverTables) -> DataFrame:
    """Questions 11 and 12 fire each other; each is asked of a page once."""
    ring = _parents_changed(t, 1, F.col("id") + 1, "false")
    files = t.files.select(F.col("id").alias("file_id"))
    stub = lambda tasks: ev.respond_stub(tasks, t.pages, ring)
    return ev.update_cascade(t.pages, files, 11, ring, stub).select(
        "file_id", "content_id", "evaluation_id", "response"
    )


@query(
    "reevaluate_changed",
    CASCADE_SQL.format(
        start="""evaluation_id = 12 AND file_id IN (
           SELECT file_id FROM p_answers WHERE evaluation_id = 11 AND response = 'true'
           UNION SELECT file_id FROM p_answers WHERE evaluation_id = 12)""",
        any_option="",
    ),
)
def reevaluate_changed(t: DriverTables) -> DataFrame:
    """The option of question 12 changes from true to false: it is asked again."""
    old = {
        "id": 12,
        "project_id": "src1",
        "parent_evaluation_id": 11,
        "parent_evaluation_option": "true",
    }
    new = {**old, "parent_evaluation_option": "false"}
    evaluations = _parents_changed(t, 2, F.col("parent_evaluation_id"), "false")
    return ev.reevaluate_changed(
        t.pages, t.files, t.answers, new, evaluations, _stub(t), old
    ).select("file_id", "content_id", "evaluation_id", "response", "level")


@query(
    "answer_edges",
    """SELECT DISTINCT c.content_id, e.parent_evaluation_id, c.evaluation_id
       FROM p_answers c JOIN p_evaluations e ON e.id = c.evaluation_id
       JOIN p_answers p ON p.content_id = c.content_id
        AND p.evaluation_id = e.parent_evaluation_id""",
)
def answer_edges(t: DriverTables) -> DataFrame:
    return hierarchy.answer_edges(t.answers, t.evaluations)


@query(
    "answer_roots",
    """SELECT DISTINCT content_id, evaluation_id FROM p_answers a WHERE NOT EXISTS (
         SELECT 1 FROM p_evaluations e JOIN p_answers p ON p.evaluation_id = e.parent_evaluation_id
         WHERE e.id = a.evaluation_id AND p.content_id = a.content_id)""",
)
def answer_roots(t: DriverTables) -> DataFrame:
    return hierarchy.answer_roots(t.answers, t.evaluations)


@query(
    "answer_trees",
    """WITH RECURSIVE nodes AS (SELECT DISTINCT content_id, evaluation_id FROM p_stub
                                WHERE response <> 'false'),
       climb AS (
         SELECT content_id, evaluation_id, evaluation_id AS root_evaluation_id, 0 AS depth FROM nodes
         UNION ALL
         SELECT c.content_id, c.evaluation_id, e.parent_evaluation_id, c.depth + 1
         FROM climb c JOIN p_evaluations e ON e.id = c.root_evaluation_id
         JOIN nodes n ON n.content_id = c.content_id AND n.evaluation_id = e.parent_evaluation_id)
       SELECT * FROM climb
       QUALIFY row_number() OVER (PARTITION BY content_id, evaluation_id ORDER BY depth DESC) = 1""",
)
def answer_trees(t: DriverTables) -> DataFrame:
    """Trees among all answers but the false ones, whose absence parts chains."""
    tasks = ev.tasks_for_pages(t.pages, t.evaluations, carry_text=True)
    answers = ev.respond_stub(tasks, t.pages, t.evaluations).filter("response <> 'false'")
    return hierarchy.answer_trees(answers, hierarchy.evaluation_tree(t.evaluations))
