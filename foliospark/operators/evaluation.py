"""Asking pages a tree of questions and storing the answers."""

from __future__ import annotations

import asyncio
from collections.abc import Awaitable, Callable, Iterator
from queue import SimpleQueue
from threading import Event, Thread

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.templates import render
from foliospark.functions.text import is_blank, percent_encode, stable_id
from foliospark.operators.maintenance import upsert_answers
from foliospark.operators.scale import join_by_key, join_dimension
from foliospark.schemas import COMPLETION_CALLBACK
from foliospark.session import materialise

# --- fixed values: tool names and texts the answering model is given ----------
BOOLEAN_TOOL = "boolean_answer"
BOOLEAN_TOOL_DESCRIPTION = "Answer a boolean question"
ENUM_TOOL = "enum_answer"
ENUM_TOOL_DESCRIPTION = "Answer an enum question"
ANSWER_DESCRIPTION = "The answer to the question"
PAGE_HEAD = "Document Page: "
METADATA_HEAD = "\n\nMetadata: "
# ------------------------------------------------------------------------------

Responder = Callable[[list[dict]], list[str | None]]

PROMPT_FIELDS = (
    "id",
    "title",
    "description",
    "system_prompt",
    "prompt",
    "project_id",
    "evaluation_type",
    "parent_evaluation_id",
    "parent_evaluation_option",
    "category_id",
    "template_id",
)


def apply_templates(evaluations: DataFrame, templates: DataFrame) -> DataFrame:
    """Fill empty prompts from the evaluation's template.

    The system prompt comes first, so the prompt's template may refer to it.
    """
    texts = templates.select(
        F.col("id").alias("template_id"),
        F.col("system_prompt").alias("_system_template"),
        F.col("prompt").alias("_prompt_template"),
    )
    joined = join_dimension(evaluations, texts, ["template_id"], "left", ["id"])

    def values() -> dict[str, Column]:
        fields = {name: F.col(name) for name in PROMPT_FIELDS}
        fields["evaluation_options"] = F.to_json("evaluation_options")
        return fields

    def filled(name: str, template: str) -> Column:
        usable = is_blank(F.col(name)) & F.col(template).isNotNull()
        return F.when(usable, render(F.col(template), values())).otherwise(F.col(name))

    return (
        joined.withColumn("system_prompt", filled("system_prompt", "_system_template"))
        .withColumn("prompt", filled("prompt", "_prompt_template"))
        .select(*evaluations.columns)
    )


def first_level(evaluations: DataFrame) -> DataFrame:
    """K9: questions asked of every page: no parent and no option."""
    return evaluations.filter(
        F.col("parent_evaluation_id").isNull()
        & F.col("parent_evaluation_option").isNull()
    )


PAGE_TEXT = ("content", "content_metadata")


def tasks_for_pages(
    pages: DataFrame, evaluations: DataFrame, carry_text: bool = False
) -> DataFrame:
    """(page, evaluation) pairs of the same project.

    ``pages`` has (id, file_id, project_id). A join on the project, whose few
    keys are very uneven: the questions are broadcast, or the pages salted.
    With ``carry_text`` the page text comes along, and answering the tasks
    needs no further join.
    """
    questions = evaluations.select("project_id", F.col("id").alias("evaluation_id"))
    text = [c for c in PAGE_TEXT if carry_text and c in pages.columns]
    heads = pages.select("project_id", "file_id", F.col("id").alias("content_id"), *text)
    return join_dimension(heads, questions, ["project_id"], spread=["content_id"])


def with_page_text(tasks: DataFrame, pages: DataFrame, *columns: str) -> DataFrame:
    """Tasks with these page columns, joined by page unless carried already.

    Few tasks, as on the lower levels of a cascade, are broadcast to the scan of
    the pages, so that no text is shuffled for them.
    """
    if all(c in tasks.columns for c in columns):
        return tasks
    texts = pages.select(F.col("id").alias("content_id"), *columns)
    return join_by_key(texts, tasks.drop(*columns), ["content_id"])


def next_level_tasks(
    answers: DataFrame, evaluations: DataFrame, any_option: bool = False
) -> DataFrame:
    """Follow-up questions on the page that was answered.

    A child fires when its option equals the answer. With ``any_option`` a
    child without an option fires on every answer. Keys stay separate columns:
    answers may contain any separator.
    """
    done = answers.select(
        "project_id",
        "file_id",
        "content_id",
        F.col("evaluation_id").alias("parent_evaluation_id"),
        "response",
    ).distinct()
    children = evaluations.filter(F.col("parent_evaluation_id").isNotNull()).select(
        "project_id",
        "parent_evaluation_id",
        F.col("parent_evaluation_option").alias("_option"),
        F.col("id").alias("evaluation_id"),
    )
    joined = join_dimension(
        done, children, ["project_id", "parent_evaluation_id"], spread=["content_id"]
    )
    fires = F.col("_option") == F.col("response")
    if any_option:
        fires = fires | F.col("_option").isNull()
    return joined.filter(fires).select(
        "project_id",
        "file_id",
        "content_id",
        "evaluation_id",
        "parent_evaluation_id",
        F.col("response").alias("parent_evaluation_option"),
    )


def build_requests(
    tasks: DataFrame, pages: DataFrame, evaluations: DataFrame, workflow_prefix: str = ""
) -> DataFrame:
    """The model request of each task.

    Messages: the evaluation's system prompt if any, the page with its metadata
    as JSON, then the question. ``tasks`` may carry the parent columns.
    """
    for name in ("parent_evaluation_id", "parent_evaluation_option"):
        if name not in tasks.columns:
            tasks = tasks.withColumn(name, F.lit(None).cast("string"))
    questions = evaluations.select(
        F.col("id").alias("evaluation_id"),
        "system_prompt",
        "prompt",
        "evaluation_type",
        "evaluation_options",
    )
    asked = join_dimension(
        with_page_text(tasks, pages, *PAGE_TEXT),
        questions,
        ["evaluation_id"],
        spread=["content_id"],
    )

    def message(role: str, text: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), text.alias("content"))

    page_text = F.concat(
        F.lit(PAGE_HEAD),
        F.col("content"),
        F.lit(METADATA_HEAD),
        F.to_json("content_metadata"),
    )
    messages = F.filter(
        F.array(
            F.when(
                ~is_blank(F.col("system_prompt")),
                message("system", F.col("system_prompt")),
            ),
            message("system", page_text),
            message("user", F.col("prompt")),
        ),
        lambda m: m.isNotNull(),
    )
    kind = F.col("evaluation_type")
    tool = F.when(kind == "boolean", F.lit(BOOLEAN_TOOL)).when(
        kind == "enum_choice", F.lit(ENUM_TOOL)
    )
    return asked.select(
        "project_id",
        "file_id",
        "content_id",
        "evaluation_id",
        "parent_evaluation_id",
        "parent_evaluation_option",
        "evaluation_type",
        "evaluation_options",
        messages.alias("messages"),
        F.struct(
            F.col("evaluation_id").cast("string").alias("evaluation_id"),
            F.col("file_id").cast("string").alias("file_id"),
            F.col("content_id").cast("string").alias("file_content_id"),
            F.col("content_metadata").alias("page_metadata"),
            F.concat(F.lit(workflow_prefix), F.col("file_id")).alias("workflow_id"),
            F.col("parent_evaluation_id").cast("string").alias("parent_evaluation_id"),
            F.col("parent_evaluation_option"),
        ).alias("metadata"),
        tool_schema(kind, F.col("evaluation_options")).alias("tools"),
        tool.alias("tool_choice"),
    )


def tool_schema(kind: Column, options: Column) -> Column:
    """The answer tool of a boolean or choice question; NULL for free text."""

    def tool(name: str, description: str, answer: Column) -> Column:
        return F.to_json(
            F.array(
                F.struct(
                    F.lit("function").alias("type"),
                    F.struct(
                        F.lit(name).alias("name"),
                        F.lit(description).alias("description"),
                        F.struct(
                            F.lit("object").alias("type"),
                            F.struct(answer.alias("answer")).alias("properties"),
                            F.array(F.lit("answer")).alias("required"),
                        ).alias("parameters"),
                    ).alias("function"),
                )
            )
        )

    boolean = F.struct(
        F.lit("boolean").alias("type"), F.lit(ANSWER_DESCRIPTION).alias("description")
    )
    choice = F.struct(
        F.lit("string").alias("type"),
        F.lit(ANSWER_DESCRIPTION).alias("description"),
        options.alias("enum"),
    )
    return F.when(
        kind == "boolean", tool(BOOLEAN_TOOL, BOOLEAN_TOOL_DESCRIPTION, boolean)
    ).when(kind == "enum_choice", tool(ENUM_TOOL, ENUM_TOOL_DESCRIPTION, choice))


def callback_url(base: str, token: Column, parameter: str = "taskToken") -> Column:
    """Completion address with the percent-encoded correlation token."""
    return F.concat(F.lit(f"{base}?{parameter}="), percent_encode(token))


def respond(requests: DataFrame, responder: Responder) -> DataFrame:
    """Call a model in the tasks, one Arrow batch of requests at a time.

    ``responder`` gets dicts with messages and tool_choice and returns one
    answer text per request. For remote models prefer writing the requests
    and reading the completions as a source: retried tasks ask again.
    """
    schema = requests.withColumn("response", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.select(["messages", "tool_choice", "metadata"]).to_pylist()
            replies = responder(asked)
            if len(replies) != len(asked):
                raise ValueError("the responder must return one answer per request")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(replies, type=pa.string())],
                names=[*batch.schema.names, "response"],
            )

    return requests.mapInArrow(run, schema)


AskOne = Callable[[dict], Awaitable[str | None]]

# --- fixed values: concurrency of the queue consumer ----------------------------
WINDOW = 100
# --------------------------------------------------------------------------------
BATCHES_AT_ONCE = 2  # Arrow batches of a task that are asked at the same time
GATHER_SECONDS = 0.25


def python_values(array: pa.Array) -> list:
    """``array.to_pylist()``, column by column: a fraction of its time for nested texts."""
    kind = array.type
    if pa.types.is_string(kind):
        return array.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_struct(kind) and kind.num_fields:
        names = [field.name for field in kind]
        rows = [dict(zip(names, row)) for row in zip(*map(python_values, array.flatten()))]
    elif pa.types.is_list(kind):
        items, rows, start = python_values(array.flatten()), [], 0
        for length in pc.fill_null(pc.list_value_length(array), 0).to_pylist():
            rows.append(items[start : start + length])
            start += length
    else:
        return array.to_pylist()
    for row in pc.indices_nonzero(array.is_null()).to_pylist() if array.null_count else ():
        rows[row] = None
    return rows


def respond_concurrently(
    requests: DataFrame, ask: AskOne, window: int = WINDOW, timeout: float = 300.0
) -> DataFrame:
    """Ask a model with up to ``window`` requests of a task in the air.

    ``ask`` is a coroutine function from a request (messages, tool_choice, metadata) to
    its answer. A new request starts as soon as any other is answered, also one of the next
    batch of rows; two batches are held at most. One that raises or takes longer than
    ``timeout`` seconds fails alone: its ``error`` says why. Rows come out as they are
    answered, with ``response`` and ``error``. As the work of
    :func:`foliospark.streaming.attempts.attempt`, answers are stored batch by batch and
    only failed requests are asked again.
    """
    if window < 1:
        raise ValueError("window is at least 1")
    schema = requests.select(
        "*", F.lit(None).cast("string").alias("response"), F.lit(None).cast("string").alias("error")
    ).schema

    async def answer(request: dict) -> tuple[str | None, str | None]:
        try:
            return await asyncio.wait_for(ask(request), timeout), None
        except asyncio.TimeoutError:
            return None, f"no answer within {timeout:g} s"
        except (Exception, asyncio.CancelledError) as fault:
            return None, f"{type(fault).__name__}: {fault}"

    def rows_of(batch: pa.RecordBatch, answered: list[tuple]) -> pa.RecordBatch:
        at, responses, errors = zip(*answered)
        return pa.RecordBatch.from_arrays(
            [
                *batch.take(pa.array(at)).columns,
                pa.array(responses, pa.string()),
                pa.array(errors, pa.string()),
            ],
            names=[*batch.schema.names, "response", "error"],
        )

    async def ask_all(
        asked: asyncio.Queue, due: dict[int, int], answered: SimpleQueue, ended: Event
    ) -> None:
        async def ask_on() -> None:  # one of the window: always the next request open
            while (item := await asked.get()) is not None:
                number, row, request = item
                answered.put((number, (row, *await answer(request))))
                due[number] -= 1
                if not due[number]:
                    del due[number]
                    ended.set()

        await asyncio.gather(*(ask_on() for _ in range(window)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Requests go on in a thread of their own while Spark takes the rows.
        loop = asyncio.new_event_loop()
        thread = Thread(target=loop.run_forever, daemon=True)
        thread.start()
        asked, answered, ended = asyncio.Queue(), SimpleQueue(), Event()
        due: dict[int, int] = {}  # of that thread: answers due of each batch
        asking = asyncio.run_coroutine_threadsafe(ask_all(asked, due, answered, ended), loop)

        def put(items: list) -> None:
            for item in items:
                if item is not None:
                    due[item[0]] = due.get(item[0], 0) + 1
                asked.put_nowait(item)

        held: dict[int, pa.RecordBatch] = {}  # batches with answers still due
        left: dict[int, int] = {}
        numbered = enumerate(batches)
        more = True
        try:
            while more or held:
                # The next batch is asked while the last answers of one are waited for.
                if more and len(held) < BATCHES_AT_ONCE:
                    number, batch = next(numbered, (None, None))
                    more = batch is not None
                    if more and batch.num_rows:
                        held[number], left[number] = batch, batch.num_rows
                        requested = batch.select(["messages", "tool_choice", "metadata"])
                        items = enumerate(python_values(requested.to_struct_array()))
                        loop.call_soon_threadsafe(put, [(number, *item) for item in items])
                    continue
                first = answered.get()
                # Few batches of rows, not one for each answer; the end of a batch is not
                # waited for, as the next one is asked then.
                ended.wait(GATHER_SECONDS)
                ended.clear()
                parts = {first[0]: [first[1]]}
                while not answered.empty():
                    number, reply = answered.get()
                    parts.setdefault(number, []).append(reply)
                for number, part in parts.items():
                    yield rows_of(held[number], part)
                    left[number] -= len(part)
                    if not left[number]:
                        del held[number], left[number]
            loop.call_soon_threadsafe(put, [None] * window)
            asking.result()
        finally:
            loop.call_soon_threadsafe(loop.stop)
            thread.join()
            loop.close()

    return requests.mapInArrow(run, schema)


def stub_answer(content: Column, evaluation: Column, kind: Column, options: Column) -> Column:
    """Deterministic stand-in for a model, from page length and evaluation id."""
    number = F.length(content) + evaluation
    return (
        F.when(
            kind == "boolean",
            F.when(F.pmod(number, F.lit(2)) == 0, "true").otherwise("false"),
        )
        .when(
            kind == "enum_choice",
            F.get(options, F.pmod(number, F.size(options)).cast("int")),
        )
        .otherwise(F.regexp_extract(content, r"[^ \t\n\r\f]+", 0))
    )


def respond_stub(tasks: DataFrame, pages: DataFrame, evaluations: DataFrame) -> DataFrame:
    """K11 with :func:`stub_answer`: tasks with an added ``response``."""
    questions = evaluations.select(
        F.col("id").alias("evaluation_id"), "evaluation_type", "evaluation_options"
    )
    joined = join_dimension(
        with_page_text(tasks, pages, "content"),
        questions,
        ["evaluation_id"],
        spread=["content_id"],
    )
    answer = stub_answer(
        F.col("content"),
        F.col("evaluation_id"),
        F.col("evaluation_type"),
        F.col("evaluation_options"),
    )
    return joined.select(*tasks.columns, answer.alias("response"))


def decode_callbacks(raw: DataFrame, column: str = "value") -> DataFrame:
    """Completion callbacks from JSON text, keyed by page and evaluation.

    What the model was asked and what it said are kept as the JSON they came in.
    """
    body = F.from_json(column, COMPLETION_CALLBACK)
    return raw.select(
        *[c for c in raw.columns if c != column],
        body.alias("_c"),
        F.get_json_object(column, "$.payload.request").alias("llm_request"),
        F.get_json_object(column, "$.payload.response").alias("llm_response"),
    ).select(
        *[c for c in raw.columns if c != column],
        F.col("_c.payload.request.metadata.file_id").alias("file_id"),
        F.col("_c.payload.request.metadata.evaluation_id").alias("evaluation_id"),
        F.col("_c.payload.request.metadata.file_content_id").alias("content_id"),
        F.col("_c.payload.status").alias("payload_status"),
        F.col("_c.payload.error").alias("payload_error"),
        F.col("_c.payload.request").isNotNull().alias("has_request"),
        F.col("_c.payload.response").alias("completion"),
        "llm_request",
        "llm_response",
    )


def parse_answers(callbacks: DataFrame, files: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Answers by evaluation type, or the reason to reject.

    ``response`` is NULL exactly where ``reject_reason`` is set. Whether a
    choice is among the options is reported, not enforced.
    """
    known_files = files.select(
        F.col("id").cast("string").alias("file_id"), F.lit(True).alias("_file")
    )
    questions = evaluations.select(
        F.col("id").cast("string").alias("evaluation_id"),
        "evaluation_type",
        "evaluation_options",
    )
    joined = join_by_key(callbacks, known_files, ["file_id"], "left")
    joined = join_dimension(joined, questions, ["evaluation_id"], "left", ["content_id"])
    kind = F.col("evaluation_type")
    call = F.get("completion.tool_calls", F.lit(0))["function"]
    by_tool = kind.isin("boolean", "enum_choice")
    expected = F.when(kind == "boolean", BOOLEAN_TOOL).otherwise(ENUM_TOOL)
    raw = F.get_json_object(call["arguments"], "$.answer")
    response = F.when(by_tool, F.when(kind == "boolean", F.lower(raw)).otherwise(raw)).otherwise(
        F.col("completion.message")
    )
    reason = (
        F.when(F.col("_file").isNull(), "unknown file")
        .when(kind.isNull(), "unknown evaluation")
        .when(F.col("completion").isNull(), "no response")
        .when(by_tool & call.isNull(), "no tool call")
        .when(by_tool & ~call["name"].eqNullSafe(expected), "wrong tool call")
        .when(by_tool & is_blank(call["arguments"]), "no arguments")
        .when(response.isNull(), "no answer")
    )
    return joined.select(
        *[c for c in callbacks.columns if c not in ("completion", "has_request")],
        "evaluation_type",
        reason.alias("reject_reason"),
        F.when(reason.isNull(), response).alias("response"),
        F.when(F.col("payload_status") == "COMPLETED", "completed")
        .otherwise("failed")
        .alias("status"),
        F.when(
            reason.isNull() & (kind == "enum_choice"),
            F.array_contains("evaluation_options", response),
        ).alias("is_listed_option"),
    )


def files_to_evaluate(
    files: DataFrame, answers: DataFrame, evaluation: dict, old_evaluation: dict | None = None
) -> DataFrame:
    """Files a created or changed evaluation must be asked of.

    Files whose parent answer is the option (the old option if it was changed),
    and files already answered (update) or all completed files (creation).
    """
    own = files.filter(F.col("project_id") == F.lit(evaluation["project_id"])).select(
        F.col("id").alias("file_id"), "status"
    )

    def answered(evaluation_id: object, response: str | None = None) -> DataFrame:
        rows = answers.filter(F.col("evaluation_id") == F.lit(evaluation_id))
        if response:
            rows = rows.filter(F.col("response") == F.lit(response))
        ids = rows.select("file_id").distinct()
        return ids.join(own.select("file_id"), "file_id", "left_semi")

    option = evaluation.get("parent_evaluation_option")
    asked_option = option
    if old_evaluation and old_evaluation.get("parent_evaluation_option") != option:
        asked_option = old_evaluation.get("parent_evaluation_option")
    parts = []
    if evaluation.get("parent_evaluation_id") is not None and option:
        parts.append(answered(evaluation["parent_evaluation_id"], asked_option))
    if old_evaluation:
        parts.append(answered(evaluation["id"]))
    else:
        parts.append(own.filter(F.col("status") == "completed").select("file_id"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.distinct()


AnswerStep = Callable[[DataFrame], DataFrame]


def cascade(
    start: DataFrame,
    evaluations: DataFrame,
    answer: AnswerStep,
    any_option: bool = False,
) -> DataFrame:
    """Answer the start tasks, then their follow-ups, level by level.

    ``answer`` adds a ``response`` to tasks. No question is asked twice of a page:
    what was answered on an earlier level is left out of the next one's tasks, so
    that a cycle ends by itself. The walk ends with the first level without tasks,
    however deep the questions hang below each other.
    """
    columns = ["project_id", "file_id", "content_id", "evaluation_id", "response"]
    result, level, tasks = None, 0, start
    while True:
        answered = materialise(
            answer(tasks).select(*columns).withColumn("level", F.lit(level)),
            f"answers-level-{level}",
        )
        result = answered if result is None else result.unionByName(answered)
        done = result.select("evaluation_id", "content_id")
        following = next_level_tasks(answered, evaluations, any_option).join(
            done, ["evaluation_id", "content_id"], "left_anti"
        )
        tasks = materialise(following, f"tasks-level-{level + 1}")
        if tasks.isEmpty():
            return result
        level += 1


def evaluate_pages(
    pages: DataFrame, evaluations: DataFrame, answer: AnswerStep, any_option: bool = False
) -> DataFrame:
    """H2 from the roots: every page of the input."""
    start = tasks_for_pages(pages, first_level(evaluations), carry_text=True)
    return cascade(start, evaluations, answer, any_option)


def update_cascade(
    pages: DataFrame,
    files: DataFrame,
    evaluation_id: object,
    evaluations: DataFrame,
    answer: AnswerStep,
    any_option: bool = False,
) -> DataFrame:
    """H4: ask one evaluation of all pages of the given files, then its children."""
    one = evaluations.filter(F.col("id") == F.lit(evaluation_id))
    scope = join_by_key(
        pages, files.select("file_id").distinct(), ["file_id"], "left_semi"
    )
    start = tasks_for_pages(scope, one, carry_text=True)
    return cascade(start, evaluations, answer, any_option)


def reevaluate_changed(
    pages: DataFrame,
    files: DataFrame,
    answers: DataFrame,
    evaluation: dict,
    evaluations: DataFrame,
    answer: AnswerStep,
    old_evaluation: dict | None = None,
    any_option: bool = False,
) -> DataFrame:
    """What a created or changed evaluation must be asked of, and its follow-ups.

    ``evaluations`` already holds the evaluation as it is now.
    """
    wanted = files_to_evaluate(files, answers, evaluation, old_evaluation)
    return update_cascade(
        pages, wanted, evaluation["id"], evaluations, answer, any_option
    )


def answer_rows(answered: DataFrame, status: str = "completed") -> DataFrame:
    """Answers in the shape of the answers table, with stable ids."""
    return answered.select(
        stable_id(F.col("evaluation_id"), F.col("content_id")).alias("id"),
        "file_id",
        "evaluation_id",
        "content_id",
        "response",
        F.lit(status).alias("status"),
    )


def store_answers(existing: DataFrame, parsed: DataFrame, at: Column) -> DataFrame:
    """The answers table after the usable answers of :func:`parse_answers`.

    Every row keeps the model's request, response and error. ``existing`` has the
    columns of the table, ``at`` is the time of the answers. Rejected callbacks are
    reported by ``parse_answers`` and change nothing.
    """
    usable = parsed.filter(F.col("reject_reason").isNull())
    rows = usable.select(
        stable_id(F.col("evaluation_id"), F.col("content_id")).alias("id"),
        "file_id",
        "evaluation_id",
        "content_id",
        "response",
        "status",
        F.col("payload_error").alias("error"),
        "llm_request",
        "llm_response",
        at.alias("created_at"),
        at.alias("updated_at"),
    )
    return upsert_answers(existing, rows.select(existing.columns))


def correlate(requests: DataFrame, callbacks: DataFrame) -> DataFrame:
    """Each request with its completion, by evaluation and page.

    Works for two tables, a stream against the table of requests, or two
    streams with watermarks.
    """
    return requests.join(callbacks, ["evaluation_id", "content_id"])


def batch_completion(
    items: DataFrame, expected: DataFrame, batch: list[str], item: list[str]
) -> DataFrame:
    """Finished items of each batch against the number submitted.

    A redelivered item counts once. Counting distinct items is two aggregations
    with map-side combining, also for a batch with most of the items.
    """
    finished = (
        items.select(*batch, *item)
        .distinct()
        .groupBy(*batch)
        .agg(F.count(F.lit(1)).alias("finished"))
    )
    return expected.join(finished, batch, "left").select(
        *batch,
        "expected",
        F.coalesce("finished", F.lit(0)).alias("finished"),
        (F.coalesce("finished", F.lit(0)) == F.col("expected")).alias("is_complete"),
    )
