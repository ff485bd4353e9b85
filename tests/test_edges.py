"""Hand-made rows for the cases where reading the rules decides the result."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.functions.templates import render
from foliospark.operators import evaluation as ev
from foliospark.operators import hierarchy, maintenance, reads, reports, search
from foliospark.operators.filters import Condition, Group, files_matching, nest_answers, search_files
from foliospark.operators.search import SearchRequest
from foliospark.sources import landing, loaders

CHUNKS = "id long, file_id long, content_id long, chunk_number int, project_id string, embedding array<float>"
QUERY = [1.0, 0.0]


def vector(score):
    return [score, (1 - score * score) ** 0.5]


def chunk(ident, score, number=None, file_id=1, project="p", content=None):
    return (
        ident, file_id, content or 100 + ident, number or ident, project,
        None if score is None else vector(score),
    )


def values(spark, column):
    """The column over a single empty row."""
    return spark.range(1).select(column.alias("v")).head()[0]


# --- similarity ---------------------------------------------------------------


def test_limit_applies_after_the_project_filter(spark):
    rows = [chunk(i, 0.9, project="other") for i in range(1, 6)]
    rows += [chunk(i, 0.5 - i / 100, project="mine") for i in range(6, 9)]
    hits = search.similarity_hits(
        spark.createDataFrame(rows, CHUNKS), "mine", SearchRequest(QUERY, limit=2)
    )
    assert [r.chunk_id for r in hits.collect()] == [6, 7]


def test_threshold_is_strict_and_none_keeps_all(spark):
    rows = [(1, 1, 1, 1, "p", [0.0, 1.0]), (2, 1, 1, 2, "p", [1.0, 0.0]),
            (3, 1, 1, 3, "p", [-1.0, 0.0]), (4, 1, 1, 4, "p", None)]
    chunks = spark.createDataFrame(rows, CHUNKS)

    def found(threshold):
        request = SearchRequest(QUERY, score_threshold=threshold)
        return [r.chunk_id for r in search.similarity_hits(chunks, None, request).collect()]

    assert found(0.0) == [2]
    assert found(1.0) == []
    assert found(None) == [2, 1, 3]


def test_file_filter(spark):
    chunks = spark.createDataFrame([chunk(1, 0.5), chunk(2, 0.4, file_id=2)], CHUNKS)
    request = SearchRequest(QUERY, file_ids=(2,))
    assert [r.chunk_id for r in search.similarity_hits(chunks, None, request).collect()] == [2]


def test_wrong_dimension_is_an_error(spark):
    chunks = spark.createDataFrame([chunk(1, 0.5)], CHUNKS)
    with pytest.raises(Exception, match="3 dimensions"):
        search.similarity_hits(chunks, None, SearchRequest([1.0, 0.0, 0.0])).collect()


def test_neighbors_are_a_value_range(spark):
    rows = [chunk(n, 0.8 if n == 2 else 0.1) for n in (1, 2, 5, 6)]
    request = SearchRequest(QUERY, 1, 0.5, before_neighbor_count=1, after_neighbor_count=1)
    found = search.similarity_chunks(spark.createDataFrame(rows, CHUNKS), None, request)
    assert [(r.chunk_id, round(r.score, 6), r.is_neighbor, r.neighbor_from) for r in found.collect()] == [
        (2, 0.8, False, None), (1, 0.0, True, 2)
    ]


@pytest.mark.parametrize("order_by", ["score", "chunk"])
def test_adjacent_hits_keep_both_roles(spark, order_by):
    scores = {3: 0.9, 4: 0.7}
    chunks = spark.createDataFrame([chunk(n, scores.get(n, 0.1)) for n in range(1, 7)], CHUNKS)
    request = SearchRequest(
        QUERY, 2, 0.5, before_neighbor_count=1, after_neighbor_count=1, order_by=order_by
    )
    rows = search.similarity_chunks(chunks, None, request)
    nested = {r.hit_id: r for r in search.nest_chunk_neighbors(rows).collect()}
    around = lambda hit, side: [n.chunk_id for n in nested[hit][f"{side}_neighbors"]]
    assert (around(3, "before"), around(3, "after")) == ([2], [4])
    assert (around(4, "before"), around(4, "after")) == ([3], [5])
    assert rows.count() == 6


def test_no_neighbors_asked_returns_hits_only_despite_equal_numbers(spark):
    chunks = spark.createDataFrame([chunk(1, 0.9, 7), chunk(2, 0.1, 7)], CHUNKS)
    found = search.similarity_chunks(chunks, None, SearchRequest(QUERY, 1))
    assert [r.chunk_id for r in found.collect()] == [1]


def test_pages_carry_their_matches_best_first(spark):
    scores = [(11, 0.9, 1), (12, 0.8, 1), (13, 0.7, 1), (14, 0.6, 2)]
    chunks = spark.createDataFrame(
        [chunk(i, s, content=page) for i, s, page in scores], CHUNKS
    )
    pages = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 1, 3)], "id long, file_id long, content_number int")
    request = SearchRequest(QUERY, 4, when_match_return="content")
    rows = search.similarity_search(chunks, pages, None, request)
    found = search.nest_page_matches(rows).collect()
    assert [(r.hit_id, [m.chunk_id for m in r.match_chunks]) for r in found] == [(1, [11, 12, 13]), (2, [14])]
    request = SearchRequest(
        QUERY, 4, when_match_return="content", before_neighbor_count=1, after_neighbor_count=1
    )
    nested = search.nest_page_matches(search.similarity_search(chunks, pages, None, request)).collect()
    assert [[n.content_id for n in r.after_neighbors] for r in nested] == [[2], [3]]
    assert [[n.content_id for n in r.before_neighbors] for r in nested] == [[], [1]]


def test_retrieval_policy():
    assert search.retrieval_request(QUERY) == SearchRequest(
        QUERY, 10, 0.3, "content", 0, 0, "chunk"
    )
    assert search.retrieval_request(QUERY, 0.5, 3) == SearchRequest(
        QUERY, 3, 0.5, "content", 1, 1, "score"
    )
    assert search.retrieval_request(QUERY, 0.0).score_threshold == 0.0


# --- boolean search -----------------------------------------------------------

FILES = "id long, name string, project_id string, status string, created_at long, size long"
ANSWERS = "id long, file_id long, evaluation_id long, content_id long, response string"


@pytest.fixture
def library(spark):
    files = spark.createDataFrame(
        [(i, f"f{i}", "p", "completed", i, 10 * i) for i in range(1, 6)], FILES
    )
    answers = spark.createDataFrame(
        [(1, 1, 7, 10, "a"), (2, 1, 7, 11, "b"), (3, 2, 7, 20, "a"), (4, 3, 8, 30, "x-y"), (5, 4, 7, 40, "c")],
        ANSWERS,
    )
    return files, answers


@pytest.mark.parametrize(
    "tree,mode,wanted",
    [
        (Group("and", (Condition(7, "a"),)), "intended", {1, 2}),
        (Group("and", (Condition(7, "a", "neq"),)), "intended", {1, 4}),
        (Group("and", (Condition(7, "a", "neq"),)), "reference", {1, 2}),
        (Group("and", (Condition(7, None, "neq"),)), "intended", {3, 5}),
        (Group("and", (Condition(7, ""),)), "intended", {1, 2, 4}),
        (Group("or", ()), "intended", {1, 2, 3, 4, 5}),
        (None, "intended", {1, 2, 3, 4, 5}),
        (
            Group("or", (Condition(8, "x-y"), Group("and", (Condition(7, "a"), Condition(7, "b"))))),
            "intended",
            {1, 3},
        ),
        (
            Group("or", (Condition(7, "c"), Group("and", (Condition(7, "a"), Condition(7, "a", "neq"))))),
            "intended",
            {1, 4},
        ),
    ],
)
def test_predicate_trees(library, tree, mode, wanted):
    files, answers = library
    assert {r.id for r in files_matching(files, answers, tree, mode).collect()} == wanted


def test_search_returns_all_answers_of_matching_files(spark, library):
    files, answers = library
    evaluations = spark.createDataFrame([(7, "t7", "text"), (8, "t8", "text")], "id long, title string, evaluation_type string")
    pages = spark.createDataFrame(
        [(p, p // 10, 1 + p % 2) for p in (10, 11, 20, 30, 40)], "id long, file_id long, content_number int"
    )
    rows = search_files(files, answers, evaluations, pages, "p", "F", Group("and", (Condition(7, "a"),)))
    assert [r.answer_id for r in rows.collect()] == [3, 1, 2]
    nested = nest_answers(rows, pages_per_part=1).collect()
    assert [(r.file_id, r.part, len(r.evaluations)) for r in nested] == [(2, 0, 1), (1, 0, 1), (1, 1, 1)]
    assert len(nest_answers(rows).collect()) == 2


def test_page_range_needs_a_first_page(spark):
    pages = spark.createDataFrame([(1, 9, n) for n in range(1, 5)], "id long, file_id long, content_number int")
    number = lambda df: [r.content_number for r in df.collect()]
    assert number(reads.page_range(pages, 9, 2, 3)) == [2, 3]
    assert number(reads.page_range(pages, 9, 3, 0)) == [3, 4]
    with pytest.raises(ValueError):
        reads.page_range(pages, 9, 0)


def test_project_stats(spark):
    projects = spark.createDataFrame([("p", 1), ("empty", 2)], "id string, created_at long")
    files = spark.createDataFrame(
        [(1, "p", 10, "completed"), (2, "p", 5, "pending"), (3, "p", 0, "evaluating")],
        "id long, project_id string, size long, status string",
    )
    answers = spark.createDataFrame([(i, 1) for i in range(3)], "id long, file_id long")
    rows = {r.id: tuple(r)[2:] for r in reports.project_stats(projects, files, answers).collect()}
    assert rows == {"p": (3, 1, 1, 0, 15.0, 3), "empty": (0, 0, 0, 0, 0.0, 0)}


# --- evaluation ----------------------------------------------------------------

EVALUATIONS = (
    "id long, project_id string, title string, description string, system_prompt string, prompt string, "
    "evaluation_type string, evaluation_options array<string>, parent_evaluation_id long, "
    "parent_evaluation_option string, category_id long, template_id long, created_at long"
)


def question(ident, kind="text", options=None, parent=None, option=None, prompt="?", template=None, system=None):
    return (ident, "p", f"t{ident}", "d", system, prompt, kind, options, parent, option, 1, template, ident)


@pytest.fixture
def invoices(spark):
    """A type question with two follow-ups on invoices and one on any answer."""
    return spark.createDataFrame(
        [
            question(1, "enum_choice", ["Invoice", "Report"]),
            question(2, "boolean", parent=1, option="Invoice"),
            question(3, parent=1, option="Invoice"),
            question(4, parent=1),
            question(5, parent=4, option="it-is"),
        ],
        EVALUATIONS,
    )


def answer_with(spark, replies):
    table = spark.createDataFrame(
        [(c, e, r) for (c, e), r in replies.items()], "content_id long, evaluation_id long, response string"
    )
    return lambda tasks: tasks.join(table, ["content_id", "evaluation_id"])


def test_invoice_tree(spark, invoices):
    pages = spark.createDataFrame([(10, 1, "p"), (20, 1, "p")], "id long, file_id long, project_id string")
    replies = {(10, 1): "Invoice", (20, 1): "Report", (10, 2): "true", (10, 3): "5 EUR",
               (10, 4): "it-is", (20, 4): "no", (10, 5): "deep"}
    asked = ev.evaluate_pages(pages, invoices, answer_with(spark, replies))
    assert {(r.content_id, r.evaluation_id, r.level) for r in asked.collect()} == {
        (10, 1, 0), (20, 1, 0), (10, 2, 1), (10, 3, 1)
    }
    asked = ev.evaluate_pages(pages, invoices, answer_with(spark, replies), any_option=True)
    assert {(r.content_id, r.evaluation_id, r.level) for r in asked.collect()} == {
        (10, 1, 0), (20, 1, 0), (10, 2, 1), (10, 3, 1), (10, 4, 1), (20, 4, 1), (10, 5, 2)
    }


def test_tree_ignores_cycles_and_orphans(spark):
    rows = [question(1), question(2, parent=1), question(8, parent=9), question(9, parent=8), question(7, parent=99)]
    tree = hierarchy.evaluation_tree(spark.createDataFrame(rows, EVALUATIONS))
    assert {(r.id, r.depth, tuple(r.path)) for r in tree.collect()} == {(1, 0, (1,)), (2, 1, (1, 2))}


def test_a_deep_chain_of_questions(spark):
    rows = [question(1)] + [question(k, parent=k - 1) for k in range(2, 251)]
    tree = hierarchy.evaluation_tree(spark.createDataFrame(rows, EVALUATIONS)).collect()
    assert {r.id: r.depth for r in tree} == {k: k - 1 for k in range(1, 251)}
    assert all(list(r.path) == list(range(1, r.id + 1)) for r in tree)
    assert hierarchy.evaluation_tree(spark.createDataFrame([], EVALUATIONS)).isEmpty()


def test_templates(spark):
    row = lambda template, **kw: values(spark, render(F.lit(template), {k: F.lit(v) for k, v in kw.items()}))
    assert row("a {{ x }}{{y}} {z}\n", x="{{ y }}", y="1") == "a {{ y }}1 {z}"
    assert row("{{ missing }}|{{ x }}", x=None) == "|None"
    assert row("{ {{x}} }", x="$1\\") == "{ $1\\ }"


def test_prompts_inherit_from_templates(spark):
    evaluations = spark.createDataFrame(
        [question(1, prompt="", template=5), question(2, prompt="", template=6),
         question(3, prompt="own", system="mine", template=5), question(4, prompt="", template=77)],
        EVALUATIONS,
    )
    templates = spark.createDataFrame(
        [(5, "sys {{ title }}", "{{ system_prompt }}!"), (6, None, "p {{ id }}")],
        "id long, system_prompt string, prompt string",
    )
    rows = {r.id: (r.system_prompt, r.prompt) for r in ev.apply_templates(evaluations, templates).collect()}
    assert rows == {1: ("sys t1", "sys t1!"), 2: (None, "p 2"), 3: ("mine", "own"), 4: (None, "")}


def callback(evaluation, name=None, arguments=None, message=None, status="COMPLETED", file_id=1, calls=True):
    call = [{"function": {"name": name, "arguments": arguments}}] if name else []
    return json.dumps({"event": "ITEM_UPDATE", "payload": {
        "status": status, "error": None,
        "request": {"metadata": {"evaluation_id": str(evaluation), "file_id": str(file_id), "file_content_id": "10"}},
        "response": {"message": message, "tool_calls": call},
    }})


def test_answers_by_type(spark, invoices):
    raw = [
        callback(2, "boolean_answer", '{"answer": true}'), callback(2, "boolean_answer", '{"answer": "No"}'),
        callback(1, "enum_answer", '{"answer": "Invoice"}'), callback(1, "enum_answer", '{"answer": "Other-1"}'),
        callback(3, message="five - six"), callback(1, "boolean_answer", '{"answer": "Invoice"}'),
        callback(1, "enum_answer", ""), callback(1), callback(99, message="x"), callback(3, message="x", file_id=5),
        callback(2, "boolean_answer", "{}"), callback(3, message="late", status="FAILED"),
    ]
    files = spark.createDataFrame([(1,)], "id long")
    numbered = spark.createDataFrame(list(enumerate(raw)), "n int, value string")
    rows = ev.parse_answers(ev.decode_callbacks(numbered), files, invoices).orderBy("n").collect()
    assert [r.reject_reason or r.response for r in rows] == [
        "true", "no", "Invoice", "Other-1", "five - six", "wrong tool call", "no arguments",
        "no tool call", "unknown evaluation", "unknown file", "no answer", "late",
    ]
    assert [r.is_listed_option for r in rows[2:4]] == [True, False]
    assert rows[11].status == "failed" and rows[0].status == "completed"


def test_answers_with_separators_keep_their_keys(spark, invoices):
    answers = spark.createDataFrame([("p", 1, 10, 4, "it-is"), ("p", 1, 10, 4, "it-is")],
                                    "project_id string, file_id long, content_id long, evaluation_id long, response string")
    assert [r.evaluation_id for r in ev.next_level_tasks(answers, invoices).collect()] == [5]


def test_changed_option_asks_the_files_of_the_old_one(spark, library):
    files, answers = library
    old = {"id": 8, "project_id": "p", "parent_evaluation_id": 7, "parent_evaluation_option": "a"}
    new = {**old, "parent_evaluation_option": "c"}
    ids = lambda df: {r.file_id for r in df.collect()}
    assert ids(ev.files_to_evaluate(files, answers, new, old)) == {1, 2, 3}
    assert ids(ev.files_to_evaluate(files, answers, new)) == {1, 2, 3, 4, 5}


# --- ingestion -------------------------------------------------------------------


def test_object_keys(spark):
    keys = ["p/a.pdf", "p/a.PDF", "p/sub/a.txt", "a.txt", "/a.txt", "q/a.txt", "p/.txt", "p/a.tar.gz"]
    projects = spark.createDataFrame([("p",)], "id string")
    objects = landing.parse_object_key(spark.createDataFrame([(k,) for k in keys], "key string"))
    reasons = {r.key: r.reject_reason for r in landing.check_objects(objects, projects).collect()}
    assert reasons == {
        "p/a.pdf": None, "p/a.PDF": "unsupported extension", "p/sub/a.txt": "malformed key",
        "a.txt": "malformed key", "/a.txt": "malformed key", "q/a.txt": "unknown project",
        "p/.txt": "unsupported extension", "p/a.tar.gz": "unsupported extension",
    }


def test_all_records_of_an_event_count(spark):
    record = lambda key: {"s3": {"bucket": {"name": "b"}, "object": {"key": key, "size": 1}}}
    bodies = [
        json.dumps({"Type": "Notification", "MessageId": "m", "Message": json.dumps({"Records": rs})})
        for rs in ([record("p/1"), record("p/2")], [])
    ]
    rows = landing.decode_landing_events(spark.createDataFrame([(b,) for b in bodies], "value string")).collect()
    assert [r.key for r in rows] == ["p/1", "p/2", None]
    assert [r.reject_reason for r in rows] == [None, None, "no records"]


def test_unreadable_bodies_are_rejected_not_lost(spark):
    bodies = [None, "", "no json", "{}", '{"MessageId":"m"}', '{"MessageId":"m","Message":"{\\"Records"}']
    raw = spark.createDataFrame([(b,) for b in bodies], "value string")
    objects = landing.parse_object_key(landing.decode_landing_events(raw))
    projects = spark.createDataFrame([("p",)], "id string")
    rows = landing.rejected(landing.check_objects(objects, projects)).collect()
    assert [r.reject_reason for r in rows] == ["unreadable message"] * len(bodies)


def test_registering_again_finds_the_file(spark):
    schema = "bucket string, key string, message_id string, file_id string, project_id string, file_name string, size long"
    objects = spark.createDataFrame([("b", "p/a.txt", "m", None, "p", "a.txt", 1)], schema)
    files = spark.createDataFrame([], "id string, name string, status string")
    first = landing.register_files(objects, files).collect()[0]
    assert (first.is_new, first.status) == (True, "chunking")
    files = spark.createDataFrame([(first.file_id, "a.txt", "completed")], files.schema)
    again = landing.register_files(objects, files).collect()[0]
    assert (again.file_id, again.is_new, again.status) == (first.file_id, False, "completed")


@pytest.mark.parametrize(
    "name,mime",
    [("a.pdf", "application/pdf"), ("A.TXT", "text/plain"), ("x.tar.gz", "application/x-tar"),
     ("x.tgz", "application/x-tar"), ("noext", None), (".profile", None), ("d.dir/noext", None)],
)
def test_mime_types_match_the_standard_library(spark, name, mime):
    import mimetypes

    assert mimetypes.MimeTypes(filenames=()).guess_type(name)[0] == mime
    assert values(spark, text.mime_type(F.lit(name))) == mime


@pytest.mark.parametrize(
    "content", ["", "a", "a\n", "a\r\nb", "\n", "a\rb\x0bc\x0cd", "x y\x85", "\r\n\r\n", "a\x1cb\x1d"]
)
def test_line_counts_match_splitlines(spark, content):
    assert values(spark, text.line_count(F.lit(content))) == len(content.splitlines())


@pytest.mark.parametrize(
    "size,label",
    [(0, "0 B"), (999, "999 B"), (1000, "1 kB"), (1500, "1.5 kB"), (265318, "265.32 kB"),
     (999_994, "999.99 kB"), (999_995, "1 MB"), (10**9, "1 GB")],
)
def test_sizes(spark, size, label):
    assert values(spark, text.human_size(F.lit(size).cast("long"))) == label


@pytest.mark.parametrize("token", ["a b", "~-_.*+%/", "é✓", ""])
def test_percent_coding(spark, token):
    from urllib.parse import quote

    encoded = quote(token, safe="")
    assert values(spark, text.percent_encode(F.lit(token))) == encoded
    assert values(spark, text.percent_decode(F.lit(encoded))) == token
    assert values(spark, text.percent_decode(F.lit("a+b"))) == "a+b"


def test_stable_ids_depend_on_every_part(spark):
    one = values(spark, text.stable_id(F.lit("a|1:b"), F.lit("c")))
    assert one != values(spark, text.stable_id(F.lit("a"), F.lit("b|1:c")))
    assert one == values(spark, text.stable_id(F.lit("a|1:b"), F.lit("c")))


def test_a_broken_file_does_not_fail_the_job(spark):
    def extractor(data):
        if data == b"bad":
            raise ValueError("not a document")
        return [(part.decode(), {"page_label": str(i)}) for i, part in enumerate(data.split(b"|"))]

    files = spark.createDataFrame([(1, b"one|two"), (2, b"bad"), (3, b"x")], "file_id long, content binary")
    rows = loaders.extract_pages(files, extractor).orderBy("file_id", "content_number").collect()
    assert [(r.file_id, r.content_number, r.content, r.error) for r in rows] == [
        (1, 1, "one", None), (1, 2, "two", None), (2, None, None, "not a document"), (3, 1, "x", None)
    ]
    assert rows[1].content_metadata == {"page_label": "1"}


def test_text_and_binary_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    row = loaders.read_text_files(spark, str(tmp_path / "*.txt")).head()
    assert row.text == "one\ntwo\n" and row.path.endswith("a.txt")
    assert [r.length for r in loaders.read_binary_files(spark, str(tmp_path)).collect()] == [4]
    page = loaders.text_pages(spark.createDataFrame([("f", "one\ntwo\n")], "file_id string, text string")).head()
    assert (page.content_number, page.content_metadata) == (1, {"total_lines": "2"})


# --- maintenance -----------------------------------------------------------------


def test_upsert_is_idempotent_and_keeps_the_first_id(spark):
    columns = "id string, file_id long, evaluation_id long, content_id long, response string, created_at long, updated_at long"
    existing = spark.createDataFrame([("a", 1, 1, 1, "old", 1, 1), ("b", 1, 1, 1, "dup", 2, 2), ("k", 1, 2, 1, "keep", 1, 1)], columns)
    incoming = spark.createDataFrame([("n", 1, 1, 1, "new", 0, 0), ("m", 1, 3, 1, "first", 9, 9)], columns)
    once = maintenance.upsert_answers(existing, incoming)
    assert sorted((r.id, r.response, r.created_at) for r in once.collect()) == [
        ("a", "new", 1), ("k", "keep", 1), ("m", "first", 9)
    ]
    assert sorted(maintenance.upsert_answers(once, incoming).collect()) == sorted(once.collect())


def test_update_tells_null_from_unchanged(spark):
    table = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "id long, error string, updated_at long")
    changes = spark.createDataFrame([(1, None)], "id long, error string")
    rows = maintenance.update_rows(table, changes, stamp=F.lit(9).cast("long")).collect()
    assert sorted(map(tuple, rows)) == [(1, None, 9), (2, "b", 5)]


def test_deleting_an_evaluation_takes_its_descendants(spark, invoices):
    answers = spark.createDataFrame([(i, i) for i in range(1, 6)], "id long, evaluation_id long")
    tables = {"evaluations": invoices, "file_evaluations": answers}
    left = maintenance.delete_evaluations(tables, spark.createDataFrame([(4,)], "id long"))
    assert {r.id for r in left["evaluations"].collect()} == {1, 2, 3}
    assert {r.evaluation_id for r in left["file_evaluations"].collect()} == {1, 2, 3}


def test_project_with_files_is_not_deleted_silently(spark, library, invoices):
    files, answers = library
    tables = {"projects": spark.createDataFrame([("p",), ("q",)], "id string"), "files": files,
              "evaluations": invoices, "file_evaluations": answers}
    ids = spark.createDataFrame([("p",)], "id string")
    with pytest.raises(ValueError):
        maintenance.delete_projects(tables, ids)
    left = maintenance.delete_projects(tables, ids, cascade=True)
    assert {n: df.count() for n, df in left.items()} == {
        "projects": 1, "files": 0, "evaluations": 0, "file_evaluations": 0
    }


def test_only_the_newest_default_stays(spark):
    templates = spark.createDataFrame(
        [(1, 7, True, 1), (2, 7, True, 2), (3, 7, False, 9), (4, 8, True, 1)],
        "id long, category_id long, default boolean, updated_at long",
    )
    assert {r.id for r in maintenance.exclusive_default(templates).filter("default").collect()} == {2, 4}


def test_seeds_are_added_once(spark, invoices):
    projects = spark.createDataFrame([("p",)], "id string")
    categories = spark.createDataFrame([("c", "Example", "mine", "p")], "id string, name string, description string, project_id string")
    known = invoices.select("project_id", F.lit("Joke Finder").alias("title")).limit(1)
    found, new = maintenance.seed_examples(categories, known, projects)
    assert [(r.id, r.is_new) for r in found.collect()] == [("c", False)]
    assert [(r.title, r.category_id) for r in new.collect()] == [("Pizza Mention Detector", "c")]


def test_answer_display_round_trip():
    assert [reads.answer_from_display(c) for c in ("All", "Yes", "no", "en")] == [None, "true", "false", "en"]
