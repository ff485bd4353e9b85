"""Statistics and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.maintenance import latest_answers
from foliospark.operators.reads import displayed_answer, page_label, shown_when_empty
from foliospark.operators.scale import join_by_key, join_dimension


def project_stats(projects: DataFrame, files: DataFrame, answers: DataFrame) -> DataFrame:
    """File counts by status, total size and answers per project.

    Each child table is aggregated on its own before it meets the projects, so
    nothing fans out and no distinct is needed. Answers are first counted per
    file, in every task, so that a file with very many of them is one row when
    its project is looked up.
    """
    status = F.col("status")
    per_file = answers.groupBy(F.col("file_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_answers")
    )
    counted = (
        files.select("id", "project_id", "size", "status")
        .join(per_file, "id", "left")
        .groupBy("project_id")
        .agg(
            F.count(F.lit(1)).alias("_total"),
            F.count_if(status == "pending").alias("_pending"),
            F.count_if(status == "completed").alias("_completed"),
            F.count_if(status == "failed").alias("_failed"),
            F.sum("size").alias("_size"),
            F.sum("_answers").alias("_answers"),
        )
        .withColumnRenamed("project_id", "id")
    )

    def filled(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).cast("long")

    return projects.join(counted, "id", "left").select(
        *projects.columns,
        filled("_total").alias("total_files_count"),
        filled("_pending").alias("pending_files_count"),
        filled("_completed").alias("completed_files_count"),
        filled("_failed").alias("failed_files_count"),
        filled("_size").cast("double").alias("total_size"),
        filled("_answers").alias("total_evaluations"),
    ).orderBy(F.col("created_at").desc(), "id")


def answers_detail(
    answers: DataFrame, files: DataFrame, evaluations: DataFrame, pages: DataFrame
) -> DataFrame:
    """Answers with their file, evaluation and page.

    Page texts join last, and on (file, page), so that a filter on the file
    reaches the scan of the pages as well.
    """
    heads = files.select(
        F.col("id").alias("file_id"), F.col("name").alias("file_name"), "project_id"
    )
    titles = evaluations.select(
        F.col("id").alias("evaluation_id"), "title", "evaluation_type", "category_id"
    )
    texts = pages.select(
        "file_id",
        F.col("id").alias("content_id"),
        "content_number",
        "content_metadata",
        "content",
    )
    rows = answers.withColumnRenamed("id", "answer_id")
    joined = join_dimension(rows, titles, ["evaluation_id"], spread=["answer_id"])
    joined = join_by_key(joined, heads, ["file_id"])
    return joined.join(texts, ["file_id", "content_id"])


def answers_by_file(detail: DataFrame, project_id: object, file_id: object) -> DataFrame:
    """Answers of a file of the project, by page and title, none twice."""
    return detail.filter(
        (F.col("file_id") == F.lit(file_id)) & (F.col("project_id") == F.lit(project_id))
    ).orderBy("content_number", "title", "answer_id")


def answers_by_evaluation(
    detail: DataFrame,
    project_id: object,
    evaluation_id: object,
    option_value: str | None = None,
) -> DataFrame:
    """Answers to an evaluation, newest first, optionally one response only."""
    rows = detail.filter(
        (F.col("evaluation_id") == F.lit(evaluation_id))
        & (F.col("project_id") == F.lit(project_id))
    )
    if option_value:
        rows = rows.filter(F.col("response") == option_value)
    return rows.orderBy(F.col("created_at").desc(), "answer_id")


def answers_by_page(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """Answers per page of a file. A page has one answer per evaluation, so
    the nested list is as short as the list of questions."""
    numbers = pages.select("file_id", F.col("id").alias("content_id"), "content_number")
    item = F.struct("evaluation_id", "response", F.col("id").alias("answer_id"))
    return (
        answers.join(numbers, ["file_id", "content_id"])
        .groupBy("file_id", "content_number")
        .agg(
            F.count(F.lit(1)).alias("n_answers"),
            F.sort_array(F.collect_list(item)).alias("answers"),
        )
    )


def file_answer_summary(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """Number of answers and highest answered page of each file."""
    numbers = pages.select("file_id", F.col("id").alias("content_id"), "content_number")
    return (
        answers.select("file_id", "content_id")
        .join(numbers, ["file_id", "content_id"])
        .groupBy("file_id")
        .agg(
            F.count(F.lit(1)).alias("n_answers"),
            F.max("content_number").alias("last_page"),
        )
    )


def grouped_by_category(categories: DataFrame, items: DataFrame) -> DataFrame:
    """Evaluations or templates under their category, one row each.

    An empty category stays as a row without item, unless it is the default.
    """
    rows = items.select(
        F.col("category_id").alias("id"),
        F.col("id").alias("item_id"),
        F.col("created_at").alias("item_created_at"),
    )
    heads = categories.select("id", "project_id", "name")
    joined = heads.join(rows, "id", "left").withColumn(
        "n_evaluations", F.col("item_id").isNotNull().cast("int")
    )
    return joined.filter(shown_when_empty()).select(
        F.col("id").alias("category_id"),
        "project_id",
        F.col("name").alias("category_name"),
        "item_id",
        "item_created_at",
    )


def results_table(
    answers: DataFrame,
    files: DataFrame,
    evaluations: DataFrame,
    pages: DataFrame,
    category_id: object | None = None,
) -> DataFrame:
    """Newest results of one category or of all, ready to show.

    Versions are dropped from the narrow answers, before page texts join.
    """
    if category_id is not None:
        evaluations = evaluations.filter(F.col("category_id") == F.lit(category_id))
        asked = evaluations.select(F.col("id").alias("evaluation_id"))
        answers = join_dimension(answers, asked, ["evaluation_id"], "left_semi", ["id"])
    newest = answers_detail(latest_answers(answers), files, evaluations, pages)
    return newest.select(
        "answer_id",
        "project_id",
        "category_id",
        "file_id",
        "file_name",
        "evaluation_id",
        "title",
        "evaluation_type",
        "response",
        displayed_answer(F.col("evaluation_type"), F.col("response")).alias("answer"),
        (F.col("response") == "true").alias("is_match"),
        page_label(F.col("content_metadata"), F.col("content_number")).alias("page_label"),
        "content_number",
        "content",
        "updated_at",
    )


def file_status_rollup(
    files: DataFrame,
    chunks: DataFrame,
    answers: DataFrame,
    failures: DataFrame,
    expected: DataFrame,
) -> DataFrame:
    """Where each file stands, derived from what exists of it.

    failed > completed (every expected answer is completed) > evaluating (some
    answers exist) > embedding state of its chunks > as registered. ``failures``
    has one row per (file_id, error), ``expected`` the number of answers
    ``n_expected`` due for each ``file_id``. Answers count once per question and
    page, and only when they are completed.
    """
    chunk_state = chunks.groupBy(F.col("file_id").alias("id")).agg(
        F.count_if(F.col("status") == "EMBEDDED").alias("n_embedded"),
        F.count(F.lit(1)).alias("n_chunks"),
    )
    # The state of a question on a page is that of its best answer.
    rank = F.when(F.col("status") == "completed", 2).when(F.col("status") == "failed", 1)
    each = answers.groupBy("file_id", "evaluation_id", "content_id").agg(
        F.max(F.coalesce(rank, F.lit(0))).alias("state")
    )
    answer_state = each.groupBy(F.col("file_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_answers"),
        F.count_if(F.col("state") == 2).alias("n_done"),
        F.count_if(F.col("state") == 1).alias("n_failed"),
    )
    due = expected.select(F.col("file_id").alias("id"), "n_expected")
    errors = failures.groupBy(F.col("file_id").alias("id")).agg(
        F.min("error").alias("error")
    )
    joined = (
        files.select("id", F.col("status").alias("registered_status"))
        .join(chunk_state, "id", "left")
        .join(answer_state, "id", "left")
        .join(due, "id", "left")
        .join(errors, "id", "left")
    )
    embedded, chunked = F.coalesce("n_embedded", F.lit(0)), F.coalesce("n_chunks", F.lit(0))
    derived = (
        F.when(F.col("error").isNotNull() | (F.coalesce("n_failed", F.lit(0)) > 0), "failed")
        .when(F.col("n_done") >= F.col("n_expected"), "completed")
        .when(F.col("n_answers") > 0, "evaluating")
        .when((chunked > 0) & (embedded == chunked), "embedded")
        .when(embedded > 0, "embedding")
        .when(chunked > 0, "chunked")
        .otherwise(F.col("registered_status"))
    )
    return joined.select(
        "id",
        "registered_status",
        chunked.alias("n_chunks"),
        embedded.alias("n_embedded"),
        F.coalesce("n_answers", F.lit(0)).alias("n_answers"),
        "error",
        derived.alias("status"),
    )
