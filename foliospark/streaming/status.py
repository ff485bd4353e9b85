"""Where each file stands, kept up to date by a stream.

Whatever happens to a file is one stream of events. They are merged on read: a batch
logs the best state it brings of each chunk and answer, and a file stands where the best
of all batches put it. So events may come twice and in any order, and a batch costs what
it brings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.streaming import landing, merge_log
from foliospark.streaming.merge_log import MergeLog

EVENT_DDL = "file_id long, kind string, item string, state int, text string"
CHUNK, ANSWER, EXPECTED, REGISTERED, FAILURE = "chunk", "answer", "expected", "registered", "failure"


def event(
    kind: str, item: Column | None = None, state: Column | None = None, text: Column | None = None
) -> list[Column]:
    item, state, text = (F.lit(None) if c is None else c for c in (item, state, text))
    return [
        F.col("file_id").cast("long").alias("file_id"),
        F.lit(kind).alias("kind"),
        item.cast("string").alias("item"),
        state.cast("int").alias("state"),
        text.cast("string").alias("text"),
    ]


def registered_events(files: DataFrame) -> DataFrame:
    rows = files.withColumnRenamed("id", "file_id")
    return rows.select(*event(REGISTERED, text=F.col("status")))


def failure_events(failures: DataFrame) -> DataFrame:
    return failures.select(*event(FAILURE, text=F.col("error")))


def expected_events(expected: DataFrame) -> DataFrame:
    return expected.select(*event(EXPECTED, state=F.col("n_expected")))


def chunk_events(chunks: DataFrame) -> DataFrame:
    done = (F.col("status") == "EMBEDDED").cast("int")
    return chunks.select(*event(CHUNK, F.col("id"), F.coalesce(done, F.lit(0))))


def answer_events(answers: DataFrame) -> DataFrame:
    """One item per question and page, whose best answer counts."""
    rank = F.when(F.col("status") == "completed", 2).when(F.col("status") == "failed", 1)
    item = F.concat_ws(":", F.col("evaluation_id"), F.col("content_id"))
    return answers.select(*event(ANSWER, item, rank.otherwise(0)))


def fold(events: DataFrame, *order: str) -> DataFrame:
    """One row for each file, kind and item: the best state and the least text.

    Of registrations and numbers due the last one counts, by the columns ``order``.
    """
    last = F.struct("state", "text")
    last = F.max_by(last, F.struct(*order)) if order else F.last(last)
    folded = events.groupBy("file_id", "kind", "item").agg(
        F.max("state").alias("_state"), F.min("text").alias("_text"), last.alias("_last")
    )
    return folded.select(
        "file_id",
        "kind",
        "item",
        F.when(F.col("kind") == EXPECTED, F.col("_last.state")).otherwise(F.col("_state")).alias("state"),
        F.when(F.col("kind") == REGISTERED, F.col("_last.text")).otherwise(F.col("_text")).alias("text"),
    )


def standing(items: DataFrame) -> DataFrame:
    """The totals and the status of each file, from its folded events."""

    def of(*kinds: str) -> Column:
        return F.col("kind").isin(*kinds)

    answer = ~of(CHUNK, EXPECTED, REGISTERED, FAILURE)
    state = F.col("state")
    totals = items.groupBy(F.col("file_id").alias("id")).agg(
        F.max(F.when(of(REGISTERED), F.col("text"))).alias("registered_status"),
        F.count_if(of(CHUNK)).alias("n_chunks"),
        F.count_if(of(CHUNK) & (state == 1)).alias("n_embedded"),
        F.count_if(answer).alias("n_answers"),
        F.min(F.when(of(FAILURE), F.col("text"))).alias("error"),
        F.count_if(answer & (state == 2)).alias("_done"),
        F.count_if(answer & (state == 1)).alias("_failed"),
        F.max(F.when(of(EXPECTED), state)).alias("_expected"),
    )
    n_chunks, n_embedded, n_answers = (F.col(f"n_{c}") for c in ("chunks", "embedded", "answers"))
    status = (
        F.when(F.col("error").isNotNull() | (F.col("_failed") > 0), "failed")
        .when((n_answers > 0) & (F.col("_done") >= F.col("_expected")), "completed")
        .when(n_answers > 0, "evaluating")
        .when((n_chunks > 0) & (n_chunks == n_embedded), "embedded")
        .when(n_embedded > 0, "embedding")
        .when(n_chunks > 0, "chunked")
        .otherwise(F.col("registered_status"))
    )
    return totals.withColumn("status", status).drop("_done", "_failed", "_expected")


def status_table(path: str) -> MergeLog:
    return MergeLog(
        path,
        EVENT_DDL,
        keys=("file_id", "kind", "item"),
        newest=(),
        fold=lambda versions: fold(versions, "version"),
    )


def status_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the status table at ``path`` up to date with the ``events`` of files.

    A batch logs one row for each item it brings; :func:`current_status` reads the
    table, also while the stream runs. A batch run again replaces what it logged.
    """
    table = status_table(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_log.append_changes(table, fold(batch), batch_id)
        merge_log.compact(table, batch.sparkSession)

    return landing.run_batches(events, write, checkpoint)


def current_status(spark: SparkSession, path: str) -> DataFrame:
    return standing(merge_log.current(status_table(path), spark))
