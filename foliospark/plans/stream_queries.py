"""Streams over data written from the given tables, run to their end.

Each is checked against the batch result stated in SQL.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators import evaluation as ev
from foliospark.plans.driver_tables import DriverTables, seconds_after_base
from foliospark.plans.evaluate_queries import ROOTS_SQL
from foliospark.plans.maintain_queries import UPSERT_COLUMNS, UPSERT_SQL, _incoming
from foliospark.plans.read_queries import FILE_STATUS_SQL, file_status_inputs
from foliospark.plans.registry import query
from foliospark.session import materialise, scratch_path, settings
from foliospark.sources import landing as source_landing
from foliospark.sources import sinks
from foliospark.streaming import answers, attempts, landing, status


STATE_PARTITIONS = 8  # at least; every partition of a state has a cost


def _with_state(build):
    """Start the streams of a query with as few partitions of state as there are cores."""

    @wraps(build)
    def run(t: DriverTables, *more):
        partitions = max(STATE_PARTITIONS, t.spark.sparkContext.defaultParallelism)
        with settings(t.spark, {"spark.sql.shuffle.partitions": str(partitions)}):
            return build(t, *more)

    return run


def _written_messages(t: DriverTables, root: str) -> str:
    path = f"{root}/in"
    t.landing_messages.select("value").write.mode("errorifexists").text(path)
    return path


@query(
    "stream_landing",
    """SELECT message_id, record, bucket, key, size, etag, NULL::VARCHAR AS reject_reason
       FROM p_objects
       UNION ALL SELECT CASE WHEN doc_id % 60 = 41 THEN 'cut' END, NULL, NULL, NULL, NULL, NULL,
         'unreadable message' FROM documents WHERE doc_id % 30 = 11
       UNION ALL SELECT 'none', NULL, NULL, NULL, NULL, NULL, 'no records'
       FROM documents WHERE doc_id % 30 = 13""",
)
def stream_landing(t: DriverTables) -> DataFrame:
    """Bodies that cannot be read arrive with the reason."""
    root = scratch_path(t.spark, "stream-landing")
    objects = landing.landed_objects(landing.read_landing(t.spark, _written_messages(t, root)))
    landing.write_stream(
        objects.select("message_id", "record", "bucket", "key", "size", "etag", "reject_reason"),
        f"{root}/out",
        f"{root}/checkpoint",
    ).awaitTermination()
    return t.spark.read.parquet(f"{root}/out")


@query(
    "stream_dedupe",
    "SELECT DISTINCT message_id, record, key FROM p_objects",
)
@_with_state
def stream_dedupe(t: DriverTables) -> DataFrame:
    root = scratch_path(t.spark, "stream-dedupe")
    objects = landing.landed_objects(landing.read_landing(t.spark, _written_messages(t, root)))
    landing.store_once(
        source_landing.readable(objects).select("message_id", "record", "key"),
        landing.MESSAGE_KEYS,
        f"{root}/out",
        f"{root}/checkpoint",
    ).awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select("message_id", "record", "key")


@query(
    "stream_late",
    "SELECT DISTINCT message_id, record, key FROM p_objects",
)
@_with_state
def stream_late(t: DriverTables) -> DataFrame:
    """The newest messages come first, those of years before and redeliveries later.

    The state remembers four years: it alone settles the newer messages, and the
    stored table those that were sent before.
    """
    root = scratch_path(t.spark, "stream-late")
    messages = t.landing_messages
    for late in (False, True):
        part = messages.filter((F.col("doc_id") % 2 == 0) == F.lit(late))
        if late:
            aged = F.regexp_replace("value", '"Timestamp":"2024', '"Timestamp":"2019')
            part = part.withColumn("value", aged).unionByName(messages.filter("doc_id % 4 = 1"))
        part.select("value").write.mode("append").text(f"{root}/in")
        objects = landing.landed_objects(landing.read_landing(t.spark, f"{root}/in"))
        landing.store_once(
            source_landing.readable(objects).select("message_id", "record", "key", "sent_at"),
            landing.MESSAGE_KEYS,
            f"{root}/out",
            f"{root}/checkpoint",
            sent_at="sent_at",
            ttl=timedelta(days=365 * 4),
        ).awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select("message_id", "record", "key")


@query("stream_upsert", UPSERT_SQL)
def stream_upsert(t: DriverTables) -> DataFrame:
    """The answers of a later run arrive as a stream and are merged batch by batch."""
    root = scratch_path(t.spark, "stream-upsert")
    _incoming(t).repartition(4).write.mode("errorifexists").parquet(f"{root}/in")
    arriving = (
        t.spark.readStream.schema(_incoming(t).schema)
        .option("maxFilesPerTrigger", 2)
        .parquet(f"{root}/in")
    )
    landing.merge_answers(
        t.answers, arriving, f"{root}/table", f"{root}/checkpoint"
    ).awaitTermination()
    return landing.current_answers(t.answers, f"{root}/table").select(*UPSERT_COLUMNS)


def _completions(t: DriverTables) -> DataFrame:
    """Answered first levels of every file, with the number of items due."""
    tasks = ev.tasks_for_pages(t.pages, ev.first_level(t.evaluations), carry_text=True)
    answered = ev.respond_stub(tasks, t.pages, t.evaluations)
    expected = answered.groupBy("file_id").agg(F.count(F.lit(1)).alias("expected"))
    return answered.join(expected, "file_id").select(
        F.concat(F.lit("ingest-"), F.col("file_id").cast("string")).alias("workflow_id"),
        F.lit(0).alias("level"),
        "project_id",
        "file_id",
        "evaluation_id",
        "content_id",
        "response",
        "expected",
    )


@_with_state
def _fired(t: DriverTables, label: str) -> str:
    """Run the barrier on completions that come twice, and half of them late."""
    root = scratch_path(t.spark, label)
    completions = materialise(_completions(t), "completions")
    for late in (False, True):
        part = completions.filter((F.col("content_id") % 2 == 0) == F.lit(late))
        part.unionByName(part).write.mode("append").parquet(f"{root}/in")
        arriving = (
            t.spark.readStream.schema(completions.schema)
            .option("maxFilesPerTrigger", 64)
            .parquet(f"{root}/in")
        )
        answers.level_barrier(
            arriving,
            f"{root}/out",
            f"{root}/checkpoint",
            lambda items: ev.next_level_tasks(items, t.evaluations),
        ).awaitTermination()
    return f"{root}/out"


@query(
    "stream_barrier",
    f"""SELECT 'ingest-' || file_id AS workflow_id, 0 AS level, count(*) AS finished
        FROM ({ROOTS_SQL}) GROUP BY file_id""",
)
def stream_barrier(t: DriverTables) -> DataFrame:
    """Every file's first level fires once, with its last, possibly late, answer."""
    return t.spark.read.parquet(f"{_fired(t, 'stream-barrier')}/fired").drop("batch_id")


@query(
    "stream_next_level",
    f"""SELECT DISTINCT r.file_id, r.content_id, c.evaluation_id,
          r.evaluation_id AS parent_evaluation_id, r.response AS parent_evaluation_option
        FROM ({ROOTS_SQL}) r JOIN p_stub c ON c.content_id = r.content_id
         AND c.parent_evaluation_id = r.evaluation_id
         AND c.parent_evaluation_option = r.response""",
)
def stream_next_level(t: DriverTables) -> DataFrame:
    """A fired level writes the tasks of the next one."""
    tasks = t.spark.read.parquet(f"{_fired(t, 'stream-next-level')}/tasks")
    return tasks.drop("batch_id", "project_id")


@query(
    "stream_evaluation_starts",
    """SELECT DISTINCT doc_id AS file_id FROM p_checked
       WHERE record = 0 AND reject_reason IS NULL""",
)
def stream_evaluation_starts(t: DriverTables) -> DataFrame:
    """The event table written by ingestion feeds the stream that starts evaluations."""
    from foliospark.plans.ingest_queries import _events

    root = scratch_path(t.spark, "stream-starts")
    events = _events(t)
    sinks.append(events, f"{root}/in")
    arriving = t.spark.readStream.schema(events.schema).parquet(f"{root}/in")
    landing.write_stream(
        answers.evaluation_starts(arriving), f"{root}/out", f"{root}/checkpoint"
    ).awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select(
        F.col("file_id").cast("long").alias("file_id")
    )



@query(
    "stream_correlate",
    """SELECT doc_id % 6 AS evaluation_id, doc_id AS content_id,
         CASE WHEN doc_id % 5 <> 0 AND doc_id % 90 <= 60 THEN 'answered' ELSE 'expired' END AS status,
         CASE WHEN doc_id % 5 <> 0 AND doc_id % 90 <= 60 THEN lang END AS response
       FROM documents""",
)
@_with_state
def stream_correlate(t: DriverTables) -> DataFrame:
    """Requests and completions meet as streams.

    Every fifth request is never answered, others are answered up to 89 minutes later,
    half of the completions arrive in a later run and some of these twice.
    """
    root = scratch_path(t.spark, "stream-correlate")
    asked_at = seconds_after_base(F.col("doc_id"))
    keys = [(F.col("doc_id") % 6).alias("evaluation_id"), F.col("doc_id").alias("content_id")]
    requests = t.documents.select(*keys, asked_at.alias("requested_at"))
    delay = F.make_dt_interval(mins=(F.col("doc_id") % 90).cast("int"))
    completions = t.documents.filter("doc_id % 5 <> 0").select(
        *keys, (asked_at + delay).alias("completed_at"), F.col("lang").alias("response")
    )
    # Both streams go on later, so that every deadline passes.
    much_later = seconds_after_base(F.lit(10**9).cast("long"))
    none = F.lit(None).cast("long")
    ticks = t.spark.range(1).select(none.alias("evaluation_id"), none.alias("content_id"), much_later.alias("at"))
    half = F.col("content_id") % 2 == 0
    arriving = [
        (requests, completions.filter(half)),
        (None, completions.filter(~half).unionByName(completions.filter("content_id % 3 = 1"))),
        (
            ticks.withColumnRenamed("at", "requested_at"),
            ticks.withColumnRenamed("at", "completed_at").withColumn("response", F.lit(None).cast("string")),
        ),
    ]
    for asked, given in arriving:
        for rows, name in ((asked, "requests"), (given, "completions")):
            if rows is not None:
                rows.write.mode("append").parquet(f"{root}/{name}")
        joined = answers.correlate_streams(
            t.spark.readStream.schema(requests.schema).parquet(f"{root}/requests"),
            t.spark.readStream.schema(completions.schema).parquet(f"{root}/completions"),
            deadline=timedelta(hours=1),
            lateness=timedelta(days=3650),
        )
        landing.write_stream(joined, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select(
        "evaluation_id", "content_id", "status", "response"
    )


@query("stream_status", FILE_STATUS_SQL)
def stream_status(t: DriverTables) -> DataFrame:
    """Events of files come twice and out of order; the table ends as the batch report."""
    root = scratch_path(t.spark, "stream-status")
    files, chunks, answered, failures, expected = file_status_inputs(t)
    # A chunk is known before its vector is, and an answer is open before it is there.
    events = [
        status.answer_events(answered),
        status.chunk_events(chunks.withColumn("status", F.lit("CHUNKED"))).unionByName(
            status.registered_events(files)
        ),
        status.chunk_events(chunks)
        .unionByName(status.answer_events(answered.withColumn("status", F.lit("processing"))))
        .unionByName(status.failure_events(failures))
        .unionByName(status.expected_events(expected)),
    ]
    for rows in events:
        rows.write.mode("append").parquet(f"{root}/in")
        arriving = t.spark.readStream.schema(status.EVENT_DDL).parquet(f"{root}/in")
        status.status_stream(arriving, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return status.current_status(t.spark, f"{root}/table")


ATTEMPTS_START = datetime(2024, 1, 1)


def _attempted(t: DriverTables, label: str) -> str:
    """Ingestion tasks of all files, of which some fail once, twice or always."""
    root = scratch_path(t.spark, label)
    t.files.select(F.col("id").alias("file_id"), "name").repartition(4).write.parquet(f"{root}/in")

    def work(tasks: DataFrame) -> DataFrame:
        kind = F.col("file_id") % 10
        fails = F.when(kind == 3, 1).when(kind == 4, 2).when(kind == 5, 99).otherwise(0)
        text = F.concat(F.lit("no loader for "), F.col("name"))
        return tasks.withColumn("error", F.when(F.col("attempts") < fails, text))

    arriving = t.spark.readStream.schema("file_id long, name string").parquet(f"{root}/in")
    attempts.attempt_stream(
        arriving, f"{root}/tasks", f"{root}/checkpoint", work, now=ATTEMPTS_START
    ).awaitTermination()
    # The clock jumps to the time the next task is due.
    attempts.finish_waiting(t.spark, f"{root}/tasks", 0, work, wait=lambda due: due)
    return f"{root}/tasks"


@query(
    "task_attempts",
    """SELECT id AS file_id,
         CASE id % 10 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 3 ELSE 1 END AS attempts,
         CASE WHEN id % 10 = 5 THEN 'failed' ELSE 'completed' END AS status,
         CASE WHEN id % 10 = 5 THEN 'no loader for ' || name END AS error
       FROM p_files""",
)
def task_attempts(t: DriverTables) -> DataFrame:
    """Attempts and end of every task, through waiting and dead letters."""
    return attempts.outcomes(t.spark, _attempted(t, "task-attempts"), ["file_id"])


@query(
    "task_dead_letters",
    """SELECT id AS file_id, name, 3 AS attempts, 'no loader for ' || name AS error,
         1704067200 + 30 AS failed_at
       FROM p_files WHERE id % 10 = 5""",
)
def task_dead_letters(t: DriverTables) -> DataFrame:
    """What is given up after three attempts, 10 and 20 seconds apart."""
    dead = landing.stored(t.spark, f"{_attempted(t, 'task-dead-letters')}/dead")
    return dead.select("file_id", "name", "attempts", "error", "failed_at")
