"""Tasks that are tried again, and what is left of them in the end.

A task carries its attempts and the time it is due. A batch works on the new tasks and on
the waiting ones that are due; what fails waits longer each time, and after
``MAX_ATTEMPTS`` it becomes a dead letter. Every batch writes three tables below its
number: ``done``, ``waiting`` (all tasks still to be done after it) and ``dead``. A batch
run again reads what the one before it left and overwrites its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.session import materialise
from foliospark.streaming import landing

# --- fixed values: attempts -----------------------------------------------------
MAX_ATTEMPTS = 3
# ------------------------------------------------------------------------------
FIRST_DELAY = timedelta(seconds=10)
COUNTERS = ("attempts", "due_at", "error")

# Adds ``error`` to tasks, NULL where the work succeeded, and any results.
Work = Callable[[DataFrame], DataFrame]


def attempt(
    tasks: DataFrame,
    batch_id: int,
    path: str,
    work: Work,
    max_attempts: int = MAX_ATTEMPTS,
    delay: timedelta = FIRST_DELAY,
    now: datetime | None = None,
) -> None:
    """One batch: ``tasks`` are the new ones, without the ``COUNTERS``.

    The n-th failure of a task makes it wait for ``delay`` times 2 to the n-1.
    """
    spark = tasks.sparkSession
    at = F.lit(now or datetime.now()).cast("timestamp")
    columns = tasks.columns
    fresh = tasks.withColumn("attempts", F.lit(0)).withColumn("due_at", at)
    left = waiting(spark, path, batch_id)
    later = None
    if left is not None:
        left = left.drop("error")
        later = left.filter(F.col("due_at") > at)
        fresh = fresh.unionByName(left.filter(F.col("due_at") <= at))
    # Written first, so that nothing is worked on twice in a batch.
    tried = materialise(
        work(fresh).withColumn("attempts", F.col("attempts") + 1), "attempts"
    )
    failed = tried.filter(F.col("error").isNotNull())
    landing.write_batch(
        tried.filter(F.col("error").isNull()).drop("error", "due_at"), batch_id, f"{path}/done"
    )
    dead = failed.filter(F.col("attempts") >= max_attempts)
    landing.write_batch(
        dead.select(*columns, "attempts", "error", at.alias("failed_at")), batch_id, f"{path}/dead"
    )
    wait = F.make_dt_interval(
        secs=F.lit(delay.total_seconds()) * F.pow(F.lit(2), F.col("attempts") - 1)
    )
    again = failed.filter(F.col("attempts") < max_attempts)
    again = again.select(*columns, "attempts", (at + wait).alias("due_at"), "error")
    if later is not None:
        again = again.unionByName(later.withColumn("error", F.lit(None).cast("string")))
    # A batch that leaves nothing says so with an empty file.
    again.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
        f"{path}/waiting/{batch_id}"
    )


def waiting(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What the batch before ``batch_id`` left to be done."""
    left = landing.stored(spark, f"{path}/waiting/{batch_id - 1}")
    return None if left is None else left.drop("batch_id")


def attempt_stream(
    stream: DataFrame, path: str, checkpoint: str, work: Work, **options
) -> StreamingQuery:
    """New tasks as a stream; each batch also tries the waiting ones that are due."""
    return landing.run_batches(
        stream, lambda batch, batch_id: attempt(batch, batch_id, path, work, **options), checkpoint
    )


def finish_waiting(
    spark: SparkSession,
    path: str,
    batch_id: int,
    work: Work,
    wait: Callable[[datetime], datetime],
    **options,
) -> int:
    """Batches without new tasks, until nothing waits; the number of the last one.

    ``batch_id`` is the last batch. ``wait`` gets the time the next task is due and
    returns the time when it has come.
    """
    while True:
        left = waiting(spark, path, batch_id + 1)
        due = left.agg(F.min("due_at")).first()[0] if left is not None else None
        if due is None:
            return batch_id
        batch_id += 1
        none = left.drop(*COUNTERS).limit(0)
        attempt(none, batch_id, path, work, now=wait(due), **options)


def outcomes(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Each finished task: ``attempts``, ``status`` (completed, failed) and ``error``."""
    parts = []
    for folder, status in (("done", "completed"), ("dead", "failed")):
        rows = landing.stored(spark, f"{path}/{folder}")
        if rows is not None:
            error = F.col("error") if folder == "dead" else F.lit(None).cast("string")
            parts.append(
                rows.select(*keys, "attempts", F.lit(status).alias("status"), error.alias("error"))
            )
    if not parts:
        raise ValueError("no task has finished")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def failures(spark: SparkSession, path: str) -> DataFrame | None:
    """Dead letters as the failures that a file's status is derived from."""
    dead = landing.stored(spark, f"{path}/dead")
    return None if dead is None else dead.select("file_id", "error")
