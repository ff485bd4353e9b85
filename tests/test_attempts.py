"""Tasks that fail, wait and are given up."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from foliospark.streaming import attempts, landing

START = datetime(2024, 1, 1)


def work(tasks):
    """Task n succeeds at its n-th further attempt."""
    error = F.when(F.col("attempts") < F.col("file_id"), F.lit("not yet"))
    return tasks.withColumn("error", error)


def tasks(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "file_id long")


def left(spark, path, batch_id):
    return sorted(
        (r.file_id, r.attempts, (r.due_at - START).total_seconds())
        for r in attempts.waiting(spark, path, batch_id + 1).collect()
    )


def test_failed_tasks_wait_longer_each_time_and_become_dead_letters(spark, tmp_path):
    path = str(tmp_path)
    attempts.attempt(tasks(spark, 0, 1, 2, 3), 0, path, work, now=START)
    assert left(spark, path, 0) == [(1, 1, 10), (2, 1, 10), (3, 1, 10)]
    # Nothing is due yet; a new task is.
    attempts.attempt(tasks(spark, 1), 1, path, work, now=START + timedelta(seconds=5))
    assert left(spark, path, 1) == [(1, 1, 10), (1, 1, 15), (2, 1, 10), (3, 1, 10)]
    for _ in range(2):  # a batch run again leaves the same
        attempts.attempt(tasks(spark), 2, path, work, now=START + timedelta(seconds=10))
        assert left(spark, path, 2) == [(1, 1, 15), (2, 2, 30), (3, 2, 30)]
    assert attempts.failures(spark, path) is None
    last = attempts.finish_waiting(spark, path, 2, work, wait=lambda due: due)
    assert last == 4
    found = attempts.outcomes(spark, path, ["file_id"]).collect()
    assert sorted(tuple(r) for r in found) == [
        (0, 1, "completed", None),
        (1, 2, "completed", None),
        (1, 2, "completed", None),
        (2, 3, "completed", None),
        (3, 3, "failed", "not yet"),
    ]
    assert [tuple(r) for r in attempts.failures(spark, path).collect()] == [(3, "not yet")]


def test_a_restarted_stream_goes_on_with_what_waits(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "tasks", "checkpoint"))
    for batch, now in enumerate([START, START + timedelta(seconds=60)]):
        tasks(spark, 10 * batch + 1).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("file_id long").parquet(source)
        attempts.attempt_stream(stream, path, checkpoint, work, now=now, max_attempts=2).awaitTermination()
    done = landing.stored(spark, f"{path}/done")
    assert [(r.file_id, r.attempts) for r in done.collect()] == [(1, 2)]
    assert [r.file_id for r in attempts.waiting(spark, path, 2).collect()] == [11]
