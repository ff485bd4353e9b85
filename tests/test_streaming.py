"""Streams survive redelivery and restarts."""

from datetime import datetime, timedelta

from foliospark.streaming import answers, landing, status


def test_a_repeated_batch_is_stored_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    spark.range(10).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long").parquet(source)
    landing.log_batches(stream(), out, checkpoint).awaitTermination()
    # as if the job had died after the write and before the commit
    (tmp_path / "checkpoint" / "commits" / "0").unlink()
    for crc in (tmp_path / "checkpoint" / "commits").glob(".0.crc"):
        crc.unlink()
    landing.log_batches(stream(), out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 10


def test_new_files_continue_the_stream(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for start in (0, 5):
        spark.range(start, start + 5).write.mode("append").parquet(source)
        landing.log_batches(
            spark.readStream.schema("id long").parquet(source), out, checkpoint
        ).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(10))


def test_barrier_fires_once_with_the_last_item_however_late(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    items = [("w", 0, 1, p, 3) for p in (1, 2, 3)] + [("v", 0, 1, 1, 2)]
    schema = "workflow_id string, level int, evaluation_id long, content_id long, expected long"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        answers.level_barrier(stream, out, checkpoint).awaitTermination()
        fired = landing.stored(spark, f"{out}/fired")
        return [] if fired is None else sorted(tuple(r)[:3] for r in fired.collect())

    assert arrive(items[:2] + items[:2]) == []
    assert arrive(items[3:]) == []
    assert arrive(items[:1] + items[2:3]) == [("w", 0, 3)]
    assert arrive(items[2:3]) == [("w", 0, 3)]


def test_keys_are_stored_once_across_batches_and_repeats(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "message_id string, record int, key string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        landing.store_once(stream, landing.MESSAGE_KEYS, out, checkpoint).awaitTermination()
        return sorted(r.key for r in spark.read.parquet(out).collect())

    assert arrive([("a", 0, "x"), ("a", 0, "x"), (None, None, "n")]) == ["n", "x"]
    assert arrive([("a", 0, "x"), ("a", 1, "y"), (None, None, "n")]) == ["n", "x", "y"]
    # as if the job had died after the write and before the commit
    (tmp_path / "checkpoint" / "commits" / "1").unlink()
    for crc in (tmp_path / "checkpoint" / "commits").glob(".1.crc"):
        crc.unlink()
    assert arrive([("b", 0, "z")]) == ["n", "x", "y", "z"]


def test_forgotten_keys_are_looked_up_in_the_table(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "message_id string, record int, sent_at timestamp"
    now = datetime.now()
    days = {"new": now - timedelta(days=1), "old": now - timedelta(days=90), "none": None}

    def arrive(rows):
        rows = [(name, 0, days[age]) for name, age in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        landing.store_once(
            stream, landing.MESSAGE_KEYS, out, checkpoint, sent_at="sent_at", ttl=timedelta(days=30)
        ).awaitTermination()
        return sorted(r.message_id for r in spark.read.parquet(out).collect())

    assert arrive([("a", "new"), ("b", "old"), ("b", "old")]) == ["a", "b"]
    assert arrive([("a", "new"), ("b", "old"), ("c", "none"), ("d", "old")]) == ["a", "b", "c", "d"]


def test_the_table_settles_what_the_state_has_forgotten(spark, tmp_path):
    """With a time to live of nothing, only the table is left to know a key."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "message_id string, record int, sent_at timestamp"
    sent = datetime.now() - timedelta(days=1)
    for names, expected in [("ab", ["a", "b"]), ("bca", ["a", "b", "c"])]:
        rows = [(n, 0, sent) for n in names]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        landing.store_once(
            spark.readStream.schema(schema).parquet(source),
            landing.MESSAGE_KEYS,
            out,
            checkpoint,
            sent_at="sent_at",
            ttl=timedelta(milliseconds=1),
        ).awaitTermination()
        assert sorted(r.message_id for r in spark.read.parquet(out).collect()) == expected


def test_a_level_with_many_items_fires_with_all_of_them(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "workflow_id string, level int, evaluation_id long, content_id long, expected long"
    seen = []
    for first in (0, 1500, 1500):
        rows = spark.range(first, first + 1500).selectExpr(
            "'w' AS workflow_id", "0 AS level", "7L AS evaluation_id", "id AS content_id", "3000L AS expected"
        )
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        answers.level_barrier(
            stream, out, checkpoint, lambda items: items.select("content_id")
        ).awaitTermination()
        tasks = landing.stored(spark, f"{out}/tasks")
        seen.append(0 if tasks is None else tasks.count())
    assert seen == [0, 3000, 3000]


def test_requests_meet_their_completions_or_expire_once(spark, tmp_path):
    asked, given, out, checkpoint = (str(tmp_path / n) for n in ("q", "c", "out", "checkpoint"))
    ddl = "evaluation_id long, content_id long, {} timestamp"
    start = datetime(2024, 1, 1)

    def arrive(requests, completions):
        for rows, path, name in ((requests, asked, "requested_at"), (completions, given, "completed_at")):
            rows = [(e, p, start + timedelta(minutes=m)) for e, p, m in rows]
            spark.createDataFrame(rows, ddl.format(name)).coalesce(1).write.mode("append").parquet(path)
        joined = answers.correlate_streams(
            spark.readStream.schema(ddl.format("requested_at")).parquet(asked),
            spark.readStream.schema(ddl.format("completed_at")).parquet(given),
            deadline=timedelta(minutes=30),
            lateness=timedelta(minutes=100),
        )
        landing.write_stream(joined, out, checkpoint).awaitTermination()
        rows = spark.read.schema(joined.schema).parquet(out).collect()
        return sorted((r.evaluation_id, r.content_id, r.status) for r in rows)

    # Answered at once, after the deadline, and before it was asked.
    first = arrive([(1, 1, 0), (1, 2, 0), (1, 3, 10)], [(1, 1, 5), (1, 1, 5), (1, 2, 31), (1, 3, 9)])
    assert first == [(1, 1, "answered")]
    # A late request meets the completion that waits for it.
    second = arrive([(2, 7, 50)], [(2, 7, 60), (1, 1, 5), (1, 3, 20)])
    assert second == [(1, 1, "answered"), (1, 3, "answered"), (2, 7, "answered")]
    # Time goes on: what was not answered expires, once.
    third = arrive([(9, 9, 5000)], [(9, 8, 5000)])
    assert third == [(1, 1, "answered"), (1, 2, "expired"), (1, 3, "answered"), (2, 7, "answered")]
    assert arrive([(9, 10, 5001)], [(9, 8, 5001)]) == third


def test_status_follows_events_that_repeat_and_restart(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), status.EVENT_DDL).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(status.EVENT_DDL).parquet(source)
        status.status_stream(stream, out, checkpoint).awaitTermination()
        return {r.id: (r.status, r.n_chunks, r.n_embedded, r.n_answers) for r in status.current_status(spark, out).collect()}

    registered = (1, "registered", None, None, "pending")
    assert arrive(registered, registered) == {1: ("pending", 0, 0, 0)}
    assert arrive((1, "chunk", "a", 0, None), (1, "chunk", "b", 1, None))[1] == ("embedding", 2, 1, 0)
    assert arrive((1, "chunk", "a", 1, None), (1, "chunk", "b", 0, None))[1] == ("embedded", 2, 2, 0)
    assert arrive((1, "expected", None, 1, None), (1, "answer", "7:1", 1, None))[1] == ("failed", 2, 2, 1)
    assert arrive((1, "answer", "7:1", 2, None), (2, "answer", "7:1", 0, None)) == {
        1: ("completed", 2, 2, 1),
        2: ("evaluating", 0, 0, 1),
    }
    assert arrive((1, "failure", None, None, "gone"))[1][0] == "failed"


def test_status_keeps_no_state_and_runs_no_python_for_its_events(spark, tmp_path):
    """a batch is folded by Spark and logged once, whatever has been stored."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), status.EVENT_DDL).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(status.EVENT_DDL).parquet(source)
        query = status.status_stream(stream, out, checkpoint)
        query.awaitTermination()
        assert query.lastProgress.stateOperators == []

    arrive(
        (1, "registered", None, None, "pending"),
        (1, "registered", None, None, "evaluating"),
        (1, "failure", None, None, "b"),
        (1, "failure", None, None, "a"),
        (1, "failure", None, None, None),
        (None, "chunk", "x", 1, None),
    )
    arrive((2, "expected", None, 2, None), (2, "answer", "7:1", 2, None), (2, "answer", "8:1", 0, None))
    arrive((2, "expected", None, 1, None), (1, "failure", None, None, "c"), (3, "failure", None, None, None))
    arrive((1, "registered", None, None, None))
    rows = {r.id: tuple(r)[1:] for r in status.current_status(spark, out).collect()}
    assert rows == {
        None: (None, 1, 1, 0, None, "embedded"),
        1: (None, 0, 0, 0, "a", "failed"),
        2: (None, 0, 0, 2, None, "completed"),
        3: (None, 0, 0, 0, None, None),
    }


def test_the_barrier_holds_open_levels_only_and_fires_them_once(spark, tmp_path):
    """the state knows the keys; items of open levels wait in a table."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "workflow_id string, level int, evaluation_id long, content_id long, expected long"

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        query = answers.level_barrier(spark.readStream.schema(schema).parquet(source), out, checkpoint)
        query.awaitTermination()
        assert [state.operatorName for state in query.lastProgress.stateOperators] == ["dedupe"]
        last = max(int(p.name) for p in (tmp_path / "out" / "open").iterdir())
        assert len(list((tmp_path / "out" / "open").iterdir())) <= 2
        left = landing.stored(spark, f"{out}/open/{last}")
        fired = landing.stored(spark, f"{out}/fired")
        return (
            sorted(str(r.workflow_id) for r in left.collect()) if left is not None else [],
            sorted((str(r.workflow_id), r.finished) for r in fired.collect()) if fired is not None else [],
        )

    assert arrive(("w", 0, 1, 1, 2), (None, 0, 1, 1, 2), ("v", 0, 1, 1, None)) == (["None", "w"], [("v", 1)])
    assert arrive(("w", 0, 1, 2, 3), ("v", 0, 1, 2, None)) == (["None", "w", "w"], [("v", 1)])
    # as if the job had died after the write and before the commit
    (tmp_path / "checkpoint" / "commits" / "1").unlink()
    for crc in (tmp_path / "checkpoint" / "commits").glob(".1.crc"):
        crc.unlink()
    fired = [("None", 2), ("v", 1), ("w", 3)]
    assert arrive((None, 0, 1, 2, 2), ("w", 0, 1, 3, 1)) == ([], fired)
    assert arrive((None, 0, 1, 3, 1), ("w", 0, 1, 4, 1), ("w", 0, 1, 4, 1)) == ([], fired)


def test_items_leave_the_barrier_as_they_came(spark, tmp_path):
    """columns of any kind, line breaks, nulls and times to the microsecond."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = (
        "workflow_id string, level int, evaluation_id long, content_id long, expected int, "
        "text string, at timestamp, more struct<a: array<double>, b: map<string, date>>"
    )
    at = datetime(2024, 5, 6, 7, 8, 9, 123456)
    items = [
        ("w", 0, 1, 1, 3, 'a\nb\r"\\ é', at, ([0.1, None, float("inf")], {"k": at.date(), "n": None})),
        ("w", 0, 1, None, 3, None, None, None),
        ("w", 0, 2**62 + 1, 2, None, "", at, (None, None)),
    ]
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    for rows in (items[:2], items[1:]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        answers.level_barrier(stream(), out, checkpoint, lambda given: given).awaitTermination()
    given = spark.createDataFrame(items, schema).collect()
    tasks = landing.stored(spark, f"{out}/tasks").drop("batch_id").select(*given[0].__fields__)
    assert sorted(map(repr, tasks.collect())) == sorted(map(repr, given))
