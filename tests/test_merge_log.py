"""The merge log against sequential merging."""

import random
from pathlib import Path

import pytest

from foliospark.operators.maintenance import upsert_answers
from foliospark.streaming import landing, merge_log

DDL = (
    "id string, evaluation_id long, content_id long, response string, "
    "created_at timestamp, updated_at timestamp"
)


def answers(spark, rows):
    """Rows of (id, key, response, seconds)."""
    values = [(i, k % 3, k, r, at, at) for i, k, r, at in rows]
    plain = DDL.replace("timestamp", "long")
    return spark.createDataFrame(values, plain).selectExpr(
        "id", "evaluation_id", "content_id", "response",
        "timestamp_seconds(created_at) AS created_at", "timestamp_seconds(updated_at) AS updated_at",
    )


def rows_of(df):
    return sorted(tuple(row) for row in df.collect())


def written(path):
    return {f.parent for f in Path(path).glob("bucket=*/version=*/part-*")}


@pytest.mark.parametrize("share", [0.0, 0.3, 100.0])
def test_reading_equals_merging_batch_by_batch(spark, tmp_path, share):
    draw = random.Random(3)
    first = answers(spark, [(f"a{k}", k, "first", k) for k in range(40)] + [("b5", 5, "twice", 90)])
    table = landing.answers_log(first, str(tmp_path))
    merge_log.start(table, first)
    expected = upsert_answers(first, first.limit(0))
    for batch in range(4):
        keys = [draw.randrange(60) for _ in range(9)]
        change = answers(spark, [(f"c{batch}-{n}", k, f"r{batch}", draw.randrange(99)) for n, k in enumerate(keys)])
        for _ in range(2):  # every batch comes twice
            merge_log.append_changes(table, change, batch)
            merge_log.compact(table, spark, share)
        expected = spark.createDataFrame(upsert_answers(expected, change).collect(), expected.schema)
        assert rows_of(merge_log.current(table, spark)) == rows_of(expected)


def test_a_small_batch_writes_its_rows_and_nothing_else(spark, tmp_path):
    first = answers(spark, [(f"a{k}", k, "first", k) for k in range(2000)])
    table = landing.answers_log(first, str(tmp_path))
    merge_log.start(table, first)
    base = written(table.base)
    change = answers(spark, [(f"c{k}", k, "new", 5000 + k) for k in range(10)])
    merge_log.append_changes(table, change, 0)
    assert spark.read.parquet(table.log).count() == 10
    assert merge_log.compact(table, spark) == []
    assert written(table.base) == base
    assert merge_log.current(table, spark).filter("response = 'new'").count() == 10


def test_compaction_rewrites_one_bucket_and_removes_what_it_replaced(spark, tmp_path):
    first = answers(spark, [(f"a{k}", k, "first", k) for k in range(320)])
    table = landing.answers_log(first, str(tmp_path))
    merge_log.start(table, first)
    hot = first.withColumn("b", table.bucket()).filter("b = 3").drop("b")
    for batch in range(3):
        merge_log.append_changes(table, hot, batch)
        assert merge_log.compact(table, spark) == [3]
        kept = {p.name for p in written(table.base) if p.parent.name == "bucket=3"}
        # The version before stays for readers that have it open, older ones are gone.
        assert kept == {f"version={v}" for v in (batch - 1, batch)}
        assert rows_of(merge_log.current(table, spark)) == rows_of(first)
    assert len(written(table.log)) <= 2
    assert {p.name for p in written(table.base) if p.parent.name != "bucket=3"} == {"version=-1"}


def test_an_empty_table_and_new_keys(spark, tmp_path):
    empty = answers(spark, [("x", 1, "r", 1)]).filter("id = 'none'")
    table = landing.answers_log(empty, str(tmp_path))
    merge_log.start(table, empty)
    assert rows_of(merge_log.current(table, spark)) == []
    change = answers(spark, [("c", 7, "new", 5)])
    merge_log.append_changes(table, change, 0)
    assert rows_of(merge_log.current(table, spark)) == rows_of(change)
    merge_log.compact(table, spark)
    assert rows_of(merge_log.current(table, spark)) == rows_of(change)
