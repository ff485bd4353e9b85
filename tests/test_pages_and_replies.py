"""Keyset pages, files listed in manifests, concurrent replies."""

import asyncio
import time
import uuid
from itertools import product
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foliospark.operators import evaluation as ev
from foliospark.operators.reads import SortKey, page_after
from foliospark.operators.scale import WAVES, spread_evenly
from foliospark.plans import catalog
from foliospark.session import scratch_root
from foliospark.sources import manifests


@pytest.mark.parametrize("descending, nulls_first", list(product([False, True], repeat=2)))
def test_pages_walk_through_the_whole_table(spark, tmp_path, descending, nulls_first):
    rows = [(None if k % 5 == 0 else k % 4, None if k % 3 == 0 else f"n{k % 2}", k) for k in range(37)]
    spark.createDataFrame(rows, "a int, b string, id long").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    keys = [SortKey("a", descending, nulls_first), SortKey("b", not descending, nulls_first), SortKey("id")]
    expected = [tuple(r) for r in table.orderBy(*[k.order() for k in keys]).collect()]
    found, last = [], None
    while page := [tuple(r) for r in page_after(table, keys, last, 7).collect()]:
        found += page
        last = page[-1]
    assert found == expected


def test_the_position_reaches_the_scan(spark, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/t")
    plan = page_after(spark.read.parquet(f"{tmp_path}/t"), [SortKey("id")], [41], 5)
    assert [r.id for r in plan.collect()] == [42, 43, 44, 45, 46]
    assert "GreaterThan(id,41)" in plan._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        page_after(plan, [SortKey("id")], [1, 2])


def test_only_listed_files_are_opened(spark, tmp_path):
    folder = tmp_path / "results" / "run=1"
    folder.mkdir(parents=True)
    for k in range(5):
        (folder / f"SUCCEEDED_{k}.json").write_text(f"line {k}\n")
    # A directory named like a file fails whoever lists or opens it.
    (tmp_path / "results" / "unreadable.gz").write_bytes(b"no gzip")
    keys = spark.createDataFrame([("run=1/SUCCEEDED_1.json",), ("run=1/SUCCEEDED_3.json",), (None,)] * 2, "key string")
    rows = manifests.read_listed(spark, f"{tmp_path}/results", keys).collect()
    assert sorted(tuple(r) for r in rows) == [
        ("line 1", "run=1/SUCCEEDED_1.json"),
        ("line 3", "run=1/SUCCEEDED_3.json"),
    ]
    assert manifests.read_listed(spark, f"{tmp_path}/results", keys.limit(0)).isEmpty()
    missing = spark.createDataFrame([("run=1/none.json",)], "key string")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        manifests.read_listed(spark, f"{tmp_path}/results", missing)


def requests(spark, n):
    return spark.range(n).select(
        "id",
        F.array(F.lit("m")).alias("messages"),
        F.lit("tool").alias("tool_choice"),
        F.struct(F.col("id").cast("string").alias("id")).alias("metadata"),
    )


def test_replies_come_as_they_are_answered_and_fail_alone(spark, tmp_path):
    calls = str(tmp_path)

    async def ask(request):
        number = int(request["metadata"]["id"])
        Path(calls, f"{number}-{uuid.uuid4().hex}").touch()
        if number % 10 == 3:
            raise ValueError("bad")
        if number % 10 == 7:
            await asyncio.sleep(30)
        await asyncio.sleep(0.01 * (number % 3))
        return None if number % 10 == 9 else f"r{number}"

    df = ev.respond_concurrently(requests(spark, 60).coalesce(1), ask, window=20, timeout=0.3)
    start = time.monotonic()
    rows = {r.id: (r.response, r.error) for r in df.collect()}
    # Six time out; one after the other they alone would take 1.8 s, with all others 2.4 s.
    assert time.monotonic() - start < 20
    assert len(rows) == 60 and len(list(tmp_path.iterdir())) == 60
    for number, (response, error) in rows.items():
        if number % 10 == 3:
            assert (response, error) == (None, "ValueError: bad")
        elif number % 10 == 7:
            assert (response, error) == (None, "no answer within 0.3 s")
        else:
            assert (response, error) == (None if number % 10 == 9 else f"r{number}", None)


def test_the_window_is_kept(spark):
    async def ask(request):
        ask.flying = getattr(ask, "flying", 0) + 1
        most = ask.flying
        await asyncio.sleep(0.005)
        ask.flying -= 1
        return str(most)

    for window in (1, 4):
        rows = ev.respond_concurrently(requests(spark, 30).coalesce(1), ask, window=window).collect()
        assert max(int(r.response) for r in rows) == window
    with pytest.raises(ValueError):
        ev.respond_concurrently(requests(spark, 1), ask, window=0)
    assert ev.respond_concurrently(requests(spark, 0), ask).isEmpty()


def test_the_window_is_filled_across_batches(spark):
    """the last answers of a batch do not keep the next one waiting."""

    async def ask(request):
        if int(request["metadata"]["id"]) % 5:
            return "0"
        ask.slow = getattr(ask, "slow", 0) + 1
        await asyncio.sleep(0.5)
        most = ask.slow
        await asyncio.sleep(0.5)
        ask.slow -= 1
        return str(most)

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(setting, "5")
    try:
        rows = ev.respond_concurrently(requests(spark, 22).coalesce(1), ask, window=4).collect()
    finally:
        spark.conf.unset(setting)
    assert sorted(r.id for r in rows) == list(range(22))
    assert all(r.error is None for r in rows)
    assert max(int(r.response) for r in rows) == 2  # two batches at once, and no more


class Caught:
    """Stands for requests; keeps what a task would run."""

    schema = None

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def batches(count, size):
    rows = [
        {"messages": [{"role": "user", "content": f"m{k}"}], "tool_choice": None, "metadata": {"id": str(k)}}
        for k in range(count * size)
    ]
    return [pa.RecordBatch.from_pylist(rows[at : at + size]) for at in range(0, len(rows), size)]


def test_answers_leave_in_few_batches(spark):
    """a batch of rows for each moment's answers cost more than the asking."""

    async def ask(request):
        await asyncio.sleep(0.05)
        return request["messages"][0]["content"]

    run = ev.respond_concurrently(Caught(), ask, window=20, timeout=5)
    parts = list(run(iter(batches(2, 200))))
    assert len(parts) < 16  # 20 times 20 requests are in the air
    rows = [row for part in parts for row in part.to_pylist()]
    assert sorted(int(r["metadata"]["id"]) for r in rows) == list(range(400))
    assert all(r["response"] == f"m{r['metadata']['id']}" and r["error"] is None for r in rows)


def test_the_end_of_a_batch_is_not_waited_for(spark):
    async def ask(request):
        return request["metadata"]["id"]

    run = ev.respond_concurrently(Caught(), ask, window=4)
    start = time.monotonic()
    parts = list(run(iter(batches(60, 5))))
    assert time.monotonic() - start < 60 * ev.GATHER_SECONDS / 4
    assert sorted(int(x) for p in parts for x in p["response"].to_pylist()) == list(range(300))


def test_requests_are_the_same_column_by_column():
    message = pa.struct([("role", pa.string()), ("content", pa.string())])
    kinds = {
        "messages": (pa.list_(message), [[{"role": "a", "content": None}, None], None, [], [{"role": "é", "content": ""}] * 3]),
        "metadata": (
            pa.struct([("id", pa.int64()), ("page", pa.map_(pa.string(), pa.string())), ("tags", pa.list_(pa.string()))]),
            [{"id": 2**60, "page": [("k", None)], "tags": ["x", None]}, None, {"id": None, "page": None, "tags": None}, {"id": 1, "page": [], "tags": []}],
        ),
        "tool_choice": (pa.string(), [None, "", "tool", None]),
        "nothing": (pa.null(), [None] * 4),
        "score": (pa.float64(), [None, 0.5, float("inf"), -1.0]),
    }
    batch = pa.RecordBatch.from_pydict({name: pa.array(rows, kind) for name, (kind, rows) in kinds.items()})
    for rows in (batch, batch.slice(1, 2), batch.slice(3), batch.slice(0, 0)):
        assert ev.python_values(rows.to_struct_array()) == rows.to_pylist()


def test_rows_are_dealt_evenly_whatever_their_keys(spark):
    rows = spark.range(960, numPartitions=3).select(F.when(F.col("id") > 950, F.col("id")).alias("key"))
    dealt = spread_evenly(rows)
    parts = WAVES * spark.sparkContext.defaultParallelism
    counts = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) == parts and max(counts) - min(counts) <= 3
    assert dealt.exceptAll(rows).isEmpty() and rows.exceptAll(dealt).isEmpty()


def test_a_long_document_is_asked_by_all_cores(spark, tmp_path):
    """requests of a document waited for each other in one task."""
    lines = [f"page {k} " + "x" * (k % 9) for k in range(320)]
    spark.createDataFrame(
        [(7, "\n".join(lines), "en", "src_3", 0)], "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    scratch = Path(scratch_root(spark).removeprefix("file:"), "foliospark")
    before = set(scratch.glob("attempts-*"))
    rows = catalog.queries()["respond_concurrent"](spark, str(tmp_path)).collect()
    pages = [700_000 + k + 1 for k in range(320)]
    assert sorted((r.content_id, r.attempts, r.status) for r in rows) == sorted(
        (p, 3 if p % 11 == 5 else 2 if p % 7 == 3 else 1, "failed" if p % 11 == 5 else "completed")
        for p in pages
        for _ in range(2)
    )
    # A task that asked wrote a file of what it asked.
    tables = set(scratch.glob("attempts-*")) - before
    asked = [[pq.read_metadata(f).num_rows for f in t.glob("*.parquet")] for t in tables]
    first = max(asked, key=sum)
    assert sum(first) == 640 and max(first) <= 2 * 640 / spark.sparkContext.defaultParallelism
