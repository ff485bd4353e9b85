"""What a query moves, holds or asks does not outgrow its input."""

import hashlib
import re
from types import SimpleNamespace

import pyarrow as pa
import pytest

from foliospark.plans import catalog
from foliospark.plans.driver_tables import DriverTables, GIVEN_SCHEMAS
from foliospark.sources import loaders, sinks


@pytest.fixture()
def given(spark, tmp_path):
    """A folder of given tables: 40 documents of two projects."""
    texts = ["one page\nand another", "only one", None, "a\n\n \nb\nc"]
    texts[1] = "".join(hashlib.sha256(bytes([n])).hexdigest() for n in range(250))
    documents = [(n, texts[n % 4], "en", f"src_{n % 2}", 10) for n in range(40)]
    spark.createDataFrame(documents, GIVEN_SCHEMAS["documents"]).write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    return str(tmp_path)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_requests_broadcast_questions_however_large_the_documents(spark, given):
    """questions are few whatever the size of the table they are derived from."""
    requests = catalog.queries()["evaluation_requests"](spark, given)
    assert "_slice" not in plan_of(requests)
    assert len(re.findall(r"strategy=broadcast", plan_of(requests))) == 2
    assert requests.count() == 2 * DriverTables(spark, given).pages.count()


def test_tasks_broadcast_questions_when_documents_exceed_the_limit(spark, given):
    """the planned size of the questions is that of their rows."""
    limit = "foliospark.broadcast.maxBytes"
    spark.conf.set(limit, "6000")  # the documents are planned with more
    try:
        answered = catalog.queries()["respond_stub"](spark, given)
        assert "_slice" not in plan_of(answered)
    finally:
        spark.conf.unset(limit)


def test_requests_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    """files of bounded size by the tasks that make the requests."""
    monkeypatch.setattr(sinks, "REQUESTS_PER_FILE", 10)
    requests = spark.range(0, 65, 1, 2).selectExpr("id", "repeat('x', 100) AS text")
    path = f"{tmp_path}/out"
    sinks.write_requests(requests, path)
    written = spark.read.schema("id long, text string").json(path)
    assert sorted(r.id for r in written.collect()) == list(range(65))
    files = [r.n for r in written.groupBy("_metadata.file_name").count().toDF("f", "n").collect()]
    assert len(files) == 8 and max(files) == 10


@pytest.mark.parametrize("limit", [{}, {"PAGES_AT_ONCE": 4}, {"PAGE_CHARS_AT_ONCE": 9}])
def test_pages_leave_a_task_in_bounded_batches(monkeypatch, limit):
    """what a task holds depends neither on the files of a batch nor on their pages."""
    for name, value in limit.items():
        monkeypatch.setattr(loaders, name, value)

    def extractor(data):
        if data is None or data == b"bad":
            raise ValueError("broken")
        return [(page, {"n": page}) for page in data.decode().split()]

    class Files:
        dtypes = [("file_id", "bigint"), ("content", "binary")]
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: SimpleNamespace(run=run)

    contents = [b"ab " * 11, b"bad", b"", None, b"cd " * 3]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(5), pa.int64()), pa.array(contents, pa.binary())], ["file_id", "content"]
    )
    parts = list(loaders.extract_pages(Files(), extractor).run(iter([batch, batch.slice(0, 0)])))
    rows = [tuple(r.values())[:3] for part in parts for r in part.to_pylist()]
    pages = [(0, n, "ab") for n in range(1, 12)] + [(1, None, None), (3, None, None)]
    assert rows == pages + [(4, n, "cd") for n in (1, 2, 3)]
    sizes = [part.num_rows for part in parts]
    assert sizes == {0: [16], 4: [4, 4, 4, 4], 9: [5, 5, 6]}[next(iter(limit.values()), 0)]
