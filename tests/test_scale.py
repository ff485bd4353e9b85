"""Hot keys, bucketed sequences and the plans behind them."""

import random

import __spark_entry__ as entry
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_DIR
from foliospark.operators import reports, scale
from foliospark.operators.search import SearchRequest, similarity_hits, with_neighbors
from foliospark.plans.driver_tables import DriverTables

QUERIES = entry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark):
    """Numbers with gaps and ties; file 0 holds a third of all rows."""
    rng = random.Random(3)
    rows = [
        (i, 0 if i % 3 == 0 else rng.randrange(1, 9), rng.randrange(1, 400))
        for i in range(1500)
    ]
    return spark.createDataFrame(rows, "id long, file_id long, number int").cache()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(shuffled, hot, how):
    side = shuffled.range(0, 5).select(
        F.col("id").alias("file_id"), (F.col("id") * 7).alias("extra")
    )
    salted = scale.join_dimension(hot, side, ["file_id"], how, ["id"])
    plain = hot.join(side, ["file_id"], how)
    assert "_slice" in plan(salted)
    assert sorted(salted.collect()) == sorted(plain.select(*salted.columns).collect())


def test_small_side_is_broadcast(spark, hot):
    side = spark.range(0, 5).select(F.col("id").alias("file_id"))
    assert "_slice" not in plan(scale.join_dimension(hot, side, ["file_id"]))


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_offsets_are_running_totals(spark, hot, width):
    unique = hot.dropDuplicates(["file_id", "number"]).withColumn("size", F.col("id") % 5)
    before = (
        Window.partitionBy("file_id")
        .orderBy("number")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    wanted = unique.select(
        "file_id", "number", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("at")
    )
    found = scale.offsets_in_group(
        unique.select("file_id", "number", "size"), ["file_id"], "number", "size", "at", width
    ).select("file_id", "number", "at")
    assert sorted(found.collect()) == sorted(wanted.collect())


def test_offsets_read_their_input_once(spark):
    rows = spark.range(100).selectExpr("id % 7 AS file_id", "int(id) AS number", "id AS size")
    found = scale.offsets_in_group(rows, ["file_id"], "number", "size", "at")
    found.collect()
    assert "Reused" in plan(found)


@pytest.mark.parametrize("width", [1, 5, 64, 4096])
@pytest.mark.parametrize("before,after", [(1, 1), (0, 3), (7, 0)])
def test_bucketed_frame_is_the_range_frame(spark, hot, width, before, after):
    frame = Window.partitionBy("file_id").orderBy("number").rangeBetween(-before, after)
    wanted = hot.select("id", F.sort_array(F.collect_list("id").over(frame)).alias("ids"))
    found = scale.range_frame(
        hot, ["file_id"], "number", before, after, "id", "ids", width
    ).select("id", F.sort_array("ids").alias("ids"))
    assert sorted(found.collect()) == sorted(wanted.collect())


def test_neighbors_by_number_equal_the_frame(shuffled, hot):
    hits = hot.filter(F.col("id") % 50 == 0).select(
        F.col("id").alias("hit_id"), "file_id", F.col("number").alias("hit_number"),
        F.lit(0.5).alias("score"),
    )
    rows = hot.select(F.col("id").alias("row_id"), "file_id", F.col("number").alias("row_number"))
    found = with_neighbors(hits, rows, 2, 1).filter("is_neighbor").select(
        "neighbor_from", "row_id"
    )
    frame = Window.partitionBy("file_id").orderBy("number").rangeBetween(-2, 1)
    wanted = (
        hot.withColumn("ids", F.collect_list("id").over(frame))
        .filter(F.col("id") % 50 == 0)
        .select("id", F.explode("ids").alias("row_id"))
        .filter("id != row_id")
    )
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_latest_per_key_combines_before_the_shuffle(spark, hot):
    latest = scale.latest_per_key(hot, ["file_id"], [F.col("number"), F.col("id")])
    text = plan(latest)
    assert "partial_max_by" in text and "Window" not in text
    newest = {}
    for row in hot.collect():
        key = newest.get(row.file_id)
        if key is None or (row.number, row.id) > (key.number, key.id):
            newest[row.file_id] = row
    assert sorted(latest.collect()) == sorted(newest.values())


def test_top_k_needs_no_shuffle(spark):
    tables = DriverTables(spark, SF_DIR)
    chunks = tables.read("embeddings").select(
        F.col("vec_id").alias("id"), F.lit(1).alias("file_id"), F.lit(1).alias("content_id"),
        F.col("label").alias("chunk_number"), F.lit("p").alias("project_id"), "embedding",
    )
    request = SearchRequest(tables.query_vector(), limit=5)
    text = plan(similarity_hits(chunks, None, request))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_project_filter_reaches_the_scan(spark):
    text = plan(QUERIES["files_by_project"](spark, SF_DIR))
    assert "EqualTo(source,src3)" in text


def test_reports_do_not_read_texts(spark):
    text = plan(QUERIES["project_stats"](spark, SF_DIR))
    assert "ReadSchema" in text and "text:string" not in text


@pytest.mark.parametrize(
    "name",
    [n for n in sorted(QUERIES) if not n.startswith("stream_") and "cascade" not in n],
)
def test_no_query_has_a_nested_loop_or_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_a_threshold_scores_every_vector_once(spark):
    t = DriverTables(spark, SF_DIR)
    request = SearchRequest(t.query_vector(), limit=5, score_threshold=0.1)
    hits = similarity_hits(t.chunks, None, request)
    assert plan(hits).count("ArrowEvalPython") == 1


def test_a_file_filter_reaches_answers_and_pages(spark, tmp_path):
    t = DriverTables(spark, SF_DIR)
    tables = {}
    for name in ("answers", "pages", "files", "evaluations"):
        getattr(t, name).write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    detail = reports.answers_detail(
        tables["answers"], tables["files"], tables["evaluations"], tables["pages"]
    )
    shown = plan(reports.answers_by_file(detail, "src5", 5))
    for column in ("response", "content_metadata"):
        scan = next(line for line in shown.splitlines() if "FileScan" in line and column in line)
        assert "EqualTo(file_id,5)" in scan
