from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from foliospark.session import materialise
from test_minhash import brute_classes
from test_packing import check_layout


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returns, each on its predecessor's rows."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF_DIR), name)
        found.append(docs)
    return found


def test_stages_return_the_columns_of_documents(kept):
    for docs in kept[:-1]:
        assert docs.dtypes == kept[0].dtypes


def test_the_first_stages_keep_clean_documents(kept):
    documents, clear, good, *_ = kept
    assert clear.count() == documents.count()  # all given texts are of clear languages
    labels = documents.sparkSession.read.parquet(f"{SF_DIR}/labels.parquet")
    labelled = documents.join(labels, "doc_id").withColumn("words", F.size(F.split("text", r"\s+")))
    clean = labelled.filter("quality = 1 AND words > 60")
    assert clean.join(good, "doc_id", "left_anti").count() <= 0.05 * clean.count()
    assert good.join(labels.filter("quality = 0"), "doc_id").count() <= 2


def test_one_of_each_class_stays(kept):
    before = sorted((r.doc_id, r.text) for r in kept[2].collect())
    groups = defaultdict(list)
    for (key, _), label in zip(before, brute_classes(before)):
        groups[label].append(key)
    assert sorted(r.doc_id for r in kept[3].collect()) == sorted(map(min, groups.values()))


def test_run_packs_what_stays(spark, kept):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    check_layout(rows, 2048)
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept[3].collect()}
    assert len(rows) == kept[4].count()


def test_odd_rows_and_empty_tables(spark, odd_documents):
    for docs in (odd_documents, odd_documents.filter(F.lit(False))):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialise(stage(spark, docs, SF_DIR), name)
            assert docs.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
