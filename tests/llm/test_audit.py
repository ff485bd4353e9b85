from itertools import permutations
from math import factorial

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from foliospark.llm import audit
from foliospark.llm.queries import ORACLES, QUERIES


def brute(counts, names):
    """Every step of every order, counted over the masks."""
    found = {}
    for order in permutations(range(len(names))):
        left = dict(counts)
        for step, k in enumerate(order, 1):
            gone = {m: w for m, w in left.items() if m >> k & 1}
            left = {m: w for m, w in left.items() if not m >> k & 1}
            failing = sum(w[0] for m, w in counts.items() if m >> k & 1)
            removed = sum(w[0] for w in gone.values())
            found["".join(names[i] for i in order), step] = (
                sum(w[0] for w in left.values()),
                removed,
                failing - removed,
                counts.get(1 << k, (0, 0, 0))[0],
                sum(w[1] for w in gone.values()),
                sum(w[2] for w in gone.values()),
            )
    return found


@pytest.mark.parametrize("filters", [1, 2, 3, 4, 5, 6])
def test_swaps_lead_through_all_orders(filters):
    order, seen = list(range(filters)), set()
    seen.add(tuple(order))
    swaps = list(audit.adjacent_swaps(filters))
    for at in swaps:
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.add(tuple(order))
    assert len(seen) == factorial(filters) == len(swaps) + 1


@pytest.mark.parametrize("seed, filters, masks", [(0, 1, 2), (1, 3, 4), (2, 5, 9), (3, 5, 32), (4, 4, 0)])
def test_diagram_against_counting(seed, filters, masks):
    draw = np.random.RandomState(seed)
    chosen = draw.choice(1 << filters, masks, replace=False) if masks else []
    counts = {}
    for m in chosen:
        n = int(draw.randint(1, 4))
        counts[int(m)] = (n, int(draw.randint(0, n + 1)), int(draw.randint(0, n + 1)))
    names = "ABCDEF"[:filters]
    expected = brute(counts, names)
    rows = audit.every_order(counts, names)
    summed = {}
    for row in rows.itertuples():
        assert tuple(row[3:9]) == expected[row.filter_order, row.step]
        name = row.filter_order[row.step - 1]
        summed[name] = summed.get(name, 0) + row.removed
    assert len(rows) == len(expected)
    assert all(row.shapley == summed[row.filter_order[row.step - 1]] for row in rows.itertuples())


def test_equal_subtrees_are_shared():
    full = audit.Diagram({m: (1, 0, 0) for m in range(32)}, 5)
    assert [len(level) for level in full.levels] == [1] * 5
    sparse = audit.Diagram({0: (7, 0, 0), 31: (2, 1, 0)}, 5)
    for at in audit.adjacent_swaps(5):
        sparse.swap(at)
        assert sum(map(len, sparse.levels)) <= 1 + 4 * 3


def test_query_matches_sql(spark):
    found = QUERIES["op12_audit"](spark, SF_DIR)
    assert compare.difference(found, compare.connect(SF_DIR), ORACLES["op12_audit"]) is None


def test_odd_rows_match_sql(spark, odd_documents):
    labels = spark.createDataFrame(
        [(0, 1, None), (0, 0, 1), (None, 1, 1), (99, 1, 1), (5, None, 0)],
        "doc_id long, quality int, toxic int",
    )
    copies = spark.createDataFrame(
        [(20, "", "en"), (21, None, None), (None, "", "en"), (22, "Ab#\x00\x1c　é", "")],
        "doc_id long, text string, lang string",
    )
    docs = odd_documents.unionByName(copies, allowMissingColumns=True)
    docs = docs.withColumn("good", F.lit("x")).withColumn("mask", F.lit(None).cast("string"))
    found = audit.text_audit(docs, labels)
    assert found.select("part").distinct().count() == 4
    con = compare.connect(SF_DIR)
    con.register("odd", docs.select("doc_id", "text", "lang").toPandas().astype({"doc_id": "Int64"}))
    con.register("odd_labels", labels.toPandas().astype("Int64"))
    sql = ORACLES["op12_audit"].replace("FROM documents", "FROM odd").replace("FROM labels", "FROM odd_labels")
    assert compare.difference(found, con, sql) is None


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    assert audit.text_audit(docs.filter(F.lit(False)), labels).isEmpty()
    unlabelled = audit.text_audit(docs, labels.filter(F.lit(False)))
    assert unlabelled.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0
