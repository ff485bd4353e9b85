import re
from collections import Counter

import compare
import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from foliospark.llm import sharding
from foliospark.llm.queries import ORACLES, QUERIES, SHARDS


def brute_table(names, size):
    """Whole preference lists, then turns."""
    orders = []
    for name in names:
        offset = sharding.name_hash(name, "offset") % size
        step = sharding.name_hash(name, "step") % (size - 1) + 1
        orders.append(iter([(offset + k * step) % size for k in range(size)]))
    slots = {}
    while len(slots) < size:
        for shard, order in enumerate(orders):
            if len(slots) < size:
                slots[next(s for s in order if s not in slots)] = shard
    return [slots[k] for k in range(size)]


def test_table_against_whole_preference_lists():
    names = [f"s{k}" for k in range(7)]
    assert sharding.fill_table(names, 1009) == brute_table(names, 1009)


def test_shares_and_changes():
    whole = sharding.fill_table(SHARDS)
    shares = Counter(whole)
    assert max(shares.values()) - min(shares.values()) <= 1
    fewer = sharding.fill_table(SHARDS[:-1])
    moved = sum(a != b for a, b in zip(whole, fewer) if a != len(SHARDS) - 1)
    assert moved < 0.1 * len(whole)
    weighted = Counter(sharding.fill_table(["a", "b"], 101, [3, 1]))
    assert weighted[0] in (75, 76)


@pytest.mark.parametrize("names, size", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_wrong_tables_raise(names, size):
    with pytest.raises(ValueError):
        sharding.fill_table(names, size)


def test_query_matches_sql(spark):
    found = QUERIES["op9_shards"](spark, SF_DIR)
    assert compare.difference(found, compare.connect(SF_DIR), ORACLES["op9_shards"]) is None
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().toString())


def test_odd_rows(odd_documents):
    rows = odd_documents.withColumn("shard", F.lit("clash"))
    found = sharding.assign(rows, ["a", "b", "c"], ["doc_id"], 101).collect()
    assert len(found) == rows.count()
    assert len({r.shard for r in found if r.doc_id == 0}) == 1
    assert len({r.slot for r in found if r.doc_id is None}) == 1
    assert sharding.assign(rows.filter(F.lit(False)), ["a"], ["doc_id"]).isEmpty()


def test_written_shards(spark, tmp_path):
    rows = sharding.assign(spark.range(500), ["a", "b", "c"], ["id"], 101)
    sharding.write_shards(rows, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 500
    assert back.select("shard").distinct().count() == 3
