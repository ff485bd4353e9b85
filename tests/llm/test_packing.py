import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_DIR
from foliospark.llm import packing
from foliospark.llm.queries import QUERIES


def check_layout(rows, capacity):
    """Sequences are gapless from 0 and not longer than the capacity."""
    held = defaultdict(list)
    for row in rows:
        held[row.sequence_id].append((row.offset, row.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def squares(gaps, capacity):
    return sum(n * n for gap, n in gaps.items() if 0 < gap < capacity)


def test_every_length_goes_where_the_sum_of_squares_grows_least():
    capacity = 12
    lengths = np.random.RandomState(3).randint(1, capacity + 1, 300)
    sequence, offset = packing.place(lengths, capacity)
    level = {}
    for length, chosen, at in zip(lengths.tolist(), sequence.tolist(), offset.tolist()):
        gaps = defaultdict(int)
        for filled in level.values():
            gaps[capacity - filled] += 1
        growths = {}
        for gap in [g for g in gaps if g >= length and gaps[g]] + [capacity]:
            after = defaultdict(int, gaps)
            if gap < capacity:
                after[gap] -= 1
            after[gap - length] += 1
            growths[gap] = squares(after, capacity) - squares(gaps, capacity)
        assert level.get(chosen, 0) == at
        # Closing a gap counts half a square less, hence the tolerance of one.
        assert growths[capacity - at] <= min(growths.values()) + 1
        level[chosen] = at + length


def test_query_pieces_against_the_library(spark, vocabulary):
    library = Tokenizer.from_file(vocabulary)
    rows = QUERIES["op2_pack"](spark, SF_DIR).collect()
    by_doc = defaultdict(list)
    for row in rows:
        by_doc[row.doc_id].append(row)
    texts = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    total = 0
    for doc_id, text in texts:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // 2048)))
        at = 0
        for p in pieces:
            assert p.start == at
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
        assert all(p.length == 2048 for p in pieces[1:])
    used = check_layout(rows, 2048)
    assert used <= 1.02 * -(-total // 2048) + 1


def test_odd_rows(odd_documents, vocabulary):
    rows = packing.pack_documents(odd_documents, vocabulary, 64).collect()
    check_layout(rows, 64)
    pieces = [r for r in rows if r.doc_id == 1]
    assert [(r.piece, r.start, r.length) for r in pieces] == [(0, 0, 1)]
    assert len([r for r in rows if r.doc_id == 0 and r.piece == 0]) == 2
    assert packing.pack_documents(
        odd_documents.filter(F.lit(False)), vocabulary, 64
    ).isEmpty()


def test_many_groups_of_equal_rows(spark):
    rows = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(5).alias("length"))
    packed = packing.pack(rows, 16, group_pieces=500).collect()
    assert len(packed) == 5000
    assert check_layout(packed, 16) <= 5000 / 3 + 12


def test_wrong_lengths_raise(spark):
    rows = spark.createDataFrame([(1, 17)], "doc_id long, length long")
    with pytest.raises(Exception, match="capacity"):
        packing.pack(rows, 16).collect()
