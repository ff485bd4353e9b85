import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from foliospark.llm import repeats
from foliospark.llm.queries import QUERIES


def brute(rows, length):
    """Removed spans and kept bytes of each (id, text), window by window."""
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, data in texts:
        for s in range(len(data) - length + 1 if i is not None else 0):
            window = data[s : s + length]
            least[window] = min(i, least.get(window, i))
    found = []
    for i, data in texts:
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1 if i is not None else 0):
            if least[data[s : s + length]] < i:
                gone[s : s + length] = b"\1" * length
        spans, kept = [], bytes(b for b, g in zip(data, gone) if not g)
        at = 0
        while at < len(gone):
            end = at
            while end < len(gone) and gone[end] == gone[at]:
                end += 1
            if gone[at]:
                spans.append((at, end))
            at = end
        found.append((i, len(data), tuple(spans), kept))
    return sorted(found, key=repr)


def collected(df):
    return sorted(
        (
            (row[0], row.n_bytes, tuple((s.start, s.stop) for s in row.spans), bytes(row.kept))
            for row in df.collect()
        ),
        key=repr,
    )


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def invented(seed, many, letters="ab ", longest=60):
    """Texts over few letters that copy parts of each other."""
    draw = random.Random(seed)
    texts = []
    for _ in range(many):
        text = ""
        while len(text) < draw.randint(0, longest):
            if texts and draw.random() < 0.6:
                other = draw.choice(texts)
                at = draw.randint(0, len(other))
                text += other[at : at + draw.randint(1, 30)]
            else:
                text += "".join(draw.choice(letters) for _ in range(draw.randint(1, 12)))
        texts.append(text)
    ids = list(range(many))
    draw.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 20, 50])
def test_rolling_hashes_are_those_of_the_bytes(width):
    data = np.frombuffer(b"abracadabra " * 9, np.uint8)
    found = repeats.rolling_hashes(data, width)
    assert len(found) == len(data) - width + 1
    whole = data.tobytes()
    by_text = {}
    for s, value in enumerate(found.tolist()):
        assert by_text.setdefault(whole[s : s + width], value) == value
    assert len(set(by_text.values())) == len(by_text)


def test_sliding_least():
    values = np.random.RandomState(1).randint(0, 99, 200).astype(np.uint64)
    for span in (1, 2, 3, 8, 31):
        expected = [min(values[s : s + span]) for s in range(len(values) - span + 1)]
        assert repeats.sliding_least(values, span).tolist() == expected


def test_squeezed_numbers():
    for values in ([], [0], [5, 3, -(2**63), 2**63 - 1, 7], range(1000)):
        values = np.array(values, np.int64)
        assert repeats.unsqueeze(repeats.squeeze(values)).tolist() == values.tolist()


@pytest.mark.parametrize("seed, length", [(1, 5), (2, 8), (3, 12), (4, 2), (5, 1)])
def test_against_all_windows(spark, monkeypatch, seed, length):
    # Small blocks and buckets, so that windows meet both inside and across them.
    rows = invented(seed, 80)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 400)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 500)
    assert collected(repeats.remove_repeats(frame(spark, rows), length=length)) == brute(rows, length)


def test_windows_of_hot_triggers_are_dealt_alone(spark, monkeypatch):
    rows = [(k, f"{k:03d} the common line of all {k * 7919 % 1000:03d} " + "xy" * 20) for k in range(60)]
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 300)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 600)
    monkeypatch.setattr(repeats, "HOT", 10)
    assert collected(repeats.remove_repeats(frame(spark, rows), length=14)) == brute(rows, 14)


def test_query_against_all_windows(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    expected = {
        i: (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
        for i, n, spans, kept in brute([tuple(r) for r in rows], 50)
    }
    found = QUERIES["op11_repeats"](spark, SF_DIR).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == expected
    assert len(found) == len(rows)
    assert any(removed for _, removed, _, _ in expected.values())


def test_odd_rows(spark, odd_documents):
    rows = [tuple(r) for r in odd_documents.select("doc_id", "text").collect()]
    more = [(7, rows[0][1]), (7, "x" + rows[0][1]), (None, rows[0][1]), (8, "é" * 40), (9, "aé" + "é" * 30)]
    more += [(10, "ab" * 500), (11, "ab" * 60), (12, "a" * 49), (13, "a" * 50), (14, "a" * 5000)]
    extra = frame(spark, more).withColumn("spans", F.lit("clash")).withColumn("block", F.lit(1))
    df = odd_documents.unionByName(extra, allowMissingColumns=True)
    assert collected(repeats.remove_repeats(df)) == brute(rows + more, 50)
    assert repeats.remove_repeats(df.filter(F.lit(False))).isEmpty()
    empty = frame(spark, [(1, ""), (2, None)])
    assert collected(repeats.remove_repeats(empty)) == [(1, 0, (), b""), (2, 0, (), b"")]
