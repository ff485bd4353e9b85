"""Splitting, numbering and embedding by their invariants."""

import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import SF_DIR
from foliospark.functions.splitting import approximate_token_count, split_text
from foliospark.operators import chunking, embedding, search
from foliospark.plans.driver_tables import DriverTables

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGES = "id long, file_id long, project_id string, content_number int, content_metadata map<string,string>, content string"


def words(texts):
    return [len(t.split()) for t in texts]


@given(st.text(alphabet="ab \n", max_size=200), st.integers(2, 12), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_chunks_cover_the_text_in_order(content, size, overlap):
    overlap = min(overlap, size)
    chunks = split_text(content, lambda ts: [len(t) for t in ts], size, overlap)
    assert all(c == c.strip() and 0 < len(c) <= size for c in chunks)
    position = 0
    for part in chunks:
        found = content.find(part, max(0, position - overlap - size))
        assert found >= 0
        position = max(position, found + len(part))
    if overlap == 0:
        squeeze = lambda s: "".join(s.split())
        assert squeeze("".join(chunks)) == squeeze(content)


def test_word_splits_overlap():
    content = " ".join(f"w{i}" for i in range(10))
    assert split_text(content, words, 4, 2) == [
        "w0 w1 w2 w3", "w2 w3 w4 w5", "w4 w5 w6 w7", "w6 w7 w8 w9"
    ]


def test_paragraphs_are_kept_whole_where_they_fit():
    content = "a b c\n\nd e f\n\ng h i j k l m n"
    assert split_text(content, words, 4, 0) == ["a b c", "d e f", "g h i j", "k l m n"]


def test_approximate_counts():
    assert approximate_token_count(["", "word", "internationally!", "a b, c"]) == [0, 1, 4, 4]


def brute_windows(content, size, overlap):
    tokens, out, at = content.split(), [], 0
    while tokens:
        out.append(" ".join(tokens[at : at + size]))
        if at + size >= len(tokens):
            break
        at += size - overlap
    return out


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(1)
    rows, ident = [], 0
    for file_id in (1, 2, 3):
        for number in range(1, 40 if file_id == 1 else 4):
            ident += 1
            content = " \n".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 30)))
            rows.append((ident, file_id, "p", number, {"n": str(number)}, content))
    return spark.createDataFrame(rows, PAGES)


def expected(pages, cut):
    out = []
    for file_id in (1, 2, 3):
        number = 0
        for page in sorted((r for r in pages.collect() if r.file_id == file_id), key=lambda r: r.content_number):
            for content in cut(page.content):
                number += 1
                out.append((file_id, page.id, number, content))
    return sorted(out)


def rows_of(chunks):
    return sorted(tuple(r) for r in chunks.select("file_id", "content_id", "chunk_number", "content").collect())


@pytest.mark.parametrize("size,overlap", [(5, 2), (3, 0), (100, 20)])
def test_windows_match_brute_force(pages, size, overlap):
    found = rows_of(chunking.chunk_windows(pages, size, overlap))
    assert found == expected(pages, lambda c: brute_windows(c, size, overlap))


def test_recursive_chunks_are_numbered_through_files(pages):
    found = rows_of(chunking.chunk_recursive(pages, words, 5, 2))
    assert found == expected(pages, lambda c: split_text(c, words, 5, 2))


def test_renumbering_matches_the_numbers_at_creation(pages):
    chunks = chunking.chunk_windows(pages, 5, 2)
    again = chunking.renumber_chunks(chunks.drop("chunk_number"))
    assert rows_of(again) == rows_of(chunks)


def test_ids_are_stable_and_unique(pages):
    ids = [r.id for r in chunking.chunk_windows(pages, 5, 2).select("id").collect()]
    assert len(set(ids)) == len(ids)
    assert sorted(ids) == sorted(r.id for r in chunking.chunk_windows(pages, 5, 2).select("id").collect())


def test_hashed_vectors_have_length_one(pages):
    chunks = chunking.chunk_windows(pages, 5, 2)
    rows = embedding.embed_hashed(chunks, 32).collect()
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-5 for r in rows)
    assert {r.status for r in rows} == {"EMBEDDED"}
    empty = chunks.limit(1).withColumn("content", F.lit(" "))
    assert [(r.embedding, r.status) for r in embedding.embed_hashed(empty, 32).collect()] == [(None, "CHUNKED")]


def test_custom_embedder(pages):
    chunks = chunking.chunk_windows(pages, 5, 2)
    rows = embedding.embed_chunks(chunks, lambda ts: [[float(len(t)), 1.0] for t in ts], 2).collect()
    assert all(list(r.embedding) == [len(r.content), 1.0] for r in rows)
    with pytest.raises(Exception, match="2 dimensions"):
        embedding.embed_chunks(chunks, lambda ts: [[1.0] for _ in ts], 2).collect()


def test_approximate_index_finds_most_of_the_exact_hits(spark):
    tables = DriverTables(spark, SF_DIR)
    vectors = tables.read("embeddings").filter("vec_id < 40").collect()
    index = embedding.build_lsh_index(tables.chunks, 64)
    found = wanted = 0
    for row in vectors[:5]:
        query = [float(x) for x in row.embedding]
        exact = search.similarity_hits(tables.chunks, None, search.SearchRequest(query, 10))
        near = embedding.similarity_lsh(index, query, 10)
        exact_ids = {r.chunk_id for r in exact.collect()}
        wanted += len(exact_ids)
        found += len(exact_ids & {r.chunk_id for r in near.collect()})
    assert found / wanted >= 0.8
