import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_DIR
from foliospark.llm import bpe
from foliospark.llm.queries import QUERIES

ALPHABET = "ab ehilnorst  \n\t.,'éß日1  \x1c<|>"


def ids_of(encoder, texts):
    ids, bounds = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_any_text_is_encoded_as_the_library_does(vocabulary):
    library = Tokenizer.from_file(vocabulary)
    encoder = bpe.Encoder(vocabulary)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(ALPHABET, max_size=60), min_size=1, max_size=5))
    def check(texts):
        wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids_of(encoder, texts) == wanted
        ids, bounds = encoder.encode(texts)
        decoded = [library.decode(i, skip_special_tokens=False) for i in wanted]
        assert encoder.decode(ids, bounds) == decoded

    check()


def test_overlapping_pairs_and_special_tokens(vocabulary):
    library = Tokenizer.from_file(vocabulary)
    texts = ["a" * n for n in range(40)] + ["<|endoftext|>", "x<|endoftext|> <|endoftext|>y"]
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids_of(bpe.Encoder(vocabulary), texts) == wanted


def test_forgetting_words_changes_nothing(vocabulary):
    texts = [f"some word{k} here" for k in range(50)]
    few, many = bpe.Encoder(vocabulary, max_words=3), bpe.Encoder(vocabulary)
    for text in texts:
        assert ids_of(few, [text]) == ids_of(many, [text])


def test_bytes_that_are_not_text_decode_to_replacements(vocabulary):
    library = Tokenizer.from_file(vocabulary)
    ids = library.encode("日本", add_special_tokens=False).ids[:1]
    found = bpe.Encoder(vocabulary).decode(np.array([*ids, -1, 10**6]), np.array([0, 3]))
    assert found == [library.decode(ids, skip_special_tokens=False)]


def test_columns_are_carried_and_null_is_empty(odd_documents, vocabulary):
    coded = bpe.encode_tokens(odd_documents, vocabulary)
    assert coded.columns == [*odd_documents.columns, "token_ids"]
    back = bpe.decode_tokens(coded, vocabulary).collect()
    assert len(back) == odd_documents.count()
    for row in back:
        assert row.decoded == (row.text or "")
        assert bool(row.token_ids) == bool(row.text)


def test_query_against_the_library(spark, vocabulary):
    library = Tokenizer.from_file(vocabulary)
    rows = {r.doc_id: r for r in QUERIES["op1_bpe"](spark, SF_DIR).collect()}
    texts = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        row = rows[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table(spark, odd_documents, vocabulary):
    empty = odd_documents.filter(F.lit(False))
    assert bpe.encode_tokens(empty, vocabulary).isEmpty()
    assert bpe.round_trip(empty, vocabulary).isEmpty()
