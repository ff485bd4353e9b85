"""The pipeline from raw documents to packed training sequences.

Each stage takes what its predecessor kept. The first three return the columns of
``documents``, whatever these are; the last returns where every piece of every
remaining document is packed.

1. ``language`` learns the languages from the documents' own ``lang`` and
   drops documents without letters and those of no clear language.
2. ``quality`` drops what the base rules or the learned decision list reject.
3. ``near_duplicates`` keeps one document of each class, that with the least id.
4. ``pack`` packs the rest into sequences of 2048 tokens.

Null and empty texts have no letters and end in the first stage. If no document has a
``lang``, nothing can be learned and every document with a letter is kept there. Empty
tables give empty results in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import langid, minhash, packing, rules
from foliospark.llm.common import read_table
from foliospark.llm.queries import vocabulary_path
from foliospark.session import materialise, tune_session

CLEAR_LANGUAGE = 0.5
PACKED_BYTES = 2_000_000  # text a packing task holds at once, beside earlier stages


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune_session(spark)
    model = langid.fit(docs, "text", "lang")
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    judged = langid.predict_rows(docs, model, "text", docs.columns)
    clear = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= CLEAR_LANGUAGE)
    return judged.filter(clear).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune_session(spark)
    labels = read_table(spark, sf_dir, "labels")
    judged = rules.judge_rows(docs, labels, "doc_id", "text", docs.columns)
    return judged.filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune_session(spark)
    found = minhash.near_duplicate_rows(docs, "doc_id", "text", docs.columns)
    return found.filter("stays").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune_session(spark)
    return packing.pack_documents(docs, vocabulary_path(), 2048, held_bytes=PACKED_BYTES)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("pack", pack),
]

# Hashed n-grams, learned rules and darts cannot be stated in SQL; the stages are
# tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
