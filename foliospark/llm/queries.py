"""Registered queries of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import (
    ann,
    audit,
    bpe,
    html,
    langid,
    lm,
    minhash,
    packing,
    repair,
    repeats,
    rules,
    sharding,
    urlfilter,
)
from foliospark.llm.common import crc_bucket, read_table
from foliospark.session import tune_session

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(tune_session(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text decoded from them, as digests."""
    coded = bpe.round_trip(read_table(spark, sf_dir, "documents"), vocabulary_path())
    decimal = F.concat_ws(",", F.col("token_ids").cast("array<string>"))
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(decimal, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query("op2_pack")
def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(
        read_table(spark, sf_dir, "documents"), vocabulary_path(), 2048
    )


@query("op3_langid")
def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from three quarters of the rows."""
    documents = read_table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 4) == 2
    model = langid.fit(documents.filter(~held_out), "text", "lang")
    return langid.predict(
        documents.withColumn("held_out", held_out), model, kept=["doc_id", "held_out"]
    )


@query("op6_neardup")
def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op10_rules")
def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every text and the verdict of the learned list."""
    return rules.judge(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    ).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query("op8_html")
def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read_table(spark, sf_dir, "pages")
    found = html.extract(pages, kept=["page_id", "url"])
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


@query("op4_urls", urlfilter.oracle_sql(URL_RULES))
def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return urlfilter.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


SHARDS = [f"shard-{k:02d}" for k in range(64)]


def sharding_sql() -> str:
    """The lookup table is stated as it is; tests fill it in another way."""
    slots = sharding.fill_table(SHARDS)
    return f"""
WITH slots AS (
  SELECT generate_subscripts(s, 1) - 1 AS slot, unnest(s) AS shard
  FROM (SELECT {slots} AS s)),
keyed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT
                 % {sharding.TABLE_SIZE} AS slot
  FROM documents)
SELECT doc_id, CAST(slot AS BIGINT) AS slot, CAST(shard AS INTEGER) AS shard,
       'shard-' || lpad(CAST(shard AS VARCHAR), 2, '0') AS shard_name
FROM keyed JOIN slots USING (slot)"""


@query("op9_shards", sharding_sql())
def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign(documents, SHARDS, ["doc_id"]).select(
        "doc_id", "slot", "shard", "shard_name"
    )


@query("op7_lm")
def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text, learned from six sevenths of the rows."""
    held_out = crc_bucket("doc_id", 7) == 2
    return lm.score(read_table(spark, sf_dir, "documents"), ~held_out).select(
        "doc_id",
        (~F.col("training")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        "bits_per_byte",
    )


@query("op5_ann")
def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    embeddings = read_table(spark, sf_dir, "embeddings")
    return ann.search(embeddings, F.col("id") % 20 == 0, 20)


@query("op11_repeats")
def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the passages of 50 bytes that an earlier one holds."""
    found = repeats.remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start)
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op12_audit", audit.ORACLE_SQL)
def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of all orders of five filters by language."""
    return audit.text_audit(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    )


@query("op13_repair")
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return repair.repair(repair.damage(read_table(spark, sf_dir, "conversations")))
