"""Chunk embeddings and the approximate index."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.ml.feature import (
    BucketedRandomProjectionLSH,
    BucketedRandomProjectionLSHModel,
    HashingTF,
    Normalizer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.vectors import cosine_to, unit
from foliospark.operators.chunking import TOKEN_BREAK, map_texts
from foliospark.schemas import EMBEDDING_DIMENSION

Embedder = Callable[[list[str]], list[Sequence[float]]]


def embed_hashed(chunks: DataFrame, dimension: int = EMBEDDING_DIMENSION) -> DataFrame:
    """K4 offline: hashed word counts scaled to length one, without leaving the JVM.

    A chunk without words keeps a NULL vector and the status CHUNKED.
    """
    words = F.filter(F.split(F.lower("content"), TOKEN_BREAK), lambda word: word != "")
    counted = HashingTF(
        inputCol="_words", outputCol="_counts", numFeatures=dimension
    ).transform(chunks.drop("embedding", "status").withColumn("_words", words))
    scaled = Normalizer(inputCol="_counts", outputCol="_unit").transform(counted)
    vector = F.when(F.size("_words") > 0, vector_to_array("_unit", "float32"))
    return _marked(
        scaled.withColumn("embedding", vector).drop("_words", "_counts", "_unit")
    )


def embed_chunks(
    chunks: DataFrame, embedder: Embedder, dimension: int = EMBEDDING_DIMENSION
) -> DataFrame:
    """Call a model with one batch of texts at a time, in the tasks.

    The caller writes the result once before using it: a lost executor would
    otherwise send the same texts to the model again.
    """
    source = chunks.drop("embedding", "status")

    def checked(texts: list[str]) -> list[Sequence[float] | None]:
        vectors = embedder(texts)
        if len(vectors) != len(texts):
            raise ValueError("the embedder must return one vector per text")
        for vector in vectors:
            if vector is not None and len(vector) != dimension:
                raise ValueError(f"expected vectors of {dimension} dimensions")
        return vectors

    def run(batches):
        return map_texts(batches, "content", "embedding", checked, pa.list_(pa.float32()))

    schema = source.withColumn("embedding", F.lit(None).cast("array<float>")).schema
    return _marked(source.mapInArrow(run, schema))


def _marked(embedded: DataFrame) -> DataFrame:
    done = F.col("embedding").isNotNull()
    return embedded.withColumn("status", F.when(done, "EMBEDDED").otherwise("CHUNKED"))


def wrong_dimension(chunks: DataFrame, dimension: int = EMBEDDING_DIMENSION) -> DataFrame:
    """Embedded chunks whose vector has another length than declared."""
    return chunks.filter(F.size("embedding") != dimension)


def build_lsh_index(
    chunks: DataFrame,
    dimension: int = EMBEDDING_DIMENSION,
    bucket_length: float = 0.5,
    tables: int = 8,
    seed: int = 42,
) -> tuple[BucketedRandomProjectionLSHModel, DataFrame]:
    """K7: hash unit vectors, on which Euclidean order is cosine order.

    Fitting draws random projections only and reads no data beyond the first
    row; the hashed table is written by the caller and reused for all queries.
    """
    vectors = chunks.filter(F.col("embedding").isNotNull()).select(
        F.col("id").alias("chunk_id"),
        "file_id",
        "project_id",
        "embedding",
        # never NULL, also where Spark evaluates it ahead of the filter
        array_to_vector(
            F.coalesce(
                unit(F.col("embedding")),
                F.array_repeat(F.lit(0.0).cast("float"), dimension),
            )
        ).alias("_vector"),
    )
    model = BucketedRandomProjectionLSH(
        inputCol="_vector",
        outputCol="_hashes",
        bucketLength=bucket_length,
        numHashTables=tables,
        seed=seed,
    ).fit(vectors)
    return model, model.transform(vectors)


def similarity_lsh(
    index: tuple[BucketedRandomProjectionLSHModel, DataFrame],
    query: Sequence[float],
    k: int,
) -> DataFrame:
    """K7: chunks sharing a hash bucket with the query, scored exactly, best k.

    Approximate like the index it stands for: a chunk in none of the query's
    buckets is not found. ``similarity_hits`` is the exact search.
    """
    model, hashed = index
    spark = hashed.sparkSession
    target = Vectors.dense(query)
    length = float(target.norm(2))
    probe = spark.createDataFrame([(Vectors.dense(target.values / length),)], ["_vector"])
    buckets = [
        float(h[0]) for h in model.transform(probe).select("_hashes").head()["_hashes"]
    ]
    shared = F.lit(False)
    for i, bucket in enumerate(buckets):
        value = F.get(vector_to_array(F.get("_hashes", F.lit(i))), F.lit(0))
        shared = shared | (value == bucket)
    scored = hashed.filter(shared).select(
        "chunk_id", "file_id", cosine_to(F.col("embedding"), query).alias("score")
    )
    return scored.orderBy(F.col("score").desc_nulls_last(), "chunk_id").limit(k)
