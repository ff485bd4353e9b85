"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP_BYTES = 8_000_000  # text a task holds at once beside its Arrow batch


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_bytes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` as ``id`` and the text as UTF-8 bytes ``data`` (null: empty)."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return df.select(F.col(key).cast("long").alias("id"), data.alias("data"))


def byte_groups(
    batches: Iterator[pa.RecordBatch], limit: int = GROUP_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches holding about ``limit`` bytes of ``data`` each.

    A single longer text makes a slice of its own. Yields the slice and its
    ``data`` column as a list.
    """
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column("data")).to_pylist()
        first, held = 0, 0
        for row, length in enumerate(lengths):
            if held and held + length > limit:
                part = batch.slice(first, row - first)
                yield part, part.column("data").to_pylist()
                first, held = row, 0
            held += length
        if first < len(lengths):
            part = batch.slice(first)
            yield part, part.column("data").to_pylist()


def crc_bucket(column: str, buckets: int):
    """crc32 of the id written as text, modulo ``buckets``."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(buckets)
