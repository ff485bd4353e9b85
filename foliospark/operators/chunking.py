"""Pages to numbered chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.binding import bind
from foliospark.functions.splitting import (
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    LengthFn,
    approximate_token_count,
    split_text,
)
from foliospark.functions.text import stable_id
from foliospark.operators.scale import join_by_key, offsets_in_group, spread_small
from foliospark.session import materialise

TOKEN_BREAK = r"[ \t\n\r\f]+"
WORD = r"[^ \t\n\r\f]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, TOKEN_BREAK), lambda word: word != "")


def _windows_of(n_words: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the chunk size")
    # the last window is the first one that reaches the end of the text
    further = F.greatest(F.ceil((n_words - size) / step), F.lit(0))
    return F.when(n_words > 0, further + 1).otherwise(0).cast("long")


def window_count(
    text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> Column:
    """K2: number of windows of a text; none for a text without words."""
    return _windows_of(F.regexp_count(text, F.lit(WORD)), size, overlap)


def window_chunks(
    text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> Column:
    """K2: the text's words in windows of ``size`` that share ``overlap`` words.

    The words are bound once per text, so the work is linear in its length.
    """

    def windows(words: Column) -> Column:
        count = _windows_of(F.size(words), size, overlap)
        starts = F.when(
            count > 0, F.sequence(F.lit(0).cast("long"), count - 1)
        ).otherwise(F.array().cast("array<bigint>"))
        return F.transform(
            starts,
            lambda i: F.array_join(
                F.slice(words, (i * (size - overlap) + 1).cast("int"), F.lit(size)), " "
            ),
        )

    return bind(_words(text), windows)


def chunk_rows(pages: DataFrame, texts: Column, counts: Column) -> DataFrame:
    """One row per chunk, numbered from 1 through its whole file.

    ``pages`` has (id, file_id, project_id, content_number, content_metadata);
    ``texts`` are a page's chunks and ``counts`` their number. The numbering
    runs over (file, page, count) alone and is joined back by page, so no
    window carries text and no task handles a whole file. The offsets are written
    first: where their size lets them be broadcast, no text is shuffled, and beyond
    that the join shuffles pages, not their overlapping chunks.
    """
    keep = ["project_id", "file_id", "content_id", "content_number", "chunk_metadata"]
    pages = spread_small(pages, "id")
    offsets = offsets_in_group(
        pages.select("id", "file_id", "content_number", counts.alias("_size")),
        ["file_id"],
        "content_number",
        "_size",
        "_offset",
    ).select("id", "_offset")
    unfolded = (
        join_by_key(pages, materialise(offsets, "offsets"), ["id"])
        .select(
            "project_id",
            "file_id",
            F.col("id").alias("content_id"),
            "content_number",
            F.col("content_metadata").alias("chunk_metadata"),
            "_offset",
            texts.alias("_texts"),
        )
        # The outer form keeps Spark from testing the array ahead of the join,
        # which would cut every page a second time.
        .select(
            *keep, "_offset", F.posexplode_outer("_texts").alias("_position", "content")
        )
        .filter(F.col("_position").isNotNull())
    )
    return unfolded.select(
        stable_id(F.col("content_id"), F.col("_position")).alias("id"),
        *keep,
        (F.col("_position") + 1).cast("int").alias("chunk_in_page"),
        (F.col("_offset") + F.col("_position") + 1).alias("chunk_number"),
        "content",
        F.lit(None).cast("array<float>").alias("embedding"),
        F.lit("CHUNKED").alias("status"),
    )


def chunk_windows(
    pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """K2: fixed word windows, all in built-in expressions."""
    content = F.col("content")
    return chunk_rows(
        pages,
        window_chunks(content, size, overlap),
        window_count(content, size, overlap),
    )


def chunk_recursive(
    pages: DataFrame,
    length_fn: LengthFn = approximate_token_count,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """K1, F2: recursive token-bounded chunks of every page's whole text.

    Greedy packing is sequential within a page, so splitting one is an Arrow
    function. Its result is written once, since numbering and unfolding both
    read it and splitting is the costly part.
    """

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array(
            [
                [] if text is None else split_text(text, length_fn, size, overlap)
                for text in texts.to_pylist()
            ],
            type=pa.list_(pa.string()),
        )

    pieces = materialise(
        spread_small(pages, "id").select(
            "id",
            "file_id",
            "project_id",
            "content_number",
            "content_metadata",
            split(F.col("content")).alias("_pieces"),
        ),
        "chunks",
    )
    return chunk_rows(pieces, F.col("_pieces"), F.size("_pieces").cast("long"))


def renumber_chunks(chunks: DataFrame) -> DataFrame:
    """Number chunks 1..N through each file, by page and then by chunk.

    ``chunks`` has (id, file_id, content_number, chunk_in_page) with chunks
    counted from 1 in their page. Chunk counts are taken per page and summed
    up over buckets of pages; no window ever spans a file.
    """
    sizes = chunks.groupBy("file_id", "content_number").agg(
        F.count(F.lit(1)).alias("_size")
    )
    offsets = offsets_in_group(
        sizes, ["file_id"], "content_number", "_size", "_offset"
    ).drop("_size")
    return (
        chunks.join(offsets, ["file_id", "content_number"])
        .withColumn("chunk_number", F.col("_offset") + F.col("chunk_in_page"))
        .drop("_offset")
    )


def map_texts(
    batches: Iterator[pa.RecordBatch], column: str, out: str, function, out_type: pa.DataType
) -> Iterator[pa.RecordBatch]:
    """Append ``function(list of texts)`` as a column, batch by batch."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        values = pa.array(function(texts), type=out_type)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, values], names=[*batch.schema.names, out]
        )
