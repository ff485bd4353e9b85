"""File bytes and texts to numbered pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.text import line_count, stable_id

PageExtractor = Callable[[bytes], list[tuple[str, dict[str, str]]]]

PAGES_AT_ONCE = 4096
PAGE_CHARS_AT_ONCE = 4 * 1024 * 1024


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, one row each: (path, text)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def text_pages(files: DataFrame, text: str = "text") -> DataFrame:
    """A text file is one page; its metadata holds the number of lines."""
    return files.select(
        stable_id(F.col("file_id"), F.lit(1)).alias("id"),
        *[c for c in files.columns if c != text],
        F.lit(1).alias("content_number"),
        F.create_map(
            F.lit("total_lines"), line_count(F.col(text)).cast("string")
        ).alias("content_metadata"),
        F.col(text).alias("content"),
    )


def explode_pages(files: DataFrame, pages: Column, keep: list[str]) -> DataFrame:
    """An array of page texts to rows numbered from 1."""
    return files.select(*keep, F.posexplode(pages).alias("_position", "content")).select(
        *keep, (F.col("_position") + 1).cast("int").alias("content_number"), "content"
    )


def read_binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """File bytes; at most a few large files are held by a task at a time."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "content")
    )


def extract_pages(files: DataFrame, extractor: PageExtractor) -> DataFrame:
    """Run a page extractor over (file_id, content bytes).

    The extractor returns (text, metadata) per page. A file it cannot read
    yields one row with ``error`` and no page, so that one broken file does not
    fail the job. A task holds the pages of a file, and of more only up to
    ``PAGES_AT_ONCE`` pages or ``PAGE_CHARS_AT_ONCE`` characters.
    """

    pairs = pa.map_(pa.string(), pa.string())

    def pages_of(data: bytes | None) -> Iterator[tuple]:
        try:
            pages = extractor(data)
        except Exception as problem:  # a broken file is one row without a page
            yield None, None, None, str(problem) or type(problem).__name__
            return
        for number, (text, described) in enumerate(pages, start=1):
            yield number, text, list(dict(described).items()), None

    def rows_of(batch: pa.RecordBatch, source: list[int], rows: list[tuple]) -> pa.RecordBatch:
        numbers, texts, metadata, errors = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("file_id").take(pa.array(source, pa.int64())),
                pa.array(numbers, pa.int32()),
                pa.array(texts, pa.string()),
                pa.array(metadata, pairs),
                pa.array(errors, pa.string()),
            ],
            ["file_id", "content_number", "content", "content_metadata", "error"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, rows, size = [], [], 0
            for row, data in enumerate(batch.column("content")):
                for page in pages_of(data.as_py()):
                    source.append(row)
                    rows.append(page)
                    size += len(page[1] or "")
                    if len(rows) >= PAGES_AT_ONCE or size >= PAGE_CHARS_AT_ONCE:
                        yield rows_of(batch, source, rows)
                        source, rows, size = [], [], 0
            if rows:
                yield rows_of(batch, source, rows)

    id_type = dict(files.dtypes)["file_id"]
    return files.select("file_id", "content").mapInArrow(
        run,
        f"file_id {id_type}, content_number INT, content STRING, "
        "content_metadata MAP<STRING,STRING>, error STRING",
    )
