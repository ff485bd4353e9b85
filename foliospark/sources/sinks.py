"""Writers: event log, request files, partitioned results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: event names ------------------------------------------------
INGESTED = "file_ingested_successfully"
INGEST_FAILED = "file_ingestion_failed"
SOURCE_PREFIX = "temporal-workflow."
# ------------------------------------------------------------------------------
REQUESTS_PER_FILE = 100_000  # a compressed file is read by one task


def events_from(df: DataFrame, source: str, event_type: Column, detail: Column, time: Column) -> DataFrame:
    """Bus events ``(source, type, detail JSON, time)``."""
    return df.select(
        F.concat(F.lit(SOURCE_PREFIX), F.lit(source)).alias("source"),
        event_type.alias("detail_type"),
        F.to_json(detail).alias("detail"),
        time.alias("time"),
    )


def ingestion_events(files: DataFrame, time: Column) -> DataFrame:
    """Success or failure of the ingestion of each file."""
    failed = F.col("error").isNotNull()
    return events_from(
        files,
        "ingestion",
        F.when(failed, INGEST_FAILED).otherwise(INGESTED),
        F.struct("file_id", "error"),
        time,
    )


def route_events(events: DataFrame, event_type: str = INGESTED) -> DataFrame:
    """File ids of the events that start the evaluation."""
    return events.filter(F.col("detail_type") == event_type).select(
        F.get_json_object("detail", "$.file_id").alias("file_id")
    )


def append(df: DataFrame, path: str) -> None:
    """Bulk append; one file set per task, no statement size to respect."""
    df.write.mode("append").parquet(path)


def write_requests(requests: DataFrame, path: str) -> None:
    """Model requests as compressed JSON lines, in files of bounded size.

    Written by the tasks that make them: evening them out would shuffle every page's
    text once for each of its questions.
    """
    requests.write.mode("errorifexists").option("compression", "gzip").option(
        "maxRecordsPerFile", REQUESTS_PER_FILE
    ).json(path)


def file_bucket(file_id: Column, buckets: int) -> Column:
    """Folder number of a file in a partitioned result set."""
    return F.pmod(F.xxhash64(file_id.cast("string")), F.lit(buckets)).cast("int")


def write_partitioned_results(
    results: DataFrame, path: str, buckets: int = 16, fmt: str = "json"
) -> None:
    """Results below ``evaluation_id=/file_bucket=``.

    Files are folded into a fixed number of buckets: a folder per file would
    mean millions of them. Rebalancing gives every folder few files of even
    size and splits the folder of a hot file.
    """
    placed = results.withColumn("file_bucket", file_bucket(F.col("file_id"), buckets))
    placed.hint("rebalance", "evaluation_id", "file_bucket").write.mode(
        "overwrite"
    ).partitionBy("evaluation_id", "file_bucket").format(fmt).save(path)


def read_partitioned_results(
    spark: SparkSession,
    path: str,
    schema: str,
    evaluation_id: object | None = None,
    file_id: object | None = None,
    buckets: int = 16,
    fmt: str = "json",
) -> DataFrame:
    """Read back; both filters prune folders before any file is opened."""
    rows = spark.read.format(fmt).schema(schema).load(path)
    if evaluation_id is not None:
        rows = rows.filter(F.col("evaluation_id") == F.lit(evaluation_id))
    if file_id is not None:
        rows = rows.filter(
            (F.col("file_bucket") == file_bucket(F.lit(file_id), buckets))
            & (F.col("file_id") == F.lit(file_id))
        )
    return rows
