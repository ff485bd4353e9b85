"""Result manifests and the result files they list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.schemas import CHUNK_RESULT, RESULT_MANIFEST


def read_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Keys of the result files that succeeded, one row each.

    ``path`` holds one manifest document per file, or with ``multi_line``
    False one per line.
    """
    return (
        spark.read.schema(RESULT_MANIFEST)
        .option("multiLine", multi_line)
        .json(path)
        .select("DestinationBucket", F.explode("ResultFiles.SUCCEEDED").alias("_file"))
        .select("DestinationBucket", F.col("_file.Key").alias("key"))
    )


def read_listed(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """Lines of just the files below ``root`` that ``keys`` lists.

    Nothing else below the folder is listed or opened. As for any folder, the reader
    holds the paths of the files it reads, here the listed ones alone, and packs them
    into tasks by their sizes. A listed file that is missing is an error.
    """
    prefix = root.rstrip("/") + "/"
    listed = keys.select("key").filter(F.col("key").isNotNull()).distinct().orderBy("key")
    paths = [prefix + row.key for row in listed.toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], "value string, key string")
    return spark.read.text(paths).select(
        "value", F.substring_index(F.col("_metadata.file_path"), prefix, -1).alias("key")
    )


def flatten_chunk_results(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines of chunking results to one row per chunk id."""
    result = F.from_json(value, CHUNK_RESULT)
    return (
        lines.select(result.alias("_r"))
        .select(
            F.col("_r.file_id").alias("file_id"),
            F.col("_r.project_id").alias("project_id"),
            F.col("_r.file_content_id").alias("content_id"),
            F.col("_r.content_number").alias("content_number"),
            F.posexplode("_r.chunk_document.result.chunk_ids").alias("_position", "chunk_id"),
        )
        .withColumn("chunk_in_page", F.col("_position") + 1)
        .drop("_position")
    )


def flatten_answer_results(items: DataFrame, value: str = "value") -> DataFrame:
    """JSON arrays of answered requests to one row per distinct answer.

    Each row is the (file, page, evaluation, response) that may start the next
    level of questions.
    """
    item = (
        "ARRAY<STRUCT<file_id: STRING, llm_request: STRUCT<metadata: STRUCT<"
        "evaluation_id: STRING, file_content_id: STRING>>, "
        "store_evaluation_response: STRUCT<result: STRING>>>"
    )
    return (
        items.select(F.explode(F.from_json(value, item)).alias("_i"))
        .select(
            F.col("_i.file_id").alias("file_id"),
            F.col("_i.llm_request.metadata.file_content_id").alias("content_id"),
            F.col("_i.llm_request.metadata.evaluation_id").alias("evaluation_id"),
            F.col("_i.store_evaluation_response.result").alias("response"),
        )
        .distinct()
    )
