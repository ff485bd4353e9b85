"""Table schemas, payload schemas and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: vocabularies ------------------------------------------
FILE_STATUS = (
    "pending",
    "chunking",
    "chunked",
    "embedding",
    "embedded",
    "evaluating",
    "evaluated",
    "completed",
    "failed",
)
ANSWER_STATUS = ("pending", "processing", "completed", "failed")
CHUNK_STATUS = ("CHUNKED", "EMBEDDED")
EVALUATION_TYPE = ("enum_choice", "text", "boolean")
EMBEDDING_DIMENSION = 1536
# --------------------------------------------------------------------------

_STAMPS = "created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL"

TABLE_DDL = {
    "projects": f"id STRING NOT NULL, name STRING NOT NULL, description STRING NOT NULL, {_STAMPS}",
    "files": (
        "id STRING NOT NULL, name STRING NOT NULL, type STRING NOT NULL, "
        "size BIGINT NOT NULL, url STRING NOT NULL, status STRING NOT NULL, "
        "error STRING, project_id STRING NOT NULL, thumbnail_url STRING, " + _STAMPS
    ),
    "file_contents": (
        "id STRING NOT NULL, file_id STRING NOT NULL, content_number INT NOT NULL, "
        "content_metadata MAP<STRING,STRING> NOT NULL, content STRING NOT NULL, "
        + _STAMPS
    ),
    "file_embeddings": (
        "id STRING NOT NULL, file_id STRING NOT NULL, chunk_number INT NOT NULL, "
        "chunk_metadata MAP<STRING,STRING> NOT NULL, project_id STRING NOT NULL, "
        "content_id STRING NOT NULL, content STRING NOT NULL, "
        "embedding ARRAY<FLOAT>, status STRING NOT NULL, " + _STAMPS
    ),
    "evaluations": (
        "id STRING NOT NULL, title STRING NOT NULL, description STRING NOT NULL, "
        "system_prompt STRING, prompt STRING NOT NULL, project_id STRING NOT NULL, "
        "evaluation_type STRING NOT NULL, evaluation_options ARRAY<STRING>, "
        "parent_evaluation_id STRING, parent_evaluation_option STRING, "
        "category_id STRING NOT NULL, template_id STRING, " + _STAMPS
    ),
    "file_evaluations": (
        "id STRING NOT NULL, file_id STRING NOT NULL, evaluation_id STRING NOT NULL, "
        "content_id STRING NOT NULL, response STRING NOT NULL, status STRING NOT NULL, "
        "error STRING, llm_request STRING, llm_response STRING, " + _STAMPS
    ),
    "evaluation_categories": (
        "id STRING NOT NULL, name STRING NOT NULL, description STRING, "
        "project_id STRING NOT NULL, " + _STAMPS
    ),
    "evaluation_templates": (
        "id STRING NOT NULL, name STRING NOT NULL, description STRING NOT NULL, "
        "project_id STRING NOT NULL, system_prompt STRING, prompt STRING NOT NULL, "
        "category_id STRING NOT NULL, default BOOLEAN NOT NULL, " + _STAMPS
    ),
    "project_evaluations": (
        f"evaluation_id STRING NOT NULL, project_id STRING NOT NULL, {_STAMPS}"
    ),
}

STATUS_COLUMNS = {
    "files": ("status", FILE_STATUS),
    "file_embeddings": ("status", CHUNK_STATUS),
    "file_evaluations": ("status", ANSWER_STATUS),
    "evaluations": ("evaluation_type", EVALUATION_TYPE),
}

SNS_ENVELOPE = (
    "Type STRING, MessageId STRING, TopicArn STRING, Message STRING, "
    "Timestamp STRING, SignatureVersion STRING, Signature STRING, "
    "SigningCertURL STRING, UnsubscribeURL STRING"
)
OBJECT_EVENT = (
    "Records ARRAY<STRUCT<s3: STRUCT<"
    "bucket: STRUCT<name: STRING, arn: STRING>, "
    "object: STRUCT<key: STRING, sequencer: STRING, versionId: STRING, "
    "eTag: STRING, size: BIGINT>>>>"
)
COMPLETION_CALLBACK = (
    "event STRING, payload STRUCT<status: STRING, error: STRING, "
    "request: STRUCT<metadata: STRUCT<evaluation_id: STRING, file_id: STRING, "
    "file_content_id: STRING, workflow_id: STRING, parent_evaluation_id: STRING, "
    "parent_evaluation_option: STRING>>, "
    "response: STRUCT<message: STRING, tool_calls: ARRAY<STRUCT<"
    "function: STRUCT<name: STRING, arguments: STRING>>>>>"
)
CHUNK_RESULT = (
    "project_id STRING, file_id STRING, file_content_id STRING, content_number INT, "
    "chunk_document STRUCT<result: STRUCT<chunk_ids: ARRAY<STRING>>>"
)
RESULT_MANIFEST = (
    "DestinationBucket STRING, "
    "ResultFiles STRUCT<SUCCEEDED: ARRAY<STRUCT<Key: STRING, Size: BIGINT>>, "
    "FAILED: ARRAY<STRUCT<Key: STRING, Size: BIGINT>>>"
)


def table_schema(name: str) -> T.StructType:
    """The declared schema of a platform table."""
    return T.StructType.fromDDL(TABLE_DDL[name])


def is_in_vocabulary(value: Column, allowed: tuple[str, ...]) -> Column:
    """True where ``value`` is one of the allowed labels; NULL counts as wrong."""
    return F.coalesce(value.isin(*allowed), F.lit(False))


def vocabulary_violations(df: DataFrame, table: str) -> DataFrame:
    """Rows whose status or type label is outside the table's vocabulary."""
    column, allowed = STATUS_COLUMNS[table]
    return df.filter(~is_in_vocabulary(F.col(column), allowed))


def read_view(df: DataFrame, *hidden: str) -> DataFrame:
    """Read projection of a table: heavy columns such as vectors are dropped
    before any join, so the scan never reads them (P18)."""
    return df.drop(*(hidden or ("embedding",)))
