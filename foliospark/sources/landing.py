"""Landing events: decoding, key checks and file registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import file_extension, mime_type, object_url, stable_id
from foliospark.operators.scale import first_per_key, join_dimension
from foliospark.schemas import OBJECT_EVENT, SNS_ENVELOPE

# --- fixed values: file types with a page loader; letter case matters ---------
LOADABLE = (".pdf", ".txt")
WORKFLOW_PREFIX = "ingestion-workflow-"
# ------------------------------------------------------------------------------

UNREADABLE = "unreadable message"
NO_RECORDS = "no records"


def decode_landing_events(raw: DataFrame, body: str = "value") -> DataFrame:
    """Queue bodies to one row per landed object.

    Two JSON layers, the notification and the object event inside its message.
    Every record of an event counts, not only the first. No body is lost: one that
    cannot be read, or names no object, is a row without object whose
    ``reject_reason`` says so; it is NULL for all others.
    """
    envelope = F.from_json(body, SNS_ENVELOPE)
    kept = [c for c in raw.columns if c != body]
    opened = raw.select(*kept, envelope.alias("_envelope"))
    message = F.col("_envelope.Message")
    events = opened.select(
        *kept,
        F.col("_envelope.MessageId").alias("message_id"),
        F.col("_envelope.Timestamp").alias("sent_at"),
        F.get_json_object(message, "$").isNull().alias("_unreadable"),
        F.from_json(message, OBJECT_EVENT).alias("_event"),
    )
    return events.select(
        *kept,
        "message_id",
        "sent_at",
        "_unreadable",
        F.posexplode_outer("_event.Records").alias("record", "_r"),
    ).select(
        *kept,
        "message_id",
        "sent_at",
        "record",
        F.col("_r.s3.bucket.name").alias("bucket"),
        F.col("_r.s3.object.key").alias("key"),
        F.col("_r.s3.object.size").alias("size"),
        F.col("_r.s3.object.eTag").alias("etag"),
        F.col("_r.s3.object.versionId").alias("version_id"),
        F.when(F.col("_unreadable"), UNREADABLE)
        .when(F.col("_r").isNull(), NO_RECORDS)
        .alias("reject_reason"),
    )


def readable(objects: DataFrame) -> DataFrame:
    """Objects of the bodies that could be read."""
    return objects.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def workflow_id(message_id: Column) -> Column:
    """Deterministic id of the work a message starts."""
    return F.concat(F.lit(WORKFLOW_PREFIX), message_id)


def parse_object_key(objects: DataFrame, key: str = "key") -> DataFrame:
    """``project/file`` keys into project, file name and extension.

    ``is_valid_key`` is false unless the key has exactly these two parts and
    names a project.
    """
    parts = F.split(key, "/")
    valid = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "")
    name = F.when(valid, F.get(parts, F.lit(1)))
    return objects.select(
        "*",
        F.coalesce(valid, F.lit(False)).alias("is_valid_key"),
        F.when(valid, F.get(parts, F.lit(0))).alias("project_id"),
        name.alias("file_name"),
        file_extension(name).alias("extension"),
    )


def check_objects(objects: DataFrame, projects: DataFrame) -> DataFrame:
    """Add ``reject_reason``, NULL for objects that can be loaded.

    ``objects`` comes from :func:`parse_object_key`. One project may receive a
    third of all objects, so the projects are broadcast or the objects salted.
    """
    known = projects.select(
        F.col("id").cast("string").alias("project_id"), F.lit(True).alias("_known")
    )
    joined = join_dimension(objects, known, ["project_id"], "left", ["key"])
    before = F.col("reject_reason") if "reject_reason" in objects.columns else F.lit(None)
    reason = (
        F.when(before.isNotNull(), before)
        .when(~F.col("is_valid_key"), "malformed key")
        .when(F.col("_known").isNull(), "unknown project")
        .when(~F.col("extension").isin(*LOADABLE), "unsupported extension")
    )
    kept = [c for c in objects.columns if c != "reject_reason"]
    return joined.select(*kept, reason.alias("reject_reason"))


def accepted(checked: DataFrame) -> DataFrame:
    """Objects to load."""
    return checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(checked: DataFrame) -> DataFrame:
    """Objects to report."""
    return checked.filter(F.col("reject_reason").isNotNull())


def register_files(objects: DataFrame, files: DataFrame) -> DataFrame:
    """Get or create the file row of each landed object.

    An object that carries ``file_id`` in its metadata must match a file. One
    without has the file whose id follows from its URL: a new one in status
    chunking, once however often its event is delivered, or the one that an
    earlier run has registered. ``is_new`` marks rows to append.
    """
    url = object_url(F.col("bucket"), F.col("key"))
    landed = first_per_key(
        objects.withColumn("url", url), ["url"], [F.col("file_id").isNull(), F.col("message_id")]
    )
    known = files.select(
        F.col("id").cast("string").alias("_key"),
        F.col("name").alias("_name"),
        F.col("status").alias("_status"),
        F.lit(True).alias("_known"),
    )
    keyed = landed.withColumn("_key", F.coalesce("file_id", stable_id(F.col("url"))))
    joined = keyed.join(known, "_key", "left")
    found = F.col("_known").isNotNull()
    is_new = F.col("file_id").isNull() & ~found
    return joined.select(
        F.col("_key").alias("file_id"),
        F.col("project_id"),
        F.when(is_new, F.col("file_name")).otherwise(F.col("_name")).alias("name"),
        "size",
        "url",
        mime_type(F.col("file_name")).alias("type"),
        F.when(is_new, F.lit("chunking")).otherwise(F.col("_status")).alias("status"),
        is_new.alias("is_new"),
        F.when(F.col("file_id").isNotNull() & ~found, "unknown file").alias("reject_reason"),
    )
