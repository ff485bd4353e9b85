"""Continuous ingestion: landing events in, deduplicated objects out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from foliospark.session import materialise, settings
from foliospark.sources.landing import decode_landing_events
from foliospark.streaming import merge_log
from foliospark.streaming.merge_log import MergeLog

# --- fixed values: polling limits ---------------------------------------------
MAX_FILES_PER_TRIGGER = 100
# ------------------------------------------------------------------------------
STORE_BUCKETS = 32  # a lookup reads only those of them it touches
MESSAGE_KEYS = ("message_id", "record")


def read_landing(
    spark: SparkSession, path: str, max_files: int = MAX_FILES_PER_TRIGGER
) -> DataFrame:
    """A folder of notification files as a stream of bodies, one per line."""
    return (
        spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)
    )


def landed_objects(stream: DataFrame) -> DataFrame:
    """S1 on the stream, with the sending time as event time.

    Bodies that cannot be read come along with their ``reject_reason``.
    """
    return decode_landing_events(stream).withColumn(
        "sent_at", F.to_timestamp("sent_at")
    )


class FirstSeen(StatefulProcessor):
    """Emits the first row of a key; remembers the key for ``ttl``.

    A row sent longer than ``ttl`` ago, or at an unknown time, may have been stored and
    forgotten since: it comes out as ``aged``. Any other is new if the state does
    not know its key, since its key cannot have been stored before it was sent.
    """

    def __init__(self, sent_at: str, ttl: timedelta):
        self.sent_at = sent_at
        self.ttl_ms = int(ttl.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "known boolean", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values):
        if self.seen.exists():
            return
        self.seen.update((True,))
        row = next(iter(rows))
        sent = row[self.sent_at]
        oldest = timer_values.getCurrentProcessingTimeInMs() - self.ttl_ms
        aged = sent is None or sent.timestamp() * 1000 < oldest
        yield Row(**row.asDict(), aged=aged)

    def close(self) -> None:
        pass


def store_once(
    stream: DataFrame,
    keys: Sequence[str],
    path: str,
    checkpoint: str,
    then: Callable[[DataFrame, int], None] | None = None,
    sent_at: str | None = None,
    ttl: timedelta | None = None,
) -> StreamingQuery:
    """Store each key once, however often and however late it is delivered.

    The state of the stream knows the keys, so that a batch costs what it brings and
    not what has been stored. Without ``ttl`` it knows them for good. With it, keys
    are forgotten that long after they were first seen, and only rows whose time
    ``sent_at`` lies further back are looked up in the stored table, in the buckets
    of their keys. There is no watermark, so no row is too late. A batch overwrites
    its own folder, so that one run again after a failure stores the same rows.
    ``then`` is called with what the batch has stored. NULL is a key like any other.
    """
    keys = list(keys)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(STORE_BUCKETS)).cast("int")
    spark = stream.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.withColumn("bucket", bucket), batch_id, path, ["bucket"])
        finish(batch_id)

    def store_checked(batch: DataFrame, batch_id: int) -> None:
        # Written first: reading the batch twice would run its stateful part twice.
        first = materialise(batch.withColumn("bucket", bucket), "first-seen")
        new, aged = first.filter("NOT aged").drop("aged"), first.filter("aged").drop("aged")
        touched = [r.bucket for r in aged.select("bucket").distinct().collect()]
        if touched:
            new = new.unionByName(unknown(aged, touched, batch_id))
        write_batch(new, batch_id, path, ["bucket"])
        finish(batch_id)

    def unknown(aged: DataFrame, touched: list[int], batch_id: int) -> DataFrame:
        known = stored(spark, path)
        if known is None:
            return aged
        earlier = known.filter(F.col("bucket").isin(touched) & (F.col("batch_id") < batch_id))
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in ("bucket", *keys)]
        return aged.alias("n").join(
            earlier.select("bucket", *keys).alias("o"), reduce(and_, same), "left_anti"
        )

    def finish(batch_id: int) -> None:
        written = stored(spark, path) if then is not None else None
        if written is not None:
            then(written.filter(F.col("batch_id") == batch_id), batch_id)

    if ttl is None:
        return run_batches(stream.dropDuplicates(keys), store, checkpoint)
    if sent_at is None:
        raise ValueError("a time to live needs the time the rows were sent")
    schema = StructType([*stream.schema, StructField("aged", BooleanType())])
    first = stream.groupBy(*keys).transformWithState(
        FirstSeen(sent_at, ttl), schema, "append", "processingTime"
    )
    return run_batches(first, store_checked, checkpoint)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that batches write; None before the first row."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:  # no folder, or no file in it yet; else a fault
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_batch(rows: DataFrame, batch_id: int, path: str, parts: Sequence[str] = ()) -> None:
    """Write below ``batch_id``, overwriting what an interrupted run has left."""
    rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch_id", *parts).parquet(path)


def run_batches(
    stream: DataFrame,
    store: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
) -> StreamingQuery:
    # A state with a time to live asks for another batch after every one, without end.
    with settings(stream.sparkSession, {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
        return (
            stream.writeStream.option("checkpointLocation", checkpoint)
            .outputMode(mode)
            .trigger(availableNow=True)
            .foreachBatch(store)
            .start()
        )


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table, exactly once, everything available now."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def log_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch below its ``batch_id``.

    A batch that is run again after a failure overwrites its own folder, so
    delivery at least once upstream still stores every row once.
    """
    return run_batches(
        stream, lambda batch, batch_id: write_batch(batch, batch_id, path), checkpoint
    )


def answers_log(existing: DataFrame, path: str) -> MergeLog:
    """The answers table as a merge log: the latest answer wins, the first id stays."""
    return MergeLog(
        path,
        ", ".join(f"`{name}` {kind}" for name, kind in existing.dtypes),
        keys=("evaluation_id", "content_id"),
        newest=("updated_at", "id"),
        kept=("id", "created_at"),
        oldest=("created_at", "id"),
    )


def merge_answers(
    existing: DataFrame, stream: DataFrame, path: str, checkpoint: str
) -> StreamingQuery:
    """Merge each batch into the answers table.

    A batch is logged as it comes and resolved when the table is read; only buckets
    whose log has outgrown their base are written anew. A repeated batch replaces what
    it logged before. ``existing`` is the table's first version.
    """
    table = answers_log(existing, path)
    merge_log.start(table, existing)

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_log.append_changes(table, batch, batch_id)
        merge_log.compact(table, batch.sparkSession)

    return run_batches(stream, merge, checkpoint)


def current_answers(existing: DataFrame, path: str) -> DataFrame:
    """The answers table after all merged batches."""
    table = answers_log(existing, path)
    return merge_log.current(table, existing.sparkSession).select(existing.columns)
