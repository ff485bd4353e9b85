"""Session settings, scratch storage and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job of this library relies on.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed partition is split even when that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # State of streams lies on the executors' disks; its changes go to the checkpoint.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

BROADCAST_LIMIT = "foliospark.broadcast.maxBytes"
SALT_BUCKETS = "foliospark.salt.buckets"

_local_root: str | None = None


def tune_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app_name: str = "foliospark",
    master: str | None = None,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """Create a tuned session; on a cluster ``master`` comes from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def broadcast_limit(spark: SparkSession) -> int:
    """Largest planned size, in bytes, of a side that may be broadcast."""
    return int(spark.conf.get(BROADCAST_LIMIT, str(32 * 1024 * 1024)))


def salt_buckets(spark: SparkSession) -> int:
    """Number of slices a possibly hot join key is spread over."""
    return int(spark.conf.get(SALT_BUCKETS, "16"))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Runtime settings for what is started inside, and the former ones afterwards."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting falls back to a temporary folder of this machine.
    """
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder all executors can reach"
        )
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="foliospark-")
    return _local_root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused folder below the scratch root."""
    return f"{scratch_root(spark)}/foliospark/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: lineage is cut, nothing recomputes.

    A Parquet table rather than an RDD checkpoint, so that later readers still
    prune columns and plan joins with real sizes. Lost executors cost nothing:
    the table lives in the shared folder.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
