"""A table kept as a base and a log of changes, merged when it is read.

Rows lie in buckets of their key. A batch of changes is appended as it comes, so that
it writes as many rows as it has. Reading resolves, for each key, the base row and the
changes logged since. When the changes of a bucket outgrow ``COMPACT_SHARE`` of its base,
the bucket alone is resolved into a new base version, and what it replaces is removed one
compaction later, when no reader can have it open any more.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32
COMPACT_SHARE = 0.25
FIRST = -1  # the version that the table starts with


@dataclass(frozen=True)
class MergeLog:
    """Where the table lies, its columns, and what makes a row the newest of its key.

    ``keys`` name a row. Of all versions of a key the one of the last batch counts,
    inside a batch that with the greatest ``newest``; the columns ``kept`` stay as the
    first version had them, inside a batch that with the least ``oldest``. Where versions
    add up otherwise, ``fold`` makes one row per key of rows with their ``version``.
    """

    path: str
    ddl: str
    keys: tuple[str, ...]
    newest: tuple[str, ...]
    kept: tuple[str, ...] = ()
    oldest: tuple[str, ...] = ()
    buckets: int = BUCKETS
    fold: Callable[[DataFrame], DataFrame] | None = None

    @property
    def base(self) -> str:
        return f"{self.path}/base"

    @property
    def log(self) -> str:
        return f"{self.path}/log"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, folder: str, version: int) -> None:
        """Write below (bucket, version), replacing what an interrupted run has left."""
        placed = rows.withColumn("bucket", self.bucket()).withColumn("version", F.lit(version))
        placed.hint("rebalance", "bucket").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("bucket", "version").parquet(folder)

    def rows(self, spark: SparkSession, folder: str) -> DataFrame:
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema(spark))
        make_folder(spark, folder)
        return spark.read.schema(f"{names}, bucket int, version long").parquet(folder)

    def schema(self, spark: SparkSession):
        return spark.createDataFrame([], self.ddl).schema

    def versions(self, spark: SparkSession, folder: str) -> DataFrame:
        """Rows of each (bucket, version); read from file footers, not from rows."""
        return self.rows(spark, folder).groupBy("bucket", "version").agg(F.count(F.lit(1)).alias("n"))


def make_folder(spark: SparkSession, folder: str) -> None:
    """Create a folder if there is none, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def remove_folders(spark: SparkSession, folders: Sequence[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def start(table: MergeLog, rows: DataFrame) -> None:
    """Write the first base version, unless the table is there already."""
    spark = rows.sparkSession
    if table.rows(spark, table.base).isEmpty():
        table.write(resolve(table, rows.withColumn("version", F.lit(FIRST))), table.base, FIRST)


def append_changes(table: MergeLog, changes: DataFrame, batch_id: int) -> None:
    """Log a batch of changes; the same batch again replaces itself."""
    table.write(changes.select(table.schema(changes.sparkSession).names), table.log, batch_id)


def resolve(table: MergeLog, versions: DataFrame) -> DataFrame:
    """One row per key from all its versions; ``version`` orders the batches."""
    if table.fold is not None:
        return table.fold(versions)
    columns = [c for c in versions.columns if c not in ("version", "bucket")]
    late = [c for c in columns if c not in (*table.keys, *table.kept)]
    aggregates = [
        F.max_by(F.struct(*late), F.struct("version", *table.newest)).alias("_late"),
    ]
    if table.kept:
        aggregates.append(
            F.min_by(F.struct(*table.kept), F.struct("version", *table.oldest)).alias("_kept")
        )
    merged = versions.groupBy(*table.keys).agg(*aggregates)
    parts = ["_late.*"] + (["_kept.*"] if table.kept else [])
    return merged.select(*table.keys, *parts).select(*columns)


def current(table: MergeLog, spark: SparkSession, buckets: Sequence[int] | None = None) -> DataFrame:
    """The merged table, or some buckets of it.

    Per bucket, the newest base version and the changes logged after it.
    """
    base, log = table.rows(spark, table.base), table.rows(spark, table.log)
    if buckets is not None:
        base, log = (df.filter(F.col("bucket").isin(list(buckets))) for df in (base, log))
    tops = base.groupBy("bucket").agg(F.max("version").alias("top"))
    tops = F.broadcast(tops)  # one row a bucket
    live = base.join(tops, "bucket").filter("version = top").drop("top")
    since = log.join(tops, "bucket", "left").filter("top IS NULL OR version > top").drop("top")
    # What is in the base came before every change.
    return resolve(table, live.withColumn("version", F.lit(FIRST).cast("long")).unionByName(since))


def compact(table: MergeLog, spark: SparkSession, share: float = COMPACT_SHARE) -> list[int]:
    """Resolve the buckets whose changes exceed ``share`` of their base; their numbers.

    What the last compaction of a bucket replaced is removed now.
    """
    base = {}
    for row in table.versions(spark, table.base).collect():
        base.setdefault(row.bucket, {})[row.version] = row.n
    logged = {}
    for row in table.versions(spark, table.log).collect():
        logged.setdefault(row.bucket, {})[row.version] = row.n
    due, upto, gone = [], FIRST, []
    for bucket, changes in logged.items():
        versions = base.get(bucket, {})
        top = max(versions, default=FIRST - 1)
        since = {v: n for v, n in changes.items() if v > top}
        if since and sum(since.values()) > share * versions.get(top, 0):
            due.append(bucket)
            upto = max(upto, *since)
            gone += [f"{table.base}/bucket={bucket}/version={v}" for v in versions if v < top]
            gone += [f"{table.log}/bucket={bucket}/version={v}" for v in changes if v <= top]
    if due:
        # All changes up to this version are in the buckets' new base.
        table.write(current(table, spark, due), table.base, upto)
        remove_folders(spark, gone)
    return sorted(due)
