"""Building blocks that keep joins, sequences and groups bounded per task.

One key may own a third of all rows, so nothing here puts a whole group into
one task: joins on few-valued keys broadcast a measured side or salt the
large one, "latest per key" is an aggregate with map-side combining, and
running totals and value-range frames are cut into buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import broadcast_limit, salt_buckets

SMALL_BYTES = 256 * 1024 * 1024  # a table that may be dealt anew to all cores
WAVES = 4  # tasks a core gets one after the other of rows that are dealt evenly


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate: file bytes for a table, k rows for a top-k."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def spread_small(df: DataFrame, *by: str) -> DataFrame:
    """Give a small input to all cores before costly work per row.

    A table of a few files is read by as few tasks. Shuffling it is cheap, as it
    is at most ``SMALL_BYTES`` whatever the cluster; a larger table has splits
    enough and is left as it is.
    """
    if planned_bytes(df) < SMALL_BYTES:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *by)
    return df


def spread_evenly(df: DataFrame) -> DataFrame:
    """Deal rows to all cores before work that waits for each of them.

    Such work takes as long as a task has rows, and a core without a task waits for
    nothing. Splits of files are as many and as even as the files; here each core gets
    ``WAVES`` tasks of the same number of rows, whatever their keys.
    """
    return df.repartition(WAVES * df.sparkSession.sparkContext.defaultParallelism)


def join_dimension(
    fact: DataFrame,
    dimension: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] = (),
    unfolded: int = 1,
) -> DataFrame:
    """Join a large table with a side that is normally small, on few keys.

    The side is broadcast only if its planned size, times the rows that each of
    its rows was ``unfolded`` into, is within the limit: plans do not count what
    an explode adds.
    Beyond it the join is salted: the large table is spread over ``spread``
    columns, the other side repeated once per slice, so a hot key is shared
    by many tasks. Meant for keys such as the project or the question, of
    which the other side has few rows each; for keys as many as files or
    pages see :func:`join_by_key`. ``how`` may be inner, left, left_semi or
    left_anti.
    """
    on = list(on)
    if planned_bytes(dimension) * unfolded <= broadcast_limit(fact.sparkSession):
        return fact.join(F.broadcast(dimension), on, how)
    return salted_join(fact, dimension, on, how, spread)


def join_by_key(
    fact: DataFrame,
    side: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    unfolded: int = 1,
) -> DataFrame:
    """Join with a side that may be large itself: keys of files, pages or rows.

    A side within the limit, ``unfolded`` included, is broadcast. Otherwise both are shuffled once, and
    the adaptive skew join, which the session settings force, splits the
    partition of a hot key and repeats only that key's few rows of ``side``.
    """
    if planned_bytes(side) * unfolded <= broadcast_limit(fact.sparkSession):
        side = F.broadcast(side)
    return fact.join(side, list(on), how)


def salted_join(
    fact: DataFrame,
    dimension: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] = (),
) -> DataFrame:
    """Equi-join whose hot keys are spread over several tasks."""
    slices = salt_buckets(fact.sparkSession)
    spread = list(spread) or [c for c in fact.columns if c not in on][:1]
    if not spread:  # nothing but the key: left to the adaptive skew join
        return fact.join(dimension, list(on), how)
    salted = fact.withColumn("_slice", F.pmod(F.xxhash64(*spread), F.lit(slices)))
    repeated = dimension.withColumn(
        "_slice",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))),
    )
    return salted.join(repeated, [*on, "_slice"], how).drop("_slice")


def latest_per_key(
    df: DataFrame, keys: Sequence[str], ordering: Sequence[Column]
) -> DataFrame:
    """The row with the greatest ``ordering`` for each key.

    An aggregate, not a ranking window: partial results are combined before
    the shuffle, so a key with very many versions is no hot spot.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(row, F.struct(*ordering)).alias("_row"))
        .select("_row.*")
    )


def first_per_key(
    df: DataFrame, keys: Sequence[str], ordering: Sequence[Column]
) -> DataFrame:
    """The row with the least ``ordering`` for each key (DISTINCT ON)."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return (
        df.groupBy(*keys)
        .agg(F.min_by(row, F.struct(*ordering)).alias("_row"))
        .select("_row.*")
    )


def offsets_in_group(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    size: str,
    out: str,
    bucket_width: int = 4096,
) -> DataFrame:
    """Add the sum of ``size`` over all rows of the group with a lower ``order``.

    ``order`` is an integer, unique in its group. Rows are summed inside
    buckets of ``bucket_width`` consecutive orders and the bucket totals are
    then accumulated, so one task sees at most a bucket of rows, or one row
    per bucket of a group, never all rows of a hot group.
    """
    group = list(group)
    # One shuffle of narrow rows serves the sums inside and across buckets: both
    # read the same columns of it and the bucket is never NULL, which would put
    # a filter below one of the two, so Spark reuses the exchange.
    bucket = F.coalesce(F.floor(F.col(order) / bucket_width), F.lit(0))
    bucketed = df.withColumn("_bucket", bucket).repartition(*group, "_bucket")
    inside = (
        Window.partitionBy(*group, "_bucket")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = (
        Window.partitionBy(*group)
        .orderBy("_last")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        bucketed.groupBy(*group, "_bucket")
        .agg(F.sum(size).alias("_total"), F.max(order).alias("_last"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(across), F.lit(0)))
        .drop("_total", "_last")
    )
    return (
        bucketed.withColumn(
            "_inside", F.coalesce(F.sum(size).over(inside), F.lit(0))
        )
        .join(before, [*group, "_bucket"])
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_bucket", "_before", "_inside")
    )


def range_frame(
    df: DataFrame,
    group: Sequence[str],
    number: str,
    before: int,
    after: int,
    value: str,
    out: str,
    bucket_width: int = 4096,
) -> DataFrame:
    """Collect ``value`` over ``number - before .. number + after`` per row.

    The frame is a value range: gaps shrink it and equal numbers are peers.
    A group is cut into buckets of consecutive numbers and only the rows near
    a bucket's edge are copied into the neighbouring one, so a hot group
    is spread over many tasks and the result is exact.
    """
    group = list(group)
    n = F.col(number).cast("long")
    home = F.floor(n / bucket_width)
    copies = F.sequence(
        F.floor((n - after) / bucket_width), F.floor((n + before) / bucket_width)
    )
    frame = (
        Window.partitionBy(*group, "_bucket")
        .orderBy("_number")
        .rangeBetween(-before, after)
    )
    return (
        df.withColumn("_number", n)
        .withColumn("_home", home)
        .withColumn("_bucket", F.explode(copies))
        .withColumn(out, F.collect_list(value).over(frame))
        .filter(F.col("_bucket") == F.col("_home"))
        .drop("_number", "_home", "_bucket")
    )
