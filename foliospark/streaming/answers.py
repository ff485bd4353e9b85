"""Completions as a stream: correlation, the level barrier, chained starts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.session import materialise
from foliospark.sources.sinks import INGESTED, route_events
from foliospark.streaming import landing, merge_log


def correlate_stream(completions: DataFrame, requests: DataFrame) -> DataFrame:
    """A completion stream against the table of written requests."""
    return completions.join(requests, ["evaluation_id", "content_id"])


def correlate_streams(
    requests: DataFrame,
    completions: DataFrame,
    deadline: timedelta,
    lateness: timedelta,
) -> DataFrame:
    """Two streams, each request with its completion or as ``expired``.

    ``requests`` have ``requested_at`` and ``completions`` ``completed_at`` beside
    (evaluation_id, content_id). A completion counts if it was made between its
    request and ``deadline`` after it, in whichever order the two arrive, up to
    ``lateness`` behind the newest row. A request whose deadline is past for both
    streams comes out with the status ``expired``, once; a redelivered completion
    counts once. State is kept only as long as rows may still meet.
    """
    keys = ["evaluation_id", "content_id"]
    allowed = f"{int(lateness.total_seconds())} seconds"
    asked = requests.withWatermark("requested_at", allowed)
    given = completions.withWatermark("completed_at", allowed)
    given = given.dropDuplicates([*keys, "completed_at"])
    last = F.col("q.requested_at") + F.lit(deadline)
    met = [F.col(f"q.{k}") == F.col(f"c.{k}") for k in keys]
    met += [F.col("c.completed_at") >= F.col("q.requested_at"), F.col("c.completed_at") <= last]
    joined = asked.alias("q").join(given.alias("c"), reduce(and_, met), "left_outer")
    return joined.select(
        "q.*",
        *[f"c.{c}" for c in completions.columns if c not in keys],
        F.when(F.col("c.completed_at").isNull(), "expired").otherwise("answered").alias("status"),
    )


ITEM_KEYS = ("workflow_id", "level", "evaluation_id", "content_id")
LEVEL = ("workflow_id", "level")


def level_barrier(
    completions: DataFrame,
    path: str,
    checkpoint: str,
    next_level: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """T5: fire each (workflow, level) once, when its last item has arrived.

    ``completions`` has the ``ITEM_KEYS`` and ``expected``. Redelivered items are
    dropped by the stream's state. Every batch writes the items of the levels that are
    still open after it below ``path/open``, for the next one to go on with; so a batch
    costs what it brings and what is open, and looks only at the keys of levels that have
    fired. There is no watermark: a level fires however late its last item is. Fired
    levels are written to ``path/fired`` as (workflow_id, level, finished); ``next_level``
    turns their items into the tasks of the next level, which are written to
    ``path/tasks``. A batch run again overwrites its own output.
    """
    spark = completions.sparkSession

    def of_levels(items: DataFrame, levels: DataFrame, how: str) -> DataFrame:
        same = [F.col(f"i.{k}").eqNullSafe(F.col(f"l.{k}")) for k in LEVEL]
        return items.alias("i").join(levels.select(*LEVEL).alias("l"), reduce(and_, same), how)

    def write(batch: DataFrame, batch_id: int) -> None:
        # Written first: reading the batch twice would run its stateful part twice.
        items = materialise(batch, "level-items")
        known = landing.stored(spark, f"{path}/fired")
        if known is not None:  # more items than were due
            items = of_levels(items, known.filter(F.col("batch_id") < batch_id), "left_anti")
        before = landing.stored(spark, f"{path}/open/{batch_id - 1}")
        if before is not None:
            items = items.unionByName(before)
        levels = items.groupBy(*LEVEL).agg(
            F.count(F.lit(1)).alias("finished"), F.max("expected").alias("_expected")
        )
        complete = F.col("finished") >= F.coalesce("_expected", F.lit(0))
        fired = materialise(levels.filter(complete).select(*LEVEL, "finished"), "fired-levels")
        landing.write_batch(fired, batch_id, f"{path}/fired")
        if next_level is not None:
            now = of_levels(items, fired, "left_semi").select(*completions.columns)
            landing.write_batch(next_level(now), batch_id, f"{path}/tasks")
        left = of_levels(items, fired, "left_anti")
        left.write.mode("overwrite").parquet(f"{path}/open/{batch_id}")
        # A batch run again needs only what the one before it has left.
        merge_log.remove_folders(spark, [f"{path}/open/{batch_id - 2}"])

    once = completions.dropDuplicates(list(ITEM_KEYS))
    return landing.run_batches(once, write, checkpoint)


def evaluation_starts(events: DataFrame) -> DataFrame:
    """Files whose ingestion succeeded, from the stream of bus events."""
    return route_events(events, INGESTED)
