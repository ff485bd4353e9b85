"""How filters interact: decision diagrams over the failures of documents.

A document's failure mask says which of the filters it fails. Spark counts the masks
of every part. Each part's counts become a decision diagram: one level per filter,
a low edge for passing and a high edge for failing it, equal subtrees shared, and
every node weighted by the documents below it. The all-pass path, along the low
edges from the root, gives the steps of one filter order: what stays after a step is
the weight of the node reached, what the step removes that of the high child passed.
All orders are visited by swaps of two adjacent levels, each of which rebuilds these
two levels only.

Only counts of masks reach a diagram, at most two to the number of filters for each
part, whatever the size of the corpus. Copies are found by joining documents with
the first of each text on (digest, id), so that copies of one text do not share a
key.

Defined results: a null text is empty, a null part the empty string. Documents
without label are neither good nor toxic; a document with several labels is good if
one of them says so, and toxic likewise. A null id is no copy of anything and no text
is a copy of it. Rows of the same id are no copies of each other; repeated rows count
one by one. Texts of any length are read whole. An empty table gives no rows. Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import byte_groups
from foliospark.session import materialise

CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#$%&*|"

Weight = tuple[int, int, int]  # documents, good ones, toxic ones


class Diagram:
    """A shared decision diagram over failure masks, weighted by counts.

    Nodes are numbers; ``levels[k]`` maps those of level k to their low and high
    child. All masks have all levels, so that a swap never meets an edge that skips one.
    """

    def __init__(self, counts: dict[int, Weight], filters: int):
        self.order = list(range(filters))
        self.weight: list[Weight] = []
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in range(filters)]
        leaves: dict[Weight, int] = {}
        for mask in range(1 << filters):
            weight = counts.get(mask, (0, 0, 0))
            if weight not in leaves:
                leaves[weight] = self._node(weight)
        # The level of the last filter joins masks that differ in its bit, and so on up.
        below = [leaves[counts.get(m, (0, 0, 0))] for m in range(1 << filters)]
        for level in reversed(range(filters)):
            half = 1 << level
            shared: dict[tuple[int, int], int] = {}
            below = [
                self._shared(level, shared, below[m], below[m | half]) for m in range(half)
            ]
        self.root = below[0]

    def _node(self, weight: Weight) -> int:
        self.weight.append(weight)
        return len(self.weight) - 1

    def _shared(self, level: int, shared: dict, low: int, high: int) -> int:
        """The node of a level with these children, made if there is none."""
        found = shared.get((low, high))
        if found is None:
            a, b = self.weight[low], self.weight[high]
            found = shared[low, high] = self._node((a[0] + b[0], a[1] + b[1], a[2] + b[2]))
            self.levels[level][found] = (low, high)
        return found

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next one.

        Nodes of the upper level keep their numbers, so that nothing above changes.
        """
        upper, lower = self.levels[level], self.levels[level + 1]
        self.levels[level + 1] = {}
        shared: dict[tuple[int, int], int] = {}
        for node, (low, high) in upper.items():
            (low_low, low_high), (high_low, high_high) = lower[low], lower[high]
            upper[node] = (
                self._shared(level + 1, shared, low_low, high_low),
                self._shared(level + 1, shared, low_high, high_high),
            )
        order = self.order
        order[level], order[level + 1] = order[level + 1], order[level]

    def steps(self) -> Iterator[tuple[int, Weight, Weight]]:
        """Each filter in order, what stays after it and what it removes."""
        node = self.root
        for level, name in enumerate(self.order):
            low, high = self.levels[level][node]
            yield name, self.weight[low], self.weight[high]
            node = low


def adjacent_swaps(size: int) -> Iterator[int]:
    """Places whose swaps with the next one lead through all orders, each once."""
    if size < 2:
        return
    down = True
    sweep = list(range(size - 1))
    for inner in adjacent_swaps(size - 1):
        yield from reversed(sweep) if down else sweep
        # The last item now stands at one end; the others change among themselves.
        yield inner + 1 if down else inner
        down = not down
    yield from reversed(sweep) if down else sweep


def every_order(counts: dict[int, Weight], names: str) -> pd.DataFrame:
    """The steps of all orders of the filters over the mask counts of one part."""
    diagram = Diagram(counts, len(names))
    rows: list[tuple] = []
    failing = [0] * len(names)
    alone = [0] * len(names)
    summed = [0] * len(names)

    def read() -> None:
        label = "".join(names[k] for k in diagram.order)
        for step, (name, stay, gone) in enumerate(diagram.steps(), 1):
            rows.append((label, step, name, stay[0], *gone))
            summed[name] += gone[0]
            if step == 1:  # all that fail the filter
                failing[name] = gone[0]
            if step == len(names):  # those that pass all others
                alone[name] = gone[0]

    read()
    for level in adjacent_swaps(len(names)):
        diagram.swap(level)
        read()
    return pd.DataFrame(
        [
            (label, step, stay, gone, failing[k] - gone, alone[k], good, toxic, summed[k])
            for label, step, k, stay, gone, good, toxic in rows
        ],
        columns=[
            "filter_order",
            "step",
            "kept",
            "removed",
            "redundant",
            "unique_fails",
            "good_lost",
            "toxic_lost",
            "shapley",
        ],
    )


def audit(
    df: DataFrame, part: Column, failures: dict[str, Column], good: Column, toxic: Column
) -> DataFrame:
    """Steps of every filter order by part.

    ``failures`` maps one-letter names to conditions. A result row is one part, order
    and step; ``shapley`` sums what its filter removes over all orders.
    """
    names = "".join(failures)
    mask = sum(
        (F.coalesce(c, F.lit(False)).cast("int") * (1 << k) for k, c in enumerate(failures.values())),
        F.lit(0),
    )
    flag = [F.coalesce(c, F.lit(False)).cast("long") for c in (good, toxic)]
    counts = (
        df.select(
            F.coalesce(part, F.lit("")).alias("part"),
            mask.alias("mask"),
            flag[0].alias("good"),
            flag[1].alias("toxic"),
        )
        .groupBy("part", "mask")
        .agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    )

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        weights = zip(rows["n"].tolist(), rows["good"].tolist(), rows["toxic"].tolist())
        steps = every_order(dict(zip(rows["mask"].tolist(), weights)), names)
        steps.insert(0, "part", key[0])
        return steps

    return counts.groupBy("part").applyInPandas(
        run,
        "part string, filter_order string, step int, kept long, removed long, redundant long, "
        "unique_fails long, good_lost long, toxic_lost long, shapley long",
    )


def text_measures(df: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """Numbers the filters judge by and a digest of each whole text."""
    rows = df.select(
        F.col(key).cast("long").alias("id"),
        F.col(part).cast("string").alias("part"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_groups(batches):
            found = []
            for data in texts:
                words = data.split()  # at spaces and the five control characters
                found.append(
                    (
                        len(words),
                        len(set(words)),
                        len(data) - len(data.translate(None, CAPITALS)),
                        len(data.decode("utf-8", "replace")),
                        len(data) - len(data.translate(None, MARKS)),
                        hashlib.sha256(data).digest(),
                    )
                )
            columns = list(zip(*found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("part"),
                    *(pa.array(c, pa.int64()) for c in columns[:5]),
                    pa.array(columns[5], pa.binary()),
                ],
                ["id", "part", *NUMBERS, "digest"],
            )

    numbers = ", ".join(f"{n} long" for n in NUMBERS)
    return rows.mapInArrow(run, f"id long, part string, {numbers}, digest binary")


NUMBERS = ("n_words", "n_distinct", "n_capitals", "n_chars", "n_marks")


def text_audit(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> DataFrame:
    """Audit of five filters on texts: short, repetitive, loud, marked and copied ones."""
    measured = materialise(text_measures(df, key, text, part), "measures")
    firsts = measured.groupBy("digest").agg(F.min("id").alias("id"))
    firsts = firsts.withColumn("first", F.lit(True))
    marks = (
        labels.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("long").alias("id"))
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    )
    judged = measured.join(firsts, ["digest", "id"], "left").join(marks, "id", "left")
    return audit(
        judged,
        F.col("part"),
        {
            "A": F.col("n_words") < 100,
            "B": 100 * F.col("n_distinct") < 80 * F.col("n_words"),
            "C": 100 * F.col("n_capitals") > 10 * F.col("n_chars"),
            "D": F.col("n_marks") > 0,
            "E": F.col("id").isNotNull() & F.col("first").isNull(),
        },
        F.col("good"),
        F.col("toxic"),
    )


# The same result from the tables; every order and step is summed anew over the masks.
ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents),
worded AS (
  SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY body) AS least
  FROM base),
marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good,
         max(CAST(toxic = 1 AS INTEGER)) AS toxic
  FROM labels GROUP BY doc_id),
masked AS (
  SELECT part,
         CAST(len(words) < 100 AS INTEGER)
         + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INTEGER)
         + 4 * CAST(100 * length(regexp_replace(body, '[^A-Z]', '', 'g'))
                    > 10 * length(body) AS INTEGER)
         + 8 * CAST(regexp_matches(body, '[#$%&*|]') AS INTEGER)
         + 16 * CAST(coalesce(doc_id > least, false) AS INTEGER) AS mask,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM worded LEFT JOIN marks USING (doc_id)),
counts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM masked GROUP BY part, mask),
letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order,
         [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(list_sum(bits[1:step]) AS BIGINT) AS upto
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
summed AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & upto = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & upto = bit THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & (upto - bit) <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & upto = bit THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & upto = bit THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM summed"""
