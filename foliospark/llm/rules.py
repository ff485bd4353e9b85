"""Quality rules: text measures and a learned decision list over them.

One pass in Arrow batches takes the measures of each whole text. The decision
list comes from labelled rows by sequential covering: a rule is a conjunction of
thresholds, grown on two thirds of the rows by information gain until it
covers no good text, pruned on the other third, and kept while it is precise;
the bad texts it covers are taken out before the next rule is grown. The list
becomes one Spark ``CASE WHEN`` expression in the order of the rules.

Learning reads at most ``SAMPLE_ROWS`` labelled rows, those with the least hash
of their key, so that the driver holds a bounded table. Everything else covers
all rows.

Defined results: a null text has no words, like an empty one; both fail the base
rules. Ratios of a text without words are 0. Rows without a label, labels without
a row and null labels or keys teach nothing; without both good and bad labels the
list is empty and keeps everything. Repeated rows are measured one by one; a key
with several labels counts as bad if one of them is. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import byte_groups
from foliospark.session import materialise

SAMPLE_ROWS = 50_000
MIN_PRECISION = 0.95
MIN_COVERED = 5
MIN_PRUNED = 2
MAX_CONDITIONS = 4
MAX_RULES = 32
THRESHOLDS = 64  # candidate thresholds a feature offers at a time

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct",
    "n_upper",
    "n_digits",
    "n_marks",
)


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words in windows of three that occur twice or more, and distinct words."""
    index = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(words) < 4:
        return 0, len(index)
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    pairs = ids[:-1] * len(index) + ids[1:]
    if len(index) >= 1 << 20:  # three numbers would not fit into one
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(index) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0, len(index)
    twice = np.zeros(len(windows), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    marked = np.zeros(len(words), bool)
    for k in range(3):
        marked[at + k] = True
    return int(marked.sum()), len(index)


def measure(data: bytes) -> tuple[int, ...]:
    """The ``MEASURES`` of one text."""
    words = data.split()
    inked = data.translate(None, WHITE)
    text = inked.decode("utf-8", "replace")
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeated, distinct = repeated_words(words)
    return (
        len(words),
        len(text),
        len(inked) - len(inked.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        distinct,
        len(inked) - len(inked.translate(None, CAPITALS)),
        len(inked) - len(inked.translate(None, b"0123456789")),
        len(inked) - len(inked.translate(None, b"!?")),
    )


def measures(df: DataFrame, text: str = "text", kept: list[str] | None = None) -> DataFrame:
    """The columns ``kept`` (default: all) in a struct ``kept``, and the measures."""
    rows = df.select(
        F.struct(*(kept or df.columns)).alias("kept"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"),
    )
    schema = f"kept {rows.schema['kept'].dataType.simpleString()}, " + ", ".join(
        f"{m} long" for m in MEASURES
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data in byte_groups(batches):
            found = np.array([measure(d) for d in data], np.int64).reshape(-1, len(MEASURES))
            columns = [pa.array(found[:, k]) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays(
                [part.column("kept"), *columns], ["kept", *MEASURES]
            )

    return rows.mapInArrow(run, schema)


def features() -> dict[str, Column]:
    """What the thresholds of the list may test, from the measures."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return {
        "symbols": F.col("n_symbols") / chars,
        "upper": F.col("n_upper") / chars,
        "digits": F.col("n_digits") / chars,
        "marks": F.col("n_marks") / words,
        "word_length": F.col("word_chars") / words,
        "distinct": F.col("n_distinct") / words,
        "repeats": F.col("n_repeat_words") / words,
        "dup_lines": F.col("n_dup_lines") / lines,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float


Rule = tuple[Condition, ...]


def covered(rows: np.ndarray, names: list[str], rule: Rule) -> np.ndarray:
    hit = np.ones(len(rows), bool)
    for c in rule:
        column = rows[:, names.index(c.feature)]
        hit &= column > c.threshold if c.above else column <= c.threshold
    return hit


def gain(bad: np.ndarray, good: np.ndarray, all_bad: int, all_good: int) -> np.ndarray:
    """Information gained on the bad rows by covering only ``bad`` and ``good``."""
    before = np.log2((all_bad + 1) / (all_bad + all_good + 1))
    return bad * (np.log2((bad + 1) / (bad + good + 1)) - before)


def best_condition(rows: np.ndarray, bad: np.ndarray, names: list[str]) -> Condition | None:
    best, best_gain = None, 1e-9
    for k, name in enumerate(names):
        values = np.unique(rows[:, k])
        if len(values) < 2:
            continue
        middle = (values[1:] + values[:-1]) / 2
        if len(middle) > THRESHOLDS:
            # Quantiles of the bad and of the good rows, so that few rows of one
            # kind at an end are still told apart; and the edges of the good.
            asked = np.linspace(0, 1, THRESHOLDS // 2)
            ends = np.quantile(rows[bad, k], asked), np.quantile(rows[~bad, k], asked)
            at = np.searchsorted(values, np.concatenate(ends)).clip(1, len(values) - 1)
            middle = middle[np.unique(np.concatenate([at - 1, at.clip(max=len(middle) - 1)]))]
        order = np.sort(rows[bad, k]), np.sort(rows[~bad, k])
        low_bad, low_good = (np.searchsorted(o, middle, "right") for o in order)
        counts = len(order[0]), len(order[1])
        for above in (True, False):
            in_bad = counts[0] - low_bad if above else low_bad
            in_good = counts[1] - low_good if above else low_good
            gains = gain(in_bad, in_good, *counts)
            at = int(np.argmax(gains))
            if gains[at] > best_gain:
                best, best_gain = Condition(name, above, float(middle[at])), gains[at]
    return best


def grow(rows: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS and bad.any() and not bad.all():
        condition = best_condition(rows, bad, names)
        if condition is None:
            break
        rule += (condition,)
        hit = covered(rows, names, (condition,))
        rows, bad = rows[hit], bad[hit]
    return rule


def prune(rule: Rule, rows: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    """The beginning of the rule that tells bad from good best on other rows."""

    def worth(size: int) -> tuple[float, int]:
        hit = covered(rows, names, rule[:size])
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return ((p - n) / (p + n) if p + n else -1.0, -size)

    return rule[: max(range(1, len(rule) + 1), key=worth)] if rule else rule


def learn(rows: np.ndarray, bad: np.ndarray, names: list[str]) -> list[Rule]:
    """An ordered list of rules that cover bad rows and hardly any good one."""
    found: list[Rule] = []
    third = np.arange(len(rows)) % 3 == 2
    left = np.ones(len(rows), bool)
    while len(found) < MAX_RULES and (bad & left).sum() >= MIN_COVERED:
        growing, pruning = left & ~third, left & third
        rule = prune(
            grow(rows[growing], bad[growing], names), rows[pruning], bad[pruning], names
        )
        hit = covered(rows, names, rule) & left
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        # The rows it was grown on flatter a rule: the others must bear it out.
        q = int((hit & bad & third).sum())
        m = int((hit & ~bad & third).sum())
        if not rule or p < MIN_COVERED or p < MIN_PRECISION * (p + n):
            break
        if q < MIN_PRUNED or q < MIN_PRECISION * (q + m):
            break
        found.append(rule)
        left &= ~hit
    return found


def as_column(rules: list[Rule], otherwise: bool = True) -> Column:
    """The list as one conditional expression: true where a text is kept."""
    expressions = features()
    result = None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            value = expressions[c.feature]
            test &= value > c.threshold if c.above else value <= c.threshold
        result = F.when(test, F.lit(False)) if result is None else result.when(test, F.lit(False))
    return F.lit(otherwise) if result is None else result.otherwise(F.lit(otherwise))


def fit(measured: DataFrame, labels: DataFrame, key: str = "doc_id") -> list[Rule]:
    """The decision list from the labelled rows of ``measured``.

    ``labels`` has ``key`` and ``quality`` (0: bad).
    """
    labelled = labels.groupBy(F.col(key).alias("key")).agg(F.min("quality").alias("quality"))
    named = measured.withColumn("key", F.col(f"kept.`{key}`"))
    columns = features()
    sample = (
        named.join(labelled.filter("quality IS NOT NULL"), "key")
        .select(
            F.xxhash64("key").alias("order"),
            "key",
            (F.col("quality") == 0).alias("bad"),
            *[c.alias(n) for n, c in columns.items()],
        )
        .orderBy("order", "key", *columns)
        .limit(SAMPLE_ROWS)
        .toPandas()
    )
    names = list(columns)
    rows = sample[names].to_numpy(float)
    return learn(rows, sample["bad"].to_numpy(bool), names)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge_rows(
    df: DataFrame, labels: DataFrame, key: str, text: str, carried: list[str]
) -> DataFrame:
    """``carried`` in a struct ``row``, the measures, ``base_failed`` and ``kept``."""
    measured = materialise(measures(df, text, [key]), "measures")
    verdict = as_column(fit(measured, labels, key))
    if carried != [key]:
        # Measuring again is cheaper than writing whole rows beside the measures.
        measured = measures(df, text, carried)
    return measured.select(
        F.col("kept").alias("row"),
        *MEASURES,
        base_failed().alias("base_failed"),
        (~base_failed() & verdict).alias("kept"),
    )


def judge(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    kept: list[str] | None = None,
) -> DataFrame:
    """Measures and verdict of every row, learned from ``labels``.

    The columns ``kept`` (default: ``key``), the measures, ``base_failed`` and
    ``kept`` (false if the base rules or the list reject the text). Carried columns
    of these names are replaced.
    """
    kept = kept or [key]
    judged = judge_rows(df, labels, key, text, list(dict.fromkeys([*kept, key])))
    own = {*MEASURES, "base_failed", "kept"}
    return judged.select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept if c not in own],
        *MEASURES,
        "base_failed",
        "kept",
    )
