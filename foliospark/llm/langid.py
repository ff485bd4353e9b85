"""Language identification: multinomial naive Bayes over hashed n-grams.

Texts are lower-cased; runs of characters other than letters and marks become
one boundary. Features are the n-grams of 1 to 3 characters inside a word, its
boundaries included, hashed into ``BUCKETS``. Training counts them in Arrow
batches over all given rows and sums the counts in Spark; the driver receives at
most languages x ``BUCKETS`` numbers, whatever the size of the corpus, and
broadcasts the matrix of log-probabilities. Scoring gathers rows of the matrix.

Defined results: a text that is null, empty or without a letter gets the language
``und`` and the score 0; so does every text if nothing was learned. Rows with a
null text or language teach nothing. Repeated rows count and are scored one by
one. The score is the posterior of the language; of equally likely languages
the first by name is taken. Long texts are scored whole, in several slices of the
same counts. Clashing names among the kept columns are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import byte_groups

BUCKETS = 1 << 17
ORDERS = 3
SMOOTHING = 0.5
UNKNOWN = "und"
GROUP_BYTES = 2_000_000
SLICE = 1_000_000  # characters hashed at once

LETTER, MARK = 1, 2


def character_kinds() -> np.ndarray:
    """LETTER or MARK for each code point, else 0."""
    kinds = np.zeros(0x110000, np.uint8)
    for code in range(0x20000):
        category = unicodedata.category(chr(code))[0]
        if category in "LM":
            kinds[code] = LETTER if category == "L" else MARK
    for code in range(0x20000, 0x40000):  # only letters are assigned there
        if unicodedata.category(chr(code))[0] == "L":
            kinds[code] = LETTER
    return kinds


def characters(
    texts: list[str], table: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and marks of all texts with 0 at word boundaries.

    ``table`` is that of :func:`character_kinds`, which a task makes once.
    Returns the characters, the bounds of each text among them, and whether each
    text has a letter. Every text begins and ends with a boundary.
    """
    lowered = [t.lower().replace("\0", " ") for t in texts]
    joined = "\0" + "\0".join(lowered) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = table[codes]
    wordly = kinds > 0
    kept = wordly.copy()
    kept[1:] |= wordly[:-1]  # the first of a run of others
    kept[codes == 0] = True
    separators = np.flatnonzero(codes == 0)
    bounds = (np.cumsum(kept) - 1)[separators]
    letters = np.append(0, np.cumsum(kinds == LETTER))[separators]
    found = np.where(wordly, codes, 0)[kept].astype(np.uint64)
    return found, bounds, np.diff(letters) > 0


def hashed_ngrams(
    codes: np.ndarray, bounds: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and text of every n-gram, in slices of bounded size."""
    for first in range(0, len(codes), SLICE):
        part = codes[first : first + SLICE + ORDERS - 1]
        text = np.searchsorted(bounds, np.arange(first, first + len(part)), "right") - 1
        hashed = np.zeros(len(part), np.uint64)
        inside = np.ones(len(part), bool)
        for order in range(1, ORDERS + 1):
            size = min(len(part) - order + 1, SLICE)
            if size <= 0:
                break
            last = part[order - 1 : order - 1 + size]
            hashed = (hashed[:size] + last + np.uint64(order)) * np.uint64(
                0x9E3779B97F4A7C15
            )
            hashed ^= hashed >> np.uint64(29)
            if order > 2:  # a boundary may only stand at the ends
                inside = inside[:size] & (part[order - 2 : order - 2 + size] > 0)
            inside = inside[:size]
            if order == 1:
                kept = last > 0
            elif order == 2:
                kept = (part[:size] > 0) | (last > 0)
            else:
                kept = inside
            yield (
                (hashed[kept] >> np.uint64(20)).astype(np.int64) % BUCKETS,
                text[:size][kept],
            )


@dataclass
class Model:
    """Languages in order of name; log-probabilities by bucket and language."""

    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows of ``df`` that have a text and a language."""
    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("lang", F.col("text").cast("binary").alias("data"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        table = character_kinds()
        for part, data in byte_groups(batches, GROUP_BYTES):
            names = part.column("lang").to_pylist()
            texts = [d.decode("utf-8", "replace") for d in data]
            codes, bounds, lettered = characters(texts, table)
            known = sorted(set(names))
            of_text = np.array([known.index(n) for n in names])
            sums = np.zeros((len(known), BUCKETS + 1), np.int64)
            for bucket, row in hashed_ngrams(codes, bounds):
                cell = of_text[row] * (BUCKETS + 1) + bucket
                sums += np.bincount(cell, minlength=sums.size).reshape(sums.shape)
            # The last column counts texts, for the prior.
            sums[:, -1] = np.bincount(of_text, lettered, minlength=len(known))
            for name, row in zip(known, sums):
                totals[name] = totals.get(name, 0) + row
        for name, row in totals.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(at), pa.string()),
                    pa.array(at.astype(np.int32)),
                    pa.array(row[at]),
                ],
                ["lang", "bucket", "n"],
            )

    counted = rows.mapInArrow(count, "lang string, bucket int, n long")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique().tolist())
    counts = np.zeros((BUCKETS + 1, len(languages)))
    column = found["lang"].map({n: k for k, n in enumerate(languages)}).to_numpy(int)
    counts[found["bucket"].to_numpy(int), column] = found["n"].to_numpy()
    texts, grams = counts[-1], counts[:-1]
    used = max(int((grams.sum(1) > 0).sum()), 1)
    totals = grams.sum(0) + SMOOTHING * (used + 1)
    weights = np.log((grams + SMOOTHING) / totals).astype(np.float32)
    prior = np.log((texts + SMOOTHING) / (texts.sum() + SMOOTHING * max(len(texts), 1)))
    return Model(languages, prior, weights)


def predict(
    df: DataFrame, model: Model, text: str = "text", kept: list[str] | None = None
) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to the columns ``kept`` (default: all)."""
    kept = [c for c in kept or df.columns if c not in ("lang_pred", "score")]
    return predict_rows(df, model, text, kept).select("row.*", "lang_pred", "score")


def predict_rows(df: DataFrame, model: Model, text: str, kept: list[str]) -> DataFrame:
    """The columns ``kept`` in a struct ``row``, ``lang_pred`` and ``score``."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data")
    rows = df.select(F.struct(*kept).alias("row"), data)
    shared = df.sparkSession.sparkContext.broadcast(
        (model.languages, model.prior, model.weights)
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = Model(*shared.value), character_kinds()
        for part, data in byte_groups(batches, GROUP_BYTES):
            texts = [d.decode("utf-8", "replace") for d in data]
            codes, bounds, lettered = characters(texts, table)
            names, scores = judge(model, codes, bounds, lettered)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(names, pa.string()), pa.array(scores)],
                ["row", "lang_pred", "score"],
            )

    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double"
    return rows.mapInArrow(score, schema)


def judge(
    model: Model, codes: np.ndarray, bounds: np.ndarray, lettered: np.ndarray
) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior."""
    texts = len(lettered)
    if not model.languages:
        return [UNKNOWN] * texts, np.zeros(texts)
    total = np.tile(model.prior, (texts, 1))
    for bucket, text in hashed_ngrams(codes, bounds):
        starts = np.flatnonzero(np.diff(text, prepend=-1))
        if len(starts):
            sums = np.add.reduceat(model.weights[bucket], starts, axis=0, dtype=np.float64)
            total[text[starts]] += sums
    best = total.argmax(1)
    posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered)]
    return names, np.where(lettered, posterior, 0.0)
