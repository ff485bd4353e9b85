"""Best-fit packing of documents into sequences by the sum of squares.

A document goes where the sum over all gaps of (open sequences with that gap)
squared becomes smallest: into an open sequence of the best gap, or into a new
one. This keeps gaps of all sizes on offer instead of piling up one that no
document fits. Placement depends on lengths only, so documents are dealt evenly
over groups of ``GROUP_PIECES`` by a hash of their row number, and every group
is packed on its own, the longest first. What a group leaves open at its end is
the only loss against packing all at once.

Defined results: a null or empty text is its separator alone. Repeated rows are
packed one by one. Longer documents are cut from their end, so that only their
first piece may be shorter than a sequence; whole pieces fill sequences of
their own. An empty table gives no rows. Lengths below 1 or above the capacity
are an error of the caller and raise. Other columns are carried along.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.bpe import shared_encoder
from foliospark.llm.common import GROUP_BYTES, byte_groups, with_bytes
from foliospark.session import materialise

GROUP_PIECES = 16384


def token_pieces(
    df: DataFrame,
    path: str,
    capacity: int,
    separator: int = 0,
    key: str = "doc_id",
    text: str = "text",
    held_bytes: int = GROUP_BYTES,
    with_ids: bool = True,
) -> DataFrame:
    """The pieces of at most ``capacity`` tokens of each document.

    A document is its ids and then ``separator``. Columns: ``key``, ``piece``,
    ``start``, ``length``, ``ids`` as little-endian unsigned 32-bit numbers, NULL
    unless ``with_ids``, and their ``ids_crc32``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        for part, data in byte_groups(batches, held_bytes):
            ids, bounds = encoder.encode([d.decode("utf-8", "replace") for d in data])
            rows: list[tuple] = []
            for key, a, b in zip(part.column("id").to_pylist(), bounds, bounds[1:]):
                whole = np.append(ids[a:b], separator).astype("<u4")
                first = len(whole) % capacity or capacity
                cuts = [0, *range(first, len(whole) + 1, capacity)]
                for piece, (start, end) in enumerate(zip(cuts, cuts[1:])):
                    cut = whole[start:end].tobytes()
                    crc = zlib.crc32(cut)
                    rows.append((key, piece, start, end - start, cut if with_ids else None, crc))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int32()),
                    pa.array(columns[2], pa.int64()),
                    pa.array(columns[3], pa.int64()),
                    pa.array(columns[4], pa.binary()),
                    pa.array(columns[5], pa.int64()),
                ],
                ["id", "piece", "start", "length", "ids", "ids_crc32"],
            )

    return (
        with_bytes(df, key, text)
        .mapInArrow(
            run, "id long, piece int, start long, length long, ids binary, ids_crc32 long"
        )
        .withColumnRenamed("id", key)
    )


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length, taken in the given order."""
    # Sequences by gap. Gaps that no length fits are closed and do not count, or else
    # new sequences would be opened to balance them.
    open_with = np.zeros(capacity + 1, np.int64)
    least = int(lengths.min()) if len(lengths) else 0
    stacks: dict[int, list[int]] = {}
    sequence = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    used = 0
    for k, length in enumerate(lengths.tolist()):
        # Half the growth of the sum of squares, less what all choices share. A
        # gap of ``length`` is closed and adds no new one; ties keep to it, then
        # to an open sequence.
        growth = open_with[: capacity - length + 1] - open_with[length:]
        growth[open_with[length:] == 0] = np.iinfo(np.int64).max
        if len(growth) == 1:
            gap = capacity
        else:
            growth[0] -= open_with[length] > 0
            at = int(np.argmin(growth[:-1]))
            fresh = open_with[capacity - length]
            gap = at + length if growth[at] <= fresh else capacity
            if growth[at] == np.iinfo(np.int64).max:
                gap = capacity
        if gap == capacity:
            chosen = used
            used += 1
        else:
            chosen = stacks[gap].pop()
            open_with[gap] -= 1
        left = gap - length
        if left >= least:
            open_with[left] += 1
            stacks.setdefault(left, []).append(chosen)
        sequence[k] = chosen
        offset[k] = capacity - gap
    return sequence, offset


def pack(
    df: DataFrame,
    capacity: int,
    length: str = "length",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` of each row, replacing columns so named.

    ``df`` is best a written table: its row numbers must not change when a task
    is repeated.
    """
    columns = [c for c in df.columns if c not in ("sequence_id", "offset")]
    groups = max(1, round(df.count() / group_pieces))
    number = F.xxhash64(F.monotonically_increasing_id())
    rows = df.select(
        F.col(length).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("number"),
        F.pmod(number, F.lit(groups)).alias("part"),
        F.struct(*columns).alias("row"),
    )

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "number"], ascending=[False, True])
        sizes = rows["size"].to_numpy()
        if len(sizes) and (sizes.min() < 1 or sizes.max() > capacity):
            raise ValueError("lengths must lie between 1 and the capacity")
        sequence, offset = place(sizes, capacity)
        return pd.DataFrame(
            {
                "row": rows["row"],
                "sequence_id": (int(key[0]) << 32) + sequence,
                "offset": offset,
            }
        )

    row = rows.schema["row"].dataType.simpleString()
    return (
        rows.groupBy("part")
        .applyInPandas(run, f"row {row}, sequence_id long, offset long")
        .select("row.*", "sequence_id", "offset")
    )


def pack_documents(
    df: DataFrame,
    path: str,
    capacity: int = 2048,
    separator: int = 0,
    key: str = "doc_id",
    text: str = "text",
    held_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Where each piece of each document is packed.

    ``key``, ``piece``, ``start``, ``length``, ``ids_crc32`` of the piece's ids,
    ``sequence_id`` and ``offset``. The ids themselves stay out of the shuffle. A
    task encodes about ``held_bytes`` of text at once.
    """
    pieces = token_pieces(df, path, capacity, separator, key, text, held_bytes, with_ids=False)
    return pack(materialise(pieces.drop("ids"), "pieces"), capacity)
