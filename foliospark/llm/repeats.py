"""Repeated passages of a corpus by prefix-free parsing.

A rolling hash over ``width`` bytes sets triggers: of the places in every window of
``length`` bytes the one of least hash, so that equal windows have equal triggers
wherever they stand. Triggers cut the documents into phrases. A window starts in one
phrase and is the rest of that phrase up to its trigger, then what the parse goes on
with. So corpus order is found from two suffix arrays, with the lengths of common
prefixes: one of the phrases' ends (the dictionary side, read backward from the
trigger) and one of what follows each trigger (the parse side). Windows are equal if
they share a class in both, at the depths that make up ``length``. No hash decides
equality.

The corpus is highly repetitive in places and not elsewhere, and Spark finds these
first. Texts are written in blocks. Every block sends the fingerprints of its
triggers, sorted, to buckets; they answer which triggers other blocks have as well.
A block closes windows that one of its own earlier documents holds and sends the
phrases with open windows and answered triggers to buckets, where all windows with one
trigger meet and are ordered. Runs of repeated windows go back to the blocks, which cut
them out. Copies inside a block are sent once, and windows of a trigger with more than
``HOT`` phrases are dealt by their own hash, so that no bucket grows with one passage.

Defined results: a null text is empty. Documents without id neither lose bytes nor
take any from others. Rows of the same id take none from each other; equal passages
inside one document stay. Repeated rows are judged one by one. Matches never cross
documents, and overlapping ones are judged on the input. Texts of any length are read
whole; a longer one than a block makes its own. An empty table gives no rows. Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.bpe import gather
from foliospark.llm.common import byte_groups, with_bytes
from foliospark.session import materialise

LENGTH = 50
BLOCK_BYTES = 4_000_000
BUCKET_BYTES = 16_000_000  # text per bucket
HOT = 1 << 16  # phrases sharing a trigger from which on windows are dealt one by one
BASE = 0x9E3779B97F4A7C15
HIGH = np.uint64(0xFFFFFFFF00000000)
LOW = np.uint64(0xFFFFFFFF)
UNSEEN, SEEN, SPLIT = 0, 1, 2


def mix(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """Well spread 64 bits of each value."""
    z = values + np.uint64(salt * BASE % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def rolling_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every ``width`` bytes, joined from hashes of halves."""
    letters = mix(np.arange(256, dtype=np.uint64), 1)
    piece, size = letters[data], 1
    whole, done = None, 0
    while True:
        if width & size:
            if whole is None:
                whole = piece
            else:
                shift = np.uint64(pow(BASE, size, 2**64))
                most = min(len(whole), len(piece) - done)
                whole = whole[:most] * shift + piece[done : done + most]
            done += size
        if done == width:
            return whole[: max(0, len(data) - width + 1)]
        shift = np.uint64(pow(BASE, size, 2**64))
        piece = piece[: max(0, len(piece) - size)] * shift + piece[size:]
        size *= 2


def sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    size = 1
    while 2 * size <= span:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = span - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


@dataclass
class Phrases:
    """Where phrases start windows: ``count`` windows from ``first``, all with the
    trigger at ``trigger`` and of the document ``doc``."""

    first: np.ndarray
    count: np.ndarray
    trigger: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray

    def take(self, at: np.ndarray) -> Phrases:
        return Phrases(
            self.first[at], self.count[at], self.trigger[at], self.doc[at], self.hashes[at]
        )


def width_of(length: int) -> int:
    """Bytes of a trigger: long enough to be rare, short enough for few triggers."""
    return max(1, length * 2 // 5)


def parse(data: np.ndarray, sizes: np.ndarray, ids: list, length: int) -> Phrases:
    """The phrases of the documents that lie one after the other in ``data``."""
    width = width_of(length)
    known = np.array([i is not None for i in ids], bool)
    windows = np.where(known, np.maximum(sizes - length + 1, 0), 0)
    total = int(windows.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return Phrases(none, none, none, none, none.astype(np.uint64))
    hashes = rolling_hashes(data, width)
    # The upper half orders places, the lower half is the place: least hash, then leftmost.
    ranked = mix(hashes)
    ranked &= HIGH
    ranked |= np.arange(len(ranked), dtype=np.uint64)
    least = sliding_least(ranked, length - width + 1)
    starts = np.cumsum(sizes) - sizes
    first = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(total)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), windows)
    trigger = (least[first] & LOW).astype(np.int64)
    fresh = np.ones(total, bool)
    fresh[1:] = (trigger[1:] != trigger[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    count = np.diff(np.append(at, total))
    trigger = trigger[at]
    return Phrases(first[at], count, trigger, doc[at].astype(np.int64), hashes[trigger])


def suffix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows, and how many bytes each shares with the one before it."""
    words = rows.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    put = rows[order]
    equal = put[1:] == put[:-1]
    shared = np.where(equal.all(axis=1), rows.shape[1], np.argmin(equal, axis=1))
    return order, np.append(0, shared) if len(rows) else shared


def classes_at(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """A number for each row: equal where the first ``depth`` bytes are."""
    numbers = np.empty(len(order), np.int64)
    numbers[order] = np.cumsum(shared < depth)
    return numbers


def repeated_windows(
    data: np.ndarray,
    first: np.ndarray,
    count: np.ndarray,
    trigger: np.ndarray,
    ids: np.ndarray,
    length: int,
) -> tuple[np.ndarray, np.ndarray]:
    """The windows of these phrases that a phrase of a smaller id holds as well.

    Phrase numbers and the place of each window's start before the trigger.
    """
    spread = length - width_of(length)  # most bytes a window has before its trigger
    left = trigger - first
    # The parse side: what follows the trigger, as far as the phrase's windows reach.
    columns = -(-length // 8) * 8
    padded = np.append(data, np.zeros(columns, np.uint8))
    after = np.lib.stride_tricks.sliding_window_view(padded, columns)[trigger]
    reach = count + length - 1 - left
    after = np.where(np.arange(columns) < reach[:, None], after, np.uint8(0))
    order, shared = suffix_order(after)
    del after
    # The dictionary side: what stands before the trigger, read backward.
    columns = max(8, -(-spread // 8) * 8)
    padded = np.append(np.zeros(columns, np.uint8), data)
    before = np.lib.stride_tricks.sliding_window_view(padded, columns)[trigger][:, ::-1]
    before = np.where(np.arange(columns) < left[:, None], before, np.uint8(0))
    back_order, back_shared = suffix_order(np.ascontiguousarray(before))
    del before
    found: list[np.ndarray] = []
    places: list[np.ndarray] = []
    least = left - count + 1
    for place in range(spread + 1):
        at = np.flatnonzero((least <= place) & (place <= left))
        if len(at) < 2:
            continue
        parse_class = classes_at(order, shared, length - place)[at]
        own_class = classes_at(back_order, back_shared, place)[at]
        pair = own_class * (len(first) + 1) + parse_class
        by_pair = np.argsort(pair, kind="stable")
        pair = pair[by_pair]
        fresh = np.append(True, pair[1:] != pair[:-1])
        begin = np.flatnonzero(fresh)
        if len(begin) == len(pair):
            continue
        of = ids[at[by_pair]]
        smallest = np.minimum.reduceat(of, begin)[np.cumsum(fresh) - 1]
        hit = at[by_pair[of > smallest]]
        found.append(hit)
        places.append(np.full(len(hit), place))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(places)


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers by their differences, byte by byte, compressed."""
    values = values.astype(np.int64)
    steps = np.diff(values, prepend=np.int64(0))
    steps = (steps << 1) ^ (steps >> 63)
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unsqueeze(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    steps = np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).ravel()
    halves = (steps.view(np.uint64) >> np.uint64(1)).view(np.int64)
    return np.cumsum(halves ^ -(steps & 1))


def deal(df: DataFrame, key: str, text: str) -> DataFrame:
    """Whole texts in blocks of about ``BLOCK_BYTES``, one row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=3)
        for part, data in byte_groups(batches, BLOCK_BYTES):
            whole = b"".join(data)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block]),
                    pa.array([len(whole)]),
                    pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([list(map(len, data))], pa.list_(pa.int64())),
                    pa.array([pack.compress(whole)], pa.binary()),
                ],
                ["block", "bytes", "ids", "sizes", "data"],
            )
            block += 1

    return with_bytes(df, key, text).mapInArrow(
        run, "block long, bytes long, ids array<long>, sizes array<long>, data binary"
    )


class Block:
    """One row of ``deal``, unpacked."""

    def __init__(self, row: dict):
        self.number = row["block"]
        self.ids = row["ids"]
        self.sizes = np.array(row["sizes"], np.int64)
        whole = zstandard.ZstdDecompressor().decompress(row["data"])
        self.data = np.frombuffer(whole, np.uint8)


class Triggers:
    """The distinct trigger fingerprints of a block, by bucket and then by value."""

    def __init__(self, hashes: np.ndarray, buckets: int, bits: int):
        prints = mix(hashes, 2) >> np.uint64(64 - bits)
        value, self.of, self.count = np.unique(prints, return_inverse=True, return_counts=True)
        self.bucket = (value % np.uint64(buckets)).astype(np.int64)
        self.value = (value // np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(self.bucket, kind="stable")

    def by_bucket(self) -> Iterator[tuple[int, np.ndarray]]:
        yield from split_by(self.bucket, self.order)


def split_by(values: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value and its places, for places ordered by value."""
    if len(order):
        put = values[order]
        cuts = np.flatnonzero(put[1:] != put[:-1]) + 1
        for at in np.split(order, cuts):
            yield int(values[at[0]]), at


def answer_triggers(blocks: DataFrame, buckets: int, bits: int, length: int) -> DataFrame:
    """For each block and bucket, which of the block's triggers other blocks have."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(batch.slice(k, 1).to_pylist()[0])
                phrases = parse(block.data, block.sizes, block.ids, length)
                triggers = Triggers(phrases.hashes, buckets, bits)
                rows = [
                    (bucket, squeeze(triggers.value[at]), squeeze(np.minimum(triggers.count[at], 255)))
                    for bucket, at in triggers.by_bucket()
                ]
                columns = list(zip(*rows)) or [()] * 3
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0], pa.int64()),
                        pa.array([block.number] * len(rows), pa.int64()),
                        pa.array(columns[1], pa.binary()),
                        pa.array(columns[2], pa.binary()),
                    ],
                    ["bucket", "block", "prints", "counts"],
                )

    def answer(rows: pa.Table) -> pa.Table:
        parts = [unsqueeze(p.as_py()) for p in rows.column("prints")]
        counts = np.concatenate([unsqueeze(c.as_py()) for c in rows.column("counts")])
        value, of, seen = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        phrases = np.bincount(of, counts, len(value))
        said = np.where(seen < 2, UNSEEN, np.where(phrases > HOT, SPLIT, SEEN))[of]
        ends = np.cumsum([len(p) for p in parts])
        said = [squeeze(a) for a in np.split(said, ends[:-1])]
        return pa.table(
            {
                "block": rows.column("block"),
                "bucket": rows.column("bucket"),
                "said": pa.array(said, pa.binary()),
            }
        )

    return (
        blocks.mapInArrow(send, "bucket long, block long, prints binary, counts binary")
        .groupBy("bucket")
        .applyInArrow(answer, "block long, bucket long, said binary")
    )


SENT = "bucket long, block long, ids binary, first binary, count binary, left binary, data binary"


def sent_rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 7
    types = [pa.int64()] * 2 + [pa.binary()] * 5
    names = ["bucket", "block", "ids", "first", "count", "left", "data"]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types)})


def runs_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive window starts as the first and the number of each run."""
    starts = np.unique(starts)
    fresh = np.append(True, starts[1:] != starts[:-1] + 1)[: len(starts)]
    at = np.flatnonzero(fresh)
    return starts[at], np.diff(np.append(at, len(starts)))


def open_phrases(block: Block, answers: list[bytes], buckets: int, bits: int, length: int) -> list[tuple]:
    """What a block sends: its own repeated windows, and phrases with open ones by bucket."""
    phrases = parse(block.data, block.sizes, block.ids, length)
    triggers = Triggers(phrases.hashes, buckets, bits)
    said = np.zeros(len(triggers.value), np.int64)
    if answers:
        said[triggers.order] = np.concatenate([unsqueeze(a) for a in answers])
    ids = np.array([i or 0 for i in block.ids], np.int64)
    # Windows that the block repeats by itself are closed here.
    local = np.flatnonzero(triggers.count[triggers.of] > 1)
    own = phrases.take(local)
    hit, place = repeated_windows(
        block.data, own.first, own.count, own.trigger, ids[own.doc], length
    )
    closed = own.trigger[hit] - place
    rows: list[tuple] = []
    if len(closed):
        first, count = runs_of(closed)
        rows.append(
            (block.number % buckets, block.number, None, squeeze(first), squeeze(count), None, None)
        )
    # Open windows of triggers that other blocks have.
    kind = said[triggers.of]
    going = np.flatnonzero(kind != UNSEEN)
    sizes = phrases.count[going]
    of = np.repeat(going, sizes)
    start = np.repeat(phrases.first[going] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(of))
    is_open = np.ones(len(block.data) + 1, bool)
    is_open[closed] = False
    kept = is_open[start]
    of, start = of[kept], start[kept]
    if not len(of):
        return rows
    split = kind[of] == SPLIT
    fresh = np.append(True, (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)) | split
    at = np.flatnonzero(fresh)
    first, count = start[at], np.diff(np.append(at, len(of)))
    of, split = of[at], split[at]
    left = np.where(split, 0, phrases.trigger[of] - first)
    bucket = triggers.bucket[triggers.of[of]]
    if split.any():
        windows = mix(rolling_hashes(block.data, length), 3)
        bucket[split] = (windows[first[split]] % np.uint64(buckets)).astype(np.int64)
    doc_ids = ids[phrases.doc[of]]
    pack = zstandard.ZstdCompressor(level=3)
    for number, at in split_by(bucket, np.argsort(bucket, kind="stable")):
        data, _ = gather(block.data, first[at], count[at] + length - 1)
        rows.append(
            (
                number,
                block.number,
                squeeze(doc_ids[at]),
                squeeze(first[at]),
                squeeze(count[at]),
                squeeze(left[at]),
                pack.compress(data.tobytes()),
            )
        )
    return rows


def settle_bucket(rows: pa.Table, length: int) -> pa.Table:
    """Runs of repeated windows of each block, from the phrases that met in a bucket."""
    out: list[tuple] = []
    blocks, ids, firsts, counts, lefts, texts = [], [], [], [], [], []
    for row in rows.to_pylist():
        if row["data"] is None:
            out.append((row["block"], row["first"], row["count"]))
            continue
        ids.append(unsqueeze(row["ids"]))
        firsts.append(unsqueeze(row["first"]))
        counts.append(unsqueeze(row["count"]))
        lefts.append(unsqueeze(row["left"]))
        blocks.append(np.full(len(ids[-1]), row["block"], np.int64))
        texts.append(zstandard.ZstdDecompressor().decompress(row["data"]))
    if blocks:
        block, doc = np.concatenate(blocks), np.concatenate(ids)
        first, count, left = map(np.concatenate, (firsts, counts, lefts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = count + length - 1
        begin = np.cumsum(sizes) - sizes
        hit, place = repeated_windows(data, begin, count, begin + left, doc, length)
        start = first[hit] + left[hit] - place
        of = block[hit]
        for number, at in split_by(of, np.argsort(of, kind="stable")):
            run, many = runs_of(start[at])
            out.append((number, squeeze(run), squeeze(many)))
    columns = list(zip(*out)) or [()] * 3
    return pa.table(
        {
            "block": pa.array(columns[0], pa.int64()),
            "first": pa.array(columns[1], pa.binary()),
            "count": pa.array(columns[2], pa.binary()),
        }
    )


def cut_out(block: Block, rows: pa.Table, length: int) -> pa.Table:
    """Each document of a block, its removed spans and the bytes that are left."""
    change = np.zeros(len(block.data) + 1, np.int32)
    for row in rows.to_pylist():
        first, count = unsqueeze(row["first"]), unsqueeze(row["count"])
        np.add.at(change, first, 1)
        np.add.at(change, first + count + length - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    ends = np.cumsum(block.sizes)
    spans, kept = [], []
    for begin, end in zip((ends - block.sizes).tolist(), ends.tolist()):
        own = gone[begin:end]
        edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
        spans.append([{"start": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()])
        kept.append(block.data[begin:end][~own].tobytes())
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.table(
        {
            "id": pa.array(block.ids, pa.int64()),
            "n_bytes": pa.array(block.sizes, pa.int64()),
            "spans": pa.array(spans, span),
            "kept": pa.array(kept, pa.binary()),
        }
    )


def remove_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH
) -> DataFrame:
    """Take from each text what a text of a smaller id holds in ``length`` bytes or more.

    ``key``, ``n_bytes``, ``spans`` (removed bytes, from ``start`` to before ``stop``)
    and ``kept``, the bytes that are left.
    """
    blocks = materialise(deal(df, key, text), "blocks")
    total = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(1, round(total / BUCKET_BYTES))
    # One in some hundred triggers that no other block has passes by chance.
    bits = min(62, max(16, int(total).bit_length() + 4))

    def choose(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        said = [a["said"] for a in sorted(answers.to_pylist(), key=lambda a: a["bucket"])]
        for row in texts.to_pylist():
            rows += open_phrases(Block(row), said, buckets, bits, length)
        return sent_rows(rows)

    def finish(texts: pa.Table, runs: pa.Table) -> pa.Table:
        return pa.concat_tables(cut_out(Block(row), runs, length) for row in texts.to_pylist())

    answers = answer_triggers(blocks, buckets, bits, length)
    sent = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(choose, SENT)
    runs = sent.groupBy("bucket").applyInArrow(
        lambda rows: settle_bucket(rows, length), "block long, first binary, count binary"
    )
    return (
        blocks.groupBy("block")
        .cogroup(runs.groupBy("block"))
        .applyInArrow(
            finish, "id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
        )
        .withColumnRenamed("id", key)
    )
