"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text is a sequence of tokens: its words, then an end. A token is coded bit by bit. The
most frequent words, the end and an escape have a Huffman code, whose bits are decided
at the nodes of its tree. Contexts predict each of these bits: none, the word before
and the two words before; the escape stands for any word without a code. What escapes is then spelled, byte by byte with a space after it,
each bit predicted by none and by the last one to four bytes of the word.

A context is hashed, with the node or the bits already known, into a slot that holds
how often a 0 and a 1 were seen in training. A gate, chosen by the bit's place and by
how much the longest context has seen, holds the weights that mix the predictions in
the logistic domain; an adaptive map then refines the mixed probability. Weights and map
are learned online, in small batches over all training texts, each bit predicted from
counts without its own occurrence; tasks learn apart and their results are averaged.

So a word's price depends on the words before it, and a text in another order scores
otherwise. A spelling does not depend on the words around it: rare words are priced
once each and delivered to the blocks of texts that hold them, with their counts.

Counts of words and contexts cover the whole training part, and so do the few thousand
weights. Broadcast are tables of fixed size: ``TABLE`` words and the context slots.

Defined results: a null text is empty and has the end token only. Repeated rows are
scored one by one and count in training as often as they stand there. Words of any
length are coded whole. Without training texts there is no code, and every bit of a
spelling costs one bit. An empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import byte_groups
from foliospark.llm.minhash import mixed
from foliospark.session import materialise

END = b"\n"  # stands for the end of a text; no word contains it
SPACE = 0x20
TABLE = 65_535  # words with a code, at most
LEAST_SEEN = 4  # times a word with a code was seen, at least
WORD_BITS = 20  # of the slots of each word context
FREQUENT = 4_096  # words told apart in a context; all others are one
SPELL_BITS = (8, 16, 19, 20, 20)  # of the slots of each spelling context
CONFIDENCE = (0.5, 2.5, 8.5, 64.5)  # steps of what the longest context has seen
STEPS = len(CONFIDENCE) + 1
DEEPEST = 15  # places in a code told apart by the gate
MAP_STEPS = 33  # of the adaptive map, over logits from -MOST to MOST
DELTA = 0.4  # added to the counts of both bits
RATE = 0.15
LEAST = np.float32(2.0**-16)  # probability of a bit
MOST = 11.0  # logit of the likeliest bit
MOST_SEEN = 65_535  # counts of a slot are halved until they fit
LOGS = np.log(np.arange(MOST_SEEN + 1) + DELTA).astype(np.float32)
BLOCK_BYTES = 12_000_000
PIECE = 1 << 20  # tokens, or bytes of words, among which equal ones are predicted once
TOKENS = 10_000  # tokens predicted at once
BATCH = 20_000  # bits learned from at once
MOST_COUNTED = 500_000  # words a task counts before it hands them on
SPELLED = 100_000  # bytes of words learned from at once
PRICED = 500_000  # bytes of words counted or priced at once
CHUNK = 1 << 16  # slots per row when counts are summed
# A slot is the head of (context + node * NODE) * MULTIPLIER, which is multiplied out.
NODE = 0xD6E8FEB86659FD93
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
NODE_MULTIPLIER = np.uint64(NODE * int(MULTIPLIER) % 2**64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and which of these every key is.

    Keys are below 2 ** 42, and there are ``PIECE`` at most, so that a key and its place
    are sorted as one number.
    """
    placed = keys << 21
    placed |= np.arange(len(keys))
    placed.sort()
    place = placed & ((1 << 21) - 1)
    placed >>= 21
    new = np.append(True, placed[1:] != placed[:-1])[: len(keys)]
    which = np.empty(len(keys), np.int64)
    which[place] = np.cumsum(new) - 1
    return place[new], which


def tokens_of(data: bytes) -> list[bytes]:
    words = data.lower().split()
    words.append(END)
    return words


# --- mixing -----------------------------------------------------------------------


@dataclass
class Mixer:
    """Weights by input and gate, and the adaptive map by gate and logit step."""

    weights: np.ndarray
    refined: np.ndarray

    @staticmethod
    def fresh(inputs: int, gates: int) -> Mixer:
        weights = np.full((inputs + 1, gates), 0.3, np.float32)
        weights[-1] = 0.0  # of the bias
        steps = np.linspace(-MOST, MOST, MAP_STEPS)
        return Mixer(weights, np.tile(1 / (1 + np.exp(-steps)), (gates, 1)).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights.ravel(), self.refined.ravel()]).astype(np.float64)

    def filled(self, flat: np.ndarray) -> Mixer:
        """A mixer of this shape with these numbers."""
        cut = self.weights.size
        return Mixer(
            flat[:cut].reshape(self.weights.shape).astype(np.float32),
            flat[cut:].reshape(self.refined.shape).astype(np.float32),
        )

    def mix(self, logits: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mixed probability, and where its logit lies between the steps of the map."""
        summed = self.weights[-1].take(gate)
        for weights, logit in zip(self.weights, logits):
            weighed = weights.take(gate)
            weighed *= logit
            summed += weighed
        np.clip(summed, -MOST, MOST, out=summed)
        at = summed + np.float32(MOST)
        at *= np.float32((MAP_STEPS - 1) / (2 * MOST))
        p = np.exp(np.negative(summed, out=summed), out=summed)
        p += 1
        return np.divide(1, p, out=p), at

    def costs(self, logits: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """log10 of the probability of each bit."""
        p, at = self.mix(logits, gate)
        low = np.minimum(at.astype(np.int32), MAP_STEPS - 2)
        at -= low.astype(np.float32)
        cell = gate * MAP_STEPS
        cell += low
        table = self.refined.ravel()
        below = table.take(cell)
        cell += 1
        refined = table.take(cell)
        refined -= below
        refined *= at
        refined += below
        p += refined
        p /= 2
        np.clip(p, LEAST, 1 - LEAST, out=p)
        p = np.where(bit == 1, p, 1 - p)
        return np.log(p, out=p) * np.float32(1 / np.log(10))

    def learn(
        self, logits: np.ndarray, gate: np.ndarray, bit: np.ndarray, much: np.ndarray | None = None
    ) -> None:
        """One online step on a batch; ``much`` weighs its bits, which are alike without it."""
        mixed_p, at = self.mix(logits, gate)
        at -= np.float32(0.5)
        nearest = np.ceil(at, out=at).astype(np.int32)  # step of the map
        error = np.subtract(bit, mixed_p, out=mixed_p)
        if much is not None:
            error *= much
        gates, table = self.weights.shape[1], self.refined.ravel()
        cell = gate * MAP_STEPS
        cell += nearest
        cell *= 2
        cell += bit
        seen = np.bincount(cell, much, 2 * table.size).reshape(-1, 2)
        hits, ones = seen.sum(axis=1), seen[:, 1]
        held = hits.reshape(gates, MAP_STEPS).sum(axis=1) + 1e-9
        pace = (RATE / np.maximum(held, held.mean())).astype(np.float32)
        for weights, logit in zip(self.weights, logits):
            weights += pace * np.bincount(gate, error * logit, gates).astype(np.float32)
        self.weights[-1] += pace * np.bincount(gate, error, gates).astype(np.float32)
        share = np.divide(ones, hits, out=table.astype(np.float64), where=hits > 0)
        table += ((hits / (hits + 50)) * (share - table)).astype(np.float32)
        self.refined = np.clip(table, LEAST, 1 - LEAST).reshape(self.refined.shape)


class Slots:
    """What the slots of all contexts have seen, and the logits that follow from it."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    @cached_property
    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Logit and step of confidence of each slot."""
        zeros, ones = self.counts
        return LOGS[ones] - LOGS[zeros], self._sure(0)

    @cached_property
    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """The same without one occurrence: of a 0 at even places, of a 1 at odd ones."""
        zeros, ones = self.counts
        fewer = [c - (c > 0) for c in self.counts]
        logits = [LOGS[ones] - LOGS[fewer[0]], LOGS[fewer[1]] - LOGS[zeros]]
        return np.stack(logits, axis=1).ravel(), self._sure(1)

    def _sure(self, own: int) -> np.ndarray:
        seen = np.maximum(self.counts[0].astype(np.int32) + self.counts[1] - own, 0)
        return np.searchsorted(CONFIDENCE, seen).astype(np.int8)

    def predict(self, slots: np.ndarray, bit: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the predictors, without ``own`` occurrences, and the step of confidence.

        The last context is the one whose counts tell it.
        """
        logits, sure = self.own if own else self.whole
        steps = sure.take(slots[-1]).astype(np.int64)
        if own:
            slots = slots * 2
            slots += bit
        return logits.take(slots), steps


def fitted(counts: np.ndarray) -> np.ndarray:
    """Counts of both bits as 16-bit numbers; larger ones are halved, both alike."""
    most = np.maximum(counts.max(axis=0), 1)
    halves = np.maximum(np.ceil(np.log2(most / MOST_SEEN)), 0)
    return np.floor(counts / 2.0**halves).astype(np.uint16)


def sum_tables(tables: DataFrame, size: int) -> np.ndarray:
    """Sum of the tasks' slot tables, given as (chunk, compressed counts)."""

    def add(parts: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.float64)
        for part in parts.column("counts").to_pylist():
            got = unplaned(part)
            total[: len(got)] += got
        packed = pa.array([planed(total)], pa.binary())
        return pa.table({"chunk": parts.column("chunk")[:1], "counts": packed})

    summed = tables.groupBy("chunk").applyInArrow(add, "chunk long, counts binary")
    whole = np.zeros(-(-2 * size // CHUNK) * CHUNK, np.float32)
    for row in summed.toLocalIterator():
        got = unplaned(bytes(row.counts))
        whole[row.chunk * CHUNK : row.chunk * CHUNK + len(got)] = got
    return fitted(whole[: 2 * size].reshape(2, size))


def planed(counts: np.ndarray) -> bytes:
    """Whole numbers byte by byte, compressed: most are small."""
    planes = np.ascontiguousarray(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor().compress(planes.tobytes())


def unplaned(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()


def table_chunks(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for first in range(0, len(table), CHUNK):
        part = table[first : first + CHUNK]
        if part.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([first // CHUNK]), pa.array([planed(part)], pa.binary())],
                ["chunk", "counts"],
            )


def averaged(learned: DataFrame, fresh: Mixer) -> Mixer:
    """What the tasks have learned, weighed by what each has seen."""
    mean = learned.groupBy("at").agg((F.sum("value") / F.sum("seen")).alias("value")).toPandas()
    if not len(mean):
        return fresh
    return fresh.filled(mean.sort_values("at")["value"].to_numpy())


def mixer_rows(mixer: Mixer, seen: float) -> Iterator[pa.RecordBatch]:
    if seen:
        flat = mixer.flat()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(flat))), pa.array(flat * seen), pa.array(np.full(len(flat), seen))],
            ["at", "value", "seen"],
        )


LEARNED = "at long, value double, seen double"

# --- words with a code --------------------------------------------------------------


@dataclass
class Code:
    """A Huffman code: the nodes and bits on the way to each symbol, and the gates by depth."""

    starts: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    gates: np.ndarray

    @staticmethod
    def build(weights: list[int]) -> Code:
        """Codes of the symbols 0, 1, .. by their weights, of which there is one at least."""
        heap = [(w, k, k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}  # of symbols, and of nodes from len(weights) on
        made = len(weights)
        while len(heap) > 1:
            (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            parent[left], parent[right] = (made, 0), (made, 1)
            heapq.heappush(heap, (a + b, made, made))
            made += 1
        starts, nodes, bits, depths = [0], [], [], []
        for symbol in range(len(weights)):
            way, at = [], symbol
            while at in parent:
                at, bit = parent[at]
                way.append((made - 1 - at, bit))  # the root is node 0
            nodes += [node for node, _ in reversed(way)]
            bits += [bit for _, bit in reversed(way)]
            depths += range(len(way))
            starts.append(len(nodes))
        gates = np.minimum(np.array(depths, np.int64), DEEPEST) * STEPS
        return Code(np.array(starts), np.array(nodes, np.int64), np.array(bits, np.int8), gates)


CONTEXTS = 3
WORD_SLOTS = TABLE + 1 + (CONTEXTS - 1) * (1 << WORD_BITS)
WORD_GATES = (DEEPEST + 1) * STEPS


@dataclass
class Words:
    """The words with a code, most frequent first, and the escape, which is the last symbol."""

    words: list[bytes]
    counts: list[int]
    code: Code

    @staticmethod
    def of(words: list[bytes], counts: list[int], others: int) -> Words:
        return Words(words, counts, Code.build([*counts, max(others, 1)]))

    @property
    def escape(self) -> int:
        return len(self.words)


def words_before(symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token and the one before that; ``begins`` marks the first
    token of each text.
    """
    start = FREQUENT + 1
    known = np.minimum(symbols, FREQUENT)  # all rarer ones alike
    before = np.full(len(symbols), start)
    before[1:] = known[:-1]
    before[begins] = start
    earlier = np.full(len(symbols), start)
    earlier[1:] = before[:-1]
    earlier[begins] = start
    return before, earlier


def word_bits(
    symbols: np.ndarray, before: np.ndarray, earlier: np.ndarray, words: Words
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slots, values and gates by depth of the bits of all symbols, some at a time, and
    how many bits each of these symbols has.

    ``before`` and ``earlier`` are the two words before each symbol.
    """
    code = words.code
    sizes = code.starts[1:] - code.starts[:-1]
    for first in range(0, len(symbols), TOKENS):
        here = slice(first, first + TOKENS)
        part = symbols[here]
        size = sizes[part]
        at = np.repeat(code.starts[part] - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        slots = np.empty((CONTEXTS, len(at)), np.int64)
        code.nodes.take(at, out=slots[0], mode="clip")
        spread = slots[0].view(np.uint64) * NODE_MULTIPLIER
        contexts = (before[here], before[here] * (FREQUENT + 2) + earlier[here])
        for k, context in enumerate(contexts):
            salted = np.repeat(mixed(context.astype(np.uint64), 41 + k) * MULTIPLIER, size)
            salted += spread
            salted >>= np.uint64(64 - WORD_BITS)
            np.add(salted.view(np.int64), TABLE + 1 + (k << WORD_BITS), out=slots[k + 1])
        yield slots, code.bits.take(at), code.gates.take(at), size


def distinct_tokens(
    symbols: np.ndarray, begins: np.ndarray
) -> Iterator[tuple[slice, tuple[np.ndarray, ...], np.ndarray]]:
    """Piece by piece the distinct tokens, as symbol and the two words before it, and
    which of these each token is.
    """
    before, earlier = words_before(symbols, begins)
    for first in range(0, len(symbols), PIECE):
        piece = slice(first, first + PIECE)
        keys = before[piece] * (FREQUENT + 2) + earlier[piece]
        keys <<= 16
        keys |= symbols[piece]
        place, which = distinct(keys)
        place += first
        yield piece, (symbols[place], before[place], earlier[place]), which


def word_costs(
    symbols: np.ndarray, begins: np.ndarray, words: Words, counts: Slots, mixer: Mixer
) -> np.ndarray:
    """log10 of the probability of each symbol after those before it.

    It depends on the two words before alone, so that equal tokens are predicted once.
    """
    cost = np.empty(len(symbols))
    for piece, tokens, which in distinct_tokens(symbols, begins):
        once = []
        for slots, bit, gate, size in word_bits(*tokens, words):
            logits, sure = counts.predict(slots, bit, 0)
            gate += sure
            ends = np.cumsum(mixer.costs(logits, gate, bit), dtype=np.float64)
            once.append(np.diff(np.append(0, ends)[np.cumsum(size)], prepend=0))
        cost[piece] = np.concatenate(once)[which]
    return cost


# --- texts in blocks -----------------------------------------------------------------


def text_rows(df: DataFrame, key: str, text: str, training: Column) -> DataFrame:
    return df.select(
        F.col(key).cast("long").alias("id"),
        F.coalesce(training, F.lit(False)).alias("training"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"),
    )


def split_texts(data: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts in a row, as ``tokens_of`` has them, and how many each has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(data.view(pa.string())))
    words = parts.flatten()
    some = pc.binary_length(words).to_numpy() > 0  # white space at an edge leaves an empty one
    ends = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
    sizes = np.diff(np.append(0, np.cumsum(some))[ends]) + 1
    order = np.full(sizes.sum(), len(words))
    order[np.delete(np.arange(len(order)), np.cumsum(sizes) - 1)] = np.flatnonzero(some)
    whole = pa.concat_arrays([words.view(pa.binary()), pa.array([END], pa.binary())])
    return whole.take(pa.array(order)), sizes


def word_batches(counts: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    words = list(counts)
    for first in range(0, len(words), 50_000):
        part = words[first : first + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.binary()), pa.array([counts[w] for w in part], pa.int64())],
            ["word", "c"],
        )


def count_words(rows: DataFrame) -> DataFrame:
    """All tokens and how often they were seen in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        others: set[bytes] = set()
        for part, data in byte_groups(batches, BLOCK_BYTES):
            for text, used in zip(data, part.column("training").to_pylist()):
                (counts if used else others).update(tokens_of(text))
            if len(counts) + len(others) > MOST_COUNTED:
                yield from word_batches(dict.fromkeys(others, 0) | counts)
                counts.clear()
                others.clear()
        yield from word_batches(dict.fromkeys(others, 0) | counts)

    seen = rows.select("training", "data").mapInArrow(run, "word binary, c long")
    return seen.groupBy("word").agg(F.sum("c").alias("c"))


CODED = (
    "block long, ids array<long>, training array<boolean>, sizes array<long>, "
    "lengths array<long>, symbols binary, rare array<binary>, n_rare int, escapes binary"
)


def code_texts(rows: DataFrame, shared) -> DataFrame:
    """Whole texts as symbols, in blocks of about ``BLOCK_BYTES``, one row a block.

    ``sizes`` are the texts' bytes and ``lengths`` their tokens, ``rare`` the block's
    words without a code, each once, and ``escapes`` which of them each escape stands for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        words, pack = shared.value, zstandard.ZstdCompressor(level=1)
        known = pa.array(words.words, pa.binary())
        for part, data in byte_groups(batches, BLOCK_BYTES):
            tokens, lengths = split_texts(part.column("data"))
            found = pc.index_in(tokens, known)
            symbols = found.fill_null(words.escape).to_numpy().astype(np.uint16)
            rare = tokens.filter(found.is_null()).dictionary_encode()
            escaped = rare.indices.to_numpy().astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block]),
                    pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([part.column("training").to_pylist()], pa.list_(pa.bool_())),
                    pa.array([list(map(len, data))], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([pack.compress(symbols.tobytes())], pa.binary()),
                    pa.ListArray.from_arrays([0, len(rare.dictionary)], rare.dictionary),
                    pa.array([len(rare.dictionary)], pa.int32()),
                    pa.array([pack.compress(escaped.tobytes())], pa.binary()),
                ],
                [
                    "block", "ids", "training", "sizes", "lengths",
                    "symbols", "rare", "n_rare", "escapes",
                ],
            )
            block += 1

    return rows.mapInArrow(run, CODED)


def unpacked(data: bytes, kind) -> np.ndarray:
    whole = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(whole, kind).astype(np.int64)


def training_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each block the symbols of its training texts in a row, and where each text begins."""
    for batch in batches:
        columns = [batch.column(k) for k in ("training", "lengths", "symbols")]
        for training, lengths, symbols in zip(*columns):
            used = np.array(training.as_py(), bool)
            lengths = np.array(lengths.as_py(), np.int64)
            kept = unpacked(symbols.as_py(), np.uint16)[np.repeat(used, lengths)]
            yield kept, np.cumsum(lengths[used]) - lengths[used]


def count_word_contexts(coded: DataFrame, shared) -> np.ndarray:
    """How often each slot of a word context has seen a 0 and a 1 in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = shared.value, np.zeros(2 * WORD_SLOTS, np.uint32)
        seen = np.zeros(words.escape + 1, np.int64)
        for symbols, begins in training_symbols(batches):
            seen += np.bincount(symbols, minlength=len(seen))
            for _, tokens, which in distinct_tokens(symbols, begins):
                much, first = np.bincount(which).astype(np.uint32), 0
                for slots, bit, _, size in word_bits(*tokens, words):
                    times = np.repeat(much[first : first + len(size)], size)
                    first += len(size)
                    slots += bit * np.int64(WORD_SLOTS)
                    for at in slots[1:]:
                        np.add.at(table, at, times)
        # Without a context a slot has seen what the symbols below it have.
        code = words.code
        at = code.nodes + code.bits * np.int64(WORD_SLOTS)
        np.add.at(table, at, np.repeat(seen, np.diff(code.starts)).astype(np.uint32))
        yield from table_chunks(table)

    used = coded.select("training", "lengths", "symbols")
    return sum_tables(used.mapInArrow(run, "chunk long, counts binary"), WORD_SLOTS)


def fit_word_mixer(coded: DataFrame, shared, slots_seen) -> Mixer:
    """Weights and map of the words' bits, learned online on all training texts."""
    fresh = Mixer.fresh(CONTEXTS, WORD_GATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, mixer, seen = shared.value, Slots(slots_seen.value), fresh, 0
        for symbols, begins in training_symbols(batches):
            for slots, bit, gate, _ in word_bits(symbols, *words_before(symbols, begins), words):
                logits, sure = counts.predict(slots, bit, 1)
                gate += sure
                for first in range(0, len(bit), BATCH):
                    at = slice(first, first + BATCH)
                    mixer.learn(logits[:, at], gate[at], bit[at])
                seen += len(bit)
        yield from mixer_rows(mixer, float(seen))

    used = coded.select("training", "lengths", "symbols")
    return averaged(used.mapInArrow(run, LEARNED), fresh)


# --- spelling --------------------------------------------------------------------------

SPELL_STARTS = tuple(int(s) for s in np.cumsum([0, *[1 << b for b in SPELL_BITS]]))
SPELL_SLOTS = SPELL_STARTS[-1]
SPELL_GATES = 8 * STEPS


def letters_before(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """Every byte to code: its word, the byte, how many of the word are before it, and
    its contexts, which are the last bytes.
    """
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(sizes) - sizes + 1
    word = np.repeat(np.arange(len(words)), sizes)
    byte = data[1:]
    before = np.arange(1, len(data)) - starts[word]  # bytes of the word so far
    wide = data.astype(np.uint64)
    contexts = np.zeros((len(SPELL_BITS), len(byte)), np.uint64)
    recent = np.zeros(len(byte), np.uint64)
    for order in range(1, len(SPELL_BITS)):
        # The space before the word counts as its first byte.
        earlier = np.zeros(len(byte), np.uint64)
        earlier[order - 1 :] = wide[: max(len(byte) - order + 1, 0)]
        recent = np.where(before >= order - 1, (recent << np.uint64(8)) | earlier, recent)
        contexts[order] = recent
    return word, byte.astype(np.int64), before, contexts


def letter_hashes(contexts: np.ndarray) -> np.ndarray:
    return np.stack([mixed(h, k) for k, h in enumerate(contexts)])


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every byte to code: its word, the byte, and its context hashes."""
    word, byte, _, contexts = letters_before(words)
    return word, byte, letter_hashes(contexts)


def distinct_letters(
    words: list[bytes],
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece the distinct bytes with their contexts, as byte and hashes, and of
    every byte its word and which of these it is.
    """
    word, byte, before, contexts = letters_before(words)
    # The longest context holds the others, once it is told how long it is.
    longest = len(SPELL_BITS) - 1
    keys = np.minimum(before, longest - 1) << 8 * longest
    keys |= contexts[-1].view(np.int64)
    keys <<= 8
    keys |= byte
    for first in range(0, len(byte), PIECE):
        place, which = distinct(keys[first : first + PIECE])
        place += first
        yield byte[place], letter_hashes(contexts[:, place]), word[first : first + PIECE], which


def letter_slots(hashes: np.ndarray, byte: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a bit of every byte, by context, and the bit's value."""
    return multiplied_slots(hashes * MULTIPLIER, byte, place)


def multiplied_slots(
    multiplied: np.ndarray, byte: np.ndarray, place: int
) -> tuple[np.ndarray, np.ndarray]:
    """The same from hashes multiplied already, once for all places."""
    node = (1 << place) | (byte >> (8 - place))
    spread = node.view(np.uint64) * NODE_MULTIPLIER
    found = np.empty(multiplied.shape, np.int64)
    found[0] = node  # no context: one slot for each node
    for k in range(1, len(SPELL_BITS)):
        salted = multiplied[k] + spread
        salted >>= np.uint64(64 - SPELL_BITS[k])
        np.add(salted.view(np.int64), SPELL_STARTS[k], out=found[k])
    return found, (byte >> (7 - place)) & 1


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of words put together until they hold ``PRICED`` bytes."""
    parts: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        parts.append(batch)
        held += batch.column("word").nbytes
        if held >= PRICED:
            yield pa.concat_batches(parts)
            parts, held = [], 0
    if parts:
        yield pa.concat_batches(parts)


def word_groups(
    batches: Iterator[pa.RecordBatch], limit: int
) -> Iterator[tuple[pa.RecordBatch, list, np.ndarray]]:
    """Rows in groups of about ``limit`` bytes, their words and counts."""
    for batch in batches:
        words, counts = batch.column("word").to_pylist(), batch.column("c").to_numpy()
        first, held = 0, 0
        for k, word in enumerate(words):
            held += len(word) + 1
            if held >= limit or k == len(words) - 1:
                yield batch.slice(first, k + 1 - first), words[first : k + 1], counts[first : k + 1]
                first, held = k + 1, 0


def count_letter_contexts(words: DataFrame) -> np.ndarray:
    """How often each slot has seen a 0 and a 1 in the rare training words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * SPELL_SLOTS)
        for _, group, c in word_groups(merged(batches), PRICED):
            for byte, hashes, word, which in distinct_letters(group):
                much = np.bincount(which, c[word])
                hashes *= MULTIPLIER
                for place in range(8):
                    slots, value = multiplied_slots(hashes, byte, place)
                    slots += SPELL_SLOTS * value
                    for at in slots:
                        np.add.at(table, at, much)
        yield from table_chunks(table)

    return sum_tables(words.mapInArrow(run, "chunk long, counts binary"), SPELL_SLOTS)


def fit_letter_mixer(words: DataFrame, slots_seen) -> Mixer:
    """Weights and map of the spelling's bits, learned online on all rare training words."""
    fresh = Mixer.fresh(len(SPELL_BITS), SPELL_GATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, mixer, seen = Slots(slots_seen.value), fresh, 0.0
        for _, group, c in word_groups(batches, SPELLED):
            word, byte, hashes = letters(group)
            much = np.sqrt(c[word]).astype(np.float32)
            seen += float(much.sum())
            order = np.argsort(mixed(hashes[-1], 3))  # not in order of the words
            for first in range(0, len(order), BATCH):
                at = order[first : first + BATCH]
                weigh = much[at] / much[at].mean()
                multiplied, part = hashes.take(at, axis=1) * MULTIPLIER, byte[at]
                for place in range(8):
                    slots, value = multiplied_slots(multiplied, part, place)
                    logits, sure = counts.predict(slots, value, 1)
                    sure += place * STEPS
                    mixer.learn(logits, sure, value.astype(np.int8), weigh)
        yield from mixer_rows(mixer, seen)

    return averaged(words.mapInArrow(run, LEARNED), fresh)


def spelled(words: list[bytes], counts: Slots, mixer: Mixer) -> np.ndarray:
    """log10 of the probability that the bits of each word have.

    That of a byte depends on its contexts alone, so that equal ones are predicted once.
    """
    found = np.zeros(len(words))
    for byte, hashes, word, which in distinct_letters(words):
        cost = np.zeros(len(byte))
        hashes *= MULTIPLIER
        for place in range(8):
            slots, value = multiplied_slots(hashes, byte, place)
            logits, sure = counts.predict(slots, value, 0)
            sure += place * STEPS
            cost += mixer.costs(logits, sure, value)
        found += np.bincount(word, cost[which], len(words))
    return found


def price_words(words: DataFrame, slots_seen, mixer: Mixer) -> DataFrame:
    """Rare words with the ``log10`` of their spelling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Slots(slots_seen.value)
        for part, group, _ in word_groups(merged(batches), PRICED):
            yield pa.RecordBatch.from_arrays(
                [part.column("word"), part.column("c"), pa.array(spelled(group, counts, mixer))],
                ["word", "c", "log10"],
            )

    return words.select("word", "c").mapInArrow(run, "word binary, c long, log10 double")


# --- scores ------------------------------------------------------------------------------

SCORES = (
    "id long, training boolean, n_tokens long, n_known long, "
    "base_score double, score double, bits_per_byte double"
)


def score_block(
    row: dict, rare: pa.Table, words: Words, counts: Slots, mixer: Mixer, tokens: int, types: int
) -> pa.Table:
    """Scores of a block's texts; ``rare`` has what its rare words cost."""
    symbols = unpacked(row["symbols"], np.uint16)
    lengths = np.array(row["lengths"], np.int64)
    begins = np.cumsum(lengths) - lengths
    cost = word_costs(symbols, begins, words, counts, mixer)
    seen = np.append(np.array(words.counts, np.int64), 0)[symbols]
    place = rare.column("place").to_numpy()
    held, priced = np.zeros(row["n_rare"], np.int64), np.zeros(row["n_rare"])
    held[place], priced[place] = rare.column("c").to_numpy(), rare.column("log10").to_numpy()
    at, which = np.flatnonzero(symbols == words.escape), unpacked(row["escapes"], np.uint32)
    seen[at] = held[which]
    cost[at] += priced[which]
    base = np.log10((seen + 1) / (tokens + types + 1))
    found = np.add.reduceat(cost, begins)
    sizes = np.maximum(np.array(row["sizes"]), 1)
    return pa.table(
        {
            "id": pa.array(row["ids"], pa.int64()),
            "training": pa.array(row["training"], pa.bool_()),
            "n_tokens": pa.array(lengths),
            "n_known": pa.array(np.add.reduceat((seen > 0).astype(np.int64), begins)),
            "base_score": pa.array(np.add.reduceat(base, begins)),
            "score": pa.array(found),
            "bits_per_byte": pa.array(-found / np.log10(2) / sizes),
        }
    )


def score(df: DataFrame, training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every text with a model of the rows where ``training`` is true.

    ``key``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (log10 by
    add-one unigrams), ``score`` (log10 by the model), ``bits_per_byte`` and
    ``training``.
    """
    context = df.sparkSession.sparkContext
    rows = text_rows(df, key, text, training)
    counts = materialise(count_words(rows), "counts")
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    tokens, types = int(tokens), int(types)
    frequent = counts.filter(F.col("c") >= LEAST_SEEN).orderBy(F.desc("c"), "word").limit(TABLE)
    chosen = sorted(((-int(r.c), bytes(r.word)) for r in frequent.collect()))
    held = -sum(c for c, _ in chosen)
    words = Words.of([w for _, w in chosen], [-c for c, _ in chosen], tokens - held)
    shared = context.broadcast(words)
    rare = counts
    if chosen:  # the table ends with a word; what comes after it is rare
        c, word = -chosen[-1][0], F.lit(bytearray(chosen[-1][1]))
        rare = counts.filter((F.col("c") < c) | ((F.col("c") == c) & (F.col("word") > word)))
    known = rare.filter("c > 0")
    coded = materialise(code_texts(rows, shared), "coded")
    word_counts = context.broadcast(count_word_contexts(coded, shared))
    word_mixer = fit_word_mixer(coded, shared, word_counts)
    letter_counts = context.broadcast(count_letter_contexts(known))
    letter_mixer = fit_letter_mixer(known, letter_counts)
    local = coded.select(F.col("block").alias("of"), F.posexplode("rare").alias("place", "word"))
    prices = materialise(price_words(rare, letter_counts, letter_mixer), "prices")
    delivered = local.join(prices, "word").select("of", "place", "c", "log10")

    ready: list[Slots] = []  # made once a task, by its first block

    def finish(texts: pa.Table, rare: pa.Table) -> pa.Table:
        if not ready:
            ready.append(Slots(word_counts.value))
        parts = [
            score_block(row, rare, shared.value, ready[0], word_mixer, tokens, types)
            for row in texts.to_pylist()
        ]
        return pa.concat_tables(parts)

    scored = coded.drop("rare").groupBy("block").cogroup(delivered.groupBy("of")).applyInArrow(finish, SCORES)
    return scored.withColumnRenamed("id", key).withColumn(
        "train_tokens", F.lit(tokens).cast("long")
    )
