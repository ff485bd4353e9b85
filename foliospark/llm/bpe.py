"""Byte-level BPE encoding and decoding with a pair occurrence index.

Every task keeps the distinct words of its partition as one flat symbol array.
An index maps each mergeable pair to all its positions there. The active merge
ranks are applied in ascending order, each once: merging a rank rewrites all
its positions together and adds the pairs that arise, which always have a
higher rank, to the lists of theirs. Words are looked up afterwards, so a word
is merged once per task however often it occurs.

Defined results: a null text is encoded as the empty text, which has no ids.
Repeated rows are encoded one by one. The text of a special token is that
token. Ids outside the vocabulary decode to nothing; bytes that are not UTF-8
decode to the replacement character. Other columns are carried along untouched.
"""

from __future__ import annotations

import heapq
import itertools
import json
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import byte_groups, with_bytes

# How byte-level vocabularies split a text into words, the white
# space of that pattern, and the bytes that stand for themselves in token names.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
SELF_NAMED = (*range(33, 127), *range(161, 173), *range(174, 256))

NO_RANK = np.iinfo(np.int32).max
MAX_WORDS = 1_000_000  # units a worker remembers before it drops the rare ones


def byte_names() -> dict[str, int]:
    """The character that names each byte in the vocabulary file."""
    own = set(SELF_NAMED)
    others = (b for b in range(256) if b not in own)
    names = {chr(b): b for b in own}
    names.update({chr(256 + k): b for k, b in enumerate(others)})
    return names


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        names = byte_names()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            if all(c in names for c in token):
                self.token_bytes[i] = bytes(names[c] for c in token)
            else:
                self.token_bytes[i] = token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int32)
        for name, b in names.items():
            self.of_byte[b] = ids[name]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.out = np.array([ids[a + b] for a, b in merges], np.int32)
        keys = (self.left << 32) | self.right
        self._order = np.argsort(keys, kind="stable").astype(np.int32)
        self._keys = keys[self._order]
        # Most lookups are of two bytes: a table of their own answers these.
        grid = np.arange(256)
        self.byte_ranks = self.rank(
            self.of_byte[np.repeat(grid, 256)], self.of_byte[np.tile(grid, 256)]
        )

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; ``NO_RANK`` where it cannot be merged."""
        if not len(self._keys):
            return np.full(len(left), NO_RANK, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        hit = (self._keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(hit, self._order[at], NO_RANK)


class PairIndex:
    """The symbols of many words and, per merge rank, where its pair occurs."""

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        self.vocabulary = vocabulary
        # A separator of -1 stands before, between and after the words.
        raw = np.frombuffer(f"\0{'\0'.join(words)}\0".encode(), np.uint8)
        ends = np.flatnonzero(raw == 0)[1:]
        if len(ends) != len(words):  # words with a zero of their own
            lengths = np.fromiter((len(w.encode()) for w in words), np.int64, len(words))
            ends = np.cumsum(lengths + 1)
        self.symbols = vocabulary.of_byte[raw].astype(np.int32)
        self.symbols[0] = -1
        self.symbols[ends] = -1
        size = len(raw)
        self.after = np.arange(1, size + 1)
        self.before = np.arange(-1, size - 1)
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        ranks = vocabulary.byte_ranks[(raw[:-1].astype(np.int32) << 8) | raw[1:]]
        inside = (self.symbols[:-1] >= 0) & (self.symbols[1:] >= 0)
        self._enter(np.arange(size - 1), np.where(inside, ranks, NO_RANK))

    def _add(self, positions: np.ndarray) -> None:
        """Enter the pairs that start at ``positions`` into the lists."""
        following = self.symbols[self.after[positions]]
        self._enter(
            positions, self.vocabulary.rank(self.symbols[positions], following)
        )

    def _enter(self, positions: np.ndarray, ranks: np.ndarray) -> None:
        kept = ranks < NO_RANK
        positions, ranks = positions[kept], ranks[kept]
        if len(self.vocabulary.out) < 2**16:  # sorts much faster
            ranks = ranks.astype(np.uint16)
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        if not len(ranks):
            return
        starts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        bounds = [0, *starts.tolist(), len(ranks)]
        for first, end in zip(bounds, bounds[1:]):
            rank, part = int(ranks[first]), positions[first:end]
            held = self.lists.get(rank)
            if held is None:
                self.lists[rank] = [part]
                heapq.heappush(self.active, rank)
            else:
                held.append(part)

    def merge_all(self) -> None:
        symbols, after, before = self.symbols, self.after, self.before
        while self.active:
            rank = heapq.heappop(self.active)
            held = self.lists.pop(rank)
            at = np.sort(held[0] if len(held) == 1 else np.concatenate(held))
            left, right = self.vocabulary.left[rank], self.vocabulary.right[rank]
            at = at[(symbols[at] == left) & (symbols[after[at]] == right)]
            if not len(at):
                continue
            at = at[np.append(True, at[1:] != at[:-1])]  # some were entered twice
            if left == right:
                at = leftmost(at, after)
            second = after[at]
            third = after[second]
            symbols[at] = self.vocabulary.out[rank]
            symbols[second] = -2
            after[at] = third
            before[third] = at
            self._add(np.concatenate([at, before[at]]))

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where each word ends among them."""
        kept = self.symbols[self.symbols != -2]
        separators = np.flatnonzero(kept == -1)[1:]
        return kept[kept >= 0], separators - np.arange(1, len(separators) + 1)


def leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of runs of overlapping pairs (as in "aaaa") every second one."""
    new_run = np.ones(len(at), bool)
    new_run[1:] = after[at[:-1]] != at[1:]
    starts = np.flatnonzero(new_run)
    run = np.cumsum(new_run) - 1
    return at[(np.arange(len(at)) - starts[run]) % 2 == 0]


class Units(dict):
    """Numbers of units by their text; a new text gets the next number when asked for."""

    def __init__(self, numbers: Iterator[int], known: dict[str, int] | None = None):
        super().__init__(known or {})
        self._numbers = numbers
        self.fresh: list[str] = []

    def __missing__(self, text: str) -> int:
        number = self[text] = next(self._numbers)
        self.fresh.append(text)
        return number


class Encoder:
    """Ids of whole texts, through a bounded memory of distinct words.

    A text is first cut at every single space that stands between two other
    characters: no word of the vocabulary's pattern reaches across, and the
    space belongs to what follows. Texts with other runs of white space around
    a space are cut by the pattern itself.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        self.vocabulary = Vocabulary(path)
        lengths = [len(t) for t in self.vocabulary.token_bytes]
        self._token_ends = np.cumsum([0, *lengths])
        self._token_data = np.frombuffer(b"".join(self.vocabulary.token_bytes), np.uint8)
        self._find = regex.compile(WORD_PATTERN).findall
        self._white = [chr(c) for c in range(0x3001) if chr(c).isspace()]
        self._ascii_white = [c for c in self._white if c.isascii()]
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self._special = (
            regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
            if special
            else None
        )
        self._max_words = max_words
        self._forget()

    def _forget(self) -> None:
        """Start with an empty memory: units of words and where their ids lie."""
        # A special token is a unit of one id.
        special = list(self.vocabulary.special.values())
        numbers = itertools.count(len(special))
        self._words = Units(numbers)
        # What follows a single space, without that space.
        self._spaced = Units(numbers)
        self._ids = np.array(special, np.int32)
        self._starts = np.arange(len(special))
        self._lengths = np.ones(len(special), np.int64)
        self._used = np.zeros(len(special), np.int64)
        self._unit_of = {name: k for k, name in enumerate(self.vocabulary.special)}

    def _shrink(self) -> None:
        """Keep the units used most since the last time, at most half of what may be held."""
        special = len(self.vocabulary.special)
        often = 2
        while np.count_nonzero(self._used >= often) > self._max_words // 2:
            often += often // 2
        kept = self._used >= often
        kept[:special] = True
        number = np.cumsum(kept) - 1
        numbers = itertools.count(int(kept.sum()))

        def rest(units: Units) -> Units:
            left = {text: int(number[n]) for text, n in units.items() if kept[n]}
            return Units(numbers, left)

        self._words, self._spaced = rest(self._words), rest(self._spaced)
        self._lengths = self._lengths[kept]
        self._ids, ends = gather(self._ids, self._starts[kept], self._lengths)
        self._starts = ends - self._lengths
        self._used = np.zeros(len(ends), np.int64)

    def _cut(self, text: str) -> tuple[list[str], list[str]]:
        """Words of the pattern, then what follows each single space."""
        for c in self._ascii_white if text.isascii() else self._white:
            if c in text and (" " + c in text or c + " " in text):
                return self._find(text), []
        first, *rest = text.split(" ")
        if not first and rest:  # a space at the very start
            return [], rest
        return self._find(first), rest

    def _parts(self, text: str) -> list:
        if self._special and any(s in text for s in self.vocabulary.special):
            units = self._unit_of
            cut = self._special.split(text)
            return [units[c] if c in units else self._cut(c) for c in cut if c]
        return [self._cut(text)] if text else []

    def _merge(self, units: Units, words: list[str], first: np.ndarray) -> None:
        """Remember the ids of the fresh units, whose words begin at ``first``."""
        index = PairIndex(self.vocabulary, words)
        index.merge_all()
        ids, ends = index.tokens()
        ends = ends[np.append(first[1:], len(words)) - 1]
        at = np.fromiter(map(units.__getitem__, units.fresh), np.int64, len(units.fresh))
        self._starts[at] = len(self._ids) + np.append(0, ends[:-1])
        self._lengths[at] = np.diff(ends, prepend=0)
        self._ids = np.concatenate([self._ids, ids])
        units.fresh = []

    def _learn(self) -> None:
        """Merge the units that have been numbered since the last time."""
        more = len(self._words.fresh) + len(self._spaced.fresh)
        self._starts = np.append(self._starts, np.zeros(more, np.int64))
        self._lengths = np.append(self._lengths, np.zeros(more, np.int64))
        if new := self._words.fresh:
            self._merge(self._words, new, np.arange(len(new)))
        if new := self._spaced.fresh:
            # Words with a space in front begin a unit, all others continue one.
            found = self._find(" " + " ".join(new))
            begins = np.fromiter((w[0] == " " for w in found), bool, len(found))
            self._merge(self._spaced, found, np.flatnonzero(begins))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the bounds of each text among them."""
        if len(self._spaced) + len(self._words) > self._max_words:
            self._shrink()
        of_word, of_spaced = self._words.__getitem__, self._spaced.__getitem__
        units = array("q")
        text_ends = [0]
        for text in texts:
            for part in self._parts(text):
                if isinstance(part, int):
                    units.append(part)
                else:
                    units.extend(map(of_word, part[0]))
                    units.extend(map(of_spaced, part[1]))
            text_ends.append(len(units))
        self._learn()
        unit = np.frombuffer(units, np.int64)
        self._used = np.bincount(unit, minlength=len(self._starts)) + np.append(
            self._used, np.zeros(len(self._starts) - len(self._used), np.int64)
        )
        ids, ends = gather(self._ids, self._starts[unit], self._lengths[unit])
        return ids, np.append(0, ends)[text_ends]

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and where each id ends among them."""
        known = (ids >= 0) & (ids < len(self._token_ends) - 1)
        at = np.where(known, ids, 0)
        starts = self._token_ends[at]
        lengths = np.where(known, self._token_ends[at + 1] - starts, 0)
        return gather(self._token_data, starts, lengths)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each run of ids between ``bounds``."""
        data, ends = self.decode_bytes(ids)
        cut = np.append(0, ends)[bounds].tolist()
        whole = data.tobytes()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])]


_encoders: dict[str, Encoder] = {}


def shared_encoder(path: str) -> Encoder:
    """The encoder of this worker process: later tasks find the words it has learned."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def gather(
    values: np.ndarray, starts: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``values`` in a row, and where each ends in the result."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(starts - (ends - lengths), lengths)
    return values[shift + np.arange(total)], ends


def list_array(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))
    )


def encode_tokens(
    df: DataFrame, path: str, text: str = "text", out: str = "token_ids"
) -> DataFrame:
    """Add the ids of ``text`` as an array column ``out``, replacing one so named."""
    kept = [c for c in df.columns if c != out]
    data = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data")
    rows = df.select(F.struct(*kept).alias("row"), data)
    schema = f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        for part, data in byte_groups(batches):
            ids = encoder.encode([d.decode("utf-8", "replace") for d in data])
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), list_array(*ids)], ["row", "ids"]
            )

    return rows.mapInArrow(run, schema).select("row.*", F.col("ids").alias(out))


def decode_tokens(
    df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded"
) -> DataFrame:
    """Add the text of an id array as a column ``out``; null ids give the empty text."""
    kept = [c for c in df.columns if c != out]
    rows = df.select(F.struct(*kept).alias("row"), F.col(ids).alias("ids"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                lists = [
                    [-1 if i is None else i for i in row or ()]
                    for row in part.column("ids").to_pylist()
                ]
                bounds = np.cumsum([0, *map(len, lists)])
                ids = np.array(list(chain.from_iterable(lists)), np.int64)
                texts = encoder.decode(ids, bounds)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(texts, pa.string())], ["row", "text"]
                )

    return rows.mapInArrow(run, schema).select("row.*", F.col("text").alias(out))


def round_trip(
    df: DataFrame, path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, the ids of each text and the text decoded from these ids, in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        for part, data in byte_groups(batches):
            ids = encoder.encode([d.decode("utf-8", "replace") for d in data])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    list_array(*ids),
                    pa.array(encoder.decode(*ids), pa.string()),
                ],
                ["id", "ids", "text"],
            )

    return (
        with_bytes(df, key, text)
        .mapInArrow(run, "id long, ids array<int>, text string")
        .toDF(key, "token_ids", "decoded")
    )
