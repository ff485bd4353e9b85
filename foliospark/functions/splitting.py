"""Recursive, size-bounded splitting of one text. A helper for Arrow tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

LengthFn = Callable[[list[str]], list[int]]

# --- fixed values -----------------------------------------------------------
SEPARATORS = ("\n\n", "\n", " ", "")
CHUNK_SIZE = 100
CHUNK_OVERLAP = 20
TOKEN_ENCODING = "cl100k_base"
# --------------------------------------------------------------------------

_WORD_PIECE = re.compile(r"\w{1,6}|[^\w\s]")


def approximate_token_count(texts: list[str]) -> list[int]:
    """Offline token estimate: words in pieces of up to six letters, plus marks."""
    return [sum(1 for _ in _WORD_PIECE.finditer(text)) for text in texts]


def tiktoken_count(texts: list[str]) -> list[int]:
    """Exact token counts; needs the encoding's rank file on every executor."""
    import tiktoken

    encoding = tiktoken.get_encoding(TOKEN_ENCODING)
    return [len(x) for x in encoding.encode_ordinary_batch(texts)]


def _pieces(text: str, separator: str) -> list[str]:
    """Cut before each separator, which stays at the head of the next piece."""
    if separator == "":
        return list(text)
    parts = text.split(separator)
    kept = [parts[0], *[separator + part for part in parts[1:]]]
    return [piece for piece in kept if piece]


def _packed(
    pieces: list[str], sizes: list[int], limit: int, overlap: int
) -> Iterator[str]:
    """Pack pieces greedily into windows of ``limit`` whose tails overlap."""
    start, total = 0, 0
    for end, size in enumerate(sizes):
        if total + size > limit and end > start:
            text = "".join(pieces[start:end]).strip()
            if text:
                yield text
            while total > overlap or (total > 0 and total + size > limit):
                total -= sizes[start]
                start += 1
        total += size
    text = "".join(pieces[start:]).strip()
    if text:
        yield text


def split_text(
    text: str,
    length_fn: LengthFn = approximate_token_count,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: tuple[str, ...] = SEPARATORS,
) -> list[str]:
    """Chunks of at most ``size`` tokens, cut at the coarsest separator that fits.

    A piece that alone exceeds the size is split again with the finer
    separators; a single character is never cut.
    """
    if overlap > size:
        raise ValueError("the overlap exceeds the chunk size")
    level = next(
        (i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1
    )
    finer = separators[level + 1 :]
    pieces = _pieces(text, separators[level])
    sizes = length_fn(pieces)
    chunks: list[str] = []
    run: list[int] = []

    def flush() -> None:
        chunks.extend(
            _packed([pieces[i] for i in run], [sizes[i] for i in run], size, overlap)
        )
        run.clear()

    for i, piece in enumerate(pieces):
        if sizes[i] < size:
            run.append(i)
            continue
        flush()
        if finer:
            chunks.extend(split_text(piece, length_fn, size, overlap, finer))
        else:
            chunks.append(piece)
    flush()
    return chunks
