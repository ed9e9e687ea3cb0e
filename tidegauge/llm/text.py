"""Vectorised word and n-gram hashing over Arrow string columns.

A chunk of texts is one byte array with the offset of each text; words are
found and hashed with array operations, so no Python object is made per word.
Words are runs of ``[0-9A-Za-z]`` and non-ASCII bytes, A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IS_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)

_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    """Powers 0..n of the hash base or of its inverse modulo 2**64; grown on demand, kept up to two chunks."""
    have = _powers.get(which)
    if have is None or len(have) <= n:
        base = _BASE if which == "base" else _BASE_INVERSE
        have = np.full(max(n + 1, CHUNK_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if n <= 2 * CHUNK_BYTES:
            _powers[which] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Chunk:
    first: int  # row of the first text
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # len(texts) + 1

    def __len__(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Split a string column into chunks of whole texts; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield Chunk(at, data[off[at] : off[to]], off[at : to + 1] - off[at])
        at = to
    pa.default_memory_pool().release_unused()


class Hasher:
    """64-bit hashes of byte spans: differences of prefix sums of a polynomial, moved to position 0."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("base", n)[:n], out=self.sums[1:])
        self.inverse = _power("inverse", n)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # index of the text in its chunk
    hash: np.ndarray
    count: np.ndarray  # words of each text
    hasher: Hasher


def words(chunk: Chunk) -> Words:
    data = LOWER[chunk.data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IS_WORD[data]
    # A text's end also ends a word: compare within texts only.
    change = inside[1:] != inside[:-1]
    cut = np.unique(chunk.offsets[1:-1])
    cut = cut[(cut > 0) & (cut < len(data))]
    joined = cut[inside[cut] & inside[cut + 1]]
    edges = np.flatnonzero(change)
    if len(joined):
        edges = np.sort(np.concatenate([edges, joined, joined]))
    start, end = edges[0::2], edges[1::2]
    doc = np.searchsorted(chunk.offsets, start, "right") - 1
    hasher = Hasher(data)
    return Words(start, end, doc, hasher(start, end), np.bincount(doc, minlength=len(chunk)), hasher)


def ngrams(hashes: np.ndarray, doc: np.ndarray, n: int, step: int = 1, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` words ``step`` apart within one text, and the word index each starts at."""
    reach = (n - 1) * step
    m = len(hashes) - reach
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[reach:])
    h = np.full(len(at), salt * 2 + 1, np.uint64)
    for k in range(n):
        h = h * _BASE + hashes[at + k * step]
    return mix(h), at
