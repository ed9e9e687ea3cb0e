"""Vectorised pre-tokens of the byte-level pattern, and packing of word lists.

The pattern cuts a text at changes between letters, numbers, white space and
other characters; one space joins the run after it, a longer white-space run
leaves its last character, and ``'s 't 're 've 'm 'll 'd`` stand alone where an
apostrophe begins a pre-token.  Texts with characters whose class differs
between Unicode versions are cut by the pattern itself.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

from tidegauge.llm import text as tx

OTHER, LETTER, NUMBER, SPACE, UNSTABLE = range(5)
#: The White_Space characters.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def classes() -> np.ndarray:
    """Class of each code point; UNSTABLE where the oldest and newest tables at hand disagree."""
    out = np.full(0x110000, UNSTABLE, np.uint8)
    of = {"L": LETTER, "N": NUMBER}
    old = unicodedata.ucd_3_2_0.category
    for i in range(0x30000):
        a, b = old(ch := chr(i)), unicodedata.category(ch)
        if a != "Cn" and a[0] == b[0]:
            out[i] = of.get(b[0], OTHER)
    out[WHITE] = SPACE
    return out


@cache
def pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


@dataclass
class Pretokens:
    start: np.ndarray  # byte positions in the chunk
    end: np.ndarray
    count: np.ndarray  # pre-tokens of each text
    hash: np.ndarray


def pretokens(chunk: tx.Chunk) -> Pretokens:
    data = chunk.data
    if not len(data):
        none = np.zeros(0, np.int64)
        return Pretokens(none, none, np.zeros(len(chunk), np.int64), np.zeros(0, np.uint64))
    text = data.tobytes().decode("utf-8")
    point = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(lead, chunk.offsets)  # of each text, in code points
    c = classes()[point]
    n = len(c)

    begins = np.ones(n + 1, bool)
    begins[1:n] = c[1:] != c[:-1]
    text_start = np.zeros(n + 1, bool)
    text_start[first] = True
    begins |= text_start
    # White space before something of the same text gives up its last character.
    last = np.flatnonzero((c[:-1] == SPACE) & (c[1:] != SPACE) & ~text_start[1:n])
    begins[last] = True
    begins[last[point[last] == 32] + 1] = False
    # Contractions: a lone apostrophe that begins a pre-token.
    for i in np.flatnonzero((point == 39) & begins[:n]).tolist():
        stop = int(first[np.searchsorted(first, i, "right")])
        for tail in CONTRACTIONS:
            if i + len(tail) < stop and text[i + 1 : i + 1 + len(tail)] == tail:
                begins[i + 1 : i + 1 + len(tail)] = False
                begins[i + 1 + len(tail)] = True
                break
    if (c == UNSTABLE).any():
        for k in np.unique(np.searchsorted(first, np.flatnonzero(c == UNSTABLE), "right") - 1).tolist():
            lo, hi = int(first[k]), int(first[k + 1])
            begins[lo:hi] = False
            begins[[lo + m.start() for m in pattern().finditer(text[lo:hi])]] = True
    at = np.flatnonzero(begins[:n])
    start = lead[at]
    end = np.append(start[1:], len(data))
    count = np.diff(np.searchsorted(at, first))
    return Pretokens(start, end, count, _hashes(data, start, end))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = tx.CHUNK_BYTES) -> np.ndarray:
    """Hashes of ascending spans, from some ``step`` bytes at a time."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + step, "right")))
        a = start[i]
        out[i:j] = tx.Hasher(data[a : end[j - 1]])(start[i:j] - a, end[i:j] - a)
        i = j
    return out


class Known:
    """Ids of words by the words' hashes.

    Hashes lie in sorted runs, each at least twice as long as the next, so a
    word is moved a logarithmic number of times; the ids lie in a pool that
    doubles when it is full.
    """

    def __init__(self, dtype):
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pool, self.used, self.words = np.zeros(1024, dtype), 0, 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each word begin, how many they are, and which words are not known."""
        start, size, left = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.arange(len(h))
        for known, s, n in self.runs:
            i = np.minimum(np.searchsorted(known, h[left]), len(known) - 1)
            hit = known[i] == h[left]
            start[left[hit]], size[left[hit]] = s[i[hit]], n[i[hit]]
            left = left[~hit]
        return start, size, left

    def add(self, h: np.ndarray, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Remember distinct new words; returns where their ids begin and how many they are."""
        size = np.array([len(i) for i in ids], np.int64)
        start = self.used + np.cumsum(size) - size
        flat = np.fromiter((i for x in ids for i in x), self.pool.dtype, int(size.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.used, self.words = self.used + len(flat), self.words + len(h)
        order = np.argsort(h)
        self.runs.append((h[order], start[order], size[order]))
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            parts = [np.concatenate(x) for x in zip(self.runs.pop(), self.runs.pop(), strict=True)]
            order = np.argsort(parts[0])
            self.runs.append(tuple(p[order] for p in parts))
        return start, size


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of the given spans, one after another."""
    size = end - start
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return data[shift + np.arange(len(shift))] if len(shift) else data[:0]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers in one compressed value; wide ones by byte planes."""
    parts = [np.array([len(arrays)] + [x for a in arrays for x in (a.itemsize, len(a))], np.uint64).tobytes()]
    for a in arrays:
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() if a.itemsize > 1 else a.tobytes())
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    head = np.frombuffer(raw, np.uint64, 2 * n, 8).astype(np.int64).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for width, size in head.tolist():
        planes = np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}") if width > 1 else planes[0])
        at += width * size
    return out
