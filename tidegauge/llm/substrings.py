"""Substring dedup: hashing of normalised lines and of content-cut stretches within them.

Words are lower-cased runs of letters and digits.  Two kinds of unit are
hashed: whole lines of ``MIN_LINE_WORDS`` words or more, and stretches between
anchors.  An anchor is the word of the lowest hash in some ``WINDOW``
neighbouring words of a text, so there is one in every ``WINDOW`` words, and a
passage that is copied into the middle of another line is cut at the same words
there as in its first place, except in the ``WINDOW - 1`` words at its ends.  A
unit spans ``SPAN`` neighbouring stretches, which keeps chance repeats of a few
common words out.

Of a passage of n words at least ``n - 4 * WINDOW + 3`` lie between its first and
last shared anchors: 22 of 51, so no passage of more than 50 words stays whole.

Digests are grouped over the corpus with pre-aggregation; the occurrence of the
lowest document id, and in it the first, is kept and the others are repeats.
Every repeated line goes.  Within lines, overlapping and touching repeats of a
document are joined, with lines that repeat among them, and a joined stretch goes
when it has ``min_words`` words or more: a shorter phrase inside a line stays.
``removed`` keeps the byte offsets of what went, in the original text.  Where a
copy begins or ends inside a line, the words up to the next shared anchor stay,
at most ``2 * WINDOW - 2`` at each end.

Edge cases: null and empty texts have no units and pass unchanged; rows of one
id have one rank and are not repeats of each other; rows with a null id rank
last; lines of fewer than ``MIN_LINE_WORDS`` words are no units of their own;
further columns pass through whatever their names, those named like a result
column are replaced.  Equal 64-bit digests stand for equal units.  A unit that very
many documents hold is dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm import text as tx
from tidegauge.llm.shared import dealt_join, pass_through, written

#: One word at least in so many neighbouring ones is an anchor.
WINDOW = 8
#: Stretches of a unit.
SPAN = 3
#: Words of a repeat within lines.
MIN_WORDS = 20
MIN_LINE_WORDS = 5
RESULT = ("n_words", "n_removed", "removed")

_LINE = np.uint64(1 << 63)
_M32 = np.uint64(0xFFFFFFFF)


class _Ranges:
    """Digests of ranges of neighbouring words."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        power = np.full(n + 1, tx._BASE, np.uint64)
        inverse = np.full(n + 1, tx._BASE_INVERSE, np.uint64)
        power[0] = inverse[0] = 1
        self.inverse = np.cumprod(inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * np.cumprod(power)[:n], out=self.sums[1:])

    def __call__(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return tx.mix((self.sums[stop] - self.sums[first]) * self.inverse[first] + (stop - first).astype(np.uint64))


def anchors(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words that have the lowest hash, and are the last that have it, of ``WINDOW`` words of one text."""
    h = tx.mix(hashes ^ np.uint64(0xA5))
    m = len(h) - WINDOW + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    low, at = h[:m].copy(), np.arange(m)
    for k in range(1, WINDOW):
        less = np.flatnonzero(h[k : k + m] <= low)
        low[less] = h[k + less]
        at[less] = less + k
    return np.unique(at[doc[:m] == doc[WINDOW - 1 :]])


def cut_units(c: tx.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, digest, place and first-in-text flag of each unit; a place packs the kind and the range of word numbers."""
    w = tx.words(c)
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    text_first = np.ones(n, bool)
    text_first[1:] = w.doc[1:] != w.doc[:-1]
    line = np.searchsorted(np.flatnonzero(c.data == 10), w.start)
    line_first = text_first.copy()
    line_first[1:] |= line[1:] != line[:-1]
    first = text_first.copy()
    first[anchors(w.hash, w.doc)] = True

    digest = _Ranges(w.hash)
    base = np.concatenate([[0], np.cumsum(w.count)])  # first word of each text
    at = np.flatnonzero(first)
    # A stretch with the next ones of its text, or a text of too few stretches.
    ahead = np.append(at, np.full(SPAN, n))
    whole = np.zeros(len(at), bool)
    whole[: len(at) - SPAN + 1] = w.doc[at[SPAN - 1 :]] == w.doc[at[: len(at) - SPAN + 1]] if len(at) >= SPAN else False
    alone = ~whole & text_first[at]
    span_stop = np.where(whole, ahead[SPAN:], base[w.doc[at] + 1])
    use = whole | alone
    lines = np.flatnonzero(line_first)
    line_stop = np.append(lines[1:], n)
    long = line_stop - lines >= MIN_LINE_WORDS

    begin = np.concatenate([at[use], lines[long]])
    end = np.concatenate([span_stop[use], line_stop[long]])
    kind = np.concatenate([np.zeros(use.sum(), np.uint64), np.full(long.sum(), _LINE)])
    h = digest(begin, end) ^ (kind >> np.uint64(1))
    doc = w.doc[begin]
    place = kind | ((begin - base[doc]).astype(np.uint64) << np.uint64(32)) | (end - base[doc]).astype(np.uint64)
    key = tx.mix(h + doc.astype(np.uint64) * tx._BASE)
    order = np.lexsort((begin, key))
    is_first = np.ones(len(key), bool)
    is_first[order[1:]] = key[order[1:]] != key[order[:-1]]
    return doc, h, place, is_first


def units(docs: DataFrame) -> DataFrame:
    """``row, id, digest, place, first`` of every unit of ``docs(row, id, text)``."""
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tx.chunks(b.column("text")):
                doc, h, place, first = cut_units(c)
                if len(doc):
                    at = pa.array(doc)
                    yield pa.record_batch(
                        [b.column("row").slice(c.first, len(c)).take(at), b.column("id").slice(c.first, len(c)).take(at), pa.array(h.view(np.int64)), pa.array(place.view(np.int64)), pa.array(first)],
                        names=["row", "id", "digest", "place", "first"],
                    )

    return docs.mapInArrow(run, f"row long, id {kind}, digest long, place long, first boolean")


def joined_repeats(place: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Ranges of words to remove (n x 2), from the places of one text's repeats."""
    place = place.view(np.uint64)
    line = (place & _LINE) > 0
    lo = ((place & ~_LINE) >> np.uint64(32)).astype(np.int64)
    hi = (place & _M32).astype(np.int64)

    def union(lo, hi):
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], np.maximum.accumulate(hi[order])
        new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
        return np.stack([lo[new], hi[np.append(new[1:], len(hi)) - 1]], 1)

    whole = union(lo, hi)
    keep = whole[whole[:, 1] - whole[:, 0] >= min_words]
    keep = np.concatenate([keep, np.stack([lo[line], hi[line]], 1)])
    return union(keep[:, 0], keep[:, 1]) if len(keep) else keep


def repeats(source: DataFrame) -> DataFrame:
    """``row, places``: the repeated units of each document that has any."""
    u = units(source)
    # One entry a document and digest; a count above 1 means several documents hold it.
    first = u.where("first").select("row", "id", "digest", "place")
    shared = written(first.groupBy("digest").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1"), "shared")
    later = dealt_join(first, shared, "digest", "n", "row").where("id > low or (id is null and low is not null)").select("row", "place")
    again = u.where("not first").select("row", "place")
    return later.unionByName(again).groupBy("row").agg(F.collect_set("place").alias("places"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeats cut from the text, and ``n_words, n_removed, removed`` (byte offsets) added."""
    row = F.xxhash64(docs[id_col], docs[text_col])
    found = repeats(docs.select(row.alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text")))
    wide = docs.select(*pass_through(docs, (*RESULT, text_col)), docs[text_col].alias("text"), row.alias("row")).join(found, "row", "left").select("doc", "text", "places")
    schema = T.StructType([wide.schema["doc"], *T._parse_datatype_string("text string, n_words long, n_removed long, removed array<struct<start:int,end:int>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tx.chunks(b.column("text")):
                yield _cut(b.slice(c.first, len(c)), c, min_words)

    columns = [F.col("text").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns if c not in RESULT]
    return wide.mapInArrow(run, schema).select(*columns, *RESULT)


def _cut(b: pa.RecordBatch, c: tx.Chunk, min_words: int) -> pa.RecordBatch:
    w = tx.words(c)
    base = np.concatenate([[0], np.cumsum(w.count)])
    raw = c.data.tobytes()
    texts, spans, removed = b.column("text").to_pylist(), [], []
    for i, places in enumerate(b.column("places").to_pylist()):
        mine, gone = [], 0
        if places:
            start = np.append(w.start[base[i] : base[i + 1]], c.offsets[i + 1])
            at, parts = int(c.offsets[i]), []
            for lo, hi in joined_repeats(np.array(places, np.int64), min_words).tolist():
                parts.append(raw[at : start[lo]])
                at = int(start[hi])
                mine.append({"start": int(start[lo] - c.offsets[i]), "end": int(at - c.offsets[i])})
                gone += hi - lo
            parts.append(raw[at : c.offsets[i + 1]])
            if mine:
                texts[i] = b"".join(parts).decode()
        spans.append(mine)
        removed.append(gone)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.record_batch([b.column("doc"), pa.array(texts, pa.string()), pa.array(w.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind)], names=["doc", "text", *RESULT])
