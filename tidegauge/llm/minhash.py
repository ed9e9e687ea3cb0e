"""Near-dedup by ProbMinHash over weighted word shingles, banding and verification.

A document is the bag of its ``SHINGLE``-word shingles, weighted by how often
they occur.  Each shingle is a Poisson process with its weight as rate; its
arrivals go to random registers, and a register keeps the shingle of its first
arrival, so two documents agree in a register with probability equal to their
probability Jaccard similarity.  Arrivals stop at a time by which the registers
of the document are full (it is doubled for the few that are not), so most
shingles of a long document end after one comparison.

Registers are banded; documents with equal words are one class first.  Each
candidate pair is verified by the exact probability Jaccard similarity of
their shingles, and linked classes form groups.

Edge cases: texts of fewer than ``SHINGLE`` words, but not none, are one
shingle of all their words; texts without words, nulls included, link with
nothing; rows with a null id are kept and never compared; rows of one id share
one verdict, and rows with the id and the text of a kept row are kept; ids may
be of any type that has an order; further columns pass through whatever their
names; an empty table gives an empty result.  Equal 64-bit hashes stand for
equal words and word sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import text as tx
from tidegauge.llm.clusters import buckets, clusters
from tidegauge.llm.shared import arrow_rows, pass_through, restored, written

SHINGLE = 5
SIMILARITY = 0.8
#: At a similarity of 0.8 the chance to share none of 24 bands of 5 registers is 7e-5.
BANDS, ROWS = 24, 5
#: Texts, or pairs of payloads, that go to Python at once.
BATCH_ROWS = 1_000
_ALL = (1 << 64) - 1


def shingles(c: tx.Chunk, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and weight of the distinct shingles of a chunk, by text."""
    w = tx.words(c)
    h, at = tx.ngrams(w.hash, w.doc, n)
    doc = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        first = (np.cumsum(w.count) - w.count)[short]
        own = [tx.mix(np.bitwise_xor.reduce(w.hash[a : a + k] * np.arange(3, 2 * k + 3, 2, dtype=np.uint64))[None])[0] for a, k in zip(first, w.count[short], strict=True)]
        h, doc = np.concatenate([h, np.array(own, np.uint64)]), np.concatenate([doc, short])
    _, at, weight = np.unique(tx.mix(h + doc.astype(np.uint64) * tx._BASE), return_index=True, return_counts=True)
    order = np.lexsort((h[at], doc[at]))
    return h[at][order], doc[at][order], weight[order]


def word_digest(c: tx.Chunk) -> np.ndarray:
    """A hash of each text's sequence of words; 0 without words."""
    w = tx.words(c)
    n = len(w.hash)
    cut = np.concatenate([[0], np.cumsum(w.count)])
    power = np.full(n + 1, tx._BASE, np.uint64)
    inverse = np.full(n + 1, tx._BASE_INVERSE, np.uint64)
    power[0] = inverse[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * np.cumprod(power)[:n])])
    out = tx.mix((sums[cut[1:]] - sums[cut[:-1]]) * np.cumprod(inverse)[cut[:-1]] + w.count.astype(np.uint64))
    return np.where(w.count > 0, out, np.uint64(0))


def _uniform(h: np.ndarray, step: int) -> np.ndarray:
    return ((tx.mix(h ^ np.uint64(0xD1B54A32D192ED03 * (2 * step + 1) & _ALL)) >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)


def registers(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, texts: int, m: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash registers (texts x m) of weighted shingles; 0 in texts without any."""
    out = np.zeros((texts, m), np.uint64)
    total = np.bincount(doc, weight, minlength=texts)
    limit = m * (np.log(m) + 2) / np.maximum(total, 1)
    todo = np.arange(len(h))
    while len(todo):
        hh, dd, ww = h[todo], doc[todo], weight[todo].astype(np.float64)
        best = np.full(texts * m, np.inf)
        arrivals = []
        t = -np.log(_uniform(hh, 0)) / ww
        step = 0
        while True:
            on = t <= limit[dd]
            if not on.any():
                break
            hh, dd, ww, t = hh[on], dd[on], ww[on], t[on]
            slot = dd * m + (tx.mix(hh + np.uint64((2 * step + 1) * int(tx._BASE) & _ALL)) % np.uint64(m)).astype(np.int64)
            np.minimum.at(best, slot, t)
            arrivals.append((slot, t, hh))
            step += 1
            t = t - np.log(_uniform(hh, step)) / ww
        flat = out.reshape(-1)
        for slot, at, who in arrivals:
            won = best[slot] == at
            flat[slot[won]] = who[won]
        full = np.isfinite(best).reshape(texts, m).all(1)
        limit = np.where(full, limit, 2 * limit)
        todo = todo[~full[doc[todo]]]
    return out


def band_keys(regs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    h = np.zeros((len(regs), regs.shape[1] // rows), np.uint64)
    for k in range(rows):
        h = tx.mix(h * tx._BASE + regs[:, k::rows])
    return tx.mix(h + np.arange(h.shape[1], dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def probability_jaccard(a: bytes, b: bytes) -> float:
    """J_P of two payloads: the sum over shared i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    (ha, xa), (hb, xb) = _open(a), _open(b)
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = xa[i].astype(float), xb[j].astype(float)
    rest_x, rest_y = xa.sum() - x.sum(), xb.sum() - y.sum()
    order = np.argsort(-x / y, kind="stable")
    x, y = x[order], y[order]
    # Sorted by falling x/y, the maximum is x_j/x_i for the j before i (and for i), y_j/y_i after; ties agree.
    head, tail = np.cumsum(x), y.sum() - np.cumsum(y)
    return float((1 / ((rest_x + head) / x + (rest_y + tail) / y)).sum())


def _open(p: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(p) // 12
    return np.frombuffer(p, np.uint64, n), np.frombuffer(p, np.uint32, n, 8 * n)


def _pass(a: list[bytes], b: list[bytes], least: float) -> list[bool]:
    return [probability_jaccard(x, y) >= least - 1e-12 for x, y in zip(a, b, strict=True)]


def _links(payloads: list[bytes], parts: np.ndarray, least: float, sides: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links among documents of different components (and sides, if given), from the matrix of their shared shingles.

    With X and Y the shares of the two documents' weight that is common, the
    similarity is at most XY / (Y + (1 - Y) X), and that exactly when all
    weights are 1; other pairs within the bound are computed one by one.
    """
    opened = [_open(p) for p in payloads]
    size = np.array([len(h) for h, _ in opened])
    doc = np.repeat(np.arange(len(opened)), size)
    h = np.concatenate([h for h, _ in opened])
    weight = np.concatenate([w for _, w in opened]).astype(np.float32)
    total = np.bincount(doc, weight, minlength=len(opened))
    order = np.argsort(h, kind="stable")
    h, doc, weight = h[order], doc[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    stop = np.append(first[1:], len(h))
    common = np.zeros((len(opened), len(opened)), np.float32)  # weight of row's shingles that column has too
    for a, z in zip(first[stop - first > 1].tolist(), stop[stop - first > 1].tolist(), strict=True):
        common[np.ix_(doc[a:z], doc[a:z])] += weight[a:z, None]
    x = common / np.maximum(total, 1)[:, None]
    y = x.T
    bound = x * y / np.maximum(y + (1 - y) * x, 1e-9)
    plain = total == size
    root = parts.copy()
    open_ = (bound >= least - 1e-5) & (parts[:, None] != parts[None, :])
    if sides is not None:
        open_ &= sides[:, None] != sides[None, :]
    for i, j in zip(*np.nonzero(np.triu(open_, 1)), strict=True):
        if root[i] != root[j] and (plain[i] and plain[j] and bound[i, j] >= least + 1e-5 or probability_jaccard(payloads[i], payloads[j]) >= least - 1e-12):
            root[root == root[j]] = root[i]
            yield int(i), int(j)


def signatures(source: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``row, id, digest, keys`` of ``source(row, id, text)``; texts without words are left out."""
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tx.chunks(b.column("text")):
                digest = word_digest(c).view(np.int64)
                h, doc, weight = shingles(c, shingle)
                keys = band_keys(registers(h, doc, weight, len(c))).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
                some = pa.array(np.bincount(doc, minlength=len(c)) > 0)
                yield pa.record_batch(
                    [b.column("row").slice(c.first, len(c)), b.column("id").slice(c.first, len(c)), pa.array(digest), lists], names=["row", "id", "digest", "keys"]
                ).filter(some)

    return source.mapInArrow(run, f"row long, id {kind}, digest long, keys array<long>")


def _payloads(source: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tx.chunks(b.column("text")):
                h, doc, weight = shingles(c, shingle)
                cut = np.searchsorted(doc, np.arange(len(c) + 1))
                rows = [h[a:z].tobytes() + weight[a:z].astype(np.uint32).tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.record_batch([pa.array(word_digest(c).view(np.int64)), pa.array(rows, pa.binary())], names=["node", "payload"])

    return source.mapInArrow(run, "node long, payload binary")


def _row(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A hash that tells rows of one id with unlike texts apart."""
    return F.xxhash64(docs[id_col], docs[text_col])


def _grouped(docs: DataFrame, id_col: str, text_col: str, similarity: float, shingle: int) -> DataFrame:
    """``row, id, component_id`` of every row with words: the smallest id of the group of its text."""
    source = docs.select(_row(docs, id_col, text_col).alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text")).where(F.col("id").isNotNull())
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        signed = written(signatures(source, shingle), "signatures")
    # Equal words make one class; its first document stands for it where texts are needed.
    classes = signed.groupBy("digest").agg(F.min("id").alias("first"))
    entries = signed.select(F.explode("keys").alias("key"), F.col("digest").alias("node")).distinct()

    def payloads(nodes: DataFrame) -> DataFrame:
        wanted = classes.join(nodes, classes["digest"] == nodes["node"], "left_semi").select(F.col("first").alias("id"))
        texts = source.join(wanted, "id", "left_semi")
        return _payloads(texts, shingle).join(nodes, "node", "left_semi").groupBy("node").agg(F.max("payload").alias("payload"))

    parts = clusters(buckets(entries), payloads, lambda a, b: _pass(a, b, similarity), lambda p, parts, sides: _links(p, parts, similarity, sides), batch_rows=BATCH_ROWS)
    named = classes.join(parts.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "first", F.coalesce("component", "digest").alias("root"))
    low = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = named.join(low, "root").select("digest", "component_id")
    return signed.select("row", "id", "digest").join(of_class, "digest").select("row", "id", "component_id")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``id, component_id, kept`` of every id: groups of near copies, named by and keeping their smallest id.

    An id with unlike texts may be in several groups; it is kept when it is the
    smallest of any, so each group has a kept id, and else named by the smallest.
    """
    low, top = F.min("component_id"), F.max("component_id")
    of_id = _grouped(docs, id_col, text_col, similarity, shingle).groupBy("id").agg(F.when(top == F.col("id"), top).otherwise(low).alias("component_id"))
    return (
        docs.select(docs[id_col].alias("id")).where("id is not null").distinct().join(of_id, "id", "left")
        .select("id", F.coalesce("component_id", "id").alias("component_id"), (F.coalesce("component_id", "id") == F.col("id")).alias("kept"))
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the rows of one id of each group; each row goes by its own text."""
    gone = _grouped(docs, id_col, text_col, similarity, shingle).where("component_id <> id").select("id", "row")
    wide = docs.select(*pass_through(docs), docs[id_col].alias("id"), _row(docs, id_col, text_col).alias("row"))
    return wide.join(gone, ["id", "row"], "left_anti").select(*restored(docs))
