"""Quality classifier: supervised subword embeddings in the manner of a bag of n-gram vectors.

A text is the average of learned vectors of hashed words, word pairs and byte
n-grams; a softmax over two classes reads the average.  Training is numpy
stochastic gradient descent on a documented bounded sample (``TRAIN_ROWS``).
At scoring time the output layer is folded into the vectors, so each feature
carries one number and a text is a mean of table look-ups.

Edge cases: a null or empty text has no features and scores by the bias; with
no labelled row every text scores 0.5; repeated rows score alike; further
columns pass through, those named like a result column are replaced.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegauge.llm import text as tx
from tidegauge.llm.sample import labelled_sample
from tidegauge.llm.shared import pass_through, restored

#: Labelled rows the model learns from, at most.
TRAIN_ROWS = 5_000
#: log2 of the number of hashed vectors.
BITS = 18
BYTE_GRAMS = (3, 4)
SAME = np.uint64(0x51ED270B)  # the shared feature of a word that repeats the one before


@dataclass(frozen=True)
class Table:
    logit: np.ndarray  # float32, one per hashed feature
    bias: float


def families(chunk: tx.Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket of every feature of a chunk and the number of features of each text, a family at a time, in text order."""
    w = tx.words(chunk)
    bucket = lambda h: (h >> np.uint64(64 - BITS)).astype(np.int32)
    yield bucket(w.hash), w.count
    h, at = tx.ngrams(w.hash, w.doc, 2, salt=3)
    h = np.where(w.hash[at] == w.hash[np.minimum(at + 1, len(w.hash) - 1)], tx.mix(np.full(1, SAME))[0], h)
    yield bucket(h), np.bincount(w.doc[at], minlength=len(chunk))
    raw = tx.Hasher(chunk.data)  # case and punctuation kept
    sizes = np.diff(chunk.offsets)
    for n in BYTE_GRAMS:
        count = np.maximum(sizes - n + 1, 0)
        first = np.repeat(chunk.offsets[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        start = first + np.arange(len(first))
        yield bucket(raw(start, start + n)), count


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets of each text and their share of its features."""
    for b in batches:
        labels = b.column("label").to_numpy(zero_copy_only=False)
        ids = b.column("id")
        for c in tx.chunks(b.column("text")):
            found, share = text_features(c)
            yield pa.record_batch(
                [ids.slice(c.first, len(c)), pa.array(labels[c.first : c.first + len(c)], pa.int32()), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([x.tobytes() for x in share], pa.binary())],
                names=["id", "label", "features", "share"],
            )


def text_features(c: tx.Chunk) -> tuple[list[np.ndarray], list[np.ndarray]]:
    parts = [(h, np.concatenate([[0], np.cumsum(n)])) for h, n in families(c)]
    found, share = [], []
    for i in range(len(c)):
        h, n = np.unique(np.concatenate([h[cut[i] : cut[i + 1]] for h, cut in parts]), return_counts=True)
        found.append(h)
        share.append((n / max(1, n.sum())).astype(np.float32))
    return found, share


def fit_vectors(features: list[np.ndarray], share: list[np.ndarray], labels: np.ndarray, dim: int = 8, rate: float = 1.0, epochs: int = 6, seed: int = 11) -> Table:
    """Averaged vectors and a softmax of two classes, a text at a time, with a falling rate."""
    if not len(labels):
        return Table(np.zeros(1 << BITS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out, bias = rng.uniform(-1, 1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for k in rng.permutation(len(labels)):
            lr, done = rate * (1 - done / steps), done + 1
            i, x = features[k], share[k]
            h = x @ vectors[i]
            s = h @ out + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = out @ p
            out -= lr * np.outer(h, p)
            bias -= lr * 0.1 * p
            # Shares are small: the step of a vector is scaled by the text's largest share.
            vectors[i] -= (lr * x / x.max())[:, None] * back[None, :] if len(x) else 0
    fold = vectors @ (out[:, 1] - out[:, 0])
    return Table(fold.astype(np.float32), float(bias[1] - bias[0]))


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [
        (i, y, np.frombuffer(f, np.int32), np.frombuffer(s, np.float32))
        for b in batches
        for i, y, f, s in zip(*(b.column(c).to_pylist() for c in ("id", "label", "features", "share")), strict=True)
    ]
    found.sort(key=lambda r: r[0])  # the same order on every run
    m = fit_vectors([r[2] for r in found], [r[3] for r in found], np.array([r[1] for r in found], int))
    out = io.BytesIO()
    np.savez_compressed(out, logit=m.logit, bias=m.bias)
    yield pa.record_batch([pa.array([out.getvalue()], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Table:
    sample = labelled_sample(docs, labels, label, rows, id_col, text_col)
    featured = sample.mapInArrow(_featurise, f"id {dict(sample.dtypes)['id']}, label int, features binary, share binary")
    # One task sees the bounded sample's features; the texts stay where they were read.
    blob = featured.repartition(1).mapInArrow(_fit_task, "model binary").first()
    m = np.load(io.BytesIO(blob["model"]))
    return Table(m["logit"], float(m["bias"]))


def score_chunk(chunk: tx.Chunk, m: Table) -> np.ndarray:
    total, count = np.zeros(len(chunk)), np.zeros(len(chunk))
    for h, n in families(chunk):
        sums = np.concatenate([[0.0], np.cumsum(m.logit[h], dtype=np.float64)])
        cut = np.concatenate([[0], np.cumsum(n)])
        total += sums[cut[1:]] - sums[cut[:-1]]
        count += n
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + m.bias, -35, 35)))


def scored(docs: DataFrame, model: Table, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``) added."""
    result = ("score", "predicted")
    wide = docs.select(*pass_through(docs, result), docs[text_col].alias("text"))
    schema = T.StructType([wide.schema["doc"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    model = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.concatenate([score_chunk(c, model.value) for c in tx.chunks(b.column("text"))] or [np.zeros(0)])
            yield pa.record_batch([b.column("doc"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc", *result])

    return wide.mapInArrow(score, schema).select(*restored(docs, result), *result)
