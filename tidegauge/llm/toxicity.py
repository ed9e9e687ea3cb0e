"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct 32-bit hashes of its words, of their stems
(the first 4 and 5 bytes of longer words, so that inflected forms meet), of its
pairs of neighbouring words and of its pairs one word apart.  Training keeps a rate per
coordinate and an L1 penalty, so few weights are not zero and the model is a
short sorted table that travels with the scoring tasks.

The model is fitted on a documented bounded sample (``TRAIN_ROWS``) in one
task; scoring reads every whole text once and shuffles nothing.

Edge cases: a null or empty text has no features and scores the bias alone;
without any labelled row every text scores 0; repeated rows score alike;
further columns pass through, those named like a result column are replaced.
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
TRAIN_ROWS = 8_000
#: Bytes of a word's crude stems.
STEMS = (4, 5)
#: Training texts a feature must occur in.
MIN_TEXTS = 4


@dataclass(frozen=True)
class Weights:
    feature: np.ndarray  # sorted uint32
    weight: np.ndarray
    bias: float


def families(chunk: tx.Chunk) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
    """32-bit feature hashes of a chunk, a family at a time, with the words they start at (None: all) and each word's text."""
    w = tx.words(chunk)
    short = lambda h: (h >> np.uint64(32)).astype(np.uint32)
    yield short(w.hash), None, w.doc
    for n in STEMS:
        long = np.flatnonzero(w.end - w.start > n)
        yield short(w.hasher(w.start[long], w.start[long] + n)) + np.uint32(n), long, w.doc
    for step in (1, 2):
        h, at = tx.ngrams(w.hash, w.doc, 2, step=step, salt=step)
        yield short(h), at, w.doc


def features(chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """All features of a chunk's texts with repetition: hashes and text index."""
    found = [(h, doc if at is None else doc[at]) for h, at, doc in families(chunk)]
    return np.concatenate([h for h, _ in found]), np.concatenate([d for _, d in found])


def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((doc.astype(np.uint64) << np.uint64(32)) | h.astype(np.uint64))
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), (key >> np.uint64(32)).astype(np.int64)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        labels = b.column("label").to_numpy(zero_copy_only=False)
        ids = b.column("id")
        for c in tx.chunks(b.column("text")):
            h, doc = distinct(*features(c))
            cut = np.searchsorted(doc, np.arange(len(c) + 1))
            rows = [h[cut[i] : cut[i + 1]].tobytes() for i in range(len(c))]
            yield pa.record_batch(
                [ids.slice(c.first, len(c)), pa.array(labels[c.first : c.first + len(c)], pa.int32()), pa.array(rows, pa.binary())], names=["id", "label", "features"]
            )


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 0.3, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1, epochs: int = 4, min_texts: int = MIN_TEXTS) -> Weights:
    """FTRL-proximal, a text at a time, over binary features that occur in ``min_texts`` texts."""
    known, counts = np.unique(np.concatenate(rows) if rows else np.zeros(0, np.uint32), return_counts=True)
    known = known[counts >= min_texts]
    z, n = np.zeros(len(known)), np.zeros(len(known))
    z0 = n0 = b = 0.0
    index = []
    for r in rows:
        i = np.searchsorted(known, r)
        i[i == len(known)] = 0
        index.append(i[known[i] == r] if len(known) else i[:0])

    def weight(z, n):
        w = (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i = index[k]
            w = weight(z[i], n[i])
            b = -z0 / ((beta + n0**0.5) / alpha + l2)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - labels[k]
            # The gradient of a present binary feature is g itself.
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
            z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / alpha * b
            n0 += g * g
    w = weight(z, n)
    keep = w != 0
    return Weights(known[keep], w[keep], b if len(rows) else -50.0)


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [(i, y, np.frombuffer(f, np.uint32)) for b in batches for i, y, f in zip(*(b.column(c).to_pylist() for c in ("id", "label", "features")), strict=True)]
    found.sort(key=lambda r: r[0])  # the same order on every run
    m = fit_ftrl([r[2] for r in found], np.array([r[1] for r in found], float))
    out = io.BytesIO()
    np.savez_compressed(out, feature=m.feature, weight=m.weight, bias=m.bias)
    yield pa.record_batch([pa.array([out.getvalue()], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Weights:
    sample = labelled_sample(docs, labels, label, rows, id_col, text_col)
    featured = sample.mapInArrow(_featurise, f"id {dict(sample.dtypes)['id']}, label int, features binary")
    # One task sees the bounded sample's features; the texts stay where they were read.
    blob = featured.repartition(1).mapInArrow(_fit_task, "model binary").first()
    m = np.load(io.BytesIO(blob["model"]))
    return Weights(m["feature"], m["weight"], float(m["bias"]))


def score_chunk(chunk: tx.Chunk, m: Weights, sieve: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text; ``sieve`` marks the low bits of the model's features."""
    total, found = np.full(len(chunk), m.bias), []
    for h, at, doc in families(chunk):
        maybe = np.flatnonzero(sieve[h & np.uint32(len(sieve) - 1)])
        if len(maybe):
            found.append((h[maybe], doc[maybe if at is None else at[maybe]]))
    if found and len(m.feature):
        h, doc = distinct(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        i = np.minimum(np.searchsorted(m.feature, h), len(m.feature) - 1)
        hit = m.feature[i] == h
        total += np.bincount(doc[hit], m.weight[i[hit]], minlength=len(chunk))
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def scored(docs: DataFrame, model: Weights, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``) added."""
    result = ("score", "predicted")
    wide = docs.select(*pass_through(docs, result), docs[text_col].alias("text"))
    schema = T.StructType([wide.schema["doc"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    model = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        sieve = np.zeros(1 << 22, bool)
        sieve[m.feature & np.uint32(len(sieve) - 1)] = True
        for b in batches:
            s = np.concatenate([score_chunk(c, m, sieve) for c in tx.chunks(b.column("text"))] or [np.zeros(0)])
            yield pa.record_batch([b.column("doc"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc", *result])

    return wide.mapInArrow(score, schema).select(*restored(docs, result), *result)
