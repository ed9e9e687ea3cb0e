"""Ranked lexical search by presence masks.

Terms are runs of ``[0-9A-Za-z]`` and non-ASCII characters, A-Z lower-cased.
One scan of the documents makes an index of blocks that holds the terms of the
asked items only: each block has its documents, their lengths, and a posting list
for each term.  Document frequencies, the number of documents and of terms are
added up from the blocks.

A task then ranks the items block by block.  Posting lists become bitmaps over
the block's documents; the bitmaps of an item's terms give each document the mask
of the terms it holds, and documents of one mask are one group.  A mask's greatest
score is the sum of its terms' greatest contributions in the block.  Masks are
evaluated from the greatest down, until the next cannot reach the item's tenth
score so far; a mask that could equal it is still evaluated, since ids break ties.
Each task gives at most ``k`` rows an item, and these are ranked in two steps, so
no task meets all of them.

Items are taken in blocks of ``ITEM_TERMS`` terms at most (an item of more is a
block of its own): what goes to the tasks at once, and the memory of a task, has
that bound.  Documents are read once for each block of items.

Edge cases: a null text has no terms and an item without terms has no rows;
rows of one item id are one item with all their terms; repeated rows of a
document are ranked as documents of their own; null document ids come after
others of their score; a table without terms gives no rows; other columns are
not carried.  Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidegauge.llm import text as tx
from tidegauge.llm.shared import written

#: Bytes of text of a block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Term places (an item's distinct terms, over all items) of a block of items.
ITEM_TERMS = 200_000
#: Masks evaluated before the bound is looked at again.
STEP = 32
#: Parts in which a first ranking is taken.
PARTS = 64


@dataclass
class Items:
    """A block of items: the hashes of their distinct terms, sorted, and each item's places in them with repeats."""

    ids: list
    terms: np.ndarray
    places: list[np.ndarray]
    repeats: list[np.ndarray]


def item_blocks(items: DataFrame, item_col: str = "item_id", text_col: str = "text", limit: int = ITEM_TERMS) -> Iterator[Items]:
    """The items in ascending order of id, block by block.

    Items are the query set: they pass the driver a row at a time, and no more
    than a block of them is held.
    """
    rows = items.groupBy(items[item_col].alias("item")).agg(F.concat_ws(" ", F.array_sort(F.collect_list(items[text_col]))).alias("text")).orderBy("item")
    held: list[tuple[object, np.ndarray, np.ndarray]] = []
    size = 0
    for row in rows.toLocalIterator():
        chunk = next(tx.chunks(pa.array([row["text"]])))
        terms, repeats = np.unique(tx.words(chunk).hash, return_counts=True)
        if not len(terms):
            continue
        if held and size + len(terms) > limit:
            yield _block(held)
            held, size = [], 0
        held.append((row["item"], terms, repeats.astype(np.int64)))
        size += len(terms)
    if held:
        yield _block(held)


def _block(held) -> Items:
    terms = np.unique(np.concatenate([t for _, t, _ in held]))
    return Items([i for i, _, _ in held], terms, [np.searchsorted(terms, t) for _, t, _ in held], [r for _, _, r in held])


def index(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ids, lengths, terms, starts, members, times``: blocks of documents with posting lists of ``terms`` (sorted hashes).

    ``terms`` in a row are places in the given array; the postings of the i-th
    run from ``starts[i]`` to ``starts[i + 1]`` and name documents by their place.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda x, t: pa.array([x], pa.list_(t))
        for b in batches:
            for c in tx.chunks(b.column("text"), BLOCK_BYTES):
                w = tx.words(c)
                at = np.minimum(np.searchsorted(terms, w.hash), len(terms) - 1)
                asked = np.flatnonzero(terms[at] == w.hash) if len(terms) else np.zeros(0, np.int64)
                posting, times = np.unique(at[asked] * len(c) + w.doc[asked], return_counts=True)
                term, member = posting // len(c), posting % len(c)
                present, start = np.unique(term, return_index=True)
                ids = pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), b.column("id").slice(c.first, len(c)))
                yield pa.record_batch(
                    [ids, one(w.count, pa.int64()), one(present, pa.int32()), one(np.append(start, len(term)), pa.int32()), one(member, pa.int32()), one(times, pa.int32())],
                    names=["ids", "lengths", "terms", "starts", "members", "times"],
                )

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"ids array<{kind}>, lengths array<long>, terms array<int>, starts array<int>, members array<int>, times array<int>")


@dataclass
class Corpus:
    documents: int  # with at least one term
    length: int  # terms of all documents
    weights: np.ndarray  # of each asked term


def corpus_statistics(blocks: DataFrame, n_terms: int) -> Corpus:
    """Counts over all blocks; one row per asked term comes to the driver."""
    total = blocks.select(F.size(F.filter("lengths", lambda n: n > 0)).alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("l")).agg(F.sum("n"), F.sum("l")).first()
    documents, length = int(total[0] or 0), int(total[1] or 0)
    sizes = F.transform("terms", lambda t, i: F.struct(t.alias("term"), (F.get("starts", i + 1) - F.get("starts", i)).cast("long").alias("n")))
    holders = np.zeros(n_terms, np.int64)
    for row in blocks.select(F.explode(sizes).alias("s")).groupBy("s.term").agg(F.sum("s.n").alias("n")).toLocalIterator():
        holders[row["term"]] = row["n"]
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in holders]
    return Corpus(documents, length, np.array(weights, np.int64))


class _Best:
    """The best ``k`` documents of each item so far."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n)]
        self.least = np.zeros(n, np.int64)  # a score has to reach this, and be above 0

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray, ids: pa.Array) -> None:
        use = np.flatnonzero((scores > 0) & (scores >= self.least[item]))
        if not len(use):
            return
        named = ids.take(pa.array(docs[use])).to_pylist()
        rows = self.rows[item] + list(zip(scores[use].tolist(), named, strict=True))
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
        self.rows[item] = rows[: self.k]
        if len(rows) >= self.k:
            self.least[item] = self.rows[item][-1][0]


def _rank_block(items: Items, weights: np.ndarray, corpus: tuple[int, int], row: dict, best: _Best) -> None:
    """Rank one block's documents for all items."""
    documents, length = corpus
    ids, n = row["ids"], row["lengths"]
    present, starts, members, times = row["terms"], row["starts"], row["members"], row["times"].astype(np.int64)
    if not len(present):
        return
    d = len(n)
    m = 100 - 75 + (75 * n * documents) // length
    size = np.diff(starts)
    gain = weights[np.repeat(present, size)] * ((1_000_000_000 * times) // (1_000 * times + 8 * m[members]))
    greatest = np.maximum.reduceat(gain, starts[:-1])
    key = np.repeat(np.arange(len(present)), size).astype(np.int64) * d + members  # ascending
    bitmaps = np.zeros((len(present), (d + 7) // 8), np.uint8)
    np.bitwise_or.at(bitmaps.reshape(-1), np.repeat(np.arange(len(present)), size) * bitmaps.shape[1] + (members >> 3), (128 >> (members & 7)).astype(np.uint8))
    row_of = np.full(len(items.terms), -1)
    row_of[present] = np.arange(len(present))
    for i, (places, repeats) in enumerate(zip(items.places, items.repeats, strict=True)):
        rows = row_of[places]
        rows, repeat = rows[rows >= 0], repeats[rows >= 0]
        top = greatest[rows] * repeat
        if not len(rows) or top.sum() < max(1, best.least[i]):
            continue
        # Documents by the mask of the item's terms they hold.
        held = np.unpackbits(bitmaps[rows], axis=1, count=d)
        masks = np.ascontiguousarray(np.packbits(held, axis=0).T)
        masks = masks.view(np.dtype((np.void, masks.shape[1]))).reshape(-1)
        _, example, group = np.unique(masks, return_index=True, return_inverse=True)
        bound = top @ held[:, example].astype(np.int64)
        members_of = np.argsort(group, kind="stable")
        cut = np.concatenate([[0], np.cumsum(np.bincount(group))])
        order = np.argsort(-bound, kind="stable")
        for at in range(0, len(order), STEP):
            step = order[at : at + STEP]
            step = step[bound[step] >= max(1, best.least[i])]
            if not len(step):
                break
            docs = np.concatenate([members_of[cut[g] : cut[g + 1]] for g in step.tolist()])
            # Only terms of the mask are looked up.
            t, where = np.nonzero(held[:, docs])
            found = gain[np.searchsorted(key, rows[t].astype(np.int64) * d + docs[where])] * repeat[t]
            scores = np.zeros(len(docs), np.int64)
            np.add.at(scores, where, found)
            best.add(i, scores, docs, ids)


def _ranked(blocks: DataFrame, items: Items, corpus: Corpus, item_type: str, id_type: str, k: int) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast((items, corpus.weights))  # bounded by ITEM_TERMS
    documents, length = corpus.documents, corpus.length
    ids_type = to_arrow_schema(_parse_datatype_string(f"id {id_type}")).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = shared.value
        best = _Best(len(asked.ids), k)
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].values for c in b.schema.names}
                _rank_block(asked, weights, (documents, length), {c: v if c == "ids" else v.to_numpy() for c, v in row.items()}, best)
        item = np.repeat(np.arange(len(asked.ids)), [len(r) for r in best.rows])
        flat = [x for r in best.rows for x in r]
        yield pa.record_batch([pa.array(item, pa.int32()), pa.array([x[1] for x in flat], ids_type), pa.array([x[0] for x in flat], pa.int64())], names=["item", "doc_id", "score"])

    rows = blocks.mapInArrow(run, f"item int, doc_id {id_type}, score long")
    names = blocks.sparkSession.createDataFrame(list(enumerate(items.ids)), f"item int, item_id {item_type}")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    first = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # as many rows as a block has items


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    item_type, id_type = dict(items.dtypes)[item_col], dict(docs.dtypes)[id_col]
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long")
    for block in item_blocks(items, item_col, item_text_col):
        blocks = written(index(docs, block.terms, id_col, text_col), "postings")
        corpus = corpus_statistics(blocks, len(block.terms))
        if corpus.documents:
            out = out.unionByName(_ranked(blocks, block, corpus, item_type, id_type, k))
    return out
