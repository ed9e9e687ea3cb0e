"""Token-id files: ORC with integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are ranged by id before they are encoded, so files hold disjoint id
ranges in ascending order; each row keeps its file number and the ids of its
file before it, and one small aggregate over files turns that into global
starts.  Readers get stripe-parallel scans, and a lookup by id skips stripes by
the row index and the Bloom filter.

Edge cases: null and empty texts give the end id alone; equal document ids are
ordered by a hash of the text; null document ids come first; a repeated row is
written again; further columns are not carried; an empty table gives an empty,
readable folder.  The string of an added token in a text becomes that token, as
the library has it; with ``added_as_text`` it is ordinary text.  A worker knows
words again by a 64-bit hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm import text as tx
from tidegauge.llm.pretokens import Known, pretokens, spans

#: Distinct words a Python worker remembers before it starts anew.
REMEMBERED = 800_000
#: Bytes of text encoded at once.
CHUNK_BYTES = 3 << 20
ROW_INDEX_STRIDE = 10_000
STRIPE_BYTES = 64 << 20


def _byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte: itself if it shows, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}


class WordEncoder:
    """Ids of pre-tokens by the tokenizers library; each distinct word is encoded once while it is remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.alphabet = self.tokenizer.model, _byte_alphabet()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self):
        self.known = Known(np.uint32)

    def __call__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the pool (start, size) of distinct words, given by hashes and spans."""
        if self.known.words > REMEMBERED:
            self._forget()
        start, size, new = self.known.find(h)
        if len(new):
            raw = data.tobytes()
            words = (raw[begin[k] : end[k]].decode("latin-1").translate(self.alphabet) for k in new.tolist())
            start[new], size[new] = self.known.add(h[new], [[t.id for t in self.model.tokenize(w)] for w in words])
        return start, size

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text by the library from end to end."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _holding(c: tx.Chunk, added: list[bytes]) -> np.ndarray:
    """Texts of a chunk that hold one of the strings."""
    raw, found = c.data.tobytes(), set()
    for token in added:
        at = raw.find(token)
        while at >= 0:
            text = int(np.searchsorted(c.offsets, at, "right")) - 1
            if at + len(token) <= c.offsets[text + 1]:
                found.add(text)
            at = raw.find(token, at + 1)
    return np.array(sorted(found), np.int64)


def encode_chunk(c: tx.Chunk, encoder: WordEncoder, end_id: int, added_as_text: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a chunk, each text closed by ``end_id``, and the number of each text."""
    p = pretokens(c)
    h, at, inverse = np.unique(p.hash, return_index=True, return_inverse=True)
    start, size = encoder(c.data, p.start[at], p.end[at], h)
    ids = spans(encoder.known.pool, start[inverse], start[inverse] + size[inverse])
    each = np.concatenate([[0], np.cumsum(size[inverse])])[np.concatenate([[0], np.cumsum(p.count)])]
    ids, count = np.insert(ids, each[1:], np.uint32(end_id)), np.diff(each) + 1
    special = _holding(c, encoder.added) if not added_as_text else []
    if len(special):
        cut = np.concatenate([[0], np.cumsum(count)])
        parts = [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for k in special.tolist():
            text = c.data[c.offsets[k] : c.offsets[k + 1]].tobytes().decode()
            parts[k] = np.append(encoder.whole(text), np.uint32(end_id))
            count[k] = len(parts[k])
        ids = np.concatenate(parts)
    return ids, count


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", added_as_text: bool = False) -> None:
    """Encode ``docs`` into the folder ``path`` in ascending order of ``id_col``."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _encoder(tokenizer_path), 0
        file = TaskContext.get().partitionId()
        for b in batches:
            for c in tx.chunks(b.column("text"), CHUNK_BYTES):
                ids, count = encode_chunk(c, encoder, end_id, added_as_text)
                cut = np.concatenate([[0], np.cumsum(count)])
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.record_batch(
                    [b.column("id").slice(c.first, len(c)), pa.array(np.full(len(c), file, np.int32)), pa.array(before + cut[:-1]), pa.array(count), lists],
                    names=["doc_id", "file", "before", "n_tokens", "ids"],
                )
                before += int(cut[-1])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    tie = F.xxhash64("text")
    (
        rows.repartitionByRange(F.col("id").asc_nulls_first(), tie)
        .sortWithinPartitions(F.col("id").asc_nulls_first(), tie)
        .mapInArrow(run, f"doc_id {kind}, file int, before long, n_tokens long, ids array<int>")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", ROW_INDEX_STRIDE)
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("compression", "zstd")
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: the ids and how many ids stand before them in all files."""
    rows = spark.read.orc(path)
    # One row a file, and no more files than shuffle partitions: fit to be broadcast.
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    offset = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("offset"))
    return rows.join(F.broadcast(offset), "file").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids")


def find(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """The rows of a few ids: the filter reaches the files, whose row indexes and Bloom filters rule out most of them."""
    return spark.read.orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the ids as little-endian unsigned 32-bit integers."""
    kind = dict(tokens.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            off = ids.offsets.to_numpy()
            raw = ids.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(raw[a:z]) for a, z in zip(off[:-1], off[1:], strict=True)]
            yield pa.record_batch([b.column("doc_id"), b.column("start"), pa.array((off[1:] - off[:-1]).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
