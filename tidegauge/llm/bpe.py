"""Byte-level BPE by a global shuffle of distinct words.

Encoding: texts are cut into pre-tokens; every chunk of texts keeps the
sequence of its words as positions in the chunk's word list and sends each
distinct word once, packed by hash bucket, to the bucket's group.  There each
distinct word of the corpus is encoded once.  The ids go back to the chunks by
a join on the chunk, where they are put in the place of the words.  Decoding
replaces ids by the bytes of the (fixed-size) token table.

A bucket holds a fixed share of the distinct words of every chunk, never
occurrences, so a frequent word costs one entry a chunk; a chunk is bounded by
its bytes of text.  A bucket's group streams through its task, which remembers
its distinct words: ``BUCKETS`` is so large that they fit in memory for tens of
billions of distinct words, and the entries a chunk sends stay in proportion to
its words.  Decoding is a map-side join: the token table's size is fixed.

Edge cases: a null or empty text has no ids; a repeated row is repeated in the
result; null ids of documents are kept; other columns are not carried.  Words
are told apart by 64-bit hashes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegauge.llm import text as tx
from tidegauge.llm.pretokens import Known, pack, pretokens, spans, unpack

CHUNK_BYTES = 4 << 20
#: Shares of the words, at least.
BUCKETS = 1_024


@cache
def vocabulary(path: str):
    """The rank file as a tiktoken encoding and as a table of token bytes."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    token = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        token[i] = t
    return encoding, np.frombuffer(b"".join(token), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in token])])


class _Chunks:
    """Texts gathered over Arrow batches into chunks of bounded bytes."""

    def __init__(self, limit: int = CHUNK_BYTES):
        self.limit = limit

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, tx.Chunk]]:
        ids, parts, sizes, held = [], [], [], 0
        for b in batches:
            for c in tx.chunks(b.column("text"), self.limit):
                if held and held + len(c.data) > self.limit:
                    yield self._join(ids, parts, sizes)
                    ids, parts, sizes, held = [], [], [], 0
                ids.append(b.column("id").slice(c.first, len(c)))
                parts.append(c.data)
                sizes.append(np.diff(c.offsets))
                held += len(c.data) + len(c)
        if ids:
            yield self._join(ids, parts, sizes)

    @staticmethod
    def _join(ids, parts, sizes):
        size = np.concatenate(sizes)
        return pa.concat_arrays(ids), tx.Chunk(0, np.concatenate(parts), np.concatenate([[0], np.cumsum(size)]))


def _listed(ids: pa.Array, c: tx.Chunk, buckets: int):
    """Key of a chunk; its distinct words by falling frequency: first places, buckets; the sequence of their ranks."""
    p = pretokens(c)
    _, at, inverse, count = np.unique(p.hash, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    at = at[order]
    digest = hashlib.blake2b(c.data.tobytes(), digest_size=8)
    digest.update(c.offsets.tobytes())
    key = int.from_bytes(digest.digest(), "little", signed=True)
    return key, p, at, (p.hash[at] % np.uint64(buckets)).astype(np.uint32), rank[inverse] if len(inverse) else rank


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """``id, n_tokens, ids`` (little-endian unsigned 32-bit integers) of every row of ``docs``."""
    return _assembled(docs, ranks_path, id_col, text_col, buckets, lambda e: [("n_tokens", pa.array(e.count)), ("ids", pa.array(e.id_bytes(), pa.binary()))], "n_tokens long, ids binary")


def round_trip_digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256``: encode, decode, and hash both where they are made."""
    sha = lambda rows: pa.array([hashlib.sha256(r).hexdigest() for r in rows], pa.string())
    return _assembled(
        docs, ranks_path, id_col, text_col, buckets,
        lambda e: [("n_tokens", pa.array(e.count)), ("ids_sha256", sha(e.id_bytes())), ("decoded_sha256", sha(e.decoded()))],
        "n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "id") -> DataFrame:
    """``id, decoded`` (binary) of ids as :func:`encode` gives them, by the token-byte table."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids = b.column("ids").to_pylist()
            sizes = np.array([len(x or b"") // 4 for x in ids], np.int64)
            e = Encoded(np.frombuffer(b"".join(x or b"" for x in ids), "<u4"), sizes, ranks_path)
            yield pa.record_batch([b.column("id"), pa.array(e.decoded(), pa.binary())], names=["id", "decoded"])

    return encoded.select(encoded[id_col].alias("id"), "ids").mapInArrow(run, f"id {kind}, decoded binary")


class Encoded:
    """Ids of several texts, one after another."""

    def __init__(self, ids: np.ndarray, count: np.ndarray, ranks_path: str):
        self.ids, self.count, self.path = ids, count, ranks_path
        self.cut = np.concatenate([[0], np.cumsum(count)])

    def id_bytes(self) -> list[bytes]:
        raw = self.ids.astype("<u4")
        return [raw[a:b].tobytes() for a, b in zip(self.cut[:-1], self.cut[1:], strict=True)]

    def decoded(self) -> list[bytes]:
        _, data, off = vocabulary(self.path)
        out = spans(data, off[self.ids], off[self.ids + 1]).tobytes()
        at = np.concatenate([[0], np.cumsum((off[1:] - off[:-1])[self.ids])])[self.cut]
        return [out[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _assembled(docs, ranks_path, id_col, text_col, buckets, results, columns) -> DataFrame:
    spark = docs.sparkSession
    buckets = buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    id_field = source.schema["id"]

    def word_lists(batches):
        for ids, c in _Chunks()(batches):
            key, p, at, bucket, _ = _listed(ids, c, buckets)
            order = np.argsort(bucket, kind="stable")  # by bucket, then rank
            at, bucket = at[order], bucket[order]
            start, end = p.start[at], p.end[at]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(cut))
            blobs = [pack((end[a:b] - start[a:b]).astype(np.uint32), spans(c.data, start[a:b], end[a:b])) for a, b in zip(cut[used], cut[used + 1], strict=True)]
            yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), key)), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "words"])
        pa.default_memory_pool().release_unused()

    def encode_bucket(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _, _ = vocabulary(ranks_path)
        known = Known(np.uint16 if encoding.n_vocab <= 1 << 16 else np.uint32)
        for b in rows:
            out = []
            for blob in b.column("words").to_pylist():
                size, data = unpack(blob)
                end = np.cumsum(size, dtype=np.int64)
                h = tx.Hasher(data)(end - size, end)
                start, count, new = known.find(h)
                if len(new):
                    raw = data.tobytes()
                    start[new], count[new] = known.add(h[new], [encoding._encode_single_piece(raw[end[k] - size[k] : end[k]]) for k in new.tolist()])
                out.append(pack(count.astype(np.uint32), spans(known.pool, start, start + count)))
            yield pa.record_batch([b.column("chunk"), b.column("bucket"), pa.array(out, pa.binary())], names=["chunk", "bucket", "ids"])

    def sequences(batches):
        for ids, c in _Chunks()(batches):
            key, p, _, bucket, seq = _listed(ids, c, buckets)
            docs_of = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.record_batch([pa.array([key]), docs_of, pa.array([pack(p.count.astype(np.uint32), bucket, seq)], pa.binary())], names=["chunk", "docs", "sequence"])
        pa.default_memory_pool().release_unused()

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = dict(zip(right.column("bucket").to_pylist(), right.column("ids").to_pylist(), strict=True))
        unpacked = [unpack(lists[k]) for k in sorted(lists)]
        size = np.concatenate([u[0] for u in unpacked]).astype(np.int64) if unpacked else np.zeros(0, np.int64)
        pool = np.concatenate([u[1] for u in unpacked]) if unpacked else np.zeros(0, np.uint32)
        off = np.concatenate([[0], np.cumsum(size)])
        tables = []
        for ids, blob in zip(left.column("docs"), left.column("sequence").to_pylist(), strict=True):
            count, bucket, seq = unpack(blob)
            if len(bucket) != len(size):
                raise RuntimeError("a chunk's words changed between two reads of the input; write the input to a table first")
            place = np.empty(len(bucket), np.int64)
            place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
            at = place[seq]
            all_ids = spans(pool, off[at], off[at + 1])
            each = np.concatenate([[0], np.cumsum(size[at])])[np.concatenate([[0], np.cumsum(count, dtype=np.int64)])]
            e = Encoded(all_ids, np.diff(each), ranks_path)
            tables.append(pa.table([ids.values, *(a for _, a in results(e))], names=["id", *names]))
        return pa.concat_tables(tables) if tables else empty

    schema = T.StructType([T.StructField("id", id_field.dataType), *T._parse_datatype_string(columns).fields])
    names = schema.names[1:]
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema).empty_table()
    kind = id_field.dataType.simpleString()
    words = source.mapInArrow(word_lists, "bucket int, chunk long, words binary")
    encoded = words.groupBy("bucket").applyInArrow(encode_bucket, "chunk long, bucket int, ids binary")
    seq = source.mapInArrow(sequences, f"chunk long, docs array<{kind}>, sequence binary")
    return seq.groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(reassemble, schema)
