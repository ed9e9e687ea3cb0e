"""Cross-tokenizer alignment: each distinct text once, pair counts weighted by how many documents carry it.

A byte-level BPE (A) and a sentence-piece BPE (B) cut one text, a space in
front, into tokens.  Byte offsets where tokens of both end cut the text into
groups; every A token of a group is linked with every B token of it.

Documents are shuffled by their whole text, and copies become one row with a
multiplicity.  Texts are gathered into chunks of bounded bytes, tokenised and
aligned with array operations; a chunk keeps its measures and, for each text,
which of the chunk's distinct pairs it holds.  Only the distinct pairs of a chunk
travel: they are added up over the corpus, weighted by the copies, and the totals
go back to the chunks by a join on the pair.  Measures then join the documents by
a digest of the text; a text with very many copies is dealt over several tasks.

Memory: a task holds one chunk, whose links are made group by group once a group
has more than ``DENSE`` of them.  The table of best counts has one row per A id,
so the vocabulary bounds what is broadcast.

Edge cases: a null or empty text, and one whose joined token bytes of either
tokenizer differ from space and text, have no tokens: all measures are 0, the
digest of groups is ''.  Strings of special tokens are plain text.  Repeated rows
are repeated in the result and each counts as a document; null ids are kept; other
columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidegauge.llm import text as tx
from tidegauge.llm.pretokens import pack, spans, unpack
from tidegauge.llm.shared import dealt_join, written
from tidegauge.llm.token_files import WordEncoder, _byte_alphabet, encode_chunk

#: Bytes of text aligned at once; a longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Links of a group that are listed one by one; a larger group is counted by its distinct ids.
DENSE = 4_096
_B_BITS = 32
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class TokenBytes:
    """The bytes of each token, one after another, by id."""

    def __init__(self, tokens: list[bytes]):
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.size = np.diff(self.offset)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return spans(self.data, self.offset[ids], self.offset[ids + 1])


class ByteTokenizer:
    """A: byte-level BPE of the tokenizers library; entries are decoded byte by byte."""

    def __init__(self, path: str):
        self.encoder = WordEncoder(path)
        byte_of = {c: b for b, c in _byte_alphabet().items()}
        vocabulary = self.encoder.tokenizer.get_vocab(with_added_tokens=False)
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.bytes = TokenBytes(tokens)

    def __call__(self, c: tx.Chunk, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, count = encode_chunk(c, self.encoder, 0, added_as_text=True)
        keep = np.ones(len(ids), bool)
        keep[np.cumsum(count) - 1] = False  # the end id of each text
        return ids[keep].astype(np.int64), count - 1


class PieceTokenizer:
    """B: sentence pieces, which put the space in front themselves."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        tokens = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            tokens.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes = TokenBytes(tokens)

    def __call__(self, c: tx.Chunk, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self.model.encode(texts, num_threads=1)
        count = np.array([len(x) for x in lists], np.int64)
        return np.fromiter((i for x in lists for i in x), np.int64, int(count.sum())), count


@cache
def _tokenizers(a_path: str, b_path: str):
    a, b = ByteTokenizer(a_path), PieceTokenizer(b_path)
    top = max(len(a.bytes.size), len(b.bytes.size))
    decimal = np.empty(3 * top, object)
    for k, sep in enumerate((b",", b"|", b";")):
        decimal[k::3] = [b"%d" % i + sep for i in range(top)]
    return a, b, decimal


def _matches(tokens: TokenBytes, ids: np.ndarray, count: np.ndarray, c: tx.Chunk) -> np.ndarray:
    """Which texts of a chunk their tokens' bytes give back."""
    cut = np.concatenate([[0], np.cumsum(count)])
    at = np.concatenate([[0], np.cumsum(tokens.size[ids])])[cut]
    same = np.diff(at) == np.diff(c.offsets)
    joined = tokens.joined(ids)
    if same.all():
        same[np.searchsorted(c.offsets, np.flatnonzero(joined != c.data), "right") - 1] = False
        return same
    for k in np.flatnonzero(same).tolist():
        same[k] = np.array_equal(joined[at[k] : at[k + 1]], c.data[c.offsets[k] : c.offsets[k + 1]])
    return same


class Aligned:
    """Tokens and groups of the texts of a chunk."""

    def __init__(self, texts: list[str], c: tx.Chunk, a_path: str, b_path: str):
        a, b, self.decimal = _tokenizers(a_path, b_path)
        c = tx.Chunk(0, np.insert(c.data, c.offsets[:-1], np.uint8(32)), c.offsets + np.arange(len(c) + 1))
        (self.a, na), (self.b, nb) = a(c, texts), b(c, texts)
        good = _matches(a.bytes, self.a, na, c) & _matches(b.bytes, self.b, nb, c) & (np.diff(c.offsets) > 1)
        if not good.all():
            self.a, self.b = self.a[np.repeat(good, na)], self.b[np.repeat(good, nb)]
            na, nb = np.where(good, na, 0), np.where(good, nb, 0)
        self.n_a, self.n_b = na, nb
        ends = np.cumsum(np.where(good, np.diff(c.offsets), 0))
        total = int(ends[-1]) if len(ends) else 0
        end_a, end_b = np.cumsum(a.bytes.size[self.a]), np.cumsum(b.bytes.size[self.b])
        both = np.zeros(total + 1, bool)
        both[end_a] = True
        of_b = np.zeros(total + 1, bool)
        of_b[end_b] = True
        both &= of_b
        before = np.cumsum(both) - both
        #: Group of each token, and tokens of each group.
        self.group_a, self.group_b = before[end_a], before[end_b]
        cuts = np.flatnonzero(both)
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=len(cuts)), np.bincount(self.group_b, minlength=len(cuts))
        self.first_a, self.first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (self.size_a, self.size_b))
        # A text without tokens shares its end with the one before it, which comes first.
        self.text = np.searchsorted(ends, cuts, "left")
        self.n_groups = np.bincount(self.text, minlength=len(c))
        self.n_links = np.zeros(len(c), np.int64)
        np.add.at(self.n_links, self.text, self.size_a * self.size_b)

    def written_groups(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        pieces = np.empty(len(self.a) + len(self.b), object)
        last_a = np.append(self.group_a[1:] != self.group_a[:-1], True) if len(self.a) else np.zeros(0, bool)
        last_b = np.append(self.group_b[1:] != self.group_b[:-1], True) if len(self.b) else np.zeros(0, bool)
        pieces[np.arange(len(self.a)) + self.first_b[self.group_a]] = self.decimal[self.a * 3 + last_a]
        pieces[np.arange(len(self.b)) + self.first_a[self.group_b + 1]] = self.decimal[self.b * 3 + 2 * last_b]
        cut = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        return [b"".join(pieces[lo:hi].tolist())[:-1] for lo, hi in zip(cut[:-1], cut[1:], strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, pair and number of occurrences; a text may hold a pair several times."""
        many = self.size_a * self.size_b > DENSE
        use = ~many[self.group_a]
        g = self.group_a[use]
        n = self.size_b[g]
        at = np.repeat(self.first_b[g] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        text, a, b = [np.repeat(self.text[g], n)], [np.repeat(self.a[use], n)], [self.b[at]]
        times = [np.ones(len(at), np.int64)]
        for g in np.flatnonzero(many).tolist():
            ia, ca = np.unique(self.a[self.first_a[g] : self.first_a[g + 1]], return_counts=True)
            ib, cb = np.unique(self.b[self.first_b[g] : self.first_b[g + 1]], return_counts=True)
            a.append(np.repeat(ia, len(ib)))
            b.append(np.tile(ib, len(ia)))
            times.append(np.outer(ca, cb).reshape(-1))
            text.append(np.full(len(ia) * len(ib), self.text[g]))
        return np.concatenate(text), (np.concatenate(a) << _B_BITS) | np.concatenate(b), np.concatenate(times)


def _pair_lists(al: Aligned, copies: np.ndarray):
    """Distinct pairs of a chunk, in how many documents each stands, and each text's entries: how many, ranks of pairs, occurrences."""
    text, pair, times = al.links()
    pairs, rank = np.unique(pair, return_inverse=True)
    width = max(1, len(pairs))
    entry, of = np.unique(text * width + rank, return_inverse=True)
    occurrences = np.bincount(of, weights=times, minlength=len(entry)).astype(np.int64)
    text, rank = entry // width, entry % width
    documents = np.bincount(rank, weights=copies[text], minlength=len(pairs)).astype(np.int64)
    wide = np.uint32 if not len(occurrences) or occurrences.max() < 1 << 32 else np.uint64
    return pairs, documents, pack(np.bincount(text, minlength=len(copies)).astype(np.uint32), rank.astype(np.uint32), occurrences.astype(wide))


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``key, text, copies`` of each text that is not empty; copies are added up before and after a shuffle by the whole text."""
    texts = docs.select(docs[text_col].alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    return texts.select(_key("text"), "text", "copies")


def _key(text: str):
    return F.unhex(F.sha2(text, 256)).alias("key")


def _chunks_of(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, tx.Chunk]]:
    for c in tx.chunks(b.column("text"), CHUNK_BYTES):
        yield b.slice(c.first, len(c)), tx.Chunk(0, c.data, c.offsets)


def aligned_groups(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``key, copies, a_ids, b_ids, a_stop, b_stop``: the tokens of each text and where each group's tokens stop in the two lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda cut, values: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values.astype(np.int32)))
        for batch in batches:
            for b, c in _chunks_of(batch):
                al = Aligned(b.column("text").to_pylist(), c, a_path, b_path)
                cut_a, cut_b, cut_g = (np.concatenate([[0], np.cumsum(n)]) for n in (al.n_a, al.n_b, al.n_groups))
                stop_a, stop_b = al.first_a[1:] - cut_a[al.text], al.first_b[1:] - cut_b[al.text]
                yield pa.record_batch(
                    [b.column("key"), b.column("copies"), lists(cut_a, al.a), lists(cut_b, al.b), lists(cut_g, stop_a), lists(cut_g, stop_b)],
                    names=["key", "copies", "a_ids", "b_ids", "a_stop", "b_stop"],
                )

    return texts.mapInArrow(run, "key binary, copies long, a_ids array<int>, b_ids array<int>, a_stop array<int>, b_stop array<int>")


def aligned_chunks(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row a chunk of texts: their keys, copies and measures, the chunk's distinct pairs with counts of documents, and the texts' entries."""
    schema = "chunk long, keys array<binary>, copies array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, pairs array<long>, documents array<long>, entries binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda x: pa.array([x])
        for batch in batches:
            for b, c in _chunks_of(batch):
                al = Aligned(b.column("text").to_pylist(), c, a_path, b_path)
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in al.written_groups()]
                pairs, documents, entries = _pair_lists(al, b.column("copies").to_numpy())
                keys = b.column("key").to_pylist()
                chunk = int.from_bytes(hashlib.blake2b(b"".join(keys), digest_size=8).digest(), "little", signed=True)
                yield pa.record_batch(
                    [one(chunk), pa.array([keys], pa.list_(pa.binary())), one(b.column("copies").to_numpy()), *(one(x.astype(np.int64)) for x in (al.n_a, al.n_b, al.n_groups, al.n_links)),
                     pa.array([digests], pa.list_(pa.string())), one(pairs), one(documents), pa.array([entries], pa.binary())],
                    names=["chunk", "keys", "copies", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "documents", "entries"],
                )
        pa.default_memory_pool().release_unused()

    return texts.mapInArrow(run, schema)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``pair, count, best``: how many documents hold a pair linked, and whether no pair of its A id has more."""
    counts = written(chunks.select(F.explode(F.arrays_zip("pairs", "documents")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.documents").alias("count")), "pairs")
    a_id = F.shiftright("pair", _B_BITS)
    # One row per A id that occurs: bounded by its vocabulary.
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(highest), a_id == F.col("a")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def text_measures(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """``key, copies, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each distinct text."""
    schema = _parse_datatype_string("key binary, copies long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    arrow = to_arrow_schema(schema)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        rank = right.column("rank").to_numpy()
        count, best = np.zeros(len(rank), np.int64), np.zeros(len(rank), bool)
        count[rank], best[rank] = right.column("count").to_numpy(), right.column("best").to_numpy()
        tables = []
        for row in range(left.num_rows):
            of = {c: left.column(c)[row] for c in left.column_names}
            n, ranks, times = unpack(of["entries"].as_py())
            times = times.astype(np.int64)
            cut = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            upto = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[cut])  # noqa: E731, B023
            n_best, total = upto(np.where(best[ranks], times, 0)), upto(count[ranks] * times)
            values = [of[c].values for c in ("keys", "copies", "n_a", "n_b", "n_groups", "n_links")]
            tables.append(pa.table([*values, pa.array(n_best), pa.array(total), of["groups"].values], names=schema.names).cast(arrow))
        return pa.concat_tables(tables) if tables else arrow.empty_table()

    pairs = chunks.select(F.col("chunk").alias("of"), F.posexplode("pairs").alias("rank", "pair"))
    back = pairs.join(counts, "pair").select("of", "rank", "count", "best")
    kept = chunks.select("chunk", "keys", "copies", "n_a", "n_b", "n_groups", "n_links", "groups", "entries")
    return kept.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(finish, schema)


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``."""
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    chunks = written(aligned_chunks(distinct_texts(source), a_path, b_path), "aligned")
    measures = written(text_measures(chunks, pair_counts(chunks)), "measures")
    found = dealt_join(source.where("text <> ''").select("id", _key("text")), measures, "key", "copies", "id").select("id", *MEASURES, "groups_sha256")
    blank = source.where("text is null or text = ''").select("id", *[F.lit(0).cast("long").alias(m) for m in MEASURES], F.lit("").alias("groups_sha256"))
    return found.unionByName(blank)
