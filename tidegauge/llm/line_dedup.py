"""Line dedup: an edit-distance join by segment partition.

Lines are compared without the white space at their ends.  Two lines are
linked when they are equal, or when their edit distance is at most ``EDITS``
and a tenth of the shorter one's characters.  A line that may differ by ``e``
edits is split into ``e + 1`` even segments; if two lines are within ``e`` edits, a
segment of the shorter occurs in the longer at a start that the two lengths and
the segment's number confine to a few places.  Each distinct line so enters
buckets keyed by (length, segment number, segment text): its own segments, and
the substrings it would share with lines up to ``e`` characters shorter.
Lines that meet in a bucket are verified by a banded bit-parallel distance.
A task sends an entry that it has sent before no second time, and deals members
of a key that has many of them apart, but for the lowest and the highest it has
met: of a key that stands in all chunks a bucket so gets a few rows a task.

Linked lines form groups; the occurrence of the lowest document id, and in it
the first, is kept and the others go.

Lines of fewer than ``min_chars`` characters (``MIN_CHARS``) may not differ at
all and stay out of the edit join; those of ``exact_chars`` characters or more
are still grouped when they are equal.

Edge cases: lines of fewer than ``exact_chars`` characters, and empty ones, are
neither compared nor removed; null and empty texts pass unchanged; rows of one id have one rank:
each keeps its first occurrence; rows with a null id rank last; further
columns pass through, those named like a result column are replaced.  Equal
64-bit hashes stand for equal lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import text as tx
from tidegauge.llm.clusters import clusters, dealt_buckets
from tidegauge.llm.pretokens import WHITE
from tidegauge.llm.shared import dealt_join, pass_through, restored, written

EDITS = 2
MIN_CHARS = 10
#: Lines of a task that one bucket takes without being dealt.
MANY = 16
#: Entries of the tables by which a task knows what it has sent (a power of two; 50 bytes each).
SLOTS = 1 << 17
#: Counts of characters that sift the pairs of a block.
COUNTS = 32
#: Pairs of a block that are sifted at once, and code points of those whose distance is tested at once.
STEP_PAIRS = 16_384
STEP_POINTS = 1 << 18
#: Hashes of candidate lines (8 bytes each) that may be broadcast.
BROADCAST_NODES = 1_000_000
RESULT = ("n_lines", "n_removed", "removed_lines")


class Lines:
    """The lines of a chunk in code points, trimmed."""

    def __init__(self, c: tx.Chunk):
        self.text = c.data.tobytes().decode()
        self.point = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((c.data & 0xC0) != 0x80)
        first = np.searchsorted(lead, c.offsets)  # of each text, in code points
        n = len(self.point)
        newline = np.flatnonzero(self.point == 10)
        cut = np.unique(np.concatenate([first[:-1], newline + 1]))
        # A text ends where the next begins, a line where its newline stands; empty texts have one empty line, left out.
        self.start = cut[cut < n]
        stop = np.append(self.start[1:], n)
        self.doc = np.searchsorted(first, self.start, "right") - 1
        stop = stop - (self.point[np.maximum(stop - 1, 0)] == 10)
        self.number = np.arange(len(self.start)) - np.searchsorted(self.doc, self.doc)
        white = np.zeros(n + 1, bool)
        white[:n] = np.isin(self.point, np.array(WHITE, np.uint32))
        self.lo, self.hi = self._trimmed(white, self.start, stop)

    @staticmethod
    def _trimmed(white: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        solid = np.flatnonzero(~white[:-1])
        a, b = np.searchsorted(solid, start), np.searchsorted(solid, stop)
        if not len(solid):
            return start, start
        lo = np.where(a < b, solid[np.minimum(a, len(solid) - 1)], start)
        hi = np.where(a < b, solid[np.maximum(b - 1, 0)] + 1, start)
        return lo, hi


def bucket_keys(hasher: tx.Hasher, lo: np.ndarray, length: np.ndarray, edits: int = EDITS, min_chars: int = MIN_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in ``lo``, keys) of the segments and probes of lines that begin at ``lo``.

    A shorter line of few characters may differ by fewer edits, and is split
    into fewer, longer segments.
    """
    for delta in range(edits + 1):
        for e in range(max(delta, 1), edits + 1):
            size = length - delta
            mine = np.flatnonzero((size >= min_chars) & (np.minimum(edits, size // 10) == e))
            size, start, whole = size[mine], lo[mine], length[mine]
            parts = e + 1
            for i in range(parts):
                width = np.where(i >= parts - size % parts, size // parts + 1, size // parts)
                begin = i * (size // parts) + np.maximum(0, i - (parts - size % parts))
                for shift in range(max(-i, delta - (e - i)), min(i, delta + (e - i)) + 1):
                    at = begin + shift
                    use = np.flatnonzero((at >= 0) & (at + width <= whole))
                    h = hasher(start[use] + at[use], start[use] + at[use] + width[use])
                    yield mine[use], tx.mix(h + (size[use] * (edits + 1) + i).astype(np.uint64) * tx._BASE)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, one after another, and where each begins and ends."""
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), end - size, end


def _shared(pa_: np.ndarray, a: np.ndarray, pb: np.ndarray, b: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    """How many of the ``n`` code points from ``a`` and from ``b`` on (or back, for a ``step`` of -1) agree before one differs."""
    out = n.copy()
    some = np.flatnonzero(n > 0)
    if len(some):
        size = n[some]
        first = np.cumsum(size) - size
        k = np.arange(int(size.sum())) - np.repeat(first, size)
        unlike = pa_[np.repeat(a[some], size) + step * k] != pb[np.repeat(b[some], size) + step * k]
        out[some] = np.minimum.reduceat(np.where(unlike, k, np.iinfo(np.int64).max), first)
    return np.minimum(out, n)


def within_each(a: list[str], b: list[str], edits: np.ndarray) -> np.ndarray:
    """For each pair whether its edit distance is at most its number of ``edits``."""
    (xa, sa, ea), (xb, sb, eb) = _points(a), _points([*b, "."])  # never without code points
    return _within(xa, sa, ea, xb, sb[:-1], eb[:-1], np.asarray(edits, np.int64))


def _within(xa: np.ndarray, sa: np.ndarray, ea: np.ndarray, xb: np.ndarray, sb: np.ndarray, eb: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Whether code points ``sa`` to ``ea`` of ``xa`` turn into ``sb`` to ``eb`` of ``xb`` by at most ``edits``.

    What the pair shares at its ends is set aside.  For the middle, one word for
    each number of errors holds a bit for each diagonal of the band: bit
    ``top + d`` of ``state[e]`` tells that the first i characters of ``a`` turn
    into the first i + d of ``b`` with e errors or fewer.  All pairs take a step
    together, and those that are decided leave.
    """
    top = int(edits.max(initial=0))
    ok = np.abs((ea - sa) - (eb - sb)) <= edits
    at = np.flatnonzero(ok)
    sa, ea, sb, eb, least = sa[at], ea[at], sb[at], eb[at], edits[at]
    head = _shared(xa, sa, xb, sb, np.minimum(ea - sa, eb - sb), 1)
    sa, sb = sa + head, sb + head
    tail = _shared(xa, ea - 1, xb, eb - 1, np.minimum(ea - sa, eb - sb), -1)
    na, nb = ea - tail - sa, eb - tail - sb
    full = (1 << (2 * top + 1)) - 1
    state = [np.full(len(at), 1 << top, np.int64)]
    for _ in range(top):
        state.append((state[-1] | state[-1] << 1) & full)
    i = 0
    while len(at):
        done = na == i
        if done.any():
            reached = np.choose(least[done], [s[done] for s in state]) >> (top + nb[done] - na[done]) & 1
            ok[at[done]] = reached > 0
        dead = ~done & (state[top] == 0)
        ok[at[dead]] = False
        on = ~(done | dead)
        at, sa, sb, na, nb, least = at[on], sa[on], sb[on], na[on], nb[on], least[on]
        state = [s[on] for s in state]
        if not len(at):
            break
        match = np.zeros(len(at), np.int64)
        ch = xa[sa + i]
        for d in range(-top, top + 1):
            real = (i + d >= 0) & (i + d < nb)
            match |= (real & (xb[np.where(real, sb + i + d, 0)] == ch)).astype(np.int64) << (top + d)
        new = [state[0] & match]
        for e in range(1, top + 1):
            new.append(((state[e] & match) | state[e - 1] | state[e - 1] >> 1 | new[e - 1] << 1) & full)
        state, i = new, i + 1
    return ok


def within(a: str, b: str, edits: int) -> bool:
    return bool(within_each([a], [b], np.array([edits]))[0])


def similar_each(a: list[str], b: list[str], edits: int = EDITS) -> np.ndarray:
    least = np.minimum([len(x) for x in a], [len(x) for x in b]) // 10
    return within_each(a, b, np.minimum(edits, least))


def similar(a: str, b: str, edits: int = EDITS) -> bool:
    return bool(similar_each([a], [b], edits)[0])


def _verify(a: list[bytes], b: list[bytes], edits: int) -> list[bool]:
    return similar_each([x.decode() for x in a], [y.decode() for y in b], edits).tolist()


def block_links(payloads: list[bytes], parts: np.ndarray, sides: np.ndarray | None, edits: int = EDITS) -> Iterator[tuple[int, int]]:
    """Links of a block's lines across parts (and sides), a spanning forest of them.

    An edit changes two counts of characters by one at most, so lines whose
    counts (of code points modulo ``COUNTS``) differ by more than twice the edits
    allowed are not similar; the others' distance is tested.
    """
    points, start, end = _points([p.decode() for p in payloads])
    size, n = end - start, len(payloads)
    count = np.bincount(np.repeat(np.arange(n), size) * COUNTS + points % COUNTS, minlength=n * COUNTS).reshape(n, COUNTS).astype(np.int32)
    root, every = parts.copy(), np.arange(n)
    step = max(1, STEP_PAIRS // n)
    for at in range(0, n, step):
        rows = every[at : at + step, None]
        least = np.minimum(edits, np.minimum(size[rows], size) // 10)
        open_ = (rows < every) & (root[rows] != root) & (np.abs(size[rows] - size) <= least)
        if sides is not None:
            open_ &= sides[rows] != sides
        i, j = np.nonzero(open_)
        least = least[i, j]
        i += at
        near = np.abs(count[i] - count[j]).sum(1) <= 2 * least
        i, j, least = i[near], j[near], least[near]
        turn = np.cumsum(size[i]) // STEP_POINTS
        for t in np.unique(turn):
            some = np.flatnonzero((turn == t) & (root[i] != root[j]))
            ok = some[_within(points, start[i[some]], end[i[some]], points, start[j[some]], end[j[some]], least[some])]
            for a, b in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                if root[a] != root[b]:
                    root[root == root[b]] = root[a]
                    yield a, b


def occurrences(source: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``row, id, line, node`` of every line that takes part; node is the hash of the trimmed line."""
    kind = dict(source.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tx.chunks(b.column("text")):
                x = Lines(c)
                use = np.flatnonzero(x.hi - x.lo >= min_chars)
                node = tx.Hasher(x.point)(x.lo[use], x.hi[use])
                at = pa.array(x.doc[use])
                yield pa.record_batch(
                    [b.column("row").slice(c.first, len(c)).take(at), b.column("id").slice(c.first, len(c)).take(at), pa.array(x.number[use].astype(np.int32)), pa.array(node.view(np.int64))],
                    names=["row", "id", "line", "node"],
                )

    return source.mapInArrow(run, f"row long, id {kind}, line int, node long")


class Slots:
    """A table of bounded size: one key in each slot, with further columns.

    A key that is met again gains a life and a stranger costs its slot's key one;
    a key without lives makes room.  Keys that keep coming so stay.
    """

    def __init__(self, *columns: str):
        self.column = {c: np.zeros(SLOTS, np.int64) for c in columns}
        self.lives = np.full(SLOTS, -1, np.int8)
        self._owner = np.zeros(SLOTS, np.int64)

    def meet(self, slot: np.ndarray, **key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows have their key in its slot, and the rows that take a slot now; their columns are the caller's to set."""
        known = self.lives[slot] >= 0
        for c, v in key.items():
            known &= self.column[c][slot] == v
        mine = slot[known]
        self.lives[mine] = np.minimum(self.lives[mine], 99) + 1
        other = np.flatnonzero(~known)
        at = slot[other]
        taken = self.lives[at] > 0
        self.lives[at[taken]] -= 1
        other = other[~taken]
        self._owner[slot[other]] = other
        new = other[self._owner[slot[other]] == other]
        self.lives[slot[new]] = 0
        for c, v in key.items():
            self.column[c][slot[new]] = v[new]
        return known, new


class Sent:
    """What a task has sent: pairs of key and node, and the range and number of a key's nodes.

    Both are tables of bounded size, so a key or pair may be forgotten and sent again.
    """

    def __init__(self):
        self.pairs, self.keys = Slots("key", "node"), Slots("key", "low", "high", "n")

    def fresh(self, keys: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Which pairs are not known to have been sent; all count as sent from now on."""
        h = tx.mix(keys.view(np.uint64) * tx._BASE + node.view(np.uint64))
        return ~self.pairs.meet((h & np.uint64(SLOTS - 1)).astype(np.int64), key=keys, node=node)[0]

    def ranges(self, keys: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lowest, highest and number of nodes sent before for each of these distinct keys, to which the new ones are added."""
        slot = (tx.mix(keys.view(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)
        known, new = self.keys.meet(slot, key=keys)
        c, ends = self.keys.column, np.iinfo(np.int64)
        before = np.where(known, c["low"][slot], ends.max), np.where(known, c["high"][slot], ends.min), np.where(known, c["n"][slot], 0)
        at = np.append(np.flatnonzero(known), new)
        c["low"][slot[at]], c["high"][slot[at]], c["n"][slot[at]] = np.minimum(before[0], low)[at], np.maximum(before[1], high)[at], (before[2] + n)[at]
        return before


def _deal(keys: np.ndarray, node: np.ndarray, sent: Sent | None = None) -> np.ndarray:
    """0, but other numbers for members of keys with more than ``MANY`` nodes that are not the lowest or highest so far."""
    deal = np.zeros(len(keys), np.int32)
    if not len(keys):
        return deal
    order = np.argsort(keys)
    ordered, member = keys[order], node[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    size = np.diff(np.append(first, len(keys)))
    low, high = np.minimum.reduceat(member, first), np.maximum.reduceat(member, first)
    lowest, highest, n = (sent or Sent()).ranges(ordered[first], low, high, size)
    group = np.repeat(np.arange(len(first)), size)
    some = np.flatnonzero((n + size > MANY)[group])
    group, member = group[some], member[some]
    end = (member == low[group]) & (low < lowest)[group] | (member == high[group]) & (high > highest)[group]
    deal[order[some[~end]]] = 1 + (member[~end] & 0xFFFFF)
    return deal


def _entries(source: DataFrame, edits: int, min_chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Sent()
        for b in batches:
            for c in tx.chunks(b.column("text")):
                x = Lines(c)
                hasher = tx.Hasher(x.point)
                use = np.flatnonzero(x.hi - x.lo >= min_chars)
                node, first = np.unique(hasher(x.lo[use], x.hi[use]), return_index=True)
                use, node = use[first], node.view(np.int64)
                for at, keys in bucket_keys(hasher, x.lo[use], x.hi[use] - x.lo[use], edits, min_chars):
                    keys, member = keys.view(np.int64), node[at]
                    fresh = sent.fresh(keys, member)
                    keys, member = keys[fresh], member[fresh]
                    yield pa.record_batch([pa.array(keys), pa.array(member), pa.array(_deal(keys, member, sent))], names=["key", "node", "deal"])

    return source.select("text").mapInArrow(run, "key long not null, node long not null, deal int not null")


def _payloads(source: DataFrame, min_chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tx.chunks(b.column("text")):
                x = Lines(c)
                use = np.flatnonzero(x.hi - x.lo >= min_chars)
                node, first = np.unique(tx.Hasher(x.point)(x.lo[use], x.hi[use]), return_index=True)
                use = use[first]
                rows = [x.text[a:z].encode() for a, z in zip(x.lo[use].tolist(), x.hi[use].tolist(), strict=True)]
                yield pa.record_batch([pa.array(node.view(np.int64)), pa.array(rows, pa.binary())], names=["node", "payload"])

    return source.select("text").mapInArrow(run, "node long, payload binary")


def linked_lines(source: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``node, component`` of distinct lines that are linked to others."""

    def payloads(nodes: DataFrame) -> DataFrame:
        # A short list of hashes spares the texts a shuffle; a longer one is joined by it.
        few = nodes.count() <= BROADCAST_NODES
        return _payloads(source, min_chars).join(F.broadcast(nodes) if few else nodes, "node", "left_semi").groupBy("node").agg(F.max("payload").alias("payload"))

    verify = lambda a, b: _verify(a, b, edits)
    return clusters(dealt_buckets(_entries(source, edits, min_chars)), payloads, verify, lambda p, parts, sides: block_links(p, parts, sides, edits))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """``docs`` without repeated lines, and ``n_lines, n_removed, removed_lines`` (0-based line numbers) added.

    Equal lines count from ``exact_chars`` characters on, by default from ``min_chars``; 1 takes every line that is not empty.
    """
    row = F.xxhash64(docs[id_col], docs[text_col])
    source = docs.select(row.alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    parts = linked_lines(source, edits, min_chars)
    lines = occurrences(source, min_chars if exact_chars is None else max(1, exact_chars)).join(parts, "node", "left").select("row", "id", "line", F.coalesce("component", "node").alias("g"))
    # One entry a document and group; rows that repeat a whole document count once.
    held = written(lines.groupBy("row", "id", "g").agg(F.sort_array(F.collect_set("line")).alias("lines")), "held")
    groups = held.groupBy("g").agg(F.min("id").alias("low"), F.count("*").alias("docs"), F.sum(F.size("lines")).alias("n")).where("n > 1").drop("n")
    later = F.col("id").isNull() & F.col("low").isNotNull() | (F.col("id") > F.col("low"))
    gone = dealt_join(held, written(groups, "groups"), "g", "docs", "row")
    gone = gone.select("row", F.when(later, F.col("lines")).otherwise(F.slice("lines", 2, F.size("lines"))).alias("lines"))
    gone = gone.where(F.size("lines") > 0).groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("lines"))).alias("gone"))
    wide = docs.select(*pass_through(docs, RESULT), row.alias("row")).join(gone, "row", "left")
    text = F.col("doc").getField(text_col)
    split = F.split(text, "\n")
    cut = F.array_join(F.filter(split, lambda _, i: ~F.array_contains("gone", i)), "\n")
    return wide.select(
        *[F.when(F.col("gone").isNull(), text).otherwise(cut).alias(n) if n == text_col else c for n, c in zip([c for c in docs.columns if c not in RESULT], restored(docs, RESULT), strict=True)],
        F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.coalesce("gone", F.array().cast("array<int>")).alias("removed_lines"),
    )
