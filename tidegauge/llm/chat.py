"""Chat formatting in budgeted windows.

A turn is written as ``<|im_start|>role``, a line feed, its text, ``<|im_end|>`` and
a line feed.  Inside roles and texts every ``<|`` gets a backslash after its ``<``
(and ``<\\|`` one more), so no control string is left in them and the way back is
exact; line feeds and backslashes of roles are written ``\\n`` and ``\\\\``.

The prefix sums of the turns' tokens cut a conversation into windows of whole
turns: a window ends before the turn with which its tokens would pass
``budget``.  Every window but the first begins with the conversation's system
turn, if its first turn is one, and with at most ``history_turns`` and
``history_tokens`` of the turns before it.  The loss mask covers the texts of
assistant turns where they are new; repeated turns are outside it, so each target
counts once.  A turn of more than ``budget`` tokens is never cut: it is a window
with the system turn.  Markers count as one token each.

A conversation is dealt by segments of ``SEGMENT_TURNS`` turn numbers, so one of
any length is formatted by many tasks; a window never reaches over a segment's end.
A segment gets the last turns of the one before it as history and the system turn
of its conversation.  Tasks stream over sorted rows and hold a window and its
history.  Reading back needs the rows of one conversation in order: a
conversation that lies in one row is read where it is, others are sorted and
streamed.

Edge cases: a null text or role is empty; a null turn counts as turn 0 and comes
before others of it; turns of one number are ordered by role, then text; repeated
rows are turns of their own; rows with a null id are one conversation; an empty
table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidegauge.llm import text as tx
from tidegauge.llm.bpe import vocabulary
from tidegauge.llm.pretokens import Known, pretokens
from tidegauge.llm.shared import dealt_join, written

START, END = "<|im_start|>", "<|im_end|>\n"
BUDGET = 1_024
HISTORY_TURNS = 8
HISTORY_TOKENS = 256
SEGMENT_TURNS = 256
#: Characters of formatted text after which the windows of a segment go on in another row.
ROW_CHARS = 4 << 20
#: Distinct words a worker remembers before it starts anew.
REMEMBERED = 800_000
#: A turn's tokens besides those of its role and text: both markers and the last line feed.
MARKERS = 3
WINDOW = "struct<text:string,loss:array<struct<start:int,end:int>>,n_turns:int,n_repeated:int,n_tokens:long>"

_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escaped(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text) if "|" in text else text


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def header(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_of(head: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(head))


class TokenCounter:
    """Tokens of texts by a rank file; each distinct word is encoded once while it is remembered."""

    def __init__(self, ranks_path: str):
        self.encoding = vocabulary(ranks_path)[0]
        self.known = Known(np.uint32)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = []
        for c in tx.chunks(pa.array(texts, pa.string())):
            if self.known.words > REMEMBERED:
                self.known = Known(np.uint32)
            p = pretokens(c)
            h, at, inverse = np.unique(p.hash, return_index=True, return_inverse=True)
            _, size, new = self.known.find(h)
            if len(new):
                raw = c.data.tobytes()
                words = [raw[p.start[k] : p.end[k]] for k in at[new].tolist()]
                size[new] = self.known.add(h[new], [self.encoding._encode_single_piece(w) for w in words])[1]
            upto = np.concatenate([[0], np.cumsum(size[inverse])])
            out.append(np.diff(upto[np.concatenate([[0], np.cumsum(p.count)])]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class _Turn:
    formatted: str
    #: Place of the text in ``formatted``, if the role is the assistant's.
    target: tuple[int, int] | None
    tokens: int


@dataclass
class _Segment:
    """Windows of one segment, turn by turn."""

    budget: int
    history_turns: int
    history_tokens: int
    system: _Turn | None = None
    #: Turns that a new window may repeat, oldest first; the system turn is not among them.
    past: list[_Turn] = field(default_factory=list)
    repeated: list[_Turn] = field(default_factory=list)
    new: list[_Turn] = field(default_factory=list)
    upto: int = 0  # prefix sum: tokens of the window so far

    def remember(self, turn: _Turn) -> None:
        self.past.append(turn)
        total = 0
        for i in range(len(self.past) - 1, -1, -1):
            total += self.past[i].tokens
            if total > self.history_tokens or len(self.past) - i > self.history_turns:
                del self.past[: i + 1]
                break

    def add(self, turn: _Turn) -> dict | None:
        """Take a turn; the window that it closes, if any."""
        done = None
        if self.new and self.upto + turn.tokens > self.budget:
            done = self.window()
        if not self.new:
            self._begin(turn)
        self.new.append(turn)
        self.upto += turn.tokens
        return done

    def _begin(self, turn: _Turn) -> None:
        self.repeated = [self.system] if self.system else []
        self.upto = sum(t.tokens for t in self.repeated)
        room, taken = self.budget - self.upto - turn.tokens, []
        for t in reversed(self.past):
            room -= t.tokens
            if room < 0:
                break
            taken.append(t)
        self.repeated += reversed(taken)
        self.upto += sum(t.tokens for t in taken)

    def window(self) -> dict:
        parts, loss, at = [], [], 0
        for k, t in enumerate([*self.repeated, *self.new]):
            if t.target and k >= len(self.repeated):
                loss.append({"start": at + t.target[0], "end": at + t.target[1]})
            parts.append(t.formatted)
            at += len(t.formatted)
        out = {"text": "".join(parts), "loss": loss, "n_turns": len(parts), "n_repeated": len(self.repeated), "n_tokens": self.upto}
        for t in self.new:
            if t is not self.system:
                self.remember(t)
        self.new, self.repeated, self.upto = [], [], 0
        return out


#: What a row of a segment is: the mark that its conversation has several segments, with the system turn if there is one; history; a turn.
_MARK, _HISTORY, _TURN = 0, 1, 2


def _rows(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, history_turns: int) -> DataFrame:
    """``id, segment, kind, turn, role, text``: the turns, and what segments need from others."""
    number = F.coalesce(conversations[turn_col].cast("long"), F.lit(0).cast("long"))
    base = conversations.select(
        conversations[id_col].alias("id"), number.alias("turn"), conversations[turn_col].isNotNull().alias("numbered"), F.coalesce(conversations[role_col], F.lit("")).alias("role"),
        F.coalesce(conversations[text_col], F.lit("")).alias("text"),
    ).withColumn("segment", F.floor(F.col("turn") / F.lit(SEGMENT_TURNS)))
    place = lambda segment, kind: F.struct(segment.cast("long").alias("segment"), F.lit(kind).alias("kind"))
    own, next_one = place(F.col("segment"), _TURN), place(F.col("segment") + 1, _HISTORY)
    late = F.pmod("turn", F.lit(SEGMENT_TURNS)) >= SEGMENT_TURNS - min(history_turns, SEGMENT_TURNS)
    columns = ["id", "segment", "kind", "turn", "numbered", "role", "text"]
    rows = base.withColumn("place", F.explode(F.when(late, F.array(own, next_one)).otherwise(F.array(own)))).select("id", "place.*", "turn", "numbered", "role", "text")

    # Conversations of several segments: from two small columns.
    key = F.when(base["id"].isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), base["id"].cast("string"))).alias("key")
    spans = base.groupBy("id").agg(F.min("turn").alias("first"), F.min("segment").alias("low"), F.max("segment").alias("high")).where("low < high")
    if spans.isEmpty():
        return rows.select(*columns)
    spans = written(spans.select(key, "first"), "long-conversations")
    keyed = base.select(key, *base.columns)
    order = F.struct("turn", "numbered", "role", "text")
    heads = keyed.join(spans, "key").where("turn = first").groupBy("key").agg(F.min(order).alias("h"))
    heads = heads.select("key", F.when(F.col("h.role") == "system", F.col("h.text")).alias("text"))
    segments = keyed.join(spans.select("key"), "key", "left_semi").select("key", "id", "segment").distinct()
    heads = written(segments.groupBy("key").agg(F.count("*").alias("n"), F.min("segment").alias("low")).join(heads, "key"), "heads")
    marks = dealt_join(written(segments, "segments"), heads, "key", "n", "segment")
    marks = marks.select("id", "segment", F.lit(_MARK).alias("kind"), F.lit(0).cast("long").alias("turn"), F.lit(True).alias("numbered"), F.lit("system").alias("role"), F.when(F.col("segment") > F.col("low"), F.col("text")).alias("text"))
    return rows.select(*columns).unionByName(marks.select(*columns))


def formatted(
    conversations: DataFrame, ranks_path: str, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS,
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """``id, segment, part, several, windows``: a conversation in one row, or, ``several``, in rows ordered by segment and part.

    A window has its ``text``, the ``loss`` mask as ranges of code points of it, the
    numbers of its turns and of those repeated at its beginning, and its tokens.
    """
    kind = dict(conversations.dtypes)[id_col]
    rows = _rows(conversations, id_col, turn_col, role_col, text_col, history_turns)
    schema = f"id {kind}, segment long, part int, several boolean, windows array<{WINDOW}>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, state = TokenCounter(ranks_path), None

        def row(last: bool) -> pa.RecordBatch:
            windows, part = state["windows"], state["part"]
            several = state["several"] or part > 0 or not last
            state.update(windows=[], part=part + 1, chars=0)
            return pa.record_batch([pa.array([x], f.type) for x, f in zip([*state["key"], part, several, windows], arrow, strict=True)], schema=arrow)

        def put(window: dict) -> None:
            state["windows"].append(window)
            state["chars"] += len(window["text"])

        def finished() -> Iterator[pa.RecordBatch]:
            if state and state["segment"].new:
                put(state["segment"].window())
            if state and state["windows"]:
                yield row(True)

        for b in batches:
            roles, texts = b.column("role").to_pylist(), b.column("text").to_pylist()
            heads = [header(r) + "\n" for r in roles]
            bodies = [escaped(t or "") for t in texts]
            tokens = counter([h + t for h, t in zip(heads, bodies, strict=True)]).tolist()
            keys = zip(b.column("id").to_pylist(), b.column("segment").to_pylist(), strict=True)
            for key, what, role, head, body, text, n in zip(keys, b.column("kind").to_pylist(), roles, heads, bodies, texts, tokens, strict=True):
                if state is None or state["key"] != key:
                    yield from finished()
                    state = {"key": key, "part": 0, "chars": 0, "several": False, "windows": [], "segment": _Segment(budget, history_turns, history_tokens)}
                segment: _Segment = state["segment"]
                begin = len(START) + len(head)
                turn = _Turn(START + head + body + END, (begin, begin + len(body)) if role == "assistant" else None, n + MARKERS)
                if what == _MARK:
                    state["several"] = True
                    segment.system = turn if text is not None else None
                elif what == _HISTORY:
                    segment.remember(turn)
                else:
                    first = not segment.new and not state["windows"] and state["part"] == 0
                    done = segment.add(turn)
                    if first and segment.system is None and role == "system" and not segment.past:
                        segment.system = turn
                    if done:
                        # A row is given out only when another window is sure to follow.
                        if state["chars"] + len(done["text"]) > ROW_CHARS and state["windows"]:
                            yield row(False)
                        put(done)
        yield from finished()
        pa.default_memory_pool().release_unused()

    order = ["id", "segment", "kind", "turn", "numbered", "role", "text"]
    dealt = rows.repartition("id", "segment").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, schema)


def windows(table: DataFrame) -> DataFrame:
    """One row a window: ``id, segment, part, window`` and its fields."""
    return table.select("id", "segment", "part", F.posexplode("windows").alias("window", "w")).select("id", "segment", "part", "window", "w.*")


def turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted text."""
    out = []
    for turn in text.split(END)[:-1]:
        head, body = turn[len(START) :].split("\n", 1)
        out.append((role_of(head), unescaped(body)))
    return out


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = self.n_windows = self.n_repeated = 0

    def add(self, window: dict) -> None:
        text = window["text"]
        for role, body in turns(text)[window["n_repeated"] :]:
            self.turns.update(f"{role}\n{body}\n".encode())
            self.n_turns += 1
        for span in window["loss"]:
            target = unescaped(text[span["start"] : span["end"]])
            self.loss.update(target.encode())
            self.loss_chars += len(target)
        self.formatted_chars += len(text)
        self.n_windows += 1
        self.n_repeated += window["n_repeated"]

    def values(self) -> list:
        return [self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, self.n_windows, self.n_repeated]


READ_BACK = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long, n_repeated long"


def read_back(table: DataFrame) -> DataFrame:
    """``id`` and, of the whole conversation, what reading its windows gives back (``READ_BACK``)."""
    kind = dict(table.dtypes)["id"]
    schema = f"id {kind}, {READ_BACK}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def batch(rows: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, started = None, None, False

        for b in batches:
            out = []
            for i, several, row in zip(b.column("id").to_pylist(), b.column("several").to_pylist(), b.column("windows"), strict=True):
                if started and not (several and i == key):
                    out.append([key, *digest.values()])
                    started = False
                if not started:
                    key, digest, started = i, _Digest(), True
                for window in row.as_py():
                    digest.add(window)
                if not several:
                    out.append([key, *digest.values()])
                    started = False
            yield batch(out)
        if started:
            yield batch([[key, *digest.values()]])

    columns = ["id", "several", "windows"]
    alone = table.where("not several").select(*columns).mapInArrow(run, schema)
    in_order = table.where("several").repartition("id").sortWithinPartitions("id", "segment", "part").select(*columns)
    return alone.unionByName(in_order.mapInArrow(run, schema))


def round_trip(conversations: DataFrame, ranks_path: str, **options) -> DataFrame:
    """Format, write, and read back from the written table."""
    return read_back(written(formatted(conversations, ranks_path, **options), "chat"))
