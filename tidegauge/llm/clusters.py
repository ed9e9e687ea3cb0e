"""Clusters of near copies from candidate buckets, without emitting a bucket's pairs.

A bucket's members are first verified against its smallest member, the hub;
components of the verified links then settle most buckets.  Where a bucket still
holds members outside the hub's component that have not met all the others, these
outsiders are dealt in blocks and each block is brought together with every block
of the rest; members of the hub's component are not compared with each other.
Blocks are bounded by their members and by the bytes of their payloads.  A task
compares members of different components and returns a spanning forest of the
links it finds.  Every candidate pair is so either verified, or already inside
one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import arrow_rows, connected_components, written

#: Members of a block and bytes of their payloads, in expectation.
BLOCK = 256
BLOCK_BYTES = 4 << 20
#: Bytes of payloads that a verification step opens at once.
STEP_BYTES = 2 << 20

#: Which of the pairs of payloads pass.
Verify = Callable[[list[bytes], list[bytes]], list[bool]]
#: Links (i, j) among payloads whose components differ; with sides, only across them.
Links = Callable[[list[bytes], np.ndarray, np.ndarray | None], Iterator[tuple[int, int]]]


def verified(pairs: DataFrame, items: DataFrame, verify: Verify) -> DataFrame:
    """The pairs ``(a, b)`` whose payloads in ``items(node, payload)`` pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = max(1, STEP_BYTES * whole.num_rows // max(1, whole.nbytes))
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                ok = verify(b.column("pa").to_pylist(), b.column("pb").to_pylist())
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        pa.default_memory_pool().release_unused()

    left, right = items.select("node", "payload").toDF("a", "pa"), items.select("node", "payload").toDF("b", "pb")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "pa", "pb").mapInArrow(run, "a long, b long")


def buckets(entries: DataFrame) -> DataFrame:
    """``key, node, hub`` of the buckets in ``entries(key, node)`` that hold two nodes or more; the hub is the smallest."""
    hubs = entries.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("key", "hub")
    return written(entries.join(hubs, "key").select("key", "node", "hub").distinct(), "buckets")


def dealt_buckets(entries: DataFrame) -> DataFrame:
    """:func:`buckets` of entries that are costly to make: they are made and shuffled once.

    Entries have a third column, ``deal``, and none may be null.  Rows of ``deal`` 0
    hold the smallest and the largest node of every key; other values set apart
    members of frequent keys, which learn their hub by a second join.
    """
    e = entries.repartition("key", "deal")
    # Aggregate and join use one exchange: a filter on either side alone would be pushed below it.
    ends = e.groupBy("key", "deal").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("key", "deal", "hub")
    found = e.join(ends.hint("shuffle_hash"), ["key", "deal"], "left").where("hub is not null or deal <> 0")
    found = written(found.select("key", "deal", "node", F.when(F.col("deal") == 0, F.col("hub")).alias("hub")).distinct(), "buckets")
    plain, apart = found.where("deal = 0").select("key", "node", "hub"), found.where("deal <> 0").select("key", "node")
    if apart.isEmpty():
        return plain
    return plain.unionByName(written(apart.join(plain.select("key", "hub").distinct(), "key").select("key", "node", "hub"), "apart"))


def clusters(live: DataFrame, payloads: Callable[[DataFrame], DataFrame], verify: Verify, links: Links, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, batch_rows: int | None = None) -> DataFrame:
    """``node, component`` of every node that has a verified link.

    ``live`` is a table of ``key, node, hub``, as :func:`buckets` gives it.
    ``payloads`` gets the nodes (column ``node``) that share a bucket and returns
    ``node, payload``.  ``batch_rows`` bounds the rows with payloads that go to Python at once.
    """
    pairs = live.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    with arrow_rows(live.sparkSession, batch_rows):
        items = written(payloads(live.select("node").distinct()).select("node", "payload", F.octet_length("payload").alias("bytes")), "items")
        parts = written(connected_components(verified(pairs, items, verify)), "parts")

    of = live.join(parts, "node", "left").select("key", "node", "hub", F.coalesce("component", "node").alias("part")).join(items.select("node", "bytes"), "node")
    home = F.col("node") == F.col("hub")
    sizes = of.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max(home.cast("int")).alias("has_hub"))
    # Open: besides the part of the hub, which has met everyone, and its like, two parts remain that have not met.
    inside = F.col("has_hub") == 1
    rest = sizes.groupBy("key").agg(
        F.count("*").alias("parts"), F.max(F.when(inside, F.col("part"))).alias("hub_part"), F.max(F.when(inside, F.col("n"))).alias("hub_n"), F.max(F.when(inside, F.col("bytes"))).alias("hub_bytes"),
        F.sum(F.when(~inside, F.col("n"))).alias("n"), F.sum(F.when(~inside, F.col("bytes"))).alias("bytes"),
    ).where((F.col("parts") > 2) | ((F.col("parts") == 2) & (F.col("hub_n") > 1)))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / block), F.ceil(F.col(size) / block_bytes)).cast("int")
    # A table of its own: adaptive skew joins can then split the rows of a large bucket.
    rest = written(rest.select("key", "hub_part", blocks("hub_n", "hub_bytes").alias("ins"), blocks("n", "bytes").alias("outs")), "open")
    member = of.join(rest, "key").withColumn("out", F.col("part") != F.col("hub_part"))
    hashed = F.pmod(F.xxhash64("node"), F.when(F.col("out"), F.col("outs")).otherwise(F.col("ins"))).cast("int")
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    meet = lambda with_out, i, j: F.struct(F.lit(with_out).alias("o"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    own = F.col("own")
    # Outsiders meet outsiders in tasks (i <= j), and the hub's component in tasks (i, j) of the other kind.
    tasks = F.when(
        F.col("out"), F.concat(each("outs", lambda k: meet(True, F.least(own, k), F.greatest(own, k))), each("ins", lambda k: meet(False, own, k)))
    ).otherwise(each("outs", lambda k: meet(False, k, own)))
    dealt = member.withColumn("own", hashed).select("key", "node", "part", "out", "own", F.explode(tasks).alias("t")).join(items.select("node", "payload"), "node")
    dealt = dealt.select("key", "t.o", "t.i", "t.j", "node", "part", "payload", F.when(F.col("t.o"), F.col("own") == F.col("t.j")).otherwise(~F.col("out")).alias("side"))

    def compare(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        number = np.unique(t.column("part").to_numpy(), return_inverse=True)[1]
        alike = t.column("o")[0].as_py() and t.column("i")[0].as_py() == t.column("j")[0].as_py()
        sides = None if alike else t.column("side").to_numpy()
        found = list(links(t.column("payload").to_pylist(), number, sides)) if len(node) > 1 and number.max() else []
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": node[a], "b": node[b]}, schema=_EDGES)

    new = dealt.groupBy("key", "o", "i", "j").applyInArrow(compare, "a long, b long")
    known = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return written(connected_components(new.unionByName(known)), "parts")


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
