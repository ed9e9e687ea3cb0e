"""Embedding near-dedup: inverted lists, residual codes, sufficient probes, exact rerank.

Vectors are scaled to unit length, and equal vectors are one class with a
weight.  Coarse centroids and the codebooks of product-quantised residuals are
fitted on a documented bounded sample of each length of vector; every vector is
indexed: it has a list, the code of its residual in subspaces of ``SUBSPACE``
components, and the length of what the code leaves out.

Probes are sufficient: for unit vectors a cosine of ``c`` is a distance of
``reach = sqrt(2 - 2c)``, and a neighbour in another list puts that list's
boundary within this distance.  Lists that lie side by side form groups of about
``BLOCK`` vectors; a vector is sent to each group it probes as its code.  There
its reconstruction, made by looking its code up in the codebooks, is compared
with the group's vectors (an asymmetric distance): by the triangle inequality
two vectors can only be linked when this distance is at most ``reach`` and the
query's rest together.  Vectors that keep a partner so meet again in full, and
are reranked: products in single precision, with a bound of their error, settle
most pairs, the others are settled by the cosine in double precision.  No link
is lost to an approximation.

Groups are dealt in blocks of bounded numbers of vectors and queries; a block
returns the number of links of each vector and a spanning forest of its links,
never the links themselves.

Edge cases: vectors that are null, zero, or hold null or non-finite components
link with nothing, and so do vectors of unlike lengths; magnitudes do not matter,
however small or large; repeated rows of one id are one vector (the first by its
components); null ids are ignored; ids must be integers, others are refused; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import connected_components, written

#: Vectors of one length that fit its centroids and codebooks, at most.
TRAIN_ROWS = 16_384
#: Vectors of one block, at most (in expectation), and queries of one block, which come as codes.
BLOCK = 4_096
QUERY_BLOCK = 16 * BLOCK
#: Components of a subspace and codewords of its codebook.
SUBSPACE, CODEWORDS = 4, 256
#: Training vectors for each list, at least.
PER_LIST = 8
INTEGERS = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Index:
    centroid: np.ndarray  # lists x dim
    first: np.ndarray  # list that each group begins with
    codebook: np.ndarray  # subspaces x codewords x SUBSPACE

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the centroids, and the nearest one."""
        c = self.centroid
        d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
        return d, d.argmin(1)

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the lengths of what they leave out."""
        r = _subspaces(x - self.centroid[own])
        code = np.stack([_nearest(r[:, m], self.codebook[m]) for m in range(r.shape[1])], 1).astype(np.uint8)
        rest = r - self.codebook[np.arange(r.shape[1]), code]
        return code, np.sqrt((rest * rest).sum((1, 2)))

    def decode(self, code: np.ndarray, own: np.ndarray) -> np.ndarray:
        parts = self.codebook[np.arange(code.shape[1]), code].reshape(len(code), -1)
        return self.centroid[own] + parts[:, : self.centroid.shape[1]]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _subspaces(x: np.ndarray) -> np.ndarray:
    width = -x.shape[1] % SUBSPACE
    return np.pad(x, ((0, 0), (0, width))).reshape(len(x), -1, SUBSPACE)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (-2 * x @ c.T + (c * c).sum(1)).argmin(1)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], minlength=k) for j in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def train(sample: np.ndarray, rows: int, block: int = BLOCK, seed: int = 5) -> Index:
    """About ``sqrt(rows)`` lists, ordered along their main axis, groups of lists of about ``block`` rows, and codebooks."""
    rng = np.random.default_rng(seed)
    x = unit(sample)
    k = int(max(1, min(len(x) // PER_LIST, math.isqrt(rows))))
    c = _kmeans(x, k, 8, rng)
    c = c[np.argsort(c @ np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0], kind="stable")]
    near = _nearest(x, c)
    held = np.bincount(near, minlength=k) * (rows / len(x))
    group = ((np.cumsum(held) - held / 2) // block).astype(int)
    r = _subspaces(x - c[near])
    codebook = np.stack([_kmeans(r[:, m], min(CODEWORDS, len(r)), 6, rng) for m in range(r.shape[1])])
    return Index(c, np.unique(group, return_index=True)[1], codebook)


def probes(x: np.ndarray, index: Index, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own list and group of each vector, and (vectors x groups) which later groups can hold a neighbour."""
    c = index.centroid
    d, own = index.nearest(x)
    between = np.sqrt(np.maximum((c[own] * c[own]).sum(1)[:, None] - 2 * c[own] @ c.T + (c * c).sum(1), 0))
    near = d - d[np.arange(len(x)), own][:, None] <= 2 * reach * between + 1e-9
    group = np.searchsorted(index.first, own, "right") - 1
    near = np.logical_or.reduceat(near, index.first, axis=1)
    return own, group, near & (np.arange(len(index.first)) > group[:, None])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def linkable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` of the vectors that can link: complete, finite, not zero; single precision stays as it is."""
    kind = dict(vectors.dtypes)[id_col]
    if kind not in INTEGERS:
        raise ValueError(f"ids of vectors must be integers, not {kind}")
    v = F.col(vector_col).cast("array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>")
    complete = ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & complete).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(v).alias("v"))


def _indexes(classes: DataFrame, train_rows: int, block: int) -> dict[int, Index]:
    """An index of each length of vector; the driver sees the lengths and a bounded sample of each that fills a block."""
    found = {}
    for r in classes.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect():
        dim, rows = r["dim"], r["count"]
        if rows <= block:  # one list that every one of its vectors is in
            none = np.zeros((-(-dim // SUBSPACE), 1, SUBSPACE))
            found[dim] = Index(np.zeros((1, dim)), np.zeros(1, np.int64), none)
        else:
            sample = classes.where(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(train_rows).select("v").toArrow().column("v")
            found[dim] = train(_matrix(sample), rows, block)
    return found


def links(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", train_rows: int = TRAIN_ROWS, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(id, node)`` membership of the classes of equal vectors, ``(node, n_links)``, and forest edges ``(a, b)`` of all pairs of classes with at least this cosine."""
    spark = vectors.sparkSession
    usable = written(linkable(vectors, id_col, vector_col), "vectors")
    classes = written(usable.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("m")), "classes")
    members = usable.join(classes.select("v", F.col("id").alias("node")), "v").select("id", "node")
    alone = classes.where("m > 1").select(F.col("id").alias("node"), (F.col("m") - 1).alias("n_links"))
    indexes = spark.sparkContext.broadcast(_indexes(classes, train_rows, block))
    reach = math.sqrt(2 - 2 * cosine)
    kind = dict(classes.dtypes)["v"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector with its group, its code and the later groups it probes."""
        for b in batches:
            dims = np.diff(b.column("v").offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                index, mine = indexes.value[dim], b.filter(pa.array(dims == dim))
                step = max(1, (1 << 21) // len(index.centroid))
                for lo in range(0, mine.num_rows, step):
                    part = mine.slice(lo, step)
                    x = unit(_matrix(part.column("v")))
                    own, group, near = probes(x, index, reach)
                    code, rest = index.encode(x, own)
                    base = dim << 32
                    offsets = np.concatenate([[0], np.cumsum(near.sum(1))]).astype(np.int32)
                    others = pa.ListArray.from_arrays(pa.array(offsets), pa.array(base + np.nonzero(near)[1]))
                    columns = [part.column("id"), part.column("m"), pa.array(base + group), others, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(rest), part.column("v")]
                    yield pa.record_batch(columns, names=_PLACED)

    placed = written(classes.mapInArrow(place, f"id long, m long, list long, others array<long>, own int, code binary, rest double, v {kind}"), "lists")
    met = F.explode(F.concat(F.array("list"), "others"))
    # A row a group: how many blocks of vectors and of queries it needs.
    sizes = placed.select(F.col("list").alias("home"), met.alias("list")).groupBy("list").agg(F.sum((F.col("home") == F.col("list")).cast("int")).alias("nv"), F.count("*").alias("nq"))
    many = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")
    sizes = sizes.select("list", many("nv", block).alias("bv"), many("nq", query_block).alias("bq"))
    share = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Own vectors are queries of their group too; block (i, j) pairs vectors i with queries j.
    held = placed.join(F.broadcast(sizes), "list").withColumn("i", share("bv", 1)).select("list", "i", every("bq").alias("j"), "id", "v")
    asked = placed.select(F.col("list").alias("home"), met.alias("list"), "id", "own", "code", "rest").join(F.broadcast(sizes), "list").withColumn("j", share("bq", 2))
    asked = asked.select("list", every("bv").alias("i"), "j", "id", "own", "code", "rest", (F.col("home") != F.col("list")).alias("q"))
    asked = asked.toDF(*asked.columns)  # columns of its own, for the cogroup with the same table

    def sift(left: pa.Table, right: pa.Table) -> pa.Table:
        """Vectors (left) and queries (right, as codes) that can have a link in this block."""
        if not left.num_rows or not right.num_rows:
            return _MAYBE.empty_table()
        key = left.column("list")[0].as_py()
        index, x = indexes.value[key >> 32], unit(_matrix(left.column("v")))
        ids = np.asarray(left.column("id"))
        qids, foreign, own, rest = (np.asarray(right.column(c)) for c in ("id", "q", "own", "rest"))
        code = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(qids), -1)
        xs, slack = x.astype(np.float32), (x.shape[1] + 8) * 2.0**-20  # more than rounding takes from a squared distance
        left_on, right_on = np.zeros(len(ids), bool), np.zeros(len(qids), bool)
        for lo in range(0, len(qids), 512):
            y = index.decode(code[lo : lo + 512], own[lo : lo + 512])
            # |x - y|^2 = 1 - 2xy + |y|^2 <= (reach + rest)^2
            least = (1 + (y * y).sum(1) - (reach + rest[lo : lo + 512]) ** 2 - slack) / 2
            near = y.astype(np.float32) @ xs.T >= least.astype(np.float32)[:, None]
            b, a = np.nonzero(near)
            other = qids[lo + b] != ids[a]
            left_on[a[other]] = True
            right_on[lo + b[other]] = True
        a, b = np.flatnonzero(left_on), np.flatnonzero(right_on)
        i, j = left.column("i")[0].as_py(), left.column("j")[0].as_py()
        n = len(a) + len(b)
        columns = [np.full(n, key), np.full(n, i, np.int32), np.full(n, j, np.int32), np.concatenate([ids[a], qids[b]]), np.concatenate([np.zeros(len(a), np.int8), 1 + foreign[b].astype(np.int8)])]
        return pa.table(columns, schema=_MAYBE)

    maybe = written(held.groupBy("list", "i", "j").cogroup(asked.groupBy("list", "i", "j")).applyInArrow(sift, "list long, i int, j int, id long, side tinyint"), "maybe")
    full = maybe.join(placed.select("id", "m", "v"), "id")

    def compare(t: pa.Table) -> pa.Table:
        """Links between a block's vectors (side 0) and its queries (1: of the same group, 2: of another)."""
        side = np.asarray(t.column("side"))
        if not (side == 0).any() or not (side > 0).any():
            return _OUT.empty_table()
        every_id, weight, all_x = np.asarray(t.column("id")), np.asarray(t.column("m")), unit(_matrix(t.column("v")))
        ids, qids, foreign = every_id[side == 0], every_id[side > 0], side[side > 0] == 2
        mv, mq, x, y = weight[side == 0], weight[side > 0], all_x[side == 0], all_x[side > 0]
        xs, ys = x.astype(np.float32), y.astype(np.float32)
        error = (x.shape[1] + 8) * 2.0**-23  # more than rounding adds to a product in single precision
        of_v, of_q = np.zeros(len(ids), np.int64), np.zeros(len(qids), np.int64)
        node, root = [], []
        for lo in range(0, len(y), 256):
            product = ys[lo : lo + 256] @ xs.T
            b, a = np.nonzero(product >= cosine - error)
            b, ok = b + lo, product[b, a] >= cosine + error
            unsure = np.flatnonzero(~ok)
            for at in range(0, len(unsure), 1 << 16):
                part = unsure[at : at + (1 << 16)]
                ok[part] = np.einsum("ij,ij->i", y[b[part]], x[a[part]]) >= cosine
            ok &= qids[b] != ids[a]
            b, a = b[ok], a[ok]
            if not len(a):
                continue
            # A query of the same group meets each partner from both sides; one of another group does not.
            of_q += np.bincount(b, mv[a], minlength=len(qids)).astype(np.int64)
            far = foreign[b]
            of_v += np.bincount(a[far], mq[b[far]], minlength=len(ids)).astype(np.int64)
            both = np.concatenate([ids, qids[lo : lo + 256]])
            low = _forest(both, a, b - lo + len(ids))
            linked = np.flatnonzero(low != both)
            node.append(both[linked])
            root.append(low[linked])
        if not node:
            return _OUT.empty_table()
        both = np.concatenate([*node, *root])
        low = _forest(both, np.arange(len(both) // 2), np.arange(len(both) // 2, len(both)))
        ends, at = np.unique(both, return_index=True)
        low = low[at]
        linked = np.flatnonzero(low != ends)
        all_ids, n = np.concatenate([ids, qids]), np.concatenate([of_v, of_q])
        some = np.flatnonzero(n)
        return pa.table(
            {"id": np.concatenate([all_ids[some], ends[linked]]), "n": np.concatenate([n[some], np.zeros(len(linked), np.int64)]), "b": np.concatenate([all_ids[some], low[linked]])},
            schema=_OUT,
        )

    out = written(full.groupBy("list", "i", "j").applyInArrow(compare, "id long, n long, b long"), "links")
    counts = out.where("n > 0").select(F.col("id").alias("node"), F.col("n").alias("n_links")).unionByName(alone).groupBy("node").agg(F.sum("n_links").alias("n_links"))
    return members, counts, out.where("b <> id").select(F.col("id").alias("a"), "b")


_PLACED = ["id", "m", "list", "others", "own", "code", "rest", "v"]
_MAYBE = pa.schema([("list", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("id", pa.int64()), ("side", pa.int8())])
_OUT = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("b", pa.int64())])


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest id that each place reaches over the edges between places ``a`` and ``b``."""
    low, node = np.unique(ids, return_inverse=True)  # the same id may stand at two places
    low = low.copy()
    a, b = node[a], node[b]
    while len(a):
        m = np.minimum(low[a], low[b])
        before = low.copy()
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        if (low == before).all():
            break
    return low[node]


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """``id, n_links, component_id, kept`` of every vector with an id; ``kept`` marks the smallest id of a component."""
    members, counts, edges = links(vectors, cosine, id_col, vector_col, **options)
    parts = connected_components(edges)
    ids = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    # A class is named by its smallest id, so a component of classes is by the smallest of all.
    component = F.coalesce("component", "node", "id")
    return (
        ids.join(members, "id", "left")
        .join(counts, "node", "left")
        .join(parts, "node", "left")
        .select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
    )
