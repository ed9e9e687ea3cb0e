"""The ten operators against brute force, exact round trips and held-out labels, with odd inputs."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidegauge.llm import bpe, decontaminate, embeddings, line_dedup, minhash, quality, substrings, token_files, toxicity
from tidegauge.llm import text as tx
from tidegauge.llm.clusters import buckets, dealt_buckets
from tidegauge.llm.pretokens import pack, pattern, pretokens, unpack
from tidegauge.llm.shards import Conflict, ShardStore
from tidegauge.llm.shared import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_words string, row string, score string"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
BASE = " ".join(f"alpha{i} beta{i % 7} gamma{i % 11}" for i in range(60))
ODD = [
    (1, None, "a", "b", "c"), (2, "", "a", "b", None), (3, "   \n\n ", "a", "b", "c"), (4, LONG, "a", None, "c"), (5, BASE, "a", "b", "c"), (6, BASE, "a", "b", "c"), (6, BASE, "a", "b", "c"),
    (7, BASE + " delta", None, "b", "c"), (None, BASE, "a", "b", "c"), (8, "Étude naïve, l'été's café!\n½² Ⅷ 漢字 🙂", "a", "b", "c"), (9, "one two", "a", "b", "c"), (10, "in " * 300, "a", "b", "c"),
]

SPECIAL = [(20, "hello <|endoftext|> x"), (21, "<|endoftext|><|endoftext|>"), (22, "<|endoftext"), (23, "|> a <|endoftext|>\n<|endoftext|> b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_components(spark):
    rng = np.random.default_rng(3)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    low = {n: n for p in e for n in p}
    for _ in range(400):
        for a, b in e:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {n: c for n, c in low.items() if any(n in p for p in e if p[0] != p[1])}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_and_hashes():
    texts = ["Hello, World", "", "hello world", "éà ça"]
    for limit in (4, 1 << 20):
        seen = []
        for c in tx.chunks(pa.array(texts), limit):
            w = tx.words(c)
            seen += [(c.first + d, int(h)) for d, h in zip(w.doc, w.hash, strict=True)]
        by = defaultdict(list)
        for d, h in seen:
            by[d].append(h)
        assert by[0] == by[2] and len(by[3]) == 2 and 1 not in by


# -- 1 and 6


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_take_odd_input(spark, odd, none, module):
    labels = spark.createDataFrame([(5, 1, 1), (7, 0, 0), (10, 1, 1), (None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    model = module.fit(odd, labels)
    rows = module.scored(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows) and len({r["score"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert module.scored(none, model).count() == 0
    empty = module.fit(none, labels.limit(0))
    assert module.scored(odd, empty).count() == len(ODD)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        s = module.scored(docs.select("doc_id", "text"), module.fit(docs, labels)).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
        r = s.agg(F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("acc"), F.avg(F.when(F.col(label) == 1, F.col("predicted"))).alias("recall")).first()
        assert r["acc"] > 0.97 and r["recall"] > 0.75, (label, r)  # some 3,000 labelled rows here


def test_ftrl_coordinate_by_coordinate():
    """The weights of 50 texts are those of the update rule, written out for one coordinate at a time."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 60, rng.integers(0, 25))).astype(np.uint32) for _ in range(50)]
    y = np.array([float(len(set(r) & {3, 4, 5}) > 0) for r in map(np.ndarray.tolist, rows)])
    alpha, beta, l1, l2, epochs, least = 0.3, 1.0, 0.5, 0.1, 3, 4
    got = toxicity.fit_ftrl(rows, y, alpha, beta, l1, l2, epochs, least)
    often = {f for f in range(60) if sum(f in r for r in map(np.ndarray.tolist, rows)) >= least}
    z, n = defaultdict(float), defaultdict(float)

    def weight(f, bound):
        if abs(z[f]) <= bound:
            return 0.0
        return -(z[f] - (bound if z[f] > 0 else -bound)) / ((beta + n[f] ** 0.5) / alpha + l2)

    order, bias = np.random.default_rng(7), 0.0
    for _ in range(epochs):
        for k in order.permutation(50):
            mine = [(f, l1) for f in rows[k].tolist() if f in often] + [("bias", 0.0)]
            w = {f: weight(f, bound) for f, bound in mine}
            bias = w["bias"]
            g = 1 / (1 + np.exp(-sum(w.values()))) - y[k]
            for f, _ in mine:
                step = ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / alpha
                z[f] += g - step * w[f]
                n[f] += g * g
    want = {f: weight(f, l1) for f in sorted(often) if weight(f, l1)}
    assert got.feature.tolist() == list(want) and np.allclose(got.weight, list(want.values())) and np.isclose(got.bias, bias) and 3 < len(want) < len(often)


def test_vectors_coordinate_by_coordinate(monkeypatch):
    """The folded table of 50 texts is that of stochastic gradient descent, written out number by number."""
    monkeypatch.setattr(quality, "BITS", 6)
    rng = np.random.default_rng(3)
    features = [np.unique(rng.integers(0, 64, rng.integers(0, 12))) for _ in range(50)]
    share = [(np.ones(len(f)) / max(1, len(f))).astype(np.float32) for f in features]
    y = np.array([int(7 in f or 9 in f) for f in map(np.ndarray.tolist, features)])
    dim, rate, epochs = 3, 0.5, 2
    got = quality.fit_vectors(features, share, y, dim, rate, epochs, seed=11)
    draw = np.random.default_rng(11)
    v = draw.uniform(-1 / dim, 1 / dim, (64, dim)).tolist()
    out, bias = draw.uniform(-1, 1, (dim, 2)).tolist(), [0.0, 0.0]
    done = 0
    for _ in range(epochs):
        for k in draw.permutation(50):
            lr, done = rate * (1 - done / (epochs * 50)), done + 1
            f, x = features[k].tolist(), share[k].tolist()
            h = [sum(a * v[i][d] for i, a in zip(f, x, strict=True)) for d in range(dim)]
            e = [np.exp(sum(h[d] * out[d][c] for d in range(dim)) + bias[c]) for c in (0, 1)]
            p = [e[c] / sum(e) - (y[k] == c) for c in (0, 1)]
            back = [sum(out[d][c] * p[c] for c in (0, 1)) for d in range(dim)]
            for d in range(dim):
                for c in (0, 1):
                    out[d][c] -= lr * h[d] * p[c]
            for c in (0, 1):
                bias[c] -= lr * 0.1 * p[c]
            for i, a in zip(f, x, strict=True):
                for d in range(dim):
                    v[i][d] -= lr * a / max(x) * back[d]
    want = [sum(v[i][d] * (out[d][1] - out[d][0]) for d in range(dim)) for i in range(64)]
    assert np.allclose(got.logit, want, atol=1e-3) and np.isclose(got.bias, bias[1] - bias[0], atol=1e-3)


# -- 2


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_distance_and_buckets():
    rng = np.random.default_rng(1)
    alphabet = list("abcé ")
    for _ in range(400):
        a = "".join(rng.choice(alphabet, rng.integers(0, 32)))
        b = list(a)
        for _ in range(rng.integers(0, 4)):
            k = int(rng.integers(0, len(b) + 1))
            if rng.random() < 0.5:
                b.insert(k, str(rng.choice(alphabet)))
            elif b:
                del b[min(k, len(b) - 1)]
        b = "".join(b)
        d = levenshtein(a, b)
        assert all(line_dedup.within(a, b, e) == (d <= e) for e in range(4))
        if a != b and min(len(a), len(b)) >= 10 and line_dedup.similar(a, b):
            keys = []
            for s in (a, b):
                h = tx.Hasher(np.frombuffer(s.encode("utf-32-le"), np.uint32))
                keys.append(set(np.concatenate([k for _, k in line_dedup.bucket_keys(h, np.array([0]), np.array([len(s)]))]).tolist()))
            assert keys[0] & keys[1]


def slow_gone(rows, exact_chars=line_dedup.MIN_CHARS):
    """The lines to remove from each text, by comparing all lines of like length."""
    at = defaultdict(list)
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if len(line.strip()) >= exact_chars:
                at[line.strip()].append((i, n))
    lines = sorted(at, key=len)
    low = {x: x for x in lines}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1 :] if len(a) >= line_dedup.MIN_CHARS else []:
            if len(b) - len(a) > 2:
                break
            if line_dedup.similar(a, b):
                low[find(a)] = find(b)
    groups = defaultdict(list)
    for x in lines:
        groups[find(x)] += at[x]
    gone = {i: [] for i, _ in rows}
    for places in groups.values():
        for i, n in sorted(places)[1:]:
            gone[i].append(n)
    return {i: sorted(n) for i, n in gone.items()}


def test_line_dedup_against_brute_force(spark, docs, none, odd):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(9001, "A line of some length that is kept\nshort\nA line of some lengths that is kept"), (9002, "  A line of some length that is kept \nanother one entirely")]
    got = {r["doc_id"]: r for r in line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert slow_gone(rows) == {i: r["removed_lines"] for i, r in got.items()}
    assert got[9001]["removed_lines"] == [2] and got[9002]["text"] == "another one entirely"
    assert line_dedup.without_repeated_lines(none).count() == 0 and line_dedup.without_repeated_lines(odd).count() == len(ODD)


def test_frequent_buckets_are_dealt(spark):
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(40):  # chunks: key 5 is frequent, key 6 has few nodes in each, the others are rare
        keys = np.concatenate([np.full(60, 5), np.full(3, 6), rng.integers(100, 400, 20), [0]])
        node = rng.integers(-(2**62), 2**62, len(keys))
        node[60:] = rng.choice(np.arange(-50, 50), len(keys) - 60)
        rows += zip(keys.tolist(), node.tolist(), line_dedup._deal(keys, node).tolist(), strict=True)
    assert sum(d > 0 for k, _, d in rows if k == 5) == 40 * 58 and not any(d for k, _, d in rows if k != 5)
    e = spark.createDataFrame(rows, "key long, node long, deal int").na.fill(0)
    as_set = lambda df: sorted(tuple(r) for r in df.collect())
    members = defaultdict(set)
    for k, n, _ in rows:
        members[k].add(n)
    want = sorted((k, n, min(m)) for k, m in members.items() if len(m) > 1 for n in m)
    assert as_set(dealt_buckets(e)) == want and as_set(buckets(e)) == want
    assert as_set(dealt_buckets(e.where("key > 5"))) == [r for r in want if r[0] > 5]
    assert dealt_buckets(e.where("key < 0")).count() == 0


@pytest.mark.parametrize("slots", [1 << 17, 1 << 6])
def test_a_segment_of_every_chunk_stays_few_rows_a_task(monkeypatch, slots):
    """Key 1 is a stock line in each of 10,000 chunks, key 2 a template with a new line in each, key 3 one with twenty."""
    monkeypatch.setattr(line_dedup, "SLOTS", slots)
    rng = np.random.default_rng(3)
    sent, given, rows = line_dedup.Sent(), [], []
    for _ in range(10_000):
        keys = np.concatenate([[1, 2], np.full(20, 3), rng.integers(10, 3_000, 30)])
        node = rng.integers(-(2**62), 2**62, len(keys))
        node[0], node[22:] = 77, np.arange(-15, 15)
        given.append(np.stack([keys, node]))
        fresh = sent.fresh(keys, node)
        keys, node = keys[fresh], node[fresh]
        rows.append(np.stack([keys, node, line_dedup._deal(keys, node, sent)]))
    given, (key, node, deal) = np.concatenate(given, 1), np.concatenate(rows, 1)
    assert set(zip(*given.tolist(), strict=True)) == set(zip(key.tolist(), node.tolist(), strict=True))
    plain = deal == 0
    for k in np.unique(given[0]):
        every, ends = given[1][given[0] == k], node[plain & (key == k)]
        assert every.min() == ends.min() and every.max() == ends.max()
    if slots > 1 << 16:
        assert (key == 1).sum() == 1
        for k in (2, 3):
            assert (plain & (key == k)).sum() <= line_dedup.MANY + 40 and (key == k).sum() == (given[0] == k).sum()


def test_lines_of_one_template(spark):
    """Hundreds of lines that share segments, some of them within two edits of others."""
    rng = np.random.default_rng(11)
    names = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(220)]
    rows = [(i, "\n".join(f"All rights reserved by the holder {n} since then" for n in names[i::20])) for i in range(20)]
    got = line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r["doc_id"]: r["removed_lines"] for r in got.collect()} == slow_gone(rows)


def test_links_of_a_block_of_lines(monkeypatch):
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("abcé"), rng.integers(3, 7))) for _ in range(150)]
    texts = [f"of one template {n} and more" for n in names] + ["", "a line", "ten chars.", "ten chars,"]
    side = rng.random(len(texts)) < 0.5
    part = np.arange(len(texts)) // 2
    similar = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts[:i]) if levenshtein(a, b) <= min(2, len(a) // 10, len(b) // 10)}
    given = [(i, i - 1) for i in range(1, len(texts)) if part[i] == part[i - 1]]
    joined = lambda es: {frozenset(c) for c in _sets([*es, *given], range(len(texts)))}
    for step, points in ((line_dedup.STEP_PAIRS, line_dedup.STEP_POINTS), (300, 100)):
        monkeypatch.setattr(line_dedup, "STEP_PAIRS", step)
        monkeypatch.setattr(line_dedup, "STEP_POINTS", points)
        for sides in (None, side):
            want = {(i, j) for i, j in similar if sides is None or sides[i] != sides[j]}
            found = {(max(p), min(p)) for p in line_dedup.block_links([t.encode() for t in texts], part, sides)}
            assert found <= want and joined(found) == joined(want) and 0 < len(found) < len(texts)


def test_short_lines_are_grouped_when_equal(spark):
    from tidegauge.llm import queries

    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: set(map(int, filter(None, r["removed_lines"].split(",")))) for r in queries.op2_line_dedup(spark, SF).collect()}
    at = defaultdict(list)
    for i, t in sorted(docs):
        for n, line in enumerate(t.split("\n")):
            if 0 < len(line.strip()) < 10:
                at[line.strip()].append((i, n))
    assert any(len(p) > 1 for p in at.values())
    for places in at.values():
        assert [n in got[i] for i, n in places] == [False] + [True] * (len(places) - 1)
    d = spark.createDataFrame([(1, "Les.\n\nLet."), (2, " Les. \n\nLes\nLet.")], "doc_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(d, exact_chars=1).collect()}
    assert cut == {1: "Les.\n\nLet.", 2: "\nLes"}


# -- 3


def contents(df):
    return sorted(map(repr, df.collect()))


def test_shards(spark, odd, none, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20, fanout=3, small_bytes=1 << 12)
    with pytest.raises(ValueError):
        store.read()
    named = odd.withColumnRenamed("row", "_metadata2").withColumnRenamed("score", "shard")
    for _ in range(4):
        store.append(named)
    assert store.versions() == [1, 2, 3, 4]
    want = contents(named.unionAll(named).unionAll(named).unionAll(named))
    assert contents(store.read(4)) == want
    version = store.settle("doc_id")
    assert version > 4 and contents(store.read()) == want and contents(store.read(4)) == want
    merged = store.manifest()
    assert len(merged.shards) < len(store.manifest(4).shards) and sum(s.rows for s in merged.shards) == 4 * len(ODD)
    assert store.append(none.limit(0).withColumnRenamed("row", "_metadata2").withColumnRenamed("score", "shard")) == version + 1
    assert store.manifest().shards == merged.shards
    assert store.vacuum() == 0 and contents(store.read(2)) == contents(named.unionAll(named))  # all young, all kept
    assert store.vacuum(keep=2, age=0) > 0 and contents(store.read()) == want and contents(store.read(version)) == want
    assert store.versions() == [version, version + 1]
    empty = ShardStore(spark, str(tmp_path / "e"))
    empty.append(none)
    assert empty.read().columns == none.columns and empty.read().count() == 0 and empty.compact("doc_id") is None
    empty.append(odd.withColumn("late", F.lit(1)))
    assert empty.read().columns == [*none.columns, "late"] and empty.read().count() == len(ODD)
    with pytest.raises(ValueError):
        empty.append(odd.withColumn("late", F.lit("text")))


def test_shards_lose_no_racing_writer(spark, odd, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), fanout=2)
    one = odd.select("doc_id").coalesce(1)
    for _ in range(3):
        store.append(one)
    plan = store.plan

    def late(shards):  # another writer commits while this one merges
        store.plan = plan
        store.append(one)
        return plan(shards)

    store.plan = late
    assert store.compact("doc_id") == 5 and store.read().count() == 4 * len(ODD)
    kinds = sorted(s.path[5] for s in store.manifest().shards)
    assert kinds == ["a", "c"]

    def twice(shards):  # another writer merges the same shards first
        store.plan = plan
        assert store.compact("doc_id") == 6
        return plan(shards)

    store.plan = twice
    assert store.compact("doc_id") is None and store.read().count() == 4 * len(ODD)
    with pytest.raises(Conflict):
        store._commit(store.manifest(5), [], None)


def test_shards_outlive_crashed_writers(spark, odd, tmp_path, monkeypatch):
    """Whatever a dying writer leaves, others read the last whole version and commit after it."""
    folder = tmp_path / "s"
    store, one = ShardStore(spark, str(folder)), odd.select("doc_id").coalesce(1)
    for _ in range(2):
        store.append(one)

    class Killed(BaseException):
        pass

    def killed(draft, target):  # the draft is written, its name not yet taken
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", killed)
        m.setattr(store, "_fs", type("NoDelete", (), {"__getattr__": lambda _, n, fs=store._fs: (lambda *a: False) if n == "delete" else getattr(fs, n)})())
        with pytest.raises(Killed):
            store.append(one)
    assert any(f.name.startswith("draft-") for f in (folder / "manifests").iterdir())
    assert store.versions() == [1, 2] and store.read().count() == 2 * len(ODD)
    (folder / "manifests" / "v00000003.json").touch()  # a claim without a body, and half a body
    (folder / "manifests" / "v00000004.json").write_text('{"version": 4, "schema": nul')
    fresh = ShardStore(spark, str(folder))
    assert fresh.manifest().version == 2 and fresh.read().count() == 2 * len(ODD)
    with pytest.raises(ValueError):
        fresh.read(4)
    assert fresh.append(one) == 5 and fresh.read().count() == 3 * len(ODD)
    assert fresh.settle("doc_id") >= 5 and fresh.vacuum(keep=1, age=0) >= 1  # the shard of the killed writer is garbage
    assert fresh.read().count() == 3 * len(ODD) and not any(f.name.startswith("draft-") for f in (folder / "manifests").iterdir())


def test_readers_never_wait_for_writers(spark, tmp_path):
    """Two writers commit in threads while a third reads: every read is of one version, and no row is lost."""
    import threading

    folder, rows = str(tmp_path / "s"), spark.range(10).toDF("doc_id").coalesce(1)
    ShardStore(spark, folder).append(rows)
    failed = []

    def write():
        try:
            for _ in range(4):
                ShardStore(spark, folder).append(rows)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write) for _ in range(2)]
    for t in threads:
        t.start()
    seen = []
    while any(t.is_alive() for t in threads):
        seen.append(ShardStore(spark, folder).read().count())
    for t in threads:
        t.join()
    assert not failed and all(n % 10 == 0 and n > 0 for n in seen) and seen == sorted(seen)
    assert ShardStore(spark, folder).read().count() == 90 and ShardStore(spark, folder).versions() == list(range(1, 10))


def test_sharding_query_compacts(spark):
    from tidegauge.llm import queries

    rows = queries.op3_sharding(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r["compacted"] for r in rows) and len(rows) == len(docs)
    assert {r["doc_id"]: (r["n_bytes"], r["text_sha256"]) for r in rows} == {i: (len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs.items()}


# -- 4


def payload(text):
    h, _, w = minhash.shingles(next(tx.chunks(pa.array([text]))))
    return h.tobytes() + w.astype(np.uint32).tobytes()


def slow_jp(a, b):
    (ha, xa), (hb, xb) = minhash._open(a), minhash._open(b)
    x, y = dict(zip(ha.tolist(), xa.tolist(), strict=True)), dict(zip(hb.tolist(), xb.tolist(), strict=True))
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in set(x) | set(y)) for i in set(x) & set(y))


def test_probability_jaccard_and_registers():
    a = BASE + " " + BASE[:300]
    b = BASE.replace("alpha7 ", "other ") + " tail"
    pa_, pb = payload(a), payload(b)
    want = slow_jp(pa_, pb)
    assert minhash.probability_jaccard(pa_, pb) == pytest.approx(want)
    h, d, w = minhash.shingles(next(tx.chunks(pa.array([a, b]))))
    r = minhash.registers(h, d, w, 2, 4000)
    assert (r[0] == r[1]).mean() == pytest.approx(want, abs=0.04)


def slow_groups(rows):
    """The smallest id of each text's group of near copies, by comparing all pairs."""
    p = {i: payload(t or "") for i, t in rows}
    low = {i: i for i in p}
    pairs = [(a, b) for a in p for b in p if a < b and len(p[a]) and len(p[b]) and minhash.probability_jaccard(p[a], p[b]) >= 0.8]
    for _ in range(5):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_minhash_against_brute_force(spark, docs, odd, none):
    low = slow_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["id"]: r["component_id"] for r in minhash.groups(docs).collect()} == low and sum(i != n for i, n in low.items()) > 2
    kept = minhash.deduplicated(odd).collect()
    assert {r["doc_id"] for r in kept} == {1, 2, 3, 4, 5, 8, 9, 10, None} and minhash.groups(none).count() == 0


def test_minhash_keeps_each_text_of_an_id(spark):
    a, b = BASE, " ".join(f"other{i} thing{i % 13}" for i in range(80))
    d = spark.createDataFrame([(3, a), (5, a), (5, b), (5, None), (9, b), (9, b + " tail")], "doc_id long, text string")
    assert {r["id"]: (r["component_id"], r["kept"]) for r in minhash.groups(d).collect()} == {3: (3, True), 5: (5, True), 9: (5, False)}
    assert {(r["doc_id"], r["text"]) for r in minhash.deduplicated(d).collect()} == {(3, a), (5, b), (5, None)}


def test_links_of_a_block():
    texts = [BASE, BASE + " tail", BASE[:400] + " x y z", LONG[:900], BASE + " " + BASE]
    p = [payload(t) for t in texts]
    found = set(minhash._links(p, np.arange(len(p)), 0.8))
    want = [(i, j) for i in range(5) for j in range(i) if minhash.probability_jaccard(p[i], p[j]) >= 0.8]
    low = list(range(5))
    for i, j in [*found, *want]:
        assert minhash.probability_jaccard(p[i], p[j]) >= 0.8
    joined = lambda es: {frozenset(c) for c in _sets(es, low)}
    assert joined(found) == joined(want)


def _sets(edges, nodes):
    low = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    out = defaultdict(set)
    for n, c in low.items():
        out[c].add(n)
    return out.values()


# -- 5 and 7


def test_pretokens():
    texts = ["it's we'll  'tis\t\n x", "a''s 'sab", "  ", "", "é½²Ⅷ漢字🙂'd", "x\x1cy\x85z 12ab", "trailing  \n", "𞤀 new"] + [t for _, t, *_ in ODD if t]
    for c in tx.chunks(pa.array(texts), 200):
        p = pretokens(c)
        cut, raw = np.concatenate([[0], np.cumsum(p.count)]), c.data.tobytes()
        for i in range(len(c)):
            assert [raw[a:b].decode() for a, b in zip(p.start[cut[i] : cut[i + 1]], p.end[cut[i] : cut[i + 1]], strict=True)] == pattern().findall(texts[c.first + i])
    arrays = [np.arange(5, dtype=np.uint32), np.zeros(0, np.uint8), np.array([1, 70_000], np.uint64)]
    assert all((a == b).all() for a, b in zip(arrays, unpack(pack(*arrays)), strict=True))


def test_token_files(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = odd.select("doc_id", "text").unionAll(spark.createDataFrame(SPECIAL, "doc_id long, text string"))
    token_files.write(odd, str(tmp_path / "t"), path)
    got = sorted(token_files.with_crc32(token_files.read(spark, str(tmp_path / "t"))).collect(), key=lambda r: r["start"])
    t = Tokenizer.from_file(path)
    want = defaultdict(list)
    for i, x, *_ in [*ODD, *SPECIAL]:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want[i].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r["doc_id"] for r in got] == sorted((i for i, *_ in [*ODD, *SPECIAL]), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
        at += r["n_tokens"]
    token_files.write(none, str(tmp_path / "e"), path)
    assert token_files.with_crc32(token_files.read(spark, str(tmp_path / "e"))).count() == 0


def test_token_files_are_pruned_by_id(spark, tmp_path):
    """A lookup by id reads row groups whose index and Bloom filter may hold it, and no others."""
    n = 3 * token_files.ROW_INDEX_STRIDE
    path = str(tmp_path / "tokens")
    token_files.write(spark.range(n).select((F.col("id") * 7).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).coalesce(1), path, public_tokenizers.path("byte_bpe_50k.json"))
    found = token_files.find(spark, path, [70_007, 70_008])
    rows = found.collect()
    assert [r["doc_id"] for r in rows] == [70_007] and rows[0]["ids"] == token_files.read(spark, path).where("doc_id = 70007").first()["ids"]

    def read_rows(*ids):
        df = token_files.find(spark, path, list(ids))
        df.collect()
        scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return scan.metrics().apply("numOutputRows").value()

    assert 0 < read_rows(70_007) <= token_files.ROW_INDEX_STRIDE  # by the row index
    assert read_rows(70_008) == 0  # within the bounds of a row group, refused by its Bloom filter


def library_digests(rows):
    """``id, n_tokens, ids_sha256, decoded_sha256`` by the tokenizer library."""
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return sorted((repr(i), len(ids := e.encode_ordinary(x or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()) for i, x, *_ in rows)


def test_byte_bpe(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    odd = odd.select("doc_id", "text").unionAll(spark.createDataFrame(SPECIAL, "doc_id long, text string"))
    want = library_digests([*ODD, *SPECIAL])
    got = sorted((repr(r["id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip_digests(odd, path).collect())
    assert got == want
    enc = bpe.encode(odd.where("doc_id = 8"), path)
    assert bytes(bpe.decode(enc, path).first()["decoded"]).decode() == ODD[9][1]
    assert bpe.encode(none, path).count() == 0


# -- 8


def test_substrings(spark, odd, none):
    passage = " ".join(f"shared{i}w passage{i * 7 % 13}" for i in range(40))
    rows = [(1, f"own words here first {passage} and an end"), (2, f"other start of text\nquite different {passage} tail tail2"), (3, "A repeated line of six words\nunique three"), (4, "first of four\nA repeated line of six words\nend"), (5, "nothing in common with any of these at all")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substrings.without_repeats(d).collect()}
    assert got[1]["n_removed"] == 0 and got[3]["n_removed"] == 0 and got[5]["text"] == rows[4][1]
    assert got[2]["n_removed"] >= 55 and got[4]["text"] == "first of four\nend"
    (span,) = got[2]["removed"]
    assert rows[1][1].encode()[span["start"] : span["end"]].decode().strip() in passage
    out = substrings.without_repeats(odd).collect()
    assert len(out) == len(ODD) and substrings.without_repeats(none).count() == 0
    left = {r["doc_id"]: r["text"] for r in out}[7].split()  # a copy's ends stay up to the next anchor
    assert left[-1] == "delta" and len(left) < 20


def test_every_copy_of_more_than_fifty_words_loses_some(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3_000)]
    some = lambda n, of: " ".join(rng.choice(of, n))
    rows = []
    for i in range(400):
        passage = some(51, words if i % 2 else [f"p{i}x{k}" for k in range(6)])
        rows += [(i, f"{some(30, words)} {passage} {some(30, words)}"), (1_000 + i, f"{some(25, words)} {passage} {some(25, words)}")]
    got = {r["doc_id"]: r for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(20 <= got[1_000 + i]["n_removed"] <= 51 for i in range(400))
    assert all(got[i]["n_removed"] == 0 for i in range(1, 400, 2))


def slow_repeats(docs):
    """Byte spans to remove from each text, from the units' definition, word by word."""
    at, out = defaultdict(list), {}
    for i, t in docs:
        b, words, line = (t or "").encode(), [], 0
        for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|\n", b):
            if m.group() == b"\n":
                line += 1
            else:
                words.append((m.start(), m.end(), m.group().lower() if m.group().isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in m.group()), line))
        h = {w: int(tx.mix(tx.words(next(tx.chunks(pa.array([w.decode()])))).hash ^ np.uint64(0xA5))[0]) for w in {x[2] for x in words}}
        n, cut = len(words), {0} if words else set()
        for k in range(n - substrings.WINDOW + 1):
            least = min(h[w[2]] for w in words[k : k + substrings.WINDOW])
            cut.add(max(j for j in range(k, k + substrings.WINDOW) if h[words[j][2]] == least))
        cut = sorted(cut)
        units = [("s", cut[k], (cut + [n])[k + substrings.SPAN]) for k in range(len(cut) - substrings.SPAN + 1)] or ([("s", 0, n)] if n else [])
        first = [k for k in range(n) if not k or words[k][3] != words[k - 1][3]]
        units += [("l", a, z) for a, z in zip(first, first[1:] + [n]) if z - a >= substrings.MIN_LINE_WORDS]
        out[i] = (words, len(b), set(), set())
        for kind, a, z in units:
            at[kind, tuple(w[2] for w in words[a:z])].append((i, a, z))
    for (kind, _), places in at.items():
        for i, a, z in sorted(places)[1:]:
            out[i][2].update(range(a, z))
            if kind == "l":
                out[i][3].update(range(a, z))

    def runs_of(gone):
        runs = []
        for k in sorted(gone):
            if runs and runs[-1][1] == k:
                runs[-1][1] = k + 1
            else:
                runs.append([k, k + 1])
        return runs

    spans = {}
    for i, (words, size, gone, lines) in out.items():
        ends = [w[0] for w in words] + [size]
        long = {k for a, z in runs_of(gone) if z - a >= substrings.MIN_WORDS for k in range(a, z)}
        spans[i] = [(ends[a], ends[z]) for a, z in runs_of(long | lines)]
    return spans


def test_substrings_against_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(9000, rows[3][1]), (9001, rows[5][1] + "\n" + rows[7][1]), (9002, "\n".join(rows[9][1].split("\n")[::-1]))]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["removed"]] for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == slow_repeats(rows) and sum(map(bool, got.values())) > 10


def test_no_repeated_line_stays(spark, docs):
    """What the query leaves holds no line of ``MIN_LINE_WORDS`` words twice, but for lines that a cut made."""
    cut = substrings.without_repeats(docs.select("doc_id", "text"))
    before = {i: {tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.lower())) for line in (t or "").split("\n")} for i, t in docs.select("doc_id", "text").collect()}
    seen = defaultdict(list)
    for r in cut.collect():
        for line in (r["text"] or "").split("\n"):
            w = tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.lower()))
            if len(w) >= substrings.MIN_LINE_WORDS and w in before[r["doc_id"]]:
                seen[w].append(r["doc_id"])
    assert not [w for w, ids in seen.items() if len(ids) > 1]


def test_a_line_that_all_documents_share(spark):
    """A hot digest is dealt over tasks and cut everywhere but in the first document."""
    rows = [(i, f"a stock line of six words\nown{i} text{i} of{i} this{i} one{i}") for i in range(4_000)]
    got = {r["doc_id"]: r for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, r in got.items() if r["n_removed"] == 0] == [0] and all(r["n_removed"] == 6 for i, r in got.items() if i)


def test_names_that_clash(spark):
    names = ["doc_id", "text", "_text", "doc", "row", "id", "_gone", "_row", "places", "_places", "node", "gone", "digest", "_w", "_part", "g"]
    rows = [(i, t, *["x"] * (len(names) - 2)) for i, t, *_ in ODD]
    d = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    bench = spark.createDataFrame([("a", BASE)], "item_id string, text string")
    model = toxicity.fit(d, spark.createDataFrame([(5, 1), (7, 0)], "doc_id long, toxic int"))
    for out in (toxicity.scored(d, model), line_dedup.without_repeated_lines(d), minhash.deduplicated(d), substrings.without_repeats(d), decontaminate.decontaminated(d, bench), decontaminate.decontaminated(d, bench, remove="spans")):
        assert set(names) <= set(out.columns) and {r["_text"] + r["doc"] + r["row"] + r["_gone"] for r in out.collect()} == {"xxxx"}


def test_ids_that_are_text(spark):
    d = spark.createDataFrame([(None if i is None else f"d{i:02}", t) for i, t, *_ in ODD], "doc_id string, text string")
    assert {r["doc_id"] for r in minhash.deduplicated(d).collect()} == {"d01", "d02", "d03", "d04", "d05", "d08", "d09", "d10", None}
    labels = spark.createDataFrame([("d05", 1, 1), ("d07", 0, 0)], "doc_id string, toxic int, quality int")
    assert all(m.scored(d, m.fit(d, labels)).count() == len(ODD) for m in (toxicity, quality))


# -- 9


def test_decontamination(spark, odd, none):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([("b", item), ("a", item), ("c", "tiny item"), ("d", None), ("e", "..."), (None, item)], "item_id string, text string")
    rows = [(1, f"start {item.upper()} stop", "x"), (2, "has a Tiny, item inside", "x"), (3, "clean text", "x"), (4, None, "x"), (5, " ".join(f"w{i}" for i in range(700)) + " " + item, "x"), (1, "clean", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.contamination(d, bench).collect()), key=repr)
    assert got == sorted([(1, 22, 20, ["a", "b"], True), (2, 5, 2, ["c"], True), (3, 2, 0, [], False), (4, 0, 0, [], False), (5, 720, 20, ["a", "b"], False), (1, 1, 0, [], False)], key=repr)
    shuffled = decontaminate.contamination(d, bench, broadcast_windows=0)
    assert sorted(r["n_hit"] for r in shuffled.collect()) == [0, 0, 0, 2, 20, 20]
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in shuffled.collect()), key=repr) == got
    assert sorted((r["doc_id"], r["text"]) for r in decontaminate.decontaminated(d, bench).collect()) == [(1, "clean"), (3, "clean text"), (4, None), (5, rows[4][1])]
    spans = {r["doc_id"]: r["text"] for r in decontaminate.decontaminated(d.where("text <> 'clean'"), bench, remove="spans").collect()}
    assert spans[1].split() == ["start", "stop"] and spans[2].split() == ["has", "a", "inside"] and spans[3] == "clean text"
    shared = spark.createDataFrame([(None, f"a {item} b", "x"), (None, "words of a clean row", "x"), (7, f"{item}", "y"), (7, " ".join(f"c{i}" for i in range(14)), "y")], "doc_id long, text string, _hits string")
    assert {r["text"] for r in decontaminate.decontaminated(shared, bench).collect()} == {"words of a clean row", " ".join(f"c{i}" for i in range(14))}
    cut = sorted(r["text"] for r in decontaminate.decontaminated(shared, bench, remove="spans").collect())
    assert [len(t.split()) for t in cut] == [0, 2, 14, 5] and "words of a clean row" in cut
    assert decontaminate.contamination(none, bench).count() == 0 and decontaminate.contamination(odd, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_sorts_no_words(spark):
    """Past 128 rows a task the aggregation by row sorts its input in memory: that input has no words of the texts."""
    item = " ".join(f"q{i}" for i in range(30))
    bench = spark.createDataFrame([("a", item), ("b", "tiny item")], "item_id string, text string")
    texts = {i: " ".join([*(f"w{j * 7 % 50}" for j in range(i % 90)), *[item] * (i % 3), *["tiny item"] * (i % 5 == 0)]) for i in range(400)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(d, bench).collect()}
    assert got == {i: (len(t.split()), 30 * (i % 3) + 2 * (i % 5 == 0), ["a"] * (i % 3 > 0) + ["b"] * (i % 5 == 0)) for i, t in texts.items()}
    words = d.select(F.monotonically_increasing_id().alias("_row"), F.struct("doc_id").alias("doc"), decontaminate._words("text").alias("_w"))
    plan = decontaminate._hits_by_broadcast(words, decontaminate.item_windows(bench).drop("classes"), [2, 13])._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Aggregate":
        plan = plan.children().head()
    read = re.findall(r"(\w+)#", plan.child().output().mkString(" "))
    assert "_row" in read and "_w" not in read


def slow_contaminated(rows, items):
    """Ids of the texts that hold benchmark passages, word by word."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
    windows = {tuple(w[p : p + min(13, len(w))]) for w in map(cut, items) if w for p in range(max(1, len(w) - 12))}
    sizes, out = {len(w) for w in windows}, set()
    for i, t in rows:
        w = cut(t)
        hit = {q for k in sizes for p in range(len(w) - k + 1) if tuple(w[p : p + k]) in windows for q in range(p, p + k)}
        if hit and 20 * len(hit) >= len(w):
            out.add(i)
    return out


# -- 10


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 32))
    near = base[rng.integers(0, 60, 300)] + 0.06 * rng.normal(size=(300, 32))
    x = np.concatenate([base, near, near[:20] * 3]).astype(np.float32)
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)] + [(900, None, "z"), (901, [0.0] * 32, "z"), (902, [float("nan")] * 32, "z"), (903, [None] * 32, "z"), (904, [1.0, 2.0], "z"), (None, x[0].tolist(), "z"), (5, x[5].tolist(), "z")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = {r["id"]: r for r in embeddings.near_duplicates(d, block=64).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    assert {i: got[i]["n_links"] for i in range(len(x))} == {i: int(link[i].sum()) for i in range(len(x))}  # no link is lost
    exact = {r["id"]: r["n_links"] for r in embeddings.near_duplicates(d.where("vec_id < 60"), block=64).collect()}
    assert exact == {i: int(link[i, :60].sum()) for i in range(60)}
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (900, 901, 902, 903, 904)) and len(got) == len(x) + 5
    assert embeddings.near_duplicates(d.limit(0)).count() == 0


def test_embeddings_of_any_magnitude_and_length(spark):
    d = spark.createDataFrame(
        [(1, [1e-60, 2e-60]), (2, [1e-300, 2e-300]), (3, [1e300, 2e300]), (4, [1.0, 0.0]), (5, [1.0, 2.0, 3.0]), (6, [2.0, 4.0, 6.1]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [])], "vec_id int, embedding array<double>"
    )
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(d).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (2, 4, True), 7: (2, 4, False), 8: (2, 4, False), 5: (1, 5, True), 6: (1, 5, False), 9: (0, 9, True)}
    with pytest.raises(ValueError):
        embeddings.near_duplicates(d.withColumn("vec_id", F.lit("a")))


def test_codes_bound_the_distance():
    rng = np.random.default_rng(2)
    x = embeddings.unit(np.concatenate([rng.normal(size=(900, 10)), rng.normal(size=(1, 10)) + 0.01 * rng.normal(size=(300, 10))]))
    index = embeddings.train(x, len(x), block=100)
    _, own = index.nearest(x)
    code, rest = index.encode(x, own)
    y = index.decode(code, own)
    assert np.allclose(np.linalg.norm(x - y, axis=1), rest) and rest.mean() < 0.6 * np.linalg.norm(x - index.centroid[own], axis=1).mean()


@pytest.mark.parametrize("rank", [1, 4, 64])
def test_embeddings_lose_no_link(spark, rank):
    rng = np.random.default_rng(rank)
    axes, base = np.linalg.qr(rng.normal(size=(64, rank)))[0], embeddings.unit(rng.normal(size=(600, 64)))
    offset = embeddings.unit(rng.normal(size=(600, rank)) @ axes.T)
    x = np.concatenate([base, base + 0.42 * offset, base[:1] + 0.25 * embeddings.unit(rng.normal(size=(200, 64)))]).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = embeddings.unit(x.astype(float))
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    got = {r["id"]: r for r in embeddings.near_duplicates(d, block=128).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == link.sum(1).tolist() and link.sum() > 1_000
    low = np.arange(len(x))
    for _ in range(30):
        low = np.where(link, low[None, :], low[:, None]).min(1)
    assert [got[i]["component_id"] for i in range(len(x))] == low.tolist()


# -- pipeline


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= 200 and set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_against_brute_force(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    labels, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("labels", "benchmark"))
    texts, items = [r["text"] for r in docs.orderBy("doc_id").collect()], [r["text"] for r in bench.collect()]
    own = "\n".join(f"line {i} of a long text {i * 37 % 101} with words {i * i}" for i in range(40))
    planted = [(9000, own), (9001, own.replace("a long text", "one lengthy document")), (9002, own.replace("\n", " ") + " tail"), (9003, texts[0]), (9004, None), (9005, items[0] + " and more"), (9006, ""), (9007, own.replace("\n", " "))]
    docs.unionByName(spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in planted], "doc_id long, text string, lang string, source string, n_chars long")).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    all_docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in toxicity.scored(all_docs, toxicity.fit(all_docs, labels)).where("predicted = 0").collect()]
    gone, kept = slow_gone(rows, 1), []
    for i, t in rows:
        left = t if not gone[i] else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])
        if not gone[i] or left.strip():
            kept.append((i, left))
    low = slow_groups(kept)
    single = [(i, t) for i, t in kept if low[i] == i]
    dirty = slow_contaminated(single, items)
    want = library_digests([(i, t) for i, t in single if i not in dirty])
    assert len(kept) < len(rows) < len(texts) + len(planted) and len(single) < len(kept) and dirty
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_pipeline_stages_keep_columns_and_drop_blank_leftovers(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    lines = "the first line of a short document\n\u00a0\nthe second line of that document"
    planted = [(9000, lines), (9001, lines.replace("\n\u00a0\n", "\n\n \t\n")), (9002, "\n \n"), (9003, lines + "\nand a line of its own")]
    extra = ["score", "predicted", "n_lines", "n_removed", "removed_lines", "gone", "component_id", "kept", "other", "n_words", "contaminated"]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.limit(60).collect()] + [(i, t, "en", "web", len(t)) for i, t in planted]
    wide = spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in extra]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == wide.columns
        found = out.collect()
        assert found and all(r[c] == f"{c}{r['doc_id']}" for r in found for c in extra)
        if name == "line_dedup":
            left = {r["doc_id"]: r["text"] for r in found}
            assert left[9000] == lines and 9001 not in left and left[9002] == "\n \n" and left[9003].strip() == "and a line of its own"
            assert all(r["n_chars"] == len(r["text"]) for r in found)
