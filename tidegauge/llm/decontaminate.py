"""Benchmark decontamination: a broadcast hash set of test n-grams, native.

Words are ``[0-9a-z]`` runs and non-ASCII runs after lower-casing A-Z.  An item
gives every window of ``window`` consecutive words; an item with fewer words,
but not none, is one window.  A document word inside any occurrence of a window
is *hit*.  Only DataFrame functions run: the windows of a document are hashed
and exploded with their positions, the hashes probe the broadcast set, and a
hash match counts only when the words themselves agree.

The set, and the table of the items of each window, are broadcast when their
counted rows are at most ``BROADCAST_WINDOWS``.  A larger set is joined by a
shuffle of (row, position, hash) alone; the words of a document are only looked
at again where it has hits.

Edge cases: null and empty texts have no words and no hits; repeated rows are
judged one by one; null item ids count as windows but are never listed; an
empty benchmark leaves every document clean; further columns pass through, those
named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import pass_through, restored, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Windows of a benchmark that may be broadcast; a larger set is joined by a shuffle.
BROADCAST_WINDOWS = 500_000


#: Columns of the result; input columns of these names are replaced.
RESULT = ("n_words", "n_hit", "n_items", "items", "hits", "contaminated")


def _words(text: str):
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, window: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``k, wid, wtext, classes``: one row per distinct window.

    Items of equal words form one class, named by the hash of their words.
    """
    items = (
        benchmark.select(_words(text_col).alias("w"))
        .where(F.size("w") > 0)
        .select(F.xxhash64("w").alias("class"), "w")
        .dropDuplicates(["class", "w"])
    )
    k = F.least(F.size("w"), F.lit(window))
    return (
        items.withColumn("k", k)
        .select("class", "w", "k", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("p"))
        .select("class", "k", F.slice("w", F.col("p"), F.col("k")).alias("win"))
        .groupBy("k", F.xxhash64("win").alias("wid"), F.array_join("win", " ").alias("wtext"))
        .agg(F.collect_set("class").alias("classes"))
    )


def _item_classes(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return (
        benchmark.select(F.col(id_col).cast("string").alias("item"), _words(text_col).alias("w"))
        .where((F.size("w") > 0) & F.col("item").isNotNull())
        .groupBy(F.xxhash64("w").alias("class"))
        .agg(F.collect_set("item").alias("items"))
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    share: int = 20,
    id_col: str = "item_id",
    text_col: str = "text",
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """Every row of ``docs`` with ``n_words, n_hit, n_items, items, hits, contaminated`` added.

    ``hits`` lists ``(p, k)`` of each occurring window, 1-based; a document is
    contaminated when ``n_hit > 0 and share * n_hit >= n_words``.  The input
    is read once; only documents that have hits take part in the second
    aggregation.
    """
    result = (*RESULT, text_col)
    windows = item_windows(benchmark, window, id_col, text_col)
    # The benchmark's window lengths (at most `window` of them), the number of windows and of (window, class) pairs.
    stats = windows.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.size("classes")).alias("pairs")).collect()
    small = sum(r["n"] for r in stats) <= broadcast_windows
    small_pairs = sum(r["pairs"] for r in stats) <= broadcast_windows
    probe = windows.select("k", "wid", "wtext")
    ks = sorted(r["k"] for r in stats) or [window]

    words = docs.select(F.monotonically_increasing_id().alias("_row"), *pass_through(docs, result), _words(text_col).alias("_w"))
    if not small:
        # The row numbers are used in two joins: fix them.
        words = written(words, "texts")
    per_doc = _hits_by_broadcast(words, probe, ks) if small else _hits_by_shuffle(words, probe, ks)
    # Words covered by the sorted windows: carry the last covered position and the sum.
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "_hits",
        start,
        lambda s, h: F.struct(
            F.greatest(s["end"], h["p"] + h["k"] - 1).alias("end"),
            (s["n"] + F.greatest(F.lit(0), h["p"] + h["k"] - 1 - F.greatest(s["end"], h["p"] - 1))).cast("long").alias("n"),
        ),
        lambda s: s["n"],
    )
    # Written once: the texts are cut and hashed a single time for both uses.
    per_doc = written(per_doc.withColumn("n_hit", covered), "hits")
    pairs = (
        per_doc.where(F.size("_hits") > 0)
        .select("_row", F.explode(F.array_distinct(F.transform("_hits", lambda h: F.struct(h["k"].alias("k"), h["wid"].alias("wid"))))).alias("h"))
        .select("_row", "h.k", "h.wid")
    )
    to_class = windows.select("k", "wid", F.explode("classes").alias("class")).distinct()
    listed = (
        pairs.join(F.broadcast(to_class) if small_pairs else to_class, ["k", "wid"])
        .select("_row", "class")
        .distinct()
        .join(_item_classes(benchmark, id_col, text_col), "class")
        .groupBy("_row")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    )
    out = per_doc.join(listed, "_row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(
        *restored(docs, result),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.transform("_hits", lambda h: F.struct(h["p"].alias("p"), h["k"].alias("k"))).alias("hits"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def _window_hash(w: str, p, k):
    return F.xxhash64(F.slice(w, p, k))


def _hits_by_broadcast(words: DataFrame, probe: DataFrame, ks: list[int]) -> DataFrame:
    """``_row, doc, n_words, _hits`` in one pass: no row leaves its task before it is known to be a hit.

    Position 0 stands for the document itself and always survives the join.
    """
    at = words.select("_row", "doc", "_w", F.explode(F.sequence(F.lit(0), F.size("_w"))).alias("p"))
    at = at.select("*", F.explode(F.array(*map(F.lit, ks))).alias("k")) if len(ks) > 1 else at.withColumn("k", F.lit(ks[0]))
    whole = (F.col("p") > 0) & (F.col("p") + F.col("k") - 1 <= F.size("_w"))
    at = at.withColumn("wid", F.when(whole, _window_hash("_w", F.greatest("p", F.lit(1)), F.col("k"))))
    at = at.alias("d").join(
        F.broadcast(probe.withColumn("known", F.lit(True))).alias("b"),
        (F.col("d.wid") == F.col("b.wid")) & (F.col("d.k") == F.col("b.k"))
        & (F.array_join(F.slice("d._w", F.greatest("d.p", F.lit(1)), F.col("d.k")), " ") == F.col("b.wtext")),
        "left",
    )
    at = at.where(F.col("known") | ((F.col("d.p") == 0) & (F.col("d.k") == ks[0])))
    # The words stay behind here: an aggregation with lists sorts its rows in memory, and would hold a task's whole text.
    at = at.select(
        "_row",
        F.when(F.col("d.p") == 0, F.col("doc")).alias("doc"),
        F.size("_w").cast("long").alias("n_words"),
        F.when(F.col("known"), F.struct(F.col("d.p").alias("p"), F.col("d.k").alias("k"), F.col("d.wid").alias("wid"))).alias("hit"),
    )
    return at.groupBy("_row").agg(
        F.first("doc", ignorenulls=True).alias("doc"),
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_list("hit")).alias("_hits"),
    )


def _hits_by_shuffle(words: DataFrame, probe: DataFrame, ks: list[int]) -> DataFrame:
    """The same from a written ``words``: hashes go to the windows, hits come back to the rows that have any."""
    size = F.size("_w")
    each = lambda k: F.when(size >= k, F.transform(F.sequence(F.lit(1), F.greatest(size - k + 1, F.lit(1))), lambda p: F.struct(F.lit(k).alias("k"), p.alias("p"), _window_hash("_w", p, F.lit(k)).alias("wid")))).otherwise(F.array())
    at = words.select("_row", F.explode(F.concat(*map(each, ks))).alias("x")).select("_row", "x.k", "x.p", "x.wid")
    maybe = at.join(probe, ["k", "wid"]).groupBy("_row").agg(F.collect_list(F.struct("p", "k", "wid", "wtext")).alias("_maybe"))
    true = F.filter("_maybe", lambda h: F.array_join(F.slice("_w", h["p"], h["k"]), " ") == h["wtext"])
    hits = F.sort_array(F.transform(true, lambda h: F.struct(h["p"].alias("p"), h["k"].alias("k"), h["wid"].alias("wid"))))
    none = F.array().cast("array<struct<p:int,k:int,wid:bigint>>")
    return words.join(maybe, "_row", "left").select("_row", "doc", size.cast("long").alias("n_words"), F.coalesce(hits, none).alias("_hits"))


def without_spans(text, hits):
    """``text`` without its hit words and what stands between them (a Column)."""
    lowered = F.translate(text, UPPER, LOWER)
    pieces = F.regexp_extract_all(text, F.lit(NOT_WORD + WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")), F.lit(0))
    kept = F.filter(pieces, lambda x, i: ~F.exists(hits, lambda h: (h["p"] <= i + 1) & (i + 1 < h["p"] + h["k"])))
    return F.when(lowered.isNull(), None).otherwise(F.array_join(kept, ""))


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", doc_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without contaminated documents, or with their hit spans cut out (``remove='spans'``).

    The text is not carried through the aggregation: verdicts are joined back on
    ``doc_col`` and a hash of the text, so each row, of whatever id, null included,
    goes or stays by its own text.
    """
    text_col = options.get("text_col", "text")
    digest = lambda: F.xxhash64(docs[text_col])
    verdicts = contamination(docs.select(docs[doc_col].alias("id"), digest().alias("digest"), docs[text_col].alias(text_col)), benchmark, **options).where("contaminated")
    spans = verdicts.groupBy("id", "digest").agg(F.max("hits").alias("cut")).toDF("bad", "digest", "cut")
    wide = docs.select(*pass_through(docs), docs[doc_col].alias("id"), digest().alias("own"))
    same = wide["id"].eqNullSafe(spans["bad"]) & (wide["own"] == spans["digest"])
    if remove == "documents":
        return wide.join(spans, same, "left_anti").select(*restored(docs))
    text = F.col("doc").getField(text_col)
    cut = F.when(F.col("cut").isNull(), text).otherwise(without_spans(text, F.col("cut")))
    return wide.join(spans, same, "left").select(*[cut.alias(c) if c == text_col else x for c, x in zip(docs.columns, restored(docs), strict=True)])
