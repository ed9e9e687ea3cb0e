"""Baseline profiling: frozen bins, categories, counts and null floors, once per baseline.

A baseline is read once: its values are counted by slice and feature
(:func:`value_counts`), and quantiles, categories, bucket counts, sizes and the
distribution behind KS all come from these counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.config import SCORE, Model
from tidegauge.functions.columns import bucket_of, dense, jsd, psi, python_str
from tidegauge.functions.special import chi2_quantile
from tidegauge.operators.shape import chosen, listed
from tidegauge.sources.scratch import written

SLICE = ["segment_dimension", "segment_value"]
BINS = 10
#: Stands for the rows of a slice among its features.
ROWS = "__rows__"
#: Live sizes at which the null distribution is simulated.
NULL_SIZES = [10, 20, 30, 50, 75, 100, 150, 200, 300, 500, 750, 1000, 1500, 2000, 3000, 5000]
NULL_DRAWS = 200
#: Fixed values of the hash that draws.
_MASK, _MIX = 0xFFFFFFFF, 0x45D9F3B


def value_counts(df: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``keys, segment, feature_name, num, cat, n``: the values of each slice, and its rows under the name ``ROWS``.

    A feature is left out in its own dimension.  One pass over ``df``; counts are
    added up before the shuffle, by the number of each pair of dimension and feature,
    whose names follow.
    """
    kinds = dict(df.dtypes)
    dims = [None, *model.segment_dimensions]
    features = [(f.name, f.name, f.dtype == "continuous") for f in model.features] + ([(SCORE, model.score, True)] if model.score else [])
    names = [name for name, _, _ in features] + [ROWS]
    pairs = [(d, f) for d in range(len(dims)) for f in range(len(names)) if dims[d] != names[f]]
    of = lambda i, x: [k for k, p in enumerate(pairs) if p[i] == x]
    values = [F.col(c).cast("double") if continuous else python_str(F.col(c), kinds[c]) for _, c, continuous in features]
    wide = df.select(*keys, *[python_str(F.col(d), kinds[d]).alias(f"_d{i}") for i, d in enumerate(dims) if d], *[v.alias(f"_f{i}") for i, v in enumerate(values)], F.explode(F.lit(list(range(len(pairs))))).alias("_p"))
    typed = lambda continuous: [(of(1, i), F.col(f"_f{i}")) for i, f in enumerate(features) if f[2] == continuous]
    segment = chosen("_p", [(of(0, i), F.col(f"_d{i}")) for i in range(1, len(dims))], "string").alias("segment_value")
    rows = wide.select(*keys, "_p", segment, chosen("_p", typed(True), "double").alias("num"), chosen("_p", typed(False), "string").alias("cat"))
    rows = rows.where((F.col("num").isNotNull() | F.col("cat").isNotNull() | F.col("_p").isin(of(1, len(features)))) & (F.col("segment_value").isNotNull() | F.col("_p").isin(of(0, 0))))
    counted = rows.groupBy(*keys, "_p", "segment_value", "num", "cat").agg(F.count("*").alias("n"))
    dimension = chosen("_p", [(of(0, i), F.lit(d)) for i, d in enumerate(dims) if d], "string").alias("segment_dimension")
    return counted.select(*keys, dimension, "segment_value", chosen("_p", [(of(1, i), F.lit(n)) for i, n in enumerate(names)], "string").alias("feature_name"), "num", "cat", "n")


def counted_once(baseline: DataFrame, model: Model) -> DataFrame:
    """The baseline's :func:`value_counts`, written down: what several plans start from."""
    return written(value_counts(baseline, model, []), "baseline-counts")


def _quantiles(rows: DataFrame, bins: int, approximate: int | None) -> DataFrame:
    """``feature_name, q``: the ``bins + 1`` evenly spaced quantiles of each feature, minimum and maximum included.

    ``rows`` are counted values.  Exact quantiles interpolate between order
    statistics; values are ranked inside ranges that a sketch of the distinct ones
    cuts, so no task sorts a whole feature.  Approximate ones are those of the
    ranges' borders, of the given accuracy.
    """
    rows = rows.where("num is not null")
    parts = min(max(64, 4 * bins), approximate or 64) if approximate else 64
    cuts = rows.groupBy("feature_name").agg(F.percentile_approx("num", F.array(*[F.lit(i / parts) for i in range(1, parts)]), max(1_000, approximate or 0)).alias("cuts"))
    # One row a feature, as many as are declared.
    counted = rows.select("feature_name", "num", "n").join(F.broadcast(cuts), "feature_name")
    counted = counted.select("feature_name", "num", "n", F.size(F.filter("cuts", lambda c: c <= F.col("num"))).alias("part"))
    whole = Window.partitionBy("feature_name")
    below = F.coalesce(F.sum("m").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counted.groupBy("feature_name", "part").agg(F.sum("n").alias("m")).select("feature_name", "part", below.alias("below"), F.sum("m").over(whole).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("feature_name", "part").orderBy("num").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("upto", upto).join(F.broadcast(sums), ["feature_name", "part"])  # as many rows a feature as ranges
    ranked = ranked.withColumn("stop", F.col("upto") + F.col("below")).withColumn("start", F.col("stop") - F.col("n"))
    wanted = []
    for i in range(bins + 1):
        at = (F.col("total") - 1) * i / F.lit(bins)
        low = F.floor(at)
        holds = lambda r: (r >= F.col("start")) & (r < F.col("stop"))
        wanted.append(F.when(holds(low) | holds(F.ceil(at)), F.struct(F.lit(i).alias("i"), (at - low).alias("share"))))
    found = ranked.select("feature_name", "num", F.explode(F.array_compact(F.array(*wanted))).alias("w"))
    one = F.min("num") + (F.max("num") - F.min("num")) * F.max("w.share")
    found = found.groupBy("feature_name", "w.i").agg(F.when(F.min("num") == F.max("num"), F.min("num")).otherwise(one).alias("x"))
    return found.groupBy("feature_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("q"))


def frozen_bins(baseline: DataFrame, model: Model, bins: int = BINS, approximate: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """``feature_name, dtype, edges, category, position, n_categories``: a row per continuous feature and per category.

    Edges are interpolated quantiles and rise strictly, except for a constant
    feature, which has its value twice; an all-null feature has none.  Categories
    are numbered in ascending order; a feature without any has one row with a null
    category.  They stay rows, so there may be any number.
    """
    counted = value_counts(baseline, model, []) if counted is None else counted
    rows = counted.where(F.col("segment_dimension").isNull() & (F.col("feature_name") != ROWS))
    q = _quantiles(rows, bins, approximate)
    lo, hi = F.element_at("q", 1), F.element_at("q", -1)
    edges = q.select("feature_name", F.when(lo == hi, F.array(lo, hi)).otherwise(F.array_distinct("q")).alias("edges"))
    names = [(f.name, f.dtype) for f in model.features] + ([(SCORE, "continuous")] if model.score else [])
    declared = F.broadcast(listed(baseline.sparkSession, names, "feature_name: string, dtype: string"))
    categories = rows.where("cat is not null").select("feature_name", F.col("cat").alias("category"))
    order = Window.partitionBy("feature_name")
    categories = categories.withColumns({"position": F.row_number().over(order.orderBy("category")) - 1, "n_categories": F.count("*").over(order)})
    none = F.array().cast("array<double>")
    numbers = declared.where("dtype = 'continuous'").join(F.broadcast(edges), "feature_name", "left").select(
        "feature_name", "dtype", F.coalesce("edges", none).alias("edges"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("int").alias("position"), F.lit(0).cast("long").alias("n_categories")
    )
    words = declared.where("dtype = 'categorical'").join(categories, "feature_name", "left").select("feature_name", "dtype", none.alias("edges"), "category", "position", F.coalesce("n_categories", F.lit(0)).cast("long").alias("n_categories"))
    return numbers.unionByName(words)


def freeze(baseline: DataFrame, model: Model, bins: int = BINS, approximate: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """:func:`frozen_bins` computed now, as a table for all plans that use them."""
    return written(frozen_bins(baseline, model, bins, approximate, counted), "bins")


def shapes(bins: DataFrame) -> DataFrame:
    """``feature_name, dtype, edges, n_categories, buckets``: one row a declared feature, fit to be broadcast."""
    s = bins.groupBy("feature_name", "dtype").agg(F.first("edges").alias("edges"), F.max("n_categories").alias("n_categories"))
    return s.withColumn("buckets", (F.when(F.col("dtype") == "continuous", F.size("edges")).otherwise(F.col("n_categories")) + 1).cast("int"))


def bucketed(counts: DataFrame, bins: DataFrame) -> DataFrame:
    """Counted values with their ``bucket``, and the feature's ``edges``; rows under ``ROWS`` have none.

    A category is looked up by a hash join on (feature, category), which Spark
    broadcasts when the dictionary's bytes allow; one that it lacks falls in the last bucket.
    """
    known = bins.where("category is not null").select("feature_name", F.col("category").alias("cat"), "position")
    j = counts.join(F.broadcast(shapes(bins)), "feature_name", "left").join(known, ["feature_name", "cat"], "left")
    bucket = F.when(F.col("dtype") == "continuous", bucket_of(F.col("num"), F.col("edges"))).otherwise(F.coalesce("position", F.col("n_categories").cast("int")))
    return j.withColumn("bucket", bucket).drop("position", "n_categories")


def slice_counts(df: DataFrame, model: Model, bins: DataFrame, keys: list[str], counted: DataFrame | None = None) -> DataFrame:
    """``keys, segment, feature_name, counts (map), n``: bucket counts of each slice, without a feature in its own dimension."""
    by = [*keys, *SLICE, "feature_name"]
    counted = value_counts(df, model, keys) if counted is None else counted
    per_bucket = bucketed(counted.where(F.col("feature_name") != ROWS), bins).groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    return per_bucket.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("counts"), F.sum("n").alias("n"))


def _mixed(x):
    """A hash of 32 bits, in arithmetic on longs that SQL repeats."""
    x = x.bitwiseAND(_MASK)
    for _ in range(2):
        x = (F.shiftright(x, 16).bitwiseXOR(x) * _MIX).bitwiseAND(_MASK)
    return F.shiftright(x, 16).bitwiseXOR(x)


def _unit(x):
    """A number above 0 and below 1."""
    return (_mixed(x) + 0.5) / F.lit(4294967296.0)


def null_tables(profiled: DataFrame, sizes: list[int] | None = None, draws: int = NULL_DRAWS, seed: int = 0, buckets: int = BINS + 2) -> DataFrame:
    """Mean and 97.5 % ceiling of each continuous signal's statistic when nothing has shifted, by live size.

    Draws are counter-based: row ``i`` of draw ``d`` of a size hashes the signal,
    the size, ``d`` and ``i``, so a table depends on no other signal, task or order.
    Live rows are drawn one by one from the baseline's buckets; the baseline's own
    noise is normal with the mean and covariance of a multinomial, as it may have
    any number of rows.  Ceilings never rise with size.  No signal has more than ``buckets`` buckets.
    """
    sizes = sorted(sizes or NULL_SIZES)
    key = F.to_json(F.array("feature_name", *SLICE), {"ignoreNullFields": "false"})
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)
    rows = profiled.where("dtype = 'continuous' and n_baseline > 0 and size(edges) > 0")
    rows = rows.select(*SLICE, "feature_name", key.alias("key"), F.transform("counts", lambda c: c.cast("long")).alias("counts")).withColumn("n", n.cast("double"))
    start = F.conv(F.substring(F.md5(F.concat("key", F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long")
    upto = F.transform("counts", lambda _, i: F.aggregate(F.slice("counts", 1, i + 1), F.lit(0).cast("long"), lambda s, c: s + c) / F.col("n"))
    signals = rows.withColumns({"start": start, "upto": upto})
    # One row a signal, size and draw: they are dealt before their rows are drawn, and counted where they lie.
    of = ["key", "size", "draw"]
    cells = signals.select("key", "start", "upto", F.explode(F.lit(sizes)).alias("size")).select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    parts = int(profiled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = _mixed(F.col("start") + F.col("size")) + F.col("draw") * sizes[-1]
    live = cells.repartition(parts, *of).select(*of, "upto", stream.alias("stream"), F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i"))
    live = live.select(*of, "upto", _unit(F.col("stream") + F.col("i")).alias("u"))
    below = [F.sum(F.when(F.col("u") < F.get("upto", F.lit(k)), 1).otherwise(0)).alias(f"b{k}") for k in range(buckets)]
    live = live.groupBy(*of).agg(*below).select(*of, F.array(*[F.col(f"b{k}") for k in range(buckets)]).alias("below"))
    r = live.join(signals.select("key", *SLICE, "feature_name", "start", "counts", "n"), "key")
    noise = lambda i: _mixed(F.col("start") + F.col("size") + 1_000_003) + (F.col("draw") * buckets + i) * 2
    z = F.transform("counts", lambda c, i: F.sqrt(c / F.col("n")) * F.sqrt(-2 * F.log(_unit(noise(i)))) * F.cos(F.lit(2 * math.pi) * _unit(noise(i) + 1)))
    r = r.withColumn("z", z).withColumn("zs", F.aggregate("z", F.lit(0.0), lambda s, x: s + x))
    share = F.transform("counts", lambda c, i: F.greatest(F.lit(0.0), c / F.col("n") + (F.get("z", i) - c / F.col("n") * F.col("zs")) / F.sqrt("n")))
    got = F.transform("counts", lambda c, i: (F.get("below", i) - F.coalesce(F.get("below", i - 1), F.lit(0))) / F.col("size"))
    r = r.select(*SLICE, "feature_name", "size", share.alias("b"), got.alias("q"))
    r = r.withColumn("x", F.when(F.col("feature_name") == SCORE, jsd(F.col("b"), F.col("q"))).otherwise(psi(F.col("b"), F.col("q"))))
    r = r.groupBy(*SLICE, "feature_name", "size").agg(F.avg("x").alias("mean"), F.percentile("x", F.lit(0.975)).alias("ceiling"))
    r = r.groupBy(*SLICE, "feature_name").agg(F.sort_array(F.collect_list(F.struct("size", "mean", "ceiling"))).alias("t"))
    highest = F.transform("t.ceiling", lambda _, i: F.array_max(F.slice("t.ceiling", i + 1, F.lit(len(sizes)))))
    return r.select(*SLICE, "feature_name", F.col("t.size").alias("null_sizes"), F.col("t.mean").alias("null_mean"), highest.alias("null_ceiling"))


def baseline_profile(
    baseline: DataFrame, model: Model, bins: int = BINS, simulate: bool = True, approximate: int | None = None, frozen: DataFrame | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """One row per (feature, slice): bins, dense counts, rows, chi-square quantile and (optionally) the null table.

    Segment slices use the bins of the whole baseline.
    """
    counted = value_counts(baseline, model, []) if counted is None else counted
    frozen = frozen_bins(baseline, model, bins, approximate, counted) if frozen is None else frozen
    out = slice_counts(baseline, model, frozen, [], counted).join(F.broadcast(shapes(frozen)), "feature_name")
    out = out.select(
        *SLICE, "feature_name", "dtype", "edges", "buckets", dense(F.col("counts"), F.col("buckets")).alias("counts"), F.col("n").alias("n_baseline"),
        chi2_quantile(F.lit(0.975), F.col("buckets") - 1).alias("chi2_q"),
    )
    if simulate:
        on = ["feature_name", *SLICE]
        nulls = null_tables(out, buckets=bins + 2).select(*[F.col(c).alias(f"_{c}") for c in on], "null_sizes", "null_mean", "null_ceiling")
        same = F.lit(True)
        for c in on:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return out.join(nulls, same, "left").drop(*[f"_{c}" for c in on])
    empty = F.lit(None).cast("array<double>")
    return out.select("*", F.lit(None).cast("array<int>").alias("null_sizes"), empty.alias("null_mean"), empty.alias("null_ceiling"))


def ceiling_at(n, sizes="null_sizes", ceilings="null_ceiling"):
    """Simulated ceiling at ``n`` rows: clamped at the ends, linear in the logarithm of the size between."""
    s, c = F.col(sizes), F.col(ceilings)
    k = F.size(F.filter(s, lambda x: x <= n))
    lo, hi = F.element_at(s, k), F.element_at(s, k + 1)
    between = F.element_at(c, k) + (F.element_at(c, k + 1) - F.element_at(c, k)) * (F.log(n) - F.log(lo)) / (F.log(hi) - F.log(lo))
    return F.when(s.isNull(), None).when(n <= F.element_at(s, 1), F.element_at(c, 1)).when(n >= F.element_at(s, -1), F.element_at(c, -1)).otherwise(between)
