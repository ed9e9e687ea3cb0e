"""Drift of every window, slice and feature against a frozen baseline profile.

All windows, models and segments are one job.  Live rows are read once, into
counts by window, slice, feature and bucket, and by value where KS asks for it;
sizes and every statistic come from these counts.  A signal that cannot be
computed is a row with a reason.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.config import Model, Profile, signals
from tidegauge.functions import columns as col
from tidegauge.functions.special import chi2_tail, kolmogorov_p, kolmogorov_ppf
from tidegauge.operators.correction import benjamini_hochberg
from tidegauge.operators.profile import ROWS, SLICE, bucketed, ceiling_at, value_counts
from tidegauge.operators.shape import listed
from tidegauge.sources.scratch import written

KEYS = ["model_id", "window_start", "window_end"]
#: Reasons, here and in the texts of `_judged` and `_refusal`.
NO_BASELINE = "baseline sample is empty"
NO_LIVE = "live sample is empty"
NO_EDGES = "no frozen bin edges available (e.g. all-null baseline feature)"
ONE_CATEGORY = "fewer than two categories have any observations"
RESULT = [
    *KEYS, "feature_name", *SLICE, "test_method", "status", "statistic", "p_value", "corrected_p_value", "is_significant", "not_computable_reason", "n_baseline", "n_live",
]
KS_CEILING = kolmogorov_ppf(0.975)


def psi_floor(nb: Column, nl: Column, buckets: Column) -> tuple[Column, Column]:
    """Mean and ceiling of the PSI of two samples of one distribution, by the chi-square approximation."""
    k, df = 1 / nb + 1 / nl, buckets - 1
    return df * k, df * k + 2 * F.sqrt(2 * df) * k


def ks_floor(nb: Column, nl: Column) -> Column:
    return F.lit(KS_CEILING) * F.sqrt((nb + nl) / (nb * nl))


def cramers_v_floor(nb: Column, nl: Column, chi2_q: Column) -> Column:
    return F.sqrt(chi2_q / (nb + nl))


def jsd_floor(nb: Column, nl: Column, chi2_q: Column) -> Column:
    return chi2_q * (1 / nb + 1 / nl) / F.lit(8 * math.log(2))


def _of_slice(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", small: bool = False) -> DataFrame:
    """Join on keys of which the slice columns may be null; the right side's keys are dropped."""
    r = right.select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in right.columns])
    cond = None
    for c in on:
        eq = left[c].eqNullSafe(r[f"_{c}"]) if c in SLICE else left[c] == r[f"_{c}"]
        cond = eq if cond is None else cond & eq
    out = left.join(F.broadcast(r) if small else r, cond, how)
    return out.drop(*[f"_{c}" for c in on])


def parted(counts: DataFrame, bins: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """``keys, segment, feature_name, bucket, part, num, n`` of counted values.

    Values of the features in ``names`` are kept, with the part of their bucket;
    of others only the bucket is.
    """
    kept = F.col("feature_name").isin(names)
    part = F.when(kept, col.fine_bucket(F.col("num"), F.col("edges"), bucket=F.col("bucket")))
    rows = bucketed(counts, bins).select(*keys, *SLICE, "feature_name", "bucket", part.alias("part"), F.when(kept, F.col("num")).alias("num"), "n")
    return rows.groupBy(*keys, *SLICE, "feature_name", "bucket", "part", "num").agg(F.sum("n").alias("n"))


def ks_statistic(live: DataFrame, baseline: DataFrame) -> DataFrame:
    """``KEYS, slice, feature_name, ks``: exact two-sample D, from two tables of :func:`parted` counts.

    D is reached at a live value or just below it, so the baseline's
    distribution is needed at live values only.  Running counts are taken within
    parts of the frozen buckets, the open ones at both ends included, and offset by
    the parts below, so no sort holds a whole feature, wherever live values drift to.
    """
    sig = [*SLICE, "feature_name"]

    def running(df, keys, name):
        inside = Window.partitionBy(*keys, *sig, "part").orderBy("num")
        per = df.groupBy(*keys, *sig, "part").agg(F.sum("n").alias("_n"))
        below = Window.partitionBy(*keys, *sig).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*keys, *sig)
        per = per.select(*keys, *sig, "part", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"), F.sum("_n").over(whole).alias(f"total_{name}"))
        out = df.withColumn(f"upto_{name}", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        out = _of_slice(out, per, [*keys, *sig, "part"])
        return out.withColumn(f"upto_{name}", F.col(f"upto_{name}") + F.col("_below")).drop("_below")

    values = lambda df, *keys: df.where("part is not null").select(*keys, *sig, "part", "num", "n")
    lv = running(values(live, *KEYS), KEYS, "l")
    # The baseline's distribution at each live value: its running count, carried to the values between.
    both = values(baseline).select(*sig, "part", "num", F.col("n").alias("nb")).unionByName(values(live).select(*sig, "part", "num").distinct().withColumn("nb", F.lit(0).cast("long")))
    both = both.groupBy(*sig, "part", "num").agg(F.sum("nb").alias("n"))
    at = running(both, [], "b").select(*sig, "part", "num", "upto_b", "total_b", F.col("n").alias("at_b"))
    j = _of_slice(lv, at, [*sig, "part", "num"], "inner")
    fb, fl = F.col("upto_b") / F.col("total_b"), F.col("upto_l") / F.col("total_l")
    fb0, fl0 = (F.col("upto_b") - F.col("at_b")) / F.col("total_b"), (F.col("upto_l") - F.col("n")) / F.col("total_l")
    d = F.greatest(F.abs(fb - fl), F.abs(fb0 - fl0))
    return j.where("total_b > 0").groupBy(*KEYS, *sig).agg(F.max(d).alias("ks"))


def _by_value(model: Model, profile: Profile) -> list[str]:
    """The features whose values KS asks for."""
    return [f.name for f in model.features if f.dtype == "continuous"] if "ks" in profile.continuous else []


def live_counts(live: DataFrame, bins: DataFrame, model: Model, profile: Profile) -> DataFrame:
    """The live rows' counts, written down: all that :func:`drift` reads of them, under this profile or one with fewer methods."""
    return written(parted(value_counts(live, model, KEYS), bins, _by_value(model, profile), KEYS), "live-counts")


def drift(
    live: DataFrame, baseline: DataFrame, profiled: DataFrame, bins: DataFrame, model: Model, profile: Profile, gated: bool = True, counted: DataFrame | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """One row per window and configured signal (columns ``RESULT``).

    ``live`` carries ``KEYS`` and the declared columns; ``bins`` is the output
    of ``frozen_bins``, ``profiled`` that of ``baseline_profile``, ``counted``
    the baseline's ``value_counts`` and ``counts`` the ``live_counts``, which are
    taken anew where they are not given.
    With ``gated=False`` statistics are given however small the samples.
    """
    tests = listed(live.sparkSession, signals(model, profile), "feature_name: string, test_method: string")
    names = _by_value(model, profile)
    counts = live_counts(live, bins, model, profile) if counts is None else counts
    counted = value_counts(baseline, model, []) if counted is None else counted
    of_rows = F.col("feature_name") == ROWS
    sizes = counts.where(of_rows).select(*KEYS, *SLICE, F.col("n").alias("n_slice"))
    whole = sizes.where("segment_dimension is null").select(*KEYS, F.col("n_slice").alias("n_predictions"))
    base_sizes = counted.where(of_rows).select(*SLICE, F.col("n").alias("n_base_slice"))
    grid = sizes.join(whole, KEYS).join(F.broadcast(tests))  # one row per configured test
    grid = grid.where("segment_dimension is null or segment_dimension <> feature_name")
    if gated:
        grid = grid.where((F.col("n_predictions") >= profile.min_window_size) | F.col("segment_dimension").isNull())
    on = ["feature_name", *SLICE]
    per_bucket = counts.where(~of_rows).groupBy(*KEYS, *on, "bucket").agg(F.sum("n").alias("n"))
    per_slice = per_bucket.groupBy(*KEYS, *on).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("live"), F.sum("n").alias("n_l"))
    r = _of_slice(grid, base_sizes, SLICE)
    r = _of_slice(r, profiled.withColumnRenamed("counts", "base"), on)
    r = _of_slice(r, per_slice, [*KEYS, *on])
    if names:
        r = _of_slice(r, ks_statistic(counts, parted(counted.where(F.col("feature_name").isin(names)), bins, names, [])), [*KEYS, *on])
    else:
        r = r.withColumn("ks", F.lit(None).cast("double"))
    r = r.withColumn("live", F.when(F.col("live").isNotNull(), col.dense(F.col("live"), F.col("buckets"))))
    nb, nl = F.coalesce("n_baseline", F.lit(0)), F.coalesce("n_l", F.lit(0))
    r = r.withColumns({"nb": nb.cast("long"), "nl": nl.cast("long")})
    return _judged(r, model, profile, gated)


def _judged(r: DataFrame, model: Model, profile: Profile, gated: bool) -> DataFrame:
    nb, nl, method = F.col("nb"), F.col("nl"), F.col("test_method")
    # Both sides as doubles: counts are exact far beyond any table's size.
    base, live = (F.transform(c, lambda x: x.cast("double")) for c in ("base", "live"))
    r = r.withColumns({"chi2": F.when(method == "chi_square", col.chi_square(base, live)), "filled": F.when(method == "chi_square", col.filled_columns(base, live))})
    statistic = (
        F.when(method == "psi", col.psi(base, live))
        .when(method == "ks", F.col("ks"))
        .when(method == "chi_square", F.sqrt(F.col("chi2") / (nb + nl)))
        .when(method == "jsd", col.jsd(base, live))
    )
    small_window = F.lit(gated) & (F.col("n_predictions") < profile.min_window_size)
    small_segment = F.lit(gated) & F.col("segment_dimension").isNotNull() & (F.col("n_slice") < model.min_segment_size)
    plain = (
        F.when(nb == 0, NO_BASELINE)
        .when(nl == 0, NO_LIVE)
        .when(method.isin("psi", "jsd") & (F.size("edges") == 0), NO_EDGES)
    )
    reason = (
        F.when(small_window, F.format_string(f"window has %d predictions, below configured minimum of {profile.min_window_size}", "n_predictions"))
        .when(small_segment, F.format_string(f"segment %s='%s' has %d live predictions, below configured minimum of {model.min_segment_size}", *SLICE, "n_slice"))
        .when(plain.isNotNull(), plain)
    )
    if gated:
        reason = reason.when(_refusal(profile).isNotNull(), _refusal(profile))
    reason = reason.when((method == "chi_square") & (F.col("filled") < 2), ONE_CATEGORY)
    r = r.withColumn("not_computable_reason", reason)
    done = F.col("not_computable_reason").isNull()
    r = r.withColumns({
        "status": F.when(done, "computed").otherwise("not_computable"),
        "statistic": F.when(done, statistic),
        "p_value": F.when(done & (method == "ks"), kolmogorov_p(F.col("ks"), nb, nl, profile.exact_ks)).when(done & (method == "chi_square"), chi2_tail(F.col("chi2"), F.col("filled") - 1)),
    })
    fire = F.create_map(*[x for m, g in profile.gates.items() for x in (F.lit(m), F.lit(g.fire))])
    r = r.withColumns({
        "is_significant": F.when(done, F.col("statistic") >= fire[method]),
        "n_baseline": F.when(small_window, 0).when(small_segment, F.coalesce("n_base_slice", F.lit(0))).otherwise(nb).cast("long"),
        "n_live": F.when(small_window, 0).when(small_segment, F.col("n_slice")).otherwise(nl).cast("long"),
    })
    return benjamini_hochberg(r, ["model_id", "window_start"], alpha=profile.fdr_alpha).select(*RESULT)


def _refusal(profile: Profile) -> Column:
    """The reason why a statistic's noise ceiling forbids gating on it; null when it does not."""
    nb, nl, method = F.col("nb"), F.col("nl"), F.col("test_method")
    simulated = ceiling_at(nl)
    psi_mean, psi_ceiling = psi_floor(nb, nl, F.col("buckets"))
    from_table = F.format_string("simulated on the baseline at %d live rows", nl)
    quiet = "exceeds the clear threshold {}; a quiet window could not reliably read as clear, so {} is not gated on at this volume"

    def refused(name: str, ceiling: Column, source: Column, clear: float) -> Column:
        return F.when(ceiling > clear, F.format_string(f"{name} sampling-noise ceiling %.3f (%s) " + quiet.format(clear, name), ceiling, source))

    psi_source = F.when(simulated.isNotNull(), from_table).otherwise(
        F.format_string("chi-square approximation, null mean %.3f at %d baseline vs %d live rows, %d buckets", psi_mean, nb, nl, F.col("buckets"))
    )
    jsd_source = F.when(simulated.isNotNull(), from_table).otherwise(F.format_string("chi-square approximation at %d baseline vs %d live rows, %d buckets", nb, nl, F.col("buckets")))
    ks_source = F.format_string("Kolmogorov at %d baseline vs %d live rows", nb, nl)
    v_source = F.format_string("chi-square with %d degrees of freedom at %d baseline vs %d live rows", F.col("buckets") - 1, nb, nl)
    g = profile.gates
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    if "psi" in g:
        out = out.when(method == "psi", refused("PSI", F.coalesce(simulated, psi_ceiling), psi_source, g["psi"].clear))
    if "ks" in g:
        out = out.when(method == "ks", refused("KS D", ks_floor(nb, nl), ks_source, g["ks"].clear))
    if "chi_square" in g:
        out = out.when(method == "chi_square", refused("Cramer's V", cramers_v_floor(nb, nl, F.col("chi2_q")), v_source, g["chi_square"].clear))
    if "jsd" in g:
        out = out.when(method == "jsd", refused("JSD", F.coalesce(simulated, jsd_floor(nb, nl, F.col("chi2_q"))), jsd_source, g["jsd"].clear))
    return out
