"""Reporting queries over windows, results and alerts: every expected slot is a row with a state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.config import Gate, Model, Profile, interval, parse_duration, signals
from tidegauge.functions.columns import bucket_of, dense, plain_text, psi
from tidegauge.operators.drift import KEYS, psi_floor
from tidegauge.operators.profile import SLICE
from tidegauge.operators.shape import slices, window_grid, windows_meeting
from tidegauge.operators.streaks import IDENTITY, METRIC_IDENTITY, classified_drift, classified_metrics, classify, first_and_latest_revision, suppressed_episodes, with_runs

#: Fixed value: the reason of a window that was never evaluated.
NO_WINDOW = "not evaluated -- no window exists for this time slot"


def state_of(evaluated: Column, status: Column) -> Column:
    return F.when(~evaluated, "missing").when(status.isNull(), "not_configured").otherwise(status)


def _grid(windows: DataFrame, start, end, duration: str) -> DataFrame:
    """Expected windows with a flag for those that were evaluated."""
    kind = dict(windows.dtypes)["window_start"]
    grid = window_grid(windows.sparkSession, start, end, duration).select(*[F.col(c).cast(kind).alias(c) for c in ("window_start", "window_end")])
    have = windows.select("window_start", F.lit(True).alias("_have"))
    return grid.join(have, "window_start", "left").withColumn("evaluated", F.coalesce("_have", F.lit(False))).drop("_have")


def _same(c: str, value: str | None) -> Column:
    return F.col(c).eqNullSafe(F.lit(value))


def drift_timeline(windows, results, start, end, duration: str, feature: str, method: str, dimension: str | None = None, value: str | None = None) -> DataFrame:
    """One row per expected window of one signal: value, significance, state, reason."""
    one = results.where((F.col("feature_name") == feature) & (F.col("test_method") == method) & _same("segment_dimension", dimension) & _same("segment_value", value))
    j = _grid(windows, start, end, duration).join(one.select("window_start", "status", "statistic", "is_significant", "not_computable_reason"), "window_start", "left")
    state = state_of(F.col("evaluated"), F.col("status"))
    return j.select(
        "window_start", "window_end", F.col("statistic").alias("value"), "is_significant", state.alias("state"), F.when(state == "missing", NO_WINDOW).otherwise(F.col("not_computable_reason")).alias("reason")
    )


def feature_attribution(results: DataFrame, window_start, model: Model, profile: Profile) -> DataFrame:
    """Global signals of one window ranked by value over fire threshold; a configured signal without a row is kept."""
    rows = [(f, m, profile.gates[m].fire) for f, m in signals(model, profile)]
    expected = results.sparkSession.createDataFrame(rows, "feature_name string, test_method string, fire_threshold double")
    one = results.where((F.col("window_start") == F.lit(window_start).cast(dict(results.dtypes)["window_start"])) & F.col("segment_dimension").isNull())
    j = F.broadcast(expected).join(one.select("feature_name", "test_method", "status", "statistic", "is_significant"), ["feature_name", "test_method"], "left")
    j = j.withColumn("ratio", F.col("statistic") / F.col("fire_threshold")).withColumn("state", state_of(F.lit(True), F.col("status")))
    return j.select("feature_name", "test_method", "statistic", "fire_threshold", "ratio", "is_significant", "state").orderBy(F.desc_nulls_last("ratio"), "feature_name", "test_method")


def segment_view(windows, results, start, end, duration: str, feature: str, method: str, dimension: str) -> DataFrame:
    """The whole and every segment value ever recorded for a signal, in every expected window."""
    mine = results.where((F.col("feature_name") == feature) & (F.col("test_method") == method))
    mine = mine.where(F.col("segment_dimension").isNull() | (F.col("segment_dimension") == dimension)).withColumn("segment", F.coalesce("segment_value", F.lit("Global")))
    values = mine.select("segment").distinct()  # segment values of one dimension and the expected windows: both small
    grid = _grid(windows, start, end, duration).crossJoin(F.broadcast(values))
    j = grid.join(mine.select("window_start", "segment", "status", "statistic", "not_computable_reason"), ["window_start", "segment"], "left")
    state = state_of(F.col("evaluated"), F.col("status"))
    return j.select("window_start", "segment", F.col("statistic").alias("value"), state.alias("state"), F.when(state == "missing", NO_WINDOW).otherwise(F.col("not_computable_reason")).alias("reason"))


def performance_timeline(windows, revisions, start, end, duration: str, metric: str) -> DataFrame:
    """Initial and latest revision of a global metric in every expected window."""
    one = revisions.where((F.col("metric_name") == metric) & F.col("segment_dimension").isNull())
    both = first_and_latest_revision(one, ["window_start", "metric_name"])
    kinds = windows.sparkSession.createDataFrame([("initial",), ("latest",)], "revision string")
    grid = _grid(windows, start, end, duration).crossJoin(F.broadcast(kinds))
    j = grid.join(both.select("window_start", "revision", "status", "metric_value", "not_computable_reason", "n_labeled"), ["window_start", "revision"], "left")
    state = state_of(F.col("evaluated"), F.col("status"))
    return j.select("window_start", "revision", F.col("metric_value").alias("value"), "n_labeled", state.alias("state"), F.when(state == "missing", NO_WINDOW).otherwise(F.col("not_computable_reason")).alias("reason"))


def alert_history(alerts: DataFrame, start, end) -> DataFrame:
    """Alerts whose time from opening to last sight meets the range, newest first; data time only."""
    seen = alerts.withColumns({"window_start": F.col("opened_window"), "window_end": F.col("last_seen_window")})
    return windows_meeting(seen, start, end).drop("window_start", "window_end").orderBy(F.desc("opened_window"), "signal_name", "feature_name", "segment_value")


def with_windows(alerts: DataFrame, windows: DataFrame) -> DataFrame:
    """``alerts`` with the start and the predictions of the windows that opened, escalated and last touched them."""
    out = alerts
    for name in ("opened", "escalated", "last_seen"):
        w = windows.select(F.col("model_id").alias("_m"), F.col("window_end").alias("_e"), F.col("window_start").alias(f"{name}_start"), F.col("n_predictions").alias(f"{name}_predictions"))
        out = out.join(w, (F.col("model_id") == F.col("_m")) & (F.col(f"{name}_window") == F.col("_e")), "left" if name == "escalated" else "inner").drop("_m", "_e")
    return out


def all_suppressed(results: DataFrame | None, metrics: DataFrame | None, profile: Profile) -> DataFrame:
    """Breach and not-computable runs too short to alert, of all signals at once."""
    parts = []
    if results is not None:
        parts.append((classified_drift(results, profile), IDENTITY, "statistic"))
    if metrics is not None:
        m = classified_metrics(metrics, profile).withColumnRenamed("metric_name", "test_method").withColumn("feature_name", F.lit(None).cast("string"))
        parts.append((m, IDENTITY, "metric_value"))
    out = []
    for df, identity, value in parts:
        for kind, least in (("breach", profile.fire_persistence), ("not_computable", profile.not_computable_persistence)):
            out.append(suppressed_episodes(df, identity, least, kind, value))
    return reduce(DataFrame.unionByName, out)


def policy_backtest(results: DataFrame, policies: DataFrame, identity: list[str] | None = None) -> DataFrame:
    """What each policy ``(policy, fire, clear, persistence)`` would have done: longest breach, whether it opens, refused and quiet windows, peak.

    Policies are a short list and are broadcast; statistics are not computed again.
    """
    identity = identity or IDENTITY
    j = results.join(F.broadcast(policies))
    kind = F.when(F.col("status") == "not_computable", "not_computable").when(F.col("statistic") >= F.col("fire"), "breach").when(F.col("statistic") <= F.col("clear"), "clear").otherwise("dead_zone")
    runs = with_runs(j.withColumn("class", kind), [*identity, "policy"])
    longest = F.coalesce(F.max(F.when(F.col("class") == "breach", F.col("run_length"))), F.lit(0))
    return runs.groupBy(*identity, "policy").agg(
        longest.alias("longest_breach"), (longest >= F.max("persistence")).alias("opens"), F.sum((F.col("class") == "not_computable").cast("int")).alias("refused"),
        F.sum((F.col("class") == "clear").cast("int")).alias("clear_windows"), F.max("statistic").alias("peak"),
    )


def mean_shift(df: DataFrame, feature: str, amount: float, when: Column) -> DataFrame:
    """Adds ``amount`` to a feature where ``when`` holds."""
    return df.withColumn(feature, F.when(when, F.col(feature) + amount).otherwise(F.col(feature)))


def label_noise(df: DataFrame, label: str, key: Column, probability: float, when: Column, seed: int = 0) -> DataFrame:
    """Flips 0/1 labels with a probability (at most 0.99), decided by ``key`` and ``seed`` and so repeatable."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long")
    hit = draw < F.lit(int(min(probability, 0.99) * (1 << 32)))
    return df.withColumn(label, F.when(when & hit, 1 - F.col(label)).otherwise(F.col(label)))


def _check(name: str, df: DataFrame, passed: Column, detail: Column) -> DataFrame:
    return df.agg(passed.alias("passed"), detail.cast("string").alias("detail")).select(F.lit(name).alias("name"), "passed", "detail")


def expect_windows(windows: DataFrame, least: int) -> DataFrame:
    return _check("windows_loaded", windows, F.count("*") >= least, F.count("*"))


def expect_no_significant(results: DataFrame) -> DataFrame:
    n = F.coalesce(F.sum(F.col("is_significant").cast("int")), F.lit(0))
    return _check("no_significant_readings", results, n == 0, n)


def expect_max_below(results: DataFrame, feature: str, method: str, limit: float) -> DataFrame:
    one = results.where((F.col("feature_name") == feature) & (F.col("test_method") == method) & F.col("segment_dimension").isNull())
    return _check(f"max_{method}_of_{feature}_below_{limit}", one, F.max("statistic") < limit, plain_text(F.max("statistic")))


def expect_no_unexpected(alerts: DataFrame, expected: DataFrame) -> DataFrame:
    """``expected`` names signals by (signal_name, feature_name)."""
    e = expected.toDF("_s", "_f")
    rest = alerts.join(e, alerts["signal_name"].eqNullSafe(e["_s"]) & alerts["feature_name"].eqNullSafe(e["_f"]), "left_anti")
    return _check("no_unexpected_alerts", rest, F.count("*") == 0, F.count("*"))


def expect_lifecycle(alerts: DataFrame, signal: str, feature: str) -> DataFrame:
    """Exactly one alert of a signal, which escalated and resolved."""
    one = alerts.where((F.col("signal_name") == signal) & (F.col("feature_name") == feature) & F.col("segment_dimension").isNull() & (F.col("kind") != "not_computable"))
    n = F.count("*")
    ok = (n == 1) & (F.coalesce(F.sum(F.col("escalated_window").isNotNull().cast("int")), F.lit(0)) == 1) & (F.coalesce(F.sum(F.col("resolved_window").isNotNull().cast("int")), F.lit(0)) == 1)
    return _check(f"{signal}_of_{feature}_opened_escalated_resolved", one, ok, n)


def expect_mean_drop(metrics: DataFrame, metric: str, split, gate: Gate) -> DataFrame:
    """A metric's mean is clear before ``split`` and breaches after it."""
    one = metrics.where((F.col("metric_name") == metric) & F.col("segment_dimension").isNull() & (F.col("status") == "computed"))
    early = F.avg(F.when(F.col("window_start") < F.lit(split), F.col("metric_value")))
    late = F.avg(F.when(F.col("window_start") >= F.lit(split), F.col("metric_value")))
    told = F.when(early.isNotNull() & late.isNotNull(), F.format_string("%.3f to %.3f", early, late)).otherwise("no data")
    return _check(f"{metric}_drops", one, F.coalesce((early >= gate.clear) & (late <= gate.fire), F.lit(False)), told)


def expect_episodes(episodes: DataFrame, n: int) -> DataFrame:
    return _check("suppressed_episodes", episodes, F.count("*") == n, F.count("*"))


def run_totals(windows: DataFrame, results: DataFrame, metrics: DataFrame, alerts: DataFrame) -> DataFrame:
    """``item, n``: what a run over a history produced, in one row an item."""
    some = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    parts = [
        (windows, {"windows": F.count("*")}),
        (results, {"drift_results": F.count("*"), "drift_computed": some(F.col("status") == "computed"), "drift_significant": some(F.coalesce("is_significant", F.lit(False)))}),
        (metrics, {"performance_results": F.count("*"), "performance_computed": some(F.col("status") == "computed")}),
        (alerts, {"alerts": F.count("*"), **{f"alerts_{s}": some(F.col("status") == s) for s in ("open", "escalated", "resolved")}}),
    ]
    rows = [df.agg(*[c.alias(n) for n, c in items.items()]).select(F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).alias("n")) for n in items])).alias("r")).select("r.*") for df, items in parts]
    return reduce(DataFrame.unionByName, rows)


def evaluation_totals(windows: DataFrame, labels: DataFrame, predictions: DataFrame, start, end, duration: str, early: str) -> DataFrame:
    """``item, n``: windows evaluated and skipped in a range, their predictions and labelled predictions, and labels that came within ``early`` or later.

    ``windows`` carry ``n_predictions`` and ``n_labels``.
    """
    some = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    inside = windows_meeting(windows, start, end)
    grid = _grid(inside, start, end, duration)
    seen = labels.select("model_id", "prediction_id", "received_at").join(predictions.select("model_id", "prediction_id", "predicted_at"), ["model_id", "prediction_id"])
    soon = F.col("received_at") < F.col("predicted_at") + F.expr(f"interval {interval(early)}")
    parts = [
        (grid, {"windows_evaluated": some(F.col("evaluated").cast("int")), "windows_skipped": some((~F.col("evaluated")).cast("int"))}),
        (inside, {"predictions": some(F.col("n_predictions")), "labelled": some(F.col("n_labels"))}),
        (seen, {"labels_early": some(soon.cast("int")), "labels_late": some((~soon).cast("int"))}),
    ]
    rows = [df.agg(*[c.alias(n) for n, c in items.items()]).select(F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).alias("n")) for n in items])).alias("r")).select("r.*") for df, items in parts]
    return reduce(DataFrame.unionByName, rows)


def data_range(windows: DataFrame) -> DataFrame:
    return windows.groupBy("model_id").agg(F.to_date(F.min("window_start")).alias("first_day"), F.to_date(F.max("window_end")).alias("last_day"), F.count("*").alias("windows"))


def displayed(metrics: DataFrame, profile: Profile) -> DataFrame:
    """Metric rows with the state a chart shows: breach or normal where a value is computed."""
    gates = {m.name: m.gate for m in profile.metrics if m.gate}
    kind = classify(F.col("metric_value"), F.col("status"), gates, F.col("metric_name"))
    return metrics.withColumn("display", F.when(F.col("status") != "computed", F.col("status")).when(kind == "breach", "breach").otherwise("normal"))


def known_segments(results: DataFrame) -> DataFrame:
    """``model_id, feature_name, test_method, segment_dimension, segments``: every segment value ever recorded for a signal, in order."""
    by = ["model_id", "feature_name", "test_method", "segment_dimension"]
    rows = results.where(F.col("segment_dimension").isNotNull()).select(*by, "segment_value").distinct()
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list("segment_value")).alias("segments"))  # values of one dimension


def ordinal(at: Column, first: Column, duration: str) -> Column:
    """Windows from the one that begins at ``first`` to the one that begins at ``at``; windows that are missing count."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((us(at) - us(first)) / F.lit(int(parse_duration(duration).total_seconds()) * 1_000_000)).cast("int")


def run_trace(windows: DataFrame, results: DataFrame, revisions: DataFrame, alerts: DataFrame, duration: str) -> DataFrame:
    """``model_id, section, series, points``: a run's history for export, one row a series.

    Sections: ``drift``, ``initial`` and ``final`` (first and newest revision of a
    metric), ``alert``.  Points name windows by their ordinal from the model's first
    evaluated window, so a window that is missing leaves a gap.  A series has a
    point a window; ``write.json`` exports it nested.
    """
    first = windows.groupBy("model_id").agg(F.min("window_start").alias("t0"))  # one row a model
    at = ordinal(F.col("window_start"), F.col("t0"), duration)
    end = lambda c: (ordinal(F.col(c), F.col("t0"), duration) - 1).alias(c.removesuffix("_window"))
    points = lambda i, value, status, n, reason: F.struct(i.alias("i"), F.round(value, 4).alias("value"), F.col(status).alias("status"), F.col(n).alias("n"), F.col(reason).alias("reason"))

    def listed(df: DataFrame, section: Column, name: list[str], point: Column) -> DataFrame:
        named = F.struct(*[F.col(c).cast("string").alias(n) for c, n in zip(name, ("name", "method", "segment_dimension", "segment_value"), strict=True)])
        return df.join(F.broadcast(first), "model_id").select("model_id", section.alias("section"), named.alias("series"), point.alias("p")).groupBy("model_id", "section", "series").agg(F.sort_array(F.collect_list("p")).alias("points"))

    drift = listed(results, F.lit("drift"), ["feature_name", "test_method", "segment_dimension", "segment_value"], points(at, F.col("statistic"), "status", "n_live", "not_computable_reason"))
    both = first_and_latest_revision(revisions, [*METRIC_IDENTITY, "window_start"]).withColumn("_none", F.lit(None).cast("string"))
    value = points(at, F.col("metric_value"), "status", "n_labeled", "not_computable_reason")
    # Both sections in one pass over the revisions.
    parts = [drift, listed(both, F.when(F.col("revision") == "initial", "initial").otherwise("final"), ["metric_name", "_none", "segment_dimension", "segment_value"], value)]
    numbered = alerts.join(F.broadcast(first), "model_id").select(
        "model_id", F.lit("alert").alias("section"), F.struct(F.col("kind").alias("name"), F.col("signal_name").alias("method"), "segment_dimension", "segment_value").alias("series"),
        F.struct("feature_name", "status", end("opened_window"), end("escalated_window"), end("resolved_window"), end("last_seen_window"), F.round("evidence_statistic", 4).alias("evidence"), "evidence_threshold").alias("p"),
    ).groupBy("model_id", "section", "series").agg(F.sort_array(F.collect_list("p")).alias("alerts"))
    out = reduce(DataFrame.unionByName, parts)
    return out.unionByName(numbered, allowMissingColumns=True)


def sensitivity_grid(live: DataFrame, profiled: DataFrame, counted: DataFrame, model: Model, profile: Profile, feature: str, cells: list[tuple[float, float]], key: str = "prediction_id", seed: int = 0) -> DataFrame:
    """What a shift of ``feature`` would do, for each cell ``(share, magnitude)``: one row a cell.

    In a cell a share of the rows, drawn by a hash of ``key``, is raised by
    ``magnitude`` standard deviations of the baseline.  Live rows are read once, for
    all cells: what moves are counts by cell, window, slice and bucket.  Signals
    are the slices; one whose every window is refused by its noise ceiling or its
    size is ``refused``, one with a breach as long as the profile asks for
    ``opens``, others are ``quiet``.  In cells that shift nothing, what opens is a
    false alarm.
    """
    spark, gate = live.sparkSession, profile.gates["psi"]
    values = counted.where((F.col("feature_name") == feature) & F.col("segment_dimension").isNull())
    n, x = F.col("n"), F.col("num")
    variance = (F.sum(n * x * x) - F.sum(n * x) * F.sum(n * x) / F.sum(n)) / (F.sum(n) - 1)
    sd = values.agg(F.sqrt(variance).alias("sd"))
    grid = spark.createDataFrame([(s, m, int(s * (1 << 32))) for s, m in cells], "share double, magnitude double, below long")
    grid = grid.crossJoin(sd).select("share", "magnitude", "below", F.round(F.col("magnitude") * F.col("sd"), 6).alias("amount"))  # one row a cell
    bins = profiled.where(F.col("feature_name") == feature).select(*[F.col(c).alias(f"_{c}") for c in SLICE], "edges", "buckets", F.col("counts").alias("base"), "n_baseline")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    rows = slices(live.where(F.col(feature).isNotNull()).withColumn("draw", draw), model).select(*KEYS, *SLICE, "draw", F.col(feature).cast("double").alias("value"))
    edges = F.broadcast(bins.where("_segment_dimension is null").select("edges"))  # one row: slices have the bins of the whole
    shifted = rows.join(F.broadcast(grid)).join(edges).select(*KEYS, *SLICE, "share", "magnitude", bucket_of(F.col("value") + F.when(F.col("draw") < F.col("below"), F.col("amount")).otherwise(0.0), F.col("edges")).alias("bucket"))
    counts = shifted.groupBy(*KEYS, *SLICE, "share", "magnitude", "bucket").agg(F.count("*").alias("n"))
    sums = counts.groupBy(*KEYS, *SLICE, "share", "magnitude").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("counts"), F.sum("n").alias("n_live"))
    whole = live.groupBy(*KEYS).agg(F.count("*").alias("n_window"))
    j = sums.join(whole, KEYS).join(bins, F.col("segment_dimension").eqNullSafe(F.col("_segment_dimension")) & F.col("segment_value").eqNullSafe(F.col("_segment_value")))
    as_double = lambda c: F.transform(c, lambda v: v.cast("double"))
    statistic = psi(as_double(F.col("base")), as_double(dense(F.col("counts"), F.col("buckets"))))
    _, ceiling = psi_floor(F.col("n_baseline"), F.col("n_live"), F.col("buckets"))
    inside = F.col("segment_dimension").isNotNull()
    refused = (F.col("n_window") < profile.min_window_size) | (inside & (F.col("n_live") < model.min_segment_size)) | (ceiling > gate.clear)
    j = j.where((F.col("n_window") >= profile.min_window_size) | ~inside).withColumns({"statistic": F.when(~refused, statistic), "status": F.when(refused, "not_computable").otherwise("computed")})
    signal = [*SLICE, "model_id", "share", "magnitude"]
    runs = with_runs(j.withColumn("class", classify(F.col("statistic"), F.col("status"), gate)), signal)
    longest = F.coalesce(F.max(F.when(F.col("class") == "breach", F.col("run_length"))), F.lit(0))
    some = lambda c: F.sum(c.cast("int")).cast("long")
    per = runs.groupBy(*signal).agg(F.count("*").alias("windows"), some(F.col("class") == "not_computable").alias("refused_windows"), longest.alias("longest"), F.max("statistic").alias("peak"))
    gone, opens = F.col("refused_windows") == F.col("windows"), F.col("longest") >= profile.fire_persistence
    clean = (F.col("share") == 0) | (F.col("magnitude") == 0)
    out = per.groupBy("share", "magnitude").agg(F.count("*").alias("signals"), some(opens).alias("opens"), some(gone).alias("refused"), F.sum("refused_windows").alias("refused_windows"), F.max("peak").alias("peak"))
    return out.withColumn("quiet", F.col("signals") - F.col("opens") - F.col("refused")).withColumn("false_open_rate", F.when(clean, F.try_divide("opens", F.col("signals") - F.col("refused"))))
