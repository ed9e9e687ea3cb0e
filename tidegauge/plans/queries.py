"""The registered queries: each applies operators to whole tables of a folder."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import Feature, Metric, Model
from tidegauge.functions.special import chi2_quantile
from tidegauge.operators import alerts as al
from tidegauge.operators import drift as dr
from tidegauge.operators import metrics as me
from tidegauge.operators import profile as pf
from tidegauge.operators import streaks as st
from tidegauge.operators.correction import benjamini_hochberg
from tidegauge.operators.shape import slices
from tidegauge.operators.validate import validated
from tidegauge.plans import backfill as bf
from tidegauge.plans import events as ev
from tidegauge.plans import reports as rp
from tidegauge.sources import ingest as ig
from tidegauge.sources.scratch import scratch_folder, written

R6 = 6
RANGE = ("2024-01-09", "2024-02-02")
DAY, SLICE = "window_start", ["segment_dimension", "segment_value"]


def _day(c: str = DAY):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _r(c: str):
    return F.round(c, R6).alias(c)


def baseline_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _ = ev.baseline_and_live(spark, sf_dir)
    b = pf.frozen_bins(base, ev.EVENTS).where("dtype = 'continuous'")
    return b.select("feature_name", F.posexplode("edges").alias("i", "edge")).select("feature_name", "i", _r("edge"))


def baseline_categories(spark, sf_dir):
    base, _ = ev.baseline_and_live(spark, sf_dir)
    b = pf.frozen_bins(base, ev.EVENTS).where("dtype = 'categorical'")
    return b.where("category is not null").select("feature_name", F.col("position").alias("i"), "category")


def baseline_slices(spark, sf_dir):
    base, _ = ev.baseline_and_live(spark, sf_dir)
    p = pf.baseline_profile(base, ev.EVENTS, simulate=False)
    return p.select("feature_name", *SLICE, "n_baseline", F.posexplode("counts").alias("bucket", "n"))


def bucket_counts(spark, sf_dir):
    base, live = ev.baseline_and_live(spark, sf_dir)
    c = pf.slice_counts(live, ev.EVENTS, pf.freeze(base, ev.EVENTS), ["window_start"])
    return c.select(_day(), "feature_name", *SLICE, F.explode("counts").alias("bucket", "n"))


def _stat(spark, sf_dir, method, where):
    r = ev.drift_of(spark, sf_dir, ev.only(method), gated=False, methods=(method,)).where(where)
    return r.select(_day(), "feature_name", *SLICE, _r("statistic"), "n_baseline", "n_live")


def psi_daily(spark, sf_dir):
    return _stat(spark, sf_dir, "psi", "segment_dimension is null")


def psi_by_segment(spark, sf_dir):
    return _stat(spark, sf_dir, "psi", "segment_dimension is not null")


def ks_daily(spark, sf_dir):
    return _stat(spark, sf_dir, "ks", "segment_dimension is null")


def ks_by_segment(spark, sf_dir):
    return _stat(spark, sf_dir, "ks", "segment_dimension is not null")


def cramers_v_daily(spark, sf_dir):
    return _stat(spark, sf_dir, "chi_square", "segment_dimension is null")


def jsd_score_daily(spark, sf_dir):
    return _stat(spark, sf_dir, "jsd", "true")


def floors_closed_form(spark, sf_dir):
    """Noise ceilings of each day's sample sizes for ``value`` and ``user_group``."""
    base, live = ev.baseline_and_live(spark, sf_dir)
    nb = base.agg(F.count("*").cast("double").alias("nb"))
    n = live.groupBy("window_start").agg(F.count("*").cast("double").alias("nl")).join(F.broadcast(nb))
    a, b = F.col("nb"), F.col("nl")
    mean, ceiling = dr.psi_floor(a, b, F.lit(12))
    return n.select(
        _day(), F.round(mean, R6).alias("psi_mean"), F.round(ceiling, R6).alias("psi_ceiling"), F.round(dr.ks_floor(a, b), R6).alias("ks_ceiling"),
        F.round(dr.cramers_v_floor(a, b, chi2_quantile(F.lit(0.975), F.lit(6))), R6).alias("v_ceiling"), F.round(dr.jsd_floor(a, b, chi2_quantile(F.lit(0.975), F.lit(11))), R6).alias("jsd_ceiling"),
    )


def drift_gated(spark, sf_dir):
    r = ev.drift_of(spark, sf_dir, ev.only("psi"), methods=("psi",))
    return r.select(_day(), "feature_name", *SLICE, "status", _r("statistic"), "is_significant", "not_computable_reason", "n_baseline", "n_live")


def bh_correction(spark, sf_dir):
    """Kolmogorov-Smirnov p-values of all slices of a day, asymptotic ones, corrected together."""
    r = ev.drift_of(spark, sf_dir, ev.only("ks", exact_ks=0), gated=False, methods=("ks",)).drop("corrected_p_value")
    r = benjamini_hochberg(r.withColumn("p_value", F.round("p_value", 9)), ["model_id", "window_start"], alpha=0.1)
    return r.select(_day(), "feature_name", *SLICE, _r("p_value"), _r("corrected_p_value"), "passes_fdr")


def null_floor_table(spark, sf_dir):
    base, _ = ev.baseline_and_live(spark, sf_dir)
    p = pf.baseline_profile(base, ev.EVENTS).where("null_sizes is not null")
    p = p.select("feature_name", *SLICE, F.explode(F.arrays_zip("null_sizes", "null_mean", "null_ceiling")).alias("t")).select("feature_name", *SLICE, "t.*")
    return p.select("feature_name", *SLICE, "null_sizes", _r("null_mean"), _r("null_ceiling"))


def drift_simulated_floor(spark, sf_dir):
    """Drift gated by the simulated nulls, all methods."""
    r = ev.drift_of(spark, sf_dir, ev.DAILY, simulate=True)
    return r.withColumn("window_start", _day()).drop("window_end")


def _performance(spark, sf_dir, labels=None, profile=ev.DAILY):
    p = ev.predictions(spark, sf_dir)
    return me.performance(p, ev.labels(spark, sf_dir) if labels is None else labels, ev.EVENTS, profile)


def perf_daily(spark, sf_dir):
    m = _performance(spark, sf_dir)
    return m.select(_day(), *SLICE, "metric_name", "status", _r("metric_value"), "not_computable_reason", "n_labeled")


def perf_regression(spark, sf_dir):
    """RMSE, and MAE as the total that it is the mean of: an amount of whole cents, where no rounding of a tie decides."""
    model = Model((), ("l_returnflag",))
    pairs = slices(ev.lines(spark, sf_dir), model)
    m = me.evaluate(pairs, (Metric("rmse"), Metric("mae")), ["window_start", *SLICE])
    return m.select(_day(), *SLICE, "metric_name", F.when(F.col("metric_name") == "mae", F.round(F.col("value") * F.col("n_labeled"), 2)).otherwise(F.round("value", 4)).alias("value"), "n_labeled")


def perf_documents(spark, sf_dir):
    """Length as a score of quality: whole corpus and by language."""
    d = ev.table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("prediction_score"))
    pairs = slices(d.join(ev.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label_value")), "doc_id"), Model((), ("lang",)))
    m = me.evaluate(pairs, (Metric("pr_auc"), Metric("roc_auc"), Metric("precision_at_k", {"n": 50})), SLICE)
    return m.select(*SLICE, "metric_name", _r("value"), "n_labeled")


@me.register("brier")
class Brier:
    """Mean squared distance of scores from labels: the sum and the number of rows."""

    def init(self, params):
        return [0.0, 0.0]

    def update(self, state, y, p, params):
        return [state[0] + float(((y - p) ** 2).sum()), state[1] + len(y)]

    def merge(self, a, b, params):
        return [a[0] + b[0], a[1] + b[1]]

    def finish(self, state, params):
        if not state[1]:
            raise ValueError("no rows")
        return state[0] / state[1]


def perf_user_metric(spark, sf_dir):
    """A metric that a user registers, evaluated per day and slice."""
    pairs = slices(me.labelled(ev.predictions(spark, sf_dir), ev.labels(spark, sf_dir)), ev.EVENTS)
    m = me.evaluate(pairs, (Metric("brier"),), ["window_start", *SLICE])
    return m.select(_day(), *SLICE, "metric_name", _r("value"), "n_labeled")


def latest_label(spark, sf_dir):
    return me.latest_label(ev.labels(spark, sf_dir)).select("prediction_id", "label_id", "label_value", _day("received_at"))


def window_labels(spark, sf_dir):
    w = me.window_labels(ev.predictions(spark, sf_dir), ev.labels(spark, sf_dir))
    return w.select(_day(), "n_predictions", "n_labels", _day("label_watermark"))


def _revisions(spark, sf_dir):
    """Performance of each day as first computed (labels received within a day) and again when all had come."""
    m = me.performance_revisions(ev.predictions(spark, sf_dir), ev.labels(spark, sf_dir), ev.EVENTS, ev.DAILY, "24h")
    n = F.when(F.col("is_retroactive"), 2).otherwise(1)
    return m.withColumns({"revision_id": n.cast("long"), "computed_at": n})


def revisions_first_latest(spark, sf_dir):
    r = st.first_and_latest_revision(_revisions(spark, sf_dir), ["window_start", *SLICE, "metric_name"])
    return r.select(_day(), *SLICE, "metric_name", "revision", _r("metric_value"), "n_labeled", "is_retroactive")


def performance_timeline(spark, sf_dir):
    windows = ev.predictions(spark, sf_dir).select("window_start").distinct()
    t = rp.performance_timeline(windows, _revisions(spark, sf_dir), *RANGE, "1d", "pr_auc")
    return t.select(_day(), "revision", _r("value"), "n_labeled", "state", "reason")


def _results(spark, sf_dir, *methods, gated=False):
    """Drift results and their windows, as :func:`_evaluated`."""
    return _evaluated(spark, sf_dir, ev.drift_of(spark, sf_dir, ev.only(*methods), gated=gated, methods=methods))


def _evaluated(spark, sf_dir, results):
    """Results and their windows, every fifth day left out as if it had never been evaluated."""
    _, live = ev.baseline_and_live(spark, sf_dir)
    return results.where("day(window_start) % 5 <> 0"), live.select("model_id", "window_start", "window_end").distinct().where("day(window_start) % 5 <> 0")


def drift_timeline(spark, sf_dir):
    r, w = _results(spark, sf_dir, "psi", gated=True)
    t = rp.drift_timeline(w, r, *RANGE, "1d", "value", "psi")
    return t.select(_day(), _day("window_end"), _r("value"), "is_significant", "state", "reason")


def segment_view(spark, sf_dir):
    r, w = _results(spark, sf_dir, "psi")
    t = rp.segment_view(w, r, *RANGE, "1d", "value", "psi", "event_type")
    return t.select(_day(), "segment", _r("value"), "state", "reason")


def attribution(spark, sf_dir):
    r = ev.drift_of(spark, sf_dir, ev.DAILY, gated=False)
    a = rp.feature_attribution(r, "2024-01-17 00:00:00", ev.EVENTS, ev.DAILY)
    return a.select("feature_name", "test_method", _r("statistic"), "fire_threshold", _r("ratio"), "is_significant", "state")


#: A profile whose gates lie inside the tables' noise, so that streaks of every kind occur; its cap is never reached.
NOISY = replace(ev.DAILY, gates={m: replace(g, fire=f, clear=c) for (m, g), (f, c) in zip(ev.GATES.items(), ((0.03, 0.02), (0.05, 0.035), (0.04, 0.03), (0.004, 0.003)), strict=True)}, max_alerts_per_run=1_000)
TEST = ["test_method", "feature_name", *SLICE]


def _noisy(spark, sf_dir, *methods):
    """Ungated results of all slices under the noisy profile: of all methods, or of some."""
    r = ev.drift_of(spark, sf_dir, NOISY, gated=False, methods=methods or None)
    return r.withColumn("statistic", F.round("statistic", R6))


def streaks(spark, sf_dir):
    return st.current_streaks(st.classified_drift(_noisy(spark, sf_dir), NOISY), TEST, NOISY.history_scan_windows)


def suppressed_episodes(spark, sf_dir):
    e = st.suppressed_episodes(st.classified_drift(_noisy(spark, sf_dir), NOISY), TEST, NOISY.fire_persistence + 1, "breach")
    return e.select(*TEST, _day("first_window"), _day("last_window"), "length", _r("peak"), "kind")


def _noisy_metrics(spark, sf_dir):
    """Performance in two revisions, of which only the newest counts."""
    return _revisions(spark, sf_dir).withColumn("metric_value", F.round("metric_value", R6))


def suppressed_report(spark, sf_dir):
    """Runs too short to alert, of drift and of performance, by its newest revision."""
    e = rp.all_suppressed(_noisy(spark, sf_dir), _noisy_metrics(spark, sf_dir), NOISY)
    return e.select(*TEST, "kind", _day("first_window"), _day("last_window"), "length", _r("peak"))


def _events(spark, sf_dir):
    return al.alert_events(_noisy(spark, sf_dir), None, NOISY)


def _alerts(spark, sf_dir):
    return al.alert_lifecycle(_events(spark, sf_dir), NOISY)


ALERT = ["signal_name", "feature_name", *SLICE]


def alert_lifecycle(spark, sf_dir):
    a = _alerts(spark, sf_dir)
    return a.select("kind", *ALERT, "status", _day("opened_window"), _day("last_seen_window"), _day("escalated_window"), _day("resolved_window"),
                    "breaching", "clear", _r("evidence_statistic"), "evidence_threshold", _r("escalation_statistic"))


def lifecycle_trace(spark, sf_dir):
    """What every signal's state machine says after each window."""
    e = _events(spark, sf_dir)
    t = al.lifecycle_trace(e.where("kind = 'drift'"), al.alert_lifecycle(e, NOISY))
    return t.select(*ALERT, _day("window_end"), "class", "streak", "phase")


def touched_alerts(spark, sf_dir):
    """Alerts that the windows of the last five days opened or changed."""
    _, live = ev.baseline_and_live(spark, sf_dir)
    w = live.where("window_start >= timestamp_ntz'2024-01-26'").select("model_id", "window_end").distinct()
    return al.touched(_alerts(spark, sf_dir), w).select("kind", *ALERT, "status", _day("opened_window"), _day("last_seen_window"))


def run_totals(spark, sf_dir):
    _, live = ev.baseline_and_live(spark, sf_dir)
    r = written(_noisy(spark, sf_dir), "noisy")  # used by several of the items
    return rp.run_totals(live.select("model_id", "window_start").distinct(), r, _performance(spark, sf_dir), al.alert_lifecycle(al.alert_events(r, None, NOISY), NOISY))


def evaluation_totals(spark, sf_dir):
    """Totals of the days in range, of which every fifth was never evaluated."""
    p, labels = ev.predictions(spark, sf_dir), ev.labels(spark, sf_dir)
    windows = me.window_labels(p, labels).where("day(window_start) % 5 <> 0")
    return rp.evaluation_totals(windows, labels, p, *RANGE, "1d", "24h")


def alert_kinds(spark, sf_dir):
    """Alerts of all three kinds, of drift and of the newest revisions of performance."""
    a = al.alert_lifecycle(al.alert_events(_noisy(spark, sf_dir), _noisy_metrics(spark, sf_dir), NOISY), NOISY)
    return a.select("kind", "source", *ALERT, "status", _day("opened_window"), _day("last_seen_window"), _day("escalated_window"), _day("resolved_window"),
                    "breaching", "clear", _r("evidence_statistic"), "evidence_threshold", "evidence_reason", _r("escalation_statistic"))


def rolled_up_alerts(spark, sf_dir):
    """The same signals with a cap of two opens a run, so that runs roll up."""
    p = replace(NOISY, max_alerts_per_run=2)
    a = al.alert_lifecycle(al.alert_events(_noisy(spark, sf_dir), _noisy_metrics(spark, sf_dir), p), p)
    name = lambda s: F.concat_ws("|", "kind", "source", s["signal_name"], *[F.coalesce(s[c], F.lit("")) for c in ("feature_name", *SLICE)])
    return a.select(
        "kind", "source", *ALERT, "status", _day("opened_window"), _day("last_seen_window"), _day("escalated_window"), _day("resolved_window"), "is_aggregate", "aggregated_signal_count",
        F.array_join(F.array_sort(F.transform("aggregated_signals", name)), ",").alias("signals"), "evidence_reason",
    )


def alert_rollup(spark, sf_dir):
    """All signals of events with a cap of three opens a run, so that runs roll up."""
    p = replace(NOISY, max_alerts_per_run=3)
    r = ev.drift_of(spark, sf_dir, p)
    a = al.alert_lifecycle(al.alert_events(r, _performance(spark, sf_dir), p), p)
    return a.select("kind", *ALERT, "status", _day("opened_window"), _day("last_seen_window"), "is_aggregate", "aggregated_signal_count", "aggregated_signals", "evidence_reason")


def alert_history(spark, sf_dir):
    h = rp.alert_history(_alerts(spark, sf_dir), "2024-01-15", "2024-01-20")
    return h.select("kind", *ALERT, "status", _day("opened_window"), _day("last_seen_window"))


def alert_windows(spark, sf_dir):
    """Alerts with the windows that opened, escalated and last touched them."""
    _, live = ev.baseline_and_live(spark, sf_dir)
    windows = live.groupBy("model_id", "window_start", "window_end").agg(F.count("*").alias("n_predictions"))
    a = rp.with_windows(_alerts(spark, sf_dir), windows)
    return a.select("kind", *ALERT, "status", _day("opened_start"), "opened_predictions", _day("escalated_start"), "escalated_predictions", _day("last_seen_start"), "last_seen_predictions")


def outbox(spark, sf_dir):
    """Transitions to announce when alerts opened before 2024-01-20 have had their opening announced, those before 2024-01-16 given up, and the last three days were just evaluated."""
    a = _alerts(spark, sf_dir)
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    tries = F.when(F.col("opened_window") < at("2024-01-16"), 5).otherwise(0)
    sent = a.where(F.col("opened_window") < at("2024-01-20")).select(*al.SIGNAL, "opened_window", F.lit("open").alias("last_notified_status"), tries.alias("notification_attempts"))
    _, live = ev.baseline_and_live(spark, sf_dir)
    evaluated = live.where("window_start >= timestamp_ntz'2024-01-28'").select("model_id", "window_end").distinct()
    return al.outbox(a, sent, evaluated=evaluated).select("kind", *ALERT, _day("opened_window"), "status", "event", "attempt")


def evaluated_range(spark, sf_dir):
    """The store after a backfill of 2024-01-12 to 15, one to 19 that skips what is done, and a forced one of 14 and 15."""
    base, live = ev.baseline_and_live(spark, sf_dir)
    model = ev.measured_by(ev.EVENTS, ("psi",))
    frozen = pf.freeze(base, model)
    store = bf.Store(spark, scratch_folder(spark), model, ev.only("psi"), base, frozen, pf.baseline_profile(base, model, simulate=False, frozen=frozen), gated=False)
    labels = ev.labels(spark, sf_dir)
    for first, last, force in (("2024-01-12", "2024-01-15", False), ("2024-01-12", "2024-01-19", False), ("2024-01-14", "2024-01-15", True)):
        store.evaluate(live, labels, first, last, force=force)
    return store.drift().select(_day(), "feature_name", *SLICE, _r("statistic"), "n_live", "evaluation")


def evaluation_windows(spark, sf_dir):
    """Records of the days from 2024-01-12 to 19, evaluated without every ninth event and with the labels of one day;
    then those events and all labels come, and the windows they touch are computed again, but for labels of the 16th."""
    base, live = ev.baseline_and_live(spark, sf_dir)
    model = replace(ev.EVENTS, features=ev.EVENTS.features[:1])
    frozen = pf.freeze(base, model)
    profile = ev.only("psi")
    store = bf.Store(spark, scratch_folder(spark), model, profile, base, frozen, pf.baseline_profile(base, model, simulate=False, frozen=frozen), gated=False, baseline_id=7)
    every, labels = F.col("prediction_id") % 9 == 0, ev.labels(spark, sf_dir)
    at = live.select("model_id", "prediction_id", "predicted_at", "window_start")
    early = labels.join(at, ["model_id", "prediction_id"]).where(F.col("received_at") < F.col("predicted_at") + F.expr("interval 24 hours")).select(*labels.columns)
    store.evaluate(live.where(~every), early, "2024-01-12", "2024-01-19", as_of="2024-02-10 00:00:00")
    store.note(live, labels.join(early, ["model_id", "label_id"], "left_anti"), live.where(every))
    store.recompute(live, labels, as_of="2024-02-11 00:00:00")
    sixteenth = labels.join(at.where("to_date(window_start) = date'2024-01-16'"), ["model_id", "prediction_id"], "left_semi")
    store.note(live, sixteenth)
    r = store.performance().where("metric_name = 'pr_auc' and segment_dimension is null").groupBy("model_id", "window_start").agg(F.count("*").alias("revisions"), F.sum(F.col("is_retroactive").cast("int")).alias("retroactive"))
    w = store.windows().join(r, ["model_id", "window_start"])
    return w.select(
        "model_id", _day(), _day("window_end"), "baseline_id", (F.col("config_hash") == profile.fingerprint()).alias("current_config"), _day("evaluated_at"), _day("performance_computed_at"), _day("label_watermark"),
        "n_predictions", "n_labels", "performance_stale", "late_prediction_count", "revisions", "retroactive",
    )


def policy_backtest(spark, sf_dir):
    r = _noisy(spark, sf_dir, "psi")
    policies = spark.createDataFrame([("loose", 0.02, 0.01, 1), ("middle", 0.03, 0.02, 2), ("strict", 0.05, 0.03, 3)], "policy string, fire double, clear double, persistence int")
    b = rp.policy_backtest(r, policies, ["feature_name", *SLICE])
    return b.select("feature_name", *SLICE, "policy", "longest_breach", "opens", "refused", "clear_windows", _r("peak"))


def shift_injection(spark, sf_dir):
    """PSI of ``value`` when it is raised by 30 for clicks from 2024-01-20 on, and labels flipped with probability 0.7."""
    base, live = ev.baseline_and_live(spark, sf_dir)
    late = F.col("predicted_at") >= F.lit("2024-01-20").cast("timestamp_ntz")
    live = rp.mean_shift(live, "value", 30.0, late & (F.col("event_type") == "click"))
    model = Model(ev.EVENTS.features[:1], ("event_type",))
    model, frozen = replace(model, score=None), pf.freeze(base, model)
    r = dr.drift(live, base, pf.baseline_profile(base, model, simulate=False, frozen=frozen), frozen, model, ev.only("psi"), False)
    return r.select(_day(), *SLICE, _r("statistic"))


def label_noise(spark, sf_dir):
    noisy = rp.label_noise(ev.labels(spark, sf_dir), "label_value", F.col("prediction_id"), 0.7, F.col("received_at") >= F.lit("2024-01-20").cast("timestamp_ntz"))
    return noisy.groupBy(F.date_format("received_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum("label_value").alias("positives"))


def run_expectations(spark, sf_dir):
    r = written(_noisy(spark, sf_dir), "noisy")  # used by several of the checks
    _, live = ev.baseline_and_live(spark, sf_dir)
    a = al.alert_lifecycle(al.alert_events(r, None, NOISY), NOISY)
    expected = spark.createDataFrame([("psi", "value"), ("psi", "k")], "s string, f string")
    checks = [
        rp.expect_windows(live.select("window_start").distinct(), 10), rp.expect_no_significant(r), rp.expect_max_below(r, "value", "psi", 0.25), rp.expect_no_unexpected(a, expected), rp.expect_lifecycle(a, "psi", "value"),
        rp.expect_episodes(st.suppressed_episodes(st.classified_drift(r, NOISY), TEST, 3, "breach"), 5), rp.expect_mean_drop(_performance(spark, sf_dir), "pr_auc", "2024-01-16", NOISY.metrics[0].gate),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def data_range(spark, sf_dir):
    w = ev.predictions(spark, sf_dir).select("model_id", "window_start", "window_end").distinct()
    return rp.data_range(w).select("model_id", F.col("first_day").cast("string"), F.col("last_day").cast("string"), "windows")


def _ingest_batch(spark, sf_dir):
    """All events as a batch: every seventh is sent twice, every eleventh twice with different payloads; half of the rest is stored already, some with another payload."""
    e = ev.table(spark, sf_dir, "events").select(F.lit("events").alias("model_id"), F.col("event_id").alias("prediction_id"), "event_type", "value")
    again = e.where("prediction_id % 7 = 0").unionAll(e.where("prediction_id % 11 = 0").withColumn("value", F.col("value") + 1))
    stored = e.where("prediction_id % 2 = 0").withColumn("value", F.when(F.col("prediction_id") % 20 == 0, F.col("value") - 1).otherwise(F.col("value")))
    return e.unionAll(again), ig.with_hash(stored, ["event_type", "value"])


def ingest_predictions(spark, sf_dir):
    batch, store = _ingest_batch(spark, sf_dir)
    parts = ig.predictions(batch, store, ["event_type", "value"])
    one = lambda df, name: df.select("prediction_id").distinct().withColumn("outcome", F.lit(name))
    out = one(parts.insert, "insert")
    for name in ("skip", "conflict", "reject"):
        out = out.unionAll(one(getattr(parts, name), name))
    return out


def ingest_labels(spark, sf_dir):
    """Labels sent again with every correction, for predictions of which every thirteenth is unknown and every second has its first label stored."""
    batch = ev.labels(spark, sf_dir).withColumn("labeled_at", F.lit(0))
    known = ev.predictions(spark, sf_dir).where("prediction_id % 13 <> 0")
    store = ig.with_hash(batch.where("label_id % 2 = 0 and prediction_id % 2 = 0"), ["label_value", "labeled_at"])
    parts = ig.labels(batch, store, known)
    out = None
    for name in ("insert", "skip", "conflict", "reject"):
        x = getattr(parts, name).select("prediction_id", F.lit({"conflict": "correction", "reject": "unknown"}.get(name, name)).alias("outcome"), "label_value")
        out = x if out is None else out.unionAll(x)
    return out


def bulk_loaded(spark, sf_dir):
    """All events loaded in bulk, and what lies in the table by day."""
    path = scratch_folder(spark, "bulk")
    ig.bulk_load(ev.predictions(spark, sf_dir).select("model_id", "prediction_id", "predicted_at", "event_type", "value"), path, ["event_type", "value"])
    t = spark.read.parquet(path)
    return t.groupBy("model_id", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("payload_hash").alias("payloads"))


def baseline_errors(spark, sf_dir):
    """Events checked as baseline rows of a model that requires ``k`` and takes ``user_id`` for a category: each distinct list of errors, counted."""
    e = ev.table(spark, sf_dir, "events").select("value", F.when(F.col("event_id") % 3 != 0, F.lit(1.0)).alias("k"), F.col("user_id").alias("user_group"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"), F.lit(1).alias("extra"))
    model = Model((Feature("value", "continuous"), Feature("k", "continuous"), Feature("user_group", "categorical"), Feature("event_type", "categorical")), score=None)
    return ig.with_errors(e, model).groupBy(F.array_join("errors", "; ").alias("errors")).agg(F.count("*").alias("n"))


def late_counts(spark, sf_dir):
    """Every ninth event arrives after its day was sealed."""
    p = ev.predictions(spark, sf_dir)
    sealed = p.where("prediction_id % 9 <> 0").select("model_id", "window_start", "window_end").distinct()
    return ig.late_counts(p.where("prediction_id % 9 = 0"), sealed).select(_day(), "late_prediction_count")


def stale_windows(spark, sf_dir):
    """Days touched by labels received on 2024-01-15."""
    p = ev.predictions(spark, sf_dir)
    new = ev.labels(spark, sf_dir).where("received_at >= timestamp_ntz'2024-01-15' and received_at < timestamp_ntz'2024-01-16'")
    return ig.stale_windows(new, p, p.select("model_id", "window_start").distinct()).select(_day())


def unevaluated_windows(spark, sf_dir):
    p = ev.predictions(spark, sf_dir).select("model_id", "window_start", "window_end").distinct()
    done = p.where("day(window_start) % 4 <> 0")
    due = ig.ready(ig.unevaluated(p.withColumn("window_end", F.col("window_end").cast("timestamp_ntz")), done), "2024-01-25 00:05:00", "10m")
    return due.select(_day())


def validation_errors(spark, sf_dir):
    """Events as JSON rows, some of them damaged: text for a number, a number for a category, missing and undeclared features."""
    i = F.col("event_id")
    number, text = F.format_string('"value":%s', F.col("value").cast("string")), F.format_string('"value":"v%d"', i)
    group = F.when(i % 4 == 0, F.lit('"user_group":true')).when(i % 4 == 1, F.format_string('"user_group":%d', i)).when(i % 4 == 2, F.lit('"user_group":"7"'))
    kind = F.when(i % 3 != 0, F.concat(F.lit('"event_type":"'), F.col("event_type"), F.lit('"')))
    extra = F.when(i % 7 == 0, F.lit('"extra":1'))
    k = F.when(i % 2 == 0, F.lit('"k":null')).when(i % 11 == 0, F.lit('"k":[1]'))
    features = F.concat(F.lit("{"), F.array_join(F.array(F.when(i % 5 == 0, text).otherwise(number), group, kind, extra, k), ","), F.lit("}"))
    v = validated(ev.table(spark, sf_dir, "events").select("event_id", features.alias("features")), ev.EVENTS)
    return v.select("event_id", F.size("errors").alias("n_errors"), F.array_join("errors", "; ").alias("errors"))


def trace_export(spark, sf_dir):
    r = ev.drift_of(spark, sf_dir, ev.only("psi"), gated=False, methods=("psi",))
    _, live = ev.baseline_and_live(spark, sf_dir)
    t = ig.trace(live.select("model_id", "window_start", "window_end").distinct(), r, "value", "psi")
    return t.select("model_id", F.explode("points").alias("p"), "windows", "significant").select("model_id", "p.i", "p.value", "windows", "significant")


def run_trace(spark, sf_dir):
    """A run's history by window ordinals: every fifth day is missing and leaves a gap; points and alerts, unnested."""
    gated, noisy = ev.drifts_of(spark, sf_dir, [(ev.only("psi"), True), (NOISY, False)], methods=("psi",))
    r, w = _evaluated(spark, sf_dir, gated)
    revisions = _revisions(spark, sf_dir).where("metric_name = 'pr_auc' and window_start >= timestamp_ntz'2024-01-11' and day(window_start) % 5 <> 0")
    t = rp.run_trace(w, r, revisions, al.alert_lifecycle(al.alert_events(noisy.withColumn("statistic", F.round("statistic", R6)), None, NOISY), NOISY), "1d")
    series = ["section", F.col("series.name").alias("name"), F.col("series.method").alias("method"), F.col("series.segment_dimension").alias("segment_dimension"), F.col("series.segment_value").alias("segment_value")]
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    points = t.where("points is not null").select(*series, F.explode("points").alias("p")).select(*[c for c in ("section", "name", "method", *SLICE)], "p.i", "p.value", "p.status", "p.n", none("int", "escalated"), none("int", "resolved"), none("int", "last_seen"))
    alerts = t.where("alerts is not null").select(*series, F.explode("alerts").alias("p")).select(
        "section", F.concat_ws(" ", "name", "p.feature_name").alias("name"), "method", *SLICE, F.col("p.opened").alias("i"), F.col("p.evidence").alias("value"), "p.status", none("long", "n"), "p.escalated", "p.resolved", "p.last_seen"
    )
    return points.unionByName(alerts)


def sensitivity_grid(spark, sf_dir):
    """PSI of ``value`` when none, half or all rows are raised by a quarter or a whole standard deviation."""
    base, live = ev.baseline_and_live(spark, sf_dir)
    model = replace(ev.EVENTS, features=ev.EVENTS.features[:1], score=None)
    counted = pf.counted_once(base, model)
    profiled = pf.baseline_profile(base, model, simulate=False, counted=counted)
    cells = [(0.0, 0.0), *((s, m) for s in (0.5, 1.0) for m in (0.25, 1.0))]
    g = rp.sensitivity_grid(live, profiled, counted, model, ev.DAILY, "value", cells)
    return g.select("share", "magnitude", "signals", "opens", "quiet", "refused", "refused_windows", _r("peak"), _r("false_open_rate"))


def known_segments(spark, sf_dir):
    s = rp.known_segments(ev.drift_of(spark, sf_dir, ev.only("psi", "chi_square"), gated=False, methods=("psi", "chi_square")))
    return s.select("feature_name", "test_method", "segment_dimension", F.array_join("segments", ",").alias("segments"))


def metric_display(spark, sf_dir):
    d = rp.displayed(_performance(spark, sf_dir), ev.DAILY)
    return d.select(_day(), *SLICE, "metric_name", "display")


QUERIES = {
    f.__name__: f
    for f in (
        baseline_edges, baseline_categories, baseline_slices, bucket_counts, psi_daily, psi_by_segment, ks_daily, ks_by_segment, cramers_v_daily, jsd_score_daily, floors_closed_form, drift_gated,
        bh_correction, null_floor_table, drift_simulated_floor, perf_daily, perf_regression, perf_documents, perf_user_metric, latest_label, window_labels, revisions_first_latest, performance_timeline,
        drift_timeline, segment_view, attribution, streaks, suppressed_episodes, suppressed_report, alert_lifecycle, lifecycle_trace, touched_alerts, run_totals, evaluated_range, evaluation_windows, evaluation_totals, alert_kinds, rolled_up_alerts, alert_rollup, alert_history, alert_windows, outbox, policy_backtest, shift_injection, label_noise,
        run_expectations, data_range, ingest_predictions, ingest_labels, bulk_loaded, baseline_errors, late_counts, stale_windows, unevaluated_windows, validation_errors, trace_export, run_trace, sensitivity_grid, known_segments, metric_display,
    )
}
