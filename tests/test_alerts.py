"""The state machine, rollups, outbox, ingestion and streams."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidegauge.config import Feature, Gate, Metric, Model, Profile
from tidegauge.operators import alerts as al
from tidegauge.operators import streaks as st
from tidegauge.operators.profile import baseline_profile, freeze
from tidegauge.operators.shape import with_window
from tidegauge.operators.validate import validated
from tidegauge.sources import ingest as ig

GATES = {m: Gate(0.2, 0.1) for m in ("psi", "ks", "chi_square", "jsd")}
P = Profile(gates=GATES, fire_persistence=2, escalate_persistence=4, resolve_persistence=3, not_computable_persistence=2, history_scan_windows=6, max_alerts_per_run=3)
T0 = dt.datetime(2026, 1, 1)
RESULTS = "model_id string, feature_name string, segment_dimension string, segment_value string, test_method string, window_end timestamp, status string, statistic double, not_computable_reason string"


def results(spark, values, features=("age",)):
    rows = [
        ("m", f, None, None, "psi", T0 + dt.timedelta(hours=i), "not_computable" if v is None else "computed", v, "too few" if v is None else None) for f in features for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, RESULTS)


def alerts(spark, values, profile=P, features=("age",)):
    return [r.asDict(True) for r in al.alert_lifecycle(al.alert_events(results(spark, values, features), None, profile), profile).collect()]


B, C, D, N = 0.5, 0.05, 0.15, None


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ([B], []),
        ([B, B], [("drift", "open")]),
        ([B, B, B, B], [("drift", "escalated")]),
        ([B, B, C, C], [("drift", "open")]),
        ([B, B, C, C, C], [("drift", "resolved")]),
        ([B, B, C, C, D, C], [("drift", "open")]),
        ([B, D, B, D], []),
        ([B, B, N, B, B], [("drift", "open")]),
        ([N, N], [("not_computable", "open")]),
        ([N, N, C], [("not_computable", "resolved")]),
        ([B, B, C, C, C, B, B], [("drift", "open"), ("drift", "resolved")]),
    ],
)
def test_lifecycle(spark, values, want):
    assert sorted((a["kind"], a["status"]) for a in alerts(spark, values)) == sorted(want)


def test_evidence_is_frozen(spark):
    (a,) = alerts(spark, [0.3, 0.31, 0.4, 0.42, 0.9])
    assert a["evidence_statistic"] == 0.31 and a["escalation_statistic"] == 0.42 and a["breaching"] == 5


def test_rollup(spark):
    many = alerts(spark, [B, B], features=tuple("abcde"))
    assert [(a["is_aggregate"], a["aggregated_signal_count"]) for a in many] == [(True, 5)] and len(many[0]["aggregated_signals"]) == 5
    # The signals open again in the next run while their streaks hold; a quiet run resolves the aggregate.
    again = alerts(spark, [B, B, B], features=tuple("abcde"))
    assert len(again) == 1 and again[0]["status"] == "open"
    quiet = alerts(spark, [B, B, C], features=tuple("abcde"))
    assert [a["status"] for a in quiet] == ["resolved"]
    assert len(alerts(spark, [B, B], features=tuple("abc"))) == 3


def test_streaks_and_episodes(spark):
    r = st.classified_drift(results(spark, [B, C, B, B]), P)
    s = st.current_streaks(r, ["feature_name"], 6).first()
    assert (s["class"], s["streak"]) == ("breach", 2)
    e = st.suppressed_episodes(r, ["feature_name"], 3, "breach").orderBy("first_window").collect()
    assert [x["length"] for x in e] == [1, 2]
    assert st.current_streaks(r, ["feature_name"], 1).first()["streak"] == 1


def test_outbox_gives_up_after_five(spark):
    events = al.alert_events(results(spark, [B, B]), None, P)
    a = al.alert_lifecycle(events, P)
    delivered = a.select(*al.SIGNAL, "opened_window", F.lit(None).cast("string").alias("last_notified_status"), F.lit(0).alias("notification_attempts"))
    for attempt in range(1, 6):
        box = al.outbox(a, delivered)
        assert box.first()["attempt"] == attempt
        delivered = spark.createDataFrame(al.after_delivery(box.withColumns({"ok": F.lit(False), "error": F.lit("down")})).collect(), "model_id string, kind string, signal_name string, feature_name string, segment_dimension string, segment_value string, opened_window timestamp, last_notified_status string, notification_attempts int, last_notification_error string")
    assert al.outbox(a, delivered).count() == 0
    # The next transition is announced by the run that made it, once.
    later = al.alert_lifecycle(al.alert_events(results(spark, [B, B, B, B]), None, P), P)
    now = results(spark, [B, B, B, B]).where(F.col("window_end") == T0 + dt.timedelta(hours=3))
    assert al.outbox(later, delivered).count() == 0 and al.outbox(later, delivered, evaluated=now).first()["attempt"] == 6
    assert al.touched(later, now).count() == 1 and al.touched(later, now.limit(0)).count() == 0


def test_only_the_newest_revision_counts(spark):
    metric = Profile(gates=GATES, metrics=(Metric("pr_auc", gate=Gate(0.3, 0.5, "below")),), fire_persistence=2, escalate_persistence=4, resolve_persistence=3, not_computable_persistence=2, history_scan_windows=6)
    rows = [("m", "pr_auc", None, None, T0 + dt.timedelta(hours=h), "computed", v, None, rev, rev) for h, v, rev in ((0, 0.1, 1), (0, 0.2, 2), (0, 0.25, 3), (1, 0.9, 1), (2, 0.1, 1), (2, 0.9, 2))]
    r = spark.createDataFrame(rows, "model_id string, metric_name string, segment_dimension string, segment_value string, window_end timestamp, status string, metric_value double, not_computable_reason string, revision_id long, computed_at long")
    events = al.alert_events(None, r, metric)
    assert sorted((e["class"], e["streak"], e["value"]) for e in events.where("kind = 'performance'").collect()) == [("breach", 1, 0.25), ("clear", 1, 0.9), ("clear", 2, 0.9)]
    assert al.alert_lifecycle(events, metric).count() == 0


def test_trace_of_a_lifecycle(spark):
    e = al.alert_events(results(spark, [C, B, B, B, B, C, C, C, B]), None, P)
    t = al.lifecycle_trace(e.where("kind = 'drift'"), al.alert_lifecycle(e, P)).orderBy("window_end")
    assert [r["phase"] for r in t.collect()] == ["quiet", "counting", "open", "open", "escalated", "escalated", "escalated", "quiet", "counting"]


def test_label_noise_takes_any_key(spark):
    from tidegauge.plans.reports import label_noise

    d = spark.createDataFrame([(10**18 + i, 1.0) for i in range(2_000)], "k long, y double")
    share = label_noise(d, "y", F.col("k"), 0.7, F.lit(True)).agg(F.avg("y")).first()[0]
    assert 0.25 < share < 0.35 and label_noise(d, "y", F.col("k"), 0.7, F.lit(False)).agg(F.avg("y")).first()[0] == 1


def test_validation(spark):
    m = Model((Feature("age", "continuous"), Feature("income", "continuous", nullable=True), Feature("region", "categorical")))
    rows = ['{"age": 1, "region": "EU"}', '{"age": true, "region": 3, "zip": 1}', '{"age": "x"}', '{"age": null, "income": null, "region": false}', None]
    got = [r["errors"] for r in validated(spark.createDataFrame([(x,) for x in rows], "features string"), m).collect()]
    assert got[0] == [] and got[3] == ["feature 'age' is required"]
    assert got[1] == ["unknown features: ['zip']", "feature 'age' must be numeric", "feature 'region' must be a string or boolean"]
    assert got[2] == ["feature 'age' must be numeric", "feature 'region' is required"] and len(got[4]) == 2


def test_ingest(spark):
    kind = "model_id string, prediction_id long, v double"
    batch = spark.createDataFrame([("m", 1, 1.0), ("m", 1, 1.0), ("m", 2, 2.0), ("m", 3, 3.0), ("m", 4, 1.0), ("m", 4, 2.0)], kind)
    store = ig.with_hash(spark.createDataFrame([("m", 2, 2.0), ("m", 3, 9.0)], kind), ["v"])
    parts = ig.predictions(batch, store, ["v"])
    ids = {n: sorted(r["prediction_id"] for r in getattr(parts, n).select("prediction_id").distinct().collect()) for n in parts._fields}
    assert ids == {"insert": [1], "skip": [2], "conflict": [3], "reject": [4]}


def test_baseline_is_not_replaced_silently(spark, tmp_path):
    rows = spark.createDataFrame([(1.0,)], "x double")
    ig.register_baseline(rows, str(tmp_path), "m", 1)
    with pytest.raises(ValueError):
        ig.register_baseline(rows, str(tmp_path), "m", 2)
    ig.register_baseline(rows, str(tmp_path), "m", 2, replace_active=True)
    assert [r["baseline_id"] for r in ig.active_baseline(spark, str(tmp_path), "m").collect()] == [2]
    model = Model((Feature("x", "continuous"),), score=None)
    bad = ig.register_baseline(spark.createDataFrame([(1.0,), (None,)], "x double"), str(tmp_path), "n", 1, model)
    assert [r["errors"] for r in bad.collect()] == [["feature 'x' is required"]]
    assert ig.register_baseline(spark.createDataFrame([(float(i),) for i in range(20)], "x double"), str(tmp_path), "n", 1, model) is None
    assert ig.active_baseline(spark, str(tmp_path), "n", "bins").first()["edges"][-1] == 19 and ig.active_baseline(spark, str(tmp_path), "n", "profiles").first()["n_baseline"] == 20


def test_backfill_is_repeatable(spark, tmp_path):
    from tidegauge.plans.backfill import Store

    model = Model((Feature("x", "continuous"),), score=None)
    p = replace(P, window="12h", min_window_size=10, continuous=("psi",))
    live = with_window(spark.createDataFrame([("m", i, T0 + dt.timedelta(hours=i / 4), float(i % 17)) for i in range(480)], "model_id string, prediction_id long, predicted_at timestamp, x double"), "predicted_at", "12h")
    base = spark.createDataFrame([(float(i % 17),) for i in range(300)], "x double")
    frozen = freeze(base, model)
    store = Store(spark, str(tmp_path), model, p, base, frozen, baseline_profile(base, model, simulate=False, frozen=frozen), gated=False)
    rows = lambda: sorted(map(repr, store.drift().drop("evaluation").collect()))
    assert store.evaluate(live, None, "2026-01-01", "2026-01-02") == 4 and store.evaluate(live, None, "2026-01-01", "2026-01-02") == 0
    first = rows()
    assert store.evaluate(live, None, "2026-01-01", "2026-01-02", force=True) == 4 and rows() == first
    assert store.evaluate(live, None, "2026-01-01", "2026-01-05") == 6 and store.windows().count() == 10 and len(rows()) == 10
    assert store.windows().where("evaluation > 1").count() == 10 and store.windows().agg(F.sum("n_predictions")).first()[0] == 480
    assert store.compact("2026-01-01", "2026-01-05") > 0 and store.windows().count() == 10 and len(rows()) == 10
    folded = store.fold_alerts()
    want = al.alert_lifecycle(al.alert_events(store.drift(), None, p), p)
    assert sorted(map(repr, folded.drop("config_hash").collect())) == sorted(map(repr, want.collect()))


def small_store(spark, folder, **more):
    from tidegauge.plans.backfill import Store

    model = Model((Feature("x", "continuous"),), score=None)
    p = replace(P, window="12h", min_window_size=10, continuous=("psi",))
    live = spark.createDataFrame([("m", i, T0 + dt.timedelta(hours=i / 2), float(i % 17)) for i in range(96)], "model_id string, prediction_id long, predicted_at timestamp, x double")
    live.coalesce(1).write.mode("overwrite").parquet(f"{folder}/live")
    live = with_window(spark.read.parquet(f"{folder}/live"), "predicted_at", "12h")
    base = spark.createDataFrame([(float(i % 17),) for i in range(300)], "x double")
    frozen = freeze(base, model)
    return Store(spark, f"{folder}/store", model, p, base, frozen, baseline_profile(base, model, simulate=False, frozen=frozen), gated=False, **more), live


def test_alerts_go_on_day_by_day(spark, tmp_path):
    """Days folded one after another, one of them tried twice, give what the whole history gives; transitions are those of the last day's windows."""
    store, live = small_store(spark, tmp_path)
    store.profile = replace(store.profile, window="12h", fire_persistence=1, escalate_persistence=2, resolve_persistence=1)
    shifted = live.withColumn("x", F.when(F.col("prediction_id") >= 24, F.col("x") + 9).otherwise(F.col("x")))
    assert store.evaluate(shifted, None, "2026-01-01", "2026-01-02") == 4
    first = store.fold_days("2026-01-01", "2026-01-01")
    kinds = "model_id string, kind string, signal_name string, feature_name string, segment_dimension string, segment_value string, opened_window timestamp, last_notified_status string, notification_attempts int"
    assert [(r["kind"], r["status"]) for r in first.collect()] == [("drift", "open")]
    second = store.fold_days("2026-01-02", "2026-01-02")
    columns = [c for c in al.ALERTS if c != "aggregated_signals"]
    rows = lambda df: sorted(repr([r[c] for c in columns]) for r in df.collect())
    assert rows(second) == rows(store.fold_alerts()) and second.first()["status"] == "escalated"
    sent = spark.createDataFrame([tuple(r[c] for c in al.SIGNAL) + (r["opened_window"], "open", 0) for r in first.collect()], kinds)
    assert [r["event"] for r in store.transitions(second, sent, "2026-01-02", "2026-01-02").collect()] == ["escalated"]


def test_racing_evaluations_leave_one(spark, tmp_path):
    import threading

    store, live = small_store(spark, tmp_path)
    counts = []
    threads = [threading.Thread(target=lambda: counts.append(store.evaluate(live, None, "2026-01-01", "2026-01-02"))) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(counts) == 4 and len(counts) == 3 and store.windows().count() == 4 and store.drift().count() == 4
    assert store._windows.all().count() == 4 and store._keyed("drift").all().count() == 4  # nothing was computed twice


def test_claims_of_failed_and_dead_processes(spark, tmp_path, monkeypatch):
    from tidegauge.plans import backfill

    store, live = small_store(spark, tmp_path)
    with monkeypatch.context() as m:
        m.setattr(backfill, "drift", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.evaluate(live, None, "2026-01-01", "2026-01-01")
    assert store.windows() is None
    store._claimed([("m", dt.date(2026, 1, 1))])  # a process that died after its claim
    assert store.evaluate(live, None, "2026-01-01", "2026-01-02") == 2  # the other day alone
    store.claim_seconds = 0
    assert store.evaluate(live, None, "2026-01-01", "2026-01-02") == 2 and store.windows().count() == 4


def test_one_day_reads_one_day(spark, tmp_path, capsys):
    """Both bounds of the event time reach the scan."""
    store, live = small_store(spark, tmp_path)
    from tidegauge.operators.shape import calendar_range

    store._within(live, *calendar_range("2026-01-02", "2026-01-02"), "predicted_at").explain("formatted")
    pushed = next(line for line in capsys.readouterr().out.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(predicted_at" in pushed and "LessThan(predicted_at" in pushed


def test_marks_during_a_recompute_stay(spark, tmp_path, monkeypatch):
    """A label that comes while its window is computed leaves the window stale."""
    from tidegauge.plans import backfill

    store, live = small_store(spark, tmp_path)
    store.model, store.profile = replace(store.model, score="x"), replace(store.profile, metrics=(Metric("rmse"),))
    store.profiled = baseline_profile(store.baseline, store.model, simulate=False, frozen=(frozen := freeze(store.baseline, store.model)))
    store.bins = frozen
    labels = lambda *ids: spark.createDataFrame([("m", i, i, 1.0, T0) for i in ids], "model_id string, prediction_id long, label_id long, label_value double, received_at timestamp")
    assert store.evaluate(live, labels(1), "2026-01-01", "2026-01-02") == 4
    store.note(live, labels(2), live.where("prediction_id = 30"))
    stale = lambda: [(r["window_start"], r["n_labels"], r["late_prediction_count"]) for r in store.windows().where("performance_stale").collect()]
    assert stale() == [(T0, 1, 0)] and store.windows().agg(F.sum("late_prediction_count")).first()[0] == 1
    before = backfill.performance

    def meanwhile(*a):
        store.note(live, labels(3))
        return before(*a)

    with monkeypatch.context() as m:
        m.setattr(backfill, "performance", meanwhile)
        assert store.recompute(live, labels(1, 2)) == 1
    assert [s[0] for s in stale()] == [T0]
    assert store.recompute(live, labels(1, 2, 3)) == 1 and stale() == [] and store.recompute(live, labels(1, 2, 3)) == 0
    assert store.windows().where("n_labels = 3").count() == 1
    revisions = store.performance().where(F.col("window_start") == T0).orderBy("revision_id").collect()
    assert [(r["n_labeled"], r["is_retroactive"]) for r in revisions] == [(1, False), (2, True), (3, True)]
