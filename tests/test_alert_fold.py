"""The native alert machine against one that walks window by window, whole and day by day."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.config import Gate, Metric, Profile
from tidegauge.operators import alerts as al

GATES = {m: Gate(0.2, 0.1) for m in ("psi", "ks", "chi_square", "jsd")}
P = Profile(
    gates=GATES, metrics=(Metric("pr_auc", gate=Gate(0.3, 0.5, "below")),), fire_persistence=2, escalate_persistence=4, resolve_persistence=2, not_computable_persistence=2, history_scan_windows=6, max_alerts_per_run=3
)
T0 = dt.datetime(2026, 1, 1)
DRIFT = "model_id string, feature_name string, segment_dimension string, segment_value string, test_method string, window_end timestamp, status string, statistic double, not_computable_reason string"
METRIC = "model_id string, metric_name string, segment_dimension string, segment_value string, window_end timestamp, status string, metric_value double, not_computable_reason string"


def walk(events, p, cap):
    """Alerts after all windows: every signal's state and every run's rollup, one window at a time."""
    alive, aggregate, done = {}, {}, []
    for at in sorted({e["window_end"] for e in events}):
        rows = [e for e in events if e["window_end"] == at]
        opened = []
        for e in rows:
            key = tuple(e[c] for c in al.IDENTITY)
            nc, a = e["kind"] == "not_computable", alive.get(key)
            if a is None:
                if (e["class"], e["streak"] >= (p.not_computable_persistence if nc else p.fire_persistence)) == ("not_computable" if nc else "breach", True):
                    alive[key] = {
                        **{c: e[c] for c in al.SIGNAL}, "status": "open", "opened_window": at, "last_seen_window": at, "escalated_window": None, "resolved_window": None, "breaching": 0 if nc else e["streak"], "clear": 0,
                        "evidence_statistic": e["value"], "evidence_threshold": None if nc else e["threshold"], "evidence_reason": e["reason"], "escalation_statistic": None, "escalation_threshold": None,
                        "is_aggregate": False, "aggregated_signal_count": None, "aggregated_signals": None, "source": e["source"],
                    }
                    opened.append(key)
                continue
            a["last_seen_window"] = at
            resolved = e["class"] != "not_computable" if nc else e["class"] == "clear" and e["streak"] >= p.resolve_persistence
            if not nc and e["class"] != "not_computable":
                a["breaching"], a["clear"] = (e["streak"] if e["class"] == k else 0 for k in ("breach", "clear"))
            if not nc and e["class"] == "breach" and a["status"] == "open" and e["streak"] >= p.escalate_persistence:
                a.update(status="escalated", escalated_window=at, escalation_statistic=e["value"], escalation_threshold=e["threshold"])
            if resolved:
                a.update(status="resolved", resolved_window=at)
                done.append(alive.pop(key))
        for g in {tuple(e[c] for c in al.GROUP) for e in rows} if cap is not None else ():
            mine, a = [k for k in opened if k[:3] == g], aggregate.get(g)
            if len(mine) <= cap:
                if a:
                    a.update(status="resolved", resolved_window=at)
                    done.append(aggregate.pop(g))
                continue
            for k in mine:
                del alive[k]
            if a is None:
                a = aggregate[g] = {
                    **dict.fromkeys(al.ALERTS), "model_id": g[0], "kind": g[1], "source": g[2], "signal_name": f"aggregate-{g[1]}", "status": "open", "opened_window": at, "breaching": 0, "clear": 0,
                    "evidence_reason": al.ROLLED_UP % (len(mine), cap), "is_aggregate": True,
                }
            signals = sorted([k[3:] for k in mine], key=lambda k: [(x is not None, x or "") for x in k])
            a.update(last_seen_window=at, aggregated_signal_count=len(mine), aggregated_signals=[dict(zip(("signal_name", "feature_name", "segment_dimension", "segment_value"), k, strict=True)) for k in signals])
    return [*done, *alive.values(), *aggregate.values()]


def plain(rows):
    return sorted(repr([r[c] for c in al.ALERTS]) for r in rows)


def results(spark, seed, windows=24, signals=14):
    """Random histories with stretches of each class and storms in which all signals breach; drift and performance, some gaps."""
    rng = np.random.default_rng(seed)
    drift, metric = [], []
    storm = np.repeat(rng.random(windows // 3 + 1) < 0.4, 3)[:windows]
    for s in range(signals):
        value = np.repeat(rng.choice([0.5, 0.05, 0.15, np.nan], windows), rng.integers(1, 5, windows))[:windows]
        for w in range(windows):
            v = 0.4 if storm[w] and rng.random() < 0.9 else value[w]
            v = None if np.isnan(v) else round(float(v) + s / 1000, 6)
            status, reason = ("not_computable", f"few in {w}") if v is None else ("computed", None)
            at = T0 + dt.timedelta(hours=w)
            if rng.random() < 0.93:
                drift.append(("mn"[s % 2], f"f{s // 4}", [None, "g"][s % 4 > 1], [None, f"v{s % 4}"][s % 4 > 1], ["psi", "ks"][s % 3 == 0], at, status, v, reason))
            metric.append(("m", "pr_auc", [None, "g"][s > 0], [None, f"v{s}"][s > 0], at, status, v, reason))
    unique = {tuple(r[:6]): r for r in drift}
    return spark.createDataFrame(list(unique.values()), DRIFT), spark.createDataFrame(metric, METRIC)


@pytest.mark.parametrize(("seed", "cap"), [(1, 3), (2, 1), (3, 6), (4, None)])
def test_fold_and_rollup(spark, seed, cap):
    p = replace(P, max_alerts_per_run=cap or 25)
    events = al.alert_events(*results(spark, seed), p).cache()
    got = al.alert_lifecycle(events, p, rollup=cap is not None).collect()
    want = walk([r.asDict() for r in events.collect()], p, cap)
    assert plain(got_rows := [r.asDict(True) for r in got]) == plain(want)
    assert {r["kind"] for r in got_rows} == {"drift", "performance", "not_computable"} and {r["status"] for r in got_rows} >= {"open", "resolved"}
    assert cap is None or any(r["is_aggregate"] for r in got_rows)


def test_day_by_day_from_stored_state(spark):
    """Each day reads its own windows, the open alerts and the last runs; together they give the whole history's alerts."""
    drift, metric = results(spark, 7)
    whole = al.alert_lifecycle(al.alert_events(drift, metric, P), P).collect()
    runs, alive, finished = None, None, []
    for day in range(3):
        lo, hi = T0 + dt.timedelta(hours=8 * day), T0 + dt.timedelta(hours=8 * day + 8)
        part = lambda df: df.where((F.col("window_end") >= lo) & (F.col("window_end") < hi))  # noqa: B023, E731
        events = al.alert_events(part(drift), part(metric), P, runs).cache()
        alerts = al.alert_lifecycle(events, P, open_alerts=alive).collect()
        finished += [r for r in alerts if r["status"] == "resolved"]
        schema = al.alert_lifecycle(events, P, rollup=False).schema
        alive = spark.createDataFrame([r for r in alerts if r["status"] != "resolved"], schema)
        new = al.last_runs(events)
        runs = spark.createDataFrame((new if runs is None else new.unionByName(runs.join(new, [c for c in al.IDENTITY if c not in ("kind", "feature_name", "segment_dimension", "segment_value")], "left_anti"))).collect(), new.schema)
    assert plain([r.asDict(True) for r in [*finished, *alive.collect()]]) == plain([r.asDict(True) for r in whole])


def test_ten_thousand_signals_in_one_run(spark):
    """A crowded run is counted and rolled up by many tasks; no task holds its signals but the one that lists them in the alert."""
    rows = spark.range(10_000).select(
        F.lit("m").alias("model_id"), F.concat(F.lit("f"), "id").alias("feature_name"), F.lit(None).cast("string").alias("segment_dimension"), F.lit(None).cast("string").alias("segment_value"), F.lit("psi").alias("test_method"),
        F.explode(F.array(*[F.lit(T0 + dt.timedelta(hours=h)) for h in range(4)])).alias("window_end"), F.lit("computed").alias("status"), F.lit(0.5).alias("statistic"), F.lit(None).cast("string").alias("not_computable_reason"),
    )
    events = al._stretches(al.alert_events(rows, None, P), P)
    rolled = al.rolled_runs(events, P.max_alerts_per_run)
    assert sorted(r["window_end"].hour for r in rolled.collect()) == [1, 2, 3]
    signals = al.rolled_signals(events, rolled)
    assert signals.groupBy("window_end").count().where("count = 10000").count() == 3
    (a,) = al.alert_lifecycle(al.alert_events(rows, None, P), P).collect()
    assert a["aggregated_signal_count"] == 10_000 and a["status"] == "open" and a["opened_window"].hour == 1 and a["last_seen_window"].hour == 3
