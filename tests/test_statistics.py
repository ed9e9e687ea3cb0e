"""Known answers of the statistics, bins, corrections and metrics."""

import math

import pytest
from pyspark.sql import functions as F

from tidegauge.config import AGGRESSIVE, PATIENT, Feature, Gate, Metric, Model, Profile, parse_duration
from tidegauge.functions import columns as col
from tidegauge.functions import special as sp
from tidegauge.operators import drift as dr
from tidegauge.operators import metrics as me
from tidegauge.operators import profile as pf
from tidegauge.operators.correction import benjamini_hochberg
from tidegauge.operators.shape import window_grid
from tidegauge.plans import reports as rp

ONE = Model((Feature("x", "continuous"),), score=None)


def edges(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return pf.frozen_bins(df, ONE).first()["edges"]


def test_edges(spark):
    e = edges(spark, [float(i) for i in range(1, 101)])
    assert len(e) == 11 and e[0] == 1 and e[-1] == 100
    assert edges(spark, [5.0] * 3) == [5.0, 5.0]
    assert edges(spark, [None, None]) == [] and edges(spark, []) == []
    skewed = edges(spark, [1.0] * 50 + [float(i) for i in range(2, 12)])
    assert len(skewed) < 11 and skewed == sorted(set(skewed))


def test_edges_keep_small_scales_and_extremes(spark):
    tiny = [i * 1e-13 for i in range(1, 101)]
    e = edges(spark, tiny)
    assert len(e) == 11 and e[0] == tiny[0] and e[-1] == tiny[-1]
    import numpy as np

    values = np.random.default_rng(3).normal(size=2_000).round(2).tolist()
    assert edges(spark, values) == pytest.approx(sorted(set(np.quantile(values, np.linspace(0, 1, 11)).tolist())))


def test_fine_buckets_rise_with_the_value(spark):
    values = sorted([-1e9, -50.0, -3.0, 0.0, 0.4, 1.0, 1.5, 2.0, 2.9, 3.0, 3.1, 9.0, 70.0, 1e9, float("inf"), float("-inf")])
    e = arr([0, 1, 3])
    got = [scalar(spark, col.fine_bucket(F.lit(v), e)) for v in values]
    assert got == sorted(got) and [g // 16 for g in got] == [scalar(spark, col.bucket_of(F.lit(v), e)) for v in values] and len(set(got)) > 9
    assert scalar(spark, col.fine_bucket(F.lit(5.0), arr([5, 5]))) == 16


def scalar(spark, c):
    return spark.range(1).select(c.alias("r")).first()["r"]


def arr(xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_bucket_of(spark):
    e = arr([1, 2, 3])
    got = [scalar(spark, col.bucket_of(F.lit(float(v)), e)) for v in (0, 1, 1.5, 2.5, 3, 100, float("nan"))]
    assert got == [0, 1, 1, 2, 2, 3, 3]


def test_many_categories_stay_rows(spark):
    """A million categories are numbered and looked up by a join; nothing of them comes to the driver."""
    base = spark.range(1_000_000).select(F.format_string("c%07d", "id").alias("c"))
    model = Model((Feature("c", "categorical"),), score=None)
    counted = pf.value_counts(base, model, [])
    bins = pf.freeze(base, model, counted=counted)
    assert bins.count() == 1_000_000 and pf.shapes(bins).first()["buckets"] == 1_000_001
    live = spark.createDataFrame([("c0000000",), ("c0999999",), ("new",), ("c0500000",)], "c string")
    found = {r["cat"]: r["bucket"] for r in pf.bucketed(pf.value_counts(live, model, []).where("cat is not null"), bins).collect()}
    assert found == {"c0000000": 0, "c0999999": 999_999, "c0500000": 500_000, "new": 1_000_000}
    assert sp.chi2_ppf(0.975, 1_000_000) == pytest.approx(1_002_773.3, abs=1.0) and sp.chi2_sf(999.9, 1_000) == pytest.approx(0.4958, abs=1e-3)


def test_drift_reads_each_side_once(spark, tmp_path, monkeypatch):
    """Of the tables that are written and of the result, two read the events: one the baseline, one the live rows."""
    from tidegauge.operators import profile
    from tidegauge.plans import events as ev
    from tidegauge.sources import scratch

    spark.range(4_000).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-05' + make_dt_interval(0, 0, cast(id * 5 as int))").alias("ts"), (F.col("id") % 97).cast("double").alias("value"), F.lit('{"k": 1}').alias("props"),
        F.col("id").alias("user_id"), F.lit("click").alias("event_type"),
    ).write.parquet(f"{tmp_path}/events.parquet")
    reads = []

    def count(df):
        reads.append(df._jdf.queryExecution().optimizedPlan().toString().count("event_id") > 0 or "props" in df._jdf.queryExecution().optimizedPlan().toString())

    def written(df, name):
        count(df)
        return scratch.written(df, name)

    monkeypatch.setattr(profile, "written", written)
    monkeypatch.setattr(dr, "written", written)
    r = ev.drift_of(spark, str(tmp_path), ev.only("psi", "ks"), gated=False)
    count(r)
    assert r.count() > 0 and sum(reads) == 2


def test_psi_and_jsd(spark):
    want = 2 * 0.1 * math.log(2) + 2 * -0.1 * math.log(0.75)
    assert scalar(spark, col.psi(arr([1, 4, 4, 1]), arr([2, 3, 3, 2]))) == pytest.approx(want)
    eps = 1e-4
    assert scalar(spark, col.psi(arr([10, 0]), arr([0, 10]))) == pytest.approx(2 * (1 - eps) * math.log(1 / eps))
    assert scalar(spark, col.jsd(arr([1, 2]), arr([2, 4]))) == pytest.approx(0)
    assert scalar(spark, col.jsd(arr([1, 0]), arr([0, 3]))) == pytest.approx(1)


def test_chi_square(spark):
    assert scalar(spark, col.chi_square(arr([50, 50, 0]), arr([60, 40, 0]))) == pytest.approx(2.0202, abs=1e-4)
    assert scalar(spark, col.filled_columns(arr([5, 0]), arr([3, 0]))) == 1


def test_special_functions(spark):
    assert sp.chi2_ppf(0.975, 11) == pytest.approx(21.92005, abs=1e-4)
    assert sp.kolmogorov_ppf(0.975) == pytest.approx(1.4802068574, abs=1e-6)
    assert sp.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert sp.chi2_sf(sp.chi2_ppf(0.9, 6), 6) == pytest.approx(0.1, abs=1e-9)


def test_exact_ks_tail(spark):
    """Every D of every pair of sizes up to 12, by counting all orders of the two samples."""
    from collections import Counter
    from math import comb

    for n in range(1, 13):
        for m in range(1, n + 1):
            # Orders by the largest distance so far, in units of 1 / (n m).
            ways = {(0, 0): Counter({0: 1})}
            for i in range(n + 1):
                for j in range(m + 1):
                    if i or j:
                        here = Counter()
                        for before in ((i - 1, j), (i, j - 1)):
                            for d, k in ways.get(before, {}).items():
                                here[max(d, abs(i * m - j * n))] += k
                        ways[i, j] = here
            end, total = ways[n, m], comb(n + m, n)
            for d in end:
                want = sum(k for x, k in end.items() if x >= d) / total
                assert sp.kolmogorov_exact_sf(d / (n * m), n, m) == pytest.approx(want, abs=1e-12) and sp.kolmogorov_exact_sf(d / (n * m), m, n) == pytest.approx(want, abs=1e-12)
    assert sp.kolmogorov_exact_sf(0.04, 3_000, 2_500) == pytest.approx(sp.kolmogorov_sf(0.04 * math.sqrt(3_000 * 2_500 / 5_500)), rel=0.05)
    # Which one is taken goes by the larger sample.
    p = lambda n, m: scalar(spark, sp.kolmogorov_p(F.lit(0.5), F.lit(n), F.lit(m), 20))
    assert p(20, 10) == pytest.approx(sp.kolmogorov_exact_sf(0.5, 20, 10)) and p(21, 10) == pytest.approx(scalar(spark, sp.kolmogorov_tail(F.lit(0.5), F.lit(21), F.lit(10))))


def test_floors(spark):
    k = 1 / 225 + 1 / 75
    mean, ceiling = dr.psi_floor(F.lit(225.0), F.lit(75.0), F.lit(12))
    assert scalar(spark, mean) == pytest.approx(11 * k) and scalar(spark, ceiling) == pytest.approx(11 * k + 2 * math.sqrt(22) * k)


def test_ceiling_lookup(spark):
    t = spark.createDataFrame([([10, 100, 1000], [1.0, 0.5, 0.1])], "null_sizes array<int>, null_ceiling array<double>")
    got = [t.select(pf.ceiling_at(F.lit(n)).alias("c")).first()["c"] for n in (5, 316, 5000)]
    assert got[0] == 1.0 and got[1] == pytest.approx(0.3, abs=1e-3) and got[2] == 0.1


def test_simulated_null_is_near_the_closed_form(spark):
    import numpy as np

    counts = [0] + [90] * 10 + [0]
    profiled = spark.createDataFrame([(f, None, None, "continuous", [0.0, 1.0], counts, 900) for f in ("a", "b")], "feature_name string, segment_dimension string, segment_value string, dtype string, edges array<double>, counts array<int>, n_baseline long")
    a, b = (r.asDict() for r in pf.null_tables(profiled, [75, 5000], 400, 1).orderBy("feature_name").collect())
    mean, ceiling = a["null_mean"], a["null_ceiling"]
    assert ceiling[0] > ceiling[1] and mean[0] == pytest.approx(9 * (1 / 900 + 1 / 75), rel=0.35)
    # Beside multinomial draws of both sides; a signal's table does not depend on the others.
    rng, p = np.random.default_rng(1), np.array(counts) / 900
    for i, size in enumerate((75, 5000)):
        x, q = (np.maximum(rng.multinomial(n, p, 4000) / n, 1e-4) for n in (900, size))
        v = ((q - x) * np.log(q / x)).sum(1)
        assert mean[i] == pytest.approx(v.mean(), rel=0.08) and ceiling[i] == pytest.approx(np.quantile(v, 0.975), rel=0.15)
    alone = pf.null_tables(profiled.where("feature_name = 'b'"), [75, 5000], 400, 1).first().asDict()
    assert alone == b and b["null_mean"] != mean


def test_benjamini_hochberg(spark):
    def run(ps):
        df = spark.createDataFrame([("m", p) for p in ps], "m string, p_value double")
        return benjamini_hochberg(df, ["m"]).orderBy("p_value").collect()

    r = [x for x in run([0.001, 0.03, 0.035, 0.045, None]) if x["p_value"] is not None]
    assert all(x["passes_fdr"] for x in r) and [round(x["corrected_p_value"], 6) for x in r] == [0.004, 0.045, 0.045, 0.045]
    r = run([0.001, 0.2, 0.3, 0.4, 0.5])
    assert [x["passes_fdr"] for x in r] == [True, False, False, False, False] and r[0]["corrected_p_value"] == pytest.approx(0.005)


def value(spark, metric, y, p):
    df = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(y, p, strict=True)], "m string, label_value double, prediction_score double")
    return me.evaluate(df, (metric,), ["m"]).first()


def test_metrics(spark):
    y, p = [0, 0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8, 0.65]
    assert value(spark, Metric("pr_auc"), y, p)["value"] == 1 and value(spark, Metric("roc_auc"), y, p)["value"] == 1
    assert value(spark, Metric("precision_at_threshold", {"threshold": 0.5}), y, p)["value"] == 1
    assert value(spark, Metric("recall_at_threshold", {"threshold": 0.9}), y, p)["value"] == 0
    assert value(spark, Metric("precision_at_k", {"n": 2}), y, p)["value"] == 1
    assert value(spark, Metric("precision_at_k", {"n": 2}), y, [0.1, 0.9, 0.35, 0.8, 0.65])["value"] == 0.5
    one = value(spark, Metric("roc_auc"), [1, 1], [0.2, 0.3])
    assert one["value"] is None and one["reason"] == me.ROC_UNDEFINED
    assert value(spark, Metric("rmse"), [1, 2, 3], [1, 2, 5])["value"] == pytest.approx(math.sqrt(4 / 3))
    assert value(spark, Metric("mae"), [1, 2, 3], [1, 2, 5])["value"] == pytest.approx(2 / 3)
    # Ties favour positives.
    assert value(spark, Metric("precision_at_k", {"n": 1}), [0, 1], [0.5, 0.5])["value"] == 1


def test_ranking_by_ranges(spark):
    """Many distinct scores are ranked in ranges; the metrics are those of one sort, ties and null slices included."""
    import numpy as np

    rng = np.random.default_rng(4)
    score = np.concatenate([rng.random(4_000), rng.integers(0, 5, 500) / 5, np.repeat(0.5, 300)])
    y = (rng.random(len(score)) < 0.2 + 0.5 * score).astype(float)
    key = [["a", None][i % 3 == 0] for i in range(len(score))]
    df = spark.createDataFrame(list(zip(key, y.tolist(), score.tolist(), strict=True)), "m string, label_value double, prediction_score double").repartition(4)
    got = {(r["m"], r["metric_name"]): r["value"] for r in me.evaluate(df, (Metric("pr_auc"), Metric("roc_auc"), Metric("precision_at_k", {"n": 100})), ["m"]).collect()}
    for m in ("a", None):
        mine = np.array([k == m for k in key])
        yy, pp = y[mine], score[mine]
        pos, neg = pp[yy == 1], pp[yy == 0]
        auc = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
        ap = sum((yy[pp == t].sum() / yy.sum()) * (yy[pp >= t].mean()) for t in np.unique(pp))
        top = sorted(zip(pp, yy, strict=True), reverse=True)[:100]
        assert got[m, "roc_auc"] == pytest.approx(auc) and got[m, "pr_auc"] == pytest.approx(ap) and got[m, "precision_at_k"] == pytest.approx(sum(t[1] for t in top) / 100)
    ranked = me._ranked(df.groupBy("m", F.col("prediction_score").alias("score")).agg(F.count("*").alias("n"), F.sum("label_value").cast("long").alias("pos"), F.lit(0.0).alias("se"), F.lit(0.0).alias("ae")), ["m"])
    assert "part#" in ranked._jdf.queryExecution().optimizedPlan().toString()  # sorts are by slice and range


def test_user_metrics_by_states(spark):
    """One slice without a task of its own: tasks send states; a metric that is not computable says why; a plain function still gets all pairs."""

    @me.register("spread")
    class Spread:
        def init(self, params):
            return [0.0]

        def update(self, state, y, p, params):
            return [max(state[0], float(p.max()) * params["by"])]

        def merge(self, a, b, params):
            return [max(a[0], b[0])]

        def finish(self, state, params):
            if state[0] > 90:
                raise ValueError("too wide")
            return state[0]

    me.register("median_gap")(lambda y, p, params: sorted(abs(a - b) for a, b in zip(y, p, strict=True))[len(y) // 2])
    df = spark.range(0, 1_000, 1, 8).select(F.when(F.col("id") < 900, None).otherwise("b").alias("g"), F.timestamp_seconds(F.col("id") % 2).alias("w"), (F.col("id") % 2).cast("double").alias("label_value"), (F.col("id") / 10).alias("prediction_score"))
    got = {(r["g"], r["w"].second, r["metric_name"]): r for r in me.evaluate(df, (Metric("spread", {"by": 1}), Metric("median_gap"), Metric("mae")), ["g", "w"]).collect()}
    assert len(got) == 12 and {r["n_labeled"] for k, r in got.items() if k[0] is None} == {450}
    assert got[None, 0, "spread"]["value"] == pytest.approx(89.8) and got["b", 1, "spread"]["reason"] == "too wide" and got["b", 1, "spread"]["value"] is None
    assert got["b", 0, "median_gap"]["value"] == pytest.approx(95.0) and "spread" in me.available_metrics()


def test_window_grid(spark):
    g = [r["window_start"].strftime("%H:%M") for r in window_grid(spark, "2026-01-01 00:30:00", "2026-01-01 02:30:00", "1h").orderBy("window_start").collect()]
    assert g == ["00:00", "01:00", "02:00"]
    assert window_grid(spark, "2026-01-01", "2026-01-01", "1h").count() == 0


def test_config_checks():
    assert parse_duration("10m").total_seconds() == 600
    for bad in ("10", "h", "1w", ""):
        with pytest.raises(ValueError):
            parse_duration(bad)
    with pytest.raises(ValueError):
        Gate(0.1, 0.2)
    with pytest.raises(ValueError):
        Profile(gates=AGGRESSIVE.gates, history_scan_windows=3)
    assert AGGRESSIVE.fingerprint() != PATIENT.fingerprint()


def test_expectation_details_are_those_of_sql(spark):
    """Small maxima have no exponent and ties after six decimals fall as SQL has them (run_expectations)."""
    import duckdb

    values = [i / 1e6 for i in range(0, 30_000, 5)] + [0.5, 1.0, 2.25, 12.345675]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = [r.t for r in df.select(col.plain_text(F.col("x")).alias("t")).collect()]
    assert got == [r[0] for r in duckdb.execute("SELECT CAST(round(unnest($1::DOUBLE[]), 5) AS VARCHAR)", [values]).fetchall()]
    one = spark.createDataFrame([("value", "psi", None, 0.000565)], "feature_name string, test_method string, segment_dimension string, statistic double")
    assert rp.expect_max_below(one, "value", "psi", 0.25).first().detail == "0.00056"
    assert rp.expect_max_below(one.where("false"), "value", "psi", 0.25).first().detail is None


def small_events(spark, path):
    """Four days around the split, with null values, null types and labels that are late or corrected."""
    spark.range(3_000).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-09' + make_dt_interval(0, 0, cast(id * 2 as int))").alias("ts"), F.when(F.col("id") % 31 != 0, (F.col("id") % 97).cast("double")).alias("value"), F.lit('{"k": 1}').alias("props"),
        F.col("id").alias("user_id"), F.when(F.col("id") % 5 != 0, F.element_at(F.array(F.lit("click"), F.lit("view")), (F.col("id") % 2 + 1).cast("int"))).alias("event_type"),
    ).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_a_trace_counts_events_and_labels_once(spark, tmp_path, monkeypatch):
    """run_trace: two drift results and two revisions come from one count of the baseline, of the live rows and of the labelled ones."""
    from tidegauge.operators import profile
    from tidegauge.plans import queries
    from tidegauge.sources import scratch

    names = []

    def written(df, name):
        names.append(name)
        return scratch.written(df, name)

    for module in (profile, dr, me):
        monkeypatch.setattr(module, "written", written)
    queries.run_trace(spark, small_events(spark, tmp_path))
    assert sorted(names) == ["baseline-counts", "bins", "live-counts", "scores"]


def test_both_revisions_are_those_of_two_evaluations(spark, tmp_path):
    from tidegauge.plans import events as ev

    p, labels = ev.predictions(spark, small_events(spark, tmp_path)), ev.labels(spark, str(tmp_path)).where("prediction_id < 2500 or received_at > timestamp_ntz'2024-01-13'")
    soon = labels.join(p.select("prediction_id", "predicted_at"), "prediction_id").where("received_at < predicted_at + interval 24 hours").drop("predicted_at")
    want = me.performance(p, soon, ev.EVENTS, ev.DAILY).unionByName(me.performance(p, labels, ev.EVENTS, ev.DAILY, True))
    got = me.performance_revisions(p, labels, ev.EVENTS, ev.DAILY, "24h")
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert got.columns == want.columns and rows(got) == rows(want) and len(rows(got)) > 20


def test_edges_are_searched_once_a_value(spark):
    """Parts take the bucket that is there: the plan of the counts filters the edges once (drift_simulated_floor, run_totals)."""
    counts = spark.createDataFrame([(None, None, "x", float(i), None, 1) for i in range(50)], "segment_dimension string, segment_value string, feature_name string, num double, cat string, n long")
    bins = spark.createDataFrame([("x", "continuous", [0.0, 10.0, 25.0, 40.0], None, None, 0)], "feature_name string, dtype string, edges array<double>, category string, position int, n_categories long")
    got = dr.parted(counts, bins, ["x"], [])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("filter(edges") == 1
    want = counts.crossJoin(bins.select("edges")).select("num", col.bucket_of(F.col("num"), F.col("edges")).alias("b"), col.fine_bucket(F.col("num"), F.col("edges")).alias("p"))
    assert sorted((r.num, r.bucket, r.part) for r in got.collect()) == sorted((r.num, r.b, r.p) for r in want.collect())


def test_labelled_rows_are_joined_once(spark, tmp_path):
    """Which windows have no labels is seen in the results: the plan that gives them joins no label again (run_totals)."""
    from tidegauge.plans import events as ev

    m = me.performance(ev.predictions(spark, small_events(spark, tmp_path)), ev.labels(spark, str(tmp_path)).where("prediction_id < 1000"), ev.EVENTS, ev.DAILY)
    assert "received_at" not in m._jdf.queryExecution().optimizedPlan().toString()
    empty = m.where("n_labeled = 0").collect()
    assert {r.metric_name for r in empty} == {x.name for x in ev.METRICS} and all(r.segment_dimension is None and r.status == "not_computable" for r in empty) and len(empty) % len(ev.METRICS) == 0
    assert m.where("n_labeled > 0").join(m.where("n_labeled = 0"), "window_start").count() == 0


def test_rows_are_multiplied_by_numbers_and_labels_sorted_once(spark, tmp_path):
    """No struct is built a row and slice, no Python worker starts for names, and grouping and join of labels share an exchange and a sort (run_totals)."""
    from tidegauge.plans import events as ev

    p, labels = ev.predictions(spark, small_events(spark, tmp_path)), ev.labels(spark, str(tmp_path))
    model = Model((Feature("value", "continuous"), Feature("flag", "categorical"), Feature("event_type", "categorical")), ("event_type", "flag"), score=None)
    rows = p.withColumn("flag", F.expr("if(prediction_id % 3 = 0, null, prediction_id % 2 = 0)"))
    counted = pf.value_counts(rows, model, ["window_start"])
    want = {}
    for r in rows.collect():
        said = {"value": r.value, "flag": None if r.flag is None else str(r.flag), "event_type": r.event_type, pf.ROWS: ""}
        for d in (None, "event_type", "flag"):
            for f, v in said.items():
                if v is not None and d != f and (d is None or said[d] is not None):
                    key = (r.window_start, d, d and said[d], f, v if f == "value" else None, v if f in ("flag", "event_type") else None)
                    want[key] = want.get(key, 0) + 1
    assert {tuple(r)[:-1]: r.n for r in counted.collect()} == want
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "explode(array(" not in plan(counted) and "explode([" in plan(counted)
    assert "ExistingRDD" not in plan(pf.frozen_bins(p, model, counted=counted))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = plan(me.labelled(p, labels))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found.count("Exchange hash") == 2 and found.count("- Sort [") == 2
