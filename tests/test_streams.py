"""Streams against the batch operators: sealing, performance in two phases, repeated batches, what is read."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from tidegauge.config import Feature, Gate, Metric, Model, Profile
from tidegauge.operators import alerts as al
from tidegauge.operators.drift import drift
from tidegauge.operators.metrics import performance
from tidegauge.operators.profile import baseline_profile, frozen_bins
from tidegauge.operators.shape import with_window
from tidegauge.streaming.seal import Monitor, windowed_counts

T0 = dt.datetime(2026, 1, 1)
GATES = {m: Gate(0.2, 0.1) for m in ("psi", "ks", "chi_square", "jsd")}
MODEL = Model((Feature("x", "continuous"),), ("g",), min_segment_size=5, score="prediction_score")
PROFILE = Profile(
    window="6h", watermark="10m", min_window_size=10, continuous=("psi", "ks"), gates=GATES, metrics=(Metric("pr_auc", gate=Gate(0.3, 0.5, "below")), Metric("roc_auc")),
    fire_persistence=2, escalate_persistence=4, resolve_persistence=3, not_computable_persistence=2, history_scan_windows=6, max_alerts_per_run=3,
)
PREDICTION = "model_id string, prediction_id long, predicted_at timestamp, x double, prediction_score double, g string"
LABEL = "model_id string, prediction_id long, label_id long, label_value double, received_at timestamp"


def predictions(spark, first, stop):
    """One every quarter of an hour."""
    rows = [("m", i, T0 + dt.timedelta(minutes=15 * i, microseconds=i), float(i % 17 + (9 if i > 240 else 0)), (i * 37 % 101) / 101, "ab"[i % 2]) for i in range(first, stop)]
    return spark.createDataFrame(rows, PREDICTION)


def labels(spark, ids, value=lambda i: float(i * 37 % 101 > 50), first=0):
    return spark.createDataFrame([("m", i, first + k, value(i), T0 + dt.timedelta(days=9, seconds=first + k)) for k, i in enumerate(ids)], LABEL)


@pytest.fixture(autouse=True)
def one_partition(spark):
    """Few rows: one state store and one worker a query."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Run:
    """A monitor over two folders of arriving files; every call lets both queries take what has come."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path = spark, tmp_path
        base = spark.createDataFrame([(float(i % 17), (i * 29 % 97) / 97, "ab"[i % 2]) for i in range(300)], "x double, prediction_score double, g string")
        bins = frozen_bins(base, MODEL)
        self.monitor = Monitor(spark, str(tmp_path / "out"), MODEL, PROFILE, base, bins, baseline_profile(base, MODEL, simulate=False), gated=False)
        self.seen = {"on_decided": [], "on_signals": []}
        for name in self.seen:
            setattr(self.monitor, name, self._kept(name, getattr(self.monitor, name)))
        predictions(spark, 0, 0).write.parquet(str(tmp_path / "p"))
        labels(spark, []).write.parquet(str(tmp_path / "l"))

    def _kept(self, name, handler):
        def call(df, batch):
            path = f"{self.path}/kept/{name}/{batch}"
            df.write.mode("overwrite").parquet(path)
            self.seen[name].append((path, batch))
            handler(df, batch)

        call.handler = handler
        return call

    def again(self, name):
        """The last batch of a query once more, as after a failure."""
        path, batch = self.seen[name][-1]
        getattr(self.monitor, name).handler(self.spark.read.parquet(path), batch)

    def take(self, p=None, l=None):
        for rows, folder in ((p, "p"), (l, "l")):
            if rows is not None:
                rows.coalesce(1).write.mode("append").parquet(str(self.path / folder))
        read = lambda schema, folder: self.spark.readStream.schema(schema).parquet(str(self.path / folder))
        m = self.monitor
        m.start_ledger(read(PREDICTION, "p"), read(LABEL, "l"), str(self.path / "cp1")).awaitTermination()
        m.start_windows(str(self.path / "cp2")).awaitTermination()


COLUMNS = ["window_start", "segment_value", "metric_name", "status", "metric_value", "n_labeled", "is_retroactive"]


def plain(df, columns):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(columns).collect())


def contents(run):
    return {n: plain(t, sorted(t.columns)) for n in ("predictions", "labels", "drift", "performance", "windows", "rejected") if (t := run.monitor.table(n)) is not None}


def test_both_phases_equal_the_batch(spark, tmp_path):
    run = Run(spark, tmp_path)
    m = run.monitor
    everything = with_window(predictions(spark, 0, 120), "predicted_at", "6h")
    early = labels(spark, range(0, 60, 2))  # before their windows seal
    run.take(predictions(spark, 0, 20), early.where("prediction_id < 20"))
    assert m.windows() is None and m.table("performance") is None
    run.take(predictions(spark, 20, 120), early.where("prediction_id >= 20"))
    sealed = m.windows().select("window_start")
    assert sealed.count() == 4  # the last window waits for its watermark
    inside = everything.join(sealed, "window_start", "left_semi")
    want = drift(inside, m.baseline, m.profiled, m.bins, MODEL, PROFILE, False)
    signal = ["window_start", "feature_name", "segment_value", "test_method", "statistic", "n_live", "p_value"]
    assert plain(m.table("drift"), signal) == plain(want, signal)
    # First performance comes with the seal, of the windows without any label too.
    initial = performance(inside, early, MODEL, PROFILE)
    assert plain(m.table("performance"), COLUMNS) == plain(initial, COLUMNS) and initial.where("n_labeled = 0").count() == 2 and initial.where("status = 'computed'").count() > 0

    # Later labels, a correction and an identical repetition: a new revision of the windows they touch alone.
    late = labels(spark, [1, 3, 5, 25], first=1_000).unionAll(labels(spark, [2], lambda i: 1.0 - float(i * 37 % 101 > 50), first=2_000)).unionAll(labels(spark, [50], first=3_000))
    before = contents(run)
    run.take(l=late)
    touched = {T0, T0 + dt.timedelta(hours=6)}
    revised = m.table("performance").where("is_retroactive")
    assert {r["window_start"] for r in revised.select("window_start").collect()} == touched
    final = performance(inside, early.unionAll(late.where("prediction_id <> 50")), MODEL, PROFILE, retroactive=True).where(F.col("window_start").isin(*touched))
    assert plain(revised, COLUMNS) == plain(final, COLUMNS)
    after = contents(run)
    assert after["drift"] == before["drift"] and set(before["performance"]) < set(after["performance"])
    record = {r["window_start"]: r for r in m.windows().collect()}
    assert record[T0]["n_predictions"] == 24 and record[T0]["n_labels"] == 15 and record[T0]["evaluated_at"] < record[T0]["performance_computed_at"] and record[T0]["label_watermark"] is not None
    assert record[T0 + dt.timedelta(hours=12)]["evaluated_at"] == record[T0 + dt.timedelta(hours=12)]["performance_computed_at"]
    assert m.alerts().count() == al.alert_lifecycle(al.alert_events(want, m.table("performance"), PROFILE), PROFILE).count()

    # A batch that is run again changes nothing, and neither does its line in the log.
    for name in ("on_decided", "on_signals"):
        run.again(name)
        assert contents(run) == after
    run.take()
    assert contents(run) == after


def test_contradictions_and_unknown_labels(spark, tmp_path):
    run = Run(spark, tmp_path)
    p = predictions(spark, 0, 10)
    run.take(p.unionAll(p.where("prediction_id = 3").withColumn("x", F.lit(-1.0))).unionAll(p.where("prediction_id = 4")), labels(spark, [1, 1, 77]))
    outcomes = lambda: sorted({(int(r["prediction_id"]), r["outcome"]) for r in run.monitor.table("rejected").collect()})
    assert outcomes() == [(3, "reject"), (77, "unknown")] and run.monitor.table("predictions").count() == 9 and run.monitor.table("labels").count() == 1
    run.take(p.where("prediction_id in (3, 5)").unionAll(p.where("prediction_id = 6").withColumn("x", F.lit(-1.0))))
    assert outcomes() == [(3, "reject"), (6, "conflict"), (77, "unknown")] and run.monitor.table("predictions").count() == 10
    stored = run.monitor.table("predictions").select(p.columns)
    assert plain(stored, p.columns) == plain(p, p.columns)  # to the microsecond


def test_late_rows_are_counted_and_sealed_days_not_read(spark, tmp_path):
    run = Run(spark, tmp_path)
    run.take(predictions(spark, 0, 230))  # two days and more
    m = run.monitor
    assert m.windows().count() == 9
    kept = m.table("drift").count()
    # Without the files of the first day nothing that reads it would work.
    shutil.move(str(tmp_path / "out" / "predictions" / "window_date=2026-01-01"), str(tmp_path / "gone"))
    late = predictions(spark, 5, 7).withColumn("prediction_id", F.col("prediction_id") + 10_000)
    run.take(late.unionAll(predictions(spark, 230, 400)))
    assert m.windows().count() == 16 and m.table("drift").where("window_start < '2026-01-03'").count() >= 8 and m.table("drift").count() > kept
    record = {r["window_start"]: r for r in m.windows().collect()}
    assert record[T0]["late_prediction_count"] == 2 and record[T0]["n_predictions"] == 24
    assert sum(r["late_prediction_count"] for r in record.values()) == 2
    # A label of the third day reads that day alone.
    run.take(l=labels(spark, [200]))
    assert {r["window_start"] for r in m.table("performance").where("is_retroactive").collect()} == {T0 + dt.timedelta(hours=48)}


def test_windows_of_several_days_and_models(spark, tmp_path):
    run = Run(spark, tmp_path)
    two = predictions(spark, 0, 100).unionAll(predictions(spark, 0, 100).withColumn("model_id", F.lit("n")))
    run.take(two)
    sizes = {(r["model_id"], r["window_start"]): r["n_predictions"] for r in run.monitor.windows().collect()}
    assert sizes == {(k, T0 + dt.timedelta(hours=6 * i)): 24 for k in "mn" for i in range(4)}


def test_watermarked_counts(spark, tmp_path):
    rows = spark.createDataFrame([(T0 + dt.timedelta(minutes=i),) for i in range(0, 200, 5)], "at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(s, "at", "1h", "10m").writeStream.format("memory").queryName("sealed_counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n_predictions"] for r in spark.table("sealed_counts").collect()) == [12, 12, 12]


def test_keyed_table(spark, tmp_path):
    from tidegauge.sources.keyed import KeyedTable, claim

    table = KeyedTable(spark, str(tmp_path / "t"), ("k", "window_start"))
    rows = lambda *r: spark.createDataFrame([(k, T0 + dt.timedelta(days=d), v) for k, d, v in r], "k string, window_start timestamp, v int")
    assert table.newest() is None and table.compact([T0.date()]) == 0
    table.upsert(rows(("a", 0, 1), ("b", 0, 1), ("a", 1, 1)), 1)
    table.upsert(rows(("a", 0, 2)), 2)
    table.upsert(rows(("a", 0, 3), ("c", 1, 3)), 3)
    now = lambda **o: sorted((r["k"], r["window_start"].day, r["v"]) for r in table.newest(**o).collect())
    want = [("a", 1, 3), ("a", 2, 1), ("b", 1, 1), ("c", 2, 3)]
    assert now() == want and now(upto=2) == [("a", 1, 2), ("a", 2, 1), ("b", 1, 1)] and now(days=[dt.date(2026, 1, 2)]) == [("a", 2, 1), ("c", 2, 3)]
    table.upsert(rows(("a", 0, 3), ("c", 1, 3)), 3)  # written again
    assert now() == want
    assert table.compact([dt.date(2026, 1, 1), dt.date(2026, 1, 2)]) == 3 and now() == want and table.all().count() == 4
    assert table.compact([dt.date(2026, 1, 1)]) == 0
    assert claim(spark, str(tmp_path), "x") and not claim(spark, str(tmp_path), "x")


