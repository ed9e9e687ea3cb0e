"""Evaluation of a range of days into stored results: repeatable, resumable, and by one process for each window.

Results are keyed tables by day and version.  Every write takes a number of its
own, which is its version; a window's record names the evaluation that counts, so a
forced evaluation makes the results of earlier ones void without touching them.
A process claims the days of a model before it computes them, by creating a file
that the file system gives to one of them; the others leave these days out.
Windows are recorded last: a run that broke off has recorded nothing, and its
claims end with it, or after ``claim_seconds`` if its process died.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import Model, Profile, interval
from tidegauge.operators.alerts import alert_events, alert_lifecycle, last_runs, outbox
from tidegauge.operators.drift import drift
from tidegauge.operators.metrics import performance, window_labels
from tidegauge.operators.shape import calendar_range, in_range
from tidegauge.sources.ingest import stale_windows, unevaluated
from tidegauge.sources.keyed import KeyedTable, claim

KEYS = ["model_id", "window_start", "window_end"]
SIGNAL = ["feature_name", "test_method", "segment_dimension", "segment_value"]
#: A window's record, besides its version.
RECORD = [
    *KEYS, "baseline_id", "config_hash", "evaluation", "evaluated_at", "performance_computed_at", "label_watermark", "n_predictions", "n_labels", "performance_stale", "late_prediction_count",
]


@dataclass
class Store:
    """The stored evaluations of models that share a description and a baseline."""

    spark: SparkSession
    folder: str
    model: Model
    profile: Profile
    baseline: DataFrame
    bins: DataFrame
    profiled: DataFrame
    gated: bool = True
    baseline_id: int = 1
    claim_seconds: float = 6 * 3600

    # -- tables ----------------------------------------------------------

    def _keyed(self, name: str, *key: str) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.folder}/{name}", key)

    @property
    def _windows(self) -> KeyedTable:
        return self._keyed("windows", "model_id", "window_start")

    def windows(self) -> DataFrame | None:
        """The record of each evaluated window (``RECORD``)."""
        found = self._windows.newest()
        return None if found is None else found.select(*RECORD)

    def _valid(self, name: str) -> DataFrame | None:
        """Stored results of the evaluations that count."""
        rows, windows = self._keyed(name).all(), self.windows()
        if rows is None or windows is None:
            return None
        return rows.join(windows.select("model_id", "window_start", "evaluation"), ["model_id", "window_start", "evaluation"], "left_semi").drop("window_date", "version")

    def drift(self) -> DataFrame | None:
        return self._valid("drift")

    def performance(self) -> DataFrame | None:
        """Every revision, with ``revision_id`` and ``computed_at``."""
        return self._valid("performance")

    # -- claims ----------------------------------------------------------

    def _files(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _number(self) -> int:
        """A number nobody else has, above all that were taken."""
        files, path = self._files("numbers")
        files.mkdirs(path)
        taken = [int(s.getPath().getName()) for s in files.listStatus(path) if s.getPath().getName().isdigit()]
        n = max(taken, default=0) + 1
        while not claim(self.spark, f"{self.folder}/numbers", str(n)):
            n += 1
        return n

    def _claimed(self, days: list[tuple]) -> dict[tuple, str]:
        """Of the (model, day) pairs, those this process has now, with the names of their claims.

        The newest claim of a pair holds until its ``.done`` mark, or until it is
        ``claim_seconds`` old: its process is then taken for dead.
        """
        files, path = self._files("claims")
        files.mkdirs(path)
        newest: dict[str, tuple[int, float]] = {}
        done = set()
        for s in files.listStatus(path):
            name = s.getPath().getName()
            if name.endswith(".done"):
                done.add(name[:-5])
            elif name.count("~") == 2:
                pair, generation = name.rsplit("~", 1)
                newest[pair] = max(newest.get(pair, (0, 0.0)), (int(generation), s.getModificationTime() / 1000))
        mine = {}
        for model, day in days:
            pair = f"{quote(str(model), safe='')}~{day}"
            generation, made = newest.get(pair, (0, 0.0))
            if generation and f"{pair}~{generation}" not in done and time.time() - made < self.claim_seconds:
                continue
            name = f"{pair}~{generation + 1}"
            if claim(self.spark, f"{self.folder}/claims", name):
                mine[(model, day)] = name
        return mine

    def _release(self, names) -> None:
        for n in names:
            claim(self.spark, f"{self.folder}/claims", f"{n}.done")

    # -- evaluation ------------------------------------------------------

    def _within(self, live: DataFrame, start, end, at: str) -> DataFrame:
        """Rows of the windows that begin in ``[start, end)``; the bounds reach the scan by event time."""
        last = end + F.expr(f"interval {interval(self.profile.window)}")
        return in_range(in_range(live, start, last, at), start, end, "window_start")

    def evaluate(self, live: DataFrame, labels: DataFrame | None, first_day: str, last_day: str, force: bool = False, at: str = "predicted_at", as_of=None) -> int:
        """Evaluate the windows of the days from ``first_day`` to ``last_day``, both whole; returns how many windows.

        ``live`` carries ``KEYS``, the event time ``at`` and the declared columns.
        No watermark applies: these very windows are asked for.  Windows that
        are evaluated already stay as they are, unless ``force``.
        """
        rows, done = self._within(live, *calendar_range(first_day, last_day), at), self.windows()
        windows = rows.select(*KEYS).distinct()
        due = windows if force or done is None else unevaluated(windows, done)
        # As many rows as models and days have something due.
        days = [(r["model_id"], r["day"]) for r in due.select("model_id", F.to_date("window_start").alias("day")).distinct().collect()]
        mine = self._claimed(days)
        try:
            done = self.windows()  # what others have finished since
            due = windows if force or done is None else unevaluated(windows, done)
            return self._evaluate(rows, labels, due, mine, at, as_of) if mine else 0
        finally:
            self._release(mine.values())

    def _evaluate(self, rows: DataFrame, labels: DataFrame | None, due: DataFrame, mine: dict, at: str, as_of) -> int:
        pairs = self.spark.createDataFrame(list(mine), f"model_id {dict(due.dtypes)['model_id']}, day date")  # bounded by the range's days and models
        due = due.withColumn("day", F.to_date("window_start")).join(F.broadcast(pairs), ["model_id", "day"], "left_semi").drop("day").persist()
        bounds = due.agg(F.min("window_start").alias("a"), F.max("window_end").alias("b"), F.count("*").alias("n")).first()
        if not bounds["n"]:
            due.unpersist()
            return 0
        rows = rows.where((F.col(at) >= F.lit(bounds["a"])) & (F.col(at) < F.lit(bounds["b"]))).join(due, KEYS, "left_semi")
        number = self._number()
        self._keyed("drift", *KEYS, *SIGNAL).upsert(drift(rows, self.baseline, self.profiled, self.bins, self.model, self.profile, self.gated).withColumn("evaluation", F.lit(number)), number)
        counted = self._revise(rows, labels, number, due.select("model_id", "window_start", F.lit(number).alias("evaluation")), False)
        now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
        record = due.join(rows.groupBy("model_id", "window_start").agg(F.count("*").alias("n_predictions")), ["model_id", "window_start"])
        record = record.join(counted, ["model_id", "window_start"], "left") if counted is not None else record.withColumns({"n_labels": F.lit(None).cast("long"), "label_watermark": F.lit(None).cast("timestamp")})
        self._windows.upsert(
            record.select(
                *KEYS, F.lit(self.baseline_id).alias("baseline_id"), F.lit(self.profile.fingerprint()).alias("config_hash"), F.lit(number).alias("evaluation"), now.alias("evaluated_at"),
                F.when(F.lit(counted is not None), now).alias("performance_computed_at"), "label_watermark", "n_predictions", F.coalesce("n_labels", F.lit(0)).cast("long").alias("n_labels"),
                F.lit(False).alias("performance_stale"), F.lit(0).cast("long").alias("late_prediction_count"),
            ),
            number,
        )
        due.unpersist()
        return bounds["n"]

    def _revise(self, rows: DataFrame, labels: DataFrame | None, number: int, evaluations: DataFrame, retroactive: bool) -> DataFrame | None:
        """Store a revision of the performance of the windows of ``rows``; returns their labels' counts."""
        if labels is None or not self.model.score or not self.profile.metrics:
            return None
        one = F.lit(number).cast("long")
        found = performance(rows, labels, self.model, self.profile, retroactive).join(evaluations, ["model_id", "window_start"])
        self._keyed("performance").upsert(found.withColumns({"revision_id": one, "computed_at": one}), number)
        return window_labels(rows, labels, self.model.score).select("model_id", "window_start", "n_labels", "label_watermark")

    # -- what comes later ------------------------------------------------

    def note(self, live: DataFrame, labels: DataFrame | None = None, late: DataFrame | None = None) -> None:
        """Mark the evaluated windows that new ``labels`` touch as stale, and count ``late`` predictions in theirs."""
        windows = self._windows.newest()
        if windows is None:
            return
        number, marks = self._number(), []
        if labels is not None:
            marks.append(stale_windows(labels, live, windows.select("model_id", "window_start")).select("model_id", "window_start", F.lit(1).alias("stale"), F.lit(0).cast("long").alias("late")))
        if late is not None:
            marks.append(late.groupBy("model_id", "window_start").agg(F.count("*").alias("late")).select("model_id", "window_start", F.lit(0).alias("stale"), "late"))
        if not marks:
            return
        both = (marks[0] if len(marks) == 1 else marks[0].unionByName(marks[1])).groupBy("model_id", "window_start").agg(F.max("stale").alias("stale"), F.sum("late").alias("late"))
        changed = windows.join(both, ["model_id", "window_start"])
        changed = changed.withColumns({"performance_stale": F.col("performance_stale") | (F.col("stale") == 1), "late_prediction_count": F.col("late_prediction_count") + F.col("late")})
        self._windows.upsert(changed.select(*RECORD), number)

    def recompute(self, live: DataFrame, labels: DataFrame, as_of=None) -> int:
        """A new revision of the performance of stale windows; returns how many.

        The number is taken first: a mark that comes while this runs has a higher
        one, so its window is stale again afterwards.
        """
        number, windows = self._number(), self._windows.newest()
        if windows is None:
            return 0
        days = [(r["model_id"], r["day"]) for r in windows.where("performance_stale").select("model_id", F.to_date("window_start").alias("day")).distinct().collect()]
        mine = self._claimed(days)
        try:
            return self._recompute(live, labels, number, mine, as_of) if mine else 0
        finally:
            self._release(mine.values())

    def _recompute(self, live: DataFrame, labels: DataFrame, number: int, mine: dict, as_of) -> int:
        windows = self._windows.newest()
        pairs = self.spark.createDataFrame(list(mine), f"model_id {dict(windows.dtypes)['model_id']}, window_date date")
        stale = windows.where("performance_stale").join(F.broadcast(pairs), ["model_id", "window_date"], "left_semi").persist()
        bounds = stale.agg(F.min("window_start").alias("a"), F.max("window_end").alias("b"), F.count("*").alias("n")).first()
        if bounds["n"]:
            rows = live.where((F.col("window_start") >= F.lit(bounds["a"])) & (F.col("window_start") < F.lit(bounds["b"]))).join(stale.select("model_id", "window_start"), ["model_id", "window_start"], "left_semi")
            counted = self._revise(rows, labels, number, stale.select("model_id", "window_start", "evaluation"), True)
            now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
            kept = [c for c in RECORD if c not in ("n_labels", "label_watermark", "performance_computed_at", "performance_stale")]
            record = stale.select(*kept).join(counted, ["model_id", "window_start"], "left")
            record = record.withColumns({"performance_computed_at": now, "performance_stale": F.lit(False), "n_labels": F.coalesce("n_labels", F.lit(0)).cast("long")})
            self._windows.upsert(record.select(*RECORD), number)
        stale.unpersist()
        return bounds["n"]

    def compact(self, first_day: str, last_day: str) -> int:
        """Fold the versions of the days' window records and drift; returns how many partitions went."""
        days = [r[0] for r in self.spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first_day)), F.to_date(F.lit(last_day))))).collect()]
        return self._windows.compact(days) + self._keyed("drift", *KEYS, *SIGNAL).compact(days)

    def fold_days(self, first_day: str, last_day: str) -> DataFrame:
        """Go on with the alerts over days that follow those folded so far: open ones, and all that these days finished.

        Reads the results of these days, the alerts open before them and the runs
        their signals were in; days have to come in order, each once.
        """
        number, state = self._number(), f"{self.folder}/alert-state"
        files, path = self._files("alert-state")
        files.mkdirs(path)
        done = sorted(int(s.getPath().getName()[:-5]) for s in files.listStatus(path) if s.getPath().getName().endswith(".done"))
        read = lambda name: self.spark.read.parquet(f"{state}/{done[-1]}/{name}") if done else None
        within = lambda rows: None if rows is None else in_range(rows, *calendar_range(first_day, last_day), "window_start")
        runs, before = read("runs"), read("alerts")
        events = alert_events(within(self.drift()), within(self.performance()), self.profile, runs)
        found = alert_lifecycle(events, self.profile, open_alerts=None if before is None else before.where("status <> 'resolved'"))
        found.write.mode("overwrite").parquet(f"{state}/{number}/alerts")
        last_runs(events, runs).write.mode("overwrite").parquet(f"{state}/{number}/runs")
        claim(self.spark, state, f"{number}.done")  # a fold that broke off before this is done again from the same state
        return self.spark.read.parquet(f"{state}/{number}/alerts")

    def transitions(self, alerts: DataFrame, delivered: DataFrame, first_day: str, last_day: str) -> DataFrame:
        """What to announce after the evaluation of these days: see :func:`outbox`."""
        windows = in_range(self.windows(), *calendar_range(first_day, last_day), "window_start")
        return outbox(alerts, delivered, evaluated=windows.select("model_id", "window_end"))

    def fold_alerts(self) -> DataFrame:
        """Fold the alerts of the whole stored history anew and replace the alert table."""
        found = alert_lifecycle(alert_events(self.drift(), self.performance(), self.profile), self.profile)
        found.withColumn("config_hash", F.lit(self.profile.fingerprint())).write.mode("overwrite").parquet(f"{self.folder}/alerts")
        return self.spark.read.parquet(f"{self.folder}/alerts")
