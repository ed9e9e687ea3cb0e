"""Streams of predictions and labels: an idempotent ledger, windows that seal by event time, performance in two phases.

Two queries, each with its checkpoint.  The *ledger* keeps one state a
prediction id: its payload's hash, its window, the hashes of its labels.  A row
that comes is so accepted, skipped, or refused, and a label finds its window,
without a look into the stored tables.  What is accepted is stored by the window's
day and by batch, and one line per window and batch goes to a log.

The *windows* query reads that log with an event-time watermark and keeps one small
state a window: its counts, whether it is sealed, the last batch it has seen.  A
timer at the window's end seals it once.  Its output says what is due: a window
that seals gets its drift and its first performance, from all labels that came
before; a sealed window that labels touch gets a new, retroactive revision; later
predictions are counted.  Only the stored rows of due windows are read, up to the
batch their state had seen, so a batch that is run again gives the same rows.

Both write by batch number and replace what an earlier try left.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tidegauge.config import Model, Profile, interval
from tidegauge.functions.columns import fingerprint
from tidegauge.operators.alerts import alert_events, alert_lifecycle
from tidegauge.operators.drift import drift
from tidegauge.operators.metrics import performance, window_labels
from tidegauge.operators.shape import with_window
from tidegauge.sources.ingest import PREDICTION
from tidegauge.sources.keyed import KeyedTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: JSON keeps microseconds, so that a payload comes back as it was.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
_DECIDED = "model_id string, prediction_id string, outcome string, payload string, window long"
_LOG = "model_id string, window long, inserts long, labels long, newest timestamp, batch int"
_SIGNALS = "model_id string, window long, signal string, n_predictions long, late long, upto int"


class Ledger(StatefulProcessor):
    """Decides on the rows of one prediction id.

    Outcomes of predictions: ``insert``, ``skip`` (seen with this payload),
    ``conflict`` (stored with another one), ``reject`` (payloads of one batch
    contradict each other).  Of labels: ``label``, ``skip``, ``unknown``.
    """

    def init(self, handle) -> None:
        self.prediction = handle.getValueState("prediction", "hash string, window long")
        self.labels = handle.getMapState("labels", "hash string", "n int")

    def handleInputRows(self, key, rows, timerValues):
        rows = pd.concat(list(rows))
        stored, out = self.prediction.get(), []
        mine = rows[rows["kind"] == "p"]
        clash = mine["hash"].nunique() > 1
        for r in mine.itertuples():
            if clash:
                outcome = "reject"
            elif stored is None:
                stored, outcome = (r.hash, r.window), "insert"
                self.prediction.update(stored)
            else:
                outcome = "skip" if stored[0] == r.hash else "conflict"
            out.append((outcome, r.payload, r.window))
        for r in rows[rows["kind"] == "l"].itertuples():
            if stored is None:
                outcome = "unknown"
            elif self.labels.containsKey((r.hash,)):
                outcome = "skip"
            else:
                self.labels.updateValue((r.hash,), (1,))
                outcome = "label"
            out.append((outcome, r.payload, stored[1] if stored else -1))
        yield pd.DataFrame([(key[0], key[1], *o) for o in out], columns=["model_id", "prediction_id", "outcome", "payload", "window"])

    def close(self) -> None:
        pass


class Windows(StatefulProcessor):
    """Seals one window when the watermark passes its end, and says when it is touched later."""

    def __init__(self, length_ms: int):
        self.length_ms = length_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "n long, late long, sealed boolean, upto int")

    def handleInputRows(self, key, rows, timerValues):
        state = self.state.get()
        n, late, sealed, upto = state or (0, 0, False, -1)
        if state is None:
            self.handle.registerTimer(key[1] // 1000 + self.length_ms)
        more = labels = 0
        for r in pd.concat(list(rows)).sort_values("batch").itertuples():
            if r.batch <= upto:  # a line that a repeated batch has written again
                continue
            upto = r.batch
            more, labels = more + r.inserts, labels + r.labels
        n, late = (n, late + more) if sealed else (n + more, late)
        self.state.update((int(n), int(late), sealed, int(upto)))
        signals = [s for s, due in (("late", more), ("stale", labels)) if sealed and due]
        yield pd.DataFrame([(*key, s, n, late, upto) for s in signals], columns=["model_id", "window", "signal", "n_predictions", "late", "upto"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n, late, _, upto = self.state.get()
        self.state.update((n, late, True, upto))
        yield pd.DataFrame([(*key, "seal", n, late, upto)], columns=["model_id", "window", "signal", "n_predictions", "late", "upto"])

    def close(self) -> None:
        pass


@dataclass
class Monitor:
    """One description's streams over a folder of tables.

    ``predictions`` carry model_id, prediction_id, predicted_at and the declared
    columns; ``labels`` carry model_id, prediction_id, label_id, label_value and
    received_at.  A label's payload is what it has besides ids and received_at.
    """

    spark: SparkSession
    folder: str
    model: Model
    profile: Profile
    baseline: DataFrame
    bins: DataFrame
    profiled: DataFrame
    gated: bool = True

    # -- tables ----------------------------------------------------------

    def _keyed(self, name: str, *key: str) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.folder}/{name}", key)

    def table(self, name: str) -> DataFrame | None:
        """All stored rows of ``predictions, labels, drift, performance, rejected``, and every version of ``windows``."""
        return self._keyed(name).all()

    def windows(self) -> DataFrame | None:
        """One row a sealed window, as it was last recorded."""
        return self._keyed("windows", "model_id", "window_start").newest()

    def alerts(self) -> DataFrame:
        """Alerts folded from the stored drift and the newest revisions of the stored performance."""
        return alert_lifecycle(alert_events(self.table("drift"), self.table("performance"), self.profile), self.profile)

    # -- the ledger ------------------------------------------------------

    def ledger(self, predictions: DataFrame, labels: DataFrame | None = None) -> DataFrame:
        """The decisions on two streams' rows."""
        window = F.unix_micros(F.window("predicted_at", interval(self.profile.window))["start"].cast("timestamp"))
        rows = self._packed(predictions, "p", [c for c in predictions.columns if c not in PREDICTION], window)
        if labels is not None:
            payload = [c for c in labels.columns if c not in (*PREDICTION, "label_id", "received_at")]
            rows = rows.unionByName(self._packed(labels, "l", payload, F.lit(-1).cast("long")))
        self._schemas = {"predictions": predictions.schema, "labels": labels.schema if labels is not None else None}
        return rows.groupBy("model_id", "prediction_id").transformWithStateInPandas(Ledger(), _DECIDED, "Append", "None")

    @staticmethod
    def _packed(rows: DataFrame, kind: str, payload: list[str], window) -> DataFrame:
        return rows.select(
            F.col("model_id").cast("string").alias("model_id"), F.col("prediction_id").cast("string").alias("prediction_id"), F.lit(kind).alias("kind"), fingerprint(*payload).alias("hash"),
            F.to_json(F.struct(*rows.columns), _JSON).alias("payload"), window.alias("window"),
        )

    def _unpacked(self, decided: DataFrame, name: str, *outcomes: str) -> DataFrame | None:
        schema: T.StructType | None = self._schemas[name]
        if schema is None:
            return None
        rows = decided.where(F.col("outcome").isin(*outcomes)).select(F.from_json("payload", schema, _JSON).alias("p"), "window")
        return rows.select("p.*", "window")

    def on_decided(self, decided: DataFrame, batch: int) -> None:
        """``foreachBatch`` of the ledger: store what was accepted, log what each window got."""
        decided = decided.persist()
        # Windows keep the type of the event time.
        kind = self._schemas["predictions"]["predicted_at"].dataType
        accepted = with_window(self._unpacked(decided, "predictions", "insert"), "predicted_at", self.profile.window)
        self._keyed("predictions").upsert(accepted.drop("window"), batch)
        labels = self._unpacked(decided, "labels", "label")
        if labels is not None:
            self._keyed("labels").upsert(labels.withColumn("window_start", F.timestamp_micros("window").cast(kind)).drop("window"), batch)
        refused = decided.where(F.col("outcome").isin("conflict", "reject", "unknown"))
        refused.select("model_id", "prediction_id", "outcome", "payload", F.lit(batch).alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.folder}/rejected")
        newest = accepted.groupBy("model_id", "window").agg(F.count("*").alias("inserts"), F.max("predicted_at").cast("timestamp").alias("newest"))
        touched = decided.where("outcome = 'label'").groupBy("model_id", "window").agg(F.count("*").alias("labels"))
        log = newest.join(touched, ["model_id", "window"], "full")
        none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        log = log.select("model_id", "window", none("inserts"), none("labels"), F.coalesce("newest", F.timestamp_micros("window")).alias("newest"), F.lit(batch).alias("batch"))
        log.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.folder}/log")
        decided.unpersist()

    # -- windows ---------------------------------------------------------

    def signals(self, log: DataFrame) -> DataFrame:
        """What is due, from the stream of the ledger's log."""
        # The watermarked column is not passed on: late lines must be counted, not dropped.
        lines = log.withWatermark("newest", interval(self.profile.watermark)).select("model_id", "window", "inserts", "labels", "batch")
        length = int(pd.Timedelta(interval(self.profile.window)).total_seconds() * 1000)
        return lines.groupBy("model_id", "window").transformWithStateInPandas(Windows(length), _SIGNALS, "Append", "EventTime")

    def on_signals(self, signals: DataFrame, batch: int) -> None:
        """``foreachBatch`` of the windows query: drift and performance of what is due, and the windows' records."""
        due = signals.groupBy("model_id", "window").agg(
            F.max((F.col("signal") == "seal").cast("int")).alias("seals"), F.max((F.col("signal") == "stale").cast("int")).alias("stale"), F.max("n_predictions").alias("n_sealed"), F.max("late").alias("late"), F.max("upto").alias("upto")
        ).persist()
        if due.isEmpty():
            due.unpersist()
            return
        predictions = self.table("predictions")
        due = due.withColumn("window_start", F.timestamp_micros("window").cast(predictions.schema["window_start"].dataType)).persist()
        # Partition names: as many as days have a due window.
        days = [r[0] for r in due.select(F.to_date("window_start")).distinct().collect()]

        def upto(rows: DataFrame | None, which: DataFrame) -> DataFrame | None:
            if rows is None:
                return None
            rows = rows.where(F.col("window_date").isin(days)).join(which.select("model_id", "window_start", "upto"), ["model_id", "window_start"])
            return rows.where(F.col("version") <= F.col("upto")).drop("upto", "version", "window_date")

        sealing, changed = due.where("seals = 1"), due.where("seals = 1 or stale = 1")
        self._keyed("drift").upsert(drift(upto(predictions, sealing), self.baseline, self.profiled, self.bins, self.model, self.profile, self.gated), batch)
        if self.model.score and self.profile.metrics:
            labels = upto(self.table("labels"), changed)
            rows = upto(predictions, changed)
            if labels is None:
                labels = self.spark.createDataFrame([], "model_id string, prediction_id string, label_id long, label_value double, received_at timestamp")
            found = performance(rows, labels, self.model, self.profile).drop("is_retroactive")
            found = found.join(due.select("model_id", "window_start", (F.col("seals") == 0).alias("is_retroactive")), ["model_id", "window_start"])
            self._keyed("performance").upsert(found.withColumns({"revision_id": F.lit(batch).cast("long"), "computed_at": F.lit(batch).cast("long")}), batch)
            counted = window_labels(rows, labels, self.model.score).select("model_id", "window_start", "n_labels", "label_watermark")
        else:
            counted = None
        self._record(due, counted, batch)
        due.unpersist()

    def _record(self, due: DataFrame, counted: DataFrame | None, batch: int) -> None:
        """Upsert the records of the windows that a batch sealed or touched; what it did not compute stays as it was."""
        table = self._keyed("windows", "model_id", "window_start")
        days = [r[0] for r in due.select(F.to_date("window_start")).distinct().collect()]
        start, none = F.col("window_start"), lambda t: F.lit(None).cast(t)
        rows = due.select("model_id", "window_start", (start + F.expr(f"interval {interval(self.profile.window)}")).alias("window_end"), "seals", "stale", "late", "n_sealed")
        if counted is not None:
            rows = rows.join(counted, ["model_id", "window_start"], "left")
        else:
            rows = rows.withColumns({"n_labels": none("long"), "label_watermark": none("timestamp")})
        before = table.newest(days, upto=batch - 1)
        if before is None:
            old = rows.select("model_id", "window_start").limit(0).withColumns({"b_evaluated": none("long"), "b_computed": none("long"), "b_labels": none("long"), "b_watermark": none(dict(rows.dtypes)["label_watermark"])})
        else:
            old = before.select("model_id", "window_start", F.col("evaluated_at").alias("b_evaluated"), F.col("performance_computed_at").alias("b_computed"), F.col("n_labels").alias("b_labels"), F.col("label_watermark").alias("b_watermark"))
        now, computed = F.lit(batch).cast("long"), (F.col("seals") == 1) | (F.col("stale") == 1)
        joined = rows.join(old, ["model_id", "window_start"], "left")
        table.upsert(
            joined.select(
                "model_id", "window_start", "window_end", F.lit(self.profile.fingerprint()).alias("config_hash"), F.when(F.col("seals") == 1, now).otherwise(F.col("b_evaluated")).alias("evaluated_at"),
                F.when(computed, now).otherwise(F.col("b_computed")).alias("performance_computed_at"), F.when(computed, F.col("label_watermark")).otherwise(F.col("b_watermark")).alias("label_watermark"),
                F.col("n_sealed").alias("n_predictions"), F.when(computed, F.col("n_labels")).otherwise(F.col("b_labels")).alias("n_labels"), F.lit(False).alias("performance_stale"), F.col("late").alias("late_prediction_count"),
            ),
            batch,
        )

    # -- queries ---------------------------------------------------------

    def _started(self, stream: DataFrame, each, checkpoint: str, trigger: dict):
        writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
        name = "spark.sql.streaming.stateStore.providerClass"
        before = self.spark.conf.get(name, None)
        self.spark.conf.set(name, ROCKSDB)  # a query keeps the settings it starts with
        try:
            return writer.start()
        finally:
            self.spark.conf.unset(name) if before is None else self.spark.conf.set(name, before)

    def start_ledger(self, predictions: DataFrame, labels: DataFrame | None, checkpoint: str, **trigger):
        return self._started(self.ledger(predictions, labels), self.on_decided, checkpoint, trigger)

    def start_windows(self, checkpoint: str, **trigger):
        """Start after the ledger, whose log it follows."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        # A repeated batch replaces its file; the state tells its lines by their number.
        log = self.spark.readStream.schema(_LOG).option("ignoreMissingFiles", "true").parquet(f"{self.folder}/log")
        return self._started(self.signals(log), self.on_signals, checkpoint, trigger)


def windowed_counts(stream: DataFrame, at: str, window: str, watermark: str) -> DataFrame:
    """Append-mode count per window: a window appears once, when the watermark has passed it."""
    return (
        stream.withWatermark(at, interval(watermark))
        .groupBy(F.window(at, interval(window)))
        .agg(F.count("*").alias("n_predictions"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_predictions")
    )
