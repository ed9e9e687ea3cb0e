"""Idempotent ingestion of baselines, predictions and labels, and the result sinks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import Model
from tidegauge.functions.columns import fingerprint
from tidegauge.operators.profile import baseline_profile, counted_once, freeze

PREDICTION = ["model_id", "prediction_id"]


class Ingest(NamedTuple):
    insert: DataFrame
    skip: DataFrame
    conflict: DataFrame  # against the store
    reject: DataFrame  # ids with different payloads inside the batch


def with_hash(df: DataFrame, payload: list[str]) -> DataFrame:
    return df.withColumn("payload_hash", fingerprint(*payload))


def predictions(batch: DataFrame, store: DataFrame, payload: list[str]) -> Ingest:
    """Split a batch: new ids, ids stored with the same payload, with another payload, and contradictions in the batch.

    The reference point is (id, payload hash); an id repeated with one payload is one row.
    """
    hashed = with_hash(batch, payload)
    per_id = hashed.groupBy(*PREDICTION).agg(F.count_distinct("payload_hash").alias("_n"))
    clash = per_id.where("_n > 1").drop("_n")
    good = hashed.join(clash, PREDICTION, "left_anti").dropDuplicates(PREDICTION)
    known = store.select(*PREDICTION, F.col("payload_hash").alias("_stored"))
    j = good.join(known, PREDICTION, "left")
    stored = F.col("_stored")
    return Ingest(
        j.where(stored.isNull()).drop("_stored"), j.where(stored == F.col("payload_hash")).drop("_stored"), j.where(stored != F.col("payload_hash")), hashed.join(clash, PREDICTION, "left_semi")
    )


def labels(batch: DataFrame, store: DataFrame, predictions: DataFrame, payload: tuple[str, ...] = ("label_value", "labeled_at")) -> Ingest:
    """Labels of unknown predictions are rejected; an (id, payload) seen before is skipped; another payload is a correction, appended."""
    hashed = with_hash(batch, list(payload))
    known = predictions.select(*PREDICTION).distinct()
    unknown = hashed.join(known, PREDICTION, "left_anti")
    good = hashed.join(known, PREDICTION, "left_semi").dropDuplicates([*PREDICTION, "payload_hash"])
    seen = store.select(*PREDICTION, "payload_hash").distinct()
    on = [*PREDICTION, "payload_hash"]
    corrected = good.join(seen, on, "left_anti").join(store.select(*PREDICTION).distinct(), PREDICTION, "left_semi")
    return Ingest(good.join(seen, on, "left_anti"), good.join(seen, on, "left_semi"), corrected, unknown)


def late_counts(arrived: DataFrame, sealed: DataFrame) -> DataFrame:
    """``model_id, window_start, late_prediction_count``: rows that fell into a window already sealed.

    Windows are epoch aligned, so this is an equality join on their start.
    """
    return arrived.join(sealed.select("model_id", "window_start"), ["model_id", "window_start"]).groupBy("model_id", "window_start").agg(F.count("*").alias("late_prediction_count"))


def stale_windows(new_labels: DataFrame, predictions: DataFrame, sealed: DataFrame) -> DataFrame:
    """Sealed windows that labels have just touched; ``predictions`` carry ``window_start``."""
    touched = predictions.join(new_labels.select(*PREDICTION).distinct(), PREDICTION, "left_semi").select("model_id", "window_start").distinct()
    return sealed.join(touched, ["model_id", "window_start"], "left_semi")


def unevaluated(candidates: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Windows without an evaluation, interior gaps included."""
    return candidates.join(evaluated.select("model_id", "window_start"), ["model_id", "window_start"], "left_anti")


def ready(windows: DataFrame, as_of, watermark: str) -> DataFrame:
    """Windows whose end lies at least ``watermark`` before ``as_of``."""
    from tidegauge.config import interval

    return windows.where(F.col("window_end") + F.expr(f"interval {interval(watermark)}") <= F.lit(as_of).cast("timestamp"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


#: Columns that rows may carry besides what a model declares.
META = ("model_id", "prediction_id", "predicted_at", "window_start", "window_end", "baseline_id")
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def with_errors(rows: DataFrame, model: Model, allowed: tuple[str, ...] = META) -> DataFrame:
    """``rows`` with ``errors``: what each breaks of the declared features, as validation of JSON rows says it.

    Columns that are declared nowhere and columns of a wrong type are errors of every row.
    """
    kinds = dict(rows.dtypes)
    declared = {f.name for f in model.features} | set(model.segment_dimensions) | ({model.score} if model.score else set())
    unknown = sorted(set(kinds) - declared - set(allowed))
    errors = [F.lit(f"unknown features: {unknown}")] if unknown else []
    for f in model.features:
        kind = kinds.get(f.name)
        required = F.lit(f"feature '{f.name}' is required")
        if kind is None:
            errors += [] if f.nullable else [required]
            continue
        fits = kind.startswith(_NUMERIC) if f.dtype == "continuous" else kind in ("string", "boolean")
        present = F.col(f.name).isNotNull()
        if not fits:
            errors.append(F.when(present, F.lit(f"feature '{f.name}' must be " + ("numeric" if f.dtype == "continuous" else "a string or boolean"))))
        if not f.nullable:
            errors.append(F.when(~present, required))
    return rows.withColumn("errors", F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>"))


def bulk_load(rows: DataFrame, path: str, payload: list[str], at: str = "predicted_at") -> None:
    """Append rows with their payload's hash, by model and day, without a look at what is stored."""
    with_hash(rows, payload).withColumn("day", F.to_date(at)).write.mode("append").partitionBy("model_id", "day").parquet(path)


def register_baseline(rows: DataFrame, store: str, model_id: str, baseline_id: int, model: Model | None = None, replace_active: bool = False, simulate: bool = True) -> DataFrame | None:
    """Append a baseline, with its profile, and make it the model's active one; refuses to replace one silently.

    With a ``model``, rows are checked first as predictions are: the first hundred
    that break its description are returned and nothing is stored.  ``None`` means stored.
    """
    spark = rows.sparkSession
    registry = f"{store}/active"
    if exists(spark, registry) and not replace_active and spark.read.parquet(registry).where(F.col("model_id") == model_id).limit(1).count():
        raise ValueError(f"model {model_id!r} has an active baseline")
    if rows.limit(1).count() == 0:
        raise ValueError("a baseline needs rows")
    if model is not None:
        bad = with_errors(rows, model).where(F.size("errors") > 0)
        if bad.limit(1).count():
            return bad.limit(100)
    key = lambda df: df.withColumns({"model_id": F.lit(model_id), "baseline_id": F.lit(baseline_id)}).write.mode("append").partitionBy("model_id", "baseline_id")
    key(rows).parquet(f"{store}/rows")
    if model is not None:
        counted = counted_once(rows, model)
        frozen = freeze(rows, model, counted=counted)
        key(baseline_profile(rows, model, simulate=simulate, frozen=frozen, counted=counted)).parquet(f"{store}/profiles")
        key(frozen).parquet(f"{store}/bins")
    new = spark.createDataFrame([(baseline_id, model_id)], "baseline_id int, model_id string")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id").parquet(registry)
    return None


def active_baseline(spark, store: str, model_id: str, part: str = "rows") -> DataFrame:
    """The ``rows``, ``bins`` or ``profiles`` of the active baseline."""
    active = spark.read.parquet(f"{store}/active").where(F.col("model_id") == model_id).select("model_id", "baseline_id")
    rows = spark.read.parquet(f"{store}/{part}").where(F.col("model_id") == model_id)
    return rows.join(F.broadcast(active), ["model_id", "baseline_id"])  # one row


def write_results(df: DataFrame, path: str, config_hash: str, replace: bool = False) -> None:
    """Result rows stamped with the configuration; a replay overwrites the days it covers."""
    out = df.withColumn("config_hash", F.lit(config_hash)).withColumn("window_date", F.to_date("window_start"))
    w = out.write.partitionBy("model_id", "window_date")
    (w.mode("overwrite").option("partitionOverwriteMode", "dynamic") if replace else w.mode("append")).parquet(path)


def trace(windows: DataFrame, drift_results: DataFrame, feature: str, method: str) -> DataFrame:
    """One row per model: the series of one global signal by window index, for export with ``write.json``."""
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy("model_id").orderBy("window_end")) - 1
    one = drift_results.where((F.col("feature_name") == feature) & (F.col("test_method") == method) & F.col("segment_dimension").isNull())
    j = windows.select("model_id", "window_end").withColumn("i", index).join(one.select("model_id", "window_end", "statistic", "is_significant"), ["model_id", "window_end"], "left")
    points = F.sort_array(F.collect_list(F.struct("i", F.round("statistic", 4).alias("value"), "is_significant")))
    return j.groupBy("model_id").agg(points.alias("points"), F.count("*").alias("windows"), F.sum(F.col("is_significant").cast("int")).alias("significant"))
