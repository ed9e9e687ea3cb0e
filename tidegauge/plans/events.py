"""The monitored tables of the registered queries: events, line items and documents in their roles."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import Feature, Gate, Metric, Model, Profile
from tidegauge.operators.drift import drift, live_counts
from tidegauge.operators.profile import baseline_profile, counted_once, freeze
from tidegauge.operators.shape import with_window

#: Events before this day are the baseline.
SPLIT = "2024-01-11"
LINE_SPLIT = "1997-01-01"

EVENTS = Model(
    (Feature("value", "continuous"), Feature("k", "continuous", nullable=True), Feature("user_group", "categorical"), Feature("event_type", "categorical")),
    ("event_type",),
)
GATES = {"psi": Gate(0.10, 0.07), "ks": Gate(0.08, 0.05), "chi_square": Gate(0.06, 0.03), "jsd": Gate(0.02, 0.01)}
METRICS = (
    Metric("pr_auc", gate=Gate(0.25, 0.32, "below")),
    Metric("roc_auc"),
    Metric("precision_at_threshold", {"threshold": 0.5}),
    Metric("recall_at_threshold", {"threshold": 0.5}),
    Metric("precision_at_k", {"n": 20}),
)
DAILY = Profile(
    window="1d", gates=GATES, metrics=METRICS, fire_persistence=2, escalate_persistence=3, resolve_persistence=2, not_computable_persistence=2, history_scan_windows=6, max_alerts_per_run=3, fdr_alpha=0.1, exact_ks=500
)


def only(*methods: str, **change) -> Profile:
    """The daily profile with some drift methods."""
    return replace(DAILY, continuous=tuple(m for m in methods if m in ("psi", "ks")), categorical=tuple(m for m in methods if m == "chi_square"), **change)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str, window: str = "1d") -> DataFrame:
    """Events as predictions of one model, with their window."""
    e = table(spark, sf_dir, "events")
    p = e.select(
        F.lit("events").alias("model_id"), F.col("event_id").alias("prediction_id"), F.col("ts").alias("predicted_at"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"),
        (F.col("user_id") % 6).cast("string").alias("user_group"), "event_type", (F.col("value") / (F.col("value") + 50)).alias("prediction_score"),
    )
    return with_window(p, "predicted_at", window)


def baseline_and_live(spark, sf_dir, window: str = "1d") -> tuple[DataFrame, DataFrame]:
    p = predictions(spark, sf_dir, window)
    at = F.lit(SPLIT).cast("timestamp_ntz")
    return p.where(F.col("predicted_at") < at), p.where(F.col("predicted_at") >= at)


def measured_by(model: Model, methods: tuple[str, ...]) -> Model:
    """The model with the features and the score that some of the methods test."""
    kinds = {k for k, ms in (("continuous", ("psi", "ks")), ("categorical", ("chi_square",))) if set(ms) & set(methods)}
    return replace(model, features=tuple(f for f in model.features if f.dtype in kinds), score=model.score if "jsd" in methods else None)


def testing(profile: Profile, methods: tuple[str, ...]) -> Profile:
    """The profile with these methods only, where none has p-values: those are corrected together with all others of the profile."""
    if set(methods) & {"ks", "chi_square"}:
        return profile
    return replace(profile, continuous=tuple(m for m in profile.continuous if m in methods), categorical=())


def drift_of(
    spark, sf_dir, profile: Profile, model: Model = EVENTS, gated: bool = True, window: str = "1d", simulate: bool = False, methods: tuple[str, ...] | None = None
) -> DataFrame:
    """Drift of live events; with ``methods``, of these alone: other features are not even counted."""
    return drifts_of(spark, sf_dir, [(profile, gated)], model, window, simulate, methods)[0]


def drifts_of(
    spark, sf_dir, judged: list[tuple[Profile, bool]], model: Model = EVENTS, window: str = "1d", simulate: bool = False, methods: tuple[str, ...] | None = None
) -> list[DataFrame]:
    """Drift of live events under several profiles, gated or not, from one count of the events; the first profile has all methods of the others."""
    base, live = baseline_and_live(spark, sf_dir, window)
    if methods:
        model, judged = measured_by(model, methods), [(testing(p, methods), gated) for p, gated in judged]
    counted = counted_once(base, model)
    frozen = freeze(base, model, counted=counted)
    profiled = baseline_profile(base, model, simulate=simulate, frozen=frozen, counted=counted)
    counts = live_counts(live, frozen, model, judged[0][0])
    out = [drift(live, base, profiled, frozen, model, p, gated, counted, counts) for p, gated in judged]
    return [r.where(F.col("test_method").isin(*methods)) for r in out] if methods else out


def labels(spark, sf_dir) -> DataFrame:
    """Labels of events, hours later; one in ten is corrected a day after."""
    e = table(spark, sf_dir, "events")
    y = ((F.col("event_id") * 7919) % 10 < 3).cast("double")
    at = F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 72).cast("int"))
    base = e.select(F.lit("events").alias("model_id"), F.col("event_id").alias("prediction_id"), (F.col("event_id") * 2).alias("label_id"), y.alias("label_value"), at.alias("received_at"))
    fix = base.where("prediction_id % 10 = 0").select("model_id", "prediction_id", F.col("label_id") + 1, 1 - F.col("label_value"), F.col("received_at") + F.expr("interval 1 day"))
    return base.unionAll(fix)


def lines(spark, sf_dir) -> DataFrame:
    """Line items as regression predictions, half a month to a window."""
    t = table(spark, sf_dir, "lineitem")
    p = t.select(
        F.lit("prices").alias("model_id"), F.col("l_shipdate").alias("predicted_at"), "l_returnflag", F.col("l_extendedprice").alias("label_value"), (F.col("l_quantity") * 1500).alias("prediction_score")
    )
    return with_window(p, "predicted_at", "30d")
