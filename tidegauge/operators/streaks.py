"""Hysteresis classes, current streaks and suppressed episodes: gaps and islands.

Histories are result rows: a slice without a row in a window neither breaks
nor extends its streak.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.config import Gate, Profile

IDENTITY = ["model_id", "feature_name", "segment_dimension", "segment_value", "test_method"]
METRIC_IDENTITY = ["model_id", "metric_name", "segment_dimension", "segment_value"]


def classify(value: Column, status: Column, gate: Gate | dict[str, Gate], key: Column | None = None) -> Column:
    """breach, clear, dead_zone or not_computable; null where ``key`` has no gate."""

    def one(g: Gate) -> Column:
        breach, clear = (value >= g.fire, value <= g.clear) if g.direction == "above" else (value <= g.fire, value >= g.clear)
        return F.when(status == "not_computable", "not_computable").when(breach, "breach").when(clear, "clear").otherwise("dead_zone")

    if isinstance(gate, Gate):
        return one(gate)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, g in gate.items():
        out = out.when(key == name, one(g))
    return out


def classified_drift(results: DataFrame, profile: Profile) -> DataFrame:
    results = newest_only(results, IDENTITY)
    return results.withColumn("class", classify(F.col("statistic"), F.col("status"), profile.gates, F.col("test_method")))


def classified_metrics(results: DataFrame, profile: Profile) -> DataFrame:
    """The newest revision of the rows of metrics that alert; others are informational."""
    gates = {m.name: m.gate for m in profile.metrics if m.gate}
    results = newest_only(results, METRIC_IDENTITY)
    return results.where(F.col("metric_name").isin(*gates)).withColumn("class", classify(F.col("metric_value"), F.col("status"), gates, F.col("metric_name")))


def with_runs(df: DataFrame, identity: list[str], order: str = "window_end", kind: str = "class") -> DataFrame:
    """Adds ``run`` (number of the island of equal classes) and ``run_length`` (rows of it so far)."""
    w = Window.partitionBy(*identity).orderBy(order)
    changed = F.coalesce((F.lag(kind).over(w) != F.col(kind)).cast("int"), F.lit(1))
    out = df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w)).drop("_c")
    return out.withColumn("run_length", F.row_number().over(Window.partitionBy(*identity, "run").orderBy(order)))


def last_windows(df: DataFrame, identity: list[str], n: int, order: str = "window_end") -> DataFrame:
    """The newest ``n`` rows of each identity."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*identity).orderBy(F.col(order).desc()))).where(F.col("_r") <= n).drop("_r")


def current_streaks(df: DataFrame, identity: list[str], scan: int, order: str = "window_end") -> DataFrame:
    """``identity, class, streak``: the newest unbroken run, at most ``scan`` rows long."""
    runs = with_runs(last_windows(df, identity, scan, order), identity, order)
    newest = F.max_by(F.struct("class", "run_length"), F.col(order))
    return runs.groupBy(*identity).agg(newest.alias("_s")).select(*identity, F.col("_s.class").alias("class"), F.col("_s.run_length").alias("streak"))


def suppressed_episodes(df: DataFrame, identity: list[str], persistence: int, target: str, value: str = "statistic", order: str = "window_end") -> DataFrame:
    """Maximal runs of ``target`` shorter than ``persistence``, the last one included while it lasts."""
    runs = with_runs(df, identity, order).where(F.col("class") == target)
    return (
        runs.groupBy(*identity, "run")
        .agg(F.min(order).alias("first_window"), F.max(order).alias("last_window"), F.count("*").alias("length"), F.max(value).alias("peak"))
        .where(F.col("length") < persistence)
        .drop("run")
        .withColumn("kind", F.lit(target))
    )


def latest_revision(results: DataFrame, by: list[str]) -> DataFrame:
    """The newest revision of each row of ``by``, by (computed_at, revision_id)."""
    rest = [c for c in results.columns if c not in by]
    return results.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("computed_at", "revision_id")).alias("_r")).select(*by, "_r.*")


def newest_only(results: DataFrame, identity: list[str]) -> DataFrame:
    """Results without superseded revisions; results that carry no revisions are as they are."""
    if not {"computed_at", "revision_id"} <= set(results.columns):
        return results
    return latest_revision(results, [*identity, "window_end"])


def first_and_latest_revision(results: DataFrame, by: list[str]) -> DataFrame:
    """Two rows per row of ``by``, marked ``initial`` and ``latest`` in ``revision``; the same one when there is one."""
    rest = [c for c in results.columns if c not in by]
    at, row = F.struct("computed_at", "revision_id"), F.struct(*rest)
    both = results.groupBy(*by).agg(F.min_by(row, at).alias("a"), F.max_by(row, at).alias("b"))
    pair = F.array(F.struct(F.lit("initial").alias("revision"), F.col("a").alias("r")), F.struct(F.lit("latest").alias("revision"), F.col("b").alias("r")))
    return both.select(*by, F.explode(pair).alias("p")).select(*by, "p.revision", "p.r.*")
