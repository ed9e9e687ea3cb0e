"""Performance of labelled predictions per window and slice.

Rows are first counted by (slice, score).  Ranking metrics need the counts above
each score: scores are cut into ranges by a sketch of each slice, running sums
are taken inside a range and offset by the sums of the ranges above, so a window
with any number of distinct scores is sorted by many tasks.

Metrics of users come in two kinds.  A :class:`PartialMetric` keeps a state of a
few numbers, which tasks update batch by batch and merge afterwards, so a slice of
any size needs no task of its own.  A plain function gets all pairs of a slice at
once, in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.config import Metric, Model, Profile, interval
from tidegauge.operators.profile import SLICE
from tidegauge.operators.shape import listed, slices
from tidegauge.sources.scratch import written

KEYS = ["model_id", "window_start", "window_end"]
#: Fixed value: a reason, as are the texts of `performance`.
ROC_UNDEFINED = "roc_auc is undefined when only one class is present in y_true"
ROW = "metric_name string, value double, reason string"

#: Ranges that the distinct scores of a slice are cut into.
RANGES = 64
RANKING = ("pr_auc", "roc_auc", "precision_at_k")
#: Slices whose states a task holds before it gives them out.
HELD_SLICES = 10_000


class PartialMetric(Protocol):
    """A metric by states of a fixed number of floats; ``finish`` raises ValueError when it is not computable."""

    def init(self, params: dict) -> list[float]: ...
    def update(self, state: list[float], y: np.ndarray, p: np.ndarray, params: dict) -> list[float]: ...
    def merge(self, a: list[float], b: list[float], params: dict) -> list[float]: ...
    def finish(self, state: list[float], params: dict) -> float: ...


#: Metrics of users by name: a PartialMetric, or fn(y_true, y_pred, params) -> float; ValueError means not computable.
_registered: dict[str, Callable | PartialMetric] = {}


def register(name: str):
    def add(metric):
        _registered[name] = metric() if isinstance(metric, type) else metric
        return metric

    return add


def available_metrics() -> list[str]:
    return sorted([*RANKING, "precision_at_threshold", "recall_at_threshold", "rmse", "mae", *_registered])


def latest_label(labels: DataFrame, keys: tuple[str, ...] = ("model_id", "prediction_id")) -> DataFrame:
    """The newest label of each prediction by (received_at, label_id)."""
    rest = [c for c in labels.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("received_at", "label_id"))
    return labels.groupBy(*keys).agg(newest.alias("_l")).select(*keys, "_l.*")


def labelled(predictions: DataFrame, labels: DataFrame, score: str = "prediction_score") -> DataFrame:
    """Scored predictions with their latest label.

    Labels are dealt by prediction before they are compared, as few of one prediction
    lie in one task; where all rows are one model's, grouping and join then share this
    one exchange and its sort (among several models the join deals them once more).
    """
    keys = ["prediction_id", "model_id"]
    newest = latest_label(labels.repartition(keys[0]), tuple(keys)).select(*keys, "label_value", "received_at")
    rest = [c for c in predictions.columns if c not in keys]
    return predictions.where(F.col(score).isNotNull()).join(newest, keys).select("model_id", "prediction_id", *rest, "label_value", "received_at")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _native(m: Metric) -> tuple[list[Column], Callable[[], tuple[Column, Column]]] | None:
    """Aggregates a metric needs over (score, n, pos, ...) rows, and its value and reason from them."""
    none = F.lit(None).cast("string")
    n, pos = F.col("n"), F.col("pos")
    if m.name in ("precision_at_threshold", "recall_at_threshold"):
        t, tag = float(m.params["threshold"]), f"{m.name}_{m.params['threshold']}".replace(".", "_").replace("-", "m")
        taken = F.col("score") >= t
        aggs = [F.sum(F.when(taken, pos).otherwise(0)).alias(f"tp_{tag}"), F.sum(F.when(taken, n).otherwise(0)).alias(f"pp_{tag}")]
        below = "pp_" + tag if m.name[0] == "p" else "P"
        return aggs, lambda: (_ratio(F.col(f"tp_{tag}"), F.col(below)), none)
    if m.name == "precision_at_k":
        k = int(m.params["n"])
        take = F.greatest(F.lit(0), F.least(F.lit(k) - (F.col("cum_n") - n), n))
        aggs = [F.sum(F.least(take, pos)).alias(f"hit_{k}"), F.sum(take).alias(f"took_{k}")]
        return aggs, lambda: (_ratio(F.col(f"hit_{k}"), F.col(f"took_{k}")), none)
    if m.name == "pr_auc":
        return [F.sum(pos * F.col("cum_pos") / F.col("cum_n")).alias("ap")], lambda: (_ratio(F.col("ap"), F.col("P")), none)
    if m.name == "roc_auc":
        # Pairs in which a negative outranks a positive; a tie counts half.
        neg, cum_neg = n - pos, F.col("cum_n") - F.col("cum_pos")
        one = (F.col("P") == 0) | (F.col("P") == F.col("N"))
        return [F.sum(pos * (cum_neg - neg / 2)).alias("lost")], lambda: (
            F.when(~one, 1 - F.col("lost") / (F.col("P") * (F.col("N") - F.col("P")))), F.when(one, ROC_UNDEFINED),
        )
    if m.name == "rmse":
        return [F.sum("se").alias("sse")], lambda: (F.sqrt(F.col("sse") / F.col("N")), none)
    if m.name == "mae":
        return [F.sum("ae").alias("sae")], lambda: (F.col("sae") / F.col("N"), none)
    return None


def evaluate(pairs: DataFrame, metrics: tuple[Metric, ...], by: list[str], score: str = "prediction_score", label: str = "label_value") -> DataFrame:
    """``by, n_labeled, metric_name, value, reason`` of labelled rows."""
    y, p = F.col(label).cast("double"), F.col(score).cast("double")
    rows = pairs.select(*by, p.alias("score"), y.alias("y"))
    err = F.col("y") - F.col("score")
    per_score = rows.groupBy(*by, "score").agg(
        F.count("*").alias("n"), F.sum((F.col("y") == 1).cast("int")).alias("pos"), F.sum(err * err).alias("se"), F.sum(F.abs(err)).alias("ae")
    )
    if any(m.name in RANKING for m in metrics):
        per_score = _ranked(written(per_score, "scores"), by)
    native = [(m, _native(m)) for m in metrics]
    aggs = [a for _, x in native if x for a in x[0]]
    summed = per_score.groupBy(*by).agg(F.sum("n").alias("N"), F.sum("pos").alias("P"), *aggs)
    entries = [F.struct(F.lit(m.name).alias("metric_name"), v.cast("double").alias("value"), r.alias("reason")) for m, x in native if x for v, r in [x[1]()]]
    out = summed.select(*by, F.col("N").alias("n_labeled"), F.explode(F.array(*entries)).alias("_m")).select(*by, "n_labeled", "_m.*") if entries else None
    own = [m for m, x in native if x is None]
    for found, how in ((_by_states, [m for m in own if hasattr(_registered[m.name], "update")]), (_by_user, [m for m in own if not hasattr(_registered[m.name], "update")])):
        if how:
            extra = found(rows, how, by)
            out = extra if out is None else out.unionByName(extra)
    return out


def _ranked(per_score: DataFrame, by: list[str]) -> DataFrame:
    """Counted scores with ``cum_n`` and ``cum_pos``: rows and positives of their slice at or above them."""
    same = lambda left, right, on: [left[c].eqNullSafe(right[f"_{c}"]) for c in on]
    renamed = lambda df, on: df.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in df.columns if c not in on])
    cuts = renamed(per_score.groupBy(*by).agg(F.percentile_approx("score", F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), 1_000).alias("cuts")), by)
    cut = per_score.join(cuts, same(per_score, cuts, by)).withColumn("part", F.size(F.filter("cuts", lambda c: c <= F.col("score")))).select(*by, "part", "score", "n", "pos", "se", "ae")
    down = lambda *keys: Window.partitionBy(*keys).orderBy
    sums = cut.groupBy(*by, "part").agg(F.sum("n").alias("sn"), F.sum("pos").alias("sp"))
    above = down(*by)(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    offsets = renamed(sums.select(*by, "part", F.coalesce(F.sum("sn").over(above), none).alias("above_n"), F.coalesce(F.sum("sp").over(above), none).alias("above_pos")), [*by, "part"])
    inside = down(*by, "part")(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumns({"cum_n": F.sum("n").over(inside), "cum_pos": F.sum("pos").over(inside)})
    j = cut.join(offsets, same(cut, offsets, [*by, "part"]))
    return j.select(*by, "score", "n", "pos", "se", "ae", (F.col("cum_n") + F.col("above_n")).alias("cum_n"), (F.col("cum_pos") + F.col("above_pos")).alias("cum_pos"))


def _by_states(rows: DataFrame, metrics: list[Metric], by: list[str]) -> DataFrame:
    """Metrics by states: tasks keep one state a slice and metric, which are merged as they come from the shuffle."""
    fns = [(k, m, _registered[m.name]) for k, m in enumerate(metrics)]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    keys = ", ".join(f"`{b}` {kinds[b]}" for b in by)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        schema = None

        def given() -> pa.RecordBatch:
            flat = [(*key, k, n, s) for key, (n, states) in held.items() for k, s in enumerate(states)]
            columns = list(zip(*flat, strict=True)) if flat else [[] for _ in range(len(by) + 3)]
            held.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [*schema, pa.int32(), pa.int64(), pa.list_(pa.float64())], strict=True)], names=[*by, "metric", "n", "state"])

        for b in batches:
            schema = schema or [b.schema.field(c).type for c in by]
            pdf = b.to_pandas()
            # Keys go by their place in the batch, so that their types stay as they are.
            number = pdf.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(number, kind="stable")
            cut = np.concatenate([[0], np.cumsum(np.bincount(number))]) if len(number) else np.zeros(1, int)
            y, p = pdf["y"].to_numpy(float), pdf["score"].to_numpy(float)
            firsts = b.select(by).take(pa.array(order[cut[:-1]])).to_pylist() if len(number) else []
            for first, lo, hi in zip(firsts, cut[:-1], cut[1:], strict=True):
                key, mine = tuple(first[c] for c in by), order[lo:hi]
                n, states = held.get(key) or (0, [fn.init(m.params) for _, m, fn in fns])
                held[key] = (n + len(mine), [fn.update(s, y[mine], p[mine], m.params) for s, (_, m, fn) in zip(states, fns, strict=True)])
            if len(held) > HELD_SLICES:
                yield given()
        if held:
            yield given()

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, m, fn = fns[key[-1].as_py()]
        state, n, schema = None, 0, None
        for b in batches:
            schema = b.schema
            for more, s in zip(b.column("n").to_pylist(), b.column("state").to_pylist(), strict=True):
                state, n = s if state is None else fn.merge(state, s, m.params), n + more
        try:
            value, reason = float(fn.finish(state, m.params)), None
        except ValueError as e:
            value, reason = None, str(e)
        columns = [pa.array([k.as_py()], schema.field(c).type) for c, k in zip(by, key, strict=False)]
        yield pa.record_batch([*columns, pa.array([n], pa.int64()), pa.array([m.name]), pa.array([value], pa.float64()), pa.array([reason], pa.string())], names=[*by, "n_labeled", "metric_name", "value", "reason"])

    states = rows.mapInArrow(partial, f"{keys}, metric int, n long, state array<double>")
    return states.groupBy(*by, "metric").applyInArrow(merge, f"{keys}, n_labeled long, {ROW}")


def _by_user(rows: DataFrame, metrics: list[Metric], by: list[str]) -> DataFrame:
    """Metrics of users need all pairs of a slice at once: one group is one slice of one window."""
    fns = [(m, _registered[m.name]) for m in metrics]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, out = pdf.iloc[0][by].tolist(), []
        for m, fn in fns:
            try:
                value, reason = float(fn(pdf["y"].tolist(), pdf["score"].tolist(), m.params)), None
            except ValueError as e:
                value, reason = None, str(e)
            out.append([*keys, len(pdf), m.name, value, reason])
        return pd.DataFrame(out, columns=[*by, "n_labeled", "metric_name", "value", "reason"])

    schema = ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", n_labeled long, " + ROW
    return rows.groupBy(*by).applyInPandas(run, schema)


def _measured(pairs: DataFrame, slots: DataFrame, model: Model, profile: Profile) -> DataFrame:
    """Metrics of labelled rows by slot (``KEYS``, and what else ``slots`` has) and slice; a slot without rows gets its global ones.

    The labelled rows are read once: which slots have none is seen in the results.
    """
    at = slots.columns
    by = [*at, *SLICE]
    names = listed(slots.sparkSession, [(m.name,) for m in profile.metrics], "metric_name: string")
    none = F.lit(None)
    empty = slots.join(F.broadcast(names)).select(
        *at, none.cast("string").alias(SLICE[0]), none.cast("string").alias(SLICE[1]), F.lit(0).cast("long").alias("n_labeled"), "metric_name", none.cast("double").alias("value"), none.cast("string").alias("reason")
    )
    most = F.max("n_labeled").over(Window.partitionBy(*at))  # over a slot's result rows
    found = evaluate(slices(pairs, model), profile.metrics, by, model.score).unionByName(empty).withColumn("_most", most).where("n_labeled > 0 or _most = 0")
    least = F.when(F.col(SLICE[0]).isNull(), profile.min_window_size).otherwise(model.min_segment_size)
    scope = F.when(F.col(SLICE[0]).isNull(), F.lit("window")).otherwise(F.format_string("segment %s='%s'", *SLICE))
    small = F.when(F.col("n_labeled") < least, F.format_string("%s has %d labeled predictions, below configured minimum of %d", scope, "n_labeled", least))
    reason = F.coalesce(small, F.col("reason"))
    return found.select(
        *KEYS, *SLICE, "metric_name", F.when(reason.isNull(), "computed").otherwise("not_computable").alias("status"), F.when(reason.isNull(), F.col("value")).alias("metric_value"),
        reason.alias("not_computable_reason"), "n_labeled", *at[len(KEYS):],
    )


def performance(predictions: DataFrame, labels: DataFrame, model: Model, profile: Profile, retroactive: bool = False) -> DataFrame:
    """One row per window, slice with labelled rows, and configured metric; predictions carry ``KEYS``.

    A window without any labelled row still gets its global rows.
    """
    found = _measured(labelled(predictions, labels, model.score), predictions.select(*KEYS).distinct(), model, profile)
    return found.withColumn("is_retroactive", F.lit(retroactive))


def performance_revisions(predictions: DataFrame, labels: DataFrame, model: Model, profile: Profile, early: str) -> DataFrame:
    """:func:`performance` from labels that came within ``early`` of their prediction and, as ``is_retroactive``, from all: labels are joined and rows counted once for both."""
    keys = ["model_id", "prediction_id"]
    soon = F.col("received_at") < F.col("predicted_at") + F.expr(f"interval {interval(early)}")
    newest = lambda at: F.max_by(F.struct("label_value"), at)
    order = F.struct("received_at", "label_id")
    known = labels.select(*keys, "label_id", "label_value", "received_at").join(predictions.select(*keys, "predicted_at"), keys)
    both = known.groupBy(*keys).agg(newest(F.when(soon, order)).alias("_early"), newest(order).alias("_all"))
    each = F.array(*[F.struct(F.lit(late).alias("late"), F.col(c).alias("l")) for c, late in (("_early", False), ("_all", True))])
    pairs = predictions.where(F.col(model.score).isNotNull()).join(both, keys).withColumn("_l", F.explode(each)).where("_l.l is not null")
    pairs = pairs.withColumns({"label_value": F.col("_l.l.label_value"), "is_retroactive": F.col("_l.late")}).drop("_early", "_all", "_l")
    slots = predictions.select(*KEYS).distinct().withColumn("is_retroactive", F.explode(F.array(F.lit(False), F.lit(True))))
    return _measured(pairs, slots, model, profile)


def window_labels(predictions: DataFrame, labels: DataFrame, score: str = "prediction_score") -> DataFrame:
    """Per window: predictions, labelled predictions, newest label time."""
    n = predictions.groupBy(*KEYS).agg(F.count("*").alias("n_predictions"))
    m = labelled(predictions, labels, score).groupBy(*KEYS).agg(F.count("*").alias("n_labels"), F.max("received_at").alias("label_watermark"))
    return n.join(m, KEYS, "left").withColumn("n_labels", F.coalesce("n_labels", F.lit(0)))
