"""The alert state machine, its rollup and the notification outbox.

Statistics are already reduced to one row per window and signal when they get
here.  The machine is folded without a fold: what resolves an alert leads to the
quiet state from any other, so a history falls into stretches that end with such a
row and begin quiet.  In a stretch an alert opens at the first row that may open
one and escalates at the first later row that escalates.  Stretches are a running
count, so a history of any length folds with window functions, signal by signal;
a new day folds the same way from the stored open alerts and runs.

A rollup ties the signals of a run together: with more opens in one run than the
cap, none of them opens.  Whether a run rolls up depends on the runs before it
alone, so decisions are found in supersteps, by counts of a run: signals lie in
rows of their own and no (model, kind) is one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.config import Profile
from tidegauge.operators.streaks import classified_drift, classified_metrics, with_runs
from tidegauge.sources.scratch import written

SIGNAL = ["model_id", "kind", "signal_name", "feature_name", "segment_dimension", "segment_value"]
IDENTITY = ["model_id", "kind", "source", "signal_name", "feature_name", "segment_dimension", "segment_value"]
#: What a run's rollup couples.
GROUP = ["model_id", "kind", "source"]
ALERTS = [
    *SIGNAL, "status", "opened_window", "last_seen_window", "escalated_window", "resolved_window", "breaching", "clear", "evidence_statistic", "evidence_threshold", "evidence_reason",
    "escalation_statistic", "escalation_threshold", "is_aggregate", "aggregated_signal_count", "aggregated_signals", "source",
]
_SIGNALS = "array<struct<signal_name:string,feature_name:string,segment_dimension:string,segment_value:string>>"
#: Fixed value: why an aggregate stands for signals.
ROLLED_UP = "%d signals opened in one evaluation run, rolled up (cap=%d)"


def alert_events(drift_results: DataFrame | None, metric_results: DataFrame | None, profile: Profile, runs: DataFrame | None = None) -> DataFrame:
    """One row per window and signal identity: its class, its streak so far, its value and threshold.

    Every signal appears twice: under its own kind and under the kind
    ``not_computable``.  ``source`` keeps drift and performance apart in rollups.
    ``runs`` are the runs that signals were in before these windows
    (:func:`last_runs`); a first run of the same class goes on.
    """
    parts = []
    if drift_results is not None:
        fire = F.create_map(*[x for m, g in profile.gates.items() for x in (F.lit(m), F.lit(g.fire))])
        d = classified_drift(drift_results, profile)
        parts.append(d.select(
            "model_id", F.lit("drift").alias("source"), F.col("test_method").alias("signal_name"), "feature_name", "segment_dimension", "segment_value", "window_end", "class",
            F.col("statistic").alias("value"), fire[F.col("test_method")].alias("threshold"), F.col("not_computable_reason").alias("reason"),
        ))
    if metric_results is not None:
        fire = F.create_map(*[x for m in profile.metrics if m.gate for x in (F.lit(m.name), F.lit(m.gate.fire))])
        m = classified_metrics(metric_results, profile)
        parts.append(m.select(
            "model_id", F.lit("performance").alias("source"), F.col("metric_name").alias("signal_name"), F.lit(None).cast("string").alias("feature_name"), "segment_dimension", "segment_value", "window_end", "class",
            F.col("metric_value").alias("value"), fire[F.col("metric_name")].alias("threshold"), F.col("not_computable_reason").alias("reason"),
        ))
    events = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    identity = [c for c in IDENTITY if c != "kind"]
    with_run = with_runs(events, identity)
    if runs is not None:
        before = _beside(with_run, runs.select(*identity, F.col("class").alias("_class"), F.col("run_length").alias("_before")), identity)
        goes_on = (F.col("run") == 1) & (F.col("class") == F.col("_class"))
        with_run = before.withColumn("run_length", F.col("run_length") + F.when(goes_on, F.col("_before")).otherwise(0)).drop("_class", "_before")
    with_run = with_run.withColumn("streak", F.least("run_length", F.lit(profile.history_scan_windows)))
    return with_run.drop("run").select("*", F.explode(F.array(F.col("source"), F.lit("not_computable"))).alias("kind"))


def last_runs(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The run each signal is in after its newest window: what a later day starts from.

    Signals without a window in ``events`` are still in the run they were in ``before``.
    """
    identity = [c for c in IDENTITY if c != "kind"]
    newest = F.max_by(F.struct("class", "run_length"), "window_end")
    new = events.where(F.col("kind") == F.col("source")).groupBy(*identity).agg(newest.alias("_r")).select(*identity, "_r.*")
    if before is None:
        return new
    rest = _beside(before, new.select(*identity, F.lit(True).alias("_new")), identity).where("_new is null").drop("_new")
    return new.unionByName(rest.select(*new.columns))


_PLAIN = ("model_id", "kind", "source", "signal_name", "window_end", "opened_window")


def _beside(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join on keys of which some may be null; the right side's keys are dropped."""
    r = right.select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in right.columns])
    cond = None
    for c in on:
        eq = left[c] == r[f"_{c}"] if c in _PLAIN else left[c].eqNullSafe(r[f"_{c}"])
        cond = eq if cond is None else cond & eq
    return left.join(r, cond, how).drop(*[f"_{c}" for c in on])


def _stretches(events: DataFrame, profile: Profile) -> DataFrame:
    """``events`` with what each row may do, and the number of its stretch."""
    quiet, kind, streak = F.col("kind") == "not_computable", F.col("class"), F.col("streak")
    opens = F.when(quiet, (kind == "not_computable") & (streak >= profile.not_computable_persistence)).otherwise((kind == "breach") & (streak >= profile.fire_persistence))
    resolves = F.when(quiet, kind != "not_computable").otherwise((kind == "clear") & (streak >= profile.resolve_persistence))
    out = events.withColumns({"opens": opens, "escalates": ~quiet & (kind == "breach") & (streak >= profile.escalate_persistence), "resolves": resolves})
    before = Window.partitionBy(*IDENTITY).orderBy("window_end").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("stretch", F.coalesce(F.sum(F.col("resolves").cast("int")).over(before), F.lit(0)))


def rolled_runs(rows: DataFrame, cap: int) -> DataFrame:
    """``GROUP, window_end`` of the runs in which more than ``cap`` signals would open.

    ``rows`` come from :func:`_stretches`, without signals that are open from
    before.  A superstep counts, for each run not decided, the signals that open in
    it for certain (every earlier run of their stretch that could have opened them
    was rolled up) and those that may (none has opened them for certain).  The
    earliest run of each group is always decided, others often with it.
    """
    run = [*GROUP, "window_end"]
    may = rows.where("opens").select(*IDENTITY, "stretch", "window_end")
    crowded = may.groupBy(*run).agg(F.count("*").alias("n")).where(F.col("n") > cap).select(*run)
    # Runs that are never crowded open what they may; the rest is to be decided.
    decided = written(crowded.withColumn("decision", F.lit(None).cast("string")), "rollup")
    if decided.isEmpty():
        return decided.select(*run)
    may = written(may.join(crowded.select(*GROUP).distinct(), GROUP, "left_semi"), "opens")
    earlier = Window.partitionBy(*IDENTITY, "stretch").orderBy("window_end").rowsBetween(Window.unboundedPreceding, -1)
    while not decided.where("decision is null").isEmpty():
        j = may.join(decided.withColumn("open_question", F.lit(True)), run, "left").withColumn("decision", F.when(F.col("open_question"), F.col("decision")).otherwise("open"))
        opened = F.coalesce(F.max((F.coalesce("decision", F.lit("")) == "open").cast("int")).over(earlier), F.lit(0)) == 1
        unsure = F.coalesce(F.max(F.col("decision").isNull().cast("int")).over(earlier), F.lit(0)) == 1
        counts = j.withColumns({"may": ~opened, "must": ~opened & ~unsure}).where("decision is null").groupBy(*run).agg(F.sum(F.col("may").cast("int")).alias("most"), F.sum(F.col("must").cast("int")).alias("least"))
        new = decided.join(counts, run, "left").withColumn("decision", F.coalesce("decision", F.when(F.col("least") > cap, "rolled").when(F.col("most") <= cap, "open")))
        decided = written(new.select(*run, "decision"), "rollup")
    return decided.where("decision = 'rolled'").select(*run)


def _alerts_of(rows: DataFrame, window_type: str) -> DataFrame:
    """One row per stretch in which an alert was open; ``was`` is the alert that its first stretch began with."""
    none = lambda t: F.lit(None).cast(t)
    stretch = Window.partitionBy(*IDENTITY, "stretch")
    at = F.col("window_end")
    rows = rows.withColumn("opened", F.coalesce(F.col("was.opened_window"), F.min(F.when(F.col("opens"), at)).over(stretch))).where(at >= F.col("opened"))
    first, escalates = at == F.col("opened"), F.col("escalates") & (at > F.col("opened"))
    quiet, kind = F.col("kind") == "not_computable", F.col("class")
    counters = F.struct(F.when(kind == "breach", F.col("streak")).otherwise(0).cast("int").alias("breaching"), F.when(kind == "clear", F.col("streak")).otherwise(0).cast("int").alias("clear"))
    found = rows.groupBy(*IDENTITY, "stretch").agg(
        F.min("opened").alias("opened_window"), F.max(at).alias("last_seen_window"), F.min(F.when(escalates, at)).alias("escalated"), F.max(F.when(F.col("resolves"), at)).alias("resolved_window"),
        F.max_by(F.when(~quiet, counters), F.when(~quiet & (kind != "not_computable"), at)).alias("counters"), F.max(F.when(first, F.struct("value", "threshold", "reason"))).alias("evidence"),
        F.min_by(F.struct("value", "threshold"), F.when(escalates, at)).alias("escalation"), F.first("was").alias("was"),
    )
    was = F.col("was.opened_window").isNotNull()
    old = lambda c: F.col(f"was.{c}")
    escalated = F.when(old("escalated_window").isNotNull(), old("escalated_window")).otherwise(F.col("escalated"))
    again = F.when(old("escalated_window").isNotNull(), F.struct(old("escalation_statistic").alias("value"), old("escalation_threshold").alias("threshold"))).otherwise(F.col("escalation"))
    found = found.withColumns({"escalated_window": escalated, "again": again})
    return found.select(
        *SIGNAL, F.when(F.col("resolved_window").isNotNull(), "resolved").when(F.col("escalated_window").isNotNull(), "escalated").otherwise("open").alias("status"),
        "opened_window", "last_seen_window", F.col("escalated_window").cast(window_type).alias("escalated_window"), "resolved_window",
        F.coalesce("counters.breaching", F.when(was, old("breaching")), F.lit(0)).alias("breaching"), F.coalesce("counters.clear", F.when(was, old("clear")), F.lit(0)).alias("clear"),
        F.when(was, old("evidence_statistic")).otherwise(F.col("evidence.value")).alias("evidence_statistic"), F.when(was, old("evidence_threshold")).when(~quiet, F.col("evidence.threshold")).alias("evidence_threshold"),
        F.when(was, old("evidence_reason")).otherwise(F.col("evidence.reason")).alias("evidence_reason"), F.col("again.value").alias("escalation_statistic"), F.col("again.threshold").alias("escalation_threshold"),
        F.lit(False).alias("is_aggregate"), none("int").alias("aggregated_signal_count"), none(_SIGNALS).alias("aggregated_signals"), "source",
    )


def rolled_signals(rows: DataFrame, rolled: DataFrame) -> DataFrame:
    """``GROUP, window_end`` and the signal, in a row each, of what rolled-up runs would have opened."""
    run = [*GROUP, "window_end"]
    j = rows.join(rolled.withColumn("_rolled", F.lit(True)), run, "left").where("opens").withColumn("_rolled", F.coalesce("_rolled", F.lit(False)))
    earlier = Window.partitionBy(*IDENTITY, "stretch").orderBy("window_end").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.max((~F.col("_rolled")).cast("int")).over(earlier), F.lit(0)) == 1
    return j.withColumn("_opened", opened).where("_rolled and not _opened").select(*run, *[c for c in IDENTITY if c not in GROUP])


def _aggregates(rows: DataFrame, rolled: DataFrame, cap: int, before: DataFrame | None, window_type: str) -> DataFrame:
    """One row per unbroken series of rolled-up runs of a group; the next run resolves it."""
    none = lambda t: F.lit(None).cast(t)
    run = [*GROUP, "window_end"]
    groups = rolled.select(*GROUP)
    if before is not None:
        groups = groups.unionByName(before.select(*GROUP))
    each = rolled_signals(rows, rolled).groupBy(*run).agg(F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list(F.struct("signal_name", "feature_name", "segment_dimension", "segment_value"))).alias("signals"))
    runs = rows.select(*run).distinct().join(groups.distinct(), GROUP, "left_semi").join(each, run, "left")
    order = Window.partitionBy(*GROUP).orderBy("window_end")
    # The run after a series belongs to it and resolves it.
    series = F.coalesce(F.sum(F.col("n").isNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = runs.withColumn("series", series).groupBy(*GROUP, "series").agg(
        F.min(F.when(F.col("n").isNotNull(), F.struct("window_end", "n"))).alias("first"), F.max_by(F.struct("window_end", "n", "signals"), F.when(F.col("n").isNotNull(), F.col("window_end"))).alias("last"),
        F.max(F.when(F.col("n").isNull(), F.col("window_end"))).alias("resolved_window"),
    )
    if before is not None:
        old = before.select(*GROUP, F.lit(0).cast("long").alias("series"), F.struct("opened_window", "last_seen_window", "evidence_reason", "aggregated_signal_count", "aggregated_signals").alias("was"))
        by = by.join(old, [*GROUP, "series"], "full")
    else:
        by = by.withColumn("was", none(f"struct<opened_window:{window_type},last_seen_window:{window_type},evidence_reason:string,aggregated_signal_count:int,aggregated_signals:{_SIGNALS}>"))
    by = by.where("first is not null or was is not null")
    return by.select(
        "model_id", "kind", F.concat(F.lit("aggregate-"), F.col("kind")).alias("signal_name"), *[none("string").alias(c) for c in SIGNAL[3:]], F.when(F.col("resolved_window").isNotNull(), "resolved").otherwise("open").alias("status"),
        F.coalesce("was.opened_window", "first.window_end").alias("opened_window"), F.coalesce("last.window_end", "was.last_seen_window").alias("last_seen_window"), none(window_type).alias("escalated_window"), "resolved_window",
        F.lit(0).alias("breaching"), F.lit(0).alias("clear"), none("double").alias("evidence_statistic"), none("double").alias("evidence_threshold"),
        F.coalesce("was.evidence_reason", F.format_string(ROLLED_UP, F.col("first.n"), F.lit(cap))).alias("evidence_reason"), none("double").alias("escalation_statistic"), none("double").alias("escalation_threshold"),
        F.lit(True).alias("is_aggregate"), F.coalesce("last.n", "was.aggregated_signal_count").alias("aggregated_signal_count"), F.coalesce("last.signals", "was.aggregated_signals").alias("aggregated_signals"), "source",
    )


def alert_lifecycle(events: DataFrame, profile: Profile, rollup: bool = True, open_alerts: DataFrame | None = None) -> DataFrame:
    """All alerts, finished and open, after the windows in ``events`` (columns ``ALERTS``).

    ``open_alerts`` are those that were open before these windows; they go on, and
    are in the result whether or not a window concerns them.
    """
    window_type = dict(events.dtypes)["window_end"]
    rows = _stretches(events, profile)
    fields = ["opened_window", "escalated_window", "breaching", "clear", "evidence_statistic", "evidence_threshold", "evidence_reason", "escalation_statistic", "escalation_threshold"]
    aggregates = None
    if open_alerts is not None:
        was = open_alerts.where("not is_aggregate").select(*IDENTITY, F.lit(0).cast("long").alias("stretch"), F.struct(*fields).alias("was"))
        rows = _beside(rows, was, [*IDENTITY, "stretch"])
        aggregates = open_alerts.where("is_aggregate")
    else:
        rows = rows.withColumn("was", F.lit(None).cast(f"struct<opened_window:{window_type},escalated_window:{window_type},breaching:int,clear:int,evidence_statistic:double,evidence_threshold:double,evidence_reason:string,escalation_statistic:double,escalation_threshold:double>"))
    out = None
    if rollup:
        rows = written(rows, "alert-rows")
        free = rows.where("was is null")
        rolled = rolled_runs(free, profile.max_alerts_per_run)
        if not rolled.isEmpty() or (aggregates is not None and not aggregates.isEmpty()):
            out = _aggregates(rows.withColumn("opens", F.col("opens") & F.col("was").isNull()), rolled, profile.max_alerts_per_run, aggregates, window_type)
            rows = rows.join(rolled.withColumn("_rolled", F.lit(True)), [*GROUP, "window_end"], "left").withColumn("opens", F.col("opens") & F.col("_rolled").isNull()).drop("_rolled")
    found = _alerts_of(rows, window_type)
    if open_alerts is not None:
        # Open alerts that no window concerned stay as they are.
        concerned = rows.where("stretch = 0").select(*IDENTITY).distinct().withColumn("_seen", F.lit(True))
        found = found.unionByName(_beside(open_alerts.where("not is_aggregate"), concerned, IDENTITY).where("_seen is null").drop("_seen").select(*found.columns))
    return (found if out is None else found.unionByName(out)).select(*ALERTS)


def touched(alerts: DataFrame, windows: DataFrame) -> DataFrame:
    """Alerts that the evaluation of ``windows(model_id, window_end)`` opened or changed: those last seen in one of them."""
    w = windows.select("model_id", F.col("window_end").alias("last_seen_window")).distinct()
    return alerts.join(w, ["model_id", "last_seen_window"], "left_semi")


def lifecycle_trace(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """``events`` with the ``phase`` of their signal after each window: quiet, counting, open or escalated."""
    identity = [*SIGNAL]
    a = alerts.where(~F.col("is_aggregate")).select(*[F.col(c).alias(f"_{c}") for c in identity], "opened_window", "escalated_window", "resolved_window")
    at, cond = F.col("window_end"), None
    for c in identity:
        eq = events[c] == a[f"_{c}"] if c in ("model_id", "kind", "signal_name") else events[c].eqNullSafe(a[f"_{c}"])
        cond = eq if cond is None else cond & eq
    on = cond & (at >= F.col("opened_window")) & (F.col("resolved_window").isNull() | (at < F.col("resolved_window")))
    counting = F.col("class") == F.when(F.col("kind") == "not_computable", "not_computable").otherwise("breach")
    phase = F.when(F.col("escalated_window") <= at, "escalated").when(F.col("opened_window").isNotNull(), "open").when(counting, "counting").otherwise("quiet")
    return events.join(a, on, "left").select(*[events[c] for c in events.columns], phase.alias("phase"))


def outbox(alerts: DataFrame, delivered: DataFrame, max_attempts: int = 5, evaluated: DataFrame | None = None) -> DataFrame:
    """Status transitions still to be announced.

    ``delivered`` has ``SIGNAL``, ``opened_window``, ``last_notified_status`` and
    ``notification_attempts``; an alert that is not in it was never announced.
    Retries end with ``max_attempts``; an alert that the windows just
    ``evaluated`` touched is announced even after an earlier status was given up.
    """
    keys = [*SIGNAL, "opened_window"]
    d = delivered.select(*[F.col(c).alias(f"_{c}") for c in keys], "last_notified_status", "notification_attempts")
    cond = None
    for c in keys:
        eq = alerts[c].eqNullSafe(d[f"_{c}"])
        cond = eq if cond is None else cond & eq
    j = alerts.join(d, cond, "left").drop(*[f"_{c}" for c in keys])
    attempts = F.coalesce("notification_attempts", F.lit(0))
    event = F.when(F.col("status") == "open", "opened").otherwise(F.col("status"))
    due = attempts < max_attempts
    if evaluated is not None:
        w = evaluated.select(F.col("model_id").alias("_m"), F.col("window_end").alias("_w")).distinct()
        j = j.join(w, (F.col("model_id") == F.col("_m")) & (F.col("last_seen_window") == F.col("_w")), "left")
        due = due | F.col("_w").isNotNull()
        j = j.withColumn("_due", due).drop("_m", "_w")
    else:
        j = j.withColumn("_due", due)
    return j.where(~F.col("status").eqNullSafe(F.col("last_notified_status")) & F.col("_due")).drop("_due").withColumn("event", event).withColumn("attempt", attempts + 1)


def after_delivery(sent: DataFrame, max_attempts: int = 5) -> DataFrame:
    """The next ``delivered`` table from outbox rows and their ``ok`` flag and ``error`` text.

    Success resets the attempts; the fifth failure marks the status as
    announced and keeps the error.
    """
    done = F.col("ok") | (F.col("attempt") >= max_attempts)
    return sent.select(
        *SIGNAL, "opened_window", F.when(done, F.col("status")).otherwise(F.col("last_notified_status")).alias("last_notified_status"),
        F.when(F.col("ok"), 0).otherwise(F.col("attempt")).alias("notification_attempts"), F.when(~F.col("ok"), F.col("error")).alias("last_notification_error"),
    )
