"""Profiles and model descriptions: plain values with their consistency checks."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field
from datetime import timedelta

SCORE = "__prediction_score__"

_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


def parse_duration(text: str) -> timedelta:
    """``90s``, ``10m``, ``1h`` or ``7d``."""
    m = re.fullmatch(r"(\d+)([smhd])", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return timedelta(**{_UNITS[m[2]]: int(m[1])})


def interval(text: str) -> str:
    """The duration as a Spark interval string."""
    return f"{int(parse_duration(text).total_seconds())} seconds"


@dataclass(frozen=True)
class Gate:
    """Hysteresis of one signal: it breaches from ``fire`` on and is clear up to ``clear`` (mirrored below)."""

    fire: float
    clear: float
    direction: str = "above"

    def __post_init__(self):
        if self.direction not in ("above", "below"):
            raise ValueError("direction is above or below")
        if (self.clear > self.fire) if self.direction == "above" else (self.clear < self.fire):
            raise ValueError("the clear threshold lies on the wrong side of the fire threshold")


@dataclass(frozen=True)
class Metric:
    name: str
    params: dict = field(default_factory=dict)
    gate: Gate | None = None


@dataclass(frozen=True)
class Profile:
    window: str = "1h"
    watermark: str = "10m"
    min_window_size: int = 50
    continuous: tuple[str, ...] = ("psi", "ks")
    categorical: tuple[str, ...] = ("chi_square",)
    score: str = "jsd"
    gates: dict[str, Gate] = field(default_factory=dict)
    fdr_alpha: float = 0.05
    metrics: tuple[Metric, ...] = ()
    fire_persistence: int = 3
    escalate_persistence: int = 8
    resolve_persistence: int = 5
    not_computable_persistence: int = 3
    history_scan_windows: int = 12
    max_alerts_per_run: int = 25
    #: KS p-values are exact where neither sample has more rows, and asymptotic beyond; 0: always asymptotic.
    exact_ks: int = 10_000

    def __post_init__(self):
        if self.escalate_persistence < self.fire_persistence:
            raise ValueError("escalation cannot come before firing")
        longest = max(self.fire_persistence, self.escalate_persistence, self.resolve_persistence, self.not_computable_persistence)
        if self.history_scan_windows < longest + 2:
            raise ValueError("history_scan_windows must be at least the longest persistence + 2")
        parse_duration(self.window), parse_duration(self.watermark)
        for method in (*self.continuous, *self.categorical, self.score):
            if method not in self.gates:
                raise ValueError(f"no gate for {method}")

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()


@dataclass(frozen=True)
class Feature:
    name: str
    dtype: str  # continuous or categorical
    nullable: bool = False


@dataclass(frozen=True)
class Model:
    features: tuple[Feature, ...]
    segment_dimensions: tuple[str, ...] = ()
    min_segment_size: int = 30
    score: str | None = "prediction_score"

    def __post_init__(self):
        names = [f.name for f in self.features]
        if len(set(names)) < len(names):
            raise ValueError("a feature is declared twice")
        if bad := [f.name for f in self.features if f.dtype not in ("continuous", "categorical")]:
            raise ValueError(f"unknown dtype of {bad}")


def signals(model: Model, profile: Profile) -> list[tuple[str, str]]:
    """(feature, method) of every configured drift test."""
    out = [(f.name, m) for f in model.features for m in (profile.continuous if f.dtype == "continuous" else profile.categorical)]
    return out + ([(SCORE, profile.score)] if model.score else [])


def _gates(psi, ks, v, jsd):
    return {"psi": Gate(*psi), "ks": Gate(*ks), "chi_square": Gate(*v), "jsd": Gate(*jsd)}


def _metrics(fire, clear):
    return (
        Metric("pr_auc", gate=Gate(fire, clear, "below")),
        Metric("precision_at_threshold", {"threshold": 0.5}),
        Metric("recall_at_threshold", {"threshold": 0.5}),
        Metric("precision_at_k", {"n": 100}),
        Metric("roc_auc"),
    )


#: Fixed values, in this profile and the next.  This one fires on the first breach.
AGGRESSIVE = Profile(
    gates=_gates((0.10, 0.07), (0.15, 0.10), (0.10, 0.07), (0.05, 0.03)), fdr_alpha=0.10, metrics=_metrics(0.3, 0.4),
    fire_persistence=1, escalate_persistence=3, resolve_persistence=2, not_computable_persistence=2, history_scan_windows=6, max_alerts_per_run=10,
)
#: Waits for a sustained breach.
PATIENT = Profile(gates=_gates((0.25, 0.15), (0.30, 0.15), (0.30, 0.15), (0.15, 0.08)), fdr_alpha=0.01, metrics=_metrics(0.5, 0.65))
