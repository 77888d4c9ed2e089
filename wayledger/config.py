"""Thresholds and weights.  All are fixed values that results depend on; pass another ``Thresholds`` to change them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # peers
    min_peers: int = 30
    mad_scale: float = 1.4826
    iqr_scale: float = 1.349
    # signals: gates, weights of the noisy-or, by signal
    extreme_percentile: float = 0.90
    risk_gate: float = 0.60
    duplicate_gate: float = 0.97
    weights: tuple[tuple[str, float], ...] = (
        ("amount", 0.60), ("duration", 0.55), ("risk", 0.60), ("conformance", 0.75), ("change", 0.50), ("anomaly", 0.40), ("duplicate", 0.65),
    )
    families: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("amount", ("amount",)), ("duration", ("duration", "risk")), ("lifecycle", ("conformance",)), ("behaviour", ("change",)),
        ("multivariate", ("anomaly",)), ("duplication", ("duplicate",)),
    )
    # rules
    rule_percentile: float = 0.99
    # series
    series_points: int = 6
    series_recent: int = 3
    # early warning
    stall_floor_days: int = 30
    stall_default_days: int = 400
    # change points
    change_min_rows: int = 5
    change_shift: float = 0.5
    # concentration
    min_payments: int = 20
    # reporting floors
    rate_floor: int = 500
    visit_floor: int = 10
    # near duplicates
    duplicate_classes: tuple[tuple[str, float], ...] = (("EXACT", 0.995), ("NEAR_EXACT", 0.97), ("HIGH_SIMILARITY", 0.92), ("POSSIBLE_REPEAT", 0.86))
    # planning, in days
    first_visit: float = 1.0
    repeat_visit: float = 0.35
    look_ahead: int = 40
    # confidence intervals
    z: float = 1.96


DEFAULT = Thresholds()
