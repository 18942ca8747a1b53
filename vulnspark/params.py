"""Tunable values shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

DAY = 86400


@dataclass(frozen=True)
class Params:
    """Defaults for every window, threshold and stamp the operators take.

    Times are seconds unless the name says days. ``now`` is never read from
    a clock inside an operator; callers pass it.
    """

    # Stamps that must stay as they are for stored state and signatures to compare.
    matcher_version: str = "2026.08.23.2"
    retain_closed_days: int = 30
    host_retire_days: int = 180
    fold_window: int = 90 * 60
    ack_window: int = 7 * DAY
    stuck_window: int = 30 * DAY
    snapshot_max_age: int = 3 * 3600
    run_tolerance: int = 300
    flow_fresh_days: int = 7
    flow_stale_days: int = 2
    flow_absence_days: int = 30
    identity_grace_days: int = 7
    signature_salt: str = "v2:foundation-sec-8b"
    asset_criticality: str = "medium"
    escalation_cap: int = 1
    escalation_floor: str = "P1"
    verdict_stale: int = 7 * DAY
    exception_expiry_days: int = 90
    feed_stale_days: int = 30
    late_floor: int = 26 * 3600
    alert_window: int = 5400
    max_hops: int = 5
    path_fanout: int | None = None
    beyond_break: int = 1


#: Retention of each event table in days (fixed values).
RETENTION_DAYS = {
    "inventory": 30,
    "findings": 365,
    "findings_archive": 730,
    "audit": 1825,
    "meta": 30,
    "ai_candidates": 7,
    "ai_prioritized": 14,
    "ai_alerts": 365,
}
