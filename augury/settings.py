"""Parameters shared by all operators.

Every duration is in seconds.  ``LIVE`` holds the values an installation polling every 15 s
would use; ``SPARSE`` stretches the same contract for data with a few dozen points per host
and day (the bundled ``events`` table).
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # feature windows
    window: int = 900
    tick: int = 60
    half_life: int = 60
    variance_window: int = 300
    freshness: int = 90
    # probes and failure confirmation
    latency_slo: float = 0.5
    confirm_count: int = 3
    confirm_span: int = 15
    max_gap: int = 10
    # labels
    horizon: int = 600
    recovery_exclusion: int = 900
    # scoring, incidents, alerts
    max_age: int = 90
    expiry_grace: int = 15
    clear_count: int = 3
    clear_span: int = 180
    alert_cooldown: int = 300
    proposal_threshold: float = 0.995
    min_lead: int = 60
    epoch_cooldown: int = 300
    # read side
    recent_limit: int = 100
    host_limit: int = 1000
    # counters
    rate_window: int = 60
    rate_step: int = 15
    # time slices used to split hot hosts over tasks
    slice_seconds: int = 86400

    def __post_init__(self) -> None:
        durations = (self.window, self.half_life, self.variance_window, self.tick, self.horizon)
        if min(durations) <= 0:
            raise ValueError("durations must be positive")
        if self.recovery_exclusion < 0 or self.confirm_count < 1 or self.confirm_span < 1:
            raise ValueError("invalid label durations")

    def but(self, **changes) -> "Params":
        return replace(self, **changes)


LIVE = Params()

SPARSE = Params(
    window=86400,
    tick=3600,
    half_life=14400,
    variance_window=28800,
    freshness=43200,
    latency_slo=2.0,
    confirm_count=3,
    confirm_span=14400,
    max_gap=14400,
    horizon=21600,
    recovery_exclusion=21600,
    max_age=7200,
    expiry_grace=900,
    clear_count=3,
    clear_span=10800,
    alert_cooldown=43200,
    proposal_threshold=0.7,
    min_lead=3600,
    epoch_cooldown=18000,
    rate_window=21600,
    rate_step=3600,
    slice_seconds=5 * 86400,
)
