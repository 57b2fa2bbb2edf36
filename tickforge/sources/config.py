"""Settings of the jobs, from defaults or an environment-like mapping."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    window_seconds: int = 1
    watermark_seconds: int = 5
    replay_watermark_hours: int = 24
    book_depth: int = 50
    quote_grid_ms: int = 100
    trigger_seconds: int = 30
    max_quote_age_us: int = 5_000_000
    baseline_ring: int = 600
    baseline_warm: int = 30
    min_bps: float = 5.0
    min_zscore: float = 3.0
    replay_start_us: int = 0
    replay_end_us: int = 0
    lake_path: str = ""
    checkpoint_path: str = ""

    def __post_init__(self):
        for name in ("window_seconds", "book_depth", "quote_grid_ms", "trigger_seconds", "max_quote_age_us", "baseline_ring"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.baseline_ring < 2 or self.baseline_warm > self.baseline_ring:
            raise ValueError("the baseline needs a ring of at least 2 and no less than its warm-up")
        if self.replay_end_us and self.replay_end_us <= self.replay_start_us:
            raise ValueError("the replay must end after it starts")

    @classmethod
    def from_mapping(cls, env: Mapping[str, str], prefix: str = "TICKFORGE_") -> Config:
        kinds = {"int": int, "float": float, "str": str}
        given = {f.name: kinds[str(f.type)](env[prefix + f.name.upper()]) for f in fields(cls) if env.get(prefix + f.name.upper())}
        return cls(**given)
