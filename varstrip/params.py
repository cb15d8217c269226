"""Thresholds and constants of the methodology."""

from __future__ import annotations

from dataclasses import dataclass, fields

# Fixed values of the methodology.
SECONDS_PER_YEAR = 365 * 86_400
MINUTES_30D = 43_200.0
MINUTES_365D = 525_600.0
NEAR_MIN_YEARS = 7.0 / 365.0
BRACKET_YEARS = 30.0 / 365.0
SNAPSHOT_SECONDS = 60
SNAPSHOT_LOOKBACK_SECONDS = 30
MIN_QUOTED_USD = 1e-9
MIN_STRIP_QUOTES = 5
GRID_POINTS = 801
MIN_FITTED_IV = 1e-4
MAX_FITTED_IV = 5.0
STRICT_MIN_IV = 1e-3
FRESH_BUDGET_SECONDS = 60.0
TARGET_STRIKES = 8
VENUES_EXPECTED = 3
HEALTH_MAX_AGE_SECONDS = 90.0
PUBLISH_INTERVAL_SECONDS = 60
HISTORY_DEFAULT_LIMIT = 1000
HISTORY_MAX_LIMIT = 10_000
VALUE_SCALE = 100_000_000
CONFIDENCE_SCALE = 1_000_000
RETENTION_YEARS = 1

VENUES = ("bybit", "deribit", "okx")
ASSETS = ("btc", "eth")
KINDS = ("call", "put")

# index id, asset: a dimension table, so further indices are data and not code.
INDEX_DIMENSION = (("BTCV30", "btc"), ("ETHV30", "eth"))

# history interval -> minutes
HISTORY_INTERVALS = {"1m": 1, "5m": 5, "1h": 60, "1d": 1440}

# timeframe -> (history interval, bars)
TIMEFRAMES = {
    "1h": ("1m", 60),
    "1d": ("5m", 288),
    "7d": ("1h", 168),
    "30d": ("1h", 720),
    "90d": ("1d", 90),
    "all": ("1d", 5000),
}


@dataclass(frozen=True)
class QualityConfig:
    """Tick filter thresholds; unknown keys and impossible values are refused."""

    max_age_secs: float = 5.0
    max_spread_ratio: float = 0.30
    intrinsic_tolerance: float = 0.01
    dedup_window_secs: int = 60

    def __post_init__(self):
        for f in fields(self):
            if not getattr(self, f.name) >= 0:
                raise ValueError(f"{f.name} must be a number >= 0, got {getattr(self, f.name)!r}")

    @classmethod
    def from_dict(cls, values: dict) -> "QualityConfig":
        known = {f.name for f in fields(cls)}
        unknown = sorted(set(values) - known)
        if unknown:
            raise ValueError(f"unknown quality settings {unknown}; known are {sorted(known)}")
        return cls(**values)


@dataclass(frozen=True)
class OutlierConfig:
    """A venue is dropped after ``streak`` consecutive ticks beyond ``threshold``."""

    threshold: float = 0.05
    streak: int = 5


@dataclass(frozen=True)
class ThinningConfig:
    """When a new on-chain price is worth publishing."""

    deviation_bps: int = 50
    heartbeat_seconds: int = 1800


@dataclass(frozen=True)
class PerpConfig:
    """Leveraged-position constants, in basis points unless named otherwise."""

    max_leverage: int = 10
    open_fee_bps: int = 10
    close_fee_bps: int = 10
    liq_threshold_bps: int = 8000
    liq_reward_bps: int = 100
    funding_bps_per_day: int = 30
    max_funding_bps_per_day: int = 1000

    def __post_init__(self):
        if not 0 <= self.funding_bps_per_day <= self.max_funding_bps_per_day:
            raise ValueError("funding rate above the allowed maximum")
