"""Thresholds shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Blocks:
    """How long series are cut so that one hot symbol spreads over many tasks.

    ``block_rows``      rows owned by one (symbol, block) window group
    ``halo_rows``       earlier rows repeated in front of a block so trailing windows see them
    ``lookahead_rows``  later rows repeated behind a block for lead()
    ``scan_rows``       rows per sub-block of the exponential-average scan
    ``slice_seconds``   width of the time slices used to number rows
    """

    block_rows: int = 8192
    halo_rows: int = 1024
    lookahead_rows: int = 64
    scan_rows: int = 512
    slice_seconds: int = 90 * 86400

    def __post_init__(self) -> None:
        if self.halo_rows < 2 * self.scan_rows:
            raise ValueError("halo_rows must cover two scan sub-blocks")
        if self.block_rows % self.scan_rows or self.block_rows < self.halo_rows:
            raise ValueError("block_rows must be a multiple of scan_rows and at least halo_rows")


@dataclass(frozen=True)
class AdaptiveSettings:
    """Thresholds of the feature, regime, anomaly and weighting layer (fixed values)."""

    regime_confidence_floor: float = 0.35
    high_volatility_percentile: float = 0.8
    adx_trending: float = 25.0
    adx_sideways: float = 18.0
    atr_high_vol_percentile: float = 0.85
    realized_vol_high: float = 0.035
    bollinger_compression: float = 0.04
    ema_slope_trend: float = 0.001
    panic_return: float = -0.04
    low_liquidity_volume_ratio: float = 0.45
    max_strategy_weight: float = 0.35
    anomaly_zscore: float = 3.0


@dataclass(frozen=True)
class TradingSettings:
    """Thresholds of the signal, ensemble and risk layer (fixed values)."""

    capital: float = 1_000_000.0
    risk_per_trade: float = 0.01
    max_strategy_weight: float = 0.45
    weight_floor: float = 0.05
    max_drawdown_limit: float = 0.15
    high_volatility_atr_pct: float = 0.03
    panic_drawdown_pct: float = -0.04
    stale_seconds: int = 7 * 86400


@dataclass(frozen=True)
class Settings:
    blocks: Blocks = field(default_factory=Blocks)
    adaptive: AdaptiveSettings = field(default_factory=AdaptiveSettings)
    trading: TradingSettings = field(default_factory=TradingSettings)


DEFAULT = Settings()
