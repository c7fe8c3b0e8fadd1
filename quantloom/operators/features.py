"""Per-bar features as window stages over blocked series.

Every stage takes rows from :func:`quantloom.operators.blocks.with_blocks` and only adds
columns. All windows share one partitioning (symbol, block) and one sort, so the stages
add no shuffle. Unfilled values stay NULL until :func:`fill`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.safe import clip, div, flag, on_grid, over_min, zero
from quantloom.operators.blocks import before, carry_last, ema_columns, series_window, tail
from quantloom.settings import Blocks

c = F.col

# Smoothing factors 2 / (span + 1).
ALPHA_12 = 2.0 / 13.0
ALPHA_26 = 2.0 / 27.0
ALPHA_9 = 2.0 / 10.0


def _lag(column: str, rows: int = 1) -> Column:
    return F.lag(column, rows).over(series_window())


def change(column: str, rows: int) -> Column:
    """Relative change over ``rows`` rows."""
    return div(c(column), _lag(column, rows)) - 1


def returns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "prev_close": _lag("close"),
        "returns": zero(change("close", 1)),
    })


def true_range(df: DataFrame) -> DataFrame:
    gap = [F.abs(c("high") - c("prev_close")), F.abs(c("low") - c("prev_close"))]
    return df.withColumn("true_range", F.greatest(c("high") - c("low"), *gap))


def volatility(df: DataFrame) -> DataFrame:
    close = F.nullif(c("close"), F.lit(0.0))
    mid = F.avg("close").over(tail(20))
    spread = zero(over_min(F.stddev_pop, c("close"), tail(20), 2))
    df = true_range(df).withColumns({
        "atr_14": F.avg("true_range").over(tail(14)),
        "realized_vol_10": over_min(F.stddev_pop, c("returns"), tail(10), 2),
        "realized_vol_20": over_min(F.stddev_pop, c("returns"), tail(20), 2),
        "bb_width": ((mid + 2 * spread) - (mid - 2 * spread)) / close,
        "high_low_range_pct": (c("high") - c("low")) / close,
        "gap_pct": div(c("open") - c("prev_close"), c("prev_close")),
    })
    return df.withColumns({
        "volatility_percentile": rank_share("realized_vol_20", 100, 5),
        "volatility_regime_score": zero(c("atr_14") / close),
        "range_expansion": div(c("high_low_range_pct"), F.avg("high_low_range_pct").over(tail(20))),
        "gap_up": F.when(c("gap_pct") > 0.01, 1).otherwise(0),
        "gap_down": F.when(c("gap_pct") < -0.01, 1).otherwise(0),
    })


def rank_share(column: str, rows: int, min_rows: int) -> Column:
    """Average rank of the current value in the trailing frame, as a share of the frame."""
    values = F.collect_list(column).over(tail(rows))
    less = F.size(F.filter(values, lambda v: v < c(column)))
    equal = F.size(F.filter(values, lambda v: v == c(column)))
    share = (less + (equal + 1) / 2) / F.size(values)
    return F.when(c(column).isNotNull() & (F.size(values) >= min_rows), share)


def rsi(df: DataFrame, rows: int = 14) -> DataFrame:
    """Relative strength from simple means; 50 where there is no loss in the window."""
    move = c("close") - c("prev_close")
    df = df.withColumns({"_gain": clip(move, low=0.0), "_loss": clip(-move, low=0.0)})
    strength = div(F.avg("_gain").over(tail(rows)), F.avg("_loss").over(tail(rows)))
    return df.withColumn("rsi_14", F.coalesce(100 - 100 / (1 + strength), F.lit(50.0))).drop("_gain", "_loss")


def adx(df: DataFrame, rows: int = 14) -> DataFrame:
    df = df.withColumns({"_up": c("high") - _lag("high"), "_down": _lag("low") - c("low")})
    df = df.withColumns({
        "_plus": F.when((c("_up") > c("_down")) & (c("_up") > 0), c("_up")).otherwise(0.0),
        "_minus": F.when((c("_down") > c("_up")) & (c("_down") > 0), c("_down")).otherwise(0.0),
    })
    plus = 100 * div(F.avg("_plus").over(tail(rows)), c("atr_14"))
    minus = 100 * div(F.avg("_minus").over(tail(rows)), c("atr_14"))
    df = df.withColumns({"_pdi": plus, "_mdi": minus})
    df = df.withColumn("_dx", div(F.abs(c("_pdi") - c("_mdi")), c("_pdi") + c("_mdi")) * 100)
    return df.withColumn("adx_14", zero(F.avg("_dx").over(tail(rows)))).drop(
        "_up", "_down", "_plus", "_minus", "_pdi", "_mdi", "_dx"
    )


def macd(df: DataFrame, blocks: Blocks) -> DataFrame:
    df = ema_columns(df, {"ema_12": ("close", ALPHA_12), "ema_26": ("close", ALPHA_26)}, blocks)
    df = df.withColumn("macd", c("ema_12") - c("ema_26"))
    df = ema_columns(df, {"macd_signal": ("macd", ALPHA_9)}, blocks)
    return df.withColumn("macd_histogram", c("macd") - c("macd_signal"))


def vwap(df: DataFrame) -> DataFrame:
    """Price weighted by volume since the series start; NULL on bars without volume."""
    return df.withColumn("vwap", F.when(c("volume") != 0, div(c("cum_price_volume"), c("cum_volume"))))


def vwap_totals() -> dict[str, Column]:
    """Running totals that :func:`vwap` needs from ``index_rows``."""
    typical = (c("high") + c("low") + c("close")) / 3
    return {"cum_price_volume": typical * c("volume"), "cum_volume": c("volume")}


def momentum(df: DataFrame, blocks: Blocks) -> DataFrame:
    close = F.nullif(c("close"), F.lit(0.0))
    df = df.withColumns({f"return_{n}": change("close", n) for n in (1, 3, 5, 10, 20)})
    df = macd(df, blocks)
    df = df.withColumns({
        "sma_20": F.avg("close").over(tail(20)),
        "sma_50": F.avg("close").over(tail(50)),
        "breakout_distance": (c("close") - F.max("high").over(before(20))) / close,
        "breakdown_distance": (F.min("low").over(before(20)) - c("close")) / close,
        "roc_10": c("return_10"),
        "ema_slope_12": change("ema_12", 5),
    })
    df = vwap(adx(rsi(df)))
    return df.withColumns({
        "sma_slope_20": change("sma_20", 5),
        "distance_from_vwap": div(c("close") - c("vwap"), c("vwap")),
        "distance_from_sma20": div(c("close") - c("sma_20"), c("sma_20")),
    })


def sentiment(df: DataFrame) -> DataFrame:
    """Rolling news features from the daily columns joined to each bar.

    Expects ``sentiment_score, sentiment_count, bullish_count, bearish_count,
    sector_sentiment`` (0 where the day has no news) and ``has_sentiment``.
    """
    df = df.withColumns({
        "rolling_sentiment_mean": on_grid(F.avg("sentiment_score").over(tail(5))),
        "rolling_sentiment_volatility": zero(over_min(F.stddev_pop, c("sentiment_score"), tail(10), 2)),
        "bullish_headline_count": F.sum("bullish_count").over(tail(5)).cast("int"),
        "bearish_headline_count": F.sum("bearish_count").over(tail(5)).cast("int"),
        "sentiment_shock_score": F.abs("sentiment_score") * F.least(c("sentiment_count"), F.lit(10)) / 10,
    })
    divergence = c("rolling_sentiment_mean") - zero(c("return_5"))
    return df.withColumns({
        "sentiment_momentum": zero(c("rolling_sentiment_mean") - _lag("rolling_sentiment_mean", 3)),
        "sentiment_price_divergence": F.when(c("has_sentiment"), divergence).otherwise(0.0),
    })


def options(df: DataFrame) -> DataFrame:
    """Options-pressure features from the day's carried-forward snapshot columns."""
    carried = ("pcr", "call_oi_change", "put_oi_change", "iv", "options_volume_call", "options_volume_put")
    df = df.withColumns({name: zero(c(name)) for name in carried})
    oi = F.abs("call_oi_change") + F.abs("put_oi_change")
    df = df.withColumn("_oi", oi)
    iv_mean = over_min(F.avg, c("iv"), tail(20), 3)
    iv_std = over_min(F.stddev_pop, c("iv"), tail(20), 3)
    put_less_call = c("options_volume_put") - c("options_volume_call")
    return df.withColumns({
        "pcr_trend": zero(c("pcr") - _lag("pcr", 3)),
        "iv_trend": zero(c("iv") - _lag("iv", 3)),
        "iv_spike": F.when(c("iv") > iv_mean + 2 * iv_std, 1).otherwise(0),
        "max_pain_distance": div(c("close") - c("max_pain"), c("close")),
        "unusual_oi_activity": div(c("_oi"), over_min(F.avg, c("_oi"), tail(20), 3)),
        "options_volume_imbalance": div(put_less_call, c("options_volume_call") + c("options_volume_put")),
        "put_call_oi_change_ratio": div(c("put_oi_change"), c("call_oi_change")),
    }).drop("_oi")


def rolling_corr(left: str, right: str, rows: int, min_rows: int) -> Column:
    """Trailing correlation, 0 where either side is constant or the frame is short."""
    frame = tail(rows)
    spread = F.stddev_pop(left).over(frame) * F.stddev_pop(right).over(frame)
    value = div(F.covar_pop(left, right).over(frame), spread)
    return zero(F.when(F.count(left).over(frame) >= min_rows, value))


def correlation(df: DataFrame) -> DataFrame:
    """Features against the benchmark and sector series joined to each bar."""
    frame = tail(60)
    beta = div(F.covar_samp("returns", "benchmark_returns").over(frame), F.var_samp("benchmark_returns").over(frame))
    df = df.withColumns({
        "benchmark_correlation": rolling_corr("returns", "benchmark_returns", 30, 5),
        "sector_correlation": rolling_corr("returns", "sector_returns", 30, 5),
        "relative_strength": zero(c("return_20")) - c("benchmark_return_20"),
        "sector_strength": c("sector_return_20"),
        "rolling_beta": F.coalesce(F.when(F.count("returns").over(frame) >= 10, beta), F.lit(1.0)),
    })
    return df.withColumn(
        "correlation_breakdown", F.when(F.abs("benchmark_correlation") < 0.2, 1).otherwise(0)
    )


def regime_scores(df: DataFrame) -> DataFrame:
    liquidity = div(c("volume"), F.avg("volume").over(tail(20)))
    df = df.withColumns({
        "trend_strength": zero(c("adx_14")) / 100,
        "volatility_strength": zero(c("volatility_percentile")),
        "liquidity_score": clip(liquidity, 0.0, 3.0) / 3,
        "_rising": flag(zero(c("return_5")) > 0),
    })
    df = df.withColumns({
        "breadth_score": F.avg("_rising").over(tail(20)),
        "market_stress_score": c("volatility_strength") * 0.4
        + flag(zero(c("return_5")) < -0.03) * 0.4
        + (1 - F.coalesce(c("liquidity_score"), F.lit(0.5))) * 0.2,
    })
    return df.withColumns({
        "risk_on_score": flag(zero(c("return_20")) > 0) * 0.35
        + flag(c("trend_strength") > 0.25) * 0.25
        + flag(zero(c("rolling_sentiment_mean")) > 0) * 0.2
        + flag(c("volatility_strength") < 0.7) * 0.2,
        "risk_off_score": flag(zero(c("return_20")) < 0) * 0.3
        + flag(c("market_stress_score") > 0.55) * 0.4
        + flag(zero(c("rolling_sentiment_mean")) < -0.15) * 0.3,
    }).drop("_rising")


def anomaly_scores(df: DataFrame) -> DataFrame:
    mean = over_min(F.avg, c("volume"), tail(20), 3)
    deviation = over_min(F.stddev_pop, c("volume"), tail(20), 3)
    df = df.withColumns({"_mean": mean, "unusual_volume_score": zero(div(c("volume") - mean, deviation))})
    return df.withColumns({
        "price_volume_divergence": zero(c("return_5")) * -clip(c("unusual_volume_score"), low=0.0),
        "sentiment_price_divergence_score": F.abs("sentiment_price_divergence"),
        "options_anomaly_score": clip(zero(c("unusual_oi_activity")), low=0.0),
        "volatility_shock_score": clip(zero(c("range_expansion")), low=0.0),
        "fake_breakout_probability": flag(zero(c("breakout_distance")) > 0)
        * flag(c("volume") < c("_mean"))
        * flag(zero(c("return_3")) < 0),
        "liquidity_breakdown_score": clip(1 - F.coalesce(c("liquidity_score"), F.lit(0.5)), 0.0, 1.0),
    }).drop("_mean")


def contract_aliases(df: DataFrame) -> DataFrame:
    """Stable names served to consumers."""
    neutral = c("sentiment_count") - c("bullish_headline_count") - c("bearish_headline_count")
    oi = F.abs("call_oi_change") + F.abs("put_oi_change")
    return df.withColumns({
        "rsi": c("rsi_14"),
        "ema_slope": c("ema_slope_12"),
        "vwap_distance": c("distance_from_vwap"),
        "atr": c("atr_14"),
        "bollinger_width": c("bb_width"),
        "realized_volatility": c("realized_vol_20"),
        "bullish_count": c("bullish_headline_count"),
        "bearish_count": c("bearish_headline_count"),
        "neutral_count": F.greatest(neutral, F.lit(0)).cast("int"),
        "oi_imbalance": div(c("put_oi_change") - c("call_oi_change"), oi),
    })


def fill(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({name: zero(c(name)) for name in columns})


def trading_features(df: DataFrame, blocks: Blocks) -> DataFrame:
    """Features of the strategy layer (rows from ``with_blocks``)."""
    df = true_range(returns(df))
    low_14, high_14 = F.min("low").over(tail(14)), F.max("high").over(tail(14))
    mean_20, std_20 = F.avg("close").over(tail(20)), F.stddev_pop("close").over(tail(20))
    df = df.withColumns({
        "sma_10": F.avg("close").over(tail(10)),
        "sma_20": mean_20,
        "sma_50": F.avg("close").over(tail(50)),
        "atr_14": F.avg("true_range").over(tail(14)),
        "_atr_10": F.avg("true_range").over(tail(10)),
        "bb_mid": mean_20,
        "bb_std": zero(std_20),
        "stoch_k": 100 * div(c("close") - low_14, high_14 - low_14),
        "zscore_20": div(c("close") - mean_20, std_20),
        "volume_sma_20": F.avg("volume").over(tail(20)),
        "donchian_high_20": F.max("high").over(tail(20)),
        "donchian_low_20": F.min("low").over(tail(20)),
        "prior_high_20": F.max("high").over(before(20)),
        "prior_low_20": F.min("low").over(before(20)),
        "prior_high_14": F.max("high").over(before(14)),
        "prior_low_14": F.min("low").over(before(14)),
        "return_mean_5": F.avg("returns").over(tail(5)),
        "return_std_20": F.stddev_pop("returns").over(tail(20)),
        "return_sum_10": F.sum("returns").over(tail(10)),
        "rolling_return_5": change("close", 5),
        "next_close": F.lead("close").over(series_window()),
    })
    df = df.withColumns({
        "atr_pct": div(c("atr_14"), c("close")),
        "bb_upper": c("bb_mid") + 2 * c("bb_std"),
        "bb_lower": c("bb_mid") - 2 * c("bb_std"),
        "volume_ratio": div(c("volume"), c("volume_sma_20")),
    })
    df = vwap(rsi(macd(df, blocks)))
    df = ema_columns(df, {"smooth_price": ("close", 0.25)}, blocks)
    df = supertrend(df)
    df = df.withColumns({
        "prev_macd": _lag("macd"),
        "prev_macd_signal": _lag("macd_signal"),
        "drawdown_60": trailing_drawdown(60),
    })
    return fill(df, ["atr_pct", "vwap", "stoch_k", "zscore_20", "volume_ratio"]).drop("_atr_10")


def supertrend(df: DataFrame, multiplier: float = 3.0) -> DataFrame:
    """+1 above the previous upper band, -1 below the previous lower band, else carried forward."""
    middle = (c("high") + c("low")) / 2
    df = df.withColumns({
        "_upper": middle + multiplier * c("_atr_10"),
        "_lower": middle - multiplier * c("_atr_10"),
    })
    above = c("close") > F.coalesce(_lag("_upper"), c("_upper"))
    below = c("close") < F.coalesce(_lag("_lower"), c("_lower"))
    df = df.withColumn(
        "supertrend_direction", F.when(below, F.lit(-1.0)).when(above, F.lit(1.0))
    ).drop("_upper", "_lower")
    df = carry_last(df, "supertrend_direction")
    return df.withColumn("supertrend_direction", zero(c("supertrend_direction")))


def trailing_drawdown(rows: int) -> Column:
    """Worst fall from a running peak within the trailing frame (0 or negative)."""
    start = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("worst"))

    def step(acc: Column, price: Column) -> Column:
        peak = F.greatest(acc["peak"], price)
        return F.struct(
            peak.alias("peak"), F.least(acc["worst"], zero(div(price - peak, peak))).alias("worst")
        )

    prices = F.collect_list("close").over(tail(rows))
    return F.aggregate(prices, start, step, lambda acc: acc["worst"])
