"""Market-regime decision tables, evaluated on every bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.operators.ensemble import percent
from quantloom.settings import AdaptiveSettings, TradingSettings

c = F.col

# Priority of the trading-layer regimes.
TRADING_PRIORITY = {
    "panic": 100, "low_liquidity": 90, "high_volatility": 80, "bullish": 70, "bearish": 70,
    "trending": 60, "sideways": 50, "normal": 10,
}

# Priority of the rule-based regimes.
RULE_PRIORITY = {
    "PANIC": 100, "LOW_LIQUIDITY": 90, "HIGH_VOLATILITY": 80, "RISK_OFF": 75, "RISK_ON": 70,
    "BULLISH_REGIME": 65, "BEARISH_REGIME": 65, "TRENDING": 55, "SIDEWAYS": 40,
}


def candidate(rank: int, priority: Column | int, regime: Column | str, confidence: Column, reason: Column | str = "") -> Column:
    """A regime candidate; the struct order makes array_max pick priority, confidence, then first listed."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(priority).alias("priority"), confidence.cast("double").alias("confidence"),
        F.lit(-rank).alias("order"), as_col(regime).alias("regime"), as_col(reason).alias("reason"),
    )


def pick(candidates: list[Column]) -> Column:
    return F.array_max(F.array_compact(F.array(*candidates)))


def trend_regime(s: TradingSettings) -> tuple[Column, Column]:
    """(label, confidence) from the moving-average spread and the five-bar return."""
    move = c("rolling_return_5")
    spread = (c("sma_20") - c("sma_50")) / F.greatest(c("close"), F.lit(1e-9))
    size = F.abs(spread)
    cases = [
        (c("pos") + 1 < 5, "normal", F.lit(0.0)),
        (move <= s.panic_drawdown_pct, "panic", F.least(F.lit(1.0), F.abs(move / s.panic_drawdown_pct))),
        ((spread > 0.01) & (move > 0), "bullish", F.least(F.lit(0.95), 0.5 + size * 12)),
        ((spread < -0.01) & (move < 0), "bearish", F.least(F.lit(0.95), 0.5 + size * 12)),
        (size > 0.006, "trending", F.least(F.lit(0.8), 0.4 + size * 15)),
    ]
    label, confidence = F, F
    for condition, name, value in cases:
        label, confidence = label.when(condition, name), confidence.when(condition, value)
    return label.otherwise("sideways"), confidence.otherwise(0.55)


def volatility_regime(s: TradingSettings) -> tuple[Column, Column]:
    relative = c("atr_pct") / max(s.high_volatility_atr_pct, 1e-9)
    high = c("atr_pct") >= s.high_volatility_atr_pct
    return (
        F.when(high, "high_volatility").otherwise("normal"),
        F.when(high, F.least(F.lit(1.0), relative)).otherwise(F.greatest(F.lit(0.2), 1.0 - relative)),
    )


def liquidity_regime() -> tuple[Column, Column]:
    low = c("volume_ratio") < 0.45
    return (
        F.when(low, "low_liquidity").otherwise("normal"),
        F.when(low, F.least(F.lit(1.0), 1.0 - c("volume_ratio"))).otherwise(F.least(F.lit(0.7), c("volume_ratio") / 2)),
    )


def trading_regime(df: DataFrame, s: TradingSettings) -> DataFrame:
    """Add ``regime`` and ``regime_confidence``: the strongest of trend, volatility and liquidity."""
    priority = F.create_map(*[F.lit(x) for pair in TRADING_PRIORITY.items() for x in pair])
    parts = [trend_regime(s), volatility_regime(s), liquidity_regime()]
    chosen = pick([candidate(i, F.element_at(priority, label), label, value) for i, (label, value) in enumerate(parts)])
    return df.withColumn("_regime", chosen).withColumns({
        "regime": c("_regime.regime"), "regime_confidence": c("_regime.confidence"),
    }).drop("_regime")


def rule_regime(df: DataFrame, s: AdaptiveSettings) -> DataFrame:
    """Add ``regime, confidence, explanation`` from the nine-label rule table (filled adaptive features)."""
    move, trend, news = c("return_5"), c("trend_strength"), c("rolling_sentiment_mean")

    def least(limit: float, value: Column) -> Column:
        return F.least(F.lit(limit), value)

    rules = [
        (move <= s.panic_return, "PANIC", least(1.0, F.abs(move / s.panic_return)), "sharp negative five-period return"),
        (c("liquidity_score") <= s.low_liquidity_volume_ratio / 3, "LOW_LIQUIDITY",
         least(1.0, 1 - c("liquidity_score")), "liquidity score is depressed"),
        (c("volatility_percentile") >= s.high_volatility_percentile, "HIGH_VOLATILITY",
         least(1.0, c("volatility_percentile")), "volatility percentile is elevated"),
        ((trend >= 0.3) & (move > 0) & (news >= -0.1), "BULLISH_REGIME", least(0.95, 0.45 + trend),
         "trend strength is high with positive returns"),
        ((trend >= 0.3) & (move < 0) & (news <= 0.1), "BEARISH_REGIME", least(0.95, 0.45 + trend),
         "trend strength is high with negative returns"),
        (c("risk_on_score") > 0.65, "RISK_ON", least(0.9, c("risk_on_score")), "risk-on score is dominant"),
        (c("risk_off_score") > 0.65, "RISK_OFF", least(0.9, c("risk_off_score")), "risk-off score is dominant"),
        (trend >= 0.25, "TRENDING", least(0.85, 0.35 + trend), "ADX-derived trend strength is above threshold"),
        (F.lit(True), "SIDEWAYS", F.greatest(F.lit(s.regime_confidence_floor), 1 - trend),
         "trend strength is low and price action is range-like"),
    ]
    chosen = pick([
        F.when(hit, candidate(i, RULE_PRIORITY[label], label, value, reason))
        for i, (hit, label, value, reason) in enumerate(rules)
    ])
    return df.withColumn("_regime", chosen).withColumns({
        "regime": c("_regime.regime"),
        "confidence": F.greatest(F.lit(s.regime_confidence_floor), F.least(F.lit(1.0), c("_regime.confidence"))),
        "explanation": F.format_string("Market classified as %s because %s.", c("_regime.regime"), c("_regime.reason")),
    }).drop("_regime")


def regime_text() -> Column:
    """Readable summary of a rule-based regime row."""
    return F.format_string(
        "Market classified as %s with %s confidence because trend strength is %.2f, volatility percentile is "
        "%.2f, liquidity score is %.2f, and rolling sentiment is %.2f.",
        c("regime"), percent(c("confidence")), c("trend_strength"), c("volatility_percentile"),
        c("liquidity_score"), c("rolling_sentiment_mean"),
    )


def latest_rows(df: DataFrame, *keys: str, order: str = "ts") -> DataFrame:
    """The last row per key. The maximum is combined map-side, so a hot key is no hot task."""
    names = [n for n in df.columns if n not in keys]
    best = F.max_by(F.struct(*names), F.col(order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def last_n(df: DataFrame, n: int, *keys: str, order: str = "pos") -> DataFrame:
    """The last ``n`` rows per key, found from the highest position instead of a full sort."""
    top = df.groupBy(*keys).agg(F.max(order).alias("_top"))
    return df.join(top, list(keys)).where(F.col(order) > F.col("_top") - n).drop("_top")


def live_regime(frame: DataFrame, quality: DataFrame, s: AdaptiveSettings) -> DataFrame:
    """Current regime per symbol from the filled adaptive frame and its quality scores.

    The rank of the last ATR in the whole history is counted with map-side aggregates
    against the one latest row of the symbol; the width median needs the last 40 rows only.
    """
    latest = latest_rows(frame.select(
        "symbol", "ts", "pos", "close", "ema_slope", "macd_histogram", "adx_14",
        "bollinger_width", "atr", "realized_volatility"), "symbol")
    ranks = (
        frame.select("symbol", "atr").join(latest.select("symbol", c("atr").alias("_last")), "symbol")
        .groupBy("symbol").agg(
            F.count_if(c("atr") < c("_last")).alias("_less"),
            F.count_if(c("atr") == c("_last")).alias("_equal"),
            F.count(F.lit(1)).alias("_n"))
    )
    widths = (
        last_n(frame.select("symbol", "pos", "bollinger_width"), 40, "symbol")
        .groupBy("symbol").agg(F.median("bollinger_width").alias("_median"))
    )
    share = F.when(c("_n") > 5, (c("_less") + (c("_equal") + 1) / 2) / c("_n")).otherwise(0.0)
    df = (
        latest.join(ranks, "symbol").join(widths, "symbol")
        .join(quality.select("symbol", "quality_score"), "symbol", "left")
        .withColumns({
            "atr_percentile": share,
            "_atr_pct": c("atr") / F.greatest(c("close"), F.lit(1e-9)),
            "_slope": F.abs("ema_slope"), "_hist": F.abs("macd_histogram"),
            "quality_score": F.coalesce("quality_score", F.lit(1.0)),
        })
    )
    limit = F.greatest(c("_median") * 1.1, F.lit(s.bollinger_compression))
    compressed = c("bollinger_width") <= limit
    volatile = (
        (c("atr_percentile") >= s.atr_high_vol_percentile)
        | (c("realized_volatility") >= s.realized_vol_high)
        | (c("_atr_pct") >= 0.03)
        | ((c("_median") > 0) & (c("bollinger_width") > c("_median") * 1.8))
    )
    sideways = (
        (c("adx_14") < s.adx_sideways) & (c("_slope") < s.ema_slope_trend)
        & ((c("_median") == 0) | compressed)
    )
    trending = ~sideways & (
        ((c("adx_14") >= s.adx_trending) & ~compressed) | ((c("_slope") >= s.ema_slope_trend) & (c("_hist") > 0))
    )
    volatile_confidence = F.least(F.lit(0.95), 0.55 + F.greatest(
        c("atr_percentile") - 0.75, c("realized_volatility") * 5, c("_atr_pct") * 10))
    trend_confidence = F.least(
        F.lit(0.9),
        0.45 + F.least(c("adx_14") / 100, F.lit(0.35)) + F.least(c("_slope") * 20, F.lit(0.2))
        + F.when(c("_hist") > 0, 0.1).otherwise(0.0))
    df = df.withColumns({
        "regime": F.when(volatile, "HIGH_VOLATILITY").when(trending, "TRENDING").otherwise("SIDEWAYS"),
        "_raw": F.when(volatile, volatile_confidence).when(trending, trend_confidence)
        .when(sideways, 0.72).otherwise(0.58),
        "quality_adjusted": c("quality_score") < 0.75,
    })
    lowered = F.greatest(F.lit(s.regime_confidence_floor), c("_raw") * F.greatest(c("quality_score"), F.lit(0.35)))
    # Reason per regime.
    reason = (
        F.when(c("regime") == "HIGH_VOLATILITY",
               "volatility is elevated from ATR percentile, realized volatility, or Bollinger width expansion")
        .when(c("regime") == "TRENDING",
              "trend strength is clear from ADX or EMA slope and MACD histogram confirmation")
        .otherwise("trend strength is weak and Bollinger width is compressed or neutral")
    )
    return df.withColumns({
        "confidence": F.round(F.when(c("quality_adjusted"), lowered).otherwise(c("_raw")), 4),
        "features": F.create_map(*[
            x for out, name in (
                ("adx", "adx_14"), ("ema_slope", "ema_slope"), ("macd_histogram", "macd_histogram"),
                ("atr_percentile", "atr_percentile"), ("realized_volatility", "realized_volatility"),
                ("bollinger_width", "bollinger_width"))
            for x in (F.lit(out), c(name).cast("double"))]),
        "explanation": F.concat(
            F.lit("Market classified as "), c("regime"), F.lit(" because "), reason, F.lit("."),
            F.when(c("quality_adjusted"), " Confidence was reduced due to low feature quality.").otherwise("")),
    }).drop("_raw", "_slope", "_hist", "_atr_pct", "_median", "_less", "_equal", "_n")

