"""Anomaly rules evaluated on every bar, and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def hit(condition: Column, kind: str, severity: Column | str, score: Column, text: str) -> Column:
    """Anomaly struct where the condition holds, else NULL."""
    level = severity if isinstance(severity, Column) else F.lit(severity)
    return F.when(condition, F.struct(
        F.lit(kind).alias("anomaly_type"), level.alias("severity"),
        score.cast("double").alias("score"), F.lit(text).alias("explanation")))


def graded(score: Column) -> Column:
    return F.when(score >= 5, "EXTREME").when(score >= 3, "HIGH").otherwise("MODERATE")


def score_hits(threshold: float = 3.0) -> list[Column]:
    """Z-score and level rules."""
    volume = F.abs("unusual_volume_score")
    shock, oi, thin = c("volatility_shock_score"), c("options_anomaly_score"), c("liquidity_breakdown_score")
    return [
        hit(volume >= threshold, "unusual_volume", graded(volume), volume,
            "Volume is unusually far from its rolling baseline."),
        hit(shock >= 2.5, "volatility_shock", graded(shock), shock,
            "High-low range expansion indicates a volatility shock."),
        hit(oi >= 2.5, "options_anomaly", graded(oi), oi, "Options open-interest activity is unusually elevated."),
        hit(thin >= 0.75, "liquidity_breakdown", graded(thin), thin,
            "Liquidity score is materially below its normal range."),
    ]


def divergence_hits() -> list[Column]:
    news, volume = F.abs("sentiment_price_divergence_score"), F.abs("price_volume_divergence")
    return [
        hit(news >= 0.35, "price_news_divergence", F.when(news < 0.65, "MODERATE").otherwise("HIGH"), news,
            "News sentiment and recent price direction are diverging."),
        hit(volume >= 0.08, "price_volume_divergence", "MODERATE", volume,
            "Recent price movement conflicts with abnormal volume behavior."),
    ]


def fake_breakout_hits() -> list[Column]:
    p = c("fake_breakout_probability")
    return [hit(p >= 0.5, "fake_breakout_probability", "MODERATE", p,
                "Breakout lacks confirmation from follow-through and volume.")]


def trading_hits() -> list[Column]:
    """Rules of the trading layer; news and options parts are NULL-safe."""
    news = F.coalesce(c("news_score"), F.lit(0.0))
    shift = F.abs("option_call_oi_change") + F.abs("option_put_oi_change")
    return [
        hit(c("volume_ratio") >= 2.5, "unusual_volume", "MODERATE", c("volume_ratio"),
            "Volume is more than 2.5x its rolling average."),
        hit(c("atr_pct") >= 0.04, "volatility_spike", "HIGH", c("atr_pct"),
            "ATR percentage indicates an elevated volatility spike."),
        hit((F.abs(news) >= 0.65) & (c("returns") * news < 0), "price_news_divergence", "MODERATE", F.abs(news),
            "Price action diverges from current news sentiment."),
        hit(shift >= 1_000_000, "unusual_options_activity", "MODERATE", shift,
            "Options open-interest change is unusually large."),
    ]


def anomaly_rows(df: DataFrame, hits: list[Column], *keep: str) -> DataFrame:
    """One row per anomaly found on a bar."""
    return df.select("symbol", "ts", *keep, F.inline(F.array_compact(F.array(*hits))))


def best_per_type(anomalies: DataFrame) -> DataFrame:
    """Strongest anomaly per (symbol, ts, type); among equals the lowest ``detector`` rank wins."""
    rank = F.struct(c("score"), -c("detector"))
    return anomalies.groupBy("symbol", "ts", "anomaly_type").agg(
        F.max_by("severity", rank).alias("severity"), F.max("score").alias("score"),
        F.max_by("explanation", rank).alias("explanation"))


def risk_from_severity(anomalies: DataFrame, *keys: str) -> DataFrame:
    """Risk level per key from the severities present."""
    severe = F.max(F.upper("severity").isin("HIGH", "EXTREME"))
    medium = F.max(F.upper("severity") == "MODERATE")
    return anomalies.groupBy(*keys).agg(
        F.when(severe, "HIGH").when(medium, "MODERATE").otherwise("LOW").alias("risk_level"),
        F.count(F.lit(1)).alias("anomalies"))
