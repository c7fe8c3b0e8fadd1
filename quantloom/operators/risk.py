"""Risk level, stops and targets, position size, action overrides and the final gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.safe import div, zero
from quantloom.operators.ensemble import agreement, percent, sentiment_only
from quantloom.settings import TradingSettings

c = F.col


def stop_loss(entry: Column, atr: Column, action: Column, fallback: float = 0.02) -> Column:
    distance = F.greatest(atr * 1.5, entry * fallback)
    return F.round(F.when(action == "SELL", entry + distance).otherwise(entry - distance), 2)


def target(entry: Column, stop: Column, action: Column, multiple: float = 2.0) -> Column:
    distance = multiple * F.abs(entry - stop)
    return F.round(F.when(action == "SELL", entry - distance).otherwise(entry + distance), 2)


def position(entry: Column, stop: Column, capital: float, risk_per_trade: float) -> tuple[Column, Column]:
    """Quantity limited by the risk budget and by what the capital can buy; and capital at risk."""
    unit = F.abs(entry - stop)
    quantity = F.least(div(F.lit(capital * risk_per_trade), unit), F.lit(capital) / F.greatest(entry, F.lit(1e-9)))
    usable = unit > 0
    return (
        F.when(usable, F.round(quantity, 4)).otherwise(0.0),
        F.when(usable, F.round(quantity * unit, 2)).otherwise(0.0),
    )


def preliminary_level(atr_pct: Column, s: TradingSettings) -> Column:
    return (
        F.when(atr_pct >= s.high_volatility_atr_pct * 1.5, "HIGH")
        .when(atr_pct >= s.high_volatility_atr_pct, "MODERATE")
        .otherwise("LOW")
    )


def risk_level(atr_pct: Column, drawdown: Column, reward_ratio: Column, s: TradingSettings) -> Column:
    vol, limit = s.high_volatility_atr_pct, s.max_drawdown_limit
    return (
        F.when((atr_pct >= vol * 2.2) | (drawdown >= limit * 1.25), "EXTREME")
        .when((atr_pct >= vol * 1.5) | (reward_ratio < 1.2) | (drawdown >= limit), "HIGH")
        .when((atr_pct >= vol) | (reward_ratio < 1.8), "MODERATE")
        .otherwise("LOW")
    )


def evaluate(df: DataFrame, s: TradingSettings, as_of: Column | None = None) -> DataFrame:
    """Risk decision per row of :func:`quantloom.operators.ensemble.vote` output.

    ``as_of`` is the time against which staleness is judged; without it no row is stale.
    Uses close, atr_14, atr_pct, volume, drawdown_60 and rolling_return_5 of the bar.
    """
    stale = F.lit(False)
    if as_of is not None:
        stale = F.unix_micros(as_of) - F.unix_micros(c("ts")) > s.stale_seconds * 1_000_000
    proposed = c("suggested_action")
    side = F.when(proposed == "HOLD", "BUY").otherwise(proposed)
    df = df.withColumns({"_stale": stale, "_stop": stop_loss(c("close"), c("atr_14"), side)})
    df = df.withColumn("_target", target(c("close"), c("_stop"), side))
    ratio = div(F.abs(c("_target") - c("close")), F.abs(c("close") - c("_stop")))
    size, at_risk = position(c("close"), c("_stop"), s.capital, s.risk_per_trade)
    df = df.withColumns({"_rr": zero(ratio), "_size": size, "_at_risk": at_risk})
    df = df.withColumn("risk_level", risk_level(c("atr_pct"), F.abs("drawdown_60"), c("_rr"), s))

    strongest = F.greatest("bullish_probability", "bearish_probability")
    panic = zero(c("rolling_return_5")) <= s.panic_drawdown_pct
    to_hold_early = c("_stale") | (zero(c("volume")) <= 0) | (zero(c("atr_14")) <= 0)
    to_hold = (
        (c("confidence") == "LOW")
        | (c("_rr") < 1.5)
        | (strongest < 0.62)
        | (agreement(c("strategy_breakdown"), proposed) < 2)
        | sentiment_only(c("strategy_breakdown"), proposed)
        | ((c("risk_level") == "HIGH") & panic)
    )
    df = df.withColumn(
        "final_action",
        F.when((proposed == "HOLD") | to_hold_early, "HOLD")
        .when(c("risk_level") == "EXTREME", "AVOID")
        .when(to_hold, "HOLD")
        .otherwise(proposed),
    )
    extreme, high = c("risk_level") == "EXTREME", c("risk_level") == "HIGH"
    kept = c("final_action") == proposed
    return df.withColumns({
        "approved": kept & (c("final_action") != "HOLD") & ~extreme & ~high,
        "override_applied": ~kept,
        "entry_price": F.round("close", 2),
        "stop_loss": F.when(~extreme, c("_stop")),
        "target": F.when(~extreme, c("_target")),
        "risk_reward_ratio": F.round("_rr", 3),
        "position_size": F.when(extreme, 0.0).when(high, F.round(c("_size") * 0.5, 4)).otherwise(c("_size")),
        "capital_at_risk": F.when(extreme, 0.0).when(high, F.round(c("_at_risk") * 0.5, 2)).otherwise(c("_at_risk")),
        "risk_reason": _reason(proposed),
    }).drop("_stale", "_stop", "_target", "_rr", "_size", "_at_risk")


def _reason(proposed: Column) -> Column:
    """Uses the intermediate columns of :func:`evaluate`."""
    details = F.concat_ws(
        "; ",
        F.when(c("_stale"), "latest candle is stale"),
        F.when(zero(c("volume")) <= 0, "latest candle volume is zero"),
        F.when(zero(c("atr_14")) <= 0, "ATR is unavailable"),
        F.when(c("_rr") < 1.5, "risk/reward is below 1.5"),
    )
    cause = F.when(details != "", details).otherwise(F.format_string("risk level is %s", c("risk_level")))
    return F.when(
        c("final_action") != proposed,
        F.format_string(
            "Risk engine overrode %s to %s; %s; risk/reward is %.2f.",
            proposed, c("final_action"), cause, c("_rr")),
    ).otherwise(F.format_string(
        "Risk engine approved %s; risk level is %s, ATR percentage is %.2f%%, and risk/reward is %.2f.",
        c("final_action"), c("risk_level"), c("atr_pct") * 100, c("_rr")))


def final_text(df: DataFrame) -> DataFrame:
    """Add ``final_explanation``. Optional columns: news_score, option_pcr, option_iv."""
    from quantloom.operators.ensemble import count_with, names_with, sentence

    signals = c("signals")
    news_label = F.when(c("news_score") > 0.1, "positive").when(c("news_score") < -0.1, "negative").otherwise("neutral")

    def or_unavailable(value: Column) -> Column:
        return F.coalesce(F.format_string("%s", value), F.lit("unavailable"))

    text = F.concat_ws(
        " ",
        F.format_string(
            "Combined market intelligence suggests %s bullish probability, %s bearish probability, "
            "and %s neutral probability.",
            percent(c("bullish_probability")), percent(c("bearish_probability")), percent(c("neutral_probability"))),
        F.format_string("The current regime is %s.", F.coalesce(c("regime"), F.lit("unknown"))),
        F.when(c("regime").isNotNull(), F.format_string(
            "Regime detector classified the market as %s with %s confidence.",
            c("regime"), percent(c("regime_confidence")))),
        F.format_string(
            "Strategy agreement is %d BUY, %d SELL, and %d HOLD.",
            count_with(signals, "BUY"), count_with(signals, "SELL"), count_with(signals, "HOLD")),
        sentence(names_with(signals, "BUY"), "Bullish support comes from %s."),
        sentence(names_with(signals, "SELL"), "Bearish pressure comes from %s."),
        sentence(names_with(signals, "HOLD", 3), "Neutral or non-confirming strategies include %s."),
        F.when(c("news_score").isNotNull(), F.format_string(
            "News sentiment contribution is %s with score %.2f.", news_label, c("news_score"))),
        F.when(c("option_pcr").isNotNull(), F.concat(
            F.lit("Options context includes PCR "), or_unavailable(c("option_pcr")),
            F.lit(" and IV "), or_unavailable(c("option_iv")), F.lit(".")))
        .otherwise("Options context is unavailable, so options confirmation did not contribute."),
        F.format_string("Risk engine final action is %s: %s", c("final_action"), c("risk_reason")),
    )
    return df.withColumn("final_explanation", text)


def gate(df: DataFrame) -> DataFrame:
    """Last authority over a signal. Adds ``gate_*`` columns; later rules overwrite earlier ones.

    Needs suggested_action, confidence, risk_level, risk_reward_ratio, position_size,
    stop_loss, target and the booleans stale_data, high_anomaly, drawdown_breach.
    """
    poor = c("risk_reward_ratio") < 1.2
    weak = c("high_anomaly") & (c("confidence") != "HIGH")

    df = df.withColumns({
        "gate_action": F.when(c("stale_data"), "AVOID").otherwise(c("suggested_action")),
        "_ok": ~c("stale_data"),
        "gate_risk_level": F.when(c("stale_data"), "HIGH").otherwise(c("risk_level")),
        "_size": F.when(c("stale_data"), 0.0).otherwise(c("position_size")),
        "_why": F.array(F.when(c("stale_data"), "stale data prevents signal approval")),
    })

    def rule(frame: DataFrame, hit: Column, action: str, reason: str, size: Column | None = None) -> DataFrame:
        hit = F.coalesce(hit, F.lit(False))
        return frame.withColumns({
            "gate_action": F.when(hit, action).otherwise(c("gate_action")),
            "_ok": c("_ok") & ~hit,
            "_size": c("_size") if size is None else F.when(hit, size).otherwise(c("_size")),
            "_why": F.array_append("_why", F.when(hit, reason)) if reason else c("_why"),
        })

    df = rule(df, poor & (c("gate_action") != "HOLD"), "HOLD", "poor risk/reward downgraded directional signal")
    high = c("risk_level") == "HIGH"
    df = df.withColumns({
        "_size": F.when(high, c("_size") * 0.5).otherwise(c("_size")),
        "_why": F.array_append("_why", F.when(high, "high risk reduced position size")),
    })
    df = df.withColumn("_why", F.array_append("_why", F.when(
        c("high_anomaly"), "high anomaly severity requires stronger confirmation")))
    df = rule(df, weak, "HOLD", "")
    df = rule(df, c("drawdown_breach"), "AVOID", "recent drawdown breach blocks new trades", F.lit(0.0))
    df = rule(df, (c("confidence") == "LOW") & (c("gate_action") != "HOLD"), "HOLD",
              "low confidence ensemble downgraded to HOLD")
    why = F.array_join(F.array_compact("_why"), "; ")
    return df.withColumns({
        "gate_approved": c("_ok") & (c("gate_action") != "HOLD"),
        "gate_position_size": F.round("_size", 4),
        "gate_stop_loss": F.when(c("_size") > 0, c("stop_loss")),
        "gate_target": F.when(c("_size") > 0, c("target")),
        "gate_reason": F.when(why != "", why).otherwise("risk gatekeeper approved the ensemble signal"),
    }).drop("_ok", "_size", "_why")
