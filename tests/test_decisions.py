from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest
from bars import minute_bars
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantloom.operators import backtest, ensemble, news, quality, regimes, risk, strategies, weighting
from quantloom.plans import frames
from quantloom.settings import DEFAULT


def brute_water_fill(ws, cap=0.45, floor=0.05):
    """Plain reading of the rule: scale, cap, hand the overflow to the rest, up to eight times."""
    w = np.maximum(np.array(ws, float), 0)
    w = w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))
    low = floor if len(w) * floor < 1 else 0.0
    w = np.minimum(np.maximum(w, low), cap)
    for _ in range(8):
        w = w / w.sum()
        over = w > cap
        if not over.any():
            return np.maximum(w, low)
        room, below = max(0.0, 1 - over.sum() * cap), w[~over].sum() or 1.0
        w = np.where(over, cap, np.maximum(low, w / below * room))
    w = np.minimum(w / w.sum(), cap)
    rest, takers = 1 - w.sum(), (w < cap).sum()
    return np.where((w < cap) & (rest > 0), np.minimum(cap, w + rest / max(takers, 1)), w)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.floats(0, 10), min_size=1, max_size=22), min_size=20, max_size=20))
def test_water_fill(spark, cases):
    rows = spark.createDataFrame([(i, [float(x) for x in w]) for i, w in enumerate(cases)], "i int, w array<double>")
    got = rows.select("i", ensemble.water_fill(F.col("w"), 0.45, 0.05).alias("w")).orderBy("i").collect()
    for row, case in zip(got, cases):
        np.testing.assert_allclose(row.w, brute_water_fill(case), atol=1e-9)


def test_regimes_of_known_series(spark):
    bars = (
        minute_bars(spark, "TREND", [2.0], 3).union(minute_bars(spark, "FLAT", [0.05, -0.04], 1))
        .union(minute_bars(spark, "WILD", [8.0, -7.0], 25)))
    stages = frames.adaptive_stages(bars)
    now = F.lit("2026-01-01 10:20:00").cast("timestamp")
    report = quality.feature_quality(stages, now)
    got = {r.symbol: r for r in regimes.live_regime(frames.fill_numeric(stages), report, DEFAULT.adaptive).collect()}
    assert got["TREND"].regime == "TRENDING" and got["FLAT"].regime == "SIDEWAYS" and got["WILD"].regime == "HIGH_VOLATILITY"


def test_a_mean_on_a_limit_is_that_limit(spark, trend80):
    """Sentiment of -0.1 by the numbers counts as -0.1, in whatever order the scores are added."""
    odd = [-0.65, -0.55, -0.55, -0.55, -0.55, -0.65, 0.0]  # mean -0.5; added as doubles in this order it is less
    days = [odd], [odd[::-1]], [[-0.55], [0.0], [-0.65], [0.7]]  # the last ones add up to less than -0.5, too
    for scores in days:
        rows = [("INFY", datetime(2026, 3, 9 + i), x) for i, day in enumerate(scores) for x in day]
        events = spark.createDataFrame(rows, "symbol string, ts timestamp, sentiment_score double").withColumns({"sentiment": F.lit("neutral"), "sector": F.lit("it")})
        frame = frames.adaptive_frame(trend80, news.daily_sentiment(events.coalesce(1))).withColumn("risk_on_score", F.lit(0.0))
        got = regimes.rule_regime(frame, DEFAULT.adaptive).where("ts = timestamp'2026-03-12'").first()
        assert (got.rolling_sentiment_mean, got.regime) == (-0.1, "BULLISH_REGIME")


def decided(spark, bars, as_of=None, names=None):
    df = regimes.trading_regime(strategies.with_signals(frames.trading_frame(bars), names), DEFAULT.trading)
    return risk.evaluate(ensemble.vote(ensemble.weighted(df, 0.45, 0.05)), DEFAULT.trading, as_of)


def test_probabilities_and_stale_data(spark, trend80):
    now = decided(spark, trend80, F.lit("2026-06-01").cast("timestamp")).collect()
    for r in now:
        assert r.bullish_probability + r.bearish_probability + r.neutral_probability == pytest.approx(1, abs=2e-4)
        assert sum(r.weights) == pytest.approx(1) and max(r.weights) <= 0.45 + 1e-9
        assert r.final_action == "HOLD"
        if r.suggested_action != "HOLD":
            assert "stale" in r.risk_reason


def test_unknown_strategy_and_custom_strategy(spark, trend80):
    with pytest.raises(ValueError, match="Unknown strategy: Nope"):
        strategies.select_strategies(["Nope"])
    mine = strategies.Strategy("Always Up", "momentum", lambda: strategies.verdict(0.9, 0.8, "always"))
    rows = strategies.signal_rows(frames.trading_frame(trend80), ["Always Up"], [mine]).collect()
    assert {r.signal for r in rows} == {"BUY"}
    config = spark.createDataFrame([("a", "VWAP", 0.3), ("a", "Nope", 0.1), ("b", "Breakout", 0.6)], "config string, strategy_name string, weight double")
    issues = {r.strategy_name: r.issue for r in strategies.config_issues(spark, config, 0.45).collect()}
    assert set(issues) == {"Nope", "Breakout"} and "exceeds" in issues["Breakout"]


def test_accuracy_moves_weights(spark, trend80):
    frame = frames.trading_frame(trend80).where("pos = 79")
    record = F.create_map(
        F.lit("MACD Momentum"), F.struct(F.lit(0.82).alias("accuracy"), F.lit(30).alias("sample_size")),
        F.lit("RSI Reversal"), F.struct(F.lit(0.35).alias("accuracy"), F.lit(30).alias("sample_size")))
    df = strategies.with_signals(frame, ["MACD Momentum", "RSI Reversal", "VWAP"]).withColumns({"regime": F.lit("normal"), "acc": record})
    w = dict(ensemble.vote(ensemble.weighted(df, 0.45, 0.05, accuracy="acc")).first().weights_used)
    assert w["MACD Momentum"] > w["RSI Reversal"] and all(0.05 <= v <= 0.45 + 1e-9 for v in w.values())


def test_backtest_drawdown_across_blocks(spark):
    rng = np.random.default_rng(5)
    r = rng.normal(0, 0.8, 200)
    rows = spark.createDataFrame([("s", "A", int(i // 17), int(i), float(x)) for i, x in enumerate(r)],
                                 "strategy_name string, symbol string, block int, pos int, realized double")
    equity = np.cumprod(1 + r)
    peak = np.maximum.accumulate(np.concatenate([[1.0], equity]))[1:]
    got = backtest.equity_curve(rows).orderBy("pos").toPandas()
    np.testing.assert_allclose(got.equity_sign * np.exp(got.log_equity), equity, rtol=1e-9)
    np.testing.assert_allclose(np.exp(got.log_peak), peak, rtol=1e-9)
    np.testing.assert_allclose(got.drawdown, equity / peak - 1, rtol=1e-9)


def test_a_long_series_does_not_overflow(spark):
    r = np.tile([2.0, -0.5, 3.0, -1.5, 0.9], 4000)
    rows = spark.createDataFrame([("s", "A", int(i // 512), int(i), float(x)) for i, x in enumerate(r)],
                                 "strategy_name string, symbol string, block int, pos int, realized double")
    got = backtest.equity_curve(rows).orderBy("pos").toPandas()
    sign, log = np.cumprod(np.sign(1 + r)), np.cumsum(np.log(np.abs(1 + r)))
    high = np.maximum.accumulate(np.where(sign > 0, log, 0.0).clip(min=0))
    np.testing.assert_allclose(got.log_equity, log, rtol=1e-9)
    np.testing.assert_allclose(got.drawdown, sign * np.exp(log - high) - 1, rtol=1e-6)
    assert got.drawdown.notna().all() and log.max() > 1000


def test_adaptive_weights_prefer_trend(spark):
    base = F.create_map(*[F.lit(x) for n in ("MACD Momentum", "RSI Reversal", "VWAP", "ATR System") for x in (n, 0.25)])
    df = spark.range(1).select(
        base.alias("base_weights"), F.lit("TRENDING").alias("regime"), F.lit(0.82).alias("regime_confidence"), F.lit(0.3).alias("sentiment_score"),
        F.lit(0.4).alias("volatility_score"), F.lit("LOW").alias("risk_level"), F.lit(False).alias("severe_anomaly"),
        F.lit(None).cast("map<string,struct<accuracy:double,avg_return:double,max_drawdown:double,sample_size:bigint>>").alias("performance"))
    w = weighting.adaptive_weights(df, DEFAULT.adaptive).first().weights
    assert sum(w.values()) == pytest.approx(1) and w["MACD Momentum"] > w["RSI Reversal"]


def test_gate_order(spark):
    row = ("A", datetime(2026, 1, 1), "BUY", "HIGH", "LOW", 2.0, 10.0, 95.0, 110.0, True, False, False)
    df = spark.createDataFrame([row], "symbol string, ts timestamp, suggested_action string, confidence string, risk_level string, "
                               "risk_reward_ratio double, position_size double, stop_loss double, target double, stale_data boolean, "
                               "high_anomaly boolean, drawdown_breach boolean")
    out = risk.gate(df).first()
    assert out.gate_action == "AVOID" and not out.gate_approved and out.gate_position_size == 0 and out.gate_stop_loss is None
