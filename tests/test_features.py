from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import tables
from quantloom.operators.asof import asof_join
from quantloom.operators.blocks import time_slice
from quantloom.plans import frames
from quantloom.settings import Blocks, Settings

SMALL = "/root/testdata/sf0.01"


def test_small_blocks_give_the_same_features(spark):
    """Cutting a series into many blocks changes nothing."""
    bars = tables.staged_bars(spark, SMALL).where("symbol in ('AF', 'RO')").cache()
    cut = Settings(blocks=Blocks(block_rows=1024, halo_rows=1024, lookahead_rows=64, scan_rows=512, slice_seconds=30 * 86400))
    names = ["macd", "macd_signal", "smooth_price", "rsi_14", "vwap", "supertrend_direction", "drawdown_60", "zscore_20",
             "next_close", "pos"]
    key = ["symbol", "ts"]
    a = frames.trading_frame(bars).select(*key, *names).toPandas().sort_values(key).reset_index(drop=True)
    b = frames.trading_frame(bars, cut).select(*key, *names).toPandas().sort_values(key).reset_index(drop=True)
    assert len(a) == len(b) == bars.count()
    for n in names:
        np.testing.assert_allclose(a[n].to_numpy(float), b[n].to_numpy(float), rtol=1e-9, atol=1e-6)


def test_against_pandas(spark, trend80):
    got = frames.adaptive_frame(trend80).toPandas().sort_values("ts").reset_index(drop=True)
    p = trend80.toPandas().sort_values("ts").reset_index(drop=True)
    close, volume = p.close, p.volume
    ema12, ema26 = close.ewm(span=12, adjust=False).mean(), close.ewm(span=26, adjust=False).mean()
    macd = ema12 - ema26
    delta = close.diff()
    gain, loss = delta.clip(lower=0).rolling(14, min_periods=1).mean(), (-delta.clip(upper=0)).rolling(14, min_periods=1).mean()
    rsi = (100 - 100 / (1 + gain / loss.replace(0, np.nan))).fillna(50)
    typical = (p.high + p.low + close) / 3
    returns = close.pct_change().fillna(0)
    vol = returns.rolling(20, min_periods=2).std(ddof=0)
    want = {
        "macd": macd, "macd_signal": macd.ewm(span=9, adjust=False).mean(), "rsi_14": rsi,
        "vwap": (typical * volume).cumsum() / volume.cumsum(), "return_5": close.pct_change(5).fillna(0),
        "volatility_percentile": vol.rolling(100, min_periods=5).rank(pct=True).fillna(0),
        "breakout_distance": ((close - p.high.rolling(20, min_periods=1).max().shift(1)) / close).fillna(0),
    }
    for name, series in want.items():
        np.testing.assert_allclose(got[name], series, rtol=1e-9, atol=1e-9, err_msg=name)
    assert not got.isna().any().any()


def test_features_ignore_the_future(spark, trend80):
    whole = frames.trading_frame(trend80).where("pos = 49").drop("next_close", "block").first()
    part = frames.trading_frame(trend80.where("ts < timestamp'2026-02-20'")).where("pos = 49").drop("next_close", "block").first()
    assert whole.asDict() == part.asDict()


def test_asof_matches_pandas(spark):
    rng = np.random.default_rng(3)
    t0 = datetime(2024, 1, 1)
    left = pd.DataFrame({"ts": sorted(t0 + timedelta(seconds=int(s)) for s in rng.choice(400_000, 300, replace=False)), "x": range(300)})
    right = pd.DataFrame({"ts": sorted(t0 + timedelta(seconds=int(s)) for s in rng.choice(400_000, 40, replace=False)), "v": rng.random(40)})
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), "ts", ["v"], time_slice("ts", 3600), bucket_rows=3)
    want = pd.merge_asof(left, right, on="ts")
    pd.testing.assert_series_equal(got.toPandas().sort_values("x").v.reset_index(drop=True), want.v, check_names=False)


def test_asof_keeps_rows_without_key_or_time(spark):
    at = datetime(2024, 1, 1)
    left = spark.createDataFrame([("a", at, 1), (None, at, 2), ("a", None, 3), ("b", at, 4)], "k string, ts timestamp, x int")
    right = spark.createDataFrame([("a", at, 0.5), (None, at, 0.7), ("a", None, 0.9)], "k string, ts timestamp, v double")
    got = {r.x: r.v for r in asof_join(left, right, "ts", ["v"], time_slice("ts", 3600), by=["k"]).collect()}
    assert got == {1: 0.5, 2: None, 3: None, 4: None}
    assert asof_join(left.limit(0), right, "ts", ["v"], time_slice("ts", 3600), by=["k"]).count() == 0


def test_leak_free_uses_the_previous_day(spark, trend80):
    news = spark.createDataFrame(
        [("INFY", datetime(2026, 1, 10).date(), 0.8, 2, 2, 0, 0.0)],
        "symbol string, day date, sentiment_score double, sentiment_count bigint, bullish_count bigint, bearish_count bigint, sector_sentiment double")
    def on(day, leak_free):
        frame = frames.adaptive_frame(trend80, news, leak_free=leak_free)
        return frame.where(F.to_date("ts") == F.lit(day).cast("date")).first().sentiment_score
    assert on("2026-01-10", False) == pytest.approx(0.8) and on("2026-01-10", True) == 0.0
    assert on("2026-01-11", True) == pytest.approx(0.8)


def test_index_rejects_unsafe_blocks():
    with pytest.raises(ValueError):
        Blocks(halo_rows=100)
