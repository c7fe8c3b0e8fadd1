"""Ticks to OHLCV candles and candle roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Candle widths in seconds.
TIMEFRAMES = {"1m": 60, "5m": 300, "15m": 900}


def clean_ticks(ticks: DataFrame) -> DataFrame:
    """Drop ticks without a positive price; missing or negative volume counts as 0."""
    return ticks.where(F.col("price") > 0).withColumn(
        "volume", F.greatest(F.coalesce(F.col("volume"), F.lit(0.0)), F.lit(0.0))
    )


def bucket_start(ts: Column, seconds: int) -> Column:
    """Floor a timestamp to a multiple of ``seconds`` since the epoch."""
    epoch = F.unix_seconds(ts)
    return F.timestamp_seconds(epoch - F.pmod(epoch, F.lit(seconds)))


def candle_aggs(order: Column, price: str = "price") -> list[Column]:
    """Open/high/low/close in arrival order. The feed's volume is cumulative, so its max is kept."""
    return [
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.max("volume").alias("volume"),
    ]


def candles(ticks: DataFrame, timeframe: str, arrival: str = "seq") -> DataFrame:
    """One candle per (symbol, bucket). All aggregates combine map-side before the shuffle."""
    return (
        clean_ticks(ticks)
        .groupBy(
            F.upper("symbol").alias("symbol"),
            bucket_start(F.col("ts"), TIMEFRAMES[timeframe]).alias("bucket"),
        )
        .agg(*candle_aggs(F.col(arrival)), F.min(arrival).alias("first_seq"), F.max(arrival).alias("last_seq"))
        .withColumn("timeframe", F.lit(timeframe))
        .withColumnRenamed("bucket", "ts")
    )


def roll_up(fine: DataFrame, timeframe: str) -> DataFrame:
    """Coarser candles from finer ones, without touching the ticks again."""
    return (
        fine.groupBy("symbol", bucket_start(F.col("ts"), TIMEFRAMES[timeframe]).alias("bucket"))
        .agg(
            F.min_by("open", "first_seq").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "last_seq").alias("close"),
            F.max("volume").alias("volume"),
            F.min("first_seq").alias("first_seq"),
            F.max("last_seq").alias("last_seq"),
        )
        .withColumn("timeframe", F.lit(timeframe))
        .withColumnRenamed("bucket", "ts")
    )


def trade_bars(trades: DataFrame, order: list[str], seconds: int = 86400) -> DataFrame:
    """Bars from trades: per-trade sizes are summed; ``order`` sorts the trades of a bar."""
    key = F.struct(*order)
    return (
        trades.groupBy("symbol", bucket_start(F.col("ts"), seconds).alias("bucket"))
        .agg(
            F.min_by("price", key).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", key).alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("bucket", "ts")
    )
