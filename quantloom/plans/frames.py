"""Feature frames for all symbols and bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.safe import zero
from quantloom.operators import features as feat
from quantloom.operators.asof import asof_join
from quantloom.operators.blocks import index_rows, owned, time_slice, with_blocks
from quantloom.settings import DEFAULT, Settings

c = F.col

BAR_COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "volume"]


def blocked_bars(bars: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Bars with position, VWAP totals and block assignment.

    ``bars`` has one row per (symbol, ts). It is scanned twice (numbering needs slice
    counts first), so give it as a stored table rather than an expensive query.
    """
    indexed = index_rows(
        bars, ["symbol"], ["ts"], time_slice("ts", settings.blocks.slice_seconds), feat.vwap_totals())
    return with_blocks(indexed, settings.blocks)


def trading_frame(bars: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Features of the strategy layer, one row per bar."""
    return owned(feat.trading_features(blocked_bars(bars.select(*BAR_COLUMNS), settings), settings.blocks))


def reference_returns(series: DataFrame, name: str, keys: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """``{name}_returns`` and ``{name}_return_20`` of reference series (columns keys, ts, close)."""
    key = F.concat_ws("|", F.lit(name), *keys)
    rows = series.select(*keys, "ts", "close", key.alias("symbol"))
    indexed = index_rows(rows, ["symbol"], ["ts"], time_slice("ts", settings.blocks.slice_seconds))
    blocked = with_blocks(indexed, settings.blocks).withColumns({
        f"{name}_returns": zero(feat.change("close", 1)),
        f"{name}_return_20": zero(feat.change("close", 20)),
    })
    return owned(blocked).select(*keys, "ts", f"{name}_returns", f"{name}_return_20")


def attach_reference(
    bars: DataFrame, series: DataFrame | None, name: str, keys: list[str], settings: Settings = DEFAULT
) -> DataFrame:
    """As-of join of the reference returns; 0 before the series starts or without one."""
    columns = [f"{name}_returns", f"{name}_return_20"]
    if series is None:
        return bars.withColumns({n: F.lit(0.0) for n in columns})
    joined = asof_join(
        bars, reference_returns(series, name, keys, settings), "ts", columns,
        time_slice("ts", settings.blocks.slice_seconds), by=keys, spread=["symbol", "ts"])
    return joined.withColumns({n: zero(c(n)) for n in columns})


NEWS_COLUMNS = ("sentiment_score", "sentiment_count", "bullish_count", "bearish_count", "sector_sentiment")
OPTION_COLUMNS = ("pcr", "max_pain", "iv", "call_oi_change", "put_oi_change", "options_volume_call", "options_volume_put")


def day_context(
    bars: DataFrame, news_daily: DataFrame | None, options_daily: DataFrame | None
) -> DataFrame:
    """News and options columns per (symbol, day that has a bar), options carried forward.

    A symbol has at most one row per calendar day here, so the carry-forward window is
    small however many bars, articles or snapshots the symbol has.
    """
    from pyspark.sql import Window

    days = bars.select("symbol", F.to_date("ts").alias("day")).distinct()
    if news_daily is not None:
        days = days.join(news_daily.select("symbol", "day", *NEWS_COLUMNS), ["symbol", "day"], "left")
        with_news = news_daily.select("symbol").distinct().withColumn("has_sentiment", F.lit(True))
        days = days.join(with_news, "symbol", "left")
    else:
        days = days.withColumns({n: F.lit(None).cast("double") for n in NEWS_COLUMNS})
        days = days.withColumn("has_sentiment", F.lit(False))
    if options_daily is not None:
        days = days.join(options_daily.select("symbol", "day", *OPTION_COLUMNS), ["symbol", "day"], "left")
        so_far = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
        days = days.withColumns({n: F.last(n, ignorenulls=True).over(so_far) for n in OPTION_COLUMNS})
    else:
        days = days.withColumns({n: F.lit(None).cast("double") for n in OPTION_COLUMNS})
    filled = {n: F.coalesce(c(n), F.lit(0)) for n in ("sentiment_count", "bullish_count", "bearish_count")}
    return days.withColumns({
        "sentiment_score": zero(c("sentiment_score")), "sector_sentiment": zero(c("sector_sentiment")),
        "has_sentiment": F.coalesce("has_sentiment", F.lit(False)), **filled,
    })


def _next_day(daily: DataFrame | None) -> DataFrame | None:
    return None if daily is None else daily.withColumn("day", F.date_add("day", 1))


def adaptive_stages(
    bars: DataFrame,
    news_daily: DataFrame | None = None,
    options_daily: DataFrame | None = None,
    benchmark: DataFrame | None = None,
    sector: DataFrame | None = None,
    sector_keys: list[str] | None = None,
    leak_free: bool = False,
    settings: Settings = DEFAULT,
) -> DataFrame:
    """The adaptive feature frame before NULLs are filled, one row per bar.

    ``leak_free`` uses the previous day's news and options, so that an intraday bar never
    sees what was published later that day.
    """
    if leak_free:
        news_daily, options_daily = _next_day(news_daily), _next_day(options_daily)
    joined = attach_reference(bars, benchmark, "benchmark", [], settings)
    joined = attach_reference(joined, sector, "sector", sector_keys or [], settings)
    context = day_context(bars, news_daily, options_daily)
    joined = joined.withColumn("day", F.to_date("ts")).join(context, ["symbol", "day"], "left")
    df = feat.returns(blocked_bars(joined, settings))
    df = feat.momentum(feat.volatility(df), settings.blocks)
    df = feat.correlation(feat.options(feat.sentiment(df)))
    df = feat.contract_aliases(feat.anomaly_scores(feat.regime_scores(df)))
    return owned(df).drop("prev_close", "true_range", "cum_price_volume", "cum_volume", "day")


def fill_numeric(df: DataFrame) -> DataFrame:
    """NULL numbers become 0."""
    names = [n for n, t in df.dtypes if t in ("double", "float", "int", "bigint")]
    return df.withColumns({n: F.coalesce(c(n), F.lit(0).cast(dict(df.dtypes)[n])) for n in names})


def adaptive_frame(bars: DataFrame, *args, **options) -> DataFrame:
    return fill_numeric(adaptive_stages(bars, *args, **options))


# Fields of the served feature vector.
VECTOR_FIELDS = (
    "rsi", "macd", "macd_signal", "macd_histogram", "ema_slope", "vwap_distance", "atr", "bollinger_width",
    "realized_volatility", "rolling_sentiment_mean", "bullish_count", "bearish_count", "neutral_count",
    "sentiment_momentum", "pcr_trend", "iv_spike", "oi_imbalance",
)


def feature_vector(frame: DataFrame, timeframe: str = "1m") -> DataFrame:
    """Latest feature vector per symbol."""
    from quantloom.operators.regimes import latest_rows

    narrow = frame.select("symbol", "ts", *VECTOR_FIELDS)
    return latest_rows(narrow, "symbol").withColumn("timeframe", F.lit(timeframe))
