"""Trading strategies as column expressions over the trading feature row.

A strategy turns a feature row into ``(score, confidence, reason)``; the common rule in
:func:`signal` bounds both numbers and labels the row BUY, SELL or HOLD. Every strategy
runs on all symbols and all bars at once, so the latest signal is a filter and a
back-test is the same plan without it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.safe import clip, let, lit

c = F.col

MOMENTUM, MEAN_REVERSION, VOLATILITY = "momentum", "mean_reversion", "volatility"
STATISTICAL, AI_ML = "statistical", "ai_ml"

# Fixed value: score beyond which a signal is directional.
DIRECTION_THRESHOLD = 0.15

Verdict = tuple[Column | float, Column | float, str | Column]


@dataclass(frozen=True)
class Strategy:
    """``verdict`` builds the (score, confidence, reason) struct from feature columns."""

    name: str
    category: str
    verdict: Callable[[], Column]
    min_rows: int = 0
    too_few: str = ""
    inputs: tuple[str, ...] = ()


def verdict(score: Column | float, confidence: Column | float, reason: str | Column) -> Column:
    return F.struct(
        lit(score).cast("double").alias("score"),
        lit(confidence).cast("double").alias("confidence"),
        lit(reason).alias("reason"),
    )


def hold(reason: str) -> Column:
    return verdict(0.0, 0.1, reason)


def choose(branches: Sequence[tuple[Column, Verdict]], otherwise: Verdict) -> Column:
    """First branch whose condition holds."""
    chain = F
    for condition, outcome in branches:
        chain = chain.when(condition, verdict(*outcome))
    return chain.otherwise(verdict(*otherwise))


def bounded_verdict(strategy: Strategy) -> Column:
    """The strategy's verdict for the current row; a hold where the series is too short."""
    raw = strategy.verdict()
    if strategy.min_rows:
        raw = F.when(c("pos") + 1 >= strategy.min_rows, raw).otherwise(hold(strategy.too_few))
    return raw


def label(score: Column) -> Column:
    return (
        F.when(score > DIRECTION_THRESHOLD, "BUY").when(score < -DIRECTION_THRESHOLD, "SELL").otherwise("HOLD")
    )


def signal(strategy: Strategy) -> Column:
    """Signal struct of the current row; the verdict is bound once and then read several times."""

    def shape(v: Column) -> Column:
        score = clip(v["score"], -1.0, 1.0)
        return F.struct(
            F.lit(strategy.name).alias("strategy_name"),
            F.lit(strategy.category).alias("category"),
            label(score).alias("signal"),
            clip(v["confidence"], 0.0, 1.0).alias("confidence"),
            score.alias("score"),
            v["reason"].alias("reason"),
            metadata(strategy).alias("metadata"),
        )

    return let(bounded_verdict(strategy), shape)


def metadata(strategy: Strategy) -> Column:
    if not strategy.inputs:
        return F.create_map().cast("map<string,double>")
    return F.create_map(*[x for name in strategy.inputs for x in (F.lit(name), c(name).cast("double"))])


def _breakout() -> Column:
    strength = F.least(F.lit(1.0), 0.45 + 0.15 * F.least(c("volume_ratio"), F.lit(3.0)))
    confidence = F.least(F.lit(0.9), 0.45 + 0.15 * c("volume_ratio"))
    return choose(
        [
            (c("close") > c("prior_high_20"), (strength, confidence, "Price closed above the 20-period range high.")),
            (c("close") < c("prior_low_20"), (-strength, confidence, "Price closed below the 20-period range low.")),
        ],
        (0.0, 0.35, "Price remains inside the 20-period range."),
    )


def _vwap() -> Column:
    distance = F.try_divide(c("close") - c("vwap"), c("vwap"))
    pull = F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.abs(distance) * 16 + F.abs("returns") * 8))
    trust = F.least(F.lit(0.85), 0.35 + pull * 0.5)
    aligned = choose(
        [
            ((distance > 0) & (c("returns") > 0), (pull, trust, "Price is above VWAP with positive short-term momentum.")),
            ((distance < 0) & (c("returns") < 0), (-pull, trust, "Price is below VWAP with negative short-term momentum.")),
        ],
        (0.0, 0.35, "VWAP and momentum are not aligned."),
    )
    return F.when(c("vwap") <= 0, hold("VWAP is unavailable due to missing volume.")).otherwise(aligned)


def _by_sign(score: Column, confidence: Column, positive: str, negative: str, neutral: str) -> Column:
    reason = F.when(score > DIRECTION_THRESHOLD, positive).when(score < -DIRECTION_THRESHOLD, negative)
    return verdict(score, confidence, reason.otherwise(neutral))


def _moving_average() -> Column:
    spread = (c("sma_10") - c("sma_20")) / F.greatest(c("close"), F.lit(1e-9))
    score = clip(spread * 25, -1.0, 1.0)
    return _by_sign(
        score, F.least(F.lit(0.8), 0.35 + F.abs(score) * 0.5),
        "Fast average is above slow average.",
        "Fast average is below slow average.",
        "Moving averages are compressed.",
    )


def _macd() -> Column:
    histogram = c("macd") - c("macd_signal")
    previous = c("prev_macd") - c("prev_macd_signal")
    up = (c("prev_macd") <= c("prev_macd_signal")) & (c("macd") > c("macd_signal"))
    down = (c("prev_macd") >= c("prev_macd_signal")) & (c("macd") < c("macd_signal"))
    relative = F.abs(histogram) / F.greatest(F.abs("macd"), F.lit(1e-6))

    def strength(crossed: Column) -> Column:
        return F.least(F.lit(1.0), relative + F.when(crossed, 0.25).otherwise(0.0))

    def trust(crossed: Column) -> Column:
        return F.least(F.lit(0.9), 0.5 + strength(crossed) * 0.35)

    def reach(crossed: Column) -> Column:
        return F.greatest(F.lit(0.25), strength(crossed))

    return choose(
        [
            (up | ((histogram > 0) & (histogram > previous)),
             (reach(up), trust(up), "MACD is bullish from crossover or rising positive histogram.")),
            (down | ((histogram < 0) & (histogram < previous)),
             (-reach(down), trust(down), "MACD is bearish from crossover or falling negative histogram.")),
        ],
        (0.0, 0.35, "MACD has no clear crossover or histogram momentum."),
    )


def _supertrend() -> Column:
    return choose(
        [
            (c("supertrend_direction") > 0, (0.55, 0.62, "SuperTrend direction is bullish.")),
            (c("supertrend_direction") < 0, (-0.55, 0.62, "SuperTrend direction is bearish.")),
        ],
        (0.0, 0.3, "SuperTrend direction is neutral."),
    )


def _rsi() -> Column:
    low, high = 30 - c("rsi_14"), c("rsi_14") - 70

    def trust(depth: Column) -> Column:
        return F.least(F.lit(0.9), 0.45 + depth / 40)

    return choose(
        [
            (low > 0, (low / 30, trust(low), "RSI is oversold and mean-reversion risk/reward is improving.")),
            (high > 0, (-high / 30, trust(high), "RSI is overbought and reversal risk is elevated.")),
            (c("rsi_14").between(45, 55), (0.0, 0.45, "RSI is between 45 and 55, so reversal edge is neutral.")),
        ],
        (0.0, 0.35, "RSI is in the neutral zone."),
    )


def _bollinger() -> Column:
    width = F.greatest(c("bb_upper") - c("bb_lower"), F.lit(1e-9))

    def reach(outside: Column) -> Column:
        return F.least(F.lit(1.0), outside / width * 4 + 0.35)

    def trust(outside: Column) -> Column:
        return F.least(F.lit(0.85), 0.45 + reach(outside) * 0.4)

    under, over = c("bb_lower") - c("close"), c("close") - c("bb_upper")
    return choose(
        [
            (c("close") < c("bb_lower"), (reach(under), trust(under), "Price is below the lower Bollinger Band.")),
            (c("close") > c("bb_upper"), (-reach(over), trust(over), "Price is above the upper Bollinger Band.")),
        ],
        (0.0, 0.3, "Price is inside Bollinger Bands."),
    )


def _stochastic() -> Column:
    return choose(
        [
            (c("stoch_k") < 20, ((20 - c("stoch_k")) / 20, 0.6, "Stochastic oscillator is oversold.")),
            (c("stoch_k") > 80, (-(c("stoch_k") - 80) / 20, 0.6, "Stochastic oscillator is overbought.")),
        ],
        (0.0, 0.3, "Stochastic oscillator is neutral."),
    )


def _atr_system() -> Column:
    threshold = 0.35 * c("atr_14")

    def reach(distance: Column) -> Column:
        return F.least(F.lit(1.0), distance / F.greatest(c("atr_14"), F.lit(1e-9)))

    def trust(distance: Column) -> Column:
        return F.least(F.lit(0.88), 0.45 + reach(distance) * 0.3)

    above, below = c("close") - c("prior_high_14"), c("prior_low_14") - c("close")
    ranged = choose(
        [
            (c("close") > c("prior_high_14") + threshold,
             (reach(above), trust(above), "Price broke above recent high by an ATR-adjusted threshold.")),
            (c("close") < c("prior_low_14") - threshold,
             (-reach(below), trust(below), "Price broke below recent low by an ATR-adjusted threshold.")),
        ],
        (0.0, 0.35, "No ATR-adjusted breakout is present."),
    )
    unusable = (c("atr_14") <= 0) | (c("close") <= 0)
    return F.when(
        unusable, hold("ATR breakout cannot run because ATR or close is unavailable.")
    ).otherwise(ranged)


def _options() -> Column:
    """Uses ``option_pcr, option_call_oi_change, option_put_oi_change, option_iv`` (NULL pcr = no chain)."""
    call, put = c("option_call_oi_change"), c("option_put_oi_change")
    skew = F.coalesce(F.try_divide(put - call, F.abs(call) + F.abs(put)), F.lit(0.0))
    penalty = F.when(c("option_iv") > 35, -0.15).otherwise(0.0)
    score = clip(0.65 * clip((c("option_pcr") - 1.0) * 1.5, -1.0, 1.0) + 0.35 * skew + penalty, -1.0, 1.0)
    scored = _by_sign(
        score, F.least(F.lit(0.85), 0.45 + F.abs(score) * 0.4),
        "Options chain positioning is bullish.",
        "Options chain positioning is bearish.",
        "Options chain positioning is balanced.",
    )
    return F.when(c("option_pcr").isNull(), hold("Options chain input is unavailable.")).otherwise(scored)


def _zscore() -> Column:
    size = F.least(F.lit(1.0), F.abs("zscore_20") / 3)
    return choose(
        [
            (c("zscore_20") < -1.5, (size, 0.65, "Price is statistically below its rolling mean.")),
            (c("zscore_20") > 1.5, (-size, 0.65, "Price is statistically above its rolling mean.")),
        ],
        (0.0, 0.3, "Z-score is inside the neutral band."),
    )


def _arima() -> Column:
    drift = F.coalesce(clip(F.try_divide(c("return_mean_5"), c("return_std_20")), -1.0, 1.0), F.lit(0.0))
    return verdict(
        drift * 0.35, F.least(F.lit(0.55), 0.25 + F.abs(drift) * 0.2),
        "ARIMA-ready interface emits a conservative return-autocorrelation proxy.",
    )


def _kalman() -> Column:
    gap = (c("close") - c("smooth_price")) / F.greatest(c("close"), F.lit(1e-9))
    score = clip(gap * 30, -1.0, 1.0)
    return verdict(
        score, F.least(F.lit(0.65), 0.3 + F.abs(score) * 0.3),
        "Kalman-ready interface emits a smoothed-state trend proxy.",
    )


def _news(weight: float, text: str) -> Callable[[], Column]:
    """Uses ``news_score, news_confidence, news_label`` (neutral where a symbol has no news)."""

    def build() -> Column:
        label = F.coalesce(c("news_label"), F.lit("neutral"))
        return verdict(
            F.coalesce(c("news_score"), F.lit(0.0)) * weight,
            F.coalesce(c("news_confidence"), F.lit(0.0)) * weight,
            F.format_string(text, label),
        )

    return build


def _xgboost() -> Column:
    def vote(condition: Column) -> Column:
        return F.when(condition, 1.0).otherwise(-1.0)

    blend = (
        0.35 * vote(c("sma_10") > c("sma_20"))
        + 0.25 * vote(c("macd") > c("macd_signal"))
        + 0.20 * vote(c("rsi_14") < 65)
        + 0.20 * clip(c("volume_ratio") - 1.0, -1.0, 1.0)
    )
    return verdict(blend * 0.45, 0.55, "XGBoost-ready interface scored engineered market features.")


def _lstm() -> Column:
    score = clip(c("return_sum_10") / F.greatest(c("return_std_20") * 5, F.lit(1e-9)), -1.0, 1.0) * 0.35
    return verdict(
        score, F.least(F.lit(0.55), 0.3 + F.abs(score)),
        "LSTM-ready interface scored recent return sequence behavior.",
    )


STRATEGIES: tuple[Strategy, ...] = (
    Strategy("Breakout", MOMENTUM, _breakout, 20, "Insufficient candles for 20-period breakout.",
             ("prior_high_20", "prior_low_20", "volume_ratio")),
    Strategy("VWAP", MOMENTUM, _vwap, 2, "Insufficient candles for VWAP.", ("close", "vwap", "returns")),
    Strategy("Moving Average Crossover", MOMENTUM, _moving_average, 20,
             "Insufficient candles for moving-average crossover.", ("sma_10", "sma_20")),
    Strategy("MACD Momentum", MOMENTUM, _macd, 26, "Insufficient candles for MACD.", ("macd", "macd_signal")),
    Strategy("SuperTrend", MOMENTUM, _supertrend, 15, "Insufficient candles for SuperTrend.",
             ("supertrend_direction",)),
    Strategy("RSI Reversal", MEAN_REVERSION, _rsi, 14, "Insufficient candles for RSI.", ("rsi_14",)),
    Strategy("Bollinger Band Reversion", MEAN_REVERSION, _bollinger, 20,
             "Insufficient candles for Bollinger Bands.", ("close", "bb_upper", "bb_lower")),
    Strategy("Stochastic Reversal", MEAN_REVERSION, _stochastic, 14,
             "Insufficient candles for stochastic reversal.", ("stoch_k",)),
    Strategy("ATR Volatility System", VOLATILITY, _atr_system, 15, "Insufficient candles for ATR system.",
             ("atr_14", "prior_high_14", "prior_low_14")),
    Strategy("Options Chain PCR", VOLATILITY, _options,
             inputs=("option_pcr", "option_call_oi_change", "option_put_oi_change", "option_iv")),
    Strategy("Z-Score Mean Reversion", STATISTICAL, _zscore, 20,
             "Insufficient candles for z-score reversion.", ("zscore_20",)),
    Strategy("ARIMA Forecast Interface", STATISTICAL, _arima, 30,
             "Insufficient candles for ARIMA-ready forecast proxy.", ("return_mean_5", "return_std_20")),
    Strategy("Kalman Trend Interface", STATISTICAL, _kalman, 20,
             "Insufficient candles for Kalman-ready trend proxy.", ("smooth_price", "close")),
    Strategy("FinBERT Sentiment", AI_ML, _news(1.0, "Financial-news sentiment is %s."),
             inputs=("news_score", "news_confidence")),
    Strategy("Transformer Sentiment", AI_ML, _news(0.9, "Transformer sentiment layer reports %s bias."),
             inputs=("news_score", "news_confidence")),
    Strategy("XGBoost Interface", AI_ML, _xgboost, 30,
             "Insufficient candles for XGBoost-ready feature scoring.",
             ("sma_10", "sma_20", "macd", "macd_signal", "rsi_14", "volume_ratio")),
    Strategy("LSTM Interface", AI_ML, _lstm, 30, "Insufficient candles for LSTM-ready sequence scoring.",
             ("return_sum_10", "return_std_20")),
)

# Fixed value: strategies run when none are named.
CORE = ("MACD Momentum", "VWAP", "RSI Reversal", "ATR Volatility System", "FinBERT Sentiment")

SENTIMENT_ONLY = "FinBERT Sentiment"


def select_strategies(
    names: Sequence[str] | None = None, custom: Sequence[Strategy] = ()
) -> list[Strategy]:
    """Named strategies (the core set by default); ``custom`` ones are always available."""
    known = {s.name: s for s in (*STRATEGIES, *custom)}
    wanted = list(names) if names else list(CORE)
    unknown = [name for name in wanted if name not in known]
    if unknown:
        raise ValueError(f"Unknown strategy: {', '.join(unknown)}")
    return [known[name] for name in wanted]


def strategy_table(spark) -> DataFrame:
    """Strategy dimension: name and category."""
    return spark.createDataFrame(
        [(s.name, s.category, s.name in CORE) for s in STRATEGIES],
        "strategy_name string, category string, core boolean",
    )


CONTEXT_COLUMNS = {
    "news_score": "double", "news_confidence": "double", "news_label": "string",
    "option_pcr": "double", "option_call_oi_change": "double",
    "option_put_oi_change": "double", "option_iv": "double",
}


def with_context_defaults(features: DataFrame) -> DataFrame:
    """Add the news and options inputs as NULL where the caller joined none."""
    missing = {n: F.lit(None).cast(t) for n, t in CONTEXT_COLUMNS.items() if n not in features.columns}
    return features.withColumns(missing) if missing else features


def with_signals(
    features: DataFrame,
    names: Sequence[str] | None = None,
    custom: Sequence[Strategy] = (),
    directional_only: bool = False,
) -> DataFrame:
    """Add ``signals``: the chosen strategies' signals of each bar (one entry per strategy).

    ``directional_only`` keeps just name, label and confidence of BUY and SELL signals.
    """
    chosen = select_strategies(names, custom)

    def light(s: Strategy) -> Column:
        return let(bounded_verdict(s), lambda v: F.when(F.abs(v["score"]) > DIRECTION_THRESHOLD, F.struct(
            F.lit(s.name).alias("strategy_name"), label(v["score"]).alias("signal"),
            clip(v["confidence"], 0.0, 1.0).alias("confidence"))))

    df = with_context_defaults(features)
    if directional_only:
        return df.withColumn("signals", F.array_compact(F.array(*[light(s) for s in chosen])))
    return df.withColumn("signals", F.array(*[signal(s) for s in chosen]))


def signal_rows(
    features: DataFrame, names: Sequence[str] | None = None, custom: Sequence[Strategy] = (), *keep: str
) -> DataFrame:
    """One row per (bar, strategy). ``keep`` lists extra bar columns to carry along."""
    return with_signals(features, names, custom).select("symbol", "ts", "pos", *keep, F.inline("signals"))


def run_config(signals: DataFrame, config: DataFrame) -> DataFrame:
    """Keep the signals a ``(config, strategy_name, weight)`` table asks for, with their weight."""
    return signals.join(config, "strategy_name")


def config_issues(spark, config: DataFrame, cap: float) -> DataFrame:
    """Problems of custom strategy mixes: unknown names and weights above ``cap``."""
    known = strategy_table(spark).select("strategy_name", F.lit(True).alias("known"))
    issue = (
        F.when(c("known").isNull(), F.format_string("Unknown strategies: %s", c("strategy_name")))
        .when(c("weight") > cap, F.format_string(
            f"%s weight %.2f exceeds max allowed {cap:.2f}", c("strategy_name"), c("weight")))
    )
    return (
        config.join(known, "strategy_name", "left")
        .withColumn("issue", issue).where(c("issue").isNotNull()).drop("known")
    )
