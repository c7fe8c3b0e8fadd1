"""Adaptive strategy weights per symbol from regime, performance, risk and sentiment.

Weights travel as MAP<strategy, weight> on the row; a request holds few strategies, so
all steps are map and array expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.safe import array_sum, let
from quantloom.session import stage
from quantloom.settings import AdaptiveSettings

c = F.col

# Name tokens of the strategy groups.
TREND_TOKENS = "momentum|breakout|vwap|macd"
REVERSION_TOKENS = "rsi|reversion|bollinger"
GUARD_TOKENS = "volatility|atr|sentiment|risk"
EXPOSED_TOKENS = "normal|trend|breakout"

UPTREND = ("TRENDING", "BULLISH_REGIME", "RISK_ON")
STRESS = ("PANIC", "RISK_OFF", "HIGH_VOLATILITY")


def cap_and_normalize(weights: Column, cap: float) -> Column:
    """Clip each weight to [0, cap], then scale to 1; equal shares when nothing is left.

    Scaling after the cap can lift a weight above it again; that is intended.
    """
    return _share(F.transform_values(weights, lambda k, w: F.least(F.greatest(w, F.lit(0.0)), F.lit(cap))))


def _share(weights: Column) -> Column:
    """Scale to 1. ``weights`` is bound once: nested uses would repeat the whole chain before it."""
    def scale(ws: Column) -> Column:
        return let(array_sum(F.map_values(ws)), lambda total: F.transform_values(
            ws, lambda k, w: F.when(total > 0, w / total).otherwise(1.0 / F.size(ws))))

    return let(weights, scale)


def _factor(name: Column, tokens: str, value: float) -> Column:
    return F.when(F.lower(name).rlike(tokens), value).otherwise(1.0)


def regime_rules(weights: Column, regime: Column) -> Column:
    def factor(name: Column) -> Column:
        up = _factor(name, TREND_TOKENS, 1.25) * _factor(name, REVERSION_TOKENS, 0.8)
        flat = _factor(name, REVERSION_TOKENS, 1.25) * _factor(name, "breakout", 0.75)
        stress = _factor(name, GUARD_TOKENS, 1.2) * _factor(name, EXPOSED_TOKENS, 0.75)
        return (
            F.when(regime.isin(*UPTREND), up).when(regime == "SIDEWAYS", flat)
            .when(regime.isin(*STRESS), stress).otherwise(1.0)
        )

    return F.transform_values(weights, lambda k, w: w * factor(k))


def performance_rules(weights: Column, performance: Column) -> Column:
    """``performance`` is MAP<strategy, STRUCT<accuracy, avg_return, max_drawdown, sample_size>>."""

    def adjusted(name: Column, w: Column) -> Column:
        p = F.element_at(performance, name)
        care = F.greatest(F.lit(0.3), 1.0 + p["avg_return"] - F.abs(p["max_drawdown"]))
        known = F.coalesce(p["sample_size"] >= 10, F.lit(False))
        return F.when(known, w * (0.6 + p["accuracy"]) * care).otherwise(w)

    return F.transform_values(weights, adjusted)


PERFORMANCE = "map<string,struct<accuracy:double,avg_return:double,max_drawdown:double,sample_size:bigint>>"


def performance_as_of(bars: DataFrame, outcomes: DataFrame, slice_of: Column) -> DataFrame:
    """``bars`` (symbol, ts, regime, base_weights, ...) with ``performance``: what each weighted strategy had settled by then.

    ``outcomes`` are (symbol, strategy_name, regime, ts, realized), ts being the time of settlement and regime that of the
    entry; those of the bar's regime or of "unknown" count. A record holds the share of gains, the mean, the worst
    single outcome (0 at best) and the number of outcomes settled at ``ts`` or before, so no weight sees the future.

    Time is cut into slices (``slice_of``, over ``ts``). Totals per slice run forward as one row per (symbol, regime, strategy,
    slice); only inside a slice are bars and outcomes sorted together. No partition holds more than a slice of one key.
    """
    keys = ["symbol", "strategy_name", "regime"]
    settled = outcomes.where(c("realized").isNotNull() & c("ts").isNotNull()).select(
        *keys, "ts", slice_of.alias("_slice"), F.lit(1).cast("bigint").alias("n"), (c("realized") > 0).cast("bigint").alias("wins"),
        c("realized").alias("total"), F.least(c("realized"), F.lit(0.0)).alias("worst"))
    either = F.array_distinct(F.array(c("regime"), F.lit("unknown")))
    asking = stage(bars.select("symbol", "ts", c("regime").alias("_now"), slice_of.alias("_slice"), F.explode(F.map_keys("base_weights")).alias("strategy_name"), either.alias("_either"))
                   .select("symbol", "ts", "_now", "_slice", "strategy_name", F.explode("_either").alias("regime")))
    sums = [F.sum("n").alias("n"), F.sum("wins").alias("wins"), F.sum("total").alias("total"), F.min("worst").alias("worst")]
    whole = settled.groupBy(*keys, "_slice").agg(*sums)
    every = asking.select(*keys, "_slice").distinct().join(whole, [*keys, "_slice"], "full")
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = every.select(*keys, "_slice", F.sum("n").over(earlier).alias("_n"), F.sum("wins").over(earlier).alias("_wins"),
                           F.sum("total").over(earlier).alias("_total"), F.min("worst").over(earlier).alias("_worst"))
    both = asking.withColumn("_asks", F.lit(1)).unionByName(settled.withColumn("_asks", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, "_slice").orderBy("ts", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.select(*keys, "ts", "_now", "_slice", "_asks", *[f(n).over(so_far).alias(n) for f, n in ((F.sum, "n"), (F.sum, "wins"), (F.sum, "total"), (F.min, "worst"))])
    known = inside.where("_asks = 1").join(opening, [*keys, "_slice"], "left")
    zero_if = lambda a, b: F.coalesce(c(a), F.lit(0)) + F.coalesce(c(b), F.lit(0))
    summed = known.groupBy("symbol", "ts", "_now", "strategy_name").agg(
        F.sum(zero_if("n", "_n")).alias("n"), F.sum(zero_if("wins", "_wins")).alias("wins"), F.sum(zero_if("total", "_total")).alias("total"),
        F.min(F.least(F.coalesce("worst", F.lit(0.0)), F.coalesce("_worst", F.lit(0.0)))).alias("worst")).where("n > 0")
    record = F.struct((c("wins") / c("n")).alias("accuracy"), (c("total") / c("n")).alias("avg_return"), c("worst").alias("max_drawdown"), c("n").alias("sample_size"))
    # One entry per weighted strategy, so the map is as short as the strategy table.
    maps = summed.groupBy("symbol", "ts", "_now").agg(F.map_from_entries(F.collect_list(F.struct("strategy_name", record))).alias("performance"))
    found = maps.select(c("symbol").alias("_symbol"), c("ts").alias("_ts"), "_now", "performance")
    at = (c("symbol") == c("_symbol")) & (c("ts") == c("_ts")) & (c("regime") == c("_now"))
    return bars.drop("performance").join(found, at, "left").drop("_symbol", "_ts", "_now")


def adaptive_weights(df: DataFrame, s: AdaptiveSettings) -> DataFrame:
    """Add ``weights, reason, weight_confidence``.

    Needs base_weights, regime, regime_confidence, sentiment_score, volatility_score,
    risk_level, severe_anomaly (boolean) and performance (map or NULL).
    """
    cap = s.max_strategy_weight
    df = df.withColumn("weights", cap_and_normalize(c("base_weights"), cap))
    df = df.withColumn("weights", regime_rules(c("weights"), c("regime")))
    df = df.withColumn("weights", performance_rules(c("weights"), c("performance")))
    risky = F.upper("risk_level") == "HIGH"
    df = df.withColumn("weights", F.transform_values("weights", lambda k, w: w * F.when(
        risky, F.when(F.lower(k).rlike("risk|volatility"), 1.15).otherwise(0.9)).otherwise(1.0)))
    df = df.withColumn("weights", cap_and_normalize(c("weights"), cap))

    supportive = (
        c("regime").isin("TRENDING", "BULLISH_REGIME") & (c("sentiment_score") > 0.1) & (c("volatility_score") < 0.75)
    )
    flat = c("regime") == "SIDEWAYS"
    stressed = c("regime").isin("PANIC", "RISK_OFF") | c("severe_anomaly")
    advised = F.transform_values("weights", lambda k, w: (
        w
        * F.when(supportive, _factor(k, TREND_TOKENS, 1.15)).otherwise(1.0)
        * F.when(flat, _factor(k, REVERSION_TOKENS, 1.15)).otherwise(1.0)
        * F.when(stressed, _factor(k, GUARD_TOKENS, 1.2) * _factor(k, "breakout|momentum", 0.75)).otherwise(1.0)
    ))
    reasons = F.concat_ws(
        ". ",
        F.when(supportive, "momentum strategies increased because regime is trending, sentiment is supportive, "
                           "and volatility is not extreme"),
        F.when(flat, "mean-reversion strategies increased because market is classified as sideways"),
        F.when(stressed, "risk-control and volatility-aware strategies increased because stress or "
                         "high-severity anomalies are present"),
    )
    unchanged = "Weights preserved because no strong adaptive adjustment condition was triggered."
    confidence = 0.45 + c("regime_confidence") * 0.35 + F.least(F.abs("sentiment_score"), F.lit(0.5)) * 0.2
    df = df.withColumns({
        "weights": _share(advised),
        "reason": F.when(reasons != "", reasons).otherwise(unchanged),
        "weight_confidence": F.least(F.lit(0.9), confidence),
    })
    return df.withColumn("weights", cap_and_normalize(c("weights"), cap))
