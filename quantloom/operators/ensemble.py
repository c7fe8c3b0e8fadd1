"""Strategy weights, the ensemble vote and its texts.

A bar carries its signals as an array with one entry per strategy, so weighting and
voting are array expressions on the row: no shuffle, no matter how many symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.safe import array_sum, clip, let
from quantloom.operators.strategies import (
    AI_ML, MEAN_REVERSION, MOMENTUM, SENTIMENT_ONLY, STATISTICAL, VOLATILITY,
)

c = F.col

# Base weight per strategy; others get DEFAULT_WEIGHT.
BASE_WEIGHTS = {
    "MACD Momentum": 0.25,
    "VWAP": 0.20,
    "RSI Reversal": 0.20,
    "ATR Volatility System": 0.15,
    "FinBERT Sentiment": 0.20,
}
DEFAULT_WEIGHT = 0.10

# Weight multipliers by regime and strategy category.
REGIME_MULTIPLIERS = {
    "trending": {MOMENTUM: 1.35, MEAN_REVERSION: 0.75},
    "bullish": {MOMENTUM: 1.35, MEAN_REVERSION: 0.75},
    "bearish": {MOMENTUM: 1.35, MEAN_REVERSION: 0.75},
    "sideways": {MEAN_REVERSION: 1.4, MOMENTUM: 0.75},
    "high_volatility": {VOLATILITY: 1.45, MOMENTUM: 0.9},
    "panic": {VOLATILITY: 1.25, AI_ML: 0.85, MOMENTUM: 0.7, MEAN_REVERSION: 0.65},
}

# Advisory tilts by regime and strategy family.
FAMILY_TILTS = {
    "trending": {"momentum": 1.15, "mean_reversion": 0.9},
    "bullish": {"momentum": 1.15, "mean_reversion": 0.9},
    "bearish": {"momentum": 1.15, "mean_reversion": 0.9},
    "sideways": {"mean_reversion": 1.15, "momentum": 0.9},
    "panic": {"volatility": 1.1, "ai_ml": 0.95, "momentum": 0.85},
}

ROUNDS = 8


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def water_fill(weights: Column, cap: float, floor: float) -> Column:
    """Scale an array of weights to sum to 1 with each entry kept within [floor, cap].

    Mass above the cap moves to the entries below it, for at most ``ROUNDS`` rounds; the
    first round without an entry above the cap ends it. With so many entries that the
    floor alone would fill the whole, no floor applies.
    """
    return let(weights, lambda ws: _water_fill(ws, cap, floor))


def _water_fill(weights: Column, cap: float, floor: float) -> Column:
    count = F.size(weights).cast("double")
    even = F.transform(weights, lambda w: 1.0 / count)
    low = F.when(count * floor < 1.0, floor).otherwise(0.0)

    def state(values: Column, low: Column, done: Column) -> Column:
        return F.struct(values.alias("w"), low.alias("low"), done.alias("done"))

    def bound(total: Column) -> Column:
        shares = F.when(total > 0, F.transform(weights, lambda w: F.greatest(w, F.lit(0.0)) / total)).otherwise(even)
        return F.transform(shares, lambda w: F.least(F.greatest(w, low), F.lit(cap)))

    positive = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + F.greatest(w, F.lit(0.0)))
    start = state(let(positive, bound), low, F.lit(False))

    def spread(ws: Column, low: Column) -> Column:
        """One round on weights that sum to 1 and have an entry above the cap."""
        room = F.greatest(F.lit(0.0), 1.0 - F.size(F.filter(ws, lambda w: w > cap)) * cap)
        below = F.aggregate(ws, F.lit(0.0), lambda acc, w: acc + F.when(w <= cap, w).otherwise(0.0))
        return let(F.struct(room.alias("room"), below.alias("below")), lambda s: F.transform(
            ws,
            lambda w: F.when(w > cap, F.lit(cap)).otherwise(F.greatest(
                low, w / F.when(s["below"] == 0, F.lit(1.0)).otherwise(s["below"]) * s["room"])),
        ))

    def one_round(acc: Column, _: Column) -> Column:
        def scaled(ws: Column) -> Column:
            over = F.exists(ws, lambda w: w > cap)
            settled = F.transform(ws, lambda w: F.greatest(w, acc["low"]))
            return state(F.when(over, spread(ws, acc["low"])).otherwise(settled), acc["low"], ~over)

        # Weights are never negative here and sum to 0 only when all of them are 0.
        return F.when(acc["done"], acc).otherwise(let(array_sum(acc["w"]), lambda total: F.when(
            total > 0, let(F.transform(acc["w"], lambda w: w / total), scaled),
        ).otherwise(state(F.transform(acc["w"], lambda w: 1.0 / F.size(acc["w"])), acc["low"], F.lit(True)))))

    def close(acc: Column) -> Column:
        """After the last round: cap once more and share the remainder evenly."""
        def capped(total: Column) -> Column:
            return F.transform(acc["w"], lambda w: F.least(
                w / F.when(total == 0, F.lit(1.0)).otherwise(total), F.lit(cap)))

        def add_rest(vs: Column) -> Column:
            facts = F.struct(
                (1.0 - array_sum(vs)).alias("rest"), F.size(F.filter(vs, lambda v: v < cap)).alias("takers"))
            return let(facts, lambda s: F.transform(vs, lambda v: F.when(
                (v < cap) & (s["rest"] > 0), F.least(F.lit(cap), v + s["rest"] / s["takers"])).otherwise(v)))

        return let(let(array_sum(acc["w"]), capped), add_rest)

    steps = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.aggregate(steps, start, one_round, lambda acc: F.when(acc["done"], acc["w"]).otherwise(close(acc)))


def base_weights(signals: Column, custom: Column | None = None) -> Column:
    """Unscaled base weight of each signal; ``custom`` (name -> weight) wins where present."""
    table = _map(BASE_WEIGHTS)

    def weight(s: Column) -> Column:
        usual = F.coalesce(F.element_at(table, s["strategy_name"]), F.lit(DEFAULT_WEIGHT))
        if custom is None:
            return usual
        chosen = F.element_at(custom, s["strategy_name"])
        return F.coalesce(F.when(chosen.isNotNull(), F.greatest(chosen, F.lit(0.0))), usual)

    return F.transform(signals, weight)


def regime_factor(regime: Column, category: Column) -> Column:
    table = F.create_map(*[
        x for label, factors in REGIME_MULTIPLIERS.items() for x in (F.lit(label), _map(factors))
    ])
    return F.coalesce(F.element_at(F.element_at(table, regime), category), F.lit(1.0))


def accuracy_factor(record: Column) -> Column:
    """From an (accuracy, sample_size) struct; 1 when absent or below ten samples."""
    usable = F.coalesce(record["sample_size"] >= 10, F.lit(False))
    return F.when(usable, clip(0.75 + record["accuracy"], 0.6, 1.35)).otherwise(1.0)


def accuracy_maps(records: DataFrame) -> DataFrame:
    """Accuracy records as one MAP<strategy, STRUCT<accuracy, sample_size>> per (symbol, regime).

    Upper-cased symbol and lower-cased regime are the keys; records hold one row per
    (strategy, symbol, regime), so a map has at most one entry per strategy.
    """
    entry = F.struct("strategy_name", F.struct("accuracy", "sample_size"))
    return records.groupBy(F.upper("symbol").alias("symbol"), F.lower("regime").alias("regime")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("accuracy_map"))


def weighted(
    df: DataFrame,
    cap: float,
    floor: float,
    custom: str | None = None,
    accuracy: str | None = None,
) -> DataFrame:
    """Add ``weights`` (array aligned with ``signals``) from base, regime, accuracy and confidence.

    ``df`` has ``signals`` and ``regime``; ``custom`` names a MAP<name, weight> column and
    ``accuracy`` a MAP<name, STRUCT<accuracy, sample_size>> column.
    """
    def fit(expression: Column) -> Column:
        return water_fill(expression, cap, floor)

    df = df.withColumn("weights", fit(base_weights(c("signals"), c(custom) if custom else None)))
    df = df.withColumn("weights", fit(F.zip_with(
        "weights", "signals", lambda w, s: w * regime_factor(c("regime"), F.coalesce(s["category"], F.lit(STATISTICAL))))))
    if accuracy:
        df = df.withColumn("weights", fit(F.zip_with(
            "weights", "signals",
            lambda w, s: w * accuracy_factor(F.element_at(c(accuracy), s["strategy_name"])))))
    else:
        df = df.withColumn("weights", fit(c("weights")))
    return df.withColumn("weights", fit(F.zip_with("weights", "signals", lambda w, s: w * (0.5 + s["confidence"]))))


def confidence_label(probability: Column) -> Column:
    return F.when(probability >= 0.7, "HIGH").when(probability >= 0.55, "MODERATE").otherwise("LOW")


def suggested_action(bullish: Column, bearish: Column) -> Column:
    return (
        F.when((bullish >= 0.58) & (bullish - bearish >= 0.12), "BUY")
        .when((bearish >= 0.58) & (bearish - bullish >= 0.12), "SELL")
        .otherwise("HOLD")
    )


def vote(df: DataFrame) -> DataFrame:
    """Turn ``signals`` and ``weights`` into probabilities, an action and a breakdown.

    The whole vote is one struct expression, so a filter on its result that is pushed
    down the plan repeats it once, not once per use.
    """
    lines = F.zip_with("signals", "weights", lambda s, w: F.struct(
        s["strategy_name"].alias("strategy_name"), s["signal"].alias("signal"),
        w.alias("raw_weight"), w.alias("adjusted_weight"),
        s["confidence"].alias("confidence"), s["score"].alias("score"),
        (w * F.greatest(F.lit(0.05), s["confidence"]) * s["score"]).alias("contribution"),
        s["reason"].alias("reason"),
        (w * F.greatest(F.lit(0.05), s["confidence"])).alias("conviction"),
    ))

    def mass(breakdown: Column, side: str, part) -> Column:
        return F.aggregate(breakdown, F.lit(0.0), lambda acc, b: acc + F.when(
            b["signal"] == side, b["conviction"] * part(b)).otherwise(0.0))

    def shares(b: Column) -> Column:
        bull = mass(b, "BUY", lambda x: 0.5 + F.greatest(x["score"], F.lit(0.0)) / 2)
        bear = mass(b, "SELL", lambda x: 0.5 + F.abs(F.least(x["score"], F.lit(0.0))) / 2)
        flat = mass(b, "HOLD", lambda x: F.lit(1.0))
        masses = F.struct(bull.alias("u"), bear.alias("d"), flat.alias("n"), b.alias("b"))

        def normalised(m: Column) -> Column:
            total = m["u"] + m["d"] + m["n"]
            return F.struct(
                F.when(total > 0, m["u"] / total).otherwise(0.0).alias("u"),
                F.when(total > 0, m["d"] / total).otherwise(0.0).alias("d"),
                F.when(total > 0, m["n"] / total).otherwise(1.0).alias("n"),
                m["b"].alias("b"))

        return let(let(masses, normalised), outcome)

    def outcome(p: Column) -> Column:
        return F.struct(
            F.round(p["u"], 4).alias("bullish_probability"),
            F.round(p["d"], 4).alias("bearish_probability"),
            F.round(p["n"], 4).alias("neutral_probability"),
            confidence_label(F.greatest(p["u"], p["d"], p["n"])).alias("confidence"),
            suggested_action(p["u"], p["d"]).alias("suggested_action"),
            F.transform(p["b"], lambda x: x.dropFields("conviction")).alias("strategy_breakdown"),
            F.map_from_entries(F.transform(
                p["b"], lambda x: F.struct(x["strategy_name"], x["raw_weight"]))).alias("weights_used"),
        )

    return df.withColumn("_vote", let(lines, shares)).select(*df.columns, "_vote.*")


def names_with(signals: Column, label: str, limit: int | None = None) -> Column:
    names = F.transform(F.filter(signals, lambda s: s["signal"] == label), lambda s: s["strategy_name"])
    return F.slice(names, 1, limit) if limit else names


def count_with(signals: Column, label: str) -> Column:
    return F.size(F.filter(signals, lambda s: s["signal"] == label))


def sentence(names: Column, text: str) -> Column:
    """``text`` with the joined names, NULL when there are none."""
    return F.when(F.size(names) > 0, F.format_string(text, F.array_join(names, ", ")))


def percent(value: Column) -> Column:
    return F.concat(F.rint(value * 100).cast("int").cast("string"), F.lit("%"))


def ensemble_text(signals: Column, regime: Column, regime_confidence: Column) -> Column:
    """Explanation of the vote; regime parts are left out where the regime is NULL."""
    return F.concat_ws(
        " ",
        F.format_string(
            "Combined market intelligence is based on %d independent engines: %d bullish, %d bearish, and %d neutral.",
            F.size(signals), count_with(signals, "BUY"), count_with(signals, "SELL"), count_with(signals, "HOLD")),
        sentence(names_with(signals, "BUY", 4), "Bullish support comes from %s."),
        sentence(names_with(signals, "SELL", 4), "Bearish pressure comes from %s."),
        F.when(regime.isNotNull(), F.format_string(
            "Regime-aware weighting adjusted the strategy mix for a %s environment.", regime)),
        F.when(regime.isNotNull() & regime_confidence.isNotNull(), F.format_string(
            "Current regime is %s with %s confidence.", regime, percent(regime_confidence))),
    )


def agreement(breakdown: Column, action: Column) -> Column:
    """Strategies other than sentiment that agree with the action."""
    return F.size(F.filter(
        breakdown, lambda b: (b["signal"] == action) & (b["strategy_name"] != SENTIMENT_ONLY)))


def sentiment_only(breakdown: Column, action: Column) -> Column:
    agreeing = F.filter(breakdown, lambda b: b["signal"] == action)
    return (F.size(agreeing) > 0) & F.forall(agreeing, lambda b: b["strategy_name"] == SENTIMENT_ONLY)


def family_tilts(regime: Column) -> Column:
    """Advisory MAP<family, factor> for a regime; {all: 1} where none applies."""
    table = F.create_map(*[x for r, tilt in FAMILY_TILTS.items() for x in (F.lit(r), _map(tilt))])
    return F.coalesce(F.element_at(table, regime), _map({"all": 1.0}))
