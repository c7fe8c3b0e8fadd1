"""Registered queries: one callable (spark, sf_dir) -> DataFrame per name."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import tables as t
from quantloom.functions import sentiment as sen
from quantloom.functions import text as tx
from quantloom.operators import (
    anomalies, backtest, candles, ensemble, features as feat, memory, news, options_chain, quality, regimes,
    risk, strategies, weighting,
)
from quantloom.operators.blocks import owned
from quantloom.plans import frames
from quantloom.settings import DEFAULT
from quantloom.sources import bars as bar_source
from quantloom.sources import events as event_source
from quantloom.sources import html, sinks

c = F.col
BLOCKS = DEFAULT.blocks
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ALL_STRATEGIES = [s.name for s in strategies.STRATEGIES]
PRICE_STRATEGIES = [s.name for s in strategies.STRATEGIES if not s.name.endswith("Sentiment") and s.name != "Options Chain PCR"]


def as_of() -> Column:
    return F.lit("2001-11-05 00:10:00").cast("timestamp")


def events_as_of() -> Column:
    return F.lit("2024-01-30 12:00:00").cast("timestamp")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, keys: list[str], digits: dict[int, list[str]]) -> DataFrame:
    """Keys plus rounded numbers; adding 0.0 turns -0.0 into 0.0."""
    numbers = [(F.round(c(n).cast("double"), d) + F.lit(0.0)).alias(n) for d, names in digits.items() for n in names]
    return df.select(*keys, *numbers)


def text_list(name: str) -> Column:
    return F.array_join(c(name), "|").alias(name)


# ---- candles -------------------------------------------------------------------------

CANDLE = ["symbol", "ts", "open", "high", "low", "close", "volume"]


@query
def candles_1m(spark, sf_dir):
    return candles.candles(t.ticks(spark, sf_dir), "1m").select(*CANDLE)


@query
def candles_5m(spark, sf_dir):
    return candles.candles(t.ticks(spark, sf_dir), "5m").select(*CANDLE)


@query
def candles_15m(spark, sf_dir):
    return candles.candles(t.ticks(spark, sf_dir), "15m").select(*CANDLE)


@query
def candle_rollup(spark, sf_dir):
    fine = candles.candles(t.ticks(spark, sf_dir), "1m")
    return candles.roll_up(candles.roll_up(fine, "5m"), "15m").select(*CANDLE)


@query
def latest_candles(spark, sf_dir):
    """The last 100 candles per symbol."""
    from quantloom.operators.blocks import index_rows, time_slice

    indexed = index_rows(candles.candles(t.ticks(spark, sf_dir), "1m").select(*CANDLE), ["symbol"], ["ts"], time_slice("ts", 86400))
    return regimes.last_n(indexed, 100, "symbol").select(*CANDLE)


@query
def daily_bars(spark, sf_dir):
    return t.daily_bars(spark, sf_dir).select("symbol", "ts", "open", "high", "low", "close", "volume")


# ---- features ------------------------------------------------------------------------

KEY = ["symbol", "ts"]


def blocked(spark, sf_dir) -> DataFrame:
    return feat.returns(frames.blocked_bars(t.staged_bars(spark, sf_dir)))


@query
def features_returns(spark, sf_dir):
    names = ["return_1", "return_3", "return_5", "return_10", "return_20"]
    df = blocked(spark, sf_dir).withColumns({n: feat.change("close", int(n[7:])) for n in names})
    return rounded(owned(df), KEY, {5: ["returns", *names]})


@query
def features_volatility(spark, sf_dir):
    df = owned(feat.volatility(blocked(spark, sf_dir)))
    return rounded(df, KEY, {2: ["atr_14"], 4: [
        "realized_vol_10", "realized_vol_20", "bb_width", "volatility_percentile", "volatility_regime_score",
        "high_low_range_pct", "range_expansion", "gap_pct", "gap_up", "gap_down"]})


@query
def features_moving_averages(spark, sf_dir):
    df = feat.ema_columns(blocked(spark, sf_dir), {"smooth_price": ("close", 0.25)}, BLOCKS)
    df = feat.macd(df, BLOCKS)
    df = df.withColumns({"sma_20": F.avg("close").over(feat.tail(20)), "sma_50": F.avg("close").over(feat.tail(50)),
                         "ema_slope_12": feat.change("ema_12", 5)})
    return rounded(owned(df), KEY, {2: ["ema_12", "ema_26", "macd", "macd_signal", "macd_histogram", "smooth_price",
                                        "sma_20", "sma_50"], 4: ["ema_slope_12"]})


@query
def features_oscillators(spark, sf_dir):
    df = feat.adx(feat.rsi(feat.volatility(blocked(spark, sf_dir))))
    return rounded(owned(df), KEY, {4: ["rsi_14", "adx_14"]})


@query
def features_momentum(spark, sf_dir):
    """Slopes and distances of the price from its means and its last highs and lows."""
    df = feat.momentum(feat.volatility(blocked(spark, sf_dir)), BLOCKS)
    return rounded(owned(df), KEY, {4: ["sma_slope_20", "distance_from_sma20", "breakout_distance", "breakdown_distance", "roc_10"]})


@query
def features_vwap(spark, sf_dir):
    df = feat.vwap(blocked(spark, sf_dir))
    df = df.withColumn("distance_from_vwap", F.try_divide(c("close") - c("vwap"), c("vwap")))
    return rounded(owned(df), KEY, {2: ["vwap"], 4: ["distance_from_vwap"]})


@query
def features_trading(spark, sf_dir):
    df = frames.trading_frame(t.staged_bars(spark, sf_dir))
    return rounded(df, [*KEY, "donchian_high_20", "donchian_low_20"], {
        2: ["sma_10", "atr_14", "bb_upper", "bb_lower", "volume_sma_20"],
        4: ["atr_pct", "stoch_k", "zscore_20", "volume_ratio", "supertrend_direction", "drawdown_60"]})


def context(spark, sf_dir) -> dict[str, DataFrame]:
    bars = t.staged_bars(spark, sf_dir).withColumn("sector", F.substring("symbol", 1, 1))
    return {
        "bars": bars, "news_daily": news.daily_sentiment(t.scored_documents(spark, sf_dir)),
        "options_daily": t.option_days(spark, sf_dir), "benchmark": t.benchmark_series(bars),
        "sector": t.sector_series(bars)}


def full_stages(spark, sf_dir) -> DataFrame:
    return frames.adaptive_stages(**context(spark, sf_dir), sector_keys=["sector"])


@query
def features_sentiment(spark, sf_dir):
    x = context(spark, sf_dir)
    df = frames.fill_numeric(frames.adaptive_stages(x["bars"], x["news_daily"]))
    return rounded(df, KEY, {4: [
        "rolling_sentiment_mean", "rolling_sentiment_volatility", "sentiment_momentum", "bullish_headline_count",
        "bearish_headline_count", "sentiment_price_divergence", "sentiment_shock_score", "sector_sentiment",
        "neutral_count"]})


@query
def features_options(spark, sf_dir):
    x = context(spark, sf_dir)
    df = frames.fill_numeric(frames.adaptive_stages(x["bars"], None, x["options_daily"]))
    return rounded(df, KEY, {4: [
        "pcr", "pcr_trend", "iv", "iv_trend", "iv_spike", "max_pain_distance", "unusual_oi_activity",
        "options_volume_imbalance", "put_call_oi_change_ratio", "oi_imbalance"]})


@query
def features_correlation(spark, sf_dir):
    x = context(spark, sf_dir)
    df = frames.fill_numeric(frames.adaptive_stages(
        x["bars"], benchmark=x["benchmark"], sector=x["sector"], sector_keys=["sector"]))
    return rounded(df, KEY, {4: [
        "benchmark_returns", "benchmark_correlation", "sector_correlation", "relative_strength", "sector_strength",
        "rolling_beta", "correlation_breakdown"]})


@query
def features_regime_and_anomaly(spark, sf_dir):
    df = frames.fill_numeric(full_stages(spark, sf_dir))
    return rounded(df, KEY, {4: [
        "trend_strength", "liquidity_score", "breadth_score", "market_stress_score", "risk_on_score", "risk_off_score",
        "unusual_volume_score", "price_volume_divergence", "options_anomaly_score", "volatility_shock_score",
        "fake_breakout_probability", "liquidity_breakdown_score"]})


@query
def feature_vector_latest(spark, sf_dir):
    df = frames.feature_vector(frames.fill_numeric(full_stages(spark, sf_dir)))
    return rounded(df, ["symbol", "ts", "timeframe"], {
        2: ["macd", "macd_signal", "macd_histogram", "atr"],
        4: [n for n in frames.VECTOR_FIELDS if n not in ("macd", "macd_signal", "macd_histogram", "atr")]})


@query
def feature_records(spark, sf_dir):
    """Wide features as store records with version and freshness, then the latest value of each."""
    df = owned(feat.rsi(blocked(spark, sf_dir)))
    records = memory.feature_records(df, ["rsi_14", "returns"], as_of())
    return rounded(records, ["symbol", "ts", "feature_name", "feature_version", "freshness_status"], {4: ["feature_value"]})


@query
def feature_store_latest(spark, sf_dir):
    df = owned(feat.rsi(blocked(spark, sf_dir)))
    latest = memory.latest_features(memory.feature_records(df, ["rsi_14", "returns"], as_of()))
    return rounded(latest, ["symbol", "ts", "feature_name"], {4: ["feature_value"]})


@query
def feature_quality_report(spark, sf_dir):
    stages = frames.adaptive_stages(t.staged_bars(spark, sf_dir))
    report = quality.feature_quality(stages, as_of())
    return report.select("symbol", "ts", "rows", "stale_inputs", "enough_history", text_list("missing_features"), text_list("warnings"))


# ---- strategies, ensemble, risk, back-test -----------------------------------------------


def latest_context(spark, sf_dir, frame: DataFrame) -> DataFrame:
    """News and options inputs joined to the frame by symbol."""
    scores = news.scored_sentiment(t.scored_documents(spark, sf_dir))
    chain = regimes.latest_rows(options_chain.summarize_chain(
        options_chain.parse_chain(t.chain_payloads(spark, sf_dir)), skip_zero=True), "symbol").select(
        "symbol", c("pcr").alias("option_pcr"), c("call_oi_change").alias("option_call_oi_change"),
        c("put_oi_change").alias("option_put_oi_change"), c("iv").alias("option_iv"))
    return frame.join(scores.drop("news_ts"), "symbol", "left").join(chain, "symbol", "left")


@query
def strategy_signals_price(spark, sf_dir):
    df = strategies.signal_rows(frames.trading_frame(t.staged_bars(spark, sf_dir)), PRICE_STRATEGIES)
    return rounded(df, [*KEY, "strategy_name", "category", "signal", "reason"], {4: ["score", "confidence"]})


@query
def strategy_signals_context(spark, sf_dir):
    latest = regimes.latest_rows(frames.trading_frame(t.staged_bars(spark, sf_dir)), "symbol")
    frame = latest_context(spark, sf_dir, latest)  # today's news and chain say nothing about earlier bars
    df = strategies.signal_rows(frame, ["FinBERT Sentiment", "Transformer Sentiment", "Options Chain PCR"])
    return rounded(df, [*KEY, "strategy_name", "signal", "reason"], {4: ["score", "confidence"]})


@query
def trading_regimes(spark, sf_dir):
    df = regimes.trading_regime(frames.trading_frame(t.staged_bars(spark, sf_dir)), DEFAULT.trading)
    return rounded(df, [*KEY, "regime"], {4: ["regime_confidence"]})


def voted(spark, sf_dir) -> DataFrame:
    frame = frames.trading_frame(t.staged_bars(spark, sf_dir))
    df = regimes.trading_regime(strategies.with_signals(frame), DEFAULT.trading)
    s = DEFAULT.trading
    return ensemble.vote(ensemble.weighted(df, s.max_strategy_weight, s.weight_floor))


@query
def ensemble_votes(spark, sf_dir):
    df = voted(spark, sf_dir)
    return rounded(df, [*KEY, "regime", "confidence", "suggested_action"], {
        4: ["bullish_probability", "bearish_probability", "neutral_probability"]})


@query
def ensemble_weights(spark, sf_dir):
    df = voted(spark, sf_dir).select(*KEY, F.inline("strategy_breakdown"))
    return rounded(df, [*KEY, "strategy_name"], {4: ["raw_weight", "contribution"]})


@query
def ensemble_texts(spark, sf_dir):
    df = voted(spark, sf_dir)
    return df.select(*KEY, ensemble.ensemble_text(c("signals"), c("regime"), c("regime_confidence")).alias("explanation"))


@query
def risk_decisions(spark, sf_dir):
    # entry_price is the close at two places; on exact halves the last bit of a mean decides, so the distance is checked
    df = risk.evaluate(voted(spark, sf_dir), DEFAULT.trading).withColumns({
        "reason": F.regexp_replace("risk_reason", "[0-9.]+%?", "#"), "entry_at_close": F.abs(c("entry_price") - c("close")) < 0.00500001,
        "entry_in_cents": F.abs(c("entry_price") * 100 - F.round(c("entry_price") * 100)) < 1e-6})
    return rounded(df, [*KEY, "risk_level", "final_action", "approved", "override_applied", "reason", "entry_at_close", "entry_in_cents"], {
        1: ["capital_at_risk"], 2: ["stop_loss", "target", "position_size"], 3: ["risk_reward_ratio"]})


@query
def risk_gate(spark, sf_dir):
    df = risk.evaluate(voted(spark, sf_dir), DEFAULT.trading).withColumns({
        "stale_data": F.year("ts") < 1996, "high_anomaly": c("volume_ratio") >= 2.5,
        "drawdown_breach": F.abs("drawdown_60") >= 0.15})
    return rounded(risk.gate(df), [*KEY, "gate_action", "gate_approved", "gate_risk_level", "gate_reason"], {
        2: ["gate_position_size", "gate_stop_loss", "gate_target"]})


def decided_latest(spark, sf_dir) -> DataFrame:
    """Latest unified signal per symbol: features, regime, signals, weights, vote and risk."""
    frame = regimes.latest_rows(frames.trading_frame(t.staged_bars(spark, sf_dir)), "symbol")
    frame = latest_context(spark, sf_dir, frame)
    df = regimes.trading_regime(strategies.with_signals(frame), DEFAULT.trading)
    s = DEFAULT.trading
    df = ensemble.vote(ensemble.weighted(df, s.max_strategy_weight, s.weight_floor))
    return risk.evaluate(df, s, as_of())


@query
def final_signals(spark, sf_dir):
    df = decided_latest(spark, sf_dir)
    return rounded(df, [*KEY, "regime", "suggested_action", "final_action", "risk_level"], {
        4: ["bullish_probability", "bearish_probability"]})


@query
def final_signal_texts(spark, sf_dir):
    return risk.final_text(decided_latest(spark, sf_dir)).select(*KEY, "final_explanation")


@query
def accuracy_weighted_votes(spark, sf_dir):
    """Votes whose weights use each strategy's own accuracy in the regime of the bar."""
    frame = t.stage(regimes.trading_regime(frames.trading_frame(t.staged_bars(spark, sf_dir)), DEFAULT.trading))
    records = backtest.accuracy_by_regime(backtest.trades(frame, strategies.CORE, (), "regime"))
    df = strategies.with_signals(frame).join(ensemble.accuracy_maps(records), ["symbol", "regime"], "left")
    s = DEFAULT.trading
    df = ensemble.vote(ensemble.weighted(df, s.max_strategy_weight, s.weight_floor, accuracy="accuracy_map"))
    return rounded(df, [*KEY, "confidence", "suggested_action"], {4: ["bullish_probability", "bearish_probability"]})


@query
def strategy_mixes(spark, sf_dir):
    """Signals of two custom mixes with the weights they carry."""
    config = spark.createDataFrame(
        [("trend", "Breakout", 0.4), ("trend", "SuperTrend", 0.3), ("revert", "RSI Reversal", 0.45), ("revert", "Breakout", 0.1)],
        "config string, strategy_name string, weight double")
    frame = frames.trading_frame(t.staged_bars(spark, sf_dir))
    df = strategies.run_config(strategies.signal_rows(frame, ["Breakout", "SuperTrend", "RSI Reversal"]), config)
    return df.select(*KEY, "config", "strategy_name", "signal", "weight")


@query
def backtest_results(spark, sf_dir):
    bars = t.staged_bars(spark, sf_dir)
    trades = t.stage(backtest.trades(frames.trading_frame(bars), PRICE_STRATEGIES))
    df = backtest.summary(trades, bars, PRICE_STRATEGIES)
    return rounded(df, ["strategy_name", "symbol", "start_date", "end_date", "total_trades", "only_gains"], {
        4: ["win_rate", "profit_factor", "return_std"], 6: ["average_return"]})


@query
def backtest_drawdown(spark, sf_dir):
    """Worst fall of the equity curve: itself where it is bounded (above -1000), and its order of magnitude."""
    bars = t.staged_bars(spark, sf_dir)
    trades = t.stage(backtest.trades(frames.trading_frame(bars), PRICE_STRATEGIES))
    df = backtest.summary(trades, bars, PRICE_STRATEGIES)
    df = df.withColumns({"log_drawdown": F.log10(1 - c("max_drawdown")), "drawdown": F.when(c("max_drawdown") > -1000, c("max_drawdown"))})
    return rounded(df, ["strategy_name", "symbol"], {3: ["log_drawdown", "drawdown"]})


@query
def accuracy_by_regime(spark, sf_dir):
    bars = t.staged_bars(spark, sf_dir)
    frame = regimes.trading_regime(frames.trading_frame(bars), DEFAULT.trading)
    df = backtest.accuracy_by_regime(backtest.trades(frame, PRICE_STRATEGIES, (), "regime"))
    return rounded(df, ["strategy_name", "symbol", "regime", "sample_size"], {4: ["accuracy"], 6: ["avg_return"]})


@query
def train_test_cut(spark, sf_dir):
    df = backtest.train_test_cut(owned(frames.blocked_bars(t.staged_bars(spark, sf_dir))), 0.7)
    return df.select(*KEY, "part")


@query
def walk_forward_folds(spark, sf_dir):
    return backtest.walk_forward_folds(owned(frames.blocked_bars(t.staged_bars(spark, sf_dir))), 3).select(*KEY, "fold", "role")


@query
def rule_regimes(spark, sf_dir):
    df = regimes.rule_regime(frames.fill_numeric(full_stages(spark, sf_dir)), DEFAULT.adaptive)
    return rounded(df, [*KEY, "regime", "explanation"], {4: ["confidence"]})


@query
def live_regimes(spark, sf_dir):
    stages = frames.adaptive_stages(t.staged_bars(spark, sf_dir))
    report = quality.feature_quality(stages, as_of())
    df = regimes.live_regime(frames.fill_numeric(stages), report, DEFAULT.adaptive)
    return rounded(df, ["symbol", "ts", "regime"], {4: ["atr_percentile"]})


def anomaly_rows(spark, sf_dir) -> DataFrame:
    hits = [*anomalies.score_hits(), *anomalies.divergence_hits(), *anomalies.fake_breakout_hits()]
    rows = anomalies.anomaly_rows(frames.fill_numeric(full_stages(spark, sf_dir)), hits)
    return rows.withColumn("detector", F.lit(0))


@query
def anomaly_events(spark, sf_dir):
    df = anomalies.best_per_type(anomaly_rows(spark, sf_dir))
    return rounded(df, [*KEY, "anomaly_type", "severity", "explanation"], {4: ["score"]})


@query
def anomaly_risk_levels(spark, sf_dir):
    return anomalies.risk_from_severity(anomaly_rows(spark, sf_dir), "symbol", "ts")


@query
def trading_anomalies(spark, sf_dir):
    latest = regimes.latest_rows(frames.trading_frame(t.staged_bars(spark, sf_dir)), "symbol")
    df = anomalies.anomaly_rows(latest_context(spark, sf_dir, latest), anomalies.trading_hits())
    return rounded(df, [*KEY, "anomaly_type", "severity"], {2: ["score"]})


def settled_outcomes(frame: DataFrame) -> DataFrame:
    """Three simple strategies on every bar, settled at the next one: follow the last return, oppose it, follow a large one."""
    following = Window.partitionBy("symbol").orderBy("ts")  # daily bars of one symbol
    closed = frame.select("symbol", "regime", "returns", F.lead("ts").over(following).alias("ts"), (F.lead("close").over(following) / c("close") - 1).alias("gain"))
    sides = F.create_map(
        F.lit("MACD Momentum"), F.sign("returns"), F.lit("RSI Reversal"), -F.sign("returns"),
        F.lit("Breakout"), F.when(F.abs("returns") > 0.02, F.sign("returns")))
    return closed.select("symbol", "regime", "ts", "gain", F.explode(sides).alias("strategy_name", "side")).select(
        "symbol", "regime", "ts", "strategy_name", (c("side") * c("gain")).alias("realized"))


def weighted_bars(spark, sf_dir) -> DataFrame:
    """Bars with rule regime, base weights and what the strategies had settled by then."""
    frame = t.stage(regimes.rule_regime(frames.fill_numeric(full_stages(spark, sf_dir)), DEFAULT.adaptive).select(
        *KEY, "close", "returns", "regime", "confidence", "rolling_sentiment_mean", "volatility_percentile", "volatility_shock_score"))
    base = F.create_map(*[F.lit(x) for pair in (("MACD Momentum", 0.4), ("RSI Reversal", 0.3), ("ATR Volatility System", 0.2),
                                                ("Breakout", 0.1), ("Risk Parity", 0.3)) for x in pair])
    bars = frame.select(
        *KEY, "regime", c("confidence").alias("regime_confidence"), c("rolling_sentiment_mean").alias("sentiment_score"),
        c("volatility_percentile").alias("volatility_score"), base.alias("base_weights"),
        F.when(c("volatility_shock_score") >= 3, "HIGH").otherwise("LOW").alias("risk_level"),
        (c("volatility_shock_score") >= 3).alias("severe_anomaly"))
    return weighting.performance_as_of(bars, settled_outcomes(frame), F.date_trunc("year", "ts"))


@query
def adaptive_strategy_weights(spark, sf_dir):
    """Adaptive weights per (symbol, bar) from the rule regime, settled outcomes, news and the bar's anomalies."""
    df = weighting.adaptive_weights(weighted_bars(spark, sf_dir), DEFAULT.adaptive)
    long = df.select(*KEY, "reason", "weight_confidence", F.explode("weights").alias("strategy_name", "weight"))
    return rounded(long, [*KEY, "strategy_name", "reason"], {4: ["weight", "weight_confidence"]})


@query
def settled_performance(spark, sf_dir):
    """The records that adaptive weights rest on, as of every bar."""
    rows = weighted_bars(spark, sf_dir).select(*KEY, "regime", F.explode("performance").alias("strategy_name", "p"))
    return rounded(rows.select(*KEY, "regime", "strategy_name", "p.*"), [*KEY, "regime", "strategy_name", "sample_size"], {4: ["accuracy", "avg_return", "max_drawdown"]})


@query
def training_targets(spark, sf_dir):
    from quantloom.operators import training

    df = training.targets(frames.blocked_bars(t.staged_bars(spark, sf_dir)), BLOCKS, horizon=5)
    return df.select(*KEY, "directional", "regime_target", "suitability")


# ---- options ---------------------------------------------------------------------------

CHAIN = {4: ["pcr", "call_oi", "put_oi", "call_oi_change", "put_oi_change", "iv", "max_pain"]}


@query
def options_rollup(spark, sf_dir):
    rows = options_chain.parse_chain(t.chain_payloads(spark, sf_dir))
    return rounded(options_chain.summarize_chain(rows), KEY, CHAIN)


@query
def options_rollup_signal(spark, sf_dir):
    rows = options_chain.parse_chain(t.chain_payloads(spark, sf_dir))
    return rounded(options_chain.summarize_chain(rows, skip_zero=True), KEY, CHAIN)


# ---- news --------------------------------------------------------------------------------


@query
def news_articles(spark, sf_dir):
    return news.normalize_articles(t.raw_articles(spark, sf_dir)).select(
        "id", "url", "url_hash", "content_hash", "semantic_hash", text_list("tags"), "language", F.length("title").alias("title_len"))


@query
def news_exact_dedupe(spark, sf_dir):
    return news.first_seen(news.normalize_articles(t.raw_articles(spark, sf_dir))).select("id", "source", "url_hash")


@query
def news_lexical_sentiment(spark, sf_dir):
    return t.scored_documents(spark, sf_dir).select("doc_id", "symbol", "sentiment", "confidence", "sentiment_score")


@query
def news_event_types(spark, sf_dir):
    words = (("first", "with|der"), ("second", "les|que"), ("third", "para"))
    return t.table(spark, sf_dir, "documents").select("doc_id", sen.event_type(c("text"), words).alias("event_type"))


@query
def news_daily_sentiment(spark, sf_dir):
    df = news.daily_sentiment(t.scored_documents(spark, sf_dir))
    return rounded(df, ["symbol", "day", "sentiment_count", "bullish_count", "bearish_count"], {4: ["sentiment_score", "sector_sentiment"]})


@query
def news_symbol_sentiment(spark, sf_dir):
    docs = t.scored_documents(spark, sf_dir)
    a = news.model_sentiment(docs).select("symbol", c("sentiment_score").alias("model_score"), "sentiment", "confidence", "count")
    b = news.scored_sentiment(docs).select("symbol", "news_score", "news_label", "news_confidence")
    g = news.gateway_sentiment(docs).select("symbol", c("sentiment_score").alias("gateway_score"))
    return rounded(a.join(b, "symbol").join(g, "symbol"), ["symbol", "sentiment", "news_label", "count"], {
        4: ["model_score", "confidence", "news_score", "news_confidence", "gateway_score"]})


@query
def news_latest(spark, sf_dir):
    docs = t.scored_documents(spark, sf_dir).select(
        c("doc_id").alias("id"), F.split("text", "\n")[0].alias("title"), F.lit(None).cast("string").alias("summary"),
        c("text").alias("content"), F.lit(None).cast("timestamp").alias("published_at"), c("ts").alias("scraped_at"))
    return news.latest_news(docs, "Tion", 20).select("id", "scraped_at")


@query
def news_matching_or_all(spark, sf_dir):
    """Articles whose title names a word, and the whole list for a word no title has."""
    docs = t.table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n")[0].alias("title"))
    found = news.matching_or_all(docs, "Der").select("doc_id", F.lit("der").alias("word"))
    return found.unionByName(news.matching_or_all(docs, "QQQQ").select("doc_id", F.lit("qqqq").alias("word")))


@query
def news_pending(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    items = docs.select(c("doc_id").alias("id"), t.doc_ts().alias("scraped_at"), F.lit(None).cast("timestamp").alias("published_at"),
                        F.lit(False).alias("semantic_duplicate"))
    return news.pending_embeddings(items, t.table(spark, sf_dir, "embeddings").select(c("vec_id").alias("id")), 50)


@query
def news_enriched(spark, sf_dir):
    docs = t.scored_documents(spark, sf_dir)
    items = docs.select("doc_id", c("text").alias("title"))
    outputs = docs.select("text", "sentiment", "confidence", "seq")
    return news.enrich(items, outputs).select("doc_id", "sentiment", "sentiment_score")


@query
def news_merge(spark, sf_dir):
    """Two article lists merged by url (by title where the url is '#'), whole lists."""
    docs = news.normalize_articles(t.raw_articles(spark, sf_dir)).select("id", "title", "url", c("id").alias("rank"))
    local = docs.withColumn("url", F.when(c("id") % 3 == 0, "#").otherwise(c("url")))
    return news.merge_news(local, docs).select("id", "url")


@query
def news_stored_duplicates(spark, sf_dir):
    """Documents in German or Spanish against the stored rest."""
    docs = news.normalize_articles(t.raw_articles(spark, sf_dir))
    batch, stored = docs.where(c("language").isin("de", "es")), docs.where(~c("language").isin("de", "es"))
    return news.new_articles(batch, stored).select("id", "duplicate_reason")


@query
def html_links(spark, sf_dir):
    return html.page_links(t.table(spark, sf_dir, "pages")).select(
        "page_id", "position", "href", "title", tx.absolutize_url(c("base_url"), c("href")).alias("link"),
        tx.is_article_url(tx.absolutize_url(c("base_url"), c("href"))).alias("is_article"))


@query
def html_urls(spark, sf_dir):
    return t.table(spark, sf_dir, "pages").select(
        "page_id", tx.normalize_url(c("url")).alias("url"), tx.source_name(c("url")).alias("source"),
        tx.is_article_url(c("url")).alias("is_article"), tx.hash_url(c("url")).alias("url_hash"))


@query
def html_headlines(spark, sf_dir):
    """Links of headline length into news, market or story pages (the test pages' links have other paths, so titles count)."""
    return html.page_links(t.table(spark, sf_dir, "pages")).select(
        "page_id", "position", tx.is_headline_link(F.concat(c("href"), F.lit(".html")), F.repeat("title", 4)).alias("headline"))


@query
def html_candidates(spark, sf_dir):
    """Article links of every page, one per url, in order of their first place (site links moved under /news/)."""
    moved = F.replace("html", F.lit('href="/'), F.lit('href="/news/'))
    pages = t.table(spark, sf_dir, "pages").withColumn("html", moved)
    return html.article_candidates(pages, min_title=2).select("page", "url", "position", "title", "rank")


@query
def news_valid(spark, sf_dir):
    return news.valid_articles(news.normalize_articles(t.raw_articles(spark, sf_dir))).select("id")


@query
def news_embedding_texts(spark, sf_dir):
    """Whole normalised texts given to an embedding model, as hashes."""
    docs = news.normalize_articles(t.raw_articles(spark, sf_dir))
    return docs.select("id", tx.sha(tx.embedding_text(c("title"), c("summary"), c("content"))).alias("digest"), "semantic_hash")


@query
def parsed_dates(spark, sf_dir):
    """Event times written in four layouts and read back."""
    ts = c("ts").cast("timestamp")
    layouts = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "d MMM yyyy HH:mm:ss")
    text = F.element_at(F.array(*[F.date_format(ts, layout) for layout in layouts]), (c("event_id") % 4 + 1).cast("int"))
    return t.table(spark, sf_dir, "events").select("event_id", tx.parse_datetime(text).alias("ts"))


@query
def bar_files(spark, sf_dir):
    """Bars written as CSV files with two header spellings and column orders, then read as one path."""
    from quantloom.streaming.flows import new_folder

    folder, bars = new_folder(spark, "bars"), t.daily_bars(spark, sf_dir)
    day = F.date_format("ts", "yyyy-MM-dd")
    one = bars.where("symbol < 'N'").select("symbol", day.alias("date"), "open", "high", "low", "close", "volume")
    two = bars.where("symbol >= 'N'").select(c("close").alias("Close"), c("symbol"), c("low").alias("Low"), day.alias("Date"), c("high").alias("High"), c("open").alias("Open"), c("volume").alias("Volume"))
    for part in (one, two):
        part.write.mode("append").option("header", True).csv(folder)
    return bar_source.read_csv(spark, folder, "none").select("symbol", "ts", "source", "open", "high", "low", "close", "volume")


@query
def preliminary_risk(spark, sf_dir):
    frame = frames.trading_frame(t.staged_bars(spark, sf_dir))
    return frame.select(*KEY, risk.preliminary_level(c("atr_pct"), DEFAULT.trading).alias("level"))


@query
def html_articles(spark, sf_dir):
    return html.extract_articles(t.table(spark, sf_dir, "pages")).select("page_id", "title", "summary", "content", "language")


@query
def html_titles(spark, sf_dir):
    """Titles and languages of the parsed pages, by an independent pattern in SQL."""
    return html.extract_articles(t.table(spark, sf_dir, "pages")).select("page_id", "title", "language")


# ---- events, quality, memory ---------------------------------------------------------------


@query
def quality_events(spark, sf_dir):
    df = quality.check_events(t.envelopes(spark, sf_dir), events_as_of())
    return rounded(df.withColumn("issues", F.array_join("issues", "|")), ["event_id", "event_type", "issues", "quality_status"], {4: ["source_reliability_score"]})


@query
def quality_bar_rules(spark, sf_dir):
    """Valid bars, impossible prices and extreme moves of the ticks, in arrival order of each candle."""
    df = blocked(spark, sf_dir)
    df = df.withColumns({"valid": quality.valid_bar(), "impossible": quality.impossible_price(c("close")),
                         "extreme": F.coalesce(quality.extreme_return(c("close"), c("prev_close")), F.lit(False))})
    return owned(df).select(*KEY, "valid", "impossible", "extreme")


@query
def quality_missing_and_fresh(spark, sf_dir):
    df = t.envelopes(spark, sf_dir).withColumn("symbol", F.when(c("seq") % 5 != 0, c("symbol")).otherwise(""))
    return df.select(
        "event_id", F.array_join(quality.missing_fields(["symbol", "payload", "correlation_id"]), "|").alias("missing"),
        quality.is_stale(c("ts"), events_as_of(), 3600).alias("stale"), quality.freshness(c("ts"), events_as_of()).alias("freshness"))


@query
def event_dead_letters(spark, sf_dir):
    checked = quality.check_events(t.envelopes(spark, sf_dir), events_as_of())
    failed = checked.where(c("quality_status") == "FAIL")
    df = event_source.dead_letters(failed, c("event_type"), F.array_join("issues", "; "), F.lit(False))
    back = F.from_json("original_event", "event_id string, source string, symbol string, payload string")
    return df.select("event_id", "event_type", "correlation_id", "original_topic", "error", "retryable", "ts", back["source"].alias("source"),
                     back["symbol"].alias("symbol"), F.concat(F.lit("dead-"), back["event_id"]).alias("original_id"))


@query
def event_round_trip(spark, sf_dir):
    sent = event_source.serialize(t.envelopes(spark, sf_dir))
    back = event_source.parse_envelopes(sent)
    return back.select("event_id", "event_type", "source", "ts", "symbol", "correlation_id", "error")


@query
def source_reliability(spark, sf_dir):
    from quantloom.operators.blocks import index_rows

    checked = quality.check_events(t.envelopes(spark, sf_dir), events_as_of()).select(
        "source", "seq", (c("quality_status") != "FAIL").alias("passed"))
    ranked = index_rows(checked, ["source"], ["seq"], F.floor(c("seq") / 100_000))
    return rounded(quality.clamp_walk(ranked), ["source", "seq", "passed"], {4: ["score_before", "score_after"]})


@query
def lifecycle_states(spark, sf_dir):
    df = memory.lifecycle(t.lifecycle_events(spark, sf_dir))
    return df.select("correlation_id", "state", text_list("completed"), text_list("missing"), "ready", "events", "error")


@query
def lifecycle_counts(spark, sf_dir):
    return memory.state_counts(t.lifecycle_events(spark, sf_dir))


@query
def rewards(spark, sf_dir):
    df = t.feedback(spark, sf_dir).withColumn("reward", memory.reward())
    return rounded(df, ["seq", "strategy_name"], {5: ["reward"]})


@query
def bandit_scores(spark, sf_dir):
    df = memory.bandit_scores(t.feedback(spark, sf_dir).withColumn("reward", memory.reward()))
    return rounded(df, ["strategy_name", "n"], {5: ["mean_reward", "score"]})


@query
def recent_win_ratio(spark, sf_dir):
    return rounded(memory.recent_win_ratio(t.outcomes(spark, sf_dir), 100), ["strategy_name"], {4: ["win_ratio"]})


def performance(spark, sf_dir) -> DataFrame:
    return t.outcomes(spark, sf_dir).where("result != 'PENDING'").groupBy("strategy_name", "symbol", "regime").agg(
        F.round(F.avg((c("result") == "WIN").cast("double")), 6).alias("accuracy"), F.round(F.avg("pnl"), 6).alias("avg_return"),
        F.count(F.lit(1)).alias("sample_size"), F.max("seq").alias("seq"))


@query
def best_strategy_by_regime(spark, sf_dir):
    df = memory.best_by_regime(performance(spark, sf_dir), "accuracy", "avg_return", "sample_size")
    return rounded(df, ["regime", "strategy_name", "sample_size"], {4: ["accuracy"]})


@query
def memory_lookup(spark, sf_dir):
    df = memory.lookup(performance(spark, sf_dir), symbol="U3", regime="Trending")
    return rounded(df, ["strategy_name", "symbol", "regime", "sample_size"], {4: ["accuracy"]})


@query
def sentiment_accuracy(spark, sf_dir):
    docs = t.scored_documents(spark, sf_dir).join(t.table(spark, sf_dir, "labels"), "doc_id")
    df = docs.withColumn("accurate", ((c("sentiment") == "bullish") & (c("quality") == 1)) | ((c("sentiment") != "bullish") & (c("quality") == 0)))
    return rounded(memory.sentiment_accuracy(df, "symbol"), ["symbol"], {4: ["accuracy"]})


def judged(spark, sf_dir) -> DataFrame:
    docs = t.scored_documents(spark, sf_dir).join(t.table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("symbol", F.when(c("quality") == 1, "bullish").otherwise("bearish").alias("label"), c("sentiment").alias("prediction"))


@query
def classification_report(spark, sf_dir):
    return rounded(memory.classification_report(judged(spark, sf_dir), "symbol"), ["symbol"], {4: ["accuracy", "precision_macro", "recall_macro", "f1_macro"]})


@query
def confusion_matrix(spark, sf_dir):
    return memory.confusion(judged(spark, sf_dir))


@query
def latency_report(spark, sf_dir):
    df = memory.latency_report(t.table(spark, sf_dir, "events").select(c("event_type").alias("name"), "value"))
    return rounded(df, ["name", "count"], {3: ["total", "avg_seconds"]})


@query
def candle_upsert(spark, sf_dir):
    """5m candles of the first days replaced by a later build of the same candles."""
    ticks = t.ticks(spark, sf_dir)
    old = candles.candles(ticks.where(c("seq") % 2 == 0), "5m").select(*CANDLE)
    return sinks.upsert(old, candles.candles(ticks, "5m").select(*CANDLE), ["symbol", "ts"]).select(*CANDLE)


@query
def candle_partition_upsert(spark, sf_dir):
    """5m candles by day; the days of odd sequence numbers in January are built again and replaced as partitions."""
    from quantloom.streaming.flows import new_folder

    ticks, path = t.ticks(spark, sf_dir), new_folder(spark, "candle-table")
    by_day = lambda rows: candles.candles(rows, "5m").select(*CANDLE).withColumn("day", F.to_date("ts"))
    sinks.upsert_partitions(by_day(ticks.where(c("seq") % 2 == 0)), path, ["symbol", "ts"], "day")
    sinks.upsert_partitions(by_day(ticks.where(F.dayofmonth("ts") % 2 == 1)), path, ["symbol", "ts"], "day")
    return spark.read.parquet(path).select(*CANDLE)


def model_versions(spark, sf_dir) -> DataFrame:
    events = t.table(spark, sf_dir, "events")
    return events.select(
        F.concat(F.lit("m"), (c("user_id") % 40).cast("string")).alias("model_name"), c("event_id").alias("model_version"),
        c("ts").cast("timestamp").alias("created_at"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("accuracy"),
        F.when(c("event_type") == "purchase", c("ts").cast("timestamp")).alias("activated_at"))


@query
def model_registry(spark, sf_dir):
    v = model_versions(spark, sf_dir)
    return memory.active_models(v).join(memory.rollback_target(v), "model_name", "left")


@query
def retraining_due(spark, sf_dir):
    v = model_versions(spark, sf_dir)
    return v.select("model_name", "model_version", memory.should_retrain(v, events_as_of()).alias("retrain"))


@query
def quotes_as_bars(spark, sf_dir):
    """Event rows as quote payloads, with 0 standing for a missing price."""
    k = F.get_json_object("props", "$.k").cast("int")
    payload = F.to_json(F.struct(
        F.struct(
            F.when(k % 7 == 0, 0.0).otherwise(c("value")).alias("lastPrice"), (c("value") + 1).alias("close"),
            F.when(k % 5 == 0, 0.0).otherwise(c("value") - 0.5).alias("open"),
            F.struct(F.when(k % 3 != 0, c("value") + 2).alias("max"), (c("value") - 2).alias("min")).alias("intraDayHighLow")
        ).alias("priceInfo"),
        F.struct(F.when(k % 2 == 0, k.cast("double")).alias("totalTradedVolume")).alias("preOpenMarket")))
    quotes = t.table(spark, sf_dir, "events").select(c("event_type").alias("symbol"), c("ts").cast("timestamp").alias("ts"), payload.alias("payload"))
    return bar_source.quotes_to_bars(quotes)


# ---- vectors, models, streams -----------------------------------------------------------------


def vectors_of(spark, sf_dir) -> DataFrame:
    return t.table(spark, sf_dir, "embeddings").select(c("vec_id").alias("id"), "embedding")


@query
def vector_top5(spark, sf_dir):
    """Every vector against all vectors (its own included), five best each."""
    from quantloom.operators import vectors

    v = vectors_of(spark, sf_dir)
    return rounded(vectors.top_k(v, v, 5), ["id", "match", "rank"], {6: ["similarity"]})


@query
def vector_top3_scaled(spark, sf_dir):
    """The same vectors at other lengths: the cosine does not see the difference."""
    from quantloom.operators import vectors

    v = vectors_of(spark, sf_dir)
    scaled = v.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * (c("id") % 5 + 1)))
    return rounded(vectors.top_k(scaled, scaled, 3), ["id", "match", "rank"], {6: ["similarity"]})


@query
def vector_dedupe(spark, sf_dir):
    from quantloom.operators import vectors

    return vectors.greedy_distinct(vectors_of(spark, sf_dir), 0.4).select("id")


@query
def vector_duplicate_matches(spark, sf_dir):
    from quantloom.operators import vectors

    v = vectors_of(spark, sf_dir)
    return rounded(vectors.duplicate_matches(v, vectors.greedy_distinct(v, 0.4), 0.4), ["id", "matched_id"], {6: ["similarity"]})


MODEL_FEATURES = ["return_1", "return_5", "realized_vol_20", "bb_width", "rsi_14", "adx_14", "liquidity_score", "trend_strength"]


def labelled_frame(spark, sf_dir) -> DataFrame:
    from quantloom.operators import training

    df = feat.regime_scores(feat.momentum(feat.volatility(blocked(spark, sf_dir)), BLOCKS).withColumn("rolling_sentiment_mean", F.lit(0.0)))
    df = df.withColumns({"directional": training.directional(5), "regime_target": training.regime_target()})
    return t.stage(frames.fill_numeric(owned(df)).select("symbol", "ts", "pos", "directional", "regime_target", *MODEL_FEATURES))


@query
def model_walk_forward(spark, sf_dir):
    """Random forest on directional targets, three expanding folds: macro metrics."""
    from quantloom.operators import training

    predictions, _ = training.walk_forward(labelled_frame(spark, sf_dir), MODEL_FEATURES, "directional", 3)
    return training.evaluate(predictions)


@query
def model_store_scores(spark, sf_dir):
    """A forest is trained, saved, registered, loaded as the active version and scores all rows: facts per symbol."""
    from quantloom.operators import training
    from quantloom.operators.model_store import ModelStore
    from quantloom.streaming.flows import new_folder

    data = labelled_frame(spark, sf_dir).where("directional is not null")
    store, at, made = ModelStore(spark, new_folder(spark, "models")), datetime(2024, 1, 1), {}

    def train():
        predictions, model = training.walk_forward(data, MODEL_FEATURES, "directional", 2, trees=8, depth=4)
        made["direct"] = model.transform(data).select("symbol", "ts", c("predicted").alias("direct"))
        report = training.evaluate(predictions).first()
        return model, "directional", MODEL_FEATURES, {"accuracy": report.accuracy, "f1_macro": report.f1_macro}

    first, second = [store.retrain_if_due("directional", train, at, min_accuracy=0.0) for _ in range(2)]
    scored = store.score(data, "directional").join(made["direct"], ["symbol", "ts"])
    return scored.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.bool_and(c("prediction").isin("up", "down", "sideways")).alias("known"),
        F.bool_and(c("prediction") == c("direct")).alias("same_after_load"), F.max("model_version").alias("model_version"),
        F.lit(first == 1 and second is None).alias("trained_once"))


@query
def model_regime_clusters(spark, sf_dir):
    from quantloom.operators import training

    return training.cluster_regimes(labelled_frame(spark, sf_dir), MODEL_FEATURES).groupBy("cluster").count()


@query
def isolation_anomalies(spark, sf_dir):
    from quantloom.operators import isolation

    frame = frames.fill_numeric(frames.adaptive_stages(t.staged_bars(spark, sf_dir)))
    return isolation.detect(t.stage(frame.select("symbol", "block", "pos", "ts", *isolation.COLUMNS)))


@query
def isolation_summary(spark, sf_dir):
    """Facts of the forest that do not hang on its random cuts: rows scored, share flagged, severities."""
    from quantloom.operators import isolation

    frame = frames.fill_numeric(frames.adaptive_stages(t.staged_bars(spark, sf_dir)))
    scored = t.stage(isolation.scores(t.stage(frame.select("symbol", "block", "pos", "ts", *isolation.COLUMNS))))
    hits = isolation.flagged(scored).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("hits"), F.bool_and((c("score") > 0.15) == (c("severity") == "HIGH")).alias("severity_fits"))
    rows = scored.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.bool_and(c("raw").between(0, 1)).alias("bounded"))
    return rows.join(hits, "symbol").select(
        "symbol", "rows", "bounded", "severity_fits", (F.abs(c("hits") / c("rows") - isolation.CONTAMINATION) < 0.01).alias("share_fits"))


def stream_of(spark, sf_dir, name: str) -> DataFrame:
    batch = t.table(spark, sf_dir, name)
    return spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/{name}.parquet")


def as_stream(df: DataFrame, parts: int = 3) -> DataFrame:
    """Write a DataFrame to the shared folder in ``parts`` of rising ``seq`` and read a part per trigger.

    A part has four files, or one per core where it is large. Its rows are taken from the staged table by bounds of
    seq, which spare row groups that hold none of them, and dealt by hash, which needs no sort.
    """
    from quantloom.streaming.flows import new_folder

    folder, rows = new_folder(df.sparkSession, "input"), t.stage(df)
    ends = rows.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count("seq").alias("n")).first()
    lo, span = ends["lo"] or 0, (ends["hi"] or 0) - (ends["lo"] or 0) + 1
    files = max(4, min(df.sparkSession.sparkContext.defaultParallelism, ends["n"] // parts // 5000))
    cuts = [lo - (-i * span // parts) for i in range(parts + 1)]
    for i in range(parts):  # one after the other, so that files arrive in sequence order
        part = rows.where((c("seq") >= cuts[i]) & (c("seq") < cuts[i + 1]))
        part.repartition(files, "seq").write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


@query
def stream_candles_5m(spark, sf_dir):
    from quantloom.streaming import flows

    return flows.stream_candles(as_stream(t.ticks(spark, sf_dir)), "5m").select(*CANDLE)


@query
def stream_event_routing(spark, sf_dir):
    from quantloom.streaming import flows

    clean, dead = flows.route_events(as_stream(t.envelopes(spark, sf_dir)), events_as_of())
    both = clean.withColumn("side", F.lit("clean")).unionByName(dead.withColumn("side", F.lit("dead")))
    return both.groupBy("event_type", "side", "quality_status").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_source_reliability(spark, sf_dir):
    from quantloom.streaming import flows

    checked = quality.check_events(t.envelopes(spark, sf_dir), events_as_of()).select(
        "source", "seq", (c("quality_status") != "FAIL").alias("passed"))
    return rounded(flows.stream_reliability(as_stream(checked)), ["source", "seq", "passed"], {4: ["score_before", "score_after"]})


@query
def stream_news_table(spark, sf_dir):
    from quantloom.streaming import flows

    articles = news.normalize_articles(t.raw_articles(spark, sf_dir)).withColumn("seq", c("id"))
    return flows.stream_news_dedupe(as_stream(articles), flows.new_folder(spark, "news-table")).select("id", "source", "url_hash")


@query
def stream_vector_table(spark, sf_dir):
    from quantloom.streaming import flows

    v = vectors_of(spark, sf_dir).withColumn("seq", c("id"))
    return flows.stream_vector_dedupe(as_stream(v, 2).drop("seq"), flows.new_folder(spark, "vector-table"), 0.4).select("id")


@query
def stream_lifecycle_states(spark, sf_dir):
    from quantloom.streaming import flows

    df = flows.stream_lifecycle(as_stream(t.lifecycle_events(spark, sf_dir)))
    return df.select("correlation_id", "state", text_list("completed"), text_list("missing"), "ready", "events", "error")


@query
def live_lifecycle_states(spark, sf_dir):
    """Sessions of every correlation id, kept as state with a timer: half a day without an event ends one."""
    from quantloom.streaming import flows

    sessions, _ = flows.live_lifecycle(as_stream(t.lifecycle_events(spark, sf_dir)), "12 hours")
    return sessions.select("correlation_id", "first_ts", "last_ts", "state", "completed", "events", "error")


@query
def stream_bandit_scores(spark, sf_dir):
    from quantloom.streaming import flows

    return rounded(flows.stream_bandit(as_stream(t.feedback(spark, sf_dir))), ["strategy_name", "n"], {5: ["mean_reward", "score"]})


@query
def stream_correlated_events(spark, sf_dir):
    """News and bar events of one correlation id at most an hour apart, joined as streams."""
    from quantloom.streaming import flows

    events = t.envelopes(spark, sf_dir)
    raw = as_stream(events.where("event_type = 'news.raw'"), 1)
    bars = as_stream(events.where("event_type = 'market.ohlcv.raw'"), 1)
    folder = flows.new_folder(spark, "correlated")
    flows.run_once(flows.correlated(raw, bars), flows.versioned_sink(folder), folder)
    return spark.read.parquet(f"{folder}/data").select("correlation_id", "raw_ts", "ts")
