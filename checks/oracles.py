"""DuckDB SQL for the registered queries, written independently of the Spark code."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

W = "PARTITION BY symbol ORDER BY ts"


def r(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def mp(agg: str, column: str, n: int, least: int) -> str:
    return f"CASE WHEN count({column}) OVER {r(n)} >= {least} THEN {agg}({column}) OVER {r(n)} END"


def lag(column: str, n: int = 1) -> str:
    return f"lag({column}, {n}) OVER ({W})"


def chg(column: str, n: int) -> str:
    return f"({column} / nullif({lag(column, n)}, 0) - 1)"


def cols(names: list[str], digits: int) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), {digits}) + 0.0 AS {n}" for n in names)


# ---- ticks and candles ---------------------------------------------------------------------

TICKS = """ticks AS (
  SELECT upper(event_type) AS symbol, ts, value AS price, greatest(coalesce(CAST(props->>'$.k' AS DOUBLE), 0), 0) AS vol,
         event_id AS seq FROM events WHERE value > 0)"""


def candle_sql(seconds: int, source: str = "ticks") -> str:
    return f"""
  SELECT symbol, make_timestamp((epoch_us(ts) // 1000000 // {seconds}) * {seconds} * 1000000) AS ts,
         first(price ORDER BY seq) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY seq) AS "close", max(vol) AS volume
  FROM {source} GROUP BY 1, 2"""


for _tf, _sec in (("1m", 60), ("5m", 300), ("15m", 900)):
    ORACLES[f"candles_{_tf}"] = f"WITH {TICKS} {candle_sql(_sec)}"
ORACLES["candle_partition_upsert"] = f"WITH {TICKS}, tk AS (SELECT * FROM ticks WHERE dayofmonth(ts) % 2 = 1 OR seq % 2 = 0) {candle_sql(300, 'tk')}"
ORACLES["candle_rollup"] = ORACLES["candles_15m"]
ORACLES["candle_upsert"] = ORACLES["candles_5m"]
ORACLES["stream_candles_5m"] = ORACLES["candles_5m"]
ORACLES["latest_candles"] = f"""WITH {TICKS}, cd AS ({candle_sql(60)})
SELECT symbol, ts, open, high, low, "close", volume FROM cd
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100"""

# ---- bars and features ---------------------------------------------------------------------

TRADE_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, price"
BARS = f"""trades AS (
  SELECT l_returnflag || l_linestatus AS symbol, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts,
         l_extendedprice / l_quantity AS price, l_quantity, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem),
bars AS (
  SELECT symbol, ts, first(price ORDER BY {TRADE_ORDER}) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY {TRADE_ORDER}) AS "close", sum(l_quantity) AS volume
  FROM trades GROUP BY 1, 2)"""

ORACLES["daily_bars"] = f"""WITH {BARS}
SELECT symbol, ts, open, high, low, "close", volume FROM bars"""

BASE = f"""{BARS},
b0 AS (SELECT *, row_number() OVER ({W}) - 1 AS pos, lag("close") OVER ({W}) AS pc FROM bars),
b1 AS (SELECT *, coalesce("close" / nullif(pc, 0) - 1, 0) AS returns,
         greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low)) AS tr FROM b0)"""

_RET = ["return_1", "return_3", "return_5", "return_10", "return_20"]
ORACLES["features_returns"] = f"""WITH {BASE}, f AS (SELECT *, {', '.join(f'{chg(chr(34) + "close" + chr(34), int(n[7:]))} AS {n}' for n in _RET)} FROM b1)
SELECT symbol, ts, {cols(['returns', *_RET], 5)} FROM f"""

VOL = f"""{BASE},
v0 AS (SELECT *, avg(tr) OVER {r(14)} AS atr_14, {mp('stddev_pop', 'returns', 10, 2)} AS realized_vol_10,
         {mp('stddev_pop', 'returns', 20, 2)} AS realized_vol_20,
         4 * coalesce({mp('stddev_pop', '"close"', 20, 2)}, 0) / nullif("close", 0) AS bb_width,
         (high - low) / nullif("close", 0) AS high_low_range_pct, (open - pc) / nullif(pc, 0) AS gap_pct FROM b1),
v1 AS (SELECT *, array_agg(realized_vol_20) OVER {r(100)} AS vols,
         high_low_range_pct / nullif(avg(high_low_range_pct) OVER {r(20)}, 0) AS range_expansion FROM v0),
v2 AS (SELECT * EXCLUDE (vols), CASE WHEN realized_vol_20 IS NOT NULL AND len(list_filter(vols, lambda x: x IS NOT NULL)) >= 5 THEN
         (len(list_filter(vols, lambda x: x < realized_vol_20)) + (len(list_filter(vols, lambda x: x = realized_vol_20)) + 1) / 2.0)
         / len(list_filter(vols, lambda x: x IS NOT NULL)) END AS volatility_percentile,
         coalesce(atr_14 / nullif("close", 0), 0) AS volatility_regime_score,
         CASE WHEN gap_pct > 0.01 THEN 1 ELSE 0 END AS gap_up, CASE WHEN gap_pct < -0.01 THEN 1 ELSE 0 END AS gap_down FROM v1)"""
ORACLES["features_volatility"] = f"""WITH {VOL}
SELECT symbol, ts, {cols(['atr_14'], 2)}, {cols(['realized_vol_10', 'realized_vol_20', 'bb_width', 'volatility_percentile',
  'volatility_regime_score', 'high_low_range_pct', 'range_expansion', 'gap_pct', 'gap_up', 'gap_down'], 4)} FROM v2"""

# Exponential averages step by step; the price list of a symbol travels with the recursion.
EMA = """px AS (SELECT symbol, list("close" ORDER BY ts) AS p, list(ts ORDER BY ts) AS t FROM bars GROUP BY symbol),
em(symbol, i, e12, e26, sm, sig) AS (
  SELECT symbol, 1, p[1], p[1], p[1], CAST(0 AS DOUBLE) FROM px
  UNION ALL
  SELECT symbol, i + 1, n12, n26, nsm, 0.2 * (n12 - n26) + 0.8 * sig FROM (
    SELECT em.symbol, i, sig, 2.0 / 13 * p[i + 1] + 11.0 / 13 * e12 AS n12, 2.0 / 27 * p[i + 1] + 25.0 / 27 * e26 AS n26,
           0.25 * p[i + 1] + 0.75 * sm AS nsm
    FROM em JOIN px ON em.symbol = px.symbol WHERE i < len(p)) q),
emas AS (SELECT em.symbol, px.t[i] AS ts, CAST(e12 AS DOUBLE) AS ema_12, CAST(e26 AS DOUBLE) AS ema_26, sm AS smooth_price, e12 - e26 AS macd,
           sig AS macd_signal, e12 - e26 - sig AS macd_histogram FROM em JOIN px ON em.symbol = px.symbol)"""
ORACLES["features_moving_averages"] = f"""WITH RECURSIVE {BASE}, {EMA},
f AS (SELECT b1.*, ema_12, ema_26, smooth_price, macd, macd_signal, macd_histogram FROM b1 JOIN emas USING (symbol, ts)),
g AS (SELECT *, avg("close") OVER {r(20)} AS sma_20, avg("close") OVER {r(50)} AS sma_50, {chg('ema_12', 5)} AS ema_slope_12 FROM f)
SELECT symbol, ts, {cols(['ema_12', 'ema_26', 'macd', 'macd_signal', 'macd_histogram', 'smooth_price', 'sma_20', 'sma_50'], 2)},
  {cols(['ema_slope_12'], 4)} FROM g"""

RSI = f"""o0 AS (SELECT *, "close" - pc AS d, high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS dn FROM %s),
o1 AS (SELECT *, avg(CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0 END) OVER {r(14)} AS gain,
         avg(CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0 END) OVER {r(14)} AS loss,
         avg(CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END) OVER {r(14)} AS pdm,
         avg(CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END) OVER {r(14)} AS mdm FROM o0),
o2 AS (SELECT *, coalesce(100 - 100 / (1 + gain / nullif(loss, 0)), 50) AS rsi_14,
         100 * abs(100 * pdm / nullif(atr_14, 0) - 100 * mdm / nullif(atr_14, 0))
           / nullif(100 * pdm / nullif(atr_14, 0) + 100 * mdm / nullif(atr_14, 0), 0) AS dx FROM o1),
osc AS (SELECT *, coalesce(avg(dx) OVER {r(14)}, 0) AS adx_14 FROM o2)"""
ORACLES["features_oscillators"] = f"""WITH {VOL}, {RSI % 'v2'} SELECT symbol, ts, {cols(['rsi_14', 'adx_14'], 4)} FROM osc"""

VWAP = f"""CASE WHEN volume <> 0 THEN sum((high + low + "close") / 3 * volume) OVER ({W}) / nullif(sum(volume) OVER ({W}), 0) END"""
ORACLES["features_vwap"] = f"""WITH {BASE}, f AS (SELECT *, {VWAP} AS vwap FROM b1)
SELECT symbol, ts, {cols(['vwap'], 2)}, round(("close" - vwap) / nullif(vwap, 0), 4) + 0.0 AS distance_from_vwap FROM f"""

ORACLES["features_momentum"] = f"""WITH {BASE}, f AS (SELECT *, avg("close") OVER {r(20)} AS sma_20, max(high) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS top,
  min(low) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS bottom, {chg(chr(34) + 'close' + chr(34), 10)} AS roc_10 FROM b1),
g AS (SELECT *, {chg('sma_20', 5)} AS sma_slope_20, ("close" - sma_20) / nullif(sma_20, 0) AS distance_from_sma20, ("close" - top) / nullif("close", 0) AS breakout_distance,
  (bottom - "close") / nullif("close", 0) AS breakdown_distance FROM f)
SELECT symbol, ts, {cols(['sma_slope_20', 'distance_from_sma20', 'breakout_distance', 'breakdown_distance', 'roc_10'], 4)} FROM g"""

TRADING = f"""{BASE}, {EMA},
t0 AS (SELECT *, avg(tr) OVER {r(14)} AS atr_14, avg(tr) OVER {r(10)} AS atr_10 FROM b1),
{RSI % 't0'},
t1 AS (SELECT osc.* EXCLUDE (d, up, dn, gain, loss, pdm, mdm, dx), ema_12, ema_26, smooth_price, macd, macd_signal,
   avg("close") OVER {r(10)} AS sma_10, avg("close") OVER {r(20)} AS sma_20, avg("close") OVER {r(50)} AS sma_50,
   coalesce(atr_14 / nullif("close", 0), 0) AS atr_pct, {VWAP} AS vwap0,
   stddev_pop("close") OVER {r(20)} AS sd, min(low) OVER {r(14)} AS lo14, max(high) OVER {r(14)} AS hi14,
   avg(volume) OVER {r(20)} AS volume_sma_20, max(high) OVER {r(20)} AS donchian_high_20, min(low) OVER {r(20)} AS donchian_low_20,
   max(high) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS ph20, min(low) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS pl20,
   max(high) OVER ({W} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS ph14, min(low) OVER ({W} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS pl14,
   avg(returns) OVER {r(5)} AS rm5, stddev_pop(returns) OVER {r(20)} AS rs20, sum(returns) OVER {r(10)} AS rs10,
   {chg('"close"', 5)} AS r5, lead("close") OVER ({W}) AS next_close, array_agg("close") OVER {r(60)} AS last60,
   (high + low) / 2 + 3 * atr_10 AS ub, (high + low) / 2 - 3 * atr_10 AS lb
   FROM osc JOIN emas USING (symbol, ts)),
t2 AS (SELECT * EXCLUDE (last60), sma_20 + 2 * coalesce(sd, 0) AS bb_upper, sma_20 - 2 * coalesce(sd, 0) AS bb_lower, coalesce(vwap0, 0) AS vwap,
   coalesce(100 * ("close" - lo14) / nullif(hi14 - lo14, 0), 0) AS stoch_k, coalesce(("close" - sma_20) / nullif(sd, 0), 0) AS zscore_20,
   coalesce(volume / nullif(volume_sma_20, 0), 0) AS volume_ratio,
   lag(macd) OVER ({W}) AS pmacd, lag(macd_signal) OVER ({W}) AS psig,
   CASE WHEN "close" < coalesce(lag(lb) OVER ({W}), lb) THEN -1 WHEN "close" > coalesce(lag(ub) OVER ({W}), ub) THEN 1 END AS dir,
   list_min(list_transform(range(1, len(last60) + 1), lambda j: last60[j] / list_max(last60[1:j]) - 1)) AS drawdown_60 FROM t1),
tf AS (SELECT *, coalesce(last_value(dir IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS supertrend_direction FROM t2)"""
ORACLES["features_trading"] = f"""WITH RECURSIVE {TRADING}
SELECT symbol, ts, donchian_high_20, donchian_low_20, {cols(['sma_10', 'atr_14', 'bb_upper', 'bb_lower', 'volume_sma_20'], 2)},
 {cols(['atr_pct', 'stoch_k', 'zscore_20', 'volume_ratio', 'supertrend_direction', 'drawdown_60'], 4)} FROM tf"""

# ---- news and options context ----------------------------------------------------------------

UP = ("que", "with", "mit ", "por")
DOWN = ("est", "ment", "by ", "und")


def _tokens(words: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words)


DOCS = f"""d0 AS (SELECT *, ({_tokens(UP)}) - ({_tokens(DOWN)}) AS lead FROM documents),
docs AS (SELECT doc_id, ['AF','AO','NF','NO','RF','RO'][doc_id % 6 + 1] AS symbol,
   TIMESTAMP '1995-01-02 09:00:00' + to_days(CAST(doc_id % 2400 AS INT)) AS ts, text, source,
   CASE WHEN lang <> 'en' THEN lang END AS sector,
   CASE WHEN lead > 0 THEN 'bullish' WHEN lead < 0 THEN 'bearish' ELSE 'neutral' END AS sentiment,
   CASE WHEN lead = 0 THEN 0.5 ELSE least(0.75, 0.45 + 0.1 * abs(lead)) END::DOUBLE AS confidence,
   (CASE WHEN lead > 0 THEN 1 WHEN lead < 0 THEN -1 ELSE 0 END * least(0.75, 0.45 + 0.1 * abs(lead)))::DOUBLE AS sentiment_score FROM d0)"""
NEWS_DAY = """nd AS (SELECT symbol, CAST(ts AS DATE) AS day, avg(sentiment_score) AS sentiment_score, count(*) AS sentiment_count,
   count(*) FILTER (sentiment_score > 0.15) AS bullish_count, count(*) FILTER (sentiment_score < -0.15) AS bearish_count,
   avg(CASE WHEN sector IS NOT NULL THEN sentiment_score ELSE 0 END) AS sector_sentiment FROM docs GROUP BY 1, 2)"""

ORACLES["news_lexical_sentiment"] = f"WITH {DOCS} SELECT doc_id, symbol, sentiment, confidence, sentiment_score FROM docs"
ORACLES["news_daily_sentiment"] = f"""WITH {DOCS}, {NEWS_DAY} SELECT symbol, day, sentiment_count, bullish_count, bearish_count,
 {cols(['sentiment_score', 'sector_sentiment'], 4)} FROM nd"""
ORACLES["news_symbol_sentiment"] = f"""WITH {DOCS}, g AS (SELECT symbol, count(*) AS "count",
   sum(sentiment_score * confidence) / sum(confidence) AS s, avg(confidence) AS conf,
   sum(sentiment_score * greatest(confidence, 0.1)) / sum(greatest(confidence, 0.1)) AS gs FROM docs GROUP BY 1)
SELECT symbol, CASE WHEN s > .15 THEN 'bullish' WHEN s < -.15 THEN 'bearish' ELSE 'neutral' END AS sentiment,
   CASE WHEN s > .15 THEN 'bullish' WHEN s < -.15 THEN 'bearish' ELSE 'neutral' END AS news_label, "count",
   round(s, 4) + 0.0 AS model_score, round(conf, 4) AS confidence, round(s, 4) + 0.0 AS news_score, round(conf, 4) AS news_confidence,
   round(gs, 4) + 0.0 AS gateway_score FROM g"""

CHAIN_ROWS = """ch AS (SELECT l_returnflag || l_linestatus AS symbol, l_shipdate AS ts, CAST(1000 + (l_partkey % 50) * 10 AS DOUBLE) AS strike,
   l_quantity AS coi, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity * 2 - 30 END AS poi, l_discount * 1000 - 40 AS cch,
   CASE WHEN l_linenumber % 3 <> 0 THEN l_tax * 1000 END AS pch, l_tax * 100 AS civ,
   CASE WHEN l_linenumber % 3 <> 0 THEN l_discount * 100 END AS piv FROM lineitem)"""


def chain_sum(skip_zero: bool) -> str:
    civ, piv, st = ("nullif(civ, 0)", "nullif(piv, 0)", "nullif(strike, 0)") if skip_zero else ("civ", "piv", "strike")
    pcr = "CASE WHEN sum(coi) > 0 THEN coalesce(sum(poi), 0) / sum(coi)" + (" ELSE 1 END" if skip_zero else " END")
    return f"""SELECT symbol, ts, {pcr} AS pcr, coalesce(sum(coi), 0) AS call_oi, coalesce(sum(poi), 0) AS put_oi,
   coalesce(sum(cch), 0) AS call_oi_change, coalesce(sum(pch), 0) AS put_oi_change,
   (coalesce(sum({civ}), 0) + coalesce(sum({piv}), 0)) / nullif(count({civ}) + count({piv}), 0) AS iv,
   list_sort(list({st}))[len(list({st})) // 2 + 1] AS max_pain FROM ch GROUP BY 1, 2"""


_CHAIN = ["pcr", "call_oi", "put_oi", "call_oi_change", "put_oi_change", "iv", "max_pain"]
ORACLES["options_rollup"] = f"WITH {CHAIN_ROWS}, s AS ({chain_sum(False)}) SELECT symbol, ts, {cols(_CHAIN, 4)} FROM s"
ORACLES["options_rollup_signal"] = f"WITH {CHAIN_ROWS}, s AS ({chain_sum(True)}) SELECT symbol, ts, {cols(_CHAIN, 4)} FROM s"

FF = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_OPT = ["pcr", "max_pain", "iv", "call_oi_change", "put_oi_change", "call_oi", "put_oi"]
OPTION_DAY = f"""{CHAIN_ROWS}, od AS (SELECT *, CAST(ts AS DATE) AS day FROM ({chain_sum(False)}) q
   QUALIFY row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts DESC) = 1)"""


def adaptive(news: bool, options: bool, refs: bool) -> str:
    """The adaptive frame as layered CTEs; the last one is ``fin``."""
    ctes = [VOL, EMA, RSI % "v2"]
    if news:
        ctes += [DOCS, NEWS_DAY]
    if options:
        ctes += [OPTION_DAY]
    news_cols = (
        "coalesce(nd.sentiment_score, 0) AS sscore, coalesce(nd.sentiment_count, 0) AS scount, coalesce(nd.bullish_count, 0) AS bullc, "
        "coalesce(nd.bearish_count, 0) AS bearc, coalesce(nd.sector_sentiment, 0) AS sector_sentiment, "
        "osc.symbol IN (SELECT symbol FROM nd) AS has_news" if news else
        "0.0 AS sscore, 0 AS scount, 0 AS bullc, 0 AS bearc, 0.0 AS sector_sentiment, false AS has_news")
    opt_cols = (", ".join(f"od.{n} AS o_{n}" for n in _OPT) if options else ", ".join(f"CAST(NULL AS DOUBLE) AS o_{n}" for n in _OPT))
    joins = (" LEFT JOIN nd ON osc.symbol = nd.symbol AND CAST(osc.ts AS DATE) = nd.day" if news else "") + (
        " LEFT JOIN od ON osc.symbol = od.symbol AND CAST(osc.ts AS DATE) = od.day" if options else "")
    ctes.append(f"""x0 AS (SELECT osc.* EXCLUDE (d, up, dn, gain, loss, pdm, mdm, dx), {news_cols}, {opt_cols} FROM osc{joins})""")
    if refs:
        ctes.append(f"""bm0 AS (SELECT ts, avg("close") AS cl FROM bars GROUP BY 1),
bm AS (SELECT ts, coalesce(cl / nullif(lag(cl) OVER (ORDER BY ts), 0) - 1, 0) AS br, coalesce(cl / nullif(lag(cl, 20) OVER (ORDER BY ts), 0) - 1, 0) AS br20 FROM bm0),
sc0 AS (SELECT substr(symbol, 1, 1) AS sector, ts, avg("close") AS cl FROM bars GROUP BY 1, 2),
sc AS (SELECT sector, ts, coalesce(cl / nullif(lag(cl) OVER (PARTITION BY sector ORDER BY ts), 0) - 1, 0) AS sr,
   coalesce(cl / nullif(lag(cl, 20) OVER (PARTITION BY sector ORDER BY ts), 0) - 1, 0) AS sr20 FROM sc0),
x0r AS (SELECT x0.*, coalesce(br, 0) AS br, coalesce(br20, 0) AS br20, coalesce(sr, 0) AS sr, coalesce(sr20, 0) AS sr20 FROM x0
   ASOF LEFT JOIN bm ON x0.ts >= bm.ts ASOF LEFT JOIN sc ON substr(x0.symbol, 1, 1) = sc.sector AND x0.ts >= sc.ts)""")
    else:
        ctes.append("x0r AS (SELECT *, 0.0 AS br, 0.0 AS br20, 0.0 AS sr, 0.0 AS sr20 FROM x0)")
    filled = ", ".join(
        f"coalesce(last_value(o_{n} IGNORE NULLS) {FF}, 0) AS {n}" if n != "max_pain" else f"last_value(o_max_pain IGNORE NULLS) {FF} AS max_pain"
        for n in _OPT)
    ctes.append(f"""x1 AS (SELECT x0r.*, {filled}, ema_12, macd, macd_signal, macd_histogram,
   {', '.join(f'{chg(chr(34) + "close" + chr(34), n)} AS return_{n}' for n in (1, 3, 5, 10, 20))},
   {VWAP} AS vwap, max(high) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS ph20,
   avg(sscore) OVER {r(5)} AS rolling_sentiment_mean, coalesce({mp('stddev_pop', 'sscore', 10, 2)}, 0) AS rolling_sentiment_volatility,
   sum(bullc) OVER {r(5)} AS bullish_headline_count, sum(bearc) OVER {r(5)} AS bearish_headline_count,
   abs(sscore) * least(scount, 10) / 10 AS sentiment_shock_score FROM x0r JOIN emas USING (symbol, ts))""")
    ctes.append(f"""x2 AS (SELECT *, {chg('ema_12', 5)} AS ema_slope_12, ("close" - vwap) / nullif(vwap, 0) AS distance_from_vwap,
   ("close" - ph20) / nullif("close", 0) AS breakout_distance,
   coalesce(rolling_sentiment_mean - {lag('rolling_sentiment_mean', 3)}, 0) AS sentiment_momentum,
   CASE WHEN has_news THEN rolling_sentiment_mean - coalesce(return_5, 0) ELSE 0 END AS sentiment_price_divergence,
   greatest(scount - bullish_headline_count - bearish_headline_count, 0) AS neutral_count,
   abs(call_oi_change) + abs(put_oi_change) AS oi, coalesce(pcr - {lag('pcr', 3)}, 0) AS pcr_trend, coalesce(iv - {lag('iv', 3)}, 0) AS iv_trend,
   CASE WHEN iv > ({mp('avg', 'iv', 20, 3)}) + 2 * ({mp('stddev_pop', 'iv', 20, 3)}) THEN 1 ELSE 0 END AS iv_spike,
   coalesce(("close" - max_pain) / nullif("close", 0), 0) AS max_pain_distance,
   coalesce((put_oi - call_oi) / nullif(call_oi + put_oi, 0), 0) AS options_volume_imbalance,
   coalesce(put_oi_change / nullif(call_oi_change, 0), 0) AS put_call_oi_change_ratio FROM x1)""")
    corr = lambda a, b: (
        f"CASE WHEN count({a}) OVER {r(30)} >= 5 THEN (covar_pop({a}, {b}) OVER {r(30)}) / nullif((stddev_pop({a}) OVER {r(30)}) * (stddev_pop({b}) OVER {r(30)}), 0) ELSE 0 END")
    ctes.append(f"""x3 AS (SELECT *, coalesce(oi / nullif({mp('avg', 'oi', 20, 3)}, 0), 0) AS unusual_oi_activity,
   coalesce((put_oi_change - call_oi_change) / nullif(oi, 0), 0) AS oi_imbalance,
   coalesce({corr('returns', 'br')}, 0) AS benchmark_correlation, coalesce({corr('returns', 'sr')}, 0) AS sector_correlation,
   coalesce(return_20, 0) - br20 AS relative_strength,
   coalesce(CASE WHEN count(returns) OVER {r(60)} >= 10 THEN (covar_samp(returns, br) OVER {r(60)}) / nullif(var_samp(br) OVER {r(60)}, 0) END, 1) AS rolling_beta,
   adx_14 / 100 AS trend_strength, least(greatest(volume / nullif(avg(volume) OVER {r(20)}, 0), 0), 3) / 3 AS liquidity_score,
   avg(CASE WHEN return_5 > 0 THEN 1.0 ELSE 0.0 END) OVER {r(20)} AS breadth_score,
   {mp('avg', 'volume', 20, 3)} AS vmean, {mp('stddev_pop', 'volume', 20, 3)} AS vstd FROM x2)""")
    ctes.append("""x4 AS (SELECT *, CASE WHEN abs(benchmark_correlation) < 0.2 THEN 1 ELSE 0 END AS correlation_breakdown,
   coalesce(volatility_percentile, 0) * 0.4 + CASE WHEN return_5 < -0.03 THEN 0.4 ELSE 0 END + (1 - coalesce(liquidity_score, 0.5)) * 0.2 AS market_stress_score,
   CASE WHEN return_20 > 0 THEN 0.35 ELSE 0 END + CASE WHEN trend_strength > 0.25 THEN 0.25 ELSE 0 END
     + CASE WHEN rolling_sentiment_mean > 0 THEN 0.2 ELSE 0 END + CASE WHEN coalesce(volatility_percentile, 0) < 0.7 THEN 0.2 ELSE 0 END AS risk_on_score,
   coalesce((volume - vmean) / nullif(vstd, 0), 0) AS unusual_volume_score FROM x3)""")
    ctes.append("""fin AS (SELECT *, CASE WHEN return_20 < 0 THEN 0.3 ELSE 0 END + CASE WHEN market_stress_score > 0.55 THEN 0.4 ELSE 0 END
     + CASE WHEN rolling_sentiment_mean < -0.15 THEN 0.3 ELSE 0 END AS risk_off_score,
   coalesce(return_5, 0) * -greatest(unusual_volume_score, 0) AS price_volume_divergence, greatest(unusual_oi_activity, 0) AS options_anomaly_score,
   abs(sentiment_price_divergence) AS sdiv, greatest(coalesce(range_expansion, 0), 0) AS volatility_shock_score,
   CASE WHEN breakout_distance > 0 AND volume < vmean AND return_3 < 0 THEN 1.0 ELSE 0.0 END AS fake_breakout_probability,
   least(greatest(1 - coalesce(liquidity_score, 0.5), 0), 1) AS liquidity_breakdown_score FROM x4)""")
    return "WITH RECURSIVE " + ",\n".join(ctes)


def cz(names: list[str], digits: int) -> str:
    return ", ".join(f"round(CAST(coalesce({n}, 0) AS DOUBLE), {digits}) + 0.0 AS {n}" for n in names)


ORACLES["features_sentiment"] = adaptive(True, False, False) + f""" SELECT symbol, ts, {cz(['rolling_sentiment_mean', 'rolling_sentiment_volatility',
  'sentiment_momentum', 'bullish_headline_count', 'bearish_headline_count', 'sentiment_price_divergence', 'sentiment_shock_score', 'sector_sentiment', 'neutral_count'], 4)} FROM fin"""
ORACLES["features_options"] = adaptive(False, True, False) + f""" SELECT symbol, ts, {cz(['pcr', 'pcr_trend', 'iv', 'iv_trend', 'iv_spike',
  'max_pain_distance', 'unusual_oi_activity', 'options_volume_imbalance', 'put_call_oi_change_ratio', 'oi_imbalance'], 4)} FROM fin"""
ORACLES["features_correlation"] = adaptive(False, False, True) + f""" SELECT symbol, ts, round(br, 4) + 0.0 AS benchmark_returns, round(sr20, 4) + 0.0 AS sector_strength,
  {cz(['benchmark_correlation', 'sector_correlation', 'relative_strength', 'rolling_beta', 'correlation_breakdown'], 4)} FROM fin"""
FULL = adaptive(True, True, True)
ORACLES["features_regime_and_anomaly"] = FULL + f""" SELECT symbol, ts, {cz(['trend_strength', 'liquidity_score', 'breadth_score', 'market_stress_score',
  'risk_on_score', 'risk_off_score', 'unusual_volume_score', 'price_volume_divergence', 'options_anomaly_score', 'volatility_shock_score',
  'fake_breakout_probability', 'liquidity_breakdown_score'], 4)} FROM fin"""
ORACLES["feature_vector_latest"] = FULL + f""", lv AS (SELECT *, rsi_14 AS rsi, ema_slope_12 AS ema_slope, distance_from_vwap AS vwap_distance, atr_14 AS atr,
  bb_width AS bollinger_width, realized_vol_20 AS realized_volatility, bullish_headline_count AS bullish_count, bearish_headline_count AS bearish_count
  FROM fin QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)
SELECT symbol, ts, '1m' AS timeframe, {cz(['macd', 'macd_signal', 'macd_histogram', 'atr'], 2)}, {cz(['rsi', 'ema_slope', 'vwap_distance', 'bollinger_width',
  'realized_volatility', 'rolling_sentiment_mean', 'bullish_count', 'bearish_count', 'neutral_count', 'sentiment_momentum', 'pcr_trend', 'iv_spike', 'oi_imbalance'], 4)} FROM lv"""

_VER = "'v2001.' || substr(sha256(feature_name || ':default'), 1, 8)"
RECORDS = f"""{VOL}, {RSI % 'v2'}, rec AS (SELECT symbol, ts, 'rsi_14' AS feature_name, rsi_14 AS v FROM osc UNION ALL SELECT symbol, ts, 'returns', returns FROM osc)"""
ORACLES["feature_records"] = f"""WITH {RECORDS} SELECT symbol, ts, feature_name, {_VER} AS feature_version,
  CASE WHEN epoch(TIMESTAMP '2001-11-05 00:10:00' - ts) <= 900 THEN 'FRESH' WHEN epoch(TIMESTAMP '2001-11-05 00:10:00' - ts) <= 3600 THEN 'STALE' ELSE 'EXPIRED' END AS freshness_status,
  round(v, 4) + 0.0 AS feature_value FROM rec"""
ORACLES["feature_store_latest"] = f"""WITH {RECORDS} SELECT symbol, ts, feature_name, round(v, 4) + 0.0 AS feature_value FROM rec
QUALIFY row_number() OVER (PARTITION BY symbol, feature_name ORDER BY ts DESC) = 1"""

# ---- strategies --------------------------------------------------------------------------------

# name, category, minimum rows, hold reason, then CASE arms (condition, score, confidence, reason) and the default.
LOW = "least(1, 0.45 + 0.15 * least(volume_ratio, 3))"
LOWC = "least(0.9, 0.45 + 0.15 * volume_ratio)"
VD = '(("close" - vwap) / nullif(vwap, 0))'
VS = f"greatest(0.2, least(1, abs({VD}) * 16 + abs(returns) * 8))"
MAS = 'least(greatest((sma_10 - sma_20) / greatest("close", 1e-9) * 25, -1), 1)'
H, PH = "(macd - macd_signal)", "(pmacd - psig)"
UPX, DNX = "(pmacd <= psig AND macd > macd_signal)", "(pmacd >= psig AND macd < macd_signal)"


def mstr(cross: str) -> str:
    return f"least(1, abs({H}) / greatest(abs(macd), 1e-6) + CASE WHEN {cross} THEN 0.25 ELSE 0 END)"


BW = "greatest(bb_upper - bb_lower, 1e-9)"
BU = f'least(1, (bb_lower - "close") / {BW} * 4 + 0.35)'
BO = f'least(1, ("close" - bb_upper) / {BW} * 4 + 0.35)'
AU, AD = 'least(1, ("close" - ph14) / greatest(atr_14, 1e-9))', 'least(1, (pl14 - "close") / greatest(atr_14, 1e-9))'
AR = "coalesce(least(greatest(rm5 / nullif(rs20, 0), -1), 1), 0)"
KA = 'least(greatest(("close" - smooth_price) / greatest("close", 1e-9) * 30, -1), 1)'
LS = "(least(greatest(rs10 / greatest(rs20 * 5, 1e-9), -1), 1) * 0.35)"
# Literals with an exponent are doubles; plain ones would be exact decimals.
XG = ("((CASE WHEN sma_10 > sma_20 THEN 0.35e0 ELSE -0.35e0 END + CASE WHEN macd > macd_signal THEN 0.25e0 ELSE -0.25e0 END "
      "+ CASE WHEN rsi_14 < 65 THEN 0.2e0 ELSE -0.2e0 END + 0.2e0 * least(greatest(volume_ratio - 1e0, -1), 1)) * 0.45e0)")
STRATS = [
    ("Breakout", "momentum", 20, "Insufficient candles for 20-period breakout.", [
        ('"close" > ph20', LOW, LOWC, "Price closed above the 20-period range high."),
        ('"close" < pl20', f"-{LOW}", LOWC, "Price closed below the 20-period range low.")],
     ("0", "0.35", "Price remains inside the 20-period range.")),
    ("VWAP", "momentum", 2, "Insufficient candles for VWAP.", [
        ("vwap <= 0", "0", "0.1", "VWAP is unavailable due to missing volume."),
        (f"{VD} > 0 AND returns > 0", VS, f"least(0.85, 0.35 + {VS} * 0.5)", "Price is above VWAP with positive short-term momentum."),
        (f"{VD} < 0 AND returns < 0", f"-{VS}", f"least(0.85, 0.35 + {VS} * 0.5)", "Price is below VWAP with negative short-term momentum.")],
     ("0", "0.35", "VWAP and momentum are not aligned.")),
    ("Moving Average Crossover", "momentum", 20, "Insufficient candles for moving-average crossover.", [
        (f"{MAS} > 0.15", MAS, f"least(0.8, 0.35 + abs({MAS}) * 0.5)", "Fast average is above slow average."),
        (f"{MAS} < -0.15", MAS, f"least(0.8, 0.35 + abs({MAS}) * 0.5)", "Fast average is below slow average.")],
     (MAS, f"least(0.8, 0.35 + abs({MAS}) * 0.5)", "Moving averages are compressed.")),
    ("MACD Momentum", "momentum", 26, "Insufficient candles for MACD.", [
        (f"{UPX} OR ({H} > 0 AND {H} > {PH})", f"greatest(0.25, {mstr(UPX)})", f"least(0.9, 0.5 + {mstr(UPX)} * 0.35)",
         "MACD is bullish from crossover or rising positive histogram."),
        (f"{DNX} OR ({H} < 0 AND {H} < {PH})", f"-greatest(0.25, {mstr(DNX)})", f"least(0.9, 0.5 + {mstr(DNX)} * 0.35)",
         "MACD is bearish from crossover or falling negative histogram.")],
     ("0", "0.35", "MACD has no clear crossover or histogram momentum.")),
    ("SuperTrend", "momentum", 15, "Insufficient candles for SuperTrend.", [
        ("supertrend_direction > 0", "0.55", "0.62", "SuperTrend direction is bullish."),
        ("supertrend_direction < 0", "-0.55", "0.62", "SuperTrend direction is bearish.")],
     ("0", "0.3", "SuperTrend direction is neutral.")),
    ("RSI Reversal", "mean_reversion", 14, "Insufficient candles for RSI.", [
        ("rsi_14 < 30", "(30 - rsi_14) / 30", "least(0.9, 0.45 + (30 - rsi_14) / 40)", "RSI is oversold and mean-reversion risk/reward is improving."),
        ("rsi_14 > 70", "-(rsi_14 - 70) / 30", "least(0.9, 0.45 + (rsi_14 - 70) / 40)", "RSI is overbought and reversal risk is elevated."),
        ("rsi_14 BETWEEN 45 AND 55", "0", "0.45", "RSI is between 45 and 55, so reversal edge is neutral.")],
     ("0", "0.35", "RSI is in the neutral zone.")),
    ("Bollinger Band Reversion", "mean_reversion", 20, "Insufficient candles for Bollinger Bands.", [
        ('"close" < bb_lower', BU, f"least(0.85, 0.45 + {BU} * 0.4)", "Price is below the lower Bollinger Band."),
        ('"close" > bb_upper', f"-{BO}", f"least(0.85, 0.45 + {BO} * 0.4)", "Price is above the upper Bollinger Band.")],
     ("0", "0.3", "Price is inside Bollinger Bands.")),
    ("Stochastic Reversal", "mean_reversion", 14, "Insufficient candles for stochastic reversal.", [
        ("stoch_k < 20", "(20 - stoch_k) / 20", "0.6", "Stochastic oscillator is oversold."),
        ("stoch_k > 80", "-(stoch_k - 80) / 20", "0.6", "Stochastic oscillator is overbought.")],
     ("0", "0.3", "Stochastic oscillator is neutral.")),
    ("ATR Volatility System", "volatility", 15, "Insufficient candles for ATR system.", [
        ('atr_14 <= 0 OR "close" <= 0', "0", "0.1", "ATR breakout cannot run because ATR or close is unavailable."),
        ('"close" > ph14 + 0.35 * atr_14', AU, f"least(0.88, 0.45 + {AU} * 0.3)", "Price broke above recent high by an ATR-adjusted threshold."),
        ('"close" < pl14 - 0.35 * atr_14', f"-{AD}", f"least(0.88, 0.45 + {AD} * 0.3)", "Price broke below recent low by an ATR-adjusted threshold.")],
     ("0", "0.35", "No ATR-adjusted breakout is present.")),
    ("Z-Score Mean Reversion", "statistical", 20, "Insufficient candles for z-score reversion.", [
        ("zscore_20 < -1.5", "least(1, abs(zscore_20) / 3)", "0.65", "Price is statistically below its rolling mean."),
        ("zscore_20 > 1.5", "-least(1, abs(zscore_20) / 3)", "0.65", "Price is statistically above its rolling mean.")],
     ("0", "0.3", "Z-score is inside the neutral band.")),
    ("ARIMA Forecast Interface", "statistical", 30, "Insufficient candles for ARIMA-ready forecast proxy.", [],
     (f"{AR} * 0.35", f"least(0.55, 0.25 + abs({AR}) * 0.2)", "ARIMA-ready interface emits a conservative return-autocorrelation proxy.")),
    ("Kalman Trend Interface", "statistical", 20, "Insufficient candles for Kalman-ready trend proxy.", [],
     (KA, f"least(0.65, 0.3 + abs({KA}) * 0.3)", "Kalman-ready interface emits a smoothed-state trend proxy.")),
    ("XGBoost Interface", "ai_ml", 30, "Insufficient candles for XGBoost-ready feature scoring.", [],
     (XG, "0.55", "XGBoost-ready interface scored engineered market features.")),
    ("LSTM Interface", "ai_ml", 30, "Insufficient candles for LSTM-ready sequence scoring.", [],
     (LS, f"least(0.55, 0.3 + abs({LS}))", "LSTM-ready interface scored recent return sequence behavior.")),
]


def strategy_select(spec: tuple, source: str = "tf") -> str:
    name, category, rows, short, arms, default = spec
    arms = [(f"pos + 1 < {rows}", "0", "0.1", short), *arms]
    case = lambda i: "CASE " + " ".join(f"WHEN {a[0]} THEN {quote(a[i], i)}" for a in arms) + f" ELSE {quote(default[i - 1], i)} END"
    return (f"SELECT symbol, ts, pos, '{name}' AS strategy_name, '{category}' AS category, least(greatest(CAST({case(1)} AS DOUBLE), -1), 1) AS score, "
            f"least(greatest(CAST({case(2)} AS DOUBLE), 0), 1) AS confidence, {case(3)} AS reason FROM {source}")


def quote(value: str, i: int) -> str:
    return "'" + value + "'" if i == 3 else value


def signals_cte(specs: list, source: str = "tf") -> str:
    union = " UNION ALL ".join(strategy_select(s, source) for s in specs)
    return f"sg AS (SELECT *, CASE WHEN score > 0.15 THEN 'BUY' WHEN score < -0.15 THEN 'SELL' ELSE 'HOLD' END AS signal FROM ({union}) u)"


ORACLES["strategy_signals_price"] = f"""WITH RECURSIVE {TRADING}, {signals_cte(STRATS)}
SELECT symbol, ts, strategy_name, category, signal, reason, {cols(['score', 'confidence'], 4)} FROM sg"""

CONTEXT = f"""{DOCS}, {CHAIN_ROWS}, nw AS (SELECT symbol, sum(sentiment_score * confidence) / sum(confidence) AS ns, least(1, avg(confidence)) AS nc FROM docs GROUP BY 1),
oc AS (SELECT * FROM ({chain_sum(True)}) q QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)"""
OS_ = ("least(greatest(0.65 * least(greatest((pcr - 1) * 1.5, -1), 1) + 0.35 * coalesce((put_oi_change - call_oi_change) / nullif(abs(call_oi_change) + abs(put_oi_change), 0), 0)"
       " + CASE WHEN iv > 35 THEN -0.15 ELSE 0 END, -1), 1)")
NL = "CASE WHEN ns > 0.15 THEN 'bullish' WHEN ns < -0.15 THEN 'bearish' ELSE 'neutral' END"
ORACLES["strategy_signals_context"] = f"""WITH {BASE}, {CONTEXT}, j AS (SELECT b1.symbol, b1.ts, ns, nc, pcr, call_oi_change, put_oi_change, iv FROM b1 LEFT JOIN nw USING (symbol) LEFT JOIN oc ON b1.symbol = oc.symbol),
u AS (SELECT symbol, ts, 'FinBERT Sentiment' AS strategy_name, ns AS score, nc AS confidence, 'Financial-news sentiment is ' || {NL} || '.' AS reason FROM j
 UNION ALL SELECT symbol, ts, 'Transformer Sentiment', ns * 0.9, nc * 0.9, 'Transformer sentiment layer reports ' || {NL} || ' bias.' FROM j
 UNION ALL SELECT symbol, ts, 'Options Chain PCR', {OS_}, least(0.85, 0.45 + abs({OS_}) * 0.4), CASE WHEN {OS_} > 0.15 THEN 'Options chain positioning is bullish.'
   WHEN {OS_} < -0.15 THEN 'Options chain positioning is bearish.' ELSE 'Options chain positioning is balanced.' END FROM j)
SELECT symbol, ts, strategy_name, CASE WHEN score > 0.15 THEN 'BUY' WHEN score < -0.15 THEN 'SELL' ELSE 'HOLD' END AS signal, reason, {cols(['score', 'confidence'], 4)} FROM u"""

SPREAD = '((sma_20 - sma_50) / greatest("close", 1e-9))'
REGIME = f"""rg0 AS (SELECT *, CASE WHEN pos + 1 < 5 THEN 'normal' WHEN r5 <= -0.04 THEN 'panic' WHEN {SPREAD} > 0.01 AND r5 > 0 THEN 'bullish'
   WHEN {SPREAD} < -0.01 AND r5 < 0 THEN 'bearish' WHEN abs({SPREAD}) > 0.006 THEN 'trending' ELSE 'sideways' END AS l1 FROM tf),
rg1 AS (SELECT *, CASE l1 WHEN 'normal' THEN 0 WHEN 'panic' THEN least(1, abs(r5 / -0.04)) WHEN 'bullish' THEN least(0.95, 0.5 + abs({SPREAD}) * 12)
   WHEN 'bearish' THEN least(0.95, 0.5 + abs({SPREAD}) * 12) WHEN 'trending' THEN least(0.8, 0.4 + abs({SPREAD}) * 15) ELSE 0.55 END AS c1,
   CASE l1 WHEN 'panic' THEN 100 WHEN 'bullish' THEN 70 WHEN 'bearish' THEN 70 WHEN 'trending' THEN 60 WHEN 'sideways' THEN 50 ELSE 10 END AS p1,
   CASE WHEN atr_pct >= 0.03 THEN least(1, atr_pct / 0.03) ELSE greatest(0.2, 1 - atr_pct / 0.03) END AS c2,
   CASE WHEN volume_ratio < 0.45 THEN least(1, 1 - volume_ratio) ELSE least(0.7, volume_ratio / 2) END AS c3 FROM rg0),
rg AS (SELECT *, CASE WHEN l1 = 'panic' THEN 'panic' WHEN volume_ratio < 0.45 THEN 'low_liquidity' WHEN atr_pct >= 0.03 THEN 'high_volatility' ELSE l1 END AS regime,
   CASE WHEN l1 = 'panic' THEN c1 WHEN volume_ratio < 0.45 THEN c3 WHEN atr_pct >= 0.03 THEN c2 WHEN p1 > 10 THEN c1 ELSE greatest(c1, c2, c3) END AS regime_confidence FROM rg1)"""
ORACLES["trading_regimes"] = f"WITH RECURSIVE {TRADING}, {REGIME} SELECT symbol, ts, regime, round(regime_confidence, 4) + 0.0 AS regime_confidence FROM rg"

# ---- weights by the bounded water-filling, unrolled to eight rounds ---------------------------------


def fill_ctes(prefix: str, source: str, expression: str) -> str:
    """CTEs that turn list column ``expression`` of ``source`` into fitted weights ``w`` of ``{prefix}_out``."""
    n = "len(w)"
    out = [f"{prefix}_a AS (SELECT * EXCLUDE (w), w AS w FROM (SELECT * EXCLUDE (w), list_transform({expression}, lambda x: greatest(x, 0)) AS w FROM {source}) q)",
           f"{prefix}_b AS (SELECT * EXCLUDE (w), list_transform(CASE WHEN list_sum(w) > 0 THEN list_transform(w, lambda x: x / list_sum(w)) ELSE list_transform(w, lambda x: 1.0 / {n}) END, "
           "lambda x: least(greatest(x, 0.05), 0.45)) AS w, false AS done FROM " + f"{prefix}_a)"]
    last = f"{prefix}_b"
    for i in range(8):
        a, b = f"{prefix}_r{i}", f"{prefix}_s{i}"
        out.append(f"{a} AS (SELECT * EXCLUDE (w), CASE WHEN done THEN w ELSE list_transform(w, lambda x: x / list_sum(w)) END AS w FROM {last})")
        over, under = "len(list_filter(w, lambda x: x > 0.45))", "list_sum(list_filter(w, lambda x: x <= 0.45))"
        out.append(f"{b} AS (SELECT * EXCLUDE (w, done), CASE WHEN done THEN w WHEN {over} = 0 THEN list_transform(w, lambda x: greatest(x, 0.05)) ELSE "
                   f"list_transform(w, lambda x: CASE WHEN x > 0.45 THEN 0.45 ELSE greatest(0.05, x / coalesce(nullif({under}, 0), 1) * greatest(0, 1 - {over} * 0.45)) END) END AS w, "
                   f"done OR {over} = 0 AS done FROM {a})")
        last = b
    cap = "list_transform(w, lambda x: least(x / list_sum(w), 0.45))"
    out.append(f"{prefix}_e AS (SELECT *, {cap} AS z FROM {last})")
    out.append(f"{prefix}_out AS (SELECT * EXCLUDE (w, z, done), CASE WHEN done THEN w WHEN 1 - list_sum(z) > 0 THEN list_transform(z, lambda x: CASE WHEN x < 0.45 THEN "
               f"least(0.45, x + (1 - list_sum(z)) / len(list_filter(z, lambda y: y < 0.45))) ELSE x END) ELSE z END AS w FROM {prefix}_e)")
    return ",\n".join(out)


CORE = ["MACD Momentum", "VWAP", "RSI Reversal", "ATR Volatility System"]
_core = [next(s for s in STRATS if s[0] == n) for n in CORE]
_FIN = ("UNION ALL SELECT symbol, ts, pos, 'FinBERT Sentiment', 'ai_ml', CAST(%s AS DOUBLE), CAST(%s AS DOUBLE), 'Financial-news sentiment is ' || %s || '.' FROM %s")


def voted(source: str = "rg", fin: str = _FIN % ("0", "0", "'neutral'", "rg"), accuracy: str = "w") -> str:
    union = " UNION ALL ".join(strategy_select(s, source) for s in _core) + " " + fin
    mult = ("CASE WHEN regime IN ('trending','bullish','bearish') THEN [1.35, 1.35, 0.75, 1.0, 1.0] WHEN regime = 'sideways' THEN [0.75, 0.75, 1.4, 1.0, 1.0] "
            "WHEN regime = 'high_volatility' THEN [0.9, 0.9, 1.0, 1.45, 1.0] WHEN regime = 'panic' THEN [0.7, 0.7, 0.65, 1.25, 0.85] ELSE [1.0, 1.0, 1.0, 1.0, 1.0] END")
    return f"""sg AS (SELECT *, CASE WHEN score > 0.15 THEN 'BUY' WHEN score < -0.15 THEN 'SELL' ELSE 'HOLD' END AS signal,
   list_position(['MACD Momentum','VWAP','RSI Reversal','ATR Volatility System','FinBERT Sentiment'], strategy_name) AS k FROM ({union}) u),
sl AS (SELECT symbol, ts, list(signal ORDER BY k) AS sigs, list(score ORDER BY k) AS scs, list(confidence ORDER BY k) AS cfs, list(strategy_name ORDER BY k) AS nms FROM sg GROUP BY 1, 2),
w0 AS (SELECT {source}.*, sigs, scs, cfs, nms, [0.0] AS w FROM {source} JOIN sl USING (symbol, ts)),
{fill_ctes('wa', 'w0', '[0.25, 0.20, 0.20, 0.15, 0.20]')},
{fill_ctes('wb', 'wa_out', f'list_transform(list_zip(w, {mult}), lambda z: z[1] * z[2])')},
{fill_ctes('wc', 'wb_out', accuracy)},
{fill_ctes('wd', 'wc_out', 'list_transform(list_zip(w, cfs), lambda z: z[1] * (0.5 + z[2]))')},
vt0 AS (SELECT *, list_transform(range(1, 6), lambda i: w[i] * greatest(0.05, cfs[i])) AS cv FROM wd_out),
vt1 AS (SELECT *, list_sum(list_transform(range(1, 6), lambda i: CASE WHEN sigs[i] = 'BUY' THEN cv[i] * (0.5 + greatest(scs[i], 0) / 2) ELSE 0 END)) AS bu,
   list_sum(list_transform(range(1, 6), lambda i: CASE WHEN sigs[i] = 'SELL' THEN cv[i] * (0.5 + abs(least(scs[i], 0)) / 2) ELSE 0 END)) AS be,
   list_sum(list_transform(range(1, 6), lambda i: CASE WHEN sigs[i] = 'HOLD' THEN cv[i] ELSE 0 END)) AS ne FROM vt0),
vt2 AS (SELECT *, CASE WHEN bu + be + ne > 0 THEN bu / (bu + be + ne) ELSE 0 END AS pb, CASE WHEN bu + be + ne > 0 THEN be / (bu + be + ne) ELSE 0 END AS ps,
   CASE WHEN bu + be + ne > 0 THEN ne / (bu + be + ne) ELSE 1 END AS pn FROM vt1),
vt AS (SELECT *, CASE WHEN greatest(pb, ps, pn) >= 0.7 THEN 'HIGH' WHEN greatest(pb, ps, pn) >= 0.55 THEN 'MODERATE' ELSE 'LOW' END AS confidence,
   CASE WHEN pb >= 0.58 AND pb - ps >= 0.12 THEN 'BUY' WHEN ps >= 0.58 AND ps - pb >= 0.12 THEN 'SELL' ELSE 'HOLD' END AS suggested_action FROM vt2)"""


VOTE = f"WITH RECURSIVE {TRADING}, {REGIME}, {voted()}"
ORACLES["ensemble_votes"] = f"""{VOTE} SELECT symbol, ts, regime, confidence, suggested_action, round(pb, 4) + 0.0 AS bullish_probability,
  round(ps, 4) + 0.0 AS bearish_probability, round(pn, 4) + 0.0 AS neutral_probability FROM vt"""
ORACLES["ensemble_weights"] = f"""{VOTE}, e AS (SELECT symbol, ts, unnest(range(1, 6)) AS i, nms, w, cv, scs FROM vt)
SELECT symbol, ts, nms[i] AS strategy_name, round(w[i], 4) + 0.0 AS raw_weight, round(cv[i] * scs[i], 4) + 0.0 AS contribution FROM e"""
ORACLES["ensemble_texts"] = f"""{VOTE}, e AS (SELECT *, list_filter(nms, lambda n, i: sigs[i] = 'BUY') AS bn, list_filter(nms, lambda n, i: sigs[i] = 'SELL') AS sn FROM vt)
SELECT symbol, ts, 'Combined market intelligence is based on 5 independent engines: ' || len(bn) || ' bullish, ' || len(sn) || ' bearish, and ' || (5 - len(bn) - len(sn)) || ' neutral.'
 || CASE WHEN len(bn) > 0 THEN ' Bullish support comes from ' || array_to_string(bn[1:4], ', ') || '.' ELSE '' END
 || CASE WHEN len(sn) > 0 THEN ' Bearish pressure comes from ' || array_to_string(sn[1:4], ', ') || '.' ELSE '' END
 || ' Regime-aware weighting adjusted the strategy mix for a ' || regime || ' environment. Current regime is ' || regime || ' with ' || CAST(round_even(regime_confidence * 100, 0) AS INT) || '% confidence.' AS explanation FROM e"""
RISK = """rk0 AS (SELECT *, CASE WHEN suggested_action = 'SELL' THEN round("close" + greatest(atr_14 * 1.5, "close" * 0.02), 2) ELSE round("close" - greatest(atr_14 * 1.5, "close" * 0.02), 2) END AS st FROM vt),
rk1 AS (SELECT *, CASE WHEN suggested_action = 'SELL' THEN round("close" - 2 * abs("close" - st), 2) ELSE round("close" + 2 * abs("close" - st), 2) END AS tg FROM rk0),
rk2 AS (SELECT *, coalesce(abs(tg - "close") / nullif(abs("close" - st), 0), 0) AS rr FROM rk1),
rk3 AS (SELECT *, CASE WHEN atr_pct >= 0.03 * 2.2 OR abs(drawdown_60) >= 0.1875 THEN 'EXTREME' WHEN atr_pct >= 0.03 * 1.5 OR rr < 1.2 OR abs(drawdown_60) >= 0.15 THEN 'HIGH'
   WHEN atr_pct >= 0.03 OR rr < 1.8 THEN 'MODERATE' ELSE 'LOW' END AS risk_level,
   len(list_filter(range(1, 5), lambda i: sigs[i] = suggested_action)) AS agree FROM rk2),
rk AS (SELECT *, CASE WHEN suggested_action = 'HOLD' OR volume <= 0 OR atr_14 <= 0 THEN 'HOLD' WHEN risk_level = 'EXTREME' THEN 'AVOID'
   WHEN confidence = 'LOW' OR rr < 1.5 OR greatest(round(pb, 4), round(ps, 4)) < 0.62 OR agree < 2 OR (risk_level = 'HIGH' AND coalesce(r5, 0) <= -0.04) THEN 'HOLD'
   ELSE suggested_action END AS final_action FROM rk3)"""
SIZE = """rs0 AS (SELECT *, abs("close" - st) AS unit, CASE risk_level WHEN 'EXTREME' THEN 0 WHEN 'HIGH' THEN 0.5e0 ELSE 1 END AS share FROM rk),
rs AS (SELECT *, CASE WHEN unit > 0 THEN round(least(1e4 / unit, 1e6 / greatest("close", 1e-9)), 4) ELSE 0 END AS qty,
   CASE WHEN unit > 0 THEN round(least(1e4 / unit, 1e6 / greatest("close", 1e-9)) * unit, 2) ELSE 0 END AS risky FROM rs0)"""
ORACLES["risk_decisions"] = f"""{VOTE}, {RISK}, {SIZE} SELECT symbol, ts, risk_level, final_action, final_action = suggested_action AND final_action <> 'HOLD' AND risk_level NOT IN ('HIGH', 'EXTREME') AS approved,
  final_action <> suggested_action AS override_applied, round(CASE WHEN risk_level <> 'EXTREME' THEN st END, 2) + 0.0 AS stop_loss,
  round(CASE WHEN risk_level <> 'EXTREME' THEN tg END, 2) + 0.0 AS target, round(rr, 3) + 0.0 AS risk_reward_ratio,
  CASE WHEN final_action <> suggested_action THEN 'Risk engine overrode ' || suggested_action || ' to ' || final_action || '; ' || coalesce(nullif(concat_ws('; ',
    CASE WHEN coalesce(volume, 0) <= 0 THEN 'latest candle volume is zero' END, CASE WHEN coalesce(atr_14, 0) <= 0 THEN 'ATR is unavailable' END,
    CASE WHEN rr < 1.5 THEN 'risk/reward is below #' END), ''), 'risk level is ' || risk_level) || '; risk/reward is #'
    ELSE 'Risk engine approved ' || final_action || '; risk level is ' || risk_level || ', ATR percentage is #, and risk/reward is #' END AS reason,
  true AS entry_at_close, true AS entry_in_cents, round(qty * share, 2) + 0.0 AS position_size, round(risky * share, 1) + 0.0 AS capital_at_risk FROM rs"""
ORACLES["risk_gate"] = f"""{VOTE}, {RISK}, {SIZE},
g0 AS (SELECT *, year(ts) < 1996 AS stale, volume_ratio >= 2.5 AS anom, abs(drawdown_60) >= 0.15 AS dd, round(rr, 3) < 1.2 AS poor FROM rs),
g1 AS (SELECT *, CASE WHEN stale THEN 'AVOID' ELSE suggested_action END AS a1 FROM g0),
g2 AS (SELECT *, CASE WHEN poor AND a1 <> 'HOLD' THEN 'HOLD' ELSE a1 END AS a2, poor AND a1 <> 'HOLD' AS x2 FROM g1),
g3 AS (SELECT *, CASE WHEN anom AND confidence <> 'HIGH' THEN 'HOLD' ELSE a2 END AS a3 FROM g2),
g4 AS (SELECT *, CASE WHEN dd THEN 'AVOID' ELSE a3 END AS a4 FROM g3),
g5 AS (SELECT *, confidence = 'LOW' AND a4 <> 'HOLD' AS x5 FROM g4),
g6 AS (SELECT *, CASE WHEN x5 THEN 'HOLD' ELSE a4 END AS a5, array_to_string(list_filter([
   CASE WHEN stale THEN 'stale data prevents signal approval' END, CASE WHEN x2 THEN 'poor risk/reward downgraded directional signal' END,
   CASE WHEN risk_level = 'HIGH' THEN 'high risk reduced position size' END, CASE WHEN anom THEN 'high anomaly severity requires stronger confirmation' END,
   CASE WHEN dd THEN 'recent drawdown breach blocks new trades' END, CASE WHEN x5 THEN 'low confidence ensemble downgraded to HOLD' END], lambda x: x IS NOT NULL), '; ') AS why FROM g5)
SELECT symbol, ts, a5 AS gate_action, NOT stale AND NOT x2 AND NOT (anom AND confidence <> 'HIGH') AND NOT dd AND NOT x5 AND a5 <> 'HOLD' AS gate_approved,
  CASE WHEN stale THEN 'HIGH' ELSE risk_level END AS gate_risk_level, CASE WHEN why = '' THEN 'risk gatekeeper approved the ensemble signal' ELSE why END AS gate_reason,
  round(gq, 2) + 0.0 AS gate_position_size, CASE WHEN gq > 0 AND risk_level <> 'EXTREME' THEN round(st, 2) + 0.0 END AS gate_stop_loss,
  CASE WHEN gq > 0 AND risk_level <> 'EXTREME' THEN round(tg, 2) + 0.0 END AS gate_target
FROM (SELECT *, CASE WHEN stale OR dd THEN 0 ELSE qty * share * CASE WHEN risk_level = 'HIGH' THEN 0.5e0 ELSE 1 END END AS gq FROM g6)"""

# ---- back-test --------------------------------------------------------------------------------------

TRADES = f"""{signals_cte(STRATS, 'tf')},
td AS (SELECT sg.strategy_name, sg.symbol, sg.ts, sg.pos, CASE WHEN signal = 'BUY' THEN 1 ELSE -1 END * (next_close - "close") / greatest("close", 1e-9) AS rz
   FROM sg JOIN tf ON sg.symbol = tf.symbol AND sg.ts = tf.ts WHERE signal <> 'HOLD' AND sg.pos >= 20 AND next_close IS NOT NULL)"""
_GRID = ("gr AS (SELECT symbol, min(ts) AS start_date, max(ts) AS end_date, unnest([" + ", ".join(f"'{s[0]}'" for s in STRATS) +
         "]) AS strategy_name FROM bars GROUP BY symbol HAVING count(*) >= 25)")
ORACLES["backtest_results"] = f"""WITH RECURSIVE {TRADING}, {TRADES}, {_GRID},
m AS (SELECT strategy_name, symbol, count(*) AS n, avg(CASE WHEN rz > 0 THEN 1.0 ELSE 0 END) AS wr, coalesce(sum(rz) FILTER (rz > 0), 0) AS gain, abs(coalesce(sum(rz) FILTER (rz < 0), 0)) AS loss,
   avg(rz) AS mean, stddev_pop(rz) AS sd FROM td GROUP BY 1, 2)
SELECT gr.strategy_name, gr.symbol, start_date, end_date, coalesce(n, 0) AS total_trades, coalesce(loss, 0) = 0 AND coalesce(gain, 0) > 0 AS only_gains,
  round(coalesce(wr, 0), 4) + 0.0 AS win_rate, round(coalesce(mean, 0), 6) + 0.0 AS average_return, round(coalesce(sd, 0), 4) + 0.0 AS return_std,
  round(CASE WHEN loss > 0 THEN gain / loss WHEN gain > 0 THEN NULL ELSE 0 END, 4) + 0.0 AS profit_factor
FROM gr LEFT JOIN m USING (strategy_name, symbol)"""
ORACLES["backtest_drawdown"] = f"""WITH RECURSIVE {TRADING}, {TRADES}, {_GRID},
e0 AS (SELECT *, product(1 + rz) OVER (PARTITION BY strategy_name, symbol ORDER BY pos) AS eq FROM td),
e1 AS (SELECT *, greatest(1, max(eq) OVER (PARTITION BY strategy_name, symbol ORDER BY pos)) AS pk FROM e0),
m AS (SELECT strategy_name, symbol, min((eq - pk) / pk) AS dd FROM e1 GROUP BY 1, 2)
SELECT gr.strategy_name, gr.symbol, round(log10(1 - round(least(coalesce(dd, 0), 0), 4)), 3) + 0.0 AS log_drawdown,
  CASE WHEN coalesce(dd, 0) > -1000 THEN round(round(least(coalesce(dd, 0), 0), 4), 3) + 0.0 END AS drawdown FROM gr LEFT JOIN m USING (strategy_name, symbol)"""
ORACLES["accuracy_by_regime"] = f"""WITH RECURSIVE {TRADING}, {REGIME}, {TRADES}
SELECT td.strategy_name, td.symbol, regime, count(*) AS sample_size, round(avg(CASE WHEN rz > 0 THEN 1.0 ELSE 0 END), 4) + 0.0 AS accuracy,
  round(avg(rz), 6) + 0.0 AS avg_return FROM td JOIN rg ON td.symbol = rg.symbol AND td.ts = rg.ts GROUP BY 1, 2, 3"""
_IX = f"ix AS (SELECT symbol, ts, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"
ORACLES["train_test_cut"] = f"WITH {BARS}, {_IX} SELECT symbol, ts, CASE WHEN pos < greatest(1, least(n - 1, floor(n * 0.7))) THEN 'train' ELSE 'test' END AS part FROM ix"
ORACLES["walk_forward_folds"] = f"""WITH {BARS}, {_IX}, f AS (SELECT *, unnest([1, 2, 3]) AS fold FROM ix)
SELECT symbol, ts, fold, CASE WHEN pos < fold * (n // 4) THEN 'train' ELSE 'test' END AS role FROM f WHERE pos < least(n, (fold + 1) * (n // 4))"""

# ---- regimes and anomalies of the adaptive frame --------------------------------------------------------

_RULES = [
    (100, "PANIC", "coalesce(return_5, 0) <= -0.04", "least(1, abs(return_5 / -0.04))", "sharp negative five-period return"),
    (90, "LOW_LIQUIDITY", "coalesce(liquidity_score, 0) <= 0.15", "least(1, 1 - coalesce(liquidity_score, 0))", "liquidity score is depressed"),
    (80, "HIGH_VOLATILITY", "volatility_percentile >= 0.8", "least(1, volatility_percentile)", "volatility percentile is elevated"),
    (65, "BULLISH_REGIME", "trend_strength >= 0.3 AND return_5 > 0 AND rolling_sentiment_mean >= -0.1", "least(0.95, 0.45 + trend_strength)", "trend strength is high with positive returns"),
    (65, "BEARISH_REGIME", "trend_strength >= 0.3 AND return_5 < 0 AND rolling_sentiment_mean <= 0.1", "least(0.95, 0.45 + trend_strength)", "trend strength is high with negative returns"),
    (70, "RISK_ON", "risk_on_score > 0.65", "least(0.9, risk_on_score)", "risk-on score is dominant"),
    (75, "RISK_OFF", "risk_off_score > 0.65", "least(0.9, risk_off_score)", "risk-off score is dominant"),
    (55, "TRENDING", "trend_strength >= 0.25", "least(0.85, 0.35 + trend_strength)", "ADX-derived trend strength is above threshold"),
    (40, "SIDEWAYS", "true", "greatest(0.35, 1 - trend_strength)", "trend strength is low and price action is range-like"),
]
RULE_CTE = "rl AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT *, {p} AS prio, '{label}' AS regime, CAST({conf} AS DOUBLE) AS conf, '{why}' AS why FROM fin WHERE {cond}" for p, label, cond, conf, why in _RULES
) + ") q QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY prio DESC, conf DESC) = 1)"
ORACLES["rule_regimes"] = f"""{FULL}, {RULE_CTE} SELECT symbol, ts, regime, 'Market classified as ' || regime || ' because ' || why || '.' AS explanation,
  round(greatest(0.35, least(1, conf)), 4) + 0.0 AS confidence FROM rl"""


def grade(x: str) -> str:
    return f"CASE WHEN {x} >= 5 THEN 'EXTREME' WHEN {x} >= 3 THEN 'HIGH' ELSE 'MODERATE' END"


_HITS = [
    ("unusual_volume", "abs(unusual_volume_score)", "3", grade("abs(unusual_volume_score)"), "Volume is unusually far from its rolling baseline."),
    ("volatility_shock", "volatility_shock_score", "2.5", grade("volatility_shock_score"), "High-low range expansion indicates a volatility shock."),
    ("options_anomaly", "options_anomaly_score", "2.5", grade("options_anomaly_score"), "Options open-interest activity is unusually elevated."),
    ("liquidity_breakdown", "liquidity_breakdown_score", "0.75", grade("liquidity_breakdown_score"), "Liquidity score is materially below its normal range."),
    ("price_news_divergence", "sdiv", "0.35", "CASE WHEN sdiv < 0.65 THEN 'MODERATE' ELSE 'HIGH' END", "News sentiment and recent price direction are diverging."),
    ("price_volume_divergence", "abs(price_volume_divergence)", "0.08", "'MODERATE'", "Recent price movement conflicts with abnormal volume behavior."),
    ("fake_breakout_probability", "fake_breakout_probability", "0.5", "'MODERATE'", "Breakout lacks confirmation from follow-through and volume."),
]
ANOM = "an AS (" + " UNION ALL ".join(
    f"SELECT symbol, ts, '{kind}' AS anomaly_type, {sev} AS severity, '{text}' AS explanation, CAST({score} AS DOUBLE) AS score FROM fin WHERE {score} >= {limit}"
    for kind, score, limit, sev, text in _HITS) + ")"
ORACLES["anomaly_events"] = f"{FULL}, {ANOM} SELECT symbol, ts, anomaly_type, severity, explanation, round(score, 4) + 0.0 AS score FROM an"
ORACLES["anomaly_risk_levels"] = f"""{FULL}, {ANOM} SELECT symbol, ts, CASE WHEN bool_or(severity IN ('HIGH', 'EXTREME')) THEN 'HIGH' WHEN bool_or(severity = 'MODERATE') THEN 'MODERATE' ELSE 'LOW' END AS risk_level,
  count(*) AS anomalies FROM an GROUP BY 1, 2"""
ORACLES["trading_anomalies"] = f"""WITH RECURSIVE {TRADING}, {CONTEXT}, j AS (SELECT tf.*, coalesce(ns, 0) AS ns, abs(call_oi_change) + abs(put_oi_change) AS shift FROM tf LEFT JOIN nw USING (symbol) LEFT JOIN oc ON tf.symbol = oc.symbol)
SELECT symbol, ts, 'unusual_volume' AS anomaly_type, 'MODERATE' AS severity, round(volume_ratio, 2) + 0.0 AS score FROM j WHERE volume_ratio >= 2.5
UNION ALL SELECT symbol, ts, 'volatility_spike', 'HIGH', round(atr_pct, 2) + 0.0 FROM j WHERE atr_pct >= 0.04
UNION ALL SELECT symbol, ts, 'price_news_divergence', 'MODERATE', round(abs(ns), 2) + 0.0 FROM j WHERE abs(ns) >= 0.65 AND returns * ns < 0
UNION ALL SELECT symbol, ts, 'unusual_options_activity', 'MODERATE', round(shift, 2) + 0.0 FROM j WHERE shift >= 1000000"""

# ---- latest decisions ------------------------------------------------------------------------------------

_LATE = f"""tl AS (SELECT tf.*, ns, nc, pcr AS opcr, call_oi_change, put_oi_change, iv AS oiv FROM tf LEFT JOIN nw USING (symbol) LEFT JOIN oc ON tf.symbol = oc.symbol
   QUALIFY row_number() OVER (PARTITION BY tf.symbol ORDER BY tf.ts DESC) = 1)"""
ORACLES["live_regimes"] = f"""{adaptive(False, False, False)}, a0 AS (SELECT symbol, ts, pos, "close", coalesce(ema_slope_12, 0) AS sl, macd_histogram AS mh, adx_14, coalesce(bb_width, 0) AS bw, atr_14,
   coalesce(realized_vol_20, 0) AS rv FROM fin),
la AS (SELECT * FROM a0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1),
rk AS (SELECT a0.symbol, count(*) FILTER (a0.atr_14 < la.atr_14) AS ls, count(*) FILTER (a0.atr_14 = la.atr_14) AS eq, count(*) AS n FROM a0 JOIN la ON a0.symbol = la.symbol GROUP BY 1),
wd AS (SELECT symbol, median(bw) AS med FROM (SELECT * FROM a0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 40) q GROUP BY 1),
j AS (SELECT la.*, med, (ls + (eq + 1) / 2.0) / n AS share, atr_14 / greatest("close", 1e-9) AS ap, bw <= greatest(med * 1.1, 0.04) AS small FROM la JOIN rk ON la.symbol = rk.symbol JOIN wd ON la.symbol = wd.symbol),
k AS (SELECT *, share >= 0.85 OR rv >= 0.035 OR ap >= 0.03 OR (med > 0 AND bw > med * 1.8) AS hv, adx_14 < 18 AND abs(sl) < 0.001 AND (med = 0 OR small) AS side FROM j)
SELECT symbol, ts, CASE WHEN hv THEN 'HIGH_VOLATILITY' WHEN NOT side AND ((adx_14 >= 25 AND NOT small) OR (abs(sl) >= 0.001 AND abs(mh) > 0)) THEN 'TRENDING' ELSE 'SIDEWAYS' END AS regime,
  round(share, 4) + 0.0 AS atr_percentile FROM k"""
ORACLES["feature_quality_report"] = f"""WITH {BASE}, l AS (SELECT symbol, max(ts) AS ts, count(*) AS rows FROM b1 GROUP BY 1)
SELECT symbol, ts, rows, epoch(TIMESTAMP '2001-11-05 00:10:00' - ts) > 1800 AS stale_inputs, rows >= 30 AS enough_history, '' AS missing_features,
  array_to_string(list_filter([CASE WHEN rows < 30 THEN 'Fewer than 30 candles are available.' END, CASE WHEN epoch(TIMESTAMP '2001-11-05 00:10:00' - ts) > 1800 THEN 'Latest candle is stale.' END,
   'Sentiment input is missing.', 'Options-chain input is missing.'], lambda x: x IS NOT NULL), '|') AS warnings FROM l"""
ORACLES["training_targets"] = f"""{adaptive(False, False, False)}, z AS (SELECT *, {mp('avg', '"close"', 20, 2)} AS m20, {mp('stddev_pop', '"close"', 20, 2)} AS s20,
   lead("close", 5) OVER ({W}) / "close" - 1 AS fut, coalesce(volatility_percentile, 0) AS vp, coalesce(liquidity_score, 0) AS liq FROM fin)
SELECT symbol, ts, CASE WHEN fut IS NULL THEN NULL WHEN fut > 0.005 THEN 'up' WHEN fut < -0.005 THEN 'down' ELSE 'sideways' END AS directional,
  CASE WHEN coalesce(return_5, 0) <= -0.04 THEN 'PANIC' WHEN vp >= 0.8 THEN 'HIGH_VOLATILITY' WHEN liq <= 0.25 THEN 'LOW_LIQUIDITY' WHEN trend_strength >= 0.3 AND return_20 > 0 THEN 'BULLISH_REGIME'
   WHEN trend_strength >= 0.3 AND return_20 < 0 THEN 'BEARISH_REGIME' WHEN trend_strength >= 0.25 THEN 'TRENDING' ELSE 'SIDEWAYS' END AS regime_target,
  CASE WHEN market_stress_score > 0.65 THEN 'risk_off' WHEN vp > 0.75 THEN 'volatility' WHEN trend_strength > 0.3 THEN 'momentum'
   WHEN abs(coalesce(("close" - m20) / nullif(s20, 0), 0)) > 1.2 OR trend_strength < 0.2 THEN 'mean_reversion' ELSE 'momentum' END AS suitability FROM z"""

_GROUP = {"t": "momentum|breakout|vwap|macd", "r": "rsi|reversion|bollinger", "g": "volatility|atr|sentiment|risk", "e": "normal|trend|breakout"}


def tok(g: str, f: str) -> str:
    return f"CASE WHEN regexp_matches(lower(strategy_name), '{_GROUP.get(g, g)}') THEN {f}e0 ELSE 1e0 END"


_NORM = "w / sum(w) OVER (PARTITION BY symbol, ts)"
_CAPN = "least(greatest(w, 0), 0.35e0) / sum(least(greatest(w, 0), 0.35e0)) OVER (PARTITION BY symbol, ts)"
SETTLED = """oc0 AS (SELECT symbol, regime, coalesce(returns, 0) AS r, lead(ts) OVER w AS ts, lead("close") OVER w / "close" - 1 AS gain FROM rl WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
oc1 AS (SELECT symbol, regime, ts, gain, unnest([{'n': 'MACD Momentum', 's': sign(r)::DOUBLE}, {'n': 'RSI Reversal', 's': -sign(r)::DOUBLE}, {'n': 'Breakout', 's': CASE WHEN abs(r) > 0.02 THEN sign(r)::DOUBLE END}]) AS u FROM oc0),
oc AS (SELECT symbol, regime, ts, u.n AS strategy_name, u.s * gain AS realized FROM oc1 WHERE u.s * gain IS NOT NULL AND ts IS NOT NULL),
perf AS (SELECT symbol, regime, strategy_name, ts, count(*) OVER w AS n, sum((realized > 0)::INT) OVER w / count(*) OVER w AS accuracy, sum(realized) OVER w / count(*) OVER w AS avg_return,
   min(least(realized, 0)) OVER w AS worst FROM oc WINDOW w AS (PARTITION BY symbol, regime, strategy_name ORDER BY ts ROWS UNBOUNDED PRECEDING))"""
ORACLES["settled_performance"] = f"""{FULL}, {RULE_CTE}, {SETTLED}, asked AS (SELECT symbol, ts, regime, unnest(['MACD Momentum', 'RSI Reversal', 'Breakout']) AS strategy_name FROM rl)
SELECT a.symbol, a.ts, a.regime, a.strategy_name, p.n AS sample_size, round(p.accuracy, 4) + 0.0 AS accuracy, round(p.avg_return, 4) + 0.0 AS avg_return, round(p.worst, 4) + 0.0 AS max_drawdown
FROM asked a ASOF JOIN perf p ON a.symbol = p.symbol AND a.regime = p.regime AND a.strategy_name = p.strategy_name AND a.ts >= p.ts"""
ORACLES["adaptive_strategy_weights"] = f"""{FULL}, {RULE_CTE}, {SETTLED},
q0 AS (SELECT symbol, ts, regime, greatest(0.35, least(1, conf)) AS rc, rolling_sentiment_mean AS sn, coalesce(volatility_percentile, 0) AS vs, volatility_shock_score >= 3 AS hot,
   unnest([{{'n': 'MACD Momentum', 'w': 0.4e0}}, {{'n': 'RSI Reversal', 'w': 0.3e0}}, {{'n': 'ATR Volatility System', 'w': 0.2e0}}, {{'n': 'Breakout', 'w': 0.1e0}}, {{'n': 'Risk Parity', 'w': 0.3e0}}]) AS u FROM rl),
q1 AS (SELECT * EXCLUDE (u), u.n AS strategy_name, u.w AS w FROM q0),
q2 AS (SELECT * REPLACE ({_CAPN} AS w) FROM q1),
qp AS (SELECT q.* REPLACE (q.w * CASE WHEN p.n >= 10 THEN (0.6e0 + p.accuracy) * greatest(0.3, 1 + p.avg_return - abs(p.worst)) ELSE 1 END AS w)
   FROM (SELECT q2.* REPLACE (w * CASE WHEN regime IN ('TRENDING','BULLISH_REGIME','RISK_ON') THEN {tok('t', '1.25')} * {tok('r', '0.8')} WHEN regime = 'SIDEWAYS' THEN {tok('r', '1.25')} * {tok('breakout', '0.75')}
   WHEN regime IN ('PANIC','RISK_OFF','HIGH_VOLATILITY') THEN {tok('g', '1.2')} * {tok('e', '0.75')} ELSE 1 END * CASE WHEN hot THEN CASE WHEN regexp_matches(lower(strategy_name), 'risk|volatility') THEN 1.15e0 ELSE 0.9e0 END ELSE 1 END AS w) FROM q2) q
   ASOF LEFT JOIN perf p ON q.symbol = p.symbol AND q.regime = p.regime AND q.strategy_name = p.strategy_name AND q.ts >= p.ts),
q4 AS (SELECT * REPLACE ({_CAPN} AS w) FROM qp),
q5 AS (SELECT *, regime IN ('TRENDING','BULLISH_REGIME') AND sn > 0.1 AND vs < 0.75 AS up, regime = 'SIDEWAYS' AS flat, regime IN ('PANIC','RISK_OFF') OR hot AS stress FROM q4),
q6 AS (SELECT * REPLACE (w * CASE WHEN up THEN {tok('t', '1.15')} ELSE 1 END * CASE WHEN flat THEN {tok('r', '1.15')} ELSE 1 END * CASE WHEN stress THEN {tok('g', '1.2')} * {tok('breakout|momentum', '0.75')} ELSE 1 END AS w) FROM q5),
q7 AS (SELECT * REPLACE ({_NORM} AS w) FROM q6),
q8 AS (SELECT * REPLACE ({_CAPN} AS w) FROM q7)
SELECT symbol, ts, strategy_name, CASE WHEN NOT up AND NOT flat AND NOT stress THEN 'Weights preserved because no strong adaptive adjustment condition was triggered.' ELSE
  array_to_string(list_filter([CASE WHEN up THEN 'momentum strategies increased because regime is trending, sentiment is supportive, and volatility is not extreme' END,
   CASE WHEN flat THEN 'mean-reversion strategies increased because market is classified as sideways' END,
   CASE WHEN stress THEN 'risk-control and volatility-aware strategies increased because stress or high-severity anomalies are present' END], lambda x: x IS NOT NULL), '. ') END AS reason,
  round(w, 4) + 0.0 AS weight, round(least(0.9, 0.45 + rc * 0.35 + least(abs(sn), 0.5) * 0.2), 4) + 0.0 AS weight_confidence FROM q8"""

# ---- news ---------------------------------------------------------------------------------------------------

_NT = r"regexp_replace(lower(trim(regexp_replace({x}, '\s+', ' ', 'g'))), 'ß', 'ss', 'g')"
ARTICLES = f"""ar AS (SELECT doc_id AS id, source, lang, n_chars, 'https://www.example.com/news/' || source || '/' || n_chars AS url,
   trim(regexp_replace(string_split(text, chr(10))[1], '[ \\t]+', ' ', 'g')) AS title, {_NT.format(x='text')} AS body, text FROM documents),
ah AS (SELECT *, sha256(url) AS url_hash, sha256(CASE WHEN body = '' THEN {_NT.format(x="title")} ELSE body END) AS content_hash FROM ar)"""
ORACLES["news_articles"] = f"WITH {ARTICLES} SELECT id, url, url_hash, content_hash, sha256({_NT.format(x="title || ' ' || text")}) AS semantic_hash, lang || '|' || source AS tags, lang AS language, length(title) AS title_len FROM ah"
GREEDY = f"""{ARTICLES}, o AS (SELECT *, row_number() OVER (ORDER BY id) AS i FROM ah),
go(i, us, cs, kept) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], NULL::BIGINT
  UNION ALL SELECT o.i, CASE WHEN list_contains(us, url_hash) OR list_contains(cs, source || content_hash) THEN us ELSE list_append(us, url_hash) END,
   CASE WHEN list_contains(us, url_hash) OR list_contains(cs, source || content_hash) THEN cs ELSE list_append(cs, source || content_hash) END,
   CASE WHEN list_contains(us, url_hash) OR list_contains(cs, source || content_hash) THEN NULL ELSE o.id END FROM go JOIN o ON o.i = go.i + 1)"""
ORACLES["news_exact_dedupe"] = f"WITH RECURSIVE {GREEDY} SELECT id, source, url_hash FROM ah WHERE id IN (SELECT kept FROM go)"
ORACLES["stream_news_table"] = ORACLES["news_exact_dedupe"]
_EDGE = r"[^\p{L}\p{N}_]"
ORACLES["news_event_types"] = "SELECT doc_id, CASE " + " ".join(
    f"WHEN regexp_matches(text, '(?i)(^|{_EDGE})({words})($|{_EDGE})') THEN '{name}'"
    for name, words in (("first", "with|der"), ("second", "les|que"), ("third", "para"))) + " END AS event_type FROM documents"
ORACLES["news_latest"] = f"WITH {DOCS} SELECT doc_id AS id, ts AS scraped_at FROM docs WHERE contains(upper(text), 'TION') ORDER BY ts DESC, doc_id DESC LIMIT 20"
ORACLES["news_pending"] = f"""WITH {DOCS} SELECT doc_id AS id, ts AS scraped_at, CAST(NULL AS TIMESTAMP) AS published_at, false AS semantic_duplicate FROM docs
WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY ts, doc_id LIMIT 50"""
ORACLES["news_enriched"] = f"""WITH {DOCS}, b AS (SELECT text, arg_max(sentiment, doc_id) AS s, arg_max(sentiment_score, doc_id) AS v FROM docs GROUP BY text)
SELECT doc_id, s AS sentiment, v AS sentiment_score FROM docs JOIN b USING (text)"""
ORACLES["news_merge"] = f"""WITH {ARTICLES}, both_ AS (SELECT 0 AS l, id, title, CASE WHEN id % 3 = 0 THEN '#' ELSE url END AS url FROM ah UNION ALL SELECT 1, id, title, url FROM ah)
SELECT id, url FROM both_ QUALIFY row_number() OVER (PARTITION BY CASE WHEN url <> '#' THEN url ELSE lower(title) END ORDER BY l, id) = 1"""
ORACLES["news_stored_duplicates"] = f"""WITH {ARTICLES}, b AS (SELECT * FROM ah WHERE lang IN ('de', 'es')), s AS (SELECT * FROM ah WHERE lang NOT IN ('de', 'es'))
SELECT id, CASE WHEN url_hash IN (SELECT url_hash FROM s) THEN 'url_hash' WHEN (source, content_hash) IN (SELECT (source, content_hash) FROM s) THEN 'content_hash' END AS duplicate_reason FROM b"""
_VIS = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g')"


def plain(x: str) -> str:
    out = rf"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    for a, b in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    return rf"nullif(trim(regexp_replace({out}, '\s+', ' ', 'g')), '')"


_AN = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)["'']?[^>]*>(.*?)</a\s*>"""
ORACLES["html_links"] = rf"""WITH v AS (SELECT page_id, url, regexp_extract_all({_VIS}, '{_AN}', 1) AS hs, regexp_extract_all({_VIS}, '{_AN}', 2) AS ts FROM pages),
l AS (SELECT page_id, url, unnest(range(0, len(hs))) AS position, hs, ts FROM v),
m AS (SELECT page_id, position, hs[position + 1] AS href, {plain('ts[position + 1]')} AS title, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS root FROM l),
n AS (SELECT *, root || coalesce(nullif(regexp_replace(regexp_replace(href, '[?#].*$', ''), '/+$', ''), ''), '/') AS link FROM m)
SELECT page_id, position, href, title, link, lower(link) NOT SIMILAR TO '.*(/video|/photos|/live-tv|/podcast|/author/).*' AND
  (contains(lower(regexp_replace(link, '^[a-z]+://[^/]*', '')), '/news/') OR ends_with(lower(link), '.html') OR regexp_matches(regexp_replace(link, '^[a-z]+://[^/]*', ''), '[0-9]')) AS is_article
FROM n WHERE title IS NOT NULL"""
ORACLES["html_urls"] = r"""WITH n AS (SELECT page_id, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))
   || coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') AS u, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
   lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS path FROM pages)
SELECT page_id, u AS url, host AS source, NOT regexp_matches(path, '/video|/photos|/live-tv|/podcast|/author/') AND (contains(path, '/news/') OR ends_with(path, '.html') OR regexp_matches(path, '[0-9]')) AS is_article,
  sha256(u) AS url_hash FROM n"""

# ---- events, memory ---------------------------------------------------------------------------------------------

ENV = """ev AS (SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'market.ohlcv.raw' WHEN 'view' THEN 'news.raw' WHEN 'purchase' THEN 'market.options.raw'
   WHEN 'signup' THEN 'features.generated' ELSE 'system.health' END AS kind, 'feed' || (user_id % 7) AS source, ts, upper(event_type) AS symbol, CAST(user_id AS VARCHAR) AS correlation_id, value AS v,
   CAST(props->>'$.k' AS DOUBLE) AS k FROM events),
p AS (SELECT *, v AS o, v + 20 - k / 2 AS h, CASE WHEN k > 3 THEN v - 1 END AS l, kind IN ('market.ohlcv.raw', 'features.generated') AS bar,
   CASE WHEN kind = 'news.raw' THEN k / 100 ELSE 0.85e0 END AS rel FROM ev),
qy AS (SELECT *, list_filter([CASE WHEN bar AND l IS NULL THEN 'missing low' END,
   CASE WHEN bar AND l IS NOT NULL AND least(o, h, l) <= 0 THEN 'invalid non-positive price' END,
   CASE WHEN bar AND l IS NOT NULL AND h < greatest(o, l) THEN 'invalid OHLC candle: high below price component' END,
   CASE WHEN bar AND l IS NOT NULL AND l > least(o, h) THEN 'invalid OHLC candle: low above price component' END,
   CASE WHEN bar AND l IS NOT NULL AND k - 2 < 0 THEN 'invalid negative volume' END,
   CASE WHEN kind = 'market.options.raw' AND v - 2 < 0 THEN 'invalid negative PCR' END, CASE WHEN kind = 'market.options.raw' AND k - 4 < 0 THEN 'invalid negative IV' END,
   CASE WHEN kind = 'news.raw' AND k <= 10 THEN 'missing empty news headline' END,
   CASE WHEN ts > TIMESTAMP '2024-01-30 12:00:00' THEN 'event timestamp is in the future' END, CASE WHEN rel < 0.4 THEN 'low source reliability' END], lambda x: x IS NOT NULL) AS issues FROM p),
ck AS (SELECT *, CASE WHEN len(list_filter(issues, lambda x: contains(x, 'invalid') OR contains(x, 'missing'))) > 0 THEN 'FAIL' WHEN len(issues) > 0 THEN 'WARN' ELSE 'PASS' END AS quality_status FROM qy)"""
ORACLES["quality_events"] = f"WITH {ENV} SELECT event_id, kind AS event_type, array_to_string(issues, '|') AS issues, quality_status, round(least(greatest(rel, 0), 1), 4) + 0.0 AS source_reliability_score FROM ck"
ORACLES["event_dead_letters"] = f"""WITH {ENV} SELECT 'dead-' || event_id AS event_id, 'system.dead_letter' AS event_type, correlation_id, kind AS original_topic, array_to_string(issues, '; ') AS error, false AS retryable, ts, source, symbol, 'dead-' || event_id AS original_id
FROM ck WHERE quality_status = 'FAIL'"""
ORACLES["event_round_trip"] = f"WITH {ENV} SELECT event_id, kind AS event_type, source, ts, symbol, correlation_id, CAST(NULL AS VARCHAR) AS error FROM ev"
ORACLES["stream_event_routing"] = f"WITH {ENV} SELECT kind AS event_type, CASE WHEN quality_status = 'FAIL' THEN 'dead' ELSE 'clean' END AS side, quality_status, count(*) AS n FROM ck GROUP BY 1, 2, 3"
ORACLES["quality_bar_rules"] = f"""WITH {BASE} SELECT symbol, ts, high >= greatest(open, low, "close") AND low <= least(open, high, "close") AND volume >= 0 AS valid, "close" <= 0 OR "close" > 1e7 AS impossible,
  coalesce(CASE WHEN pc <= 0 THEN true ELSE abs("close" / pc - 1) > 0.4 END, false) AS extreme FROM b1"""
ORACLES["quality_missing_and_fresh"] = f"""WITH {ENV}, a AS (SELECT *, epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(ts) AS age FROM ev)
SELECT event_id, CASE WHEN seq % 5 = 0 THEN 'symbol' ELSE '' END AS missing, age > 3600000000 AS stale, CASE WHEN age <= 900000000 THEN 'FRESH' WHEN age <= 3600000000 THEN 'STALE' ELSE 'EXPIRED' END AS freshness FROM a"""
ORACLES["source_reliability"] = f"""WITH RECURSIVE {ENV}, s AS (SELECT source, seq, quality_status <> 'FAIL' AS passed, row_number() OVER (PARTITION BY source ORDER BY seq) AS i FROM ck),
ws AS (SELECT source, list(passed ORDER BY i) AS ps, list(seq ORDER BY i) AS qs FROM s GROUP BY 1),
wk(source, i, b, a) AS (SELECT source, 1, 0.85e0, CASE WHEN ps[1] THEN least(1e0, 0.85e0 + 0.02e0) ELSE greatest(0e0, 0.85e0 - 0.08e0) END FROM ws
  UNION ALL SELECT wk.source, i + 1, a, CASE WHEN ps[i + 1] THEN least(1e0, a + 0.02e0) ELSE greatest(0e0, a - 0.08e0) END FROM wk JOIN ws ON wk.source = ws.source WHERE i < len(ps))
SELECT wk.source, qs[i] AS seq, ps[i] AS passed, round(b, 4) + 0.0 AS score_before, round(a, 4) + 0.0 AS score_after FROM wk JOIN ws ON wk.source = ws.source"""
ORACLES["stream_source_reliability"] = ORACLES["source_reliability"]
LIFE = """lf AS (SELECT CAST(user_id AS VARCHAR) AS correlation_id, event_id AS seq, CAST(props->>'$.k' AS INT) AS k,
   ['CREATED','DATA_COLLECTED','FEATURES_READY','REGIME_READY','STRATEGIES_READY','ENSEMBLE_READY','RISK_READY','FINALIZED','FAILED'][CAST(props->>'$.k' AS INT) % 9 + 1] AS state FROM events)"""
ORACLES["lifecycle_states"] = f"""WITH {LIFE}, g AS (SELECT correlation_id, arg_max(state, seq) AS state, list_sort(list(DISTINCT state) FILTER (state NOT IN ('CREATED', 'FAILED'))) AS done, count(*) AS events,
   'code ' || arg_max(k, seq) FILTER (state = 'FAILED') AS error FROM lf GROUP BY 1),
h AS (SELECT *, list_filter(['DATA_COLLECTED','FEATURES_READY','REGIME_READY','STRATEGIES_READY','ENSEMBLE_READY','RISK_READY'], lambda x: NOT list_contains(coalesce(done, []), x)) AS miss FROM g)
SELECT correlation_id, state, array_to_string(coalesce(done, []), '|') AS completed, array_to_string(miss, '|') AS missing, len(miss) = 0 AS ready, events, error FROM h"""
ORACLES["stream_lifecycle_states"] = ORACLES["lifecycle_states"]
ORACLES["live_lifecycle_states"] = f"""WITH {LIFE}, tm AS (SELECT lf.*, e.ts FROM lf JOIN events e ON e.event_id = lf.seq),
gp AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS cut FROM tm WINDOW w AS (PARTITION BY correlation_id ORDER BY ts, seq)),
sn AS (SELECT *, sum(cut) OVER (PARTITION BY correlation_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS session, (SELECT max(ts) FROM events) AS latest FROM gp),
ss AS (SELECT correlation_id, session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events, arg_max(state, seq) AS state, max(session) OVER (PARTITION BY correlation_id) AS newest, any_value(latest) AS latest,
   list_sort(list(DISTINCT state) FILTER (state NOT IN ('CREATED', 'FAILED'))) AS done, 'code ' || arg_max(k, seq) FILTER (state = 'FAILED') AS error FROM sn GROUP BY 1, 2)
SELECT correlation_id, first_ts, last_ts, CASE WHEN session < newest OR last_ts + INTERVAL 12 HOUR < latest - INTERVAL 1 MINUTE THEN 'EXPIRED' ELSE state END AS state,
  array_to_string(coalesce(done, []), '|') AS completed, events, error FROM ss"""
ORACLES["lifecycle_counts"] = f"WITH {LIFE} SELECT state, count(*) AS n FROM lf GROUP BY 1"
FEED = """fb AS (SELECT event_id AS seq, event_type AS strategy_name, CAST(props->>'$.k' AS DOUBLE) AS k, (value - 20) / 100 AS rr, value / 500 AS mae FROM events),
fr AS (SELECT *, CASE WHEN k < 40 THEN 1 WHEN k < 80 THEN -1 ELSE 0 END * rr AS g FROM fb),
fw AS (SELECT *, g - abs(mae) * 0.5e0 - CASE WHEN g < 0 AND k / 100 > 0.65e0 THEN 0.02e0 ELSE 0 END + CASE WHEN g > 0 AND k / 100 > 0.65e0 THEN 0.01e0 ELSE 0 END AS reward FROM fr)"""
ORACLES["rewards"] = f"WITH {FEED} SELECT seq, strategy_name, round(reward, 5) + 0.0 AS reward FROM fw"
ORACLES["bandit_scores"] = f"""WITH {FEED}, s AS (SELECT strategy_name, count(*) AS n, avg(reward) AS m FROM fw GROUP BY 1)
SELECT strategy_name, n, round(m, 5) + 0.0 AS mean_reward, round(m + sqrt(2 * ln(sum(n) OVER () + 1) / n), 5) + 0.0 AS score FROM s"""
ORACLES["stream_bandit_scores"] = ORACLES["bandit_scores"]
OUT = """oo AS (SELECT event_type AS strategy_name, 'u' || (user_id % 10) AS symbol, ['trending', 'sideways', 'panic', 'unknown'][CAST(props->>'$.k' AS INT) % 4 + 1] AS regime,
   CASE WHEN CAST(props->>'$.k' AS INT) % 10 = 0 THEN 'PENDING' WHEN value > 15 THEN 'WIN' WHEN value < 5 THEN 'LOSS' ELSE 'NEUTRAL' END AS result, value - 15 AS pnl, event_id AS seq FROM events),
pf AS (SELECT strategy_name, symbol, regime, round(avg(CASE WHEN result = 'WIN' THEN 1e0 ELSE 0 END), 6) AS accuracy, round(avg(pnl), 6) AS avg_return, count(*) AS sample_size, max(seq) AS seq
   FROM oo WHERE result <> 'PENDING' GROUP BY 1, 2, 3)"""
ORACLES["recent_win_ratio"] = f"""WITH {OUT} SELECT strategy_name, round(avg(CASE WHEN result = 'WIN' THEN 1e0 ELSE 0 END), 4) AS win_ratio FROM (SELECT * FROM oo WHERE result <> 'PENDING'
   QUALIFY row_number() OVER (PARTITION BY strategy_name ORDER BY seq DESC) <= 100) q GROUP BY 1"""
ORACLES["best_strategy_by_regime"] = f"""WITH {OUT} SELECT regime, strategy_name, sample_size, round(accuracy, 4) AS accuracy FROM pf
QUALIFY row_number() OVER (PARTITION BY regime ORDER BY accuracy DESC, avg_return DESC, sample_size DESC, seq) = 1"""
ORACLES["memory_lookup"] = f"WITH {OUT} SELECT strategy_name, symbol, regime, sample_size, round(accuracy, 4) AS accuracy FROM pf WHERE symbol = 'u3' AND regime = 'trending'"
JUDGE = f"{DOCS}, jd AS (SELECT symbol, CASE WHEN quality = 1 THEN 'bullish' ELSE 'bearish' END AS label, sentiment AS prediction, quality FROM docs JOIN labels USING (doc_id))"
ORACLES["sentiment_accuracy"] = f"WITH {JUDGE} SELECT symbol, round(avg(CASE WHEN (prediction = 'bullish') = (quality = 1) THEN 1e0 ELSE 0 END), 4) AS accuracy FROM jd GROUP BY 1"
ORACLES["confusion_matrix"] = f"WITH {JUDGE} SELECT label, prediction, count(*) AS n FROM jd GROUP BY 1, 2"
ORACLES["classification_report"] = f"""WITH {JUDGE}, cl AS (SELECT DISTINCT symbol, label AS x FROM jd UNION SELECT DISTINCT symbol, prediction FROM jd),
m AS (SELECT cl.symbol, x, count(*) FILTER (label = x AND prediction = x) AS hit, count(*) FILTER (label = x) AS act, count(*) FILTER (prediction = x) AS said FROM cl JOIN jd USING (symbol) GROUP BY 1, 2),
n AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(act, 0), 0) AS rc FROM m)
SELECT symbol, round(sum(hit) / sum(act), 4) AS accuracy, round(avg(p), 4) AS precision_macro, round(avg(rc), 4) AS recall_macro, round(avg(coalesce(2 * p * rc / nullif(p + rc, 0), 0)), 4) AS f1_macro FROM n GROUP BY 1"""
ORACLES["latency_report"] = 'SELECT event_type AS name, count(*) AS "count", round(sum(value), 3) AS total, round(avg(value), 3) AS avg_seconds FROM events GROUP BY 1'
MODELS = """mv AS (SELECT 'm' || (user_id % 40) AS model_name, event_id AS model_version, ts, CAST(props->>'$.k' AS DOUBLE) / 100 AS acc, event_type = 'purchase' AS act FROM events)"""
ORACLES["model_registry"] = f"""WITH {MODELS}, n AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY ts DESC) AS i FROM mv)
SELECT model_name, coalesce(arg_max(model_version, ts) FILTER (act), arg_min(model_version, ts)) AS active, max(model_version) FILTER (i = 2) AS previous FROM n GROUP BY 1"""
ORACLES["retraining_due"] = f"WITH {MODELS} SELECT model_name, model_version, acc < 0.52e0 OR ts < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 14 DAY AS retrain FROM mv"
ORACLES["quotes_as_bars"] = """WITH q AS (SELECT upper(event_type) AS symbol, ts, value AS v, CAST(props->>'$.k' AS INT) AS k FROM events),
a AS (SELECT *, CASE WHEN k % 7 = 0 OR v = 0 THEN coalesce(nullif(v + 1, 0), 0) ELSE v END AS cl FROM q)
SELECT symbol, ts, coalesce(nullif(CASE WHEN k % 5 = 0 THEN 0 ELSE v - 0.5e0 END, 0), cl) AS open, coalesce(nullif(CASE WHEN k % 3 <> 0 THEN v + 2 END, 0), cl) AS high,
  coalesce(nullif(v - 2, 0), cl) AS low, cl AS "close", CAST(CASE WHEN k % 2 = 0 THEN k ELSE 0 END AS DOUBLE) AS volume, 'NSEPython' AS source FROM a"""

# ---- vectors -------------------------------------------------------------------------------------------------------

SIM = """vx AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sm AS (SELECT a.id, b.id AS other, round(least(greatest(list_cosine_similarity(a.e, b.e), 0), 1), 6) AS s FROM vx a, vx b)"""
ORACLES["vector_top5"] = f"""WITH {SIM}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS rank FROM sm) SELECT id, other AS match, rank, round(s, 6) + 0.0 AS similarity FROM k WHERE rank <= 5"""
ORACLES["vector_top3_scaled"] = f"""WITH {SIM}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS rank FROM sm) SELECT id, other AS match, rank, round(s, 6) + 0.0 AS similarity FROM k WHERE rank <= 3"""
GREEDYV = f"""{SIM}, cf AS (SELECT vx.id, coalesce(list(other) FILTER (s > 0.4 AND other < vx.id), []) AS cs FROM vx JOIN sm ON sm.id = vx.id GROUP BY 1),
og AS (SELECT *, row_number() OVER (ORDER BY id) AS i FROM cf),
gv(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT og.i, CASE WHEN list_has_any(kept, cs) THEN kept ELSE list_append(kept, og.id) END FROM gv JOIN og ON og.i = gv.i + 1),
kp AS (SELECT unnest(kept) AS id FROM gv WHERE i = (SELECT max(i) FROM gv))"""
ORACLES["vector_dedupe"] = f"WITH RECURSIVE {GREEDYV} SELECT id FROM kp"
ORACLES["stream_vector_table"] = ORACLES["vector_dedupe"]
ORACLES["vector_duplicate_matches"] = f"""WITH RECURSIVE {GREEDYV} SELECT sm.id, other AS matched_id, round(s, 6) + 0.0 AS similarity FROM sm WHERE sm.id NOT IN (SELECT id FROM kp) AND other IN (SELECT id FROM kp) AND other < sm.id
QUALIFY row_number() OVER (PARTITION BY sm.id ORDER BY s DESC, other) = 1"""

# ---- compositions ----------------------------------------------------------------------------------------------------

ORACLES["final_signals"] = f"""WITH RECURSIVE {TRADING}, {CONTEXT}, {_LATE}, {REGIME.replace("FROM tf)", "FROM tl)")},
{voted("rg", _FIN % ("ns", "nc", NL, "rg"))}, {RISK}
SELECT symbol, ts, regime, suggested_action, final_action, risk_level, round(pb, 4) + 0.0 AS bullish_probability, round(ps, 4) + 0.0 AS bearish_probability FROM rk"""
_ACC = ("list_transform(list_zip(w, nms), lambda z: z[1] * coalesce(list_filter(acl, lambda q: q.n = z[2])[1].f, 1e0))")
ORACLES["accuracy_weighted_votes"] = f"""WITH RECURSIVE {TRADING}, {REGIME}, {TRADES.replace("sg AS", "sg0 AS").replace("FROM sg JOIN tf ON sg.symbol = tf.symbol AND sg.ts = tf.ts", "FROM sg0 AS sg JOIN tf ON sg.symbol = tf.symbol AND sg.ts = tf.ts")},
ac AS (SELECT td.symbol, regime, td.strategy_name AS n, round(avg(CASE WHEN rz > 0 THEN 1.0 ELSE 0 END), 4) AS a, count(*) AS k FROM td JOIN rg ON td.symbol = rg.symbol AND td.ts = rg.ts GROUP BY 1, 2, 3),
al AS (SELECT symbol, regime, list({{'n': n, 'f': CASE WHEN k >= 10 THEN least(greatest(0.75e0 + a, 0.6e0), 1.35e0) ELSE 1e0 END}}) AS acl FROM ac GROUP BY 1, 2),
rga AS (SELECT rg.*, coalesce(acl, []) AS acl FROM rg LEFT JOIN al USING (symbol, regime)),
{voted("rga", _FIN % ("0", "0", "'neutral'", "rga"), _ACC)}
SELECT symbol, ts, confidence, suggested_action, round(pb, 4) + 0.0 AS bullish_probability, round(ps, 4) + 0.0 AS bearish_probability FROM vt"""
ORACLES["strategy_mixes"] = f"""WITH RECURSIVE {TRADING}, {signals_cte([s for s in STRATS if s[0] in ("Breakout", "SuperTrend", "RSI Reversal")])},
cf AS (SELECT * FROM (VALUES ('trend', 'Breakout', 0.4e0), ('trend', 'SuperTrend', 0.3e0), ('revert', 'RSI Reversal', 0.45e0), ('revert', 'Breakout', 0.1e0)) v(config, strategy_name, weight))
SELECT symbol, ts, config, strategy_name, signal, weight FROM sg JOIN cf USING (strategy_name)"""
ORACLES["news_matching_or_all"] = """WITH d AS (SELECT doc_id, upper(string_split(text, chr(10))[1]) AS t FROM documents)
SELECT doc_id, 'der' AS word FROM d WHERE contains(t, 'DER') UNION ALL SELECT doc_id, 'qqqq' FROM d"""
ORACLES["stream_correlated_events"] = """SELECT CAST(a.user_id AS VARCHAR) AS correlation_id, a.ts AS raw_ts, b.ts AS ts FROM events a JOIN events b ON a.user_id = b.user_id
  AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR"""

# News and option chains are those of the last bar, so only that bar is judged with them.
_LAST_BARS = "(SELECT l_returnflag || l_linestatus AS symbol, CAST(max(date_trunc('day', l_shipdate)) AS TIMESTAMP) AS ts FROM lineitem GROUP BY 1)"
for _name in ("strategy_signals_context", "trading_anomalies"):
    ORACLES[_name] = f"SELECT q.* FROM ({ORACLES[_name]}) q JOIN {_LAST_BARS} l ON q.symbol = l.symbol AND q.ts = l.ts"

ORACLES["isolation_summary"] = f"WITH {BARS} SELECT symbol, count(*) AS rows, true AS bounded, true AS severity_fits, true AS share_fits FROM bars GROUP BY 1 HAVING count(*) >= 40"
ORACLES["html_headlines"] = f"""WITH l AS ({ORACLES["html_links"]})
SELECT page_id, position, length(repeat(title, 4)) BETWEEN 35 AND 220 AND NOT regexp_matches(lower(repeat(title, 4)), 'subscribe|download app|follow us|sign in|watch live') AS headline FROM l"""
_MOVED = "FROM (SELECT page_id, url, replace(html, 'href=\"/', 'href=\"/news/') AS html FROM pages) pages"
ORACLES["html_candidates"] = f"""WITH l AS ({ORACLES["html_links"].replace("FROM pages", _MOVED)}), w AS (
  SELECT page_id AS page, link AS url, min(position) AS position, arg_max(title, position) AS title FROM l WHERE is_article AND length(title) >= 2 GROUP BY 1, 2)
SELECT page, url, position, title, row_number() OVER (PARTITION BY page ORDER BY position) AS rank FROM w"""
ORACLES["news_valid"] = f"WITH {ARTICLES} SELECT id FROM ah WHERE length(title) >= 8"
ORACLES["news_embedding_texts"] = f"""WITH {ARTICLES}, j AS (SELECT id, {_NT.format(x="title || ' ' || text")} AS t FROM ah) SELECT id, sha256(t) AS digest, sha256(t) AS semantic_hash FROM j"""
ORACLES["parsed_dates"] = "SELECT event_id, date_trunc('second', ts) AS ts FROM events"
ORACLES["bar_files"] = f"""WITH {BARS} SELECT symbol, ts, 'kaggle_ohlcv' AS source, open, high, low, "close", CAST(volume AS DOUBLE) AS volume FROM bars"""
ORACLES["preliminary_risk"] = f"""WITH RECURSIVE {TRADING} SELECT symbol, ts, CASE WHEN atr_pct >= 0.03 * 1.5 THEN 'HIGH' WHEN atr_pct >= 0.03 THEN 'MODERATE' ELSE 'LOW' END AS level FROM tf"""
_H1 = r"regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1)"
_TITLE = rf"regexp_replace({_H1}, '(?s)<[^>]*>', ' ', 'g')"
for _name, _char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
    _TITLE = f"regexp_replace({_TITLE}, '&{_name};?', '{_char}', 'g')"  # HTML knows these names without a semicolon too
ORACLES["html_titles"] = rf"SELECT page_id, nullif(trim(regexp_replace({_TITLE}, '\s+', ' ', 'g')), '') AS title, 'en' AS language FROM pages"

# What holds whatever the trees look like.
ORACLES["model_store_scores"] = f"""SELECT symbol, count(*) AS rows, true AS known, true AS same_after_load, 1::BIGINT AS model_version, true AS trained_once
FROM ({ORACLES["training_targets"]}) WHERE directional IS NOT NULL GROUP BY 1"""
