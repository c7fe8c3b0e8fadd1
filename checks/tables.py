"""Engine inputs (bars, ticks, news, options, envelopes) read from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.candles import trade_bars
from quantloom.session import prepare, stage

c = F.col

TRADE_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def line_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trades: symbol from the two flags, unit price, quantity as size."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        c("l_shipdate").cast("timestamp").alias("ts"),
        (c("l_extendedprice") / c("l_quantity")).alias("price"),
        c("l_quantity").alias("volume"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_bars(line_trades(spark, sf_dir), TRADE_ORDER)


def staged_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars written once, so that feature passes do not re-read the trades."""
    return stage(daily_bars(spark, sf_dir))


SYMBOLS = ("AF", "AO", "NF", "NO", "RF", "RO")

# Words that occur in the test documents, used in place of the default token lists.
UP_TOKENS = ("que", "with", "mit ", "por")
DOWN_TOKENS = ("est", "ment", "by ", "und")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        c("event_type").alias("symbol"), c("ts").cast("timestamp").alias("ts"), c("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"), c("event_id").alias("seq"))


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(
        F.lit("HTTPS://WWW.Example.com/news/"), c("source"), F.lit("/"), c("n_chars").cast("string"),
        F.lit("/?utm="), c("doc_id").cast("string"), F.lit("#top"))
    return table(spark, sf_dir, "documents").select(
        c("doc_id").alias("id"), "source", F.split("text", "\n")[0].alias("title"), url.alias("url"),
        F.lit(None).cast("string").alias("summary"), c("text").alias("content"),
        F.lit(None).cast("string").alias("author"), F.array(c("lang"), c("source"), c("lang")).alias("tags"),
        c("lang").alias("language"))


def doc_symbol():
    return F.element_at(F.array(*[F.lit(s) for s in SYMBOLS]), (c("doc_id") % 6 + 1).cast("int"))


def doc_ts():
    start = F.lit("1995-01-02 09:00:00").cast("timestamp")
    return F.timestamp_seconds(F.unix_seconds(start) + (c("doc_id") % 2400) * 86400)


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news with lexical sentiment: symbol and time follow from the document id."""
    from quantloom.functions.sentiment import lexical_sentiment, signed_score

    docs = table(spark, sf_dir, "documents").select(
        "doc_id", doc_symbol().alias("symbol"), doc_ts().alias("ts"), "text", "lang",
        lexical_sentiment(c("text"), UP_TOKENS, DOWN_TOKENS).alias("_s"))
    return docs.select(
        "doc_id", "symbol", "ts", "text", F.when(c("lang") != "en", c("lang")).alias("sector"),
        c("_s.sentiment").alias("sentiment"), c("_s.confidence").alias("confidence"),
        signed_score(c("_s.sentiment"), c("_s.confidence")).alias("sentiment_score"),
        c("doc_id").alias("seq"))


def chain_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as one-strike option-chain JSON payloads per (symbol, day)."""
    odd = c("l_linenumber") % 3 != 0
    side = lambda oi, change, iv: F.struct(
        oi.alias("openInterest"), change.alias("changeinOpenInterest"), iv.alias("impliedVolatility"))
    strike = F.struct(
        (1000 + (c("l_partkey") % 50) * 10).cast("double").alias("strikePrice"),
        side(c("l_quantity"), c("l_discount") * 1000 - 40, c("l_tax") * 100).alias("CE"),
        F.when(odd, side(c("l_quantity") * 2 - 30, c("l_tax") * 1000, c("l_discount") * 100)).alias("PE"))
    payload = F.struct(F.struct(
        F.array(strike).alias("data"), (c("l_extendedprice") / c("l_quantity")).alias("underlyingValue")).alias("records"))
    used = ["l_returnflag", "l_linestatus", "l_shipdate", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    return table(spark, sf_dir, "lineitem").select(*used).select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), c("l_shipdate").cast("timestamp").alias("ts"),
        F.to_json(payload).alias("payload"))


def option_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily snapshots with the columns the feature engine reads."""
    from quantloom.operators.options_chain import last_of_day, parse_chain, summarize_chain

    days = last_of_day(summarize_chain(parse_chain(chain_payloads(spark, sf_dir))))
    return days.withColumns({"options_volume_call": c("call_oi"), "options_volume_put": c("put_oi")})


def benchmark_series(bars: DataFrame) -> DataFrame:
    """Mean close over all symbols per day."""
    return bars.groupBy("ts").agg(F.avg("close").alias("close"))


def sector_series(bars: DataFrame) -> DataFrame:
    """Mean close per sector (first letter of the symbol) and day."""
    return bars.groupBy(F.substring("symbol", 1, 1).alias("sector"), "ts").agg(F.avg("close").alias("close"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as envelopes: bar, options, news and health payloads by event type."""
    kinds = {"click": "market.ohlcv.raw", "view": "news.raw", "purchase": "market.options.raw",
             "signup": "features.generated", "error": "system.health"}
    k = F.get_json_object("props", "$.k").cast("double")
    kind = F
    for name, topic in kinds.items():
        kind = kind.when(c("event_type") == name, topic)
    bar = F.to_json(F.struct(
        c("value").alias("open"), (c("value") + 20 - k / 2).alias("high"), F.when(k > 3, c("value") - 1).alias("low"),
        c("value").alias("close"), (k - 2).alias("volume")))
    chain = F.to_json(F.struct((c("value") - 2).alias("pcr"), (k - 4).alias("iv")))
    news = F.to_json(F.struct(
        F.when(k > 10, F.concat(F.lit("item "), c("event_id").cast("string"))).otherwise(" ").alias("title"),
        (k / 100).alias("source_reliability_score")))
    payload = (
        F.when(c("event_type").isin("click", "signup"), bar).when(c("event_type") == "purchase", chain)
        .when(c("event_type") == "view", news).otherwise(c("props")))
    return table(spark, sf_dir, "events").select(
        c("event_id").cast("string").alias("event_id"), kind.alias("event_type"),
        F.concat(F.lit("feed"), (c("user_id") % 7).cast("string")).alias("source"),
        c("ts").cast("timestamp").alias("ts"), F.upper("event_type").alias("symbol"),
        c("user_id").cast("string").alias("correlation_id"), payload.alias("payload"),
        F.lit("1.0").alias("schema_version"), c("event_id").alias("seq"))


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lifecycle steps of the user's correlation id; the state follows from props.k."""
    states = ("CREATED", "DATA_COLLECTED", "FEATURES_READY", "REGIME_READY", "STRATEGIES_READY",
              "ENSEMBLE_READY", "RISK_READY", "FINALIZED", "FAILED")
    k = F.get_json_object("props", "$.k").cast("int")
    state = F.element_at(F.array(*[F.lit(s) for s in states]), k % 9 + 1)
    return table(spark, sf_dir, "events").select(
        c("user_id").cast("string").alias("correlation_id"), state.alias("state"), c("ts").cast("timestamp").alias("ts"),
        c("event_id").alias("seq"), F.when(state == "FAILED", F.concat(F.lit("code "), k.cast("string"))).alias("error"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as paper-trade feedback: strategy from the type, figures from value and props.k."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        c("event_type").alias("strategy_name"), c("event_id").alias("seq"), c("ts").cast("timestamp").alias("ts"),
        F.when(k < 40, "BUY").when(k < 80, "sell").otherwise("HOLD").alias("signal"),
        ((c("value") - 20) / 100).alias("realized_return"), (c("value") / 500).alias("max_adverse_excursion"),
        (k / 100).alias("confidence"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as strategy outcomes with a regime (first props digit) and a result."""
    k = F.get_json_object("props", "$.k").cast("int")
    regimes = ("trending", "sideways", "panic", "unknown")
    return table(spark, sf_dir, "events").select(
        c("event_type").alias("strategy_name"), F.concat(F.lit("u"), (c("user_id") % 10).cast("string")).alias("symbol"),
        F.element_at(F.array(*[F.lit(r) for r in regimes]), k % 4 + 1).alias("regime"),
        F.when(k % 10 == 0, "PENDING").when(c("value") > 15, "WIN").when(c("value") < 5, "LOSS").otherwise("NEUTRAL").alias("result"),
        (c("value") - 15).alias("pnl"), c("event_id").alias("seq"), c("ts").cast("timestamp").alias("ts"))
