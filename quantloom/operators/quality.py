"""Event, bar and feature quality checks as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.safe import clip, zero
from quantloom.session import stage

c = F.col

# Default source reliability and its steps.
START_SCORE, PASS_STEP, FAIL_STEP = 0.85, 0.02, -0.08

PRICES = ("open", "high", "low", "close")

# Topics of the event bus.
TOPICS = (
    "news.raw", "news.cleaned", "news.sentiment.completed", "market.ohlcv.raw", "market.options.raw",
    "features.generated", "regime.detected", "strategy.signal.generated", "ensemble.signal.generated",
    "risk.evaluated", "final.signal.generated", "anomaly.detected", "model.prediction.generated",
    "system.dead_letter", "system.health",
)


def valid_bar() -> Column:
    """High and low enclose the bar and the volume is not negative."""
    return (
        (c("high") >= F.greatest("open", "low", "close")) & (c("low") <= F.least("open", "high", "close"))
        & (c("volume") >= 0))


def split_bars(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid bars, quarantined bars)."""
    ok = F.coalesce(valid_bar(), F.lit(False))
    return bars.where(ok), bars.where(~ok)


def issue(condition: Column, text: str) -> Column:
    return F.when(condition, F.lit(text))


def bar_issues(p: dict[str, Column]) -> list[Column]:
    """Rules for a bar payload; missing prices stop the other checks."""
    missing = [issue(p[n].isNull(), f"missing {n}") for n in PRICES]
    complete = p["open"].isNotNull() & p["high"].isNotNull() & p["low"].isNotNull() & p["close"].isNotNull()
    o, h, low, cl = (p[n] for n in PRICES)
    return missing + [
        issue(complete & (F.least(o, h, low, cl) <= 0), "invalid non-positive price"),
        issue(complete & (h < F.greatest(o, low, cl)), "invalid OHLC candle: high below price component"),
        issue(complete & (low > F.least(o, h, cl)), "invalid OHLC candle: low above price component"),
        issue(complete & (zero(p["volume"]) < 0), "invalid negative volume"),
    ]


def check_events(events: DataFrame, as_of: Column) -> DataFrame:
    """Add ``issues, quality_status, source_reliability_score`` to envelopes with a JSON payload.

    A payload is searched once per field, and only for the fields of its kind of event; the rules then read columns.
    """
    def number(name: str) -> Column:
        return F.get_json_object("payload", f"$.{name}").try_cast("double")

    headline = F.coalesce(
        F.nullif(F.get_json_object("payload", "$.title"), F.lit("")), F.get_json_object("payload", "$.text"), F.lit(""))
    is_bar = c("event_type").isin("market.ohlcv.raw", "features.generated")
    is_chain = c("event_type") == "market.options.raw"
    is_news = c("event_type").isin("news.raw", "news.cleaned")
    read = {f"_{n}": F.when(is_bar, number(n)) for n in (*PRICES, "volume")} | {
        "_pcr": F.when(is_chain, number("pcr")), "_iv": F.when(is_chain, number("iv")), "_headline": F.when(is_news, headline),
        "_reliability": F.coalesce(number("source_reliability_score"), F.lit(START_SCORE))}
    prices, reliability = {n: c(f"_{n}") for n in (*PRICES, "volume")}, c("_reliability")
    found = [F.when(is_bar, rule) for rule in bar_issues(prices)] + [
        issue(c("_pcr") < 0, "invalid negative PCR"),
        issue(c("_iv") < 0, "invalid negative IV"),
        issue(F.trim("_headline") == "", "missing empty news headline"),
        issue(c("ts") > as_of, "event timestamp is in the future"),
        issue(reliability < 0.4, "low source reliability"),
    ]
    issues = F.array_compact(F.array(*found))
    return events.withColumns(read).withColumn("issues", issues).withColumns({
        "quality_status": F.when(F.exists("issues", lambda x: x.rlike("invalid|missing")), "FAIL")
        .when(F.size("issues") > 0, "WARN").otherwise("PASS"),
        "source_reliability_score": clip(reliability, 0.0, 1.0),
    }).drop(*read)


def missing_fields(required: list[str]) -> Column:
    """Sorted names of required columns that are NULL or ''."""
    return F.array_sort(F.array_compact(F.array(*[
        F.when(F.coalesce(c(n).cast("string"), F.lit("")) == "", F.lit(n)) for n in required])))


def is_stale(ts: Column, as_of: Column, max_age_seconds: int) -> Column:
    return F.unix_micros(as_of) - F.unix_micros(ts) > max_age_seconds * 1_000_000


def impossible_price(price: Column) -> Column:
    return (price <= 0) | (price > 10_000_000)


def extreme_return(current: Column, previous: Column, threshold: float = 0.4) -> Column:
    moved = F.abs(F.try_divide(current, previous) - 1) > threshold
    return F.when(previous <= 0, True).otherwise(moved)


def freshness(ts: Column, as_of: Column, max_age_seconds: int = 900) -> Column:
    age = F.unix_micros(as_of) - F.unix_micros(ts)
    limit = max_age_seconds * 1_000_000
    return F.when(age <= limit, "FRESH").when(age <= 4 * limit, "STALE").otherwise("EXPIRED")


# Features a usable vector must have.
REQUIRED_FEATURES = (
    "rsi", "macd", "macd_signal", "macd_histogram", "ema_slope", "vwap_distance", "atr", "bollinger_width",
    "realized_volatility",
)


def feature_quality(frame: DataFrame, as_of: Column, news: DataFrame | None = None, options: DataFrame | None = None) -> DataFrame:
    """Quality report per symbol from the unfilled adaptive frame.

    Only the last ten bars of a symbol are looked at besides its row count. ``news`` and
    ``options`` hold (symbol, ts) of the inputs that were available. The NULL ratio is read
    before NULLs are filled.
    """
    from quantloom.operators.regimes import last_n, latest_rows

    numeric = [n for n, t in frame.dtypes if t in ("double", "int", "bigint", "float") and n not in ("pos", "block")]
    ends = frame.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.max("pos").alias("_top"))
    recent = last_n(frame.select("symbol", "ts", "pos", *numeric), 10, "symbol").join(ends, "symbol")
    holes = sum((c(n).isNull().cast("int") for n in numeric), F.lit(0))
    last5 = c("pos") > c("_top") - 5
    stats = recent.groupBy("symbol").agg(
        F.max("rows").alias("rows"), F.sum("volume").alias("_volume"),
        (F.sum(F.when(last5, holes)) / F.sum(F.when(last5, F.lit(len(numeric))))).alias("nan_ratio"))
    latest = latest_rows(frame.select("symbol", "ts", *REQUIRED_FEATURES), "symbol")
    df = latest.join(stats, "symbol")
    for name, source in (("_news", news), ("_options", options)):
        if source is None:
            df = df.withColumn(name, F.lit(None).cast("timestamp"))
        else:
            df = df.join(source.groupBy("symbol").agg(F.max("ts").alias(name)), "symbol", "left")
    df = df.withColumns({
        "missing_features": F.array_compact(F.array(*[F.when(c(n).isNull(), F.lit(n)) for n in REQUIRED_FEATURES])),
        "enough_history": c("rows") >= 30,
        "stale_inputs": is_stale(c("ts"), as_of, 1800),
    })
    df = df.withColumn("warnings", F.array_compact(F.array(
        issue(~c("enough_history"), "Fewer than 30 candles are available."),
        issue(c("stale_inputs"), "Latest candle is stale."),
        issue(c("_news").isNull(), "Sentiment input is missing."),
        F.when(c("_options").isNull(), "Options-chain input is missing.")
        .when(c("_options") < c("ts"), "Options-chain snapshot is older than the latest market candle."),
        issue(c("_volume") <= 0, "Recent candles have zero volume."),
        issue(zero(c("atr")) <= 0, "ATR is zero or unavailable."),
        issue(zero(c("realized_volatility")) <= 0, "Realized volatility is zero or unavailable."),
    )))
    score = (
        1.0
        - F.when(c("enough_history"), 0.0).otherwise(0.25)
        - F.when(c("stale_inputs"), 0.25).otherwise(0.0)
        - F.least(F.lit(0.25), c("nan_ratio"))
        - F.least(F.lit(0.25), F.size("missing_features") * 0.03)
        - F.least(F.lit(0.15), F.size("warnings") * 0.03))
    return df.withColumn("quality_score", F.round(clip(score, 0.0, 1.0), 4)).select(
        "symbol", "ts", "rows", "missing_features", "stale_inputs", "enough_history", "quality_score", "warnings")


def clamp_walk(events: DataFrame, block_rows: int = 256, start: DataFrame | None = None) -> DataFrame:
    """Source reliability in arrival order: ``score_before`` and ``score_after`` per event.

    ``events`` has source, seq and passed, with ``pos`` (rank within the source); ``start`` may hold
    (source, score) to begin with. A run of clamped steps is itself one clamped step (add, then
    limit to [low, high]), so blocks are reduced to such triples, blocks of blocks next, as many
    levels as it takes to reach one triple per source; then each level is replayed from the
    starting scores of the one above. The first level keeps the events themselves, so they
    are shuffled once. No array is larger than ``block_rows``.
    """
    def reduce_steps(steps: Column) -> Column:
        begin = F.struct(F.lit(0.0).alias("add"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"))
        return F.aggregate(steps, begin, lambda acc, s: F.struct(
            (acc["add"] + s["add"]).alias("add"),
            F.least(F.greatest(acc["low"] + s["add"], s["low"]), s["high"]).alias("low"),
            F.least(F.greatest(acc["high"] + s["add"], s["low"]), s["high"]).alias("high")))

    def apply(score: Column, s: Column) -> Column:
        return F.least(F.greatest(score + s["add"], s["low"]), s["high"])

    def step(passed: Column) -> Column:
        return F.struct(
            F.when(passed, PASS_STEP).otherwise(FAIL_STEP).alias("add"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

    def replay(score: Column, items: Column, fields: dict[str, str], step_of: Callable[[Column], Column]) -> Column:
        """The fields of the items with the score before each of them."""
        none = F.array().cast(f"array<struct<{','.join(f'{n}:{kind}' for n, kind in fields.items())},before:double>>")
        first = F.struct(score.cast("double").alias("score"), none.alias("out"))
        return F.aggregate(items, first, lambda acc, i: F.struct(
            apply(acc["score"], step_of(i)).alias("score"),
            F.array_append(acc["out"], F.struct(*[i[n].alias(n) for n in fields], acc["score"].alias("before"))).alias("out")),
            lambda acc: acc["out"])

    # what an item of the first level is, and of those above: its fields besides the step, and its step
    event = {"at": "bigint", "seq": dict(events.dtypes)["seq"], "passed": "boolean"}, ["at", "seq", "passed"], lambda i: step(i["passed"])
    block = {"at": "bigint"}, ["at", "step"], lambda i: i["step"]
    current, levels, top = events.select("source", c("pos").cast("long").alias("at"), "seq", "passed"), [], None
    while not levels or top:
        _, columns, step_of = block if levels else event
        grouped = current.groupBy("source", F.floor(c("at") / block_rows).alias("g")).agg(
            F.array_sort(F.collect_list(F.struct(*columns))).alias("items"))
        levels.append(stage(grouped.withColumn("step", reduce_steps(F.transform("items", step_of)))))
        current, top = levels[-1].select("source", c("g").alias("at"), "step"), levels[-1].agg(F.max("g")).first()[0]
    before = current.select("source", "at")
    before = before.withColumn("before", F.lit(START_SCORE)) if start is None else before.join(
        start.select("source", "score"), "source", "left").select("source", "at", F.coalesce("score", F.lit(START_SCORE)).alias("before"))
    for level in reversed(levels):
        fields, _, step_of = event if level is levels[0] else block
        opened = level.join(before.withColumnRenamed("at", "g"), ["source", "g"])
        before = opened.select("source", F.inline(replay(c("before"), c("items"), fields, step_of)))
    return before.select(
        "source", "seq", "passed", c("before").alias("score_before"), apply(c("before"), step(c("passed"))).alias("score_after"))
