"""Feature store, performance memory, rewards, lifecycle and model bookkeeping as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.safe import div, zero
from quantloom.functions.text import feature_version
from quantloom.operators.quality import freshness

c = F.col

# Lifecycle states a signal must complete, in order.
REQUIRED_STATES = (
    "DATA_COLLECTED", "FEATURES_READY", "REGIME_READY", "STRATEGIES_READY", "ENSEMBLE_READY", "RISK_READY")
UNCOUNTED_STATES = ("CREATED", "FAILED", "EXPIRED")


def feature_records(
    wide: DataFrame, names: list[str], as_of: Column, timeframe: str = "1d", source: str = "feature_engine"
) -> DataFrame:
    """Wide features to one record per (symbol, ts, feature)."""
    long = wide.select("symbol", "ts", *[c(n).cast("double").alias(n) for n in names]).unpivot(
        ["symbol", "ts"], names, "feature_name", "feature_value")
    return long.select(
        F.upper("symbol").alias("symbol"), "ts", F.lit(timeframe).alias("timeframe"), "feature_name", "feature_value",
        feature_version(c("feature_name"), F.lit("default"), F.year(as_of)).alias("feature_version"),
        F.lit(source).alias("source"), freshness(c("ts"), as_of).alias("freshness_status"))


def latest_features(records: DataFrame, timeframe: str = "1d") -> DataFrame:
    """Newest value per (symbol, feature)."""
    order = F.struct("ts", "seq") if "seq" in records.columns else F.struct("ts")
    return records.where(c("timeframe") == timeframe).groupBy("symbol", "timeframe", "feature_name").agg(
        F.max_by("feature_value", order).alias("feature_value"), F.max("ts").alias("ts"))


def lookup(records: DataFrame, start: Column | None = None, end: Column | None = None, **equals: str | None) -> DataFrame:
    """Rows by column values (``symbol`` and ``regime`` in any case) and time range; NULL means any."""
    for name, value in equals.items():
        if value is None:
            continue
        if name in ("symbol", "regime"):
            records = records.where(F.upper(name) == value.upper())
        else:
            records = records.where(c(name) == value)
    if start is not None:
        records = records.where(c("ts") >= start)
    return records if end is None else records.where(c("ts") <= end)


def best_by_regime(records: DataFrame, *ranking: str) -> DataFrame:
    """Best strategy per regime by the ranking columns; the earliest record wins ties."""
    key = F.struct(*ranking, (-c("seq")).alias("first"))
    return records.groupBy("regime").agg(
        F.max_by("strategy_name", key).alias("strategy_name"),
        *[F.max_by(n, key).alias(n) for n in ranking])


def recent_win_ratio(outcomes: DataFrame, limit: int = 100) -> DataFrame:
    """Share of wins among each strategy's last settled outcomes.

    The rank limit is applied in every task before the shuffle (Spark's window group limit), so
    the final ranking sees ``limit`` rows per task at most, however many outcomes a strategy has.
    """
    settled = outcomes.where(c("result") != "PENDING").select("strategy_name", "seq", "result")
    whole = Window.partitionBy("strategy_name").orderBy(c("seq").desc())
    last = settled.withColumn("_n", F.row_number().over(whole)).where(c("_n") <= limit)
    return last.groupBy("strategy_name").agg(F.avg((c("result") == "WIN").cast("double")).alias("win_ratio"))


def sentiment_accuracy(outcomes: DataFrame, *keys: str) -> DataFrame:
    return outcomes.groupBy(*keys).agg(zero(F.avg(c("accurate").cast("double"))).alias("accuracy"))


def reward() -> Column:
    """Paper-trade reward of a feedback row (signal, realized_return, max_adverse_excursion, confidence)."""
    side = F.when(F.upper("signal") == "BUY", 1.0).when(F.upper("signal") == "SELL", -1.0).otherwise(0.0)
    gained = side * c("realized_return")
    sure = c("confidence") > 0.65
    return (
        gained - F.abs("max_adverse_excursion") * 0.5
        - F.when((gained < 0) & sure, 0.02).otherwise(0.0) + F.when((gained > 0) & sure, 0.01).otherwise(0.0))


def bandit_scores(rewards: DataFrame) -> DataFrame:
    """Mean reward and upper-confidence score per strategy."""
    sums = rewards.groupBy("strategy_name").agg(F.count(F.lit(1)).alias("n"), F.sum("reward").alias("total"))
    return ucb(sums)


def ucb(sums: DataFrame) -> DataFrame:
    """Scores from (strategy_name, n, total); one row per strategy, so one window holds them all."""
    everyone = F.sum("n").over(Window.partitionBy(F.lit(0)))
    mean = c("total") / c("n")
    return sums.select(
        "strategy_name", "n", mean.alias("mean_reward"),
        (mean + F.sqrt(2 * F.log(everyone + 1) / c("n"))).alias("score"))


def classification_report(pairs: DataFrame, *keys: str) -> DataFrame:
    """Accuracy and macro precision, recall, F1 over the classes seen as truth or prediction."""
    cells = confusion(pairs, *keys)
    true = cells.groupBy(*keys, c("label").alias("cls")).agg(
        F.sum("n").alias("actual"), F.sum(F.when(c("label") == c("prediction"), c("n"))).alias("hit"))
    pred = cells.groupBy(*keys, c("prediction").alias("cls")).agg(F.sum("n").alias("said"))
    both = true.join(pred, [*keys, "cls"], "full")
    hit, actual, said = (F.coalesce(n, F.lit(0)) for n in ("hit", "actual", "said"))
    p, r = zero(div(hit, said)), zero(div(hit, actual))
    return both.groupBy(*keys).agg(
        (F.sum(hit) / F.sum(actual)).alias("accuracy"), F.avg(p).alias("precision_macro"),
        F.avg(r).alias("recall_macro"), F.avg(zero(div(2 * p * r, p + r))).alias("f1_macro"))


def confusion(pairs: DataFrame, *keys: str) -> DataFrame:
    """Counts per (label, prediction)."""
    return pairs.groupBy(*keys, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def latency_report(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("name").agg(
        F.sum("value").alias("total"), F.avg("value").alias("avg_seconds"), F.count(F.lit(1)).alias("count"))


def lifecycle(events: DataFrame) -> DataFrame:
    """State per correlation id: current state, completed and missing states, readiness.

    Only state names and extremes are kept per id, so a long event list does not grow a row.
    """
    counted = F.when(~c("state").isin(*UNCOUNTED_STATES), c("state"))
    states = events.groupBy("correlation_id").agg(
        F.max_by("state", "seq").alias("state"), F.array_sort(F.collect_set(counted)).alias("completed"),
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count(F.lit(1)).alias("events"),
        F.max_by("error", F.when(c("state") == "FAILED", c("seq"))).alias("error"))
    missing = F.array_except(F.array(*[F.lit(s) for s in REQUIRED_STATES]), c("completed"))
    return states.withColumn("missing", missing).withColumn("ready", F.size("missing") == 0)


def state_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def should_retrain(models: DataFrame, as_of: Column, min_accuracy: float = 0.52, max_age_days: int = 14) -> Column:
    """True for weak or old models (a NULL model row also counts)."""
    old = c("created_at") < as_of - F.make_interval(days=F.lit(max_age_days))
    return F.coalesce((zero(c("accuracy")) < min_accuracy) | old, F.lit(True))


def active_models(versions: DataFrame) -> DataFrame:
    """Active version per model: the last activated one, the first registered one by default."""
    return versions.groupBy("model_name").agg(
        F.coalesce(F.max_by("model_version", "activated_at"), F.min_by("model_version", "created_at")).alias("active"))


def rollback_target(versions: DataFrame) -> DataFrame:
    """Version before the newest per model; models with one version are left out.

    The two newest versions come out of one mergeable aggregate instead of a sort.
    """
    newest = versions.groupBy("model_name").agg(F.max("created_at").alias("_top"))
    older = versions.join(newest, "model_name").where(c("created_at") < c("_top"))
    return older.groupBy("model_name").agg(F.max_by("model_version", "created_at").alias("previous"))
