"""Back-tests of all strategies in one pass over the signals.

All trading features look backwards only, so the signal on a bar equals the signal of a
feature build that stops at that bar. A trade is the bar's direction times the return to
the next bar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.safe import zero
from quantloom.operators.strategies import Strategy, with_signals

c = F.col

# First bar that may trade and the shortest series that is tested.
FIRST_TRADE = 20
MIN_BARS = 25


def trades(
    features: DataFrame, names: Sequence[str], custom: Sequence[Strategy] = (), *keep: str
) -> DataFrame:
    """Directional signals with their realised return. Needs pos, block, close and next_close."""
    moved = (c("next_close") - c("close")) / F.greatest(c("close"), F.lit(1e-9))
    tradable = features.where((c("pos") >= FIRST_TRADE) & c("next_close").isNotNull())
    return (
        with_signals(tradable, names, custom, directional_only=True)
        .select("symbol", "block", "pos", "ts", *keep, moved.alias("_move"), F.inline("signals"))
        .withColumn("realized", F.when(c("signal") == "BUY", c("_move")).otherwise(-c("_move")))
        .drop("_move")
    )


def equity_curve(trade_rows: DataFrame) -> DataFrame:
    """Add the equity curve (product of 1 + return from the first trade) and its drawdown.

    Equity is kept as ``equity_sign`` (-1, 0, 1) and ``log_equity`` (sum of log |1 + return|),
    the running peak, which starts at 1, as ``log_peak``; so no length of series overflows.
    ``drawdown`` is equity / peak - 1. Inside a block the sums are local; one summary row per
    block carries sign, log and peak over. ``trade_rows`` is read twice, so give it as a
    stored table. A loss above 100 % turns the sign, so a block keeps the highs of both signs.
    """
    keys = ["strategy_name", "symbol"]
    inside = Window.partitionBy(*keys, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    growth = 1 + c("realized")
    zeros = F.max((growth == 0).cast("int"))
    turns = F.sum((growth < 0).cast("int"))
    local = trade_rows.withColumns({
        "_log": F.sum(F.when(growth != 0, F.log(F.abs(growth))).otherwise(0.0)).over(inside),
        "_sign": F.when(zeros.over(inside) == 1, 0).otherwise(1 - 2 * F.pmod(turns.over(inside), F.lit(2)))})
    local = local.withColumns({
        "_top": F.max(F.when(c("_sign") == 1, c("_log"))).over(inside), "_low": F.max(F.when(c("_sign") == -1, c("_log"))).over(inside)})
    reach = c("_start") + F.when(c("_from") == 1, c("_top")).when(c("_from") == -1, c("_low"))
    blocks = local.groupBy(*keys, "block").agg(
        F.max_by("_log", "pos").alias("_add"), F.max_by("_sign", "pos").alias("_end"), F.max("_top").alias("_top"), F.max("_low").alias("_low"))
    blocks = blocks.withColumns({
        "_start": F.coalesce(F.sum("_add").over(earlier), F.lit(0.0)), "_from": F.coalesce(F.product("_end").over(earlier), F.lit(1.0)).cast("int")})
    blocks = blocks.withColumn("_high", F.greatest(F.lit(0.0), F.max(reach).over(earlier))).select(*keys, "block", "_start", "_from", "_high")
    joined = local.join(blocks, [*keys, "block"]).withColumns({
        "equity_sign": c("_from") * c("_sign"), "log_equity": c("_start") + c("_log"), "log_peak": F.greatest(c("_high"), reach)})
    fall = c("equity_sign") * F.exp(c("log_equity") - c("log_peak")) - 1
    return joined.withColumn("drawdown", fall).drop("_log", "_sign", "_top", "_low", "_start", "_from", "_high")


def summary(trade_rows: DataFrame, bars: DataFrame, names: Sequence[str]) -> DataFrame:
    """One back-test result per (strategy, symbol), also where no trade happened.

    ``profit_factor`` is NULL with ``only_gains`` set where there are gains but no losses.
    """
    keys = ["strategy_name", "symbol"]
    metrics = equity_curve(trade_rows).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_trades"), F.avg((c("realized") > 0).cast("double")).alias("_rate"),
        F.sum(F.when(c("realized") > 0, c("realized"))).alias("_gain"),
        F.abs(F.sum(F.when(c("realized") < 0, c("realized")))).alias("_loss"),
        F.min("drawdown").alias("_fall"),
        F.avg("realized").alias("_mean"), F.stddev_pop("realized").alias("_std"))
    spans = (
        bars.groupBy("symbol").agg(F.min("ts").alias("start_date"), F.max("ts").alias("end_date"),
                                   F.count(F.lit(1)).alias("bars"))
        .where(c("bars") >= MIN_BARS)
    )
    # Every tested symbol gets one row per chosen strategy, a short literal list.
    grid = spans.withColumn("strategy_name", F.explode(F.array(*[F.lit(n) for n in names])))
    return grid.join(metrics, keys, "left").select(
        *keys, "start_date", "end_date",
        F.coalesce("_trades", F.lit(0)).alias("total_trades"),
        F.round(zero(c("_rate")), 4).alias("win_rate"),
        F.when(zero(c("_loss")) > 0, F.round(zero(c("_gain")) / c("_loss"), 4))
        .when(zero(c("_gain")) > 0, F.lit(None)).otherwise(0.0).alias("profit_factor"),
        ((zero(c("_loss")) == 0) & (zero(c("_gain")) > 0)).alias("only_gains"),
        F.round(F.least(zero(c("_fall")), F.lit(0.0)), 4).alias("max_drawdown"),
        F.round(zero(c("_mean")), 6).alias("average_return"),
        F.round(zero(c("_rate")), 4).alias("accuracy"),
        zero(c("_mean")).alias("mean_return"), zero(c("_std")).alias("return_std"),
    )


def accuracy_records(results: DataFrame, regime: str = "unknown", timeframe: str = "1d") -> DataFrame:
    """Back-test results as accuracy records for weighting."""
    return results.select(
        "strategy_name", "symbol", F.lit(regime).alias("regime"), F.lit(timeframe).alias("timeframe"),
        "accuracy", "win_rate", c("average_return").alias("avg_return"), c("total_trades").alias("sample_size"))


def accuracy_by_regime(trade_rows: DataFrame, timeframe: str = "1d") -> DataFrame:
    """Accuracy records split by the regime in force when the trade was opened."""
    return trade_rows.groupBy("strategy_name", "symbol", "regime").agg(
        F.lit(timeframe).alias("timeframe"),
        F.round(F.avg((c("realized") > 0).cast("double")), 4).alias("accuracy"),
        F.round(F.avg("realized"), 6).alias("avg_return"),
        F.count(F.lit(1)).alias("sample_size"))


def report(results: DataFrame) -> DataFrame:
    """Dashboard view of the results."""
    return results.select(
        "strategy_name", "symbol", F.struct(c("start_date").alias("start"), c("end_date").alias("end")).alias("period"),
        c("total_trades").alias("trades"), "win_rate", "profit_factor", "max_drawdown", "average_return", "accuracy",
        F.create_map(F.lit("mean_return"), c("mean_return"), F.lit("return_std"), c("return_std")).alias("metadata"))


def train_test_cut(indexed: DataFrame, ratio: float) -> DataFrame:
    """Add ``part``: the first ``ratio`` of each series is train, the rest test."""
    sizes = indexed.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    cut = F.greatest(F.lit(1), F.least(c("_n") - 1, F.floor(c("_n") * ratio)))
    return indexed.join(sizes, "symbol").withColumn(
        "part", F.when(c("pos") < cut, "train").otherwise("test")).drop("_n")


def walk_forward_folds(indexed: DataFrame, splits: int) -> DataFrame:
    """Expanding folds: fold f trains on the first f parts and tests on the next one.

    A row belongs to one test fold and to the training side of all later ones. Series
    shorter than ``splits + 2`` are left out.
    """
    sizes = indexed.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(c("_n") >= splits + 2)
    part = F.floor(c("pos") / F.floor(c("_n") / (splits + 1)))
    folds = F.transform(F.sequence(F.lit(1), F.lit(splits)), lambda f: F.struct(
        f.alias("fold"), F.when(part < f, "train").when(part == f, "test").alias("role")))
    return indexed.join(sizes, "symbol").select(
        *indexed.columns, F.inline(F.filter(folds, lambda x: x["role"].isNotNull())))
