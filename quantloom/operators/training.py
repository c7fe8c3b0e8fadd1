"""Training targets, walk-forward evaluation and regime models on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.safe import div, over_min, zero
from quantloom.operators import features as feat
from quantloom.operators.backtest import walk_forward_folds
from quantloom.operators.blocks import owned, series_window, tail
from quantloom.operators.memory import classification_report
from quantloom.session import stage
from quantloom.settings import Blocks

c = F.col


def directional(horizon: int, threshold: float = 0.005) -> Column:
    """Direction of the return over ``horizon`` bars; NULL where the future is unknown."""
    future = div(F.lead("close", horizon).over(series_window()), c("close")) - 1
    return (
        F.when(future.isNull(), F.lit(None)).when(future > threshold, "up")
        .when(future < -threshold, "down").otherwise("sideways"))


def regime_target() -> Column:
    trend = zero(c("trend_strength"))
    return (
        F.when(zero(c("return_5")) <= -0.04, "PANIC")
        .when(zero(c("volatility_percentile")) >= 0.8, "HIGH_VOLATILITY")
        .when(zero(c("liquidity_score")) <= 0.25, "LOW_LIQUIDITY")
        .when((trend >= 0.3) & (zero(c("return_20")) > 0), "BULLISH_REGIME")
        .when((trend >= 0.3) & (zero(c("return_20")) < 0), "BEARISH_REGIME")
        .when(trend >= 0.25, "TRENDING").otherwise("SIDEWAYS"))


def suitability_target() -> Column:
    trend = zero(c("trend_strength"))
    return (
        F.when(zero(c("market_stress_score")) > 0.65, "risk_off")
        .when(zero(c("volatility_percentile")) > 0.75, "volatility")
        .when(trend > 0.3, "momentum")
        .when((F.abs(zero(c("zscore"))) > 1.2) | (trend < 0.2), "mean_reversion")
        .when(F.abs(zero(c("rolling_sentiment_mean"))) > 0.25, "sentiment").otherwise("momentum"))


def with_zscore(blocked: DataFrame) -> DataFrame:
    mean = over_min(F.avg, c("close"), tail(20), 2)
    spread = over_min(F.stddev_pop, c("close"), tail(20), 2)
    return blocked.withColumn("zscore", div(c("close") - mean, spread))


def targets(blocked: DataFrame, blocks: Blocks, horizon: int = 5) -> DataFrame:
    """All three targets per bar, from price data alone."""
    if horizon > blocks.lookahead_rows:
        raise ValueError("horizon exceeds the lookahead of the blocks")
    df = feat.adx(feat.volatility(feat.returns(blocked)))
    df = df.withColumns({n: feat.change("close", int(n[7:])) for n in ("return_3", "return_5", "return_20")})
    df = df.withColumn("rolling_sentiment_mean", F.lit(0.0))
    df = with_zscore(feat.regime_scores(df)).withColumn("directional", directional(horizon))
    return owned(df.withColumns({"regime_target": regime_target(), "suitability": suitability_target()}))


def forest(trees: int = 160, depth: int = 6, min_leaf: int = 5, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed, featuresCol="features", labelCol="target_index")


def _pipeline(names: Sequence[str], labels: list[str], estimator) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="keep"), estimator,
        IndexToString(inputCol="prediction", outputCol="predicted", labels=labels)])


def walk_forward(
    dataset: DataFrame, names: Sequence[str], target: str, splits: int = 3, **forest_options: int
) -> tuple[DataFrame, PipelineModel]:
    """Out-of-fold predictions (fold, symbol, ts, label, prediction) and the model fitted on all rows.

    ``dataset`` is indexed (symbol, pos); rows without a target are left out. All symbols
    are trained together, each cut into expanding folds along its own history.
    """
    rows = dataset.where(c(target).isNotNull())
    indexer = StringIndexer(inputCol=target, outputCol="target_index", stringOrderType="alphabetAsc").fit(rows)
    ready = indexer.transform(rows)
    folds = walk_forward_folds(ready.select("symbol", "ts", "pos", "target_index", target, *names), splits)
    predicted = None
    for fold in range(1, splits + 1):
        part = folds.where(c("fold") == fold)
        model = _pipeline(names, indexer.labels, forest(**forest_options)).fit(part.where("role = 'train'"))
        out = model.transform(part.where("role = 'test'")).select(
            "fold", "symbol", "ts", c(target).alias("label"), c("predicted").alias("prediction"))
        predicted = out if predicted is None else predicted.unionByName(out)
    return predicted, _pipeline(names, indexer.labels, forest(**forest_options)).fit(ready)


def evaluate(predictions: DataFrame) -> DataFrame:
    return classification_report(predictions)


def cluster_regimes(dataset: DataFrame, names: Sequence[str], clusters: int = 4, seed: int = 42) -> DataFrame:
    """Add ``cluster`` from k-means on standardised features."""
    model = Pipeline(stages=[
        VectorAssembler(inputCols=list(names), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        KMeans(k=clusters, seed=seed, featuresCol="_scaled", predictionCol="cluster"),
    ]).fit(dataset)
    return model.transform(dataset).drop("_raw", "_scaled")


def boosted_regimes(
    dataset: DataFrame, names: Sequence[str], target: str, rounds: int = 200, depth: int = 4, step: float = 0.05,
    validation: Column | None = None, tolerance: float = 0.01,
) -> DataFrame:
    """``dataset`` rows with a target, scored out of training: (..., label, prediction, validation, trees).

    One boosted binary model per label, one against the rest; the label with the largest probability wins, ties to the
    first. Rows of ``validation`` (a fifth by the hash of symbol and time) do not train: each model stops when they stop
    gaining by ``tolerance``. ``trees`` tells how many rounds the longest model took.
    """
    held = F.pmod(F.xxhash64("symbol", "ts"), F.lit(5)) == 0 if validation is None else validation
    rows = stage(dataset.where(c(target).isNotNull()).select("symbol", "ts", c(target).alias("label"), held.alias("validation"), *names))
    labels = sorted(r.label for r in rows.select("label").distinct().collect())  # a handful of regimes
    base = stage(VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="keep").transform(rows))
    ready, longest = base, 0
    for i, label in enumerate(labels):
        booster = GBTClassifier(
            maxDepth=depth, maxIter=rounds, stepSize=step, subsamplingRate=0.8, seed=42, validationIndicatorCol="validation", validationTol=tolerance,
            labelCol="_is", featuresCol="features", predictionCol="_guess").setRawPredictionCol("_raw").setProbabilityCol("_both")
        model = booster.fit(base.select("features", "validation", (c("label") == label).cast("double").alias("_is")))
        longest = max(longest, model.getNumTrees)
        ready = model.transform(ready).withColumn(f"_p{i}", vector_to_array("_both")[1]).drop("_raw", "_guess", "_both")
    best = F.array_max(F.array(*[F.struct(c(f"_p{i}").alias("p"), F.lit(-i).alias("i"), F.lit(label).alias("label")) for i, label in enumerate(labels)]))
    return ready.select("symbol", "ts", *names, "label", best["label"].alias("prediction"), "validation", F.lit(longest).alias("trees"))
