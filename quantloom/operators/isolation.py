"""Isolation forest per symbol: every tree draws its own sample of the whole history; every row is scored.

Trees are grown on ``SAMPLE`` rows each, as the method defines, in one small group per
(symbol, tree). Rows are scored block by block.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.session import stage

c = F.col

# Features, forest size and thresholds.
COLUMNS = (
    "unusual_volume_score", "sentiment_price_divergence_score", "options_anomaly_score",
    "volatility_shock_score", "liquidity_breakdown_score", "return_5",
)
TREES, SAMPLE, CONTAMINATION, MIN_ROWS = 120, 256, 0.05, 40


def _path_length(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    mean = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, mean))


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int):
    """Nested tuples (feature, cut, left, right), or the size of a leaf."""
    spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(x.shape[1])
    usable = np.flatnonzero(spread > 0)
    if depth == 0 or len(x) <= 1 or not len(usable):
        return len(x)
    f = int(rng.choice(usable))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    low = x[:, f] < cut
    return f, cut, _grow(x[low], rng, depth - 1), _grow(x[~low], rng, depth - 1)


def _depths(node, x: np.ndarray, level: int = 0) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), level + float(_path_length(node)))
    f, cut, left, right = node
    out, low = np.empty(len(x)), x[:, f] < cut
    out[low], out[~low] = _depths(left, x[low], level + 1), _depths(right, x[~low], level + 1)
    return out


def forests(rows: DataFrame, seed: int) -> DataFrame:
    """One row per symbol: its trees in order. ``rows`` carry the symbol's row count as ``_n``.

    A tree's sample is the ``SAMPLE`` rows with the smallest hash of (pos, tree). A share that
    leaves about twice as many rows per tree is drawn before they are ranked, so a group stays small.
    """
    columns = list(COLUMNS)

    def draw(tree: Column) -> Column:
        return F.pmod(F.xxhash64(c("pos"), tree, F.lit(seed)), F.lit(1 << 30))

    drawn = F.filter(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda tree: draw(tree) * c("_n") < F.lit(2 * SAMPLE * (1 << 30)))
    placed = rows.select("symbol", "pos", *columns, F.explode(drawn).alias("tree")).withColumn("_draw", draw(c("tree")))
    rank = F.row_number().over(Window.partitionBy("symbol", "tree").orderBy("_draw", "pos"))
    samples = placed.withColumn("_rank", rank).where(c("_rank") <= SAMPLE)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x, tree = pdf[columns].to_numpy(float), int(pdf.tree.iloc[0])
        root = _grow(x, np.random.default_rng([seed, tree]), int(np.ceil(np.log2(max(len(x), 2)))))
        return pd.DataFrame({"symbol": [pdf.symbol.iloc[0]], "tree": [tree], "size": [len(x)], "root": [pickle.dumps(root)]})

    grown = samples.groupBy("symbol", "tree").applyInPandas(grow, "symbol string, tree int, size int, root binary")
    return grown.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("tree", "size", "root"))).alias("forest"))


def scores(frame: DataFrame, seed: int = 42) -> DataFrame:
    """Every bar of symbols with enough history: symbol, pos, ts and raw score (0 to 1).

    ``frame`` is the filled adaptive frame with pos and block.
    """
    columns = list(COLUMNS)
    sizes = frame.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(c("_n") >= MIN_ROWS)
    rows = frame.select("symbol", "block", "pos", "ts", *columns).join(sizes, "symbol")
    per_block = rows.select("symbol", "block").distinct().join(forests(rows, seed), "symbol").select(
        c("symbol").alias("model_symbol"), c("block").alias("model_block"), "forest")

    def score(pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        x, trees = pdf[columns].to_numpy(float), model.forest.iloc[0]
        depth = np.mean([_depths(pickle.loads(t["root"]), x) for t in trees], axis=0)  # written by grow() above
        raw = np.power(2.0, -depth / max(float(_path_length(trees[0]["size"])), 1e-9))
        return pdf[["symbol", "pos", "ts"]].assign(raw=raw)

    return rows.groupBy("symbol", "block").cogroup(per_block.groupBy("model_symbol", "model_block")).applyInPandas(
        score, "symbol string, pos bigint, ts timestamp, raw double")


def detect(frame: DataFrame, seed: int = 42) -> DataFrame:
    """Anomalies among all bars: symbol, ts, anomaly_type, severity, score."""
    return flagged(stage(scores(frame, seed)))


def flagged(scored: DataFrame) -> DataFrame:
    """Scores above the symbol's contamination limit. ``scored`` is read twice, so give it as a stored table."""
    limits = scored.groupBy("symbol").agg(
        F.percentile_approx("raw", F.lit(1.0 - CONTAMINATION), F.lit(100_000)).alias("_limit"))
    found = scored.join(limits, "symbol").withColumn("score", c("raw") - c("_limit")).where(c("score") > 0)
    return found.select(
        "symbol", "ts", F.lit("isolation_forest_market_anomaly").alias("anomaly_type"),
        F.when(c("score") > 0.15, "HIGH").otherwise("MODERATE").alias("severity"), "score")
