"""Structured Streaming versions of the batch operators.

Each flow is the batch column logic on a stream plus a sink. ``run_once`` processes what
is there and stops, so the same flow serves back-fills, tests and live use.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantloom.operators import candles, memory, quality, vectors
from quantloom.operators.blocks import index_rows
from quantloom.session import read_if_there, shared_dir, stage
from quantloom.sources import sinks

c = F.col


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], folder: str, mode: str = "append") -> None:
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(on_batch)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()


def versioned_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to its own folder; a replayed batch overwrites itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/data/batch={batch_id}")

    return write


def read_versions(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Newest version of each key over all micro-batches."""
    rows = spark.read.parquet(f"{folder}/data").drop("batch")
    return sinks.latest_by_key(rows, keys, c("batch_id")).drop("batch_id")


def live_candles(ticks: DataFrame, timeframe: str, lateness: str = "1 hour") -> DataFrame:
    """Candles of a tick stream, updated with every batch, for dashboards: ticks later than ``lateness``
    are dropped so that state stays bounded. ``stream_candles`` keeps them."""
    seconds = candles.TIMEFRAMES[timeframe]
    return (
        candles.clean_ticks(ticks).withWatermark("ts", lateness)
        .groupBy(F.window("ts", f"{seconds} seconds").alias("w"), F.upper("symbol").alias("symbol"))
        .agg(*candles.candle_aggs(c("seq")))
        .select("symbol", c("w.start").alias("ts"), "open", "high", "low", "close", "volume"))


def stream_candles(ticks: DataFrame, timeframe: str) -> DataFrame:
    """Candles of a tick stream, late ticks included.

    Each micro-batch stores its own partial candles (first and last sequence number with
    them); partial candles merge like ticks do, so no state is kept and no tick is too late.
    """
    folder = new_folder(ticks.sparkSession, "candles")
    store = versioned_sink(folder)
    run_once(ticks, lambda batch, batch_id: store(candles.candles(batch, timeframe), batch_id), folder)
    parts = ticks.sparkSession.read.parquet(f"{folder}/data")
    return parts.groupBy("symbol", "ts").agg(
        F.min_by("open", "first_seq").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "last_seq").alias("close"), F.max("volume").alias("volume"))


def route_events(events: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Check an envelope stream and split it: (cleaned, dead letters). Each event goes to one side."""
    spark = events.sparkSession
    folder = new_folder(spark, "events")
    checked = quality.check_events(events, as_of)

    def split(batch: DataFrame, batch_id: int) -> None:
        marked = batch.withColumn("side", F.when(c("quality_status") == "FAIL", "dead").otherwise("clean"))
        marked.write.mode("overwrite").partitionBy("side").parquet(f"{folder}/data/batch={batch_id}")

    run_once(checked, split, folder)
    stored = spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data")
    return stored.where("side = 'clean'").drop("side", "batch"), stored.where("side = 'dead'").drop("side", "batch")


def stream_reliability(events: DataFrame) -> DataFrame:
    """Source scores over a stream of (source, seq, passed): scores before and after each event.

    A micro-batch is walked like a batch, from the last scores of the batch before it: one row per source.
    """
    spark = events.sparkSession
    folder = new_folder(spark, "reliability")

    def walk(batch: DataFrame, batch_id: int) -> None:
        last = read_if_there(spark, f"{folder}/scores/batch={batch_id - 1}")
        ranked = index_rows(stage(batch), ["source"], ["seq"], F.floor(c("seq") / 100_000))
        scored = quality.clamp_walk(ranked, start=last)
        scored.write.mode("overwrite").parquet(f"{folder}/data/batch={batch_id}")
        ends = spark.read.schema(scored.schema).parquet(f"{folder}/data/batch={batch_id}").groupBy("source").agg(F.max_by("score_after", "seq").alias("score"))
        kept = ends if last is None else ends.unionByName(last.join(ends.select("source"), "source", "left_anti"))
        kept.write.mode("overwrite").parquet(f"{folder}/scores/batch={batch_id}")

    run_once(events, walk, folder)
    return spark.read.parquet(f"{folder}/data").drop("batch")


def stream_news_dedupe(articles: DataFrame, table_path: str) -> DataFrame:
    """Insert an article stream into a news table, dropping exact duplicates without a time limit.

    A micro-batch reads the key buckets it may hit, never the stored articles; ``sources/keytable`` tells how.
    """
    from quantloom.operators.news import insert_news_batch

    folder = new_folder(articles.sparkSession, "news")

    def insert(batch: DataFrame, batch_id: int) -> None:
        insert_news_batch(batch, table_path, batch_id)

    run_once(articles, insert, folder)
    return articles.sparkSession.read.parquet(f"{table_path}/articles").drop("batch")


class VectorTable:
    """Stored vectors in cells as partitions, with the bounds of each cell; ``operators/vectors`` tells how cells bound products.

    Folders per batch: ``vectors`` by cell, ``boxes`` (one row per cell, as all batches so far left them) and ``reads``. The
    cells are fitted to the first batch and stay. A batch reads earlier batches only and overwrites its own folders, so replays are harmless.
    """

    def __init__(self, spark: SparkSession, root: str, depth: int = 8):
        self.spark, self.root, self.depth = spark, root, depth

    def cells(self, batch: DataFrame) -> vectors.Cells:
        found = read_if_there(self.spark, f"{self.root}/cells")
        if found is None:
            made = vectors.fit_cells(batch, depth=self.depth)
            row = (made.axes.tobytes(), made.on.tobytes(), made.cuts.tobytes(), made.depth)
            self.spark.createDataFrame([row], "axes binary, `on` binary, cuts binary, depth int").write.mode("overwrite").parquet(f"{self.root}/cells")
            return made
        r = found.first()
        axes = np.frombuffer(r.axes)
        side = round(len(axes) ** 0.5)
        return vectors.Cells(axes.reshape(side, side), np.frombuffer(r["on"], np.int64), np.frombuffer(r.cuts), r.depth)

    def _boxes(self, batch_id: int) -> pd.DataFrame:
        for before in range(batch_id - 1, -1, -1):
            found = read_if_there(self.spark, f"{self.root}/boxes/batch={before}")
            if found is not None:
                return pd.DataFrame([r.asDict() for r in found.collect()], columns=["cell", "n", "low", "high", "rest"])  # MAX_CELLS rows at most
        return pd.DataFrame(columns=["cell", "n", "low", "high", "rest"])

    def insert(self, batch: DataFrame, batch_id: int, threshold: float) -> None:
        """Store the vectors of a batch that are no near-duplicates of stored or earlier ones."""
        batch = stage(batch.select(c("id").cast("bigint").alias("id"), "embedding"))
        cells, before = self.cells(batch), self._boxes(batch_id)
        asked = vectors.with_cells(vectors.tiles(vectors.placed(batch, cells)), before, F.lit(threshold))
        wanted = sorted(r.cell for r in asked.select(F.explode("want").alias("cell")).distinct().collect())
        near = None
        if wanted:
            near = self.spark.read.parquet(f"{self.root}/vectors").where(c("cell").isin(wanted) & (c("batch") < batch_id)).select("id", "embedding")
        kept = stage(vectors.greedy_distinct(batch, threshold, near, cells=cells))
        at = vectors.placed(kept, cells)
        kept.join(at.select("id", "cell"), "id").repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/vectors/batch={batch_id}")
        grown = pd.concat([before, vectors.boxes(vectors.tiles(at))])
        rows = []
        for cell, g in grown.groupby("cell"):
            rows.append((int(cell), int(g.n.sum()), np.min(g.low.tolist(), 0).tolist(), np.max(g.high.tolist(), 0).tolist(), float(g.rest.max())))
        self.spark.createDataFrame(rows, "cell int, n bigint, low array<double>, high array<double>, rest double").write.mode("overwrite").parquet(f"{self.root}/boxes/batch={batch_id}")
        self.spark.createDataFrame([(batch_id, len(before), len(wanted))], "batch_id bigint, cells_stored bigint, cells_read bigint").write.mode("overwrite").parquet(
            f"{self.root}/reads/batch={batch_id}")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/vectors").drop("batch", "cell")

    def reads(self) -> DataFrame:
        """Per batch: cells that held vectors before it, and how many of them were read."""
        return self.spark.read.parquet(f"{self.root}/reads").select("batch_id", "cells_stored", "cells_read")


def stream_vector_dedupe(stream: DataFrame, table_path: str, threshold: float = 0.92, depth: int = 8) -> DataFrame:
    """Store the vectors of a stream that are no near-duplicates of stored or earlier ones."""
    spark = stream.sparkSession
    table = VectorTable(spark, table_path, depth)
    run_once(stream, lambda batch, batch_id: table.insert(batch, batch_id, threshold), new_folder(spark, "vectors"))
    return table.rows()


def stream_lifecycle(events: DataFrame) -> DataFrame:
    """Lifecycle per correlation id over a stream: events are stored, states derived by key."""
    folder = new_folder(events.sparkSession, "lifecycle")
    run_once(events, versioned_sink(folder), folder)
    return memory.lifecycle(events.sparkSession.read.parquet(f"{folder}/data"))


LIVE_STATE = "correlation_id string, state string, completed string, events bigint, first_ts timestamp, last_ts timestamp, error string"


def expiring_lifecycle(events: DataFrame, ttl: str = "1 day", lateness: str = "1 minute") -> DataFrame:
    """Lifecycle per correlation id with keyed state and a timer: a row per change, in update mode.

    State per id is its last state, the completed ones, counts and times; no event is stored. An id without an event for
    ``ttl`` of event time becomes EXPIRED and its state is removed, by a timer or, within a batch, by the gap itself;
    a later event starts it anew. Events later than ``lateness`` are dropped. Events of a batch are taken by ts, then seq.
    """
    span = pd.Timedelta(ttl)

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(name: str, held: tuple) -> tuple:
            return (key[0], name, held[1], held[2], pd.Timestamp(held[3], unit="us"), pd.Timestamp(held[4], unit="us"), held[5] or None)

        held, out = state.get if state.exists else None, []
        if state.hasTimedOut:
            state.remove()
            out.append(row("EXPIRED", held))
        else:
            gap, events = span.value // 1000, []
            for batch in batches:  # plain tuples: most ids have few events a batch, and a table of its own for each is dear
                times = batch["ts"].to_numpy("datetime64[ns]")
                events += zip(np.isnat(times).tolist(), (times.astype("int64") // 1000).tolist(), batch["seq"].tolist(), batch["state"].tolist(), batch["error"].tolist())
            events.sort(key=lambda e: e[:3])
            done = set(held[1].split("|")) - {""} if held else set()
            for _, at, _, name, error in events:
                if held is not None and at - held[4] > gap:
                    out.append(row("EXPIRED", (held[0], "|".join(sorted(done)), *held[2:])))
                    held, done = None, set()
                if name not in memory.UNCOUNTED_STATES:
                    done.add(name)
                held = (name, "", (held[2] if held else 0) + 1, held[3] if held else at, max(at, held[4]) if held else at,
                        error or "" if name == "FAILED" else held[5] if held else "")
            held = (held[0], "|".join(sorted(done)), *held[2:])
            over = (held[4] + gap) // 1000
            if over < state.getCurrentWatermarkMs():  # an old event of a new batch: its timer would lie in the past
                out.append(row("EXPIRED", held))
                if state.exists:
                    state.remove()
            else:
                out.append(row(held[0], held))
                state.update(held)
                state.setTimeoutTimestamp(over)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in LIVE_STATE.split(", ")])

    if "error" not in events.columns:
        events = events.withColumn("error", F.lit(None).cast("string"))
    return (
        events.select("correlation_id", "state", "ts", "seq", "error").withWatermark("ts", lateness).groupBy("correlation_id").applyInPandasWithState(
            step, LIVE_STATE, "state string, completed string, events bigint, first_us bigint, last_us bigint, error string",
            "update", GroupStateTimeout.EventTimeTimeout))


def live_lifecycle(events: DataFrame, ttl: str, lateness: str = "1 minute") -> tuple[DataFrame, DataFrame]:
    """Run ``expiring_lifecycle`` over what is there: (last row of each session, state rows held after each batch)."""
    spark = events.sparkSession
    folder = new_folder(spark, "live-lifecycle")
    query = (
        expiring_lifecycle(events, ttl, lateness).writeStream.outputMode("update").foreachBatch(versioned_sink(folder))
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    sizes = [(p["batchId"], s["numRowsTotal"], p["numInputRows"]) for p in map(lambda x: json.loads(x.json), query.recentProgress) for s in p["stateOperators"]]
    held = spark.createDataFrame(sizes, "batch_id bigint, state_rows bigint, input_rows bigint")
    rows = spark.read.parquet(f"{folder}/data").drop("batch")
    newest = F.struct("batch_id", "events", (c("state") == "EXPIRED").alias("over"))
    last = rows.withColumn("_v", newest).groupBy("correlation_id", "first_ts").agg(F.max_by(F.struct(*[n for n in rows.columns if n not in ("correlation_id", "first_ts")]), "_v").alias("_r"))
    return last.select("correlation_id", "first_ts", "_r.*").drop("batch_id"), held


def stream_bandit(feedback: DataFrame) -> DataFrame:
    """Reward sums per strategy over a feedback stream, as upper-confidence scores."""
    folder = new_folder(feedback.sparkSession, "bandit")
    sums = feedback.withColumn("reward", memory.reward()).groupBy("strategy_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("reward").alias("total"))
    run_once(sums, versioned_sink(folder), folder, "update")
    return memory.ucb(read_versions(feedback.sparkSession, folder, ["strategy_name"]))


def correlated(raw: DataFrame, sentiment: DataFrame, within: str = "1 hour") -> DataFrame:
    """Join two event streams on the correlation id within a time range."""
    a = raw.select("correlation_id", c("ts").alias("raw_ts"), c("payload").alias("raw_payload")).withWatermark("raw_ts", within)
    b = sentiment.select(c("correlation_id").alias("_id"), "ts", "payload").withWatermark("ts", within)
    near = (c("correlation_id") == c("_id")) & (c("ts") >= c("raw_ts")) & (c("ts") <= c("raw_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).drop("_id")
