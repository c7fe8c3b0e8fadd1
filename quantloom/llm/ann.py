"""Approximate nearest neighbours: a forest of random-projection trees, searched through a shared priority queue.

Trees are fitted on a bounded sample (``SAMPLE`` rows) and all rows are routed to a leaf of every tree. A query walks all
trees at once: one priority queue holds the branches not taken, by the summed squared distances to the splits passed, and
leaves are opened until they hold ``share`` of the rows. Rows of a leaf are packed into blocks of bounded size, queries
that open it too; the blocks meet in a join on (tree, leaf) and are multiplied. Each pair of blocks returns a query's
``k`` best, whose scores are recomputed one by one in double precision, so equal vectors get equal scores whatever block
they came from; the best of all blocks remain.

``share`` sets recall against work. It is measured: ``QUERIES`` sampled rows search the sample, and the smallest share
that reaches ``RECALL`` of their true neighbours there is taken. Clustered embeddings need a few hundredths of the rows; vectors
without structure, as in the test tables, need to open nearly as many as there are, or more (a row counts in each tree).

A hot leaf (many equal vectors) is many blocks, each multiplied on its own. Trees grow with the rows, to leaves of about
``BLOCK``, from depth ``DEPTH`` to ``MAX_DEPTH``. The forest has ``TREES`` times 2 ** ``MAX_DEPTH`` leaves at most and is broadcast.

Defined cases: vectors that are null, zero, hold a null or non-finite component or are not of the most common length
take no part, nor do null ids. Of several rows of an id the smallest vector counts. Equal scores go to the smaller id.
With fewer than ``k`` candidates all are returned. Further columns pass by.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.chat import grouped
from quantloom.llm.common import stage

TREES = 12
DEPTH, MAX_DEPTH = 5, 8
SAMPLE = 8192
LEAF_SAMPLE = 32  # sampled rows that a leaf has at least
QUERIES = 96  # sampled rows whose neighbours set the share
RECALL = 0.96
MARGIN = 1.1  # the share is taken so many times, as sampled neighbours are farther than those among all rows
BLOCK = 4096
c = F.col


@dataclass
class Forest:
    """Complete trees: the children of node i are 2i + 1 and 2i + 2; leaves are numbered from the left."""

    depth: int
    splits: np.ndarray  # (trees, nodes, dimensions)
    cuts: np.ndarray  # (trees, nodes)

    @staticmethod
    def fit(rows: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> Forest:
        while depth and len(rows) >> depth < LEAF_SAMPLE:
            depth -= 1
        draw, nodes = np.random.default_rng(seed), (1 << depth) - 1
        splits = draw.standard_normal((trees, nodes, rows.shape[1]))
        splits /= np.linalg.norm(splits, axis=2, keepdims=True)
        forest = Forest(depth, splits, np.zeros((trees, nodes)))
        for tree in range(trees):
            at = np.zeros(len(rows), np.int64)
            for node in range(nodes):
                here = rows[at == node] @ splits[tree, node]
                forest.cuts[tree, node] = np.median(here) if len(here) else 0.0
                at[at == node] = 2 * node + 1 + (here > forest.cuts[tree, node])
        return forest

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """(rows, trees, nodes): signed distances to the splits."""
        return np.einsum("rd,tnd->rtn", rows, self.splits, optimize=True) - self.cuts

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """(rows, trees): leaf of every row in every tree."""
        margins = self.margins(rows)
        at = np.zeros(margins.shape[:2], np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (np.take_along_axis(margins, at[:, :, None], 2)[:, :, 0] > 0)
        return at - ((1 << self.depth) - 1)

    def share_for(self, rows: np.ndarray, k: int, recall: float = RECALL, queries: int = QUERIES) -> float:
        """The share of ``rows`` that opened leaves must hold so that queries among them find this part of their k nearest."""
        asked = rows[:: max(1, len(rows) // queries)]
        at = np.arange(len(rows))[:: max(1, len(rows) // queries)]
        if len(rows) < 2:
            return 1.0
        scores = asked @ rows.T
        scores[np.arange(len(asked)), at] = -np.inf
        near = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(rows) - 1)]
        leaves, margins, count = self.leaves(rows), self.margins(asked), 1 << self.depth
        sizes = np.stack([np.bincount(leaves[:, t], minlength=count) for t in range(leaves.shape[1])])
        needed = []
        for i in range(len(asked)):
            opened = np.full(sizes.shape, np.inf)
            held = 0
            for tree, leaf in self.open_leaves(margins[i], sizes, np.inf):
                opened[tree, leaf] = held  # a leaf is opened while fewer rows are held
                held += sizes[tree, leaf]
            needed += opened[np.arange(leaves.shape[1])[None, :], leaves[near[i]]].min(1).tolist()
        return float(np.quantile(needed, recall, method="higher") / len(rows)) * MARGIN + 1e-9

    def open_leaves(self, margins: np.ndarray, sizes: np.ndarray, wanted: float) -> list[tuple[int, int]]:
        """Leaves (tree, leaf) of one query, nearest first, until they hold ``wanted`` rows."""
        first, found, held = (1 << self.depth) - 1, [], 0
        queue = [(0.0, tree, 0) for tree in range(margins.shape[0])]
        while queue and held < wanted:
            distance, tree, node = heapq.heappop(queue)
            while node < first:
                margin = margins[tree, node]
                near = 2 * node + 1 + (margin > 0)
                heapq.heappush(queue, (distance + margin * margin, tree, 4 * node + 3 - near))
                node = near
            found.append((tree, node - first))
            held += sizes[tree, node - first]
        return found


def usable(vectors: DataFrame) -> DataFrame:
    """Staged (vec_id, embedding) of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = vectors.select(c("vec_id").cast("long").alias("vec_id"), "embedding").where(
        c("vec_id").isNotNull() & c("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))
    single = stage(sound.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    common = single.groupBy(F.size("embedding").alias("n")).count().orderBy(c("count").desc(), "n").first()
    return single.where(F.size("embedding") == (common["n"] if common else 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def packed(routed: DataFrame, salts: int, kind: np.dtype) -> DataFrame:
    """Blocks (tree, leaf, ids, vectors) of at most BLOCK rows from rows (tree, leaf, id, vector)."""
    schema = pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (((t, f), i, v) for b in batches for t, f, i, v in zip(*[b.column(n).to_pylist() for n in ("tree", "leaf", "id", "vector")]))
        for (tree, leaf), members in grouped(rows):
            ids, parts = [], []

            def block() -> pa.RecordBatch:
                values = [[tree], [leaf], [np.array(ids, np.int64).tobytes()], [b"".join(parts)]]
                return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

            for _, i, vector in members:
                ids.append(i)
                parts.append(vector)
                if len(ids) >= BLOCK:
                    yield block()
                    ids, parts = [], []
            if ids:
                yield block()

    salted = routed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    placed = salted.repartition("tree", "leaf", "salt").sortWithinPartitions("tree", "leaf")
    return placed.select("tree", "leaf", "id", "vector").mapInArrow(run, "tree int, leaf int, ids binary, vectors binary")


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best in a block, other than itself; ties to the smaller id."""
    queries, vectors = queries.astype(np.float64), vectors.astype(np.float64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(queries), 256):
        rough = queries[a : a + 256] @ vectors.T
        rough[query_ids[a : a + 256, None] == ids[None, :]] = -np.inf
        least = np.partition(rough, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(rough), -np.inf)
        size = 1e-9 * (1.0 + np.abs(np.where(np.isfinite(least), least, 0.0)))
        for i in range(len(rough)):
            at = np.flatnonzero((rough[i] >= least[i] - size[i]) & (rough[i] > -np.inf))
            score = (vectors[at] * queries[a + i]).sum(1)
            order = np.lexsort((ids[at], -score))[:k]
            out.append((np.full(len(order), query_ids[a + i]), ids[at[order]], score[order]))
    return tuple(np.concatenate(v) for v in zip(*out))  # type: ignore[return-value]


def search(vectors: DataFrame, is_query: Column, k: int = 20, share: float | None = None, trees: int = TREES, depth: int | None = None) -> DataFrame:
    """The k nearest found of every query row: query_id, rank, vec_id, score (inner product). ``share`` is measured if not given."""
    base = usable(vectors)
    single = dict(base.dtypes)["embedding"] == "array<float>"
    kind = np.dtype(np.float32 if single else np.float64)
    count = base.count()
    drawn = base.where(F.pmod(F.xxhash64(F.lit("forest"), "vec_id"), F.lit(1 << 30)) < F.lit(min(1.0, SAMPLE / max(1, count)) * (1 << 30))).orderBy("vec_id").collect()
    sample = np.array([r.embedding for r in drawn], np.float64)
    depth = min(MAX_DEPTH, max(DEPTH, (count // BLOCK).bit_length())) if depth is None else depth
    forest = Forest.fit(sample if len(sample) else np.zeros((1, 1)), trees, depth)
    share = forest.share_for(sample, k) if share is None and len(sample) else share or 1.0
    held = base.sparkSession.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                rows = batch.slice(a, 1024)
                found = matrix(rows.column("embedding"))
                leaves = held.value.leaves(found.astype(np.float64))
                raw = [v.tobytes() for v in np.ascontiguousarray(found, kind)]
                n = leaves.shape[1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.tile(np.arange(n, dtype=np.int32), len(raw))), pa.array(leaves.reshape(-1).astype(np.int32)),
                    pa.array(np.repeat(rows.column("vec_id").to_numpy(), n)), pa.array([r for r in raw for _ in range(n)], pa.binary())], ["tree", "leaf", "id", "vector"])

    salts = max(1, count >> 16)
    routed = base.mapInArrow(route, "tree int, leaf int, id long, vector binary")
    blocks = stage(packed(routed, salts, kind))
    sizes = np.zeros((trees, 1 << forest.depth), np.int64)
    for r in blocks.groupBy("tree", "leaf").agg(F.sum(F.octet_length("ids") / 8).cast("long").alias("n")).collect():  # one row per leaf of the forest
        sizes[r.tree, r.leaf] = r.n

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256)
                found = matrix(rows.column("embedding"))
                margins = held.value.margins(found.astype(np.float64))
                raw = [v.tobytes() for v in np.ascontiguousarray(found, kind)]
                opened = [(t, f, i, raw[j]) for j, i in enumerate(rows.column("vec_id").to_pylist()) for t, f in held.value.open_leaves(margins[j], sizes, share * count)]
                cells = list(zip(*opened)) if opened else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cells, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["tree", "leaf", "id", "vector"])

    asked = base.where(is_query).repartition("vec_id").mapInArrow(walk, "tree int, leaf int, id long, vector binary")
    questions = stage(packed(asked, salts, kind).select(c("tree").alias("q_tree"), c("leaf").alias("q_leaf"), c("ids").alias("q_ids"), c("vectors").alias("q_vectors")))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_vectors, ids, found in zip(*[batch.column(n).to_pylist() for n in ("q_ids", "q_vectors", "ids", "vectors")]):
                q, v = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                cells = best_of(q, np.frombuffer(q_vectors, kind).reshape(len(q), -1), v, np.frombuffer(found, kind).reshape(len(v), -1), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], ["query_id", "vec_id", "score"])

    met = questions.join(blocks, (c("q_tree") == c("tree")) & (c("q_leaf") == c("leaf"))).select("q_ids", "q_vectors", "ids", "vectors")
    found = met.mapInArrow(multiply, "query_id long, vec_id long, score double").repartition("query_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(c("score").desc(), "vec_id")))
    return ranked.where(c("rank") <= k).select("query_id", "rank", "vec_id", "score")
