"""Hard negatives by rotated one-bit codes with stored alignment, and integer scores for what the codes cannot decide.

A vector's code is the signs of its coordinates under ``ROTATIONS`` random rotations. Turning the signs back gives the
code vector z; beside the code its length and the cosine ("alignment") between z and the vector are stored. For a query q,
quantised to ``PLANES`` bits, <z, q> comes from popcounts with an error that is known exactly. What is left of the vector
beside its share of z is orthogonal to z, so by Cauchy-Schwarz it adds at most ``sqrt(1 - alignment^2)`` times the length
of q's own part beside z: a certain interval for every inner product, no probability. A row whose interval cannot reach a list is left out;
all others are scored as integers. Results are exact.

1. Rows and anchors are packed into blocks of one label (``BLOCK``, ``ANCHORS`` rows at most), coded and staged. A hot label is many blocks.
2. Blocks of anchors meet the blocks of their label: the first ``positives`` rows of each anchor.
3. Blocks of anchors, now with these scores, meet all blocks, which are dealt into groups: the first ``negatives`` rows of
   other labels per positive. A task keeps the lists of a block of anchors while row blocks pass, so intervals are held
   against the list's last score; lists of all tasks are merged by a window over a few rows per list.

Work grows with anchors times rows, as the question does; shuffled are all rows once and the anchors once per group of
``GROUP`` row blocks. Nothing is collected but the row count and the most common length.

Defined cases: rows with a null id, label, vector or component, and those not of the most common length, take no part.
Repeated rows count each, also as positives and negatives of each other. Zero vectors score 0. Equal scores go to the
smaller id. Without a positive, or without a row in its range (as for negative scores), there is no result row. Scores must fit in a long.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.chat import grouped
from quantloom.llm.common import stage

ROTATIONS = 4
PLANES = 8
BLOCK = 4096
ANCHORS = 512
GROUP = 16  # row blocks that meet a copy of the anchors
HELD = 64  # blocks of anchors whose lists a task keeps
PAIRS = 1 << 16  # pairs that are scored at a time
SALT_ROWS = 1 << 16
NONE = np.iinfo(np.int64).min
c = F.col

BLOCKS = "label long, block long, rows binary, ids binary, vectors binary, codes binary, facts binary, bounds binary"
LISTS = "anchor long, slot int, row long, id long, score long"


@lru_cache(4)
def rotations(dims: int) -> np.ndarray:
    """(dims, ROTATIONS * dims): columns of orthogonal matrices, the same in every process."""
    draw = np.random.default_rng(29)
    return np.concatenate([np.linalg.qr(draw.standard_normal((dims, dims)))[0] for _ in range(ROTATIONS)], 1)


def packed_bits(bits: np.ndarray) -> np.ndarray:
    """Bits of the last axis as words of 64."""
    raw = np.packbits(bits, -1)
    wide = np.zeros((*raw.shape[:-1], -(-raw.shape[-1] // 8) * 8), np.uint8)
    wide[..., : raw.shape[-1]] = raw
    return wide.view(np.uint64)


def coded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, words) and facts (rows, 3): length of the vector, length of its code vector, alignment."""
    turn, real = rotations(vectors.shape[1]), vectors.astype(np.float64)
    size = np.linalg.norm(real, axis=1)
    unit = real / np.where(size > 0, size, 1.0)[:, None]
    bits = unit @ turn > 0
    z = (2.0 * bits - 1.0) @ turn.T
    length = np.linalg.norm(z, axis=1)
    length = np.where(length > 0, length, 1.0)
    return packed_bits(bits), np.stack([size, length, (z * unit).sum(1) / length], 1)


def intervals(queries: np.ndarray, codes: np.ndarray, facts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries, rows): certain lower and upper bounds of the inner products."""
    turned = queries.astype(np.float64) @ rotations(queries.shape[1])
    low = turned.min(1, keepdims=True)
    step = np.maximum((turned.max(1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-300)
    level = np.rint((turned - low) / step).astype(np.int64)
    rounded = low + step * level
    off = np.abs(turned - rounded).sum(1)
    both = np.zeros((len(queries), len(codes)))
    for j in range(PLANES):
        plane = packed_bits((level >> j & 1).astype(bool))
        for w in range(codes.shape[1]):
            both += np.bitwise_count(plane[:, w, None] & codes[None, :, w]) * float(1 << j)
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    dot = 2.0 * (low * ones[None, :] + step * both) - rounded.sum(1)[:, None]
    size, length, alignment = facts.T
    along, error = dot / length, off[:, None] / length
    whole = np.linalg.norm(queries.astype(np.float64), axis=1)[:, None]
    beside = np.sqrt(np.maximum(0.0, whole**2 - np.maximum(0.0, np.abs(along) - error) ** 2))
    middle = alignment * along
    width = np.abs(alignment) * error + np.sqrt(np.maximum(0.0, 1.0 - alignment**2)) * beside + 1e-9 * whole
    return size * (middle - width) - 1e-3, size * (middle + width) + 1e-3


def integer_scores(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS):
        out[at : at + PAIRS] = (a[i[at : at + PAIRS]] * b[j[at : at + PAIRS]]).sum(1)
    return out


class Lists:
    """The first ``k`` rows of each (anchor, slot) so far; a slot admits scores from ``low`` to ``high``."""

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.rows, self.low, self.high, self.k = rows, low, high, k
        self.least = np.full(low.shape, -np.inf)  # score of the last row of a full list
        self.found = [np.zeros((4, 0), np.int64) for _ in range(low.shape[1])]  # anchor, score, id, row

    def wanted(self, lower: np.ndarray, upper: np.ndarray, first: int) -> np.ndarray:
        """Which intervals of anchors from ``first`` on reach a list."""
        here = slice(first, first + len(lower))
        out = np.zeros(lower.shape, bool)
        for s in range(self.low.shape[1]):
            floor = np.maximum(self.low[here, s], self.least[here, s])
            out |= (upper >= floor[:, None]) & (lower <= self.high[here, s][:, None])
        return out

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        for s in range(self.low.shape[1]):
            fits = (score >= self.low[anchor, s]) & (score <= self.high[anchor, s]) & (score >= self.least[anchor, s]) & (rows != self.rows[anchor])
            if not fits.any():
                continue
            cells = np.concatenate([self.found[s], np.stack([anchor[fits], score[fits], ids[fits], rows[fits]])], 1)
            cells = cells[:, np.lexsort((cells[3], cells[2], -cells[1], cells[0]))]
            place = np.arange(cells.shape[1]) - np.searchsorted(cells[0], cells[0])
            self.found[s] = cells = cells[:, place < self.k]
            last = place[place < self.k] == self.k - 1
            self.least[cells[0][last], s] = cells[1][last]

    def rows_out(self) -> list[np.ndarray]:
        """Columns of LISTS."""
        parts = [np.stack([self.rows[f[0]], np.full(f.shape[1], s), f[3], f[2], f[1]]) for s, f in enumerate(self.found)]
        return list(np.concatenate(parts, 1))


def packed(rows: DataFrame, size: int, salts: int) -> DataFrame:
    """Staged blocks (``BLOCKS``) of one label each from rows (label, row, id, vector array<long>, bounds array<long>)."""
    names = [f.split()[0] for f in BLOCKS.split(", ")]

    def block(label: int, members: list[tuple]) -> pa.RecordBatch:
        vectors = np.array([m[3] for m in members], np.int64)
        codes, facts = coded(vectors)
        bounds = np.array([m[4] for m in members], np.int64)
        values = [label, members[0][1], *[np.array(v, np.int64).tobytes() for v in ([m[1] for m in members], [m[2] for m in members])],
                  vectors.tobytes(), codes.tobytes(), facts.tobytes(), bounds.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i < 2 else pa.binary()) for i, v in enumerate(values)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = (r for b in batches for r in zip(*[b.column(n).to_pylist() for n in ("label", "row", "id", "vector", "bounds")]))
        for label, members in grouped(source):
            held = []
            for m in members:
                held.append(m)
                if len(held) == size:
                    yield block(label, held)
                    held = []
            if held:
                yield block(label, held)

    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(salts))).repartition("label", "_salt").sortWithinPartitions("label")
    return stage(dealt.select("label", "row", "id", "vector", "bounds").mapInArrow(run, BLOCKS))


def scan(pairs: DataFrame, dims: int, slots: int, k: int, low: int, high: int, bounded: bool) -> DataFrame:
    """Lists (``LISTS``, several per anchor and slot) from pairs of an anchor block (columns a_...) and a row block.

    ``bounded``: slots admit from low to high per cent of the anchor's bounds; otherwise there is one slot for all scores.
    """
    schema = [f.split()[0] for f in LISTS.split(", ")]

    def out(lists: Lists) -> pa.RecordBatch:
        cells = lists.rows_out()
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if n == "slot" else pa.int64()) for n, v in zip(schema, cells)], schema)

    def opened(rows: bytes, bounds: bytes) -> Lists:
        rows = np.frombuffer(rows, np.int64)
        if not bounded:
            return Lists(rows, np.full((len(rows), 1), -np.inf), np.full((len(rows), 1), np.inf), k)
        score = np.frombuffer(bounds, np.int64).reshape(len(rows), slots)
        none = score == NONE
        return Lists(rows, np.where(none, np.inf, np.ceil(low * score.astype(np.float64) / 100)), np.where(none, -np.inf, np.floor(high * score.astype(np.float64) / 100)), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, Lists] = OrderedDict()
        names = ("a_block", "a_rows", "a_vectors", "a_bounds", "rows", "ids", "vectors", "codes", "facts")
        for batch in batches:
            for i in range(batch.num_rows):
                block, a_rows, a_vectors, a_bounds, rows, ids, vectors, codes, facts = [batch.column(n)[i].as_py() for n in names]
                if block not in held:
                    held[block] = opened(a_rows, a_bounds)
                    if len(held) > HELD:
                        yield out(held.popitem(last=False)[1])
                held.move_to_end(block)
                lists = held[block]
                rows, ids = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64)
                anchors, vectors = np.frombuffer(a_vectors, np.int64).reshape(-1, dims), np.frombuffer(vectors, np.int64).reshape(-1, dims)
                codes, facts = np.frombuffer(codes, np.uint64).reshape(len(rows), -1), np.frombuffer(facts, np.float64).reshape(-1, 3)
                for a in range(0, len(anchors), 32):
                    lower, upper = intervals(anchors[a : a + 32], codes, facts)
                    x, y = np.nonzero(lists.wanted(lower, upper, a))
                    if len(x):
                        lists.add(x + a, integer_scores(anchors, vectors, x + a, y), ids[y], rows[y])
        for lists in held.values():
            yield out(lists)

    return pairs.mapInArrow(run, LISTS)


def first_of(lists: DataFrame, k: int) -> DataFrame:
    """The k first rows of each (anchor, slot), numbered from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(c("score").desc(), "id", "row")
    return lists.withColumn("rank", F.row_number().over(order)).where(c("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Rows anchor_id, positive_id, rank, negative_id, positive_score, negative_score from (vec_id, label, vector array<long>).

    The negatives of an anchor and a positive are the first rows of other labels whose score is ``low`` to ``high`` per cent of the positive's.
    """
    sound = vectors.where(c("vec_id").isNotNull() & c("label").isNotNull() & c("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    rows = stage(sound.select(
        c("label").cast("long").alias("label"), F.monotonically_increasing_id().alias("row"), c("vec_id").cast("long").alias("id"),
        c("vector").cast("array<long>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")))
    lengths = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("n")).count().orderBy(c("count").desc(), "n").first()
    dims, count = (lengths["n"], lengths["count"]) if lengths else (1, 0)
    rows = rows.where(F.size("vector") == dims)
    salts, none = max(1, count // SALT_ROWS), F.array().cast("array<long>")
    blocks = packed(rows.withColumn("bounds", none), BLOCK, salts)
    anchors = rows.where("is_anchor").drop("is_anchor")

    def named(a: DataFrame) -> DataFrame:
        return a.select(c("label").alias("a_label"), c("block").alias("a_block"), c("rows").alias("a_rows"), c("vectors").alias("a_vectors"), c("bounds").alias("a_bounds"))

    columns = ("a_block", "a_rows", "a_vectors", "a_bounds", "rows", "ids", "vectors", "codes", "facts")
    asked = named(packed(anchors.withColumn("bounds", none), ANCHORS, salts))
    same = asked.join(blocks, c("a_label") == c("label")).select(*columns)
    nearest = stage(first_of(scan(same, dims, 1, positives, low, high, False), positives).select("anchor", "rank", c("id").alias("positive_id"), c("score").alias("positive_score")))

    ranked = nearest.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("_near"))  # ``positives`` entries at most
    bounds = F.concat(F.transform("_near", lambda s: s["positive_score"]), F.array_repeat(F.lit(int(NONE)).cast("long"), F.lit(positives) - F.size("_near")))
    bounded = anchors.drop("bounds").join(ranked, c("row") == c("anchor")).select("label", "row", "id", "vector", bounds.alias("bounds"))
    hunting = named(packed(bounded, ANCHORS, salts))
    groups = max(1, -(-blocks.count() // GROUP))
    dealt = blocks.withColumn("_group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    copies = hunting.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    other = copies.join(dealt, (c("_to") == c("_group")) & (c("a_label") != c("label"))).select(*columns)
    found = first_of(scan(other, dims, positives, negatives, low, high, True), negatives).select(
        c("anchor").alias("_anchor"), (c("slot") + 1).alias("_slot"), c("rank").cast("int").alias("rank"), c("id").alias("negative_id"), c("score").alias("negative_score"))
    names = anchors.select(c("row").alias("_row"), c("id").alias("anchor_id"))
    told = found.join(nearest, (c("_anchor") == c("anchor")) & (c("_slot") == nearest["rank"])).drop(nearest["rank"])
    return told.join(names, c("_anchor") == c("_row")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
