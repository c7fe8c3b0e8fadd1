"""Exact cosine search and greedy near-duplicate removal, with bounds that spare pairs of tiles.

Vectors are divided by their length first; a zero vector has similarity 0 to everything.

Rows are turned onto the principal axes of a bounded sample (a rotation, so products stay as they are) and sorted into
cells by their leading coordinates: a tree of medians of that sample. Rows of a cell are packed into tiles of at most
``tile_rows``; a cell of any size is many tiles, so groups of copies make no hot task. A tile and a cell know the ranges of
their ``LEAD`` leading coordinates and the largest length of the rest, which bounds every product between them: the
ranges' largest products, plus the product of the remaining lengths. Pairs below the threshold, or below the
current k-th best of all the tile's rows, never meet. What is left is one matrix product per left tile and block of right
tiles; a task emits a few numbers per row, never the pairs. Products are taken in single precision; whatever its error could
let in or keep out is taken again in double precision, so results are exact, with bounds or without.

Cells are packed into blocks of at most ``BLOCK`` values, and left tiles are dealt to slices: a tile is repeated once per block
or slice that it has to meet, so shuffled bytes grow with rows times blocks. The driver sees the sample (``CELL_ROWS`` rows a cell, ``SAMPLE``
values at most) and one row per cell (``MAX_CELLS`` at most); vectors are never broadcast. ``planned_pairs`` tells how many cells each tile has to meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.session import stage

c = F.col
TILE_ROWS = 4096
SAMPLE = 1 << 22  # values of the sampled rows, at most
CELL_ROWS = 64  # rows sampled for each cell
BLOCK = 1 << 22  # values of the right tiles that a task holds
LINKS = 64  # earlier conflicts that a row lists per block
PIECE = 4096  # right rows of one matrix product
LEAD = 16
MAX_CELLS = 4096
CELL_SAMPLE = 16  # sampled rows that a cell has at least
SALT_ROWS = 1 << 16
ROUND = 1e-6  # similarities are rounded to six digits

ROWS = "cell int, id bigint, vector binary"
TILES = "cell int, tile bigint, n bigint, ids binary, vectors binary, low array<double>, high array<double>, rest double, first bigint, last bigint"


def unit_rows(column: pa.Array) -> np.ndarray:
    """Rows scaled to length 1; zero vectors stay."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1.0)


@dataclass
class Cells:
    """A rotation and a complete tree of medians over its leading coordinates; children of node i are 2i + 1 and 2i + 2."""

    axes: np.ndarray
    on: np.ndarray
    cuts: np.ndarray
    depth: int

    @staticmethod
    def fit(sample: np.ndarray, depth: int) -> Cells:
        dims = sample.shape[1]
        while depth and len(sample) >> depth < CELL_SAMPLE:
            depth -= 1
        values, vectors = np.linalg.eigh(sample.T @ sample)
        axes = vectors[:, np.argsort(-values, kind="stable")]
        rows, nodes = (sample @ axes)[:, :LEAD], (1 << depth) - 1
        on, cuts, at = np.zeros(nodes, np.int64), np.zeros(nodes), np.zeros(len(sample), np.int64)
        for node in range(nodes):
            here = at == node
            if here.any():
                on[node] = int(np.argmax(rows[here].std(0)))
                cuts[node] = np.median(rows[here, on[node]])
                at[here] = 2 * node + 1 + (rows[here, on[node]] > cuts[node])
        return Cells(axes if dims else np.zeros((0, 0)), on, cuts, depth)

    def cell_of(self, turned: np.ndarray) -> np.ndarray:
        at = np.zeros(len(turned), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (turned[np.arange(len(turned)), self.on[at]] > self.cuts[at])
        return at - ((1 << self.depth) - 1)


def fit_cells(vectors: DataFrame, tile_rows: int = TILE_ROWS, depth: int | None = None) -> Cells:
    """Cells of about a tile each, from rows drawn by the hash of their id."""
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    dims = max(1, size.dims or 1)
    depth = max(0, min(MAX_CELLS, -(-size.n // tile_rows)) - 1).bit_length() if depth is None else depth
    wanted = min(SAMPLE // dims, max(CELL_ROWS << depth, 16 * dims, 4096))
    share = min(1.0, wanted / max(1, size.n))
    drawn = vectors.where(F.pmod(F.xxhash64(F.lit("cells"), "id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(2 * wanted)
    found = drawn.select(c("id").cast("bigint").alias("id"), c("embedding").cast("array<double>").alias("embedding")).toArrow()  # not as Python floats
    rows = found.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    rows = rows[np.argsort(found.column("id").to_numpy(), kind="stable")]
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return Cells.fit(rows / np.where(norms > 0, norms, 1.0), depth)


def placed(vectors: DataFrame, cells: Cells) -> DataFrame:
    """Staged (cell, id, vector) of (id, embedding): the turned unit vector as bytes."""
    held = vectors.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = unit_rows(batch.column("embedding")) @ held.value.axes if batch.num_rows else np.zeros((0, 1))
            raw = [r.tobytes() for r in np.ascontiguousarray(turned)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.value.cell_of(turned), pa.int32()), batch.column("id"), pa.array(raw, pa.binary())], ["cell", "id", "vector"])

    return stage(vectors.select(c("id").cast("bigint").alias("id"), "embedding").mapInArrow(run, ROWS))


def tiles(rows: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Staged tiles (``TILES``) of ``placed`` rows. Large cells are dealt to several tasks."""
    sizes = {r.cell: r["count"] for r in rows.groupBy("cell").count().collect()}  # MAX_CELLS rows at most
    large = {cell: -(-n // SALT_ROWS) for cell, n in sizes.items() if n > SALT_ROWS}
    salts = F.create_map(*[F.lit(x) for pair in large.items() for x in pair])[c("cell")] if large else F.lit(1)

    def tile(cell: int, members: list[tuple[int, bytes]]) -> pa.RecordBatch:
        ids = np.array([m[0] for m in members], np.int64)
        vectors = np.frombuffer(b"".join(m[1] for m in members)).reshape(len(ids), -1)
        rest = np.linalg.norm(vectors[:, LEAD:], axis=1).max()
        values = [cell, int(ids.min()), len(ids), ids.tobytes(), vectors.tobytes(), vectors[:, :LEAD].min(0).tolist(), vectors[:, :LEAD].max(0).tolist(), float(rest), int(ids.min()), int(ids.max())]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [f.split()[0] for f in TILES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for cell, i, vector in zip(*[batch.column(n).to_pylist() for n in ("cell", "id", "vector")]):
                if held and (cell != at or len(held) == tile_rows):
                    yield tile(at, held)
                    held = []
                at = cell
                held.append((i, vector))
        if held:
            yield tile(at, held)

    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.coalesce(salts, F.lit(1)))).repartition("cell", "_salt").sortWithinPartitions("cell", "id")
    return stage(dealt.select("cell", "id", "vector").mapInArrow(run, TILES))


def boxes(tiled: DataFrame) -> pd.DataFrame:
    """One row per cell (``MAX_CELLS`` at most): ranges of the leading coordinates, largest rest, number of rows."""
    out = []
    for r in tiled.groupBy("cell").agg(
            F.sum("n").alias("n"), F.max("rest").alias("rest"), F.max(F.size("low")).alias("lead"),
            *[F.min(F.try_element_at("low", F.lit(i + 1))).alias(f"l{i}") for i in range(LEAD)],
            *[F.max(F.try_element_at("high", F.lit(i + 1))).alias(f"h{i}") for i in range(LEAD)]).collect():
        out.append((r.cell, r.n, [r[f"l{i}"] for i in range(r.lead)], [r[f"h{i}"] for i in range(r.lead)], r.rest))
    return pd.DataFrame(sorted(out), columns=["cell", "n", "low", "high", "rest"])


def bounds(low: np.ndarray, high: np.ndarray, rest: float, table: dict[str, np.ndarray]) -> np.ndarray:
    """Largest possible product between a box and each of the boxes of ``table``."""
    products = np.stack([low * table["low"], low * table["high"], high * table["low"], high * table["high"]])
    return products.max(0).sum(1) + rest * table["rest"]


def as_arrays(found: pd.DataFrame) -> dict[str, np.ndarray]:
    return {"cell": found.cell.to_numpy(np.int64), "low": np.array(found.low.tolist(), np.float64), "high": np.array(found.high.tolist(), np.float64), "rest": found.rest.to_numpy(np.float64)}


def with_cells(left: DataFrame, right_boxes: pd.DataFrame, floor: Column, only_nearest: bool = False) -> DataFrame:
    """Adds ``want``: the cells that may hold a product of ``floor`` or more with a row of the tile; or only the likeliest one."""
    if right_boxes.empty:
        return left.withColumn("want", F.array().cast("array<int>"))
    table = as_arrays(right_boxes)

    @F.pandas_udf("array<int>")
    def wanted(low: pd.Series, high: pd.Series, rest: pd.Series, cell: pd.Series, least: pd.Series) -> pd.Series:
        out = []
        for lo, hi, r, own, f in zip(low, high, rest, cell, least):
            if only_nearest and own in table["cell"]:
                out.append(np.array([own], np.int32))
                continue
            bound = bounds(np.asarray(lo), np.asarray(hi), r, table)
            at = [int(np.argmax(bound))] if only_nearest else np.flatnonzero(bound + ROUND >= f)
            out.append(table["cell"][at].astype(np.int32))
        return pd.Series(out)

    return left.withColumn("want", wanted("low", "high", "rest", "cell", floor.cast("double")))


def planned_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Per left tile how many cells of the right there are and how many it meets at ``threshold``."""
    found = boxes(right)
    return with_cells(left, found, F.lit(threshold)).select("cell", "tile", "n", F.lit(len(found)).alias("cells"), F.size("want").alias("met"))


Pieces = list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # of right rows: ids, vectors, vectors in single precision
Compare = Callable[[np.ndarray, np.ndarray, Pieces], tuple[np.ndarray, ...]]


@dataclass
class Blocks:
    """Cells packed in order into blocks of ``rows`` rows; a larger cell has several blocks, its tiles dealt by hash."""

    start: dict[int, int]
    count: dict[int, int]
    blocks: int

    @staticmethod
    def pack(found: pd.DataFrame, rows: int) -> Blocks:
        start, count, at, held = {}, {}, 0, 0
        for cell, n in zip(found.cell.tolist(), found.n.tolist()):
            if held and held + n > rows:
                at, held = at + 1, 0
            start[cell], count[cell] = at, -(-n // rows)
            at, held = at + count[cell] - 1, held + n if count[cell] == 1 else rows
        return Blocks(start, count, at + 1)

    def of_tile(self) -> Column:
        held = F.pandas_udf(lambda cells, deal: pd.Series([self.start[a] + b % self.count[a] for a, b in zip(cells, deal)], dtype="int32"), "int")
        return held("cell", F.pmod(F.xxhash64("tile"), F.lit(1 << 30)))

    def wanted(self) -> Column:
        held = F.pandas_udf(lambda want: pd.Series([np.unique([b for a in w for b in range(self.start[a], self.start[a] + self.count[a])]).astype(np.int32) for w in want]), "array<int>")
        return held("want")


def slack_of(dims: int) -> float:
    """Half a unit of the sixth digit, and what single precision may add to or take from a product of unit vectors."""
    return ROUND + (dims + 8) * 2.0**-23


def exact(own: np.ndarray, others: np.ndarray, at: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Similarities of the pairs (at, col) in double precision, a bounded number of values at a time."""
    out, step = np.empty(len(at)), max(1, (1 << 21) // max(1, own.shape[1]))
    for a in range(0, len(at), step):
        out[a : a + step] = np.einsum("ij,ij->i", own[at[a : a + step]], others[col[a : a + step]])
    return np.round(np.clip(out, 0.0, 1.0), 6)


def meet(left: DataFrame, right: DataFrame, found: pd.DataFrame, dims: int, compare: Compare, schema: str, tile_rows: int, earlier_only: bool = False) -> DataFrame:
    """Apply ``compare(left ids, left vectors, pieces)`` to every left tile and the right tiles of the cells it wants, block by block.

    ``found`` has the boxes of the right. With ``earlier_only``, right tiles without an id before the last of the left tile are left out.
    """
    most = max(1, BLOCK // max(1, dims))
    rows, asking = int(found.n.sum()), left.agg(F.sum("n")).first()[0] or 0
    blocks = Blocks.pack(found, min(most, max(tile_rows, -(-rows // 8))))
    slices = max(1, -(-asking // min(most, max(tile_rows, -(-asking // 8)))))
    names = ["_block", "_slice", "_left", "want", "cell", "ids", "vectors", "first", "last"]
    asked = left.where(F.size("want") > 0).withColumns({"_block": F.explode(blocks.wanted()), "_slice": F.pmod(F.xxhash64("cell", "tile"), F.lit(slices)).cast("int"), "_left": F.lit(True)})
    there = right.withColumns({"_block": blocks.of_tile(), "_slice": F.explode(F.sequence(F.lit(0), F.lit(slices - 1))), "_left": F.lit(False), "want": F.lit(None).cast("array<int>")})
    tasks = min(2 * blocks.blocks * slices, 4000)
    dealt = asked.select(*names).unionByName(there.select(*names)).repartition(tasks, "_block", "_slice").sortWithinPartitions("_block", "_slice", "_left", "cell", "first")
    kinds = {"bigint": pa.int64(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in names}
                if key != (r["_block"], r["_slice"]):
                    key, held, block = (r["_block"], r["_slice"]), [], None
                ids = np.frombuffer(r["ids"], np.int64)
                if not r["_left"]:
                    held.append((r["cell"], r["first"], ids, np.frombuffer(r["vectors"]).reshape(len(ids), -1)))
                    continue
                if not held:
                    continue
                if block is None:  # the block's right tiles as one table
                    ends, block = np.cumsum([0] + [len(h[2]) for h in held]), (np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]))
                    block += (block[1].astype(np.float32),)
                    held = [(h[0], h[1]) for h in held]
                want, own, spans = set(r["want"]), np.frombuffer(r["vectors"]).reshape(len(ids), -1), []
                for j, (cell, first) in enumerate(held):
                    if cell in want and not (earlier_only and first >= r["last"]):
                        if spans and spans[-1][1] == ends[j] and ends[j + 1] - spans[-1][0] <= PIECE:
                            spans[-1][1] = ends[j + 1]
                        else:
                            spans.append([ends[j], ends[j + 1]])
                pieces = [tuple(x[a:b] for x in block) for lo, hi in spans for a, b in zip(range(lo, hi, PIECE), [*range(lo + PIECE, hi, PIECE), hi])]
                for a in range(0, len(ids) if pieces else 0, 512):  # bounds the matrix of products
                    cells = compare(ids[a : a + 512], own[a : a + 512], pieces)
                    yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(cells, fields)], [n for n, _ in fields])

    return dealt.mapInArrow(run, schema)


def _best(k: int, earlier_only: bool = False) -> Compare:
    """The ``k`` most similar (earlier) rows, ties to the lower id."""
    def best(ids: np.ndarray, own: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, ...]:
        slack, own32 = slack_of(own.shape[1]), own.astype(np.float32)
        score, match = np.full((len(ids), k), -1.0), np.zeros((len(ids), k), np.int64)  # -1: nothing found yet
        for others, vectors, vectors32 in pieces:
            similar = own32 @ vectors32.T
            if earlier_only:
                similar[others[None, :] >= ids[:, None]] = -2.0
            least, open_rows = score[:, -1].copy(), np.flatnonzero(score[:, -1] < 0)
            if len(open_rows) and len(others) > 4 * k:
                least[open_rows] = np.partition(similar[open_rows], len(others) - k, axis=1)[:, len(others) - k] - slack
            cut = np.where(least > slack, least - slack, -1.5).astype(np.float32)  # products below zero count as zero
            at, col = np.nonzero(similar >= cut[:, None])
            better = (score[at, -1] < 1.0) | (others[col] < match[at, -1])  # of copies only lower ids matter
            at, col = at[better], col[better]
            if len(at):
                hit, place = np.unique(at, return_inverse=True)
                scores = np.concatenate([score[hit].ravel(), exact(own, vectors, at, col)])
                matches, row = np.concatenate([match[hit].ravel(), others[col]]), np.concatenate([np.repeat(np.arange(len(hit)), k), place])
                order = np.lexsort((matches, -scores, row))
                firsts = np.searchsorted(row[order], np.arange(len(hit)))[:, None] + np.arange(k)  # each row has its k old ones at least
                score[hit], match[hit] = scores[order][firsts], matches[order][firsts]
        some = score >= 0
        return np.repeat(ids, some.sum(1)), match[some], score[some]

    return best


def top_k(queries: DataFrame, stored: DataFrame, k: int = 5, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The ``k`` most similar stored vectors per query (id, embedding): (id, match, similarity, rank).

    Similarity is the cosine clamped to [0, 1] and rounded to 6 digits; ties go to the lower id. Tiles of queries first
    meet their likeliest cell; the k-th similarity found there rules out cells for the second pass.
    """
    cells = fit_cells(stored, tile_rows)
    right = tiles(placed(stored, cells), tile_rows)
    left = tiles(placed(queries, cells), tile_rows)
    found, schema = boxes(right), "id bigint, match bigint, similarity double"
    first = with_cells(left, found, F.lit(0.0), only_nearest=True)
    dims = len(cells.axes)
    begun = stage(meet(first, right, found, dims, _best(k), schema, tile_rows))
    order = Window.partitionBy("id").orderBy(c("similarity").desc(), "match")
    own = queries.select(c("id").cast("bigint").alias("id")).distinct().join(
        begun.withColumn("rank", F.row_number().over(order)).where(c("rank") == k).select("id", "similarity"), "id", "left")
    ids_of = F.pandas_udf(lambda raw: pd.Series([np.frombuffer(r, np.int64) for r in raw]), "array<bigint>")
    members = left.select("cell", "tile", F.explode(ids_of("ids")).alias("id"))
    floors = stage(members.join(own, "id").groupBy("cell", "tile").agg(F.min(F.coalesce("similarity", F.lit(0.0))).alias("floor")).select(
        c("cell").alias("_of"), c("tile").alias("_tile"), "floor"))
    bounded = first.withColumnRenamed("want", "met").join(floors, (c("cell") == c("_of")) & (c("tile") == c("_tile")))
    again = with_cells(bounded, found, c("floor")).withColumn("want", F.array_except("want", "met"))
    both = begun.unionByName(meet(again, right, found, dims, _best(k), schema, tile_rows))
    return both.withColumn("rank", F.row_number().over(order)).where(c("rank") <= k)


def conflicts(left: DataFrame, right: DataFrame, dims: int, threshold: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Ids of left ``tiles`` with an earlier right row above the threshold."""
    def find(ids: np.ndarray, own: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, ...]:
        slack, open_rows = slack_of(own.shape[1]), np.arange(len(ids))
        for others, vectors, vectors32 in pieces:
            similar = own[open_rows].astype(np.float32) @ vectors32.T
            at, col = np.nonzero(similar > (threshold - slack if threshold >= 0 else -np.inf))
            earlier = others[col] < ids[open_rows[at]]
            at, col = at[earlier], col[earlier]
            sure = (similar[at, col] > threshold + slack) | (threshold < 0)
            hit = np.zeros(len(open_rows), bool)
            hit[at[sure]] = True
            near = ~sure & ~hit[at]
            hit[at[near][exact(own[open_rows], vectors, at[near], col[near]) > threshold]] = True
            open_rows = open_rows[~hit]
        return (np.delete(ids, open_rows),)

    found = boxes(right)
    if found.empty:
        return left.select(c("first").alias("id")).limit(0)
    return meet(with_cells(left, found, F.lit(threshold)), right, found, dims, find, "id bigint", tile_rows, earlier_only=True).distinct()


def links(left: DataFrame, right: DataFrame, dims: int, threshold: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(id, earlier): ids of earlier right rows above the threshold, the lowest ``LINKS`` of each block of right tiles.

    A row with more has a link to itself, which says that its list is not whole.
    """
    def find(ids: np.ndarray, own: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, ...]:
        slack, own32 = slack_of(own.shape[1]), own.astype(np.float32)
        rows, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for others, vectors, vectors32 in pieces:
            similar = own32 @ vectors32.T
            at, col = np.nonzero(similar > (threshold - slack if threshold >= 0 else -np.inf))
            earlier = others[col] < ids[at]
            at, col = at[earlier], col[earlier]
            good = (similar[at, col] > threshold + slack) | (threshold < 0)
            good[~good] = exact(own, vectors, at[~good], col[~good]) > threshold
            rows, found = np.concatenate([rows, at[good]]), np.concatenate([found, others[col[good]]])
            order = np.lexsort((found, rows))
            rows, found = rows[order], found[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, found = rows[place <= LINKS], found[place <= LINKS]  # one more than is kept
        more = np.arange(len(rows)) - np.searchsorted(rows, rows) == LINKS
        return ids[rows], np.where(more, ids[rows], found)

    boxed = boxes(right)
    return meet(with_cells(left, boxed, F.lit(threshold)), right, boxed, dims, find, "id bigint, earlier bigint", tile_rows, earlier_only=True)


def settle(ids: DataFrame, linked: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Walk the greedy rule over links: (tables of kept ids, ids that stay open because a link list is not whole).

    A row without a link is kept; a row linked to a kept one is dropped, and links to dropped rows go. Only ids are shuffled and written.
    """
    kept: list[DataFrame] = []
    while not ids.isEmpty():
        free = stage(ids.join(linked.select("id").distinct(), "id", "left_anti"))
        if free.isEmpty():
            break
        kept.append(free)
        gone = stage(linked.join(free.select(c("id").alias("earlier")), "earlier", "left_semi").select("id").distinct())
        settled = free.unionByName(gone)
        linked = stage(linked.join(gone, "id", "left_anti").join(gone.select(c("id").alias("earlier")), "earlier", "left_anti").select("id", "earlier"))
        ids = stage(ids.join(settled, "id", "left_anti"))
    return kept, ids


def greedy_distinct(
    vectors: DataFrame, threshold: float = 0.92, stored: DataFrame | None = None,
    tile_rows: int = TILE_ROWS, cells: Cells | None = None,
) -> DataFrame:
    """Rows of ``vectors`` (id, embedding) kept by the greedy rule in id order: a row is a
    duplicate when its best earlier kept match is above ``threshold`` (strictly).

    Later copies of an identical vector always share the first one's conflicts, so they
    are removed first. Then vectors meet once: each row's earlier conflicts are listed (a bounded list), and rounds over
    these ids settle who stays. Rows whose list was cut meet the kept rows and, if still open, one another again.
    Everything ``stored`` counts as earlier than the batch.
    """
    first = stage(vectors.groupBy("embedding").agg(F.min("id").alias("id")).select(c("id").cast("bigint").alias("id"), "embedding"))
    cells = cells or fit_cells(first, tile_rows)
    open_rows, dims = placed(first, cells), len(cells.axes)
    if stored is not None:
        shifted = placed(stored.select((-c("id") - 1).alias("id"), "embedding"), cells)
        old = conflicts(tiles(open_rows, tile_rows), tiles(shifted, tile_rows), dims, threshold, tile_rows)
        open_rows = stage(open_rows.join(old, "id", "left_anti"))
    kept: list[DataFrame] = []
    while not open_rows.isEmpty():  # once, unless a row has more than ``LINKS`` links into a block
        tiled = tiles(open_rows, tile_rows)
        winners, still = settle(open_rows.select("id"), stage(links(tiled, tiled, dims, threshold, tile_rows)))
        kept += winners
        if still.isEmpty():
            break
        new = winners[0]  # the smallest open id settles in every pass, so there is one
        for more in winners[1:]:
            new = new.unionByName(more)
        rest = stage(open_rows.join(still, "id", "left_semi"))
        dropped = conflicts(tiles(rest, tile_rows), tiles(stage(open_rows.join(new, "id", "left_semi")), tile_rows), dims, threshold, tile_rows)
        open_rows = stage(rest.join(dropped, "id", "left_anti"))
    if not kept:
        return first.limit(0)
    ids = kept[0].select("id")
    for more in kept[1:]:
        ids = ids.unionByName(more.select("id"))
    return first.join(ids, "id", "left_semi")


def duplicate_matches(vectors: DataFrame, kept: DataFrame, threshold: float = -1.0, tile_rows: int = TILE_ROWS) -> DataFrame:
    """For each dropped row its most similar earlier kept row: (id, matched_id, similarity).

    ``threshold`` is the one that rows were dropped by, if known: every dropped row has a match above it.
    """
    cells = fit_cells(kept, tile_rows)
    dropped = vectors.join(kept.select("id"), "id", "left_anti")
    right = tiles(placed(kept, cells), tile_rows)
    boxed = boxes(right)
    asked = with_cells(tiles(placed(dropped, cells), tile_rows), boxed, F.lit(threshold))
    found = meet(asked, right, boxed, len(cells.axes), _best(1, earlier_only=True), "id bigint, matched_id bigint, similarity double", tile_rows, earlier_only=True)
    rank = F.struct("similarity", -c("matched_id"))
    return found.groupBy("id").agg(F.max_by("matched_id", rank).alias("matched_id"), F.max("similarity").alias("similarity"))
