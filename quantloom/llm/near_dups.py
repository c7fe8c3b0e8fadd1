"""N-gram Jaccard join: MinHash banding proposes, full n-gram sets decide.

Texts become sets of hashed five-word shingles. Documents of equal sets are one text. The number of bands and of rows per
band is the most selective one that reaches ``TARGET_RECALL`` at the threshold. Band hashes are shuffled with an id each; a
bucket of several texts links each of them to its smallest id (never all pairs), and the components of these links bring
candidates together. Each candidate's text, found by its place and not by its id, goes to its component, where every pair is
compared on full sets; texts whose sizes rule the threshold out don't link, which keeps chains of unlike candidates short. A
large component is dealt into block pairs of bounded size, so no task holds more than two blocks.
A block pair returns, per text, how many it is linked to and one edge towards the smallest text it is connected with, so
the output grows with texts, not with pairs, while no link inside a component is lost.

Bounds: a block holds about ``BLOCK`` texts; bitmaps that spare texts without a candidate the shuffle have a bounded size.

Defined cases: words are runs of word characters, lower case. Null texts and texts without a word take part in no link.
A text of fewer than five words has one shingle, all its words. A document's class is the smallest doc_id of all that are
connected with it (null doc_ids come last). Repeated rows count as copies. Further columns pass by.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.chat import grouped
from quantloom.llm.common import ROW, bitmap, components, maybe_in, named_rows, stage, unstage, without_rows

SHINGLE = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
MAX_HASHES = 128
BLOCK = 128
CACHED_WORDS = 300_000
CHUNK = 2048  # shingles whose signature is computed at a time
WORD = re.compile(r"\w+")
c = F.col


def choose_bands(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the largest number of rows whose bands find a pair at the threshold with this probability."""
    for rows in range(hashes, 0, -1):
        bands = math.ceil(math.log(1.0 - recall) / math.log(1.0 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("too few hashes for this recall")


class Shingler:
    """Sets of shingles and their band hashes; remembers word hashes up to a bound."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        draw = np.random.default_rng(5)
        self.factors = draw.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.mixers = draw.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.known: dict[str, int] = {}

    def shingles(self, text: str | None) -> np.ndarray | None:
        """Sorted distinct hashes; None without a word."""
        words = WORD.findall((text or "").lower())
        if not words:
            return None
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            new = set(words)
        for word in new:
            known[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(SHINGLE, len(words))
        out = hashed[: len(words) - size + 1].copy()
        for i in range(1, size):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashed[i : len(words) - size + 1 + i]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return np.unique(out)

    def band_hashes(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        for a in range(0, len(shingles), CHUNK):
            np.minimum(least, (shingles[None, a : a + CHUNK] * self.factors[:, None] + self.shifts[:, None]).min(1), out=least)
        parts = (least >> np.uint64(20)).reshape(self.bands, self.rows) * self.mixers
        parts ^= parts >> np.uint64(31)
        return ((parts * self.mixers[::-1]).sum(1, dtype=np.uint64)).view(np.int64)


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def sketches(named: DataFrame, bands: int, rows: int) -> DataFrame:
    """Staged (row, ROW, doc_id, set_key, size, bands) of ``named_rows``: set_key and what follows are null without a word."""
    names = ["doc_id", *ROW]
    kinds = f"doc_id {dict(named.dtypes)['doc_id']}, _row_file string, _row_at long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(bands, rows)
        for batch in batches:
            keys, sizes, hashes = [], [], []
            for text in batch.column("text"):
                found = shingler.shingles(text.as_py())
                keys.append(None if found is None else set_key(found))
                sizes.append(None if found is None else len(found))
                hashes.append(None if found is None else shingler.band_hashes(found))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], [*names, "set_key", "size", "bands"])

    found = named.select(*names, "text").mapInArrow(run, f"{kinds}, set_key binary, size long, bands array<long>")
    return stage(found.withColumn("row", F.monotonically_increasing_id()))


def distinct_texts(found: DataFrame) -> DataFrame:
    """Staged (node, ROW, set_key, size, copies, bands), one row per set of shingles; node is its first row."""
    first = found.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct("row", *ROW, "size", "bands")).alias("_first"), F.count(F.lit(1)).alias("copies"))
    return stage(first.select(c("_first.row").alias("node"), *[c(f"_first.{n}").alias(n) for n in (*ROW, "size", "bands")], "set_key", "copies"))


def candidate_links(texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): each text of a bucket and the bucket's smallest, among texts whose sizes allow the threshold.

    Sets of a similarity of ``threshold`` differ in size by that factor at most, so they are in the same step of a scale of
    this factor or in neighbouring ones: each text is asked for in its own step and the next one.
    """
    banded = texts.select("node", "size", F.posexplode("bands").alias("band", "hash")).select("node", "size", F.xxhash64("band", "hash").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    likely = maybe_in(banded, "bucket", bitmap(shared, "bucket"), "_shared").where("_shared").drop("_shared")
    step = F.floor(F.log(c("size")) / -math.log(threshold) + 1e-9)
    keyed = stage(likely.withColumn("step", F.explode(F.array(step, step + 1))).select("node", F.xxhash64("bucket", "step").alias("bucket")))
    least = stage(keyed.groupBy("bucket").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select(c("bucket").alias("key"), "b"))
    return keyed.join(least, c("bucket") == c("key")).where("node <> b").select(c("node").alias("a"), "b")


def linked_pairs(sets: list[np.ndarray], first: int, threshold: float) -> list[tuple[int, int]]:
    """Pairs of a Jaccard similarity of ``threshold`` or more: all within the list, or between its first part and the rest."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if both >= threshold * (sizes.sum() - both) else []
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(column) > 1
    number = np.cumsum(often) - 1
    owner, column = owner[often[column]], number[column[often[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for a in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(column, [a, a + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1.0
        both += part @ part.T
    similar = both >= threshold * (sizes[:, None] + sizes[None, :] - both)
    if first:
        similar[:first, :first] = False
        similar[first:, first:] = False
    x, y = np.nonzero(np.triu(similar, 1))
    return list(zip(x.tolist(), y.tolist()))


def compare_blocks(dealt: DataFrame, bands: int, rows: int, threshold: float) -> DataFrame:
    """Per text of a block pair that has a link: (node, root, links, linked_copies)."""
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("linked_copies", pa.int64())])
    names = ("comp", "left", "right", "node", "copies", "block", "shingles", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(bands, rows)
        source = ((tuple(r[:3]), *r[3:]) for b in batches for r in zip(*[b.column(n).to_pylist() for n in names]))
        out: list[tuple[int, int, int, int]] = []
        for (_, left, right), members in grouped(source):
            texts = sorted(members, key=lambda m: (m[3] != left, m[1]))
            first = sum(m[3] == left for m in texts) if left != right else 0
            root = list(range(len(texts)))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            links, copies = [0] * len(texts), [0] * len(texts)
            if len(texts) > 1 and (left == right or 0 < first < len(texts)):
                sets = [shingler.shingles(m[5]) if m[4] is None else np.frombuffer(m[4], np.uint64) for m in texts]
                for x, y in linked_pairs(sets, first, threshold):
                    links[x] += 1
                    links[y] += 1
                    copies[x] += texts[y][2]
                    copies[y] += texts[x][2]
                    a, b = find(x), find(y)
                    if a != b:
                        small, large = (a, b) if texts[a][1] < texts[b][1] else (b, a)
                        root[large] = small
            out += [(texts[i][1], texts[find(i)][1], links[i], copies[i]) for i in range(len(texts)) if links[i]]
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out)], schema=schema)

    placed = dealt.repartition("comp", "left", "right").sortWithinPartitions("comp", "left", "right")
    return placed.select(*names).mapInArrow(run, "node long, root long, links long, linked_copies long")


def verified(named: DataFrame, texts: DataFrame, groups: DataFrame, bands: int, rows: int, threshold: float, block: int) -> DataFrame:
    """Staged block results of all candidate components (node, root).

    Members are joined to their text by row. Texts travel as they are to a component of one block, which takes their shingles;
    for components of several blocks shingles are taken once, before they are dealt out.
    """
    sizes = stage(groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).withColumnRenamed("root", "comp"))
    placed = groups.join(sizes, c("root") == c("comp")).select("node", "comp", "blocks")
    members = stage(placed.join(texts.select("node", *ROW, "copies"), "node"))
    likely = maybe_in(named.select(*ROW, "text"), ROW, bitmap(members, *ROW), "_member").where("_member").drop("_member")
    found = likely.join(members, list(ROW)).select("text", "node", "comp", "blocks", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(bands, rows)
        for batch in batches:
            several = np.array(batch.column("blocks")) > 1
            texts = batch.column("text").to_pylist()
            sets = [shingler.shingles(t).tobytes() if s else None for t, s in zip(texts, several)]
            kept = pa.array([None if s else t for t, s in zip(texts, several)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("node", "comp", "blocks", "copies")], pa.array(sets, pa.binary()), kept],
                                             ["node", "comp", "blocks", "copies", "shingles", "text"])

    carried = found.mapInArrow(run, "node long, comp long, blocks int, copies long, shingles binary, text string")
    dealt = carried.withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return stage(compare_blocks(dealt.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")}).drop("other"), bands, rows, threshold))


def classified(named: DataFrame, threshold: float, recall: float, block: int) -> DataFrame:
    """Per row of ``named_rows``: ROW, doc_id and what is known of its text (``_key`` and the rest are null without a word)."""
    bands, rows = choose_bands(threshold, recall)
    sketched = sketches(named, bands, rows)
    texts = distinct_texts(sketched)
    found = stage(sketched.select(*ROW, "doc_id", "set_key"))
    unstage(sketched)
    groups = stage(components(candidate_links(texts, threshold)))
    pairs = verified(named, texts, groups, bands, rows, threshold, block)
    counts = stage(pairs.groupBy("node").agg(F.sum("links").alias("links"), F.sum("linked_copies").alias("linked_copies")))
    linked = stage(components(pairs.select(c("node").alias("a"), c("root").alias("b"))).withColumnRenamed("root", "class"))
    own = found.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("text_id"))
    told = stage(texts.select("node", "set_key", "copies").join(own, "set_key").join(linked, "node", "left").join(counts, "node", "left").select(
        "set_key", "copies", "text_id", F.coalesce("class", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("linked_copies", F.lit(0)).alias("linked_copies")))
    unstage(texts, groups, pairs, counts)
    smallest = stage(told.groupBy("class").agg(F.min("text_id").alias("class_id")))
    final = stage(told.join(smallest, "class").select(c("set_key").alias("_key"), "copies", "text_id", "class", "class_id", "links", "linked_copies"))
    return found.join(final, c("set_key") == c("_key"), "left")


def join_similar(docs: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id, text_id, copies, n_linked_texts and n_links.

    class_id: smallest doc_id of all connected documents; text_id: of those with equal shingles; copies: how many these
    are; n_linked_texts: other texts of the threshold's similarity; n_links: other documents, copies counted.
    """
    joined = classified(named_rows(docs.select("doc_id", "text")), threshold, recall, block)
    alone = c("_key").isNull()
    return joined.select(
        "doc_id", F.when(alone, c("doc_id")).otherwise(c("class_id")).alias("class_id"), F.when(alone, c("doc_id")).otherwise(c("text_id")).alias("text_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.coalesce("links", F.lit(0)).cast("long").alias("n_linked_texts"),
        F.coalesce(c("linked_copies") + c("copies") - 1, F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, the one with the smallest doc_id (null comes last).

    Rows are told apart by where they lie, so null and repeated ids neither take others along nor save copies, and only
    texts with a candidate pass a shuffle.
    """
    named = named_rows(docs)
    several = stage(classified(named, THRESHOLD, TARGET_RECALL, BLOCK).where("linked_copies + copies > 1").select(*ROW, "doc_id", "class"))
    first = several.groupBy("class").agg(F.min(F.struct(c("doc_id").isNull().alias("none"), "doc_id", *ROW)).alias("first"))
    gone = stage(several.select(*ROW).join(first.select(*[c(f"first.{n}").alias(n) for n in ROW]), list(ROW), "left_anti"))
    return without_rows(named, gone)
