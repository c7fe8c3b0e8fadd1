"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q, at least ``max(LEAST, EXPONENT * q)`` words long, that neither neighbour
extends. Words are the stretches between ASCII blanks. Per slice of texts:

1. Words become ranks per document, and ranks of 2, 4, 8, ... words come from pairs (prefix doubling). Every word of a run
   lies in four words that occur twice in the run, so stretches without such a repeat leave here; this drops no run.
2. The ranks order the rest as a suffix array does: equal blocks of 2 ** k words are an interval of it, for every k. A
   wavelet matrix over that order answers, for an interval, which is the next or the previous position after a given one.
3. For each k the blocks of b = 2 ** k words at multiples of b ask for their next and previous occurrence less than b words away.
   Occurrences of a block in a window of its own size form one progression, whose difference is the block's period, so
   the nearest one tells the only candidate. A run of period q holds such a block with q < b <= 2q, and the
   block occurs q words to its right or left inside the run: no run is missed.
4. Each candidate is extended both ways by the ranks, longest first, and kept if it is long enough. Its period is the
   smallest one: a shorter one would have brought a nearer occurrence.

All steps work on arrays of the slice (``CHARS`` characters, one text at least), so memory is bounded by the longest text:
about 200 bytes per word that is left after step 1. Nothing is shuffled; a text is one row's work.

Defined cases: null and empty texts have no words and no run. Repeated rows are judged each; further columns pass through,
those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import slices

LEAST = 6
EXPONENT = 4
CHARS = 2_000_000
CACHED_WORDS = 300_000
c = F.col

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = "n_words long, runs array<struct<start: long, length: long, period: long>>, best struct<start: long, length: long, period: long>, collapsed string"


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 on, equal for equal keys."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if len(keys) else 0
    return rank


def doubled(rank: np.ndarray, step: int) -> np.ndarray:
    """Ranks of twice as many words; what reaches past the end is less than all else."""
    after = np.zeros(len(rank), np.int64)
    after[: max(0, len(rank) - step)] = rank[step:] + 1
    return dense(rank * (len(rank) + 1) + after)


class WaveletMatrix:
    """Order statistics of ranges of a permutation of 0 to n - 1, one bit after the other, for many questions at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.ones, self.zeros = [], []
        for bit in reversed(range(self.bits)):
            one = (values >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(one)]).astype(np.int32))
            self.zeros.append(len(values) - int(one.sum()))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of [low, high) are less than ``bound``."""
        count = np.zeros(len(low), np.int64)
        for level, bit in enumerate(reversed(range(self.bits))):
            ones = self.ones[level]
            a, b = ones[low].astype(np.int64), ones[high].astype(np.int64)
            set_ = ((bound >> bit) & 1) == 1
            count += np.where(set_, (high - b) - (low - a), 0)
            low, high = np.where(set_, self.zeros[level] + a, low - a), np.where(set_, self.zeros[level] + b, high - b)
        return count

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of [low, high) that ``k`` others are less than."""
        value = np.zeros(len(low), np.int64)
        for level, bit in enumerate(reversed(range(self.bits))):
            ones = self.ones[level]
            a, b = ones[low].astype(np.int64), ones[high].astype(np.int64)
            few = (high - b) - (low - a)
            set_ = k >= few
            value += np.where(set_, 1 << bit, 0)
            k = np.where(set_, k - few, k)
            low, high = np.where(set_, self.zeros[level] + a, low - a), np.where(set_, self.zeros[level] + b, high - b)
        return value


def common_part(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """How many words agree from i and j on (``back``: before i and j), by ranks of ever fewer words."""
    n, got = len(levels[0]), np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        rank, size = levels[k], 1 << k
        open_ = np.arange(len(i))
        while len(open_):
            x, y = (i[open_] - got[open_] - size, j[open_] - got[open_] - size) if back else (i[open_] + got[open_], j[open_] + got[open_])
            inside = (x >= 0) & (y >= 0) & (x + size <= n) & (y + size <= n)
            same = np.zeros(len(open_), bool)
            same[inside] = rank[x[inside]] == rank[y[inside]]
            got[open_[same]] += size
            open_ = open_[same] if k == len(levels) - 1 else open_[:0]
    return got


def periodic_stretches(codes: np.ndarray, longest: int) -> np.ndarray:
    """(start, length, period) of all runs of a sequence whose stretches, ``longest`` at most, are parted by unique codes."""
    levels = [dense(codes)]
    while 2 << len(levels) <= longest:  # blocks of up to half of the longest stretch
        levels.append(doubled(levels[-1], 1 << (len(levels) - 1)))
    order = np.argsort(levels[-1], kind="stable")
    wavelet, found = WaveletMatrix(order), []
    for k in range(1, len(levels)):
        size, rank = 1 << k, levels[k]
        start = np.arange(0, len(codes) - size + 1, size)
        ordered = rank[order]
        low, high = np.searchsorted(ordered, rank[start], "left"), np.searchsorted(ordered, rank[start], "right")
        several = high - low > 1
        start, low, high = start[several], low[several], high[several]
        place = wavelet.below(low, high, start)
        ahead = place + 1 < high - low
        after = wavelet.kth(low[ahead], high[ahead], place[ahead] + 1) - start[ahead]
        behind = place > 0
        before = start[behind] - wavelet.kth(low[behind], high[behind], place[behind] - 1)
        for left, period in ((start[ahead], after), (start[behind] - before, before)):
            fits = (period < size) & (2 * period >= size)
            found.append(np.stack([left[fits], period[fits]], 1))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    left, period = pairs[:, 0], pairs[:, 1]
    ahead, behind = common_part(levels, left, left + period, False), common_part(levels, left, left + period, True)
    runs = np.stack([left - behind, behind + period + ahead, period], 1)
    return np.unique(runs[runs[:, 1] >= np.maximum(LEAST, EXPONENT * period)], axis=0)


def runs_of(documents: list[np.ndarray]) -> list[np.ndarray]:
    """Runs (start, length, period) of each sequence of word codes, by start and period."""
    none = np.zeros((0, 3), np.int64)
    sizes = np.array([len(d) for d in documents], np.int64)
    if not len(sizes) or sizes.max() < LEAST:
        return [none] * len(documents)
    owner = np.repeat(np.arange(len(documents)), sizes)
    codes = np.concatenate(documents).astype(np.int64)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    four = doubled(doubled(dense(owner * (codes.max() + 1) + codes), 1), 2)
    repeated = np.bincount(four)[four] > 1
    repeated &= place + 4 <= sizes[owner]
    near = np.concatenate([[0], np.cumsum(repeated)])
    at = np.arange(len(codes))
    covered = near[at + 1] - near[np.maximum(0, at - np.minimum(place, 3))] > 0
    edge = np.concatenate([[True], (owner[1:] != owner[:-1]) | (covered[1:] != covered[:-1])])
    first = np.flatnonzero(edge)
    length = np.diff(np.concatenate([first, [len(codes)]]))
    good = covered[first] & (length >= LEAST)
    first, length = first[good], length[good]
    if not len(first):
        return [none] * len(documents)
    moved = np.cumsum(length + 1) - length - 1  # where each stretch begins, a unique code behind each
    total = int(moved[-1] + length[-1] + 1)
    packed = -np.arange(1, total + 1)
    source = np.repeat(first - moved, length) + (within := np.repeat(moved, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
    packed[within] = owner[source] * (codes.max() + 1) + codes[source]
    runs = periodic_stretches(packed, int(length.max()))
    stretch = np.searchsorted(moved, runs[:, 0], "right") - 1
    origin = first[stretch] + runs[:, 0] - moved[stretch]
    runs = np.stack([place[origin], runs[:, 1], runs[:, 2]], 1)
    whose = owner[origin]
    order = np.lexsort((runs[:, 2], runs[:, 0], whose))
    runs, whose = runs[order], whose[order]
    cuts = np.searchsorted(whose, np.arange(len(documents) + 1))
    return [runs[a:b] for a, b in zip(cuts, cuts[1:])]


def strongest(runs: list[list[int]]) -> list[int] | None:
    """The run with the greatest exact length / period; ties to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def find_runs(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """Adds ``n_words``, ``runs`` (by start, then period), ``best`` (null without a run) and ``collapsed``: the words that no run
    holds after its first period, joined by one blank. The text itself is left out."""
    names = [n for n in docs.columns if n not in ("text", "n_words", "runs", "best", "collapsed")]
    kinds = [f for f in docs.schema.fields if f.name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for a, b in slices(texts, CHARS):
                words = [(t or b"").split() for t in texts[a:b]]  # of bytes: splits at ASCII blanks only
                if len(known) > CACHED_WORDS:
                    known.clear()
                documents = []
                for own in words:
                    for word in set(own).difference(known):
                        known[word] = len(known)
                    documents.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
                found, rest = [r.tolist() for r in runs_of(documents)], []
                for own, runs in zip(words, found):
                    if runs:
                        kept = bytearray(b"\x01") * len(own)
                        for start, length, period in runs:
                            kept[start + period : start + length] = bytes(length - period)
                        own = compress(own, kept)
                    rest.append(b" ".join(own))
                as_run = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found]
                best = [strongest(r) for r in found]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([
                    *[part.column(n) for n in names], pa.array([len(w) for w in words], pa.int64()), pa.array(as_run, pa.list_(RUN)),
                    pa.array([r and dict(zip(("start", "length", "period"), r)) for r in best], RUN), pa.array(rest, pa.binary()).cast(pa.string())],
                    [*names, "n_words", "runs", "best", "collapsed"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + [RESULT])
    source = c(text) if isinstance(text, str) else text
    return docs.select(*[c(f"`{n}`") for n in names], source.cast("binary").alias("_text")).mapInArrow(run, schema)


def repeated_text(doc_id: Column, text: Column) -> Column:
    """For a tenth of the documents, by the checksum of their ids, the text with its words from some place on repeated."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, g = F.size(words), F.floor(crc / 10)
    a = (g % n).cast("int")
    p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(cycle, F.lit(1), n - a)), " ")
    return F.when((crc % 10 == 0) & (n > 0), planted).otherwise(text)
