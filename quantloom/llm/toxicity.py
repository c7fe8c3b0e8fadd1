"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine, found in a block-max inverted index.

Terms are all lower-case words, hashed into ``TERMS`` numbers. Inverse document frequencies come from all documents and
whole texts. So that examples are near when they agree in what matters, each term's weight is multiplied by how
clearly its share differs between toxic and clean examples (a damped chi-square, ``FLOOR`` at least): no word is left out, and
any text that shares a word with an example, toxic or clean, has neighbours.

The index keeps examples in blocks. The ``COMMON`` terms that most examples have are a matrix with, per block, the largest
weight of each; all other terms are postings. A search adds up the postings, opens the ``OPENED`` blocks with the
highest bounds, and then multiplies the matrix of every block whose bound (largest score from postings, and the block's
largest common weights) reaches the k-th score so far, for ``TOGETHER`` texts at once; blocks
below are skipped. Its result equals a full scan's. Votes weigh by 1 / distance
and by how many labelled rows an example stands for; isotonic regression over the examples' own leave-one-out votes turns
them into probabilities. The nearest examples are returned as evidence.

Bounds: ``EXAMPLES`` labelled rows of each class fit the model (chosen by hash; all others only count towards its class's
size), one text for each, so index and broadcast do not grow with the input.

Defined cases: texts without a word that an example has (null and empty ones too) get the toxic share of examples without
words. Of several labels of a document the largest counts, null labels and null ids don't; of several texts of a labelled
id the first in order stands for it. Without examples the score is 0. Equal cosines go to
the smaller doc_id. Repeated rows are scored each; further columns pass by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import bounded_sample, stage

EXAMPLES = 3000
TERMS = 1 << 20
CHI_SQUARE = 100.0  # at this value a term has half of the full weight
FLOOR = 0.02  # share of the full weight that any term has
COMMON = 256  # terms that are columns of a matrix
BLOCK = 64
OPENED = 3
TOGETHER = 64  # texts searched at once
NEIGHBOURS = 15
EVIDENCE = 3
CACHED_WORDS = 300_000
CACHED_TEXTS = 20_000
PRIOR = 0.5  # weight of the base rate among the votes
WORD = re.compile(r"[^\W\d_]+")
c = F.col


class Numbers(dict):
    """Term numbers by word; a new word is hashed when it is first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % TERMS
        return number


class Terms:
    """Rising term numbers and their counts in texts; remembers about ``CACHED_WORDS`` words."""

    def __init__(self) -> None:
        self.known = Numbers()

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = WORD.findall((text or "").lower())
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        return np.unique(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)), return_counts=True)


# ---- index ---------------------------------------------------------------------------


class BlockMaxIndex:
    """Unit vectors of examples, sorted so that neighbours share their heaviest term, in blocks of ``BLOCK``."""

    def __init__(self, ids: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        order = sorted(range(len(ids)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), int(ids[i])))
        self.ids, self.order = ids[order], np.array(order, np.int64)
        blocks = max(1, -(-len(ids) // BLOCK))
        owner = np.repeat(np.arange(len(ids)), np.array([len(vectors[i][0]) for i in order], np.int64))
        term = np.concatenate([vectors[i][0] for i in order]) if len(order) else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in order]) if len(order) else np.zeros(0)
        having = np.bincount(term, minlength=terms)
        common = np.argsort(-having, kind="stable")[:COMMON]
        common = common[having[common] > 0]
        self.column = np.full(terms, -1, np.int32)  # of the matrix, by term
        self.column[common] = np.arange(len(common))
        column = self.column[term]
        held = column >= 0
        matrix = np.zeros((blocks * BLOCK, len(common)))
        matrix[owner[held], column[held]] = weight[held]
        self.matrix = matrix.reshape(blocks, BLOCK, len(common))
        self.largest = self.matrix.max(1)  # by block and column
        by_term = np.flatnonzero(~held)[np.argsort(term[~held], kind="stable")]
        self.owner, self.posted = owner[by_term], weight[by_term]
        self.starts = np.searchsorted(term[by_term], np.arange(terms + 1))  # where the postings of each term begin

    @staticmethod
    def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Positions first, first + 1, ... of each span, one after the other."""
        return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """(cosine, position) of the k nearest with a cosine above 0; ``without`` is left out."""
        return self.nearest_of_each([(terms, weights)], k, [without])[0]

    def nearest_of_each(self, searched: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """``nearest`` of several vectors; cosines do not depend on which vectors are searched together."""
        if not searched:
            return []
        blocks, size, columns = self.matrix.shape
        common, posted = np.zeros((len(searched), columns)), np.zeros((len(searched), blocks * size))
        for i, (terms, weights) in enumerate(searched):
            column = self.column[terms]
            held = column >= 0
            common[i, column[held]] = weights[held]
            first = self.starts[terms[~held]]
            many = self.starts[terms[~held] + 1] - first
            at = self.spans(first, many)
            posted[i] = np.bincount(self.owner[at], np.repeat(weights[~held], many) * self.posted[at], blocks * size)
            if without is not None and without[i] >= 0:
                posted[i, without[i]] = -np.inf
        scores = posted.reshape(len(searched), blocks, size).copy()
        bounds = scores.max(2) + common @ self.largest.T
        opened = np.argsort(-bounds, axis=1, kind="stable")[:, :OPENED]
        for i, best in enumerate(opened):
            for block in best:
                scores[i, block] += self.matrix[block] @ common[i]
        reached = np.maximum(kth(np.take_along_axis(scores, opened[:, :, None], 1).reshape(len(searched), -1), k), kth(scores.max(2), k))
        others = bounds + 1e-9 >= reached[:, None]
        np.put_along_axis(others, opened, False, 1)
        for block in np.flatnonzero(others.any(0)):
            rows = np.flatnonzero(others[:, block])
            scores[rows, block] += common[rows] @ self.matrix[block].T
        examples, least, found = self.matrix.reshape(blocks * size, columns), kth(scores.max(2), k), []
        for i, score in enumerate(scores.reshape(len(searched), -1)):
            at = np.flatnonzero(score >= max(least[i] - 1e-11, 1e-13))
            at = at[score[at] >= kth(score[None, at], k) - 1e-11]
            cosines = (posted[i, at] + (examples[at] * common[i]).sum(1)).round(12)  # in one order, so that equal examples are equally near
            best = np.lexsort((self.ids[at], -cosines))[:k]
            found.append([(s, p) for s, p in zip(cosines[best].tolist(), at[best].tolist()) if s > 0])
        return found


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row, 0 at least."""
    return np.maximum(0.0, np.partition(values, -k, axis=1)[:, -k]) if values.shape[1] >= k else np.zeros(len(values))


@dataclass
class Model:
    idf: np.ndarray  # by term, with what the labels say of it
    index: BlockMaxIndex
    labels: np.ndarray  # by position in the index
    shares: np.ndarray  # rows that an example stands for
    base: float
    steps: np.ndarray  # isotonic steps: votes from which on ...
    values: np.ndarray  # ... a probability holds

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return unit(terms, counts, self.idf)

    def vote(self, near: list[tuple[float, int]]) -> float:
        at = np.array([p for _, p in near], np.int64)
        weight = self.shares[at] / (1.02 - np.array([s for s, _ in near]))
        return (float(weight @ self.labels[at]) + PRIOR * self.base) / (float(weight.sum()) + PRIOR)

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[tuple[float, int]]]]:
        """Of texts with these terms and counts: probability and nearest examples."""
        near = self.index.nearest_of_each([(f[0], self.vector(*f)) for f in found], NEIGHBOURS) if len(self.labels) else [[]] * len(found)
        return [(float(self.values[max(0, np.searchsorted(self.steps, self.vote(n), "right") - 1)]), n) if n else (self.base, n) for n in near]


def unit(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1.0 + np.log(counts)) * idf[terms]
    return values / np.sqrt(values @ values) if len(values) else values


def isotonic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools of rising votes whose weighted label means rise: where each begins and its smoothed mean."""
    pools: list[list[float]] = []  # start, weight, weighted labels
    for i in np.argsort(votes, kind="stable"):
        pools.append([votes[i], weights[i], weights[i] * labels[i]])
        while len(pools) > 1 and (pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1] or pools[-2][0] == pools[-1][0]):
            start, w, y = pools.pop()
            pools[-1][1] += w
            pools[-1][2] += y
    smooth = float(np.mean(weights))
    mean = float(weights @ labels / weights.sum())
    return np.array([p[0] for p in pools]), np.array([(p[2] + 0.5 * smooth * mean) / (p[1] + 0.5 * smooth) for p in pools])


# ---- fitting -------------------------------------------------------------------------


def labelled_sample(labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, toxic, share): about ``limit`` rows per class; share is how many rows of its class one stands for."""
    single = stage(labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    drawn = bounded_sample(single, "toxic", c("doc_id"), limit)
    sizes = single.groupBy("toxic").agg(F.greatest(F.count(F.lit(1)) / F.lit(float(limit)), F.lit(1.0)).alias("share"))
    return stage(drawn.join(sizes, "toxic").select("doc_id", "toxic", "share"))


def example_terms(docs: DataFrame, sample: DataFrame) -> list:
    """Rows (doc_id, toxic, share, terms, counts) of the sampled ids that have a document, by doc_id: one text for each."""
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic", "share").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Terms().of
        for batch in batches:
            found = [of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in ("doc_id", "toxic", "share")], *[pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (0, 1)]], ["doc_id", "toxic", "share", "terms", "counts"])

    kinds = dict(texts.dtypes)
    found = texts.mapInArrow(run, f"doc_id {kinds['doc_id']}, toxic {kinds['toxic']}, share double, terms array<long>, counts array<long>")
    return sorted(found.collect(), key=lambda r: r.doc_id)  # two times EXAMPLES rows or so


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term; TERMS numbers per task and on the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen, rows = Terms().of, np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                seen[of(text.as_py())[0]] += 1
            rows += batch.num_rows
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some])), pa.array(np.concatenate([[rows], seen[some]]))], ["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = counted.select(F.pmod("term", F.lit(64)).alias("part"), "term", "n").groupBy("part").agg(F.collect_list("term").alias("terms"), F.collect_list("n").alias("ns")).collect()
    seen, total = np.zeros(TERMS, np.int64), 0
    for r in found:
        terms, ns = np.array(r.terms, np.int64), np.array(r.ns, np.int64)
        total += int(ns[terms < 0].sum())
        seen[terms[terms >= 0]] = ns[terms >= 0]
    return total, seen


def told_apart(rows: list) -> np.ndarray:
    """Per term FLOOR to FLOOR + 1: a damped chi-square of its shares among toxic and clean examples."""
    seen, size = np.zeros((2, TERMS)), np.zeros(2)
    for r in rows:
        kind = int(r.toxic > 0)
        seen[kind, r.terms] += 1
        size[kind] += 1
    if not size.all():
        return np.ones(TERMS)
    clean, toxic = seen[0] / size[0], seen[1] / size[1]
    both = seen.sum(0) / size.sum()
    chi = (toxic - clean) ** 2 / (both * (1 - both) * (1 / size).sum() + 1e-12)
    return FLOOR + chi / (chi + CHI_SQUARE)


def fit(docs: DataFrame, sample: DataFrame) -> Model:
    """Model from all documents and the labelled sample (doc_id, toxic, share)."""
    rows = example_terms(docs, sample)
    documents, seen = document_frequencies(docs)
    idf = (np.log((1.0 + documents) / (1.0 + seen)) + 1.0) * told_apart(rows)
    full, empty = [r for r in rows if r.terms], [r for r in rows if not r.terms]
    mass = sum(r.share for r in empty)
    everything = sum(r.share for r in rows)
    overall = sum(r.share * (r.toxic > 0) for r in rows) / everything if rows else 0.0
    base = (sum(r.share * (r.toxic > 0) for r in empty) + overall) / (mass + 1.0)
    vectors = [(np.array(r.terms), unit(np.array(r.terms), np.array(r.counts), idf)) for r in full]
    index = BlockMaxIndex(np.array([r.doc_id for r in full], np.int64), vectors, TERMS)
    labels = np.array([float(full[i].toxic > 0) for i in index.order])
    shares = np.array([full[i].share for i in index.order])
    model = Model(idf, index, labels, shares, base, np.zeros(1), np.array([base]))
    votes = []
    for at in range(0, len(index.order), TOGETHER):
        some = index.order[at : at + TOGETHER]
        votes += [model.vote(near) if near else base for near in index.nearest_of_each([vectors[i] for i in some], NEIGHBOURS, list(range(at, at + len(some))))]
    if votes:
        model.steps, model.values = isotonic(np.array(votes), labels, shares)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score, predicted and evidence (nearest examples: doc_id, cosine, toxic) in place of the text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = [f for f in docs.schema.fields if f.name not in ("text", "score", "predicted", "evidence")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, of, known = held.value, Terms().of, {}
        for batch in batches:
            scores, evidence, texts = [], [], batch.column("text")
            for start in range(0, batch.num_rows, TOGETHER):
                found = [of(text.as_py()) for text in texts.slice(start, TOGETHER)]
                keys = [xxhash.xxh3_128_digest(terms.tobytes() + n.tobytes()) for terms, n in found]
                if len(known) >= CACHED_TEXTS:
                    known.clear()
                new = {key: f for key, f in zip(keys, found) if key not in known}
                for key, (value, near) in zip(new, m.scores(list(new.values()))):
                    known[key] = value, [{"doc_id": int(m.index.ids[p]), "cosine": s, "toxic": int(m.labels[p])} for s, p in near[:EVIDENCE]]
                scores += [known[key][0] for key in keys]
                evidence += [known[key][1] for key in keys]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in rest], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, kind)],
                [*[f.name for f in rest], "score", "predicted", "evidence"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["score double, predicted int, evidence array<struct<doc_id: long, cosine: double, toxic: int>>"])
    return docs.select(*[f"`{f.name}`" for f in rest], "text").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """Scores of ``docs``, learnt from the rows of ``labels`` (doc_id, toxic) that are among them."""
    return score(docs, fit(docs, labelled_sample(labels, examples)))
