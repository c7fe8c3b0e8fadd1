"""Quality classifier trained without labels: overlapping heuristic labellers, EM, and a hashed linear scorer.

1. Every document gets a vote (good, bad, abstain) of each labeller; only counts of vote patterns reach the driver, at
   most ``3 ** len(LABELLERS)`` rows.
2. Expectation-maximisation over the pattern counts of all documents estimates how often each labeller is right per
   class. Pseudo-counts (``TRUST``) say that hardly any labeller objects to a good text, which also tells the classes apart.
3. The posterior of its pattern labels a bounded sample of documents (``SAMPLE`` of each side), on which a logistic
   scorer over hashed n-grams of character classes is fitted. It scores every document; below ``CUT`` it is rejected.

Defined cases: null texts and texts without a word score 0 and are rejected. Where one side has no example, all
others score the class's posterior. Repeated rows score alike; further columns pass by; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import ROW, bounded_sample, named_rows, stage

DIMS = 1 << 11
SAMPLE = 1500
CUT = 0.4
TRUST = ((3.0, 3.0), (10.0, 0.3))  # pseudo-votes of each labeller for and against a class, bad and good
ROUNDS = 60
CHUNK = 1 << 20
#: Characters by class: other symbols stay apart by code point.
LETTER, CAPITAL, DIGIT, BLANK, LINE, POINT = 1, 2, 3, 4, 5, 6
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    global _classes
    if _classes is None:
        def kind(i: int) -> int:
            s = chr(i)
            if s.isalpha():
                return CAPITAL if s.isupper() else LETTER
            if s.isdigit():
                return DIGIT
            if s == "\n":
                return LINE
            if s.isspace():
                return BLANK
            return POINT if s in ".,;:'\"?-()" else 16 + i % 112

        _classes = np.fromiter((kind(i) for i in range(0x110000)), np.uint8, 0x110000)
    return _classes


@dataclass
class Facts:
    """Numbers about a text that the labellers look at."""

    words: int
    letters: float  # share of the characters that are no blank, digit or point
    capitals: float  # share of the letters
    symbols: float  # symbols per word
    again: float  # share of words equal to the word before
    distinct: float  # distinct words of a word, in a window of 400 words
    length: float  # characters per word
    signs: float  # share of words of no letter or digit


def facts(text: str | None) -> Facts | None:
    """None if there is no word."""
    words = (text or "").split()
    if not words:
        return None
    counts = np.zeros(256, np.int64)
    for a in range(0, len(text), CHUNK):
        counts += np.bincount(classes()[np.frombuffer(text[a : a + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=256)
    n, solid = len(words), int(counts.sum() - counts[BLANK] - counts[LINE])
    letters = int(counts[LETTER] + counts[CAPITAL])
    windows = [words[a : a + 400] for a in range(0, n, 400)]
    distinct = sum(len(set(w)) for w in windows) / n
    return Facts(
        n, letters / max(1, solid - int(counts[DIGIT] + counts[POINT])), counts[CAPITAL] / max(1, letters), float(counts[16:].sum()) / n,
        sum(map(eq, words, words[1:])) / n, distinct, solid / n, sum(len(w) == 1 and not w.isalnum() for w in words) / n)


def between(value: float, good: tuple[float, float], bad: tuple[float, float]) -> int:
    """1: in the good range, 0: in the bad one, 2: no opinion."""
    return 1 if good[0] <= value <= good[1] else 0 if bad[0] <= value <= bad[1] else 2


LABELLERS = (
    lambda f: between(f.symbols, (0.0, 0.05), (0.4, math.inf)),
    lambda f: between(f.letters, (0.95, 1.0), (0.0, 0.8)),
    lambda f: between(f.capitals, (0.0, 0.25), (0.6, 1.0)),
    lambda f: between(f.again, (0.0, 0.05), (0.25, 1.0)) if f.words >= 10 else 2,
    lambda f: between(f.distinct, (0.35, 1.0), (0.0, 0.2)) if f.words >= 40 else 2,
    lambda f: between(f.length, (3.0, 9.0), (14.0, math.inf)),
    lambda f: between(f.signs, (0.0, 0.03), (0.2, 1.0)) if f.words >= 10 else 2,
)


def pattern(text: str | None, known: Facts | None = None) -> int:
    """The votes as one number; -1 without a word. ``known`` are the text's facts, if they are known."""
    found = known or facts(text)
    return -1 if found is None else sum(vote(found) * 3**i for i, vote in enumerate(LABELLERS))


@dataclass
class LabelModel:
    """``table[class, labeller, vote]`` are probabilities of the votes of those that have one; class 1 is good.

    An abstention says nothing: it has probability 1 in either class.
    """

    prior: float
    table: np.ndarray

    @staticmethod
    def votes(patterns: np.ndarray) -> np.ndarray:
        return np.stack([patterns // 3**i % 3 for i in range(len(LABELLERS))], 1)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of the good class."""
        votes = self.votes(patterns)
        log = [np.log(self.table[k][np.arange(votes.shape[1]), votes]).sum(1) + math.log((1 - self.prior, self.prior)[k]) for k in (0, 1)]
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Accuracies of the labellers from counts of vote patterns."""
    votes = LabelModel.votes(patterns)
    start = ((votes == 1).sum(1) + 1.0) / ((votes == 1).sum(1) + 3.0 * (votes == 0).sum(1) + 2.0)
    good, model = start, LabelModel(0.5, np.zeros((2, len(LABELLERS), 3)))
    for _ in range(rounds):
        table = np.zeros((2, len(LABELLERS), 3))
        for k, weight in enumerate((counts * (1 - good), counts * good)):
            agree, against = TRUST[k]
            for j in range(len(LABELLERS)):
                table[k, j] = np.bincount(votes[:, j], weights=weight, minlength=3) + against
                table[k, j, k] += agree - against
            table[k] /= table[k][:, :2].sum(1, keepdims=True)
            table[k][:, 2] = 1.0
        prior = (float(counts @ good) + 1.0) / (float(counts.sum()) + 2.0)
        model = LabelModel(min(max(prior, 1e-6), 1 - 1e-6), table)
        good = model.posterior(patterns)
    return model


def features(text: str | None, found: Facts | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """(dimensions, values): log shares of hashed n-grams of character classes, and steps of the repetition shares.

    ``found`` are the text's facts, if they are known.
    """
    found = found or facts(text)
    if found is None:
        return None
    counts, total = np.zeros(DIMS), 0
    for a in range(0, len(text), CHUNK):
        kinds = classes()[np.frombuffer(text[a : a + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        edge = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
        runs = np.diff(np.concatenate([edge, [len(kinds)]])) > 1
        code = (kinds[edge].astype(np.uint32) * 2 + runs) * np.uint32(2654435761)
        two = (code[:-1] >> 7) * np.uint32(2246822519) + code[1:]
        three = (two[:-1] >> 5) * np.uint32(3266489917) + code[2:]
        for hashed in (code, two, three):
            counts += np.bincount((hashed ^ (hashed >> 15)) * np.uint32(2654435761) >> np.uint32(33 - DIMS.bit_length()), minlength=DIMS)
        total += len(code)
    counts[:32] = 0.0  # kept for the steps
    for i, share in enumerate((found.again, 1.0 - found.distinct, found.signs, found.capitals)):
        for j, step in enumerate((0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8)):
            counts[i * 8 + j] = total / 4 if share > step else 0.0
    dims = np.flatnonzero(counts)
    return dims, np.log1p(counts[dims] / total * 8.0)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None, known: Facts | None = None) -> float:
        found = features(text, known)
        if found is None:
            return 0.0
        return float(1.0 / (1.0 + math.exp(-min(700.0, max(-700.0, float(self.weights[found[0]] @ found[1]) + self.bias)))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, rounds: int = 300, rate: float = 2.0, ridge: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels by accelerated full-batch steps; both sides weigh the same."""
    x = np.zeros((len(rows), DIMS), np.float32)
    for i, (dims, values) in enumerate(rows):
        x[i, dims] = values
    weight = np.where(soft > 0.5, 0.5 / max(1e-9, (soft > 0.5).sum()), 0.5 / max(1e-9, (soft <= 0.5).sum()))
    w, b, vw, vb = np.zeros(DIMS), 0.0, np.zeros(DIMS), 0.0
    for _ in range(rounds):
        error = weight * (1.0 / (1.0 + np.exp(-np.clip(x @ w + b, -50, 50))) - soft)
        vw, vb = 0.9 * vw - rate * (error @ x + ridge * w), 0.9 * vb - rate * float(error.sum())
        w, b = w + vw, b + vb
    return Scorer(w, b)


def vote_patterns(named: DataFrame) -> DataFrame:
    """(doc_id, ROW, pattern) of every row of ``named_rows``, staged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [pattern(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("doc_id", *ROW)], pa.array(votes, pa.int32())], ["doc_id", *ROW, "pattern"])

    return stage(named.select("doc_id", *ROW, "text").mapInArrow(run, f"doc_id {dict(named.dtypes)['doc_id']}, {ROW[0]} string, {ROW[1]} long, pattern int"))


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, Scorer]:
    """Learn from all documents' votes; no label is used."""
    named = named_rows(docs)
    patterns = vote_patterns(named)
    counts = patterns.where("pattern >= 0").groupBy("pattern").count().orderBy("pattern").toPandas()
    model = expectation_maximisation(counts["pattern"].to_numpy(np.int64), counts["count"].to_numpy(np.float64))
    posterior = model.posterior(counts["pattern"].to_numpy(np.int64))
    good = [int(p) for p, s in zip(counts["pattern"], posterior) if s > 0.5]
    sides = patterns.where("pattern >= 0").withColumn("_side", F.col("pattern").isin(good).cast("int"))
    drawn = stage(bounded_sample(sides, "_side", F.xxhash64("doc_id", ROW[1]), sample).select(*ROW, "pattern"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("text")]
            keep = [i for i, f in enumerate(found) if f is not None]
            yield pa.RecordBatch.from_arrays([
                batch.column("pattern").take(pa.array(keep, pa.int64())),
                pa.array([found[i][0].astype(np.int32).tobytes() for i in keep], pa.binary()),
                pa.array([found[i][1].astype(np.float32).tobytes() for i in keep], pa.binary())], ["pattern", "dims", "vals"])

    texts = named.select(*ROW, "text").join(F.broadcast(drawn), list(ROW)).select("pattern", "text")  # about 2 * sample rows, by the draw
    rows = texts.mapInArrow(run, "pattern int, dims binary, vals binary").orderBy("pattern", "dims", "vals").toPandas()
    if not len(rows):
        return model, Scorer(np.zeros(DIMS), 0.0)
    soft = model.posterior(rows["pattern"].to_numpy(np.int64))
    if (soft > 0.5).all() or (soft <= 0.5).all():
        mean = min(max(float(soft.mean()), 1e-6), 1 - 1e-6)
        return model, Scorer(np.zeros(DIMS), math.log(mean / (1 - mean)))
    pairs = [(np.frombuffer(d, np.int32), np.frombuffer(v, np.float32)) for d, v in zip(rows["dims"], rows["vals"])]
    return model, fit_scorer(pairs, soft)


def predict(docs: DataFrame, model: LabelModel, scorer: Scorer, names: tuple[str, ...] = ("quality_score", "votes_posterior")) -> DataFrame:
    """All columns of ``docs``, the scorer's score and the posterior of the votes (null without a word)."""
    held = docs.sparkSession.sparkContext.broadcast((model, scorer))
    rest = [f for f in docs.schema.fields if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, linear = held.value
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            found = [facts(t) for t in texts]
            scores = [linear.score(t, f) if f else 0.0 for t, f in zip(texts, found)]
            votes = np.array([pattern(t, f) if f else -1 for t, f in zip(texts, found)], np.int64)
            posterior = pa.array(labels.posterior(np.maximum(votes, 0)), mask=votes < 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), posterior], [*batch.schema.names, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"{n} double" for n in names])
    return docs.select(*[f"`{f.name}`" for f in rest]).mapInArrow(run, schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without what the scorer rejects."""
    scored = predict(docs, *fit(docs), names=("_quality_score", "_votes_posterior"))
    return scored.where(F.col("_quality_score") >= CUT).select(*[f"`{n}`" for n in docs.columns])
