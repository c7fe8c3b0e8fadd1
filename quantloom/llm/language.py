"""Language identification by the nearest of several clustered centroids per language.

Texts become hashed counts of letter n-grams (1 to 3, blanks between words), weighted by 1 + log count and by the
inverse document frequency over all training documents, and normalised. A bounded sample per language is clustered by
spherical k-means; a text gets the language of the centroid with the largest cosine. Each centroid also has a cutoff from
the distances of its own members: what lies beyond is flagged ``rejected`` (the nearest language is still named).

Bounds: ``SAMPLE`` documents of a language are clustered, a model has ``CLUSTERS`` x ``DIMS`` floats per language.
Document frequencies are counted over all training rows, in partial sums of at most ``DIMS`` rows per task.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so are all texts where no row can be
learned from. Equal cosines go to the smaller language. Repeated rows are predicted each; further columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import sampled_rows, stage

DIMS = 1 << 14
SAMPLE = 400
CLUSTERS = 4
ROUNDS = 8
UNKNOWN = "und"
FACTORS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
SHIFT = np.uint32(32 - DIMS.bit_length() + 1)
CHUNK = 1 << 20
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(dimensions, counts) of the hashed n-grams of a whole text; None if it has no letter."""
    codes = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = letters()[codes]
    if not alpha.any():
        return None
    counts = np.zeros(DIMS, np.int64)
    for start in range(0, len(codes), CHUNK):  # neighbours that begin in this chunk, so that long texts need no more memory
        count_chunk(np.where(alpha[start : start + CHUNK + 2], codes[start : start + CHUNK + 2], np.uint32(32)), counts)
    dims = np.flatnonzero(counts)
    return dims, counts[dims]


def count_chunk(codes: np.ndarray, counts: np.ndarray) -> None:
    a, b, d = FACTORS
    one = codes * a
    two = (one[:-1] ^ (one[:-1] >> 15)) * b + codes[1:]
    three = ((two[:-1] ^ (two[:-1] >> 13)) * d + codes[2:]) * a
    two = two * a
    blank = codes == 32
    for hashed, wanted in ((one, ~blank), (two, ~(blank[:-1] & blank[1:])), (three, ~(blank[:-2] & blank[1:-1]) & ~(blank[1:-1] & blank[2:]))):
        counts += np.bincount(hashed[:CHUNK][wanted[:CHUNK]] >> SHIFT, minlength=DIMS)


def weigh(dims: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1.0 + np.log(counts)) * idf[dims]
    norm = np.sqrt(values @ values)
    return values / norm if norm > 0 else values


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray  # (DIMS, number of centroids)
    cutoffs: np.ndarray

    def nearest(self, text: str | None) -> tuple[str, float, bool]:
        found = ngram_counts(text) if self.languages else None
        if found is None:
            return UNKNOWN, 0.0, True
        dims, counts = found
        cosines = weigh(dims, counts, self.idf) @ self.centroids[dims]
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[best], score, bool(1.0 - score > self.cutoffs[best])


def document_frequencies(train: DataFrame) -> np.ndarray:
    """Inverse document frequency of every dimension over all rows of ``train``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                if (found := ngram_counts(text.as_py())) is not None:
                    seen[found[0]] += 1
                    rows += 1
        dims = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *dims], pa.int32()), pa.array([rows, *seen[dims]], pa.int64())], ["dim", "n"])

    counted = train.select("text").mapInArrow(run, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).toPandas()
    rows = int(counted.loc[counted.dim == -1, "n"].sum())
    seen = np.zeros(DIMS)
    seen[counted.dim[counted.dim >= 0]] = counted.n[counted.dim >= 0]
    return np.log((1.0 + rows) / (1.0 + seen)) + 1.0


def cluster(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with farthest-first starts: centroids and a distance cutoff for each."""
    k = min(k, len(vectors))
    chosen = [int(np.argmax(vectors @ vectors.sum(0)))]
    while len(chosen) < k:
        chosen.append(int(np.argmin((vectors @ vectors[chosen].T).max(1))))
    centroids = vectors[chosen]
    for _ in range(rounds):
        member = np.argmax(vectors @ centroids.T, 1)
        sums = np.stack([vectors[member == j].sum(0) if (member == j).any() else centroids[j] for j in range(k)])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    cosines = vectors @ centroids.T
    member, distance = np.argmax(cosines, 1), 1.0 - cosines.max(1)
    spread = distance.std() or 0.05
    cutoffs = np.array([(distance[member == j].mean() if (member == j).any() else distance.mean()) + 4.0 * spread for j in range(k)])
    return centroids, cutoffs


def fit(train: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """Learn from rows (doc_id, text, lang); rows with a null in text or lang are left out."""
    train = train.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    idf = document_frequencies(train)
    spark = train.sparkSession
    held = spark.sparkContext.broadcast(idf)

    def centroids(rows: pd.DataFrame) -> pd.DataFrame:
        vectors = []
        for text in rows.sort_values(["doc_id", "text"])["text"]:
            if (found := ngram_counts(text)) is not None:
                vector = np.zeros(DIMS, np.float32)
                vector[found[0]] = weigh(*found, held.value)
                vectors.append(vector)
        if not vectors:
            return pd.DataFrame({"lang": [], "vector": [], "cutoff": []})
        found, cutoffs = cluster(np.stack(vectors), clusters)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "vector": [v.astype(np.float32).tobytes() for v in found], "cutoff": cutoffs})

    drawn = stage(sampled_rows(train, "lang", sample))
    rows = drawn.groupBy("lang").applyInPandas(centroids, "lang string, vector binary, cutoff double").orderBy("lang", "vector").collect()
    matrix = np.stack([np.frombuffer(r.vector, np.float32) for r in rows], 1) if rows else np.zeros((DIMS, 0), np.float32)
    return Model(idf, [r.lang for r in rows], np.ascontiguousarray(matrix), np.array([r.cutoff for r in rows]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score (cosine) and rejected to the columns of ``docs`` other than ``text``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = [f for f in docs.schema.fields if f.name not in ("text", "lang_pred", "score", "rejected")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.nearest(t.as_py()) for t in batch.column("text")]
            named = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *named], [f.name for f in rest] + ["lang_pred", "score", "rejected"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["lang_pred string, score double, rejected boolean"])
    return docs.select(*[f"`{f.name}`" for f in rest], "text").mapInArrow(run, schema)
