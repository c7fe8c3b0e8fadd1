"""SentencePiece coding, language, quality and toxicity: against the public library, brute force and held-out labels."""

from __future__ import annotations

import itertools
import sys

import numpy as np
import pytest

from quantloom.llm import language, pieces, quality, toxicity
from quantloom.llm.queries import PIECE_MODEL, QUERIES

SF = "/root/testdata/sf0.01"


def test_ids_equal_the_public_library(spark, awkward, nothing):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    vocabulary = pieces.Vocabulary.load(PIECE_MODEL)
    extra = ["  a  b ", "\n\n x\ty", "aaaaaaaaaaaaaaaa", "x" * 5000, "<s>[INST]▁ é́", "def f(x):\n    return x"]
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame([(i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    coded = pieces.encode(docs, vocabulary, round_trip=True)
    for r in coded.collect():
        assert r.ids == lib.encode(r.text or "") and r.n_tokens == len(r.ids) and r.round_trip
    for r in pieces.decode(coded.withColumnRenamed("text", "old"), vocabulary).collect():
        assert r.text == (r.old or "").replace("▁", " ")
    assert pieces.encode(nothing, vocabulary).count() == 0
    assert pieces.encode(awkward, vocabulary).columns == [*[n for n in awkward.columns if n != "ids"], "ids", "n_tokens"]


def test_unigram_viterbi_finds_the_best_score():
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -2.2, "▁a": -3.1, "bab": -4.0, "aba": -3.9}
    encoder = pieces.Encoder(pieces.Vocabulary(list(scores), list(scores.values()), unigram=True))
    for n in range(1, 7):
        for letters in itertools.product("ab", repeat=n):
            word = "▁" + "".join(letters)

            def best(rest):
                return 0.0 if not rest else max(scores[rest[:k]] + best(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in scores)

            (_, ids), = encoder.split([word])
            assert "".join(encoder.vocabulary.pieces[i] for i in ids) == word
            assert sum(encoder.vocabulary.scores[i] for i in ids) == pytest.approx(best(word))


def test_a_full_cache_changes_nothing(monkeypatch):
    vocabulary = pieces.Vocabulary.load(PIECE_MODEL)
    texts = [f"word{i} again and again {i * 7919}" for i in range(300)]
    whole, ends = pieces.Encoder(vocabulary).encode(texts)
    monkeypatch.setattr(pieces, "CACHED_WORDS", 10)
    monkeypatch.setattr(pieces, "CACHED_PAIRS", 10)
    small = pieces.Encoder(vocabulary)
    assert np.concatenate([small.encode([t])[0] for t in texts]).tolist() == whole.tolist() and len(ends) == 301


def test_a_worker_remembers_little():
    encoder = pieces.Encoder(pieces.Vocabulary.load(PIECE_MODEL))
    for a in range(0, 450_000, 50_000):  # distinct words, as many as a slice of texts may bring
        encoder.encode([" ".join(f"w{i:x}" for i in range(a, a + 50_000))])
    held = sum(sys.getsizeof(cache) + sum(sys.getsizeof(w) + sys.getsizeof(i) for w, i in cache.items()) for cache in (encoder.known, encoder.older))
    assert held < 60e6


def test_language_on_held_out_rows(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op7_language_id"](spark, SF).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_rows(awkward, nothing):
    model = language.fit(awkward)
    got = language.predict(awkward, model)
    rows = {r.text: r for r in got.join(awkward.select("doc_id", "text"), "doc_id").collect()}
    assert rows[""].lang_pred == rows["12 34 , ."].lang_pred == "und" and rows["12 34 , ."].score == 0
    assert rows["日本語 テキスト 😀"].lang_pred == "ja"
    assert got.count() == awkward.count() and language.predict(nothing, model).count() == 0
    assert {r.lang_pred for r in language.predict(awkward, language.fit(nothing)).collect()} == {"und"}


def test_long_texts_count_like_short_ones(monkeypatch):
    text = "".join(chr(97 + i * 7 % 26) if i % 6 else " " for i in range(5000))
    dims, counts = language.ngram_counts(text)
    monkeypatch.setattr(language, "CHUNK", 64)
    dims2, counts2 = language.ngram_counts(text)
    assert dims.tolist() == dims2.tolist() and counts.tolist() == counts2.tolist()


def test_quality_agrees_with_labels_it_never_saw(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r.kept for r in QUERIES["op9_quality"](spark, SF).collect()}
    assert np.mean([got[i] == bool(q) for i, q in truth.items()]) > 0.97
    assert np.mean([got[i] for i, q in truth.items() if q]) > 0.99


def test_quality_of_awkward_rows(awkward, nothing):
    left = quality.keep_good(awkward)
    assert left.columns == awkward.columns
    kept = {r.doc_id for r in left.collect()}
    assert not {100, 101, 102} & kept and set(range(130, 144)) <= kept
    assert quality.keep_good(nothing).count() == 0


def test_em_finds_the_good_labellers():
    draw = np.random.default_rng(1)
    good = draw.random(4000) < 0.8
    votes = np.stack([np.where(draw.random(4000) < (0.97 if i < 4 else 0.7), good, ~good) for i in range(len(quality.LABELLERS))], 1)
    patterns = (votes * 3 ** np.arange(votes.shape[1])).sum(1)
    numbers, counts = np.unique(patterns, return_counts=True)
    model = quality.expectation_maximisation(numbers, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.03 and model.table[0, 0, 0] > 0.9 > 0.8 > model.table[0, 6, 0]
    assert ((model.posterior(patterns) > 0.5) == good).mean() > 0.98


def random_index(n=500, terms=60):
    draw = np.random.default_rng(2)
    vectors = []
    for _ in range(n):
        t = np.sort(draw.choice(terms, draw.integers(1, 8), replace=False))
        w = draw.integers(1, 4, len(t)).astype(float)
        vectors.append((t, w / np.sqrt(w @ w)))
    return vectors, toxicity.BlockMaxIndex(np.arange(n) * 3, vectors, terms), terms


def test_block_max_search_equals_a_full_scan():
    vectors, index, terms = random_index()
    dense = np.zeros((len(vectors), terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for t, w in vectors[:80]:
        query = np.zeros(terms)
        query[t] = w
        full = sorted((-round(float(s), 12), i * 3) for i, s in enumerate(dense @ query) if s > 1e-12)[:15]
        got = [(-s, int(index.ids[p])) for s, p in index.nearest(t, w, 15)]
        assert [g[0] for g in got] == pytest.approx([f[0] for f in full]) and sorted(i for _, i in got[:10]) == sorted(i for _, i in full[:10]) or len(full) < 10


def test_many_blocks_are_scored_like_a_full_scan(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    vectors, index, terms = random_index()
    dense = np.zeros((len(vectors), terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for at, i in enumerate(index.order[:80]):
        scores = (dense @ dense[i]).round(12)
        full = sorted((-s, j * 3) for j, s in enumerate(scores) if s > 0 and j != i)[:15]
        got = index.nearest(*vectors[i], 15, without=at)
        assert [g[0] for g in got] == pytest.approx([-s for s, _ in full]) and len(got) == len(full)


def test_common_words_are_not_read_as_postings(monkeypatch):
    monkeypatch.setattr(toxicity, "COMMON", 40, raising=False)
    draw, vectors = np.random.default_rng(5), []
    for i in range(600):  # every example has 40 common terms and 3 of 3,000 others; every third is a copy of the one before
        t = np.concatenate([np.arange(40), np.sort(draw.choice(np.arange(40, 3040), 3, replace=False))])
        w = draw.random(43)
        vectors.append(vectors[-1] if i % 3 == 2 else (t, w / np.sqrt(w @ w)))
    index, read = toxicity.BlockMaxIndex(np.arange(600)[::-1] * 2, vectors, 3040), []
    spans = index.spans
    monkeypatch.setattr(index, "spans", lambda first, size: (read.append(int(size.sum())), spans(first, size))[1])
    got = [index.nearest(*v, 15) for v in vectors[:100]]
    assert sum(read) / 100 < 20  # 600 postings for each of 40 words before
    dense = np.zeros((600, 3040))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for (t, w), near in zip(vectors[:100], got):
        cosines = (dense[:, t] * w).sum(1).round(12)  # equal rows have equal sums
        full = sorted((-float(s), int(2 * (599 - i))) for i, s in enumerate(cosines) if s > 0)[:15]
        assert [int(index.ids[p]) for _, p in near] == [i for _, i in full] and [s for s, _ in near] == pytest.approx([-s for s, _ in full])
    assert index.nearest_of_each(vectors[:100], 15) == got and index.nearest_of_each([], 15) == []
    none = np.zeros(0, np.int64), np.zeros(0)
    assert index.nearest_of_each([none, vectors[0]], 15) == [[], got[0]] and toxicity.BlockMaxIndex(np.zeros(0, np.int64), [], 3040).nearest(*vectors[0], 15) == []


def test_words_three_times_as_frequent_in_toxic_rows_count(spark):
    # labels don't follow ids: equal texts are equally near, and ties go to small ids
    rows = [(i, int(i % 4 == 0), ("grim " if i // 4 % 10 < (6 if i % 4 == 0 else 2) else "mild ") + f"w{i % 7}") for i in range(800)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows] + [(900, "a grim text"), (901, "another text")], "doc_id long, text string")
    labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, toxic int")
    weight = toxicity.told_apart(toxicity.example_terms(docs, toxicity.labelled_sample(labels, 1000)))
    number = {w: int(toxicity.Terms().of(w)[0][0]) for w in ("grim", "mild", "another")}
    assert weight[number["grim"]] > 0.4 and weight[number["mild"]] > 0.4 and weight[number["another"]] == toxicity.FLOOR
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect() if r.doc_id >= 900}
    assert got[900].evidence and not got[901].evidence and got[900].score > got[901].score


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op3_toxicity"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(truth[r.doc_id], r.score, r.predicted) for r in got if r.held_out and r.doc_id in truth]
    pos, neg = [s for t, s, _ in held if t], [s for t, s, _ in held if not t]
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.93
    assert np.mean([p == 0 for t, _, p in held if not t]) > 0.97 and all(p == (s >= 0.5) for _, s, p in held)
    assert np.mean([bool(r.evidence) for r in got]) > 0.99  # every text that shares a word with an example has neighbours


def test_toxicity_equals_a_full_scan_of_the_examples(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    sample = toxicity.labelled_sample(labels, 500)
    model, of = toxicity.fit(docs, sample), toxicity.Terms().of
    rows = toxicity.example_terms(docs, sample)
    dense = {r.doc_id: dict(zip(r.terms, toxicity.unit(np.array(r.terms), np.array(r.counts), model.idf))) for r in rows if r.terms}
    for r in docs.where("doc_id % 7 = 0").collect():
        terms, counts = of(r.text)
        got = model.index.nearest(terms, model.vector(terms, counts), 15) if len(terms) else []
        own = dict(zip(terms.tolist(), model.vector(terms, counts))) if len(terms) else {}
        full = sorted(-sum(w * own[t] for t, w in v.items() if t in own) for v in dense.values())[:15]
        assert [s for s, _ in got] == pytest.approx([-s for s in full if s < -1e-12], abs=1e-9)


def test_a_hot_id_in_the_sample_is_one_example(spark):
    docs = spark.createDataFrame([(1, f"vile text {i}") for i in range(5000)] + [(i, f"plain words {i}") for i in range(2, 200)] + [(None, "vile none")] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 50 + [(i, int(i % 9 == 0)) for i in range(2, 200)] + [(None, 1)], "doc_id long, toxic int")
    assert len(toxicity.example_terms(docs, toxicity.labelled_sample(labels, 500))) == 199
    assert toxicity.classify(docs, labels).count() == docs.count()


def test_toxicity_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    docs = awkward.where("doc_id < 60").selectExpr("doc_id", "if(doc_id % 2 = 1, concat(text, ' vile rotten'), text) AS text", "score")
    got = {r.doc_id: r for r in toxicity.classify(docs.unionByName(awkward.where("doc_id >= 100 or doc_id is null").select("doc_id", "text", "score")), labels).collect()}
    assert got[11].predicted == 1 and got[12].predicted == 0 and got[100].score == got[101].score and got[11].evidence[0].toxic == 1
    assert toxicity.classify(nothing, labels).count() == 0
    assert {r.score for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.0}
