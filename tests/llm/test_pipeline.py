"""The pipeline: awkward rows pass every stage, and run() equals a brute-force version stage by stage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from checks.compare import compare, database
from quantloom.llm import mixing, near_dups, quality
from quantloom.llm.queries import ORACLES, PIECE_MODEL, QUERIES

SF = "/root/testdata/sf0.001"


def test_sql_agrees(spark):
    con = database(SF)
    for name, sql in ORACLES.items():
        assert compare(QUERIES[name](spark, SF).toPandas(), con.sql(sql).df()) == "", name


def test_stages_keep_columns_and_take_awkward_rows(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for _, step in corpus_pipeline.STAGES[:-1]:
            assert step(spark, docs, SF).columns == docs.columns
            step(spark, docs, SF).write.format("noop").mode("overwrite").save()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_readers_decode_few_texts_at_a_time(spark, nothing):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    for _, step in corpus_pipeline.STAGES:
        spark.conf.unset(name)
        step(spark, nothing, SF)
        assert int(spark.conf.get(name)) <= 512
    spark.conf.set(name, "900")  # a chosen value stays
    corpus_pipeline.mix_sources(spark, nothing, SF)
    assert spark.conf.get(name) == "900"
    spark.conf.unset(name)


def test_run_equals_brute_force(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, scorer = quality.fit(docs)
    rows = [r for r in docs.collect() if scorer.score(r.text) >= quality.CUT]
    last = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        last[r.text] = r
    rows = sorted(last.values(), key=lambda r: r.doc_id)
    shingler, root = near_dups.Shingler(1, 1), {r.doc_id: r.doc_id for r in rows}
    sets = [(r.doc_id, set(shingler.shingles(r.text).tolist())) for r in rows]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    rows = [r for r in rows if find(r.doc_id) == r.doc_id]
    plan = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix(spark.createDataFrame(rows, docs.schema)).collect()}  # its rows are checked by themselves
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    expected = Counter()
    for r in rows:
        taken, size = plan[r.doc_id]
        expected[r.doc_id, tuple(lib.encode(r.text))] += taken // size if size else 0
        if size and taken % size:
            pieces = __import__("re").findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", r.text)[: taken % size]
            expected[r.doc_id, tuple(lib.encode("".join(pieces)))] += 1
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +expected
