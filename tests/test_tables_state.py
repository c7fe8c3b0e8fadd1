"""Vector cells, key table, live state, performance records, model store, links and partition upserts: against brute force."""

from __future__ import annotations

import glob
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.sql import functions as F

from quantloom.operators import training, vectors, weighting
from quantloom.operators.model_store import ModelStore
from quantloom.operators.news import insert_news_batch
from quantloom.session import only_result_stays, stage
from quantloom.sources import html, sinks
from quantloom.sources.keytable import KeyTable
from quantloom.streaming import flows


def clustered(n, dims=24, groups=12, spread=0.05, seed=4):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((groups, dims))
    return centres[draw.integers(0, groups, n)] + spread * draw.standard_normal((n, dims))


def frame_of(spark, rows):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id bigint, embedding array<double>")


def cosines(rows):
    unit = rows / np.where((norms := np.linalg.norm(rows, axis=1, keepdims=True)) > 0, norms, 1)
    return np.round(np.clip(unit @ unit.T, 0, 1), 6)


def brute_greedy(rows, threshold):
    similar, kept = cosines(rows), []
    for i in range(len(rows)):
        if not any(similar[i, j] > threshold for j in kept):
            kept.append(i)
    return kept


@pytest.fixture(scope="module")
def points():
    rows = clustered(700)
    rows[100:160] = rows[100]  # copies
    rows[300] = 0.0
    rows[301:303] *= 5.0
    return rows


def test_bounded_top_k_equals_brute_force(spark, points):
    df, similar = frame_of(spark, points), cosines(points)
    got = {}
    for r in vectors.top_k(df, df, 4, tile_rows=40).collect():
        got.setdefault(r.id, []).append((r["rank"], r.match, r.similarity))
    for i in range(len(points)):
        order = sorted(range(len(points)), key=lambda j: (-similar[i, j], j))[:4]
        assert [m for _, m, _ in sorted(got[i])] == order or [s for *_, s in sorted(got[i])] == pytest.approx([similar[i, j] for j in order], abs=2e-6)
    assert len(got) == len(points)


def test_greedy_dedupe_and_matches_equal_brute_force(spark, points):
    df, kept = frame_of(spark, points), brute_greedy(points, 0.97)
    found = stage(vectors.greedy_distinct(df, 0.97, tile_rows=40))
    assert sorted(r.id for r in found.collect()) == kept
    for r in vectors.duplicate_matches(df, found, 0.97, tile_rows=40).collect():
        best = max((cosines(points[[r.id, j]])[0, 1], -j) for j in kept if j < r.id)
        assert r.similarity == pytest.approx(best[0], abs=2e-6)
    assert vectors.greedy_distinct(df.limit(0), 0.9).count() == 0


def test_bounds_hold_and_spare_most_cells(spark):
    rows = clustered(3000, groups=30, spread=0.02)
    df = frame_of(spark, rows)
    cells = vectors.fit_cells(df, 64)
    tiled = vectors.tiles(vectors.placed(df, cells), 64)
    plan = vectors.planned_pairs(tiled, tiled, 0.9).agg(F.sum("cells").alias("all"), F.sum("met").alias("met")).first()
    assert plan.met < 0.35 * plan["all"]
    table = vectors.as_arrays(vectors.boxes(tiled))
    turned = rows / np.linalg.norm(rows, axis=1, keepdims=True) @ cells.axes
    where = cells.cell_of(turned)
    for r in tiled.limit(5).collect():
        own = np.frombuffer(r.vectors).reshape(r.n, -1)
        bound = dict(zip(table["cell"], vectors.bounds(np.array(r.low), np.array(r.high), r.rest, table)))
        for cell in np.unique(where):
            assert (own @ turned[where == cell].T).max() <= bound[cell] + 1e-9


def test_vector_stream_reads_few_cells_and_replays(spark):
    rows = clustered(900, groups=30, spread=0.02, seed=6)
    table = flows.VectorTable(spark, flows.new_folder(spark, "test-vectors"), depth=5)
    batches = [frame_of(spark, rows).where(f"id >= {a} and id < {a + 300}") for a in (0, 300, 600)]
    for number, batch in enumerate(batches):
        table.insert(batch, number, 0.97)
    once = sorted(r.id for r in table.rows().collect())
    assert once == brute_greedy(rows, 0.97)
    few = frame_of(spark, rows[:2]).selectExpr("id + 2000 as id", "embedding")
    table.insert(few, 3, 0.97)
    table.insert(batches[2], 2, 0.97)  # a replay of an earlier batch
    table.insert(few, 3, 0.97)
    assert sorted(r.id for r in table.rows().collect()) == once
    read = {r.batch_id: r for r in table.reads().collect()}
    assert read[0].cells_read == 0 and read[3].cells_read < read[3].cells_stored / 2


def article(spark, rows):
    return spark.createDataFrame(rows, "id bigint, source string, url_hash string, content_hash string")


def test_news_keys_read_only_what_they_may_hit(spark):
    root, seen = flows.new_folder(spark, "test-news"), []
    for number in range(4):
        fresh = [(number * 100 + i, "s", f"u{number}-{i}", f"t{number}-{i}") for i in range(40)]
        again = [(number * 100 + 50 + i, "s", f"u{number - 1}-{i}", f"x{number}-{i}") for i in range(3)] if number else []
        same_text = [(number * 100 + 60, "s", f"v{number}", f"t{number}-7"), (number * 100 + 61, "other", f"w{number}", f"t{number}-7"), (number * 100 + 62, "s", None, None)]
        batch = article(spark, fresh + again + same_text)
        insert_news_batch(batch, root, number)
        seen.append(batch)
    keep = sorted(r.id for r in spark.read.parquet(f"{root}/articles").collect())
    assert keep == sorted(n * 100 + i for n in range(4) for i in [*range(40), 61, 62])  # null hashes equal no other
    look = {r.batch_id: r for r in KeyTable(f"{root}/keys").lookups(spark).collect()}
    assert all(look[n].buckets_read <= 12 for n in (1, 2, 3)) and look[3].keys_read < 0.3 * 4 * 80
    for number in (2, 3, 3):  # replays, as after a crash between the two writes
        insert_news_batch(seen[number], root, number)
    assert sorted(r.id for r in spark.read.parquet(f"{root}/articles").collect()) == keep
    small = KeyTable(f"{root}/keys").compact(spark, 3, f"{root}/merged")
    asked = spark.createDataFrame([("u:u0-1",), ("u:u3-39",), ("u:none",), (None,)], "key string")
    assert sorted(r.key for r in small.seen(asked, 4).collect()) == ["u:u0-1", "u:u3-39"]


def test_live_state_is_flat_and_expires(spark):
    at, rows = datetime(2024, 1, 1), []
    for day in range(6):
        rows += [(f"c{day}-{i}", s, at + timedelta(days=day, minutes=10 * k + i), day * 100 + i * 3 + k, "bad" if s == "FAILED" else None)
                 for i in range(4) for k, s in enumerate(("CREATED", "DATA_COLLECTED", "FAILED" if i == 3 else "FINALIZED"))]
    folder = flows.new_folder(spark, "test-live")
    events = spark.createDataFrame(rows, "correlation_id string, state string, ts timestamp, seq bigint, error string")
    for day in range(6):
        events.where(f"seq div 100 = {day}").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    sessions, held = flows.live_lifecycle(stream, "6 hours")
    found = {r.correlation_id: r for r in sessions.collect()}
    assert len(found) == 24 and {r.state for k, r in found.items() if k < "c5"} == {"EXPIRED"}
    assert {found[f"c5-{i}"].state for i in range(4)} == {"FINALIZED", "FAILED"} and found["c2-3"].error == "bad" and found["c2-0"].completed == "DATA_COLLECTED|FINALIZED"
    assert max(r.state_rows for r in held.collect()) <= 8 and all(r.events == 3 for r in found.values())


def test_performance_as_of_sees_the_past_only(spark):
    draw, at = np.random.default_rng(9), datetime(2024, 1, 1)
    outcomes = [("A", str(draw.choice(["x", "y"])), str(draw.choice(["UP", "DOWN", "unknown"])), at + timedelta(hours=int(h)), float(r))
                for h, r in zip(draw.integers(0, 2000, 400), draw.normal(0, 0.1, 400))] + [("A", "x", "UP", None, 9.0), ("A", "x", "UP", at, None)]
    bars = [("A", at + timedelta(hours=int(h)), str(r)) for h, r in zip(sorted(draw.choice(2200, 60, replace=False)), draw.choice(["UP", "DOWN"], 60))] + [("B", at, "UP")]
    weights = F.create_map(F.lit("x"), F.lit(0.5), F.lit("y"), F.lit(0.3), F.lit("z"), F.lit(0.2))
    df = spark.createDataFrame(bars, "symbol string, ts timestamp, regime string").withColumn("base_weights", weights)
    got = weighting.performance_as_of(df, spark.createDataFrame(outcomes, "symbol string, strategy_name string, regime string, ts timestamp, realized double"), F.date_trunc("week", "ts"))
    found = {(r.symbol, r.ts): r.performance or {} for r in got.collect()}
    assert len(found) == len(bars)
    for symbol, ts, regime in bars:
        for name in ("x", "y", "z"):
            own = [r for s, n, g, t, r in outcomes if s == symbol and n == name and g in (regime, "unknown") and t is not None and r is not None and t <= ts]
            p = found[symbol, ts].get(name)
            assert (p is None) == (not own)
            if own:
                assert (p.sample_size, p.accuracy, p.avg_return, p.max_drawdown) == pytest.approx((len(own), np.mean([r > 0 for r in own]), np.mean(own), min(0.0, min(own))))


def test_model_store(spark):
    rows = spark.createDataFrame([(float(i), float(i > 20), "up" if i > 20 else "down") for i in range(40)], "x double, target_index double, label string")
    store, at = ModelStore(spark, flows.new_folder(spark, "test-models")), datetime(2024, 1, 1)

    def fit(accuracy):
        def train():
            stages = [VectorAssembler(inputCols=["x"], outputCol="features"), LogisticRegression(labelCol="target_index", maxIter=5),
                      IndexToString(inputCol="prediction", outputCol="predicted", labels=["down", "up"])]
            return Pipeline(stages=stages).fit(rows), "label", ["x"], {"accuracy": accuracy}
        return train

    assert store.active("m") is None and store.roll_back("m", at) is None
    with pytest.raises(ValueError):
        store.score(rows, "m")
    assert store.retrain_if_due("m", fit(0.9), at) == 1 and store.retrain_if_due("m", fit(0.9), at) is None
    assert store.retrain_if_due("m", fit(0.4), at + timedelta(days=15)) == 2  # old
    assert store.retrain_if_due("m", fit(0.8), at + timedelta(days=16)) == 3  # weak
    assert store.roll_back("m", at + timedelta(days=17)) == 2 and store.active("m")[0] == 2
    scored = store.score(rows, "m").where("prediction = label")
    assert scored.count() >= 38 and scored.first().model_version == 2


def test_boosted_labels_stop_on_validation_rows(spark):
    rows = [("A", datetime(2024, 1, 1) + timedelta(days=i), float(i % 7), "low" if i % 7 < 3 else "high") for i in range(200)] + [("A", datetime(2023, 1, 1), 1.0, None)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, x double, regime string")
    got = training.boosted_regimes(df, ["x"], "regime", rounds=3, depth=2, step=0.5).collect()
    assert len(got) == 200 and {r.prediction for r in got} == {"low", "high"}
    assert np.mean([r.prediction == r.label for r in got if r.validation]) > 0.95 and got[0].trees <= 3 and 10 < sum(r.validation for r in got) < 80


def test_links_from_the_tree(spark):
    page = """<a href="/a b">R&#233;sum&#xE9; &lt;x&gt;</a><a href='/c' title=" named  by title "><img src=x></a><a href="/d"></a><a name=x>no href</a>
      <div><a class=k href="/e?a=1&amp;b=2">one<b> two</b>three</a></div><script><a href="/no">no</a></script><!-- <a href="/no2">no</a> --><A HREF=/f>open"""
    df = spark.createDataFrame([(1, "http://h/", page), (2, None, None), (3, "http://h/", "")], "page_id long, url string, html string")
    assert [tuple(r) for r in html.page_links(df).orderBy("position").collect()] == [
        (1, "http://h/", 0, "/a b", "Résumé <x>"), (1, "http://h/", 1, "/c", "named by title"), (1, "http://h/", 3, "/e?a=1&b=2", "one two three"), (1, "http://h/", 4, "/f", "open")]


def test_partition_upserts_keep_untouched_files(spark):
    path = flows.new_folder(spark, "test-upsert")
    rows = lambda *r: spark.createDataFrame(r, "k int, v string, day string")
    sinks.upsert_partitions(rows((1, "a", "d1"), (2, "b", "d1"), (3, "c", "d2"), (3, "b", "d2")), path, ["k"], "day")
    before = set(glob.glob(f"{path}/day=d2/*.parquet"))
    for _ in range(2):  # the second is a replay
        sinks.upsert_partitions(rows((2, "new", "d1"), (4, None, "d3")), path, ["k"], "day")
    assert sorted((r.k, r.v, r.day) for r in spark.read.parquet(path).collect() if r.v) == [(1, "a", "d1"), (2, "new", "d1"), (3, "c", "d2")]
    assert set(glob.glob(f"{path}/day=d2/*.parquet")) == before and spark.read.parquet(path).count() == 4


def test_versions_are_compacted(spark):
    folder = flows.new_folder(spark, "test-compact")
    store = flows.versioned_sink(folder)
    for number in range(4):
        store(spark.createDataFrame([(k, number) for k in range(number + 2)], "k int, v int"), number)
    want = {r.k: r.v for r in flows.read_versions(spark, folder, ["k"]).collect()}
    sinks.compact_versions(spark, folder, ["k"], 2)
    assert {r.k: r.v for r in flows.read_versions(spark, folder, ["k"]).collect()} == want
    assert len(glob.glob(f"{folder}/data/batch=*")) == 2


def test_tables_of_a_block_are_deleted(spark):
    with only_result_stays(spark) as kept:
        inner, result = stage(spark.range(3)), stage(spark.range(5))
        kept.append(result)
    assert result.count() == 5 and not glob.glob(inner._quantloom_path)
