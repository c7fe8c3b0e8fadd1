"""What shows on larger tables only: cut texts, memory of the driver, work per row."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd

from checks.compare import compare
from checks.oracles import ORACLES
from checks.queries import QUERIES
from quantloom.operators import vectors
from quantloom.streaming import flows


def test_titles_with_a_cut_reference_match_sql(spark, tmp_path):
    rows = [(1, "u", "<h1>a &amp;&amp;&amp</h1>"), (2, "u", "<h1>b&amp;amp; <b>&quot</b>c&lt;i&gt;</h1>"), (3, "u", "<h1>&copy 2020 &middot; d &am</h1>"), (4, "u", "<h1> </h1>")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = QUERIES["html_titles"](spark, str(tmp_path)).toPandas()
    assert dict(zip(got.page_id, got.title)) == {1: "a &&&", 2: 'b&amp; " c<i>', 3: "© 2020 · d &am", 4: None}
    assert compare(got, con.sql(ORACLES["html_titles"]).df()) == ""


def test_cells_are_packed_into_few_blocks():
    found = pd.DataFrame({"cell": range(20), "n": [10] * 10 + [95] + [10] * 9})
    blocks = vectors.Blocks.pack(found, 30)
    assert blocks.blocks == 11 and blocks.count[10] == 4  # 4 of three cells or less, 4 of the large one, 3 after it
    rows = {}
    for cell, n in zip(found.cell, found.n):
        if blocks.count[cell] == 1:
            rows[blocks.start[cell]] = rows.get(blocks.start[cell], 0) + n
    assert max(rows.values()) <= 30 and len(set(rows) & set(range(blocks.start[10], blocks.start[10] + 4))) == 0


def test_best_of_pieces_equals_brute_force_with_ties():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(900, 24))
    rows[200:500] = rows[200]  # copies, so that ids decide
    rows[7] = 0.0
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
    ids, similar = rng.permutation(900), np.round(np.clip(rows @ rows.T, 0.0, 1.0), 6)
    pieces = [(ids[a : a + 100], rows[a : a + 100], rows[a : a + 100].astype(np.float32)) for a in range(0, 900, 100)]
    for earlier in (False, True):
        got = pd.DataFrame(dict(zip(("id", "match", "score"), vectors._best(4, earlier)(ids, rows, pieces)))).groupby("id").match.apply(list).to_dict()
        for i, own in enumerate(ids):
            want = sorted((-similar[i, j], ids[j]) for j in range(900) if not earlier or ids[j] < own)[:4]
            assert got.get(own, []) == [m for _, m in want]


def test_greedy_rule_settles_over_links_and_cut_lists(spark, monkeypatch):
    """One meeting of vectors settles a chain of conflicts; cut lists lead to further ones and the same rows."""
    angles = np.concatenate([np.arange(0, 3.0, 0.05), np.full(40, 1.0) + np.arange(40) * 1e-3, np.arange(0, 3.0, 0.03)])
    rows = np.stack([np.cos(angles), np.sin(angles)], 1)
    similar, kept = np.round(np.clip(rows @ rows.T, 0.0, 1.0), 6), []
    for i in range(len(rows)):
        if not any(similar[i, j] > 0.99 for j in kept):
            kept.append(i)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id bigint, embedding array<double>")
    calls, meet = [], vectors.meet
    monkeypatch.setattr(vectors, "meet", lambda *a, **b: calls.append(1) or meet(*a, **b))
    assert sorted(r.id for r in vectors.greedy_distinct(df, 0.99, tile_rows=30).collect()) == kept
    assert len(calls) == 1
    monkeypatch.setattr(vectors, "LINKS", 1)
    assert sorted(r.id for r in vectors.greedy_distinct(df, 0.99, tile_rows=30).collect()) == kept
    assert len(calls) > 2


def test_live_lifecycle_takes_events_past_their_time(spark):
    """An event that is on time for its batch, but whose timer would lie before the watermark, expires at once."""
    at, folder = datetime(2024, 1, 1), flows.new_folder(spark, "test-old-events")
    for i, (key, day) in enumerate((("a", 0), ("b", 10), ("c", 1))):
        rows = [(key, "CREATED", at + timedelta(days=day), i, None)]
        spark.createDataFrame(rows, "correlation_id string, state string, ts timestamp, seq bigint, error string").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("correlation_id string, state string, ts timestamp, seq bigint, error string").option("maxFilesPerTrigger", 1).parquet(folder)
    sessions, _ = flows.live_lifecycle(stream, "6 hours")
    assert {r.correlation_id: r.state for r in sessions.collect()} == {"a": "EXPIRED", "b": "CREATED", "c": "EXPIRED"}
