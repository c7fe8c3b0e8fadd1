"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import pandas as pd
import pytest

from checks.compare import compare, database
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"
FAST = ["candles_5m", "features_oscillators", "trading_regimes", "options_rollup", "news_exact_dedupe", "html_links", "quality_events",
        "source_reliability", "lifecycle_states", "classification_report", "stream_candles_5m", "bar_files", "html_titles", "html_candidates",
        "html_headlines", "news_valid", "news_embedding_texts", "news_enriched", "parsed_dates", "event_dead_letters", "recent_win_ratio",
        "vector_top5", "vector_top3_scaled", "candle_upsert", "risk_decisions", "risk_gate", "strategy_signals_context", "trading_anomalies",
        "backtest_drawdown", "preliminary_risk"]
NAMES = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else FAST


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()) == ""


def test_equal_sentiment_gives_equal_records(spark, tmp_path):
    """Days whose mean is -0.5, from three scores or from seven that do not add up exactly as doubles."""
    words = {-0.75: "est ment by ", -0.65: "est ment", -0.55: "est", 0.0: "no"}
    found = []
    for scores in ([-0.75, -0.75, 0.0], [-0.65, -0.55, -0.55, -0.55, -0.55, -0.65, 0.0]):
        folder = tmp_path / str(len(scores))
        folder.mkdir()
        for table in Path(SF).glob("*.parquet"):
            if table.name != "documents.parquet":
                (folder / table.name).symlink_to(table)
        docs = [(day + 2400 * i, words[x], "en", "web", len(words[x])) for i, x in enumerate(scores) for day in range(2400)]
        pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(folder / "documents.parquet")
        found.append(QUERIES["settled_performance"](spark, str(folder)).toPandas())
    assert len(found[0]) > 1000 and compare(*found) == ""
