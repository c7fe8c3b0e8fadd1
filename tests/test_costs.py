"""Work that grows with the rows is done once: parsing, shuffles of whole rows, copies of texts."""

from pyspark.sql import functions as F

from quantloom.functions import text
from quantloom.operators import news, options_chain, quality

c = F.col


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_event_payload_fields_are_read_once(spark):
    rows = [("market.ohlcv.raw", '{"open": 5, "high": 4, "low": 3, "close": 4, "volume": 1}'), ("market.options.raw", '{"pcr": -1, "iv": 2}'),
            ("news.raw", '{"title": " "}'), ("news.raw", '{"title": "a", "source_reliability_score": 0.1}'), ("system.health", "no json")]
    events = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, event_type string, payload string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    checked = quality.check_events(events, F.lit("2024-01-02").cast("timestamp"))
    assert checked.columns == [*events.columns, "issues", "quality_status", "source_reliability_score"]
    assert [r.quality_status for r in checked.orderBy("seq").collect()] == ["FAIL", "FAIL", "FAIL", "WARN", "PASS"]
    assert optimized(checked).count("get_json_object(") <= 11  # ten fields, the title's in a condition as well


def test_clamp_walk_joins_events_with_no_second_copy(spark):
    events = spark.range(40).select(F.lit("a").alias("source"), c("id").alias("seq"), (c("id") % 3 == 0).alias("passed"), c("id").alias("pos"))
    walked = quality.clamp_walk(events)
    score, wanted = quality.START_SCORE, []
    for i in range(40):
        before, score = score, min(max(score + (quality.PASS_STEP if i % 3 == 0 else quality.FAIL_STEP), 0.0), 1.0)
        wanted.append((i, before, score))
    assert [(r.seq, r.score_before, r.score_after) for r in walked.orderBy("seq").collect()] == wanted
    assert optimized(walked).count("Join Inner") == 1


def test_option_payloads_are_parsed_once(spark):
    payloads = spark.createDataFrame([
        ("A", '{"records": {"data": [{"strikePrice": 1, "CE": {"openInterest": 2}}, null], "underlyingValue": 3}}'),
        ("B", '{"records": {"data": [], "underlyingValue": 3}}'), ("C", None), ("D", "no json")], "symbol string, payload string")
    rows = options_chain.parse_chain(payloads)
    assert sorted((r.symbol, r.underlying_value, r.strike or 0.0, r.call_oi) for r in rows.collect() if r.strike) == [("A", 3.0, 1.0, 2.0)]
    assert rows.where("symbol = 'A'").count() == 2 and rows.where("symbol <> 'A'").count() == 0
    assert optimized(rows).count("from_json(") == 1


def test_letters_are_replaced_without_a_map_per_character(spark):
    df = spark.createDataFrame([("A\u00a0 b\u00a0\u00a0\u00a0c  ſtraße Οδος ς",)], "t string")
    done = df.select(text.clean_text(c("t")).alias("clean"), text.normalize_text(c("t")).alias("norm"))
    assert done.first() == ("A b c ſtraße Οδος ς", "a b c strasse οδοσ σ")
    assert "translate(" not in optimized(done.where("clean <> norm"))


def test_news_batches_stage_no_texts(spark, tmp_path, monkeypatch):
    staged = []
    keep = news.stage
    monkeypatch.setattr(news, "stage", lambda df, *a: staged.append(df.columns) or keep(df, *a))
    rows = [(1, "s", "u1", "c1", "text one"), (2, "s", "u1", "c2", "text two"), (3, "s", "u3", None, "text three")]
    kinds = "id long, source string, url_hash string, content_hash string, content string"
    news.insert_news_batch(spark.createDataFrame(rows, kinds), str(tmp_path), 0)
    news.insert_news_batch(spark.createDataFrame([(4, "s", "u3", "c4", "text four"), (5, "s", "u5", "c5", "text five")], kinds), str(tmp_path), 1)
    assert staged and not any("content" in columns for columns in staged)
    found = spark.read.parquet(f"{tmp_path}/articles")
    assert sorted((r.id, r.content) for r in found.collect()) == [(1, "text one"), (3, "text three"), (5, "text five")]
