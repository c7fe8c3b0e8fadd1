from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import sentiment, text
from quantloom.operators import candles, memory, news, options_chain, quality, vectors
from quantloom.operators.blocks import index_rows
from quantloom.sources import bars as bar_source
from quantloom.sources import events as event_source
from quantloom.sources import html, sinks
from quantloom.streaming import flows

c = F.col


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_candles(spark):
    day = datetime(2026, 1, 1)
    at = lambda h, m, s: day + timedelta(hours=h, minutes=m, seconds=s)
    ticks = spark.createDataFrame(
        [("infy", at(9, 15, 10), 1500.0, 100.0, 1), ("INFY", at(9, 15, 40), 1505.0, 180.0, 2), ("INFY", at(9, 16, 5), 1498.0, 220.0, 3),
         ("BAD", at(9, 15, 0), 0.0, 1.0, 4), ("LATE", at(9, 15, 50), 1510.0, None, 5), ("LATE", at(9, 15, 5), 1500.0, 0.0, 6)],
        "symbol string, ts timestamp, price double, volume double, seq bigint")
    one_minute = {(r.symbol, r.ts): r for r in candles.candles(ticks, "1m").collect()}
    first = one_minute["INFY", at(9, 15, 0)]
    assert (first.open, first.high, first.low, first.close, first.volume) == (1500, 1505, 1500, 1505, 180)
    late = one_minute["LATE", at(9, 15, 0)]
    assert (late.high, late.low, late.close, late.volume) == (1510, 1500, 1500, 0) and len(one_minute) == 3
    five = candles.roll_up(candles.candles(ticks, "1m"), "5m").where("symbol = 'INFY'").first()
    assert (five.high, five.low, five.close, five.volume) == (1505, 1498, 1498, 220)


def test_text(spark):
    url = "HTTPS://WWW.Example.com/news/business/markets/story/?utm_source=x&id=1#section"
    assert one(spark, text.normalize_url(F.lit(url))) == "https://www.example.com/news/business/markets/story"
    assert one(spark, text.normalize_text(F.lit(" Infosys  cuts\n\n FY Guidance "))) == "infosys cuts fy guidance"
    assert one(spark, text.clean_text(F.lit(" a  b \n\n\n\n c "))) == "a b\n\n c".replace("\n c", "\nc")
    base = F.lit("https://a.com/x/y.html?q=1")
    for href, want in (("/n/1/", "https://a.com/n/1"), ("z.html", "https://a.com/x/z.html"), ("../w", "https://a.com/w"),
                       ("//b.com/q", "https://b.com/q"), ("http://c.com", "http://c.com/"), ("?p=2", "https://a.com/x/y.html")):
        assert one(spark, text.absolutize_url(base, F.lit(href))) == want
    for raw in ("2026-01-02T03:04:05Z", "2026-01-02T03:04:05+00:00", "2026-01-02 03:04:05", "Fri, 02 Jan 2026 03:04:05 GMT",
                "Fri, 02 Jan 2026 08:34:05 +0530"):
        assert one(spark, text.parse_datetime(F.lit(raw))) == datetime(2026, 1, 2, 3, 4, 5), raw
    assert one(spark, text.parse_datetime(F.lit("soon"))) is None


def test_sentiment(spark):
    got = one(spark, sentiment.lexical_sentiment(F.lit("Infosys raises guidance after strong revenue growth and resilient deal wins")))
    assert got.sentiment == "bullish" and got.confidence == pytest.approx(0.75)
    assert one(spark, sentiment.event_type(F.lit("Board approves Dividend"))) == "corporate_action"
    tie = one(spark, sentiment.calibrate(F.create_map(F.lit("positive"), F.lit(0.4), F.lit("negative"), F.lit(0.4), F.lit("neutral"), F.lit(0.2))))
    assert tie.sentiment == "bullish" and tie.score == 0


def greedy_news(rows):
    urls, texts, kept = set(), set(), []
    for i, u, s, h in sorted(rows):
        if u in urls or (s, h) in texts:
            continue
        urls.add(u), texts.add((s, h)), kept.append(i)
    return kept


def test_exact_dedupe_is_greedy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"u{rng.integers(60)}", f"s{rng.integers(3)}", f"h{rng.integers(40)}") for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, url_hash string, source string, content_hash string")
    assert sorted(r.id for r in news.first_seen(df).collect()) == greedy_news(rows)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    x = np.vstack([base, base[:15] + rng.normal(scale=0.05, size=(15, 8)), base[:5]])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, embedding array<double>")
    sims = np.round(np.clip(x @ x.T, 0, 1), 6)
    kept = []
    for i in range(len(x)):
        if not any(sims[i, j] > 0.92 for j in kept):
            kept.append(i)
    got = vectors.greedy_distinct(df, 0.92, tile_rows=16)
    assert sorted(r.id for r in got.collect()) == kept
    top = vectors.top_k(df, df, 3, tile_rows=16).where("id = 7").orderBy("rank").collect()
    np.testing.assert_allclose([r.similarity for r in top], np.sort(sims[7])[::-1][:3])


def test_options(spark):
    payload = ('{"records": {"data": [{"strikePrice": 100, "CE": {"openInterest": 10, "impliedVolatility": 20}, "PE": {"openInterest": 5}},'
               '{"strikePrice": 110, "CE": {"openInterest": 10, "impliedVolatility": 0}}], "underlyingValue": 105}}')
    rows = options_chain.parse_chain(spark.createDataFrame([("nifty", datetime(2026, 1, 1), payload)], "symbol string, ts timestamp, payload string"))
    a, b = options_chain.summarize_chain(rows).first(), options_chain.summarize_chain(rows, skip_zero=True).first()
    assert (a.symbol, a.pcr, a.iv, a.max_pain) == ("NIFTY", 0.25, 10.0, 110.0) and b.iv == 20.0


def test_events(spark):
    good = '{"event_id":"1","event_type":"market.ohlcv.raw","source":"x","timestamp":"2026-01-01T00:00:00Z","correlation_id":"c","payload":{"open":10,"high":9,"low":8,"close":10}}'
    raw = spark.createDataFrame([(good,), ('{"event_type":"a","source":"x","payload":{},"extra":1}',), ("nonsense",)], "value string")
    parsed = {r.value: r for r in event_source.parse_envelopes(raw).collect()}
    assert parsed[good].error is None and "extra" in [r.error for r in parsed.values() if r.error and "unknown" in r.error][0]
    checked = quality.check_events(event_source.parse_envelopes(raw.where(c("value") == good)).drop("value", "error"), F.lit("2026-02-01").cast("timestamp"))
    row = checked.first()
    assert row.quality_status == "FAIL" and row.correlation_id == "c"
    dead = event_source.dead_letters(checked, c("event_type"), F.array_join("issues", "; "), F.lit(True)).first()
    assert dead.correlation_id == "c" and dead.event_type == "system.dead_letter"


def test_clamp_walk_over_many_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{i % 2}", i, bool(rng.random() < 0.75)) for i in range(600)]
    df = spark.createDataFrame(rows, "source string, seq bigint, passed boolean")
    got = quality.clamp_walk(index_rows(df, ["source"], ["seq"], F.floor(c("seq") / 50)), block_rows=8).orderBy("seq").collect()
    score = {"s0": 0.85, "s1": 0.85}
    for r, (source, _, passed) in zip(got, rows):
        assert r.score_before == pytest.approx(score[source])
        score[source] = min(1, score[source] + 0.02) if passed else max(0, score[source] - 0.08)
        assert r.score_after == pytest.approx(score[source])


def test_bar_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Open,High,Low,Close,Volume\n2026-01-01,1,3,0.5,2,\n")
    row = bar_source.read_csv(spark, str(tmp_path), "abc").first()
    assert (row.symbol, row.ts, row.open, row.volume, row.source) == ("ABC", datetime(2026, 1, 1), 1.0, 0.0, "kaggle_ohlcv")
    (tmp_path / "c.csv").write_text("close,date,open,low,high\n5,2026-01-02,4,3,10\n")
    both = bar_source.read_csv(spark, str(tmp_path / "*.csv"), "abc").orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close) for r in both] == [(1.0, 3.0, 0.5, 2.0), (4.0, 10.0, 3.0, 5.0)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "p.csv").write_text('sentence,label\n"Good, really",positive\nBad,-1\nMeh,other\n')
    labels = [r.sentiment for r in bar_source.read_labelled_sentences(spark, str(tmp_path / "b")).collect()]
    assert labels == ["bullish", "bearish", "neutral"]


def test_html(spark):
    page = ('<html><head><meta property="og:title" content="Shares &amp; bonds"><meta name="author" content="A B"></head><body>'
            '<script>var x="<a href=/no>no</a>"</script><a href="/news/a-long-story.html"><b>Shares rise</b> on strong results</a>'
            '<article><nav>menu</nav><p>' + "Word " * 20 + '</p><p>End.</p></article></body></html>')
    pages = spark.createDataFrame([(1, "https://a.com/list", page)], "page_id bigint, url string, html string")
    link = html.page_links(pages).collect()
    assert len(link) == 1 and link[0].title == "Shares rise on strong results"
    assert html.article_candidates(pages).first().url == "https://a.com/news/a-long-story.html"
    article = html.extract_articles(pages).first()
    assert article.title == "Shares & bonds" and article.author == "A B" and article.content.endswith("\n\nEnd.") and "menu" not in article.content


def test_nested_and_entity_html(spark):
    nested = '<div class="big content"><div>x</div><p>It&#8217;s ' + "word " * 20 + "<b>bold</b> end<p>Second &mdash; one.<aside><p>ad</p></aside></div><p>after</p>"
    pages = spark.createDataFrame([(1, "u", nested), (2, "u", None), (3, "u", "<h1>A &amp; B</h1><p class='author'>C</p><script>var a='</p>'</script>")], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in html.extract_articles(pages).collect()}
    assert got[1].content.startswith("It’s word") and got[1].content.endswith("bold end\n\nSecond — one.")
    assert got[2].title is None and got[2].language == "en" and (got[3].title, got[3].author, got[3].content) == ("A & B", "C", None)


def test_sinks_and_store(spark, tmp_path):
    df = spark.createDataFrame([("A", datetime(2026, 1, 1), 1.0), ("B", datetime(2026, 1, 2), 2.0)], "symbol string, ts timestamp, v double")
    path = sinks.append_snapshot(df, str(tmp_path), "regimes")
    sinks.append_snapshot(df, str(tmp_path), "regimes")
    assert spark.read.parquet(path).where("day = date'2026-01-02'").count() == 2
    merged = sinks.upsert(df, df.where("symbol = 'A'").withColumn("v", F.lit(9.0)), ["symbol"])
    assert {r.symbol: r.v for r in merged.collect()} == {"A": 9.0, "B": 2.0}


def test_insert_news_reports_duplicates(spark, tmp_path):
    schema = "id bigint, url_hash string, source string, content_hash string"
    table = str(tmp_path / "news")
    first = news.insert_news(spark.createDataFrame([(1, "u1", "s", "h1"), (2, "u1", "s", "h2")], schema), table)
    assert {r.id: r.inserted for r in first.collect()} == {1: True, 2: False}
    second = {r.id: r for r in news.insert_news(spark.createDataFrame([(3, "u3", "s", "h1"), (4, "u4", "s", "h4")], schema), table).collect()}
    assert second[3].duplicate_reason == "content_hash" and second[4].inserted and spark.read.parquet(table).count() == 2


def test_expiring_lifecycle(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    schema = "correlation_id string, state string, ts timestamp, seq bigint"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, rows in enumerate([[("a", "CREATED", t0, 1), ("a", "DATA_COLLECTED", t0, 2)], [("b", "CREATED", t0 + timedelta(days=5), 3)],
                              [("c", "CREATED", t0 + timedelta(days=6), 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    flows.run_once(flows.expiring_lifecycle(stream), flows.versioned_sink(out), out, "update")
    states = spark.read.parquet(f"{out}/data").where("correlation_id = 'a'").orderBy("batch_id").collect()
    assert states[0].completed == "DATA_COLLECTED" and states[-1].state == "EXPIRED"


def test_retrain_and_versions(spark):
    now = datetime(2026, 2, 1)
    rows = [("m", "v1", now - timedelta(days=30), 0.6, None), ("m", "v2", now - timedelta(days=1), 0.4, now), ("m", "v3", now, 0.7, None)]
    df = spark.createDataFrame(rows, "model_name string, model_version string, created_at timestamp, accuracy double, activated_at timestamp")
    due = {r.model_version: r.due for r in df.select("model_version", memory.should_retrain(df, F.lit(now)).alias("due")).collect()}
    assert due == {"v1": True, "v2": True, "v3": False}
    assert memory.active_models(df).first().active == "v2" and memory.rollback_target(df).first().previous == "v2"
