"""News: normalised articles, sentiment roll-ups, look-ups and exact dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import text as tx
from quantloom.functions.safe import clip, div, zero
from quantloom.functions.sentiment import default_score, score_label, signed_score
from quantloom.session import read_if_there, stage, unstage
from quantloom.sources.keytable import KeyTable

c = F.col


def normalize_articles(raw: DataFrame) -> DataFrame:
    """Clean texts and the three hashes. Extra columns pass through."""
    known = ("title", "summary", "content", "author", "url", "tags", "language")
    rest = [n for n in raw.columns if n not in known]
    cleaned = raw.select(
        *rest,
        F.coalesce(tx.clean_text(c("title")), F.lit("")).alias("title"),
        tx.clean_text(c("summary")).alias("summary"), tx.clean_text(c("content")).alias("content"),
        tx.clean_text(c("author")).alias("author"), tx.normalize_url(c("url")).alias("url"),
        tx.distinct_tags(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"),
        tx.language_tag(c("source"), c("language")).alias("language"))
    basis = F.coalesce("content", "summary", "title")
    return cleaned.withColumns({
        "url_hash": tx.sha(c("url")), "content_hash": tx.hash_content(basis),
        "semantic_hash": tx.semantic_hash(c("title"), c("summary"), c("content")),
    })


def valid_articles(articles: DataFrame) -> DataFrame:
    return articles.where((F.length("title") >= 8) & (F.coalesce("url", F.lit("")) != ""))


def first_seen(articles: DataFrame, id_col: str = "id") -> DataFrame:
    """Articles kept by the greedy rule in id order: drop on a url seen before, then on a
    (source, content) seen before; dropped articles block nobody.

    Each round keeps every open article that is the first open one of both its groups,
    then drops the others of those groups, until none is open (the smallest id always
    settles, so rounds end). Group minima combine map-side and are written out, so that
    each join meets two plain scans and AQE can split a hot group. The open set is
    written out every round too, which cuts lineage.
    """
    columns = [id_col, "url_hash", "source", "content_hash"]
    own = F.concat(F.lit("id:"), c(id_col).cast("string"))  # a null hash equals no other
    keyed = articles.select(id_col, F.coalesce("url_hash", own).alias("url_hash"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("content_hash", own).alias("content_hash"))
    open_rows, kept = stage(keyed), []
    while True:
        by_url = stage(open_rows.groupBy("url_hash").agg(F.min(id_col).alias("_u")))
        by_text = stage(open_rows.groupBy("source", "content_hash").agg(F.min(id_col).alias("_t")))
        marked = open_rows.join(by_url, "url_hash").join(by_text, ["source", "content_hash"])
        winners = stage(
            marked.where((c(id_col) == c("_u")) & (c(id_col) == c("_t"))).select(*columns))
        kept.append(winners)
        rest = stage(
            open_rows.join(winners.select("url_hash"), "url_hash", "left_anti")
            .join(winners.select("source", "content_hash"), ["source", "content_hash"], "left_anti")
            .select(*columns))
        unstage(open_rows, by_url, by_text)
        open_rows = rest
        if open_rows.isEmpty():
            break
    result = kept[0]
    for more in kept[1:]:
        result = result.unionByName(more)
    return articles.join(result.select(id_col), id_col, "left_semi")


def new_articles(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """``batch`` with ``duplicate_reason`` against the stored table (NULL = new)."""
    urls = stored.select("url_hash").distinct().withColumn("_u", F.lit(True))
    texts = stored.select("source", "content_hash").distinct().withColumn("_t", F.lit(True))
    return (
        batch.join(urls, "url_hash", "left").join(texts, ["source", "content_hash"], "left")
        .withColumn("duplicate_reason", F.when(c("_u"), "url_hash").when(c("_t"), "content_hash"))
        .drop("_u", "_t"))


def insert_news(batch: DataFrame, table_path: str, id_col: str = "id") -> DataFrame:
    """Append the new articles of a batch to a Parquet table; returns the per-article outcome."""
    spark = batch.sparkSession
    checked = stage(batch)
    stored = read_if_there(spark, table_path)
    stored = checked.limit(0) if stored is None else stored
    marked = stage(new_articles(checked, stored))
    fresh = first_seen(marked.where("duplicate_reason is null"), id_col)
    stage_fresh = stage(fresh.select(*batch.columns))
    stage_fresh.write.mode("append").parquet(table_path)
    return marked.join(
        stage_fresh.select(id_col, F.lit(True).alias("inserted")), id_col, "left"
    ).withColumn("inserted", F.coalesce("inserted", F.lit(False)))


def article_keys() -> Column:
    """The two keys by which an article is known: its url, and its text within its source."""
    text = F.concat(F.lit("t:"), F.coalesce("source", F.lit("")), F.lit("\x1f"), c("content_hash"))
    return F.array(F.concat(F.lit("u:"), "url_hash"), text)  # null where a hash is


def insert_news_batch(batch: DataFrame, root: str, batch_id: int, id_col: str = "id") -> None:
    """Store the new articles of a micro-batch under ``root``, by a key table instead of the stored articles.

    What is new is found by ids and hashes alone; texts are read once more, to be written. Articles are written first, then their keys; each batch overwrites its own folders and looks at earlier batches only,
    so a replay after a crash between the two writes leaves the same table.
    """
    keys = KeyTable(f"{root}/keys")
    checked = stage(batch.select(id_col, "url_hash", "source", "content_hash"))
    known = keys.seen(checked.select(F.explode(article_keys()).alias("key")), batch_id)
    old = checked.select(id_col, F.explode(article_keys()).alias("key")).join(known, "key", "left_semi").select(id_col).distinct()
    fresh = first_seen(stage(checked.join(old, id_col, "left_anti")), id_col).select(id_col)
    batch.join(stage(fresh), id_col, "left_semi").select(*batch.columns).write.mode("overwrite").parquet(f"{root}/articles/batch={batch_id}")
    written = batch.sparkSession.read.schema(batch.schema).parquet(f"{root}/articles/batch={batch_id}")
    keys.add(written.select(F.explode(article_keys()).alias("key")), batch_id)


def pending_embeddings(items: DataFrame, vectors: DataFrame, limit: int = 100) -> DataFrame:
    """Oldest articles without a vector that are no known duplicates (``limit`` = work batch)."""
    waiting = items.where(~c("semantic_duplicate")).join(vectors.select("id"), "id", "left_anti")
    return waiting.orderBy(F.coalesce("published_at", "scraped_at"), "id").limit(limit)


def latest_news(items: DataFrame, symbol: str | None = None, limit: int = 20) -> DataFrame:
    """Newest articles that mention the symbol (any case)."""
    if symbol:
        needle = F.lit(symbol.upper())
        found = [F.contains(F.upper(F.coalesce(n, F.lit(""))), needle) for n in ("title", "summary", "content")]
        items = items.where(found[0] | found[1] | found[2])
    return items.orderBy(F.coalesce("published_at", "scraped_at").desc(), c("id").desc()).limit(limit)


def matching_or_all(items: DataFrame, symbol: str) -> DataFrame:
    """Rows whose title names the symbol, or all rows when none does."""
    match = F.contains(F.upper("title"), F.lit(symbol.upper()))
    found = items.agg(F.coalesce(F.max(match), F.lit(False)))
    return items.where(match | ~found.scalar())


def merge_news(local: DataFrame, live: DataFrame, limit: int | None = None) -> DataFrame:
    """Two lists in order, first one wins per url (per title where the url is '#')."""
    both = local.withColumn("_list", F.lit(0)).unionByName(live.withColumn("_list", F.lit(1)))
    key = F.when(c("url") != "#", c("url")).otherwise(F.lower("title"))
    names = [n for n in local.columns]
    merged = (
        both.groupBy(key.alias("_key"))
        .agg(F.min_by(F.struct(*names), F.struct("_list", "rank")).alias("_row"), F.min(F.struct("_list", "rank")).alias("_at"))
        .select("_row.*", "_at"))
    ordered = merged.orderBy("_at")
    return (ordered.limit(limit) if limit else ordered).drop("_at")


def candidate_links(links: DataFrame, per_page: int | None = None) -> DataFrame:
    """Links per page by url: place of the first, title of the last; the first ``per_page`` if a fetch budget is given."""
    merged = links.groupBy("page", "url").agg(
        F.min("position").alias("position"), F.max_by("title", "position").alias("title"))
    w = Window.partitionBy("page").orderBy("position")
    ranked = merged.withColumn("rank", F.row_number().over(w))
    return ranked.where(c("rank") <= per_page) if per_page else ranked


def enrich(items: DataFrame, outputs: DataFrame) -> DataFrame:
    """Add sentiment to articles whose title equals a scored text (last scored one wins).

    Texts are matched by a 256-bit hash, so that neither join nor aggregate moves them.
    """
    scored = outputs.select(tx.sha(c("text")).alias("_text"), "sentiment", "confidence", "seq")
    best = stage(scored.groupBy("_text").agg(F.max_by(F.struct("sentiment", "confidence"), "seq").alias("_s")))
    return items.withColumn("_title", tx.sha(c("title"))).join(best, c("_title") == c("_text"), "left").withColumns({
        "sentiment": c("_s.sentiment"),
        "sentiment_score": signed_score(c("_s.sentiment"), c("_s.confidence")),
    }).drop("_s", "_text", "_title")


def daily_sentiment(events: DataFrame) -> DataFrame:
    """Per (symbol, day): mean score, counts of all, bullish and bearish items, mean sector score."""
    score = default_score(c("sentiment_score"), c("sentiment"))
    scored = events.select(
        F.upper("symbol").alias("symbol"), F.to_date("ts").alias("day"), score.alias("_score"), "sector")
    sector = F.when(F.coalesce("sector", F.lit("")) != "", c("_score")).otherwise(0.0)
    return scored.groupBy("symbol", "day").agg(
        F.avg("_score").alias("sentiment_score"), F.count("_score").alias("sentiment_count"),
        F.count_if(c("_score") > 0.15).alias("bullish_count"),
        F.count_if(c("_score") < -0.15).alias("bearish_count"),
        F.avg(sector).alias("sector_sentiment"))


def model_sentiment(outputs: DataFrame) -> DataFrame:
    """Per symbol from model outputs (label, confidence); outputs without a symbol are left out."""
    total = F.sum("confidence")
    score = zero(div(F.sum(signed_score(c("sentiment"), c("confidence")) * c("confidence")), total))
    grouped = outputs.where(F.coalesce("symbol", F.lit("")) != "").groupBy(F.upper("symbol").alias("symbol")).agg(
        score.alias("sentiment_score"), F.least(F.lit(1.0), F.avg("confidence")).alias("confidence"),
        F.count(F.lit(1)).alias("count"))
    return grouped.withColumn("sentiment", score_label(c("sentiment_score")))


def scored_sentiment(events: DataFrame) -> DataFrame:
    """Per symbol from scored events, for the sentiment strategies."""
    weight = F.sum("confidence")
    score = clip(zero(div(F.sum(c("sentiment_score") * c("confidence")), weight)), -1.0, 1.0)
    confidence = F.when(weight == 0, F.least(F.lit(1.0), 1.0 / F.count(F.lit(1)))).otherwise(
        F.least(F.lit(1.0), F.avg("confidence")))
    grouped = events.groupBy(F.upper("symbol").alias("symbol")).agg(
        score.alias("news_score"), confidence.alias("news_confidence"), F.max("ts").alias("news_ts"))
    return grouped.withColumn("news_label", score_label(c("news_score")))


def gateway_sentiment(outputs: DataFrame) -> DataFrame:
    """Per symbol score with every output weighing at least 0.1."""
    weight = F.greatest(c("confidence"), F.lit(0.1))
    score = div(F.sum(signed_score(c("sentiment"), c("confidence")) * weight), F.sum(weight))
    return outputs.groupBy("symbol").agg(clip(zero(score), -1.0, 1.0).alias("sentiment_score"))
