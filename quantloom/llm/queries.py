"""Registered queries of the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import bucket, table

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_mixing(spark, sf_dir):
    from quantloom.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


ORACLES["op4_mixing"] = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT AS sid
  FROM sized GROUP BY source),
weighed AS (SELECT *, sid % 3 + 1 AS weight, source_size * 3 AS lim FROM ranked),
filled AS (
  SELECT *, coalesce(sum(lim) OVER w, 0)::BIGINT AS lim_ahead, coalesce(sum(weight) OVER w, 0)::BIGINT AS weight_ahead,
         (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS all_weight
  FROM weighed
  WINDOW w AS (ORDER BY lim / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stops AS (SELECT *, lim <= weight * ((total - lim_ahead) / (all_weight - weight_ahead)) AS stop FROM filled),
held AS (SELECT coalesce(sum(CASE WHEN stop THEN lim END), 0)::BIGINT AS held, coalesce(sum(CASE WHEN stop THEN weight END), 0)::BIGINT AS held_weight FROM stops),
targets AS (
  SELECT s.*, CASE WHEN stop THEN lim::DOUBLE ELSE weight * ((total - held) / nullif(all_weight - held_weight, 0)) END AS target
  FROM stops s CROSS JOIN held),
budgets AS (SELECT *, round(target)::BIGINT AS budget, coalesce(round(target)::BIGINT // nullif(source_size, 0), 0) AS epochs FROM targets),
ahead AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY b.sid ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM ahead
"""


@query
def op8_exact_dedup(spark, sf_dir):
    from quantloom.llm import exact_dedup

    return exact_dedup.find_copies(table(spark, sf_dir, "documents"), digest_all=True)


ORACLES["op8_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


#: Vocabulary of a public tokenizer; never copied into the repository.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op10_sentencepiece(spark, sf_dir):
    """Ids of every whole document, and whether decoding them gives the text back."""
    from quantloom.llm import pieces

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, pieces.Vocabulary.load(PIECE_MODEL), round_trip=True, keep_text=False)


@query
def op2_chat_format(spark, sf_dir):
    """All conversations and conversation -7, whose texts look like control strings, read back from the formatted text."""
    from quantloom.llm import chat

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sly = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), c("id").alias("turn"),
        F.when(c("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digest_formatted(chat.format_conversations(turns.unionByName(sly)))


ORACLES["op2_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, len(regexp_replace(text, '\\|<\|(turn|text|end|im_start|im_end|endoftext)\|>|</?s>|\[/?INST\]|<</?SYS>>', '', 'g')) AS plain,
         length(text) - length(replace(text, '\', '')) AS slashes,
         len(regexp_extract_all(text, '<\|(turn|text|end|im_start|im_end|endoftext)\|>|</?s>|\[/?INST\]|<</?SYS>>')) AS controls
  FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(23 + length(role) + length(text) + slashes + 2 * controls)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query
def op7_language_id(spark, sf_dir):
    from quantloom.llm import language

    docs = table(spark, sf_dir, "documents").withColumn("held_out", bucket(c("doc_id"), 4) == 2)
    model = language.fit(docs.where("not held_out"))
    return language.predict(docs.select("doc_id", "held_out", "text"), model)


@query
def op9_quality(spark, sf_dir):
    from quantloom.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.predict(docs, *quality.fit(docs))
    return scored.select("doc_id", "quality_score", "votes_posterior", (c("quality_score") >= quality.CUT).alias("kept"))


@query
def op3_toxicity(spark, sf_dir):
    from quantloom.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", bucket(c("doc_id"), 5) == 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(bucket(c("doc_id"), 5) != 0)
    return toxicity.classify(docs, labels)


@query
def op6_ngram_jaccard(spark, sf_dir):
    from quantloom.llm import near_dups

    return near_dups.join_similar(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_ann_forest(spark, sf_dir):
    from quantloom.llm import ann

    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), c("vec_id") % 20 == 0)


def dated_lists(pages: DataFrame) -> DataFrame:
    """List events derived from the hosts and URLs of the pages: about a third of the sites is listed at some time."""
    from quantloom.llm import url_lists

    def digits(start: int, n: int):
        return F.conv(F.substring("digest", start, n), 16, 10).cast("int")

    sites = pages.select(F.regexp_extract(url_lists.host(c("url")), r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("entry")).where("entry <> ''").distinct()
    urls = pages.select(c("url").alias("entry")).where("url is not null").distinct()
    both = sites.withColumn("kind", F.lit("domain")).unionByName(urls.withColumn("kind", F.lit("url"))).withColumn("digest", F.md5(c("entry").cast("binary")))
    lists = F.when(c("kind") == "url", F.lit("malware")).when(digits(1, 1) < 5, "spam").when(digits(1, 1) < 6, "trusted").otherwise("adult")
    listed = both.where(((c("kind") == "url") & (digits(1, 1) < 4)) | ((c("kind") == "domain") & (digits(1, 1) < 9))).withColumn("list", lists)
    steps = F.array(
        F.struct(F.lit("add").alias("action"), digits(2, 2).alias("day")),
        F.struct(F.lit("remove").alias("action"), (digits(2, 2) + digits(4, 2) % 120 + 1).alias("day")),
        F.struct(F.lit("add").alias("action"), (digits(2, 2) + digits(4, 2) % 120 + digits(6, 2) % 120 + 2).alias("day")))
    dated = listed.withColumn("step", F.explode(F.slice(steps, 1, digits(8, 1) % 3 + 1)))
    return dated.select("list", "kind", "entry", c("step.action").alias("action"), F.expr("timestamp_seconds(1704067200 + step.day * 86400L)").alias("at"))


@query
def op1_url_lists(spark, sf_dir):
    """Every page as a capture with a fetch time, against dated lists of sites and URLs."""
    from quantloom.llm import url_lists

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.expr("timestamp_seconds(1704067200 + (page_id * 7919 % 525600) * 60)"))
    judged = url_lists.judge(captures, dated_lists(pages), allow=("trusted",))
    return judged.select("page_id", "url", "blocked", F.size("hits").alias("n_hits"), F.array_join(F.transform(
        "hits", lambda h: F.concat_ws(" ", h["list"], h["key"], F.date_format(h["valid_from"], "yyyy-MM-dd"), F.coalesce(F.date_format(h["valid_to"], "yyyy-MM-dd"), F.lit("-")))), "|").alias("hits"))


ORACLES["op1_url_lists"] = r"""
WITH keyed AS (
  SELECT *, lower(coalesce(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1), '')) AS host FROM pages),
captures AS (
  SELECT page_id, url, host, make_timestamp((1704067200 + (page_id * 7919 % 525600) * 60) * 1000000) AS fetched_at, string_split(host, '.') AS labels,
         'u:' || host || regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS url_key
  FROM keyed),
entries AS (
  SELECT DISTINCT 'domain' AS kind, entry, 'd:' || entry AS key FROM (SELECT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS entry FROM captures) WHERE entry <> ''
  UNION ALL SELECT DISTINCT 'url', url, url_key FROM captures WHERE url IS NOT NULL),
digits AS (
  SELECT *, ('0x' || substr(md5(entry), 1, 1))::INT AS a, ('0x' || substr(md5(entry), 2, 2))::INT AS b, ('0x' || substr(md5(entry), 4, 2))::INT AS d,
         ('0x' || substr(md5(entry), 6, 2))::INT AS e, ('0x' || substr(md5(entry), 8, 1))::INT % 3 + 1 AS steps FROM entries),
listed AS (
  SELECT *, CASE WHEN kind = 'url' THEN 'malware' WHEN a < 5 THEN 'spam' WHEN a < 6 THEN 'trusted' ELSE 'adult' END AS list
  FROM digits WHERE (kind = 'url' AND a < 4) OR (kind = 'domain' AND a < 9)),
events AS (
  SELECT list, key, true AS active, b AS day FROM listed
  UNION ALL SELECT list, key, false, b + d % 120 + 1 FROM listed WHERE steps >= 2
  UNION ALL SELECT list, key, true, b + d % 120 + e % 120 + 2 FROM listed WHERE steps >= 3),
single AS (SELECT list, key, make_timestamp((1704067200 + day::BIGINT * 86400) * 1000000) AS valid_from, bool_and(active) AS active FROM events GROUP BY ALL),
spans AS (SELECT *, lead(valid_from) OVER (PARTITION BY list, key ORDER BY valid_from) AS valid_to FROM single),
asked AS (
  SELECT page_id, fetched_at, url_key AS key FROM captures WHERE host <> ''
  UNION SELECT page_id, fetched_at, 'd:' || array_to_string(labels[i:], '.') FROM (
    SELECT *, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS i FROM captures WHERE host <> '')),
hits AS (
  SELECT page_id, count(*) AS n_hits, bool_or(list = 'trusted') AS allowed,
         string_agg(list || ' ' || key || ' ' || strftime(valid_from, '%Y-%m-%d') || ' ' || coalesce(strftime(valid_to, '%Y-%m-%d'), '-'), '|' ORDER BY list, key) AS hits
  FROM asked JOIN spans USING (key)
  WHERE active AND valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to) GROUP BY page_id)
SELECT page_id, url, coalesce(n_hits > 0 AND NOT allowed, false) AS blocked, coalesce(n_hits, 0)::INT AS n_hits, coalesce(hits, '') AS hits
FROM captures LEFT JOIN hits USING (page_id)
"""


@query
def op11_warc(spark, sf_dir):
    """Every page through a monolithic archive, the normaliser and a read by offset."""
    from quantloom.llm import warc

    return warc.archive_pages(table(spark, sf_dir, "pages"))


#: Base32 of a 40-digit hex digest: four groups of 40 bits, eight letters each.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, {10 * g + 1}, 10))::BIGINT >> {35 - 5 * i}) & 31)::INT + 1, 1)" for g in range(4) for i in range(8))
ORACLES["op11_warc"] = f"""
WITH hashed AS (SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages),
ranked AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS keep, row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST) AS n FROM hashed)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n > 1 THEN keep END AS refers_to, url AS uri, true AS intact
FROM ranked
"""


@query
def op12_periodic_runs(spark, sf_dir):
    """Runs of every document, a tenth of which get a repeated end."""
    from quantloom.llm import periodic

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.find_runs(docs, periodic.repeated_text(c("doc_id"), c("text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(c("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op13_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector, components as integers, labels of every seventh moved on."""
    from quantloom.llm import hard_negatives

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    whole = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    moved = F.when(c("vec_id") % 7 == 0, (c("label") + 1) % 10).otherwise(c("label"))
    ready_rows = vectors.where(whole).select("vec_id", moved.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))
    return hard_negatives.mine(ready_rows, c("vec_id") % 100 == 0)


ORACLES["op13_hard_negatives"] = """
WITH base AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.n AS anchor, a.vec_id AS anchor_id, b.n, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM (SELECT * FROM base WHERE vec_id % 100 = 0) a JOIN base b ON a.n <> b.n),
positives AS (
  SELECT anchor, n AS p, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, n) <= 5)
SELECT s.anchor_id, p.positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM scored s JOIN positives p USING (anchor)
WHERE NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY anchor, p.p ORDER BY s.score DESC, s.vec_id, s.n)
QUALIFY rank <= 5
"""
