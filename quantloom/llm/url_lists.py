"""URL filters over time: dated list entries become validity intervals; captures are judged as of their fetch time.

An entry is a domain (matching its subdomains too) or a URL, added to or removed from a named list at a time. Events turn
into intervals that end at the entry's next event. A capture has a few keys, its URL and the suffixes of its host; keys
that no list holds drop out in a join with the distinct entries. What is left is sorted by (key, list, time) together
with the intervals, and each capture takes the last interval that began before it. The sort is by ranges and what a range
needs to know of earlier ones is one row per range and key, so neither a hot host nor a hot entry meets in one task.

Defined cases: an event at the very fetch time counts. Of events of one entry at one time a removal wins; repeated events
count once; events with a null are left out. A capture without URL, host or time matches nothing and is not blocked. An active
entry of an ``allow`` list overrules all others. Repeated captures are judged each. Further columns of events pass by, of captures
too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import stage

HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)"
c = F.col


def host(url: Column) -> Column:
    """Lower-case host; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def url_key(url: Column) -> Column:
    """Host and path without a slash at the end; scheme, port, user, query and fragment don't count."""
    return F.concat(F.lit("u:"), host(url), F.regexp_replace(F.regexp_extract(url, PATH, 1), "/+$", ""))


def capture_keys(url: Column) -> Column:
    """The URL's key and those of all host suffixes of two labels or more (or of the only label)."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), ".")))
    return F.when(host(url) != "", F.concat(F.array(url_key(url)), suffixes)).otherwise(F.array().cast("array<string>"))


def entry_key(kind: Column, entry: Column) -> Column:
    """Key of a list entry: kind ``url`` (a whole URL) or ``domain``."""
    return F.when(kind == "url", url_key(entry)).when(kind == "domain", F.concat(F.lit("d:"), F.lower(entry)))


def latest(rows: DataFrame, keys: list[str], order: list[str], value: str, itself: bool) -> DataFrame:
    """Adds ``_latest``: the last non-null ``value`` of earlier rows of the group (of the row too, if ``itself``)."""
    ranged = stage(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    ends = ranged.groupBy("_part", *keys).agg(F.max(F.when(c(value).isNotNull(), F.struct(*order, value)))[value].alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = stage(ends.select("_part", *keys, F.last("_end", ignorenulls=True).over(earlier).alias("_before")))
    here = ranged.withColumn("_here", F.last(value, ignorenulls=True).over(inside))
    return here.join(carried, ["_part", *keys]).withColumn("_latest", F.coalesce("_here", "_before")).drop("_part", "_here", "_before")


def intervals(events: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to, active) of events (list, kind, entry, action, at); the last one has no end."""
    keyed = events.select("list", entry_key(c("kind"), c("entry")).alias("key"), (c("action") == "add").alias("active"), c("at").alias("valid_from"))
    single = keyed.dropna().groupBy("list", "key", "valid_from").agg(F.min("active").alias("active"))
    backwards = single.withColumn("_back", -F.unix_micros(c("valid_from").cast("timestamp")))
    return latest(backwards, ["key", "list"], ["_back"], "valid_from", itself=False).select(
        "list", "key", "valid_from", c("_latest").alias("valid_to"), "active")


def judge(captures: DataFrame, events: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """``captures`` (url, fetched_at, ...) with ``hits`` (list, key, valid_from, valid_to; sorted) and ``blocked``."""
    named = [n for n in captures.columns if n not in ("hits", "blocked")]
    base = stage(captures.select(*[f"`{n}`" for n in named]).withColumn("_capture", F.monotonically_increasing_id()))
    spans = stage(intervals(events))
    held = stage(spans.select(c("key").alias("_held"), c("list").alias("_list")).distinct())
    asked = base.where("fetched_at is not null").select("_capture", "fetched_at", F.explode(F.array_distinct(capture_keys(c("url")))).alias("key"))
    probes = asked.join(held, c("key") == c("_held")).select("key", c("_list").alias("list"), c("fetched_at").alias("at"), F.lit(1).alias("tag"), "_capture", F.lit(None).alias("span"))
    starts = spans.select("key", "list", c("valid_from").alias("at"), F.lit(0).alias("tag"), F.lit(None).cast("long").alias("_capture"), F.struct("valid_from", "valid_to", "active").alias("span"))
    probes = probes.withColumn("span", F.lit(None).cast(starts.schema["span"].dataType))
    judged = latest(starts.unionByName(probes), ["key", "list"], ["at", "tag", "_capture"], "span", itself=True)
    active = judged.where("tag = 1 and _latest.active").select("_capture", F.struct("list", "key", c("_latest.valid_from").alias("valid_from"), c("_latest.valid_to").alias("valid_to")).alias("hit"))
    hits = stage(active.groupBy("_capture").agg(F.array_sort(F.collect_list("hit")).alias("hits")).withColumnRenamed("_capture", "_hit"))
    joined = base.join(hits, c("_capture") == c("_hit"), "left")
    allowed = F.exists("hits", lambda h: h["list"].isin(*allow)) if allow else F.lit(False)
    found = F.coalesce(c("hits"), F.array().cast(hits.schema["hits"].dataType))
    return joined.withColumn("hits", found).select(*[f"`{n}`" for n in named], "hits", ((F.size("hits") > 0) & ~allowed).alias("blocked"))
