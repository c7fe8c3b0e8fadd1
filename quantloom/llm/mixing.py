"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key. Documents are range-sorted by (source, key), word counts are summed ahead of each
one in two levels (inside a range, then over the ranges), and each source is cut where its budget ends. The cut of a
source is one row (its last key), so decisions reach the documents by a join with one row per source: texts are neither
sorted nor shuffled. A hot source spreads over as many ranges as it needs.

Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share the words of all documents by weight; a target
stops at ``MAX_EPOCHS`` times its source's words, the excess goes to the others by weight. With sources in order of
limit / weight those that stop come first, so prefix sums give the common level in one pass.

Defined cases: size is the number of runs of non-blank characters (null text: 0). A null source is a source of its own.
A source without words has target 0. A budget is its target rounded to whole words; the document at the cut is taken in
part. Rows that agree in doc_id, source and size are treated alike: at the cut each takes an equal whole share. Empty
tables give empty results; further columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = 3
MAX_EPOCHS = 3
SEED = "mix-1:"
c = F.col


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column) -> Column:
    """60 bits of a digest of the id: the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 15), 16, 10).cast("long")


def sums_ahead(df: DataFrame, group: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """Adds ``<value>_ahead``: sums of earlier rows of the group. Rows meet per range, ranges per group: both bounded."""
    ranged = stage(df.repartitionByRange(*[c(g) for g in group], *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over_parts = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part", *group).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    bases = totals.select("_part", *group, *[F.coalesce(F.sum(f"_{v}").over(over_parts), F.lit(0)).alias(f"_{v}") for v in values])
    summed = ranged.withColumns({f"{v}_ahead": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    joined = summed.join(stage(bases), ["_part", *group])
    return joined.withColumns({f"{v}_ahead": c(f"{v}_ahead") + c(f"_{v}") for v in values}).drop("_part", *[f"_{v}" for v in values])


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: sid, source, source_size, target, epochs (whole passes) and rest (words of the last pass)."""
    totals = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = sums_ahead(totals.withColumns({"one": F.lit(1).cast("long"), "_all": F.lit(0)}), ["_all"], [c("source").asc_nulls_last()], ["one"])
    weighed = ranked.select(c("one_ahead").alias("sid"), "source", "source_size", (c("one_ahead") % WEIGHTS + 1).alias("weight"), "_all")
    limits = weighed.withColumn("limit", c("source_size") * MAX_EPOCHS)
    filled = stage(sums_ahead(limits, ["_all"], [(c("limit") / c("weight")).asc(), c("sid").asc()], ["limit", "weight"]))
    total, weight = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (F.lit(total) - c("limit_ahead")) / (F.lit(weight) - c("weight_ahead"))
    stops = filled.withColumn("stops", c("limit") <= c("weight") * level)
    held, held_weight = stops.where("stops").agg(F.coalesce(F.sum("limit"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    free = (F.lit(total) - F.lit(held)) / F.nullif(F.lit(weight) - F.lit(held_weight), F.lit(0))
    target = F.when(c("stops"), c("limit").cast("double")).otherwise(c("weight") * free)
    budget = F.round("target").cast("long")
    out = stops.withColumn("target", target).withColumn("budget", budget)
    epochs = F.coalesce(F.expr("budget div nullif(source_size, 0)"), F.lit(0))
    return stage(out.withColumn("epochs", epochs).select("sid", "source", "source_size", "target", "epochs", (c("budget") - c("epochs") * c("source_size")).alias("rest")))


def cut_points(sizes: DataFrame) -> DataFrame:
    """One row per source: its target and the place where its last pass ends."""
    plan = targets(sizes)
    alike = sizes.groupBy("source", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("words", c("n") * c("size"))
    keyed = alike.alias("a").join(plan.alias("p"), c("a.source").eqNullSafe(c("p.source"))).select("p.sid", "p.rest", "a.key", "a.doc_id", "a.size", "a.n", "a.words")
    ahead = sums_ahead(keyed, ["sid"], [c("key").asc(), c("doc_id").asc(), c("size").asc()], ["words"])
    cut = ahead.where((c("words_ahead") <= c("rest")) & (c("rest") < c("words_ahead") + c("words")))
    ends = cut.select("sid", c("key").alias("cut_key"), c("doc_id").alias("cut_id"), c("size").alias("cut_size"),
                      F.expr("(rest - words_ahead) div n").alias("cut_share"))
    return stage(plan.join(ends, "sid", "left").withColumnRenamed("source", "cut_source").drop("sid", "rest"))


def attach(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, key, size, ...) with source_size, target and ``taken`` words."""
    first = F.struct("key", "doc_id", "size")
    last = F.struct(c("cut_key").alias("key"), c("cut_id").alias("doc_id"), c("cut_size").alias("size"))
    part = F.when(c("cut_key").isNull() | (first > last), F.lit(0)).when(first < last, c("size")).otherwise(c("cut_share"))
    joined = rows.join(cuts, c("source").eqNullSafe(c("cut_source")))
    return joined.withColumn("taken", (c("epochs") * c("size") + part).cast("long")).drop("cut_source", "epochs", "cut_key", "cut_id", "cut_size", "cut_share")


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"size": words(c("text")), "key": random_key(c("doc_id"))})


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and taken (words the mix takes, repeats counted)."""
    sizes = stage(sized(docs.select("doc_id", "source", "text")).drop("text"))
    return attach(sizes, cut_points(sizes)).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row per whole copy, and one with the first words where the cut falls.

    ``n_chars``, if there, follows the text of a cut copy.
    """
    names = docs.columns
    sizes = stage(sized(docs.select("doc_id", "source", "text")).drop("text"))
    renamed = docs.select(*[c(n).alias(f"in_{n}") for n in names], "doc_id", "source", "text")
    taken = attach(sized(renamed), cut_points(sizes)).where("taken > 0")
    copies = taken.withColumn("_words", F.explode(F.expr(
        "concat(array_repeat(size, cast(taken div size as int)), filter(array(taken % size), x -> x > 0))")))
    pieces = F.regexp_extract_all(c("text"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.when(c("_words") < c("size"), F.array_join(F.slice(pieces, F.lit(1), c("_words").cast("int")), "")).otherwise(c("text"))
    out = copies.withColumn("_cut", cut)
    kinds = dict(docs.dtypes)
    return out.select(*[
        c("_cut").alias(n) if n == "text"
        else F.when(c("_words") < c("size"), F.length("_cut")).otherwise(c("in_n_chars")).cast(kinds[n]).alias(n) if n == "n_chars"
        else c(f"in_{n}").alias(n) for n in names])
