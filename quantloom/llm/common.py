"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.session import ship_package, stage, unstage

c = F.col

#: A bitmap of keys has BITS_PER_KEY bits for each, at least FILTER_BITS and at most MOST_BITS: a broadcast table of 65,536 to
#: 2,097,152 words of 64 bits. Beyond that false positives grow, which costs shuffle but changes no result.
FILTER_BITS, BITS_PER_KEY, MOST_BITS = 1 << 22, 16, 1 << 27


#: Rows of an Arrow batch, where the session has Spark's default: whole texts are large, and a batch is copied several times.
BATCH_ROWS = 1000
#: Rows that a reader of Parquet decodes at a time in the pipeline, where the session has Spark's default: 4,096 whole texts fill
#: byte arrays of 16 MB a task, which are copied as they grow, and the executor's heap grows with them.
READ_ROWS = 512


def ready(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers and keep batches of texts small."""
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def ready_for_texts(spark: SparkSession) -> SparkSession:
    """``ready``, for jobs that read whole texts again and again: readers of Parquet decode few rows at a time."""
    if spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096":
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    return ready(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the session is made ready first."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(key: Column, parts: int) -> Column:
    """Remainder of the checksum of a key's text; null counts as the text ``null``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % F.lit(parts)


def bounded_sample(df: DataFrame, group: str, key: Column, limit: int) -> DataFrame:
    """About ``limit`` rows of each value of ``group`` (all of them where there are fewer).

    Rows are chosen by a hash of ``key`` against a share computed from the group's count, so no group meets in one
    task. The sample exceeds ``limit`` by a few standard deviations (square root of ``limit``) at most.
    """
    shares = df.groupBy(group).agg((F.lit(float(limit)) / F.count(F.lit(1))).alias("_share"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = df.withColumn("_draw", draw).alias("d").join(shares.alias("s"), F.col(f"d.{group}").eqNullSafe(F.col(f"s.{group}")))
    return drawn.where(F.col("_draw") < F.col("_share")).select("d.*").drop("_draw")


def sampled_rows(docs: DataFrame, group: str, limit: int) -> DataFrame:
    """About ``limit`` rows of each value of ``group``, with all columns; texts are neither shuffled nor read to draw.

    Rows are drawn by id and place, so rows that share an id are drawn one by one. The drawn places are broadcast: ``limit``
    for each value.
    """
    named = named_rows(docs)
    drawn = stage(bounded_sample(named.select(group, "doc_id", *ROW), group, F.xxhash64("doc_id", ROW[1]), limit).select(*ROW))
    return named.join(F.broadcast(drawn), list(ROW), "left_semi").drop(*ROW)


def slices(texts: list[str | None], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``chars`` characters, one row at least: bounds the working memory of a batch."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Bitmap(NamedTuple):
    words: DataFrame  # (_word, _bits)
    bits: int


def bitmap(keys: DataFrame, *key: str) -> Bitmap:
    """A bit for the hash of every value of ``key``, staged; sized by their number."""
    hashed = stage(keys.select(F.xxhash64(*key).alias("_hash")))
    bits, count = FILTER_BITS, hashed.count()
    while bits < min(MOST_BITS, count * BITS_PER_KEY):
        bits *= 2
    bit = hashed.select(F.pmod("_hash", F.lit(bits)).alias("_bit"))
    words = bit.select(F.expr("cast(_bit div 64 as int)").alias("_word"), F.expr("shiftleft(1L, cast(_bit % 64 as int))").alias("_bits"))
    held = stage(words.groupBy("_word").agg(F.bit_or("_bits").alias("_bits")))
    unstage(hashed)
    return Bitmap(held, bits)


def maybe_in(rows: DataFrame, key: str | tuple[str, ...], held: Bitmap, flag: str) -> DataFrame:
    """Adds a boolean: the bit of ``key`` is set. Unset means that the value is not among the keys; rows are not shuffled."""
    names = (key,) if isinstance(key, str) else key
    marked = rows.withColumn("_bit", F.pmod(F.xxhash64(*names), F.lit(held.bits))).withColumn("_word", F.expr("cast(_bit div 64 as int)"))
    test = F.expr("shiftright(_bits, cast(_bit % 64 as int)) & 1L") == 1
    return marked.join(F.broadcast(held.words), "_word", "left").withColumn(flag, F.coalesce(test, F.lit(False))).drop("_bit", "_word", "_bits")


#: Columns that name a row for good: its file and its place in it.
ROW = ("_row_file", "_row_at")


def named_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns ``ROW``. A plain scan of files has them already, anything else is staged first."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    files = docs if plan.nodeName() == "LogicalRelation" else stage(docs)
    try:
        return files.select(*[c(f"`{n}`") for n in docs.columns], c("_metadata.file_path").alias("_row_file"), c("_metadata.row_index").alias("_row_at"))
    except AnalysisException:  # files of a format without row numbers
        files = stage(docs)
        return files.select(*[c(f"`{n}`") for n in docs.columns], c("_metadata.file_path").alias("_row_file"), c("_metadata.row_index").alias("_row_at"))


def without_rows(named: DataFrame, gone: DataFrame) -> DataFrame:
    """``named_rows`` but for those in staged ``gone`` (``ROW``).

    Two bitmaps tell apart which rows go and which only seem to, so that hardly any content is shuffled: rows in neither
    pass, rows that go for certain are dropped where they lie, and a few that both bitmaps flag are joined.
    """
    names = [c(f"`{n}`") for n in named.columns if n not in ROW]
    go = bitmap(gone, *ROW)
    flagged = maybe_in(named.select(*ROW), ROW, go, "_maybe").where("_maybe").drop("_maybe")
    stay = bitmap(stage(flagged.join(gone, list(ROW), "left_anti")), *ROW)  # false positives of the first
    marked = maybe_in(maybe_in(named, ROW, go, "_maybe"), ROW, stay, "_unsure")
    sure = marked.where("not _maybe").select(*names)
    return sure.unionByName(marked.where("_maybe and _unsure").join(gone, list(ROW), "left_anti").select(*names))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): rows (node, root), root being the smallest node. Nodes without an edge are left out.

    Alternates the large-star and small-star steps until nothing changes. Each step is a minimum per node (combined
    before the shuffle) and a join of two staged tables, which splits hot nodes.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    current, before = stage(pairs.distinct()), None
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if state == before:
            return current.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
                current.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
        before = state
        around = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(current.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        smallest = stage(around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")))
        large = stage(around.where("v > u").join(smallest, F.col("u") == F.col("n")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        lowest = stage(large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "n"))
        joined = large.join(lowest, F.col("hi") == F.col("n"))
        used = (current, smallest, large, lowest)
        current = stage(joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(
            lowest.select(F.col("n").alias("hi"), F.col("m").alias("lo"))).distinct())
        unstage(*used)
