"""Exact de-duplication by progressive refinement: length, then prefix hash, then full hash.

Each level counts its groups with a map-side aggregate and publishes those of two rows or more as a bitmap of bounded
size (``common.bitmap``), which is the only thing that is broadcast. A row whose bit is unset is alone and leaves the
refinement; the next level is computed for the others only. A false positive of the bitmap costs one hash and changes
no result. Full texts are hashed for surviving groups only and are never shuffled by the refinement.

Defined cases: null text is the empty text. Texts are equal when their UTF-8 bytes are. Of equal texts the row with the
largest ``doc_id`` stays (null is the smallest); of repeated rows with that ``doc_id`` one stays. Empty tables give
empty results; further columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import ROW, Bitmap, bitmap, maybe_in, named_rows, stage, without_rows

PREFIX_CHARS = 256
c = F.col


def content() -> Column:
    return F.coalesce(c("text"), F.lit(""))


def level_keys() -> dict[str, Column]:
    return {
        "_length": F.octet_length(content()),
        "_prefix": F.xxhash64(F.octet_length(content()), F.substring(content(), 1, PREFIX_CHARS)),
    }


def shared_bits(rows: DataFrame, key: str) -> Bitmap:
    """Bitmap of the values of ``key`` that two or more rows have."""
    return bitmap(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), key)


def survivors(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_alive``: the document shares length and prefix hash with another one (or seems to)."""
    small = stage(docs.select(*[v.alias(k) for k, v in level_keys().items()]))
    by_length = maybe_in(small, "_length", shared_bits(small, "_length"), "_same_length").where("_same_length")
    bits = shared_bits(by_length, "_prefix")
    return maybe_in(docs.withColumn("_prefix", level_keys()["_prefix"]), "_prefix", bits, "_alive").drop("_prefix")


def groups_of(rows: DataFrame) -> DataFrame:
    """One row per full hash that several rows have: size and the row that stays."""
    found = rows.groupBy("_full").agg(F.count(F.lit(1)).alias("_size"), F.max(F.struct("doc_id", "_row")).alias("_keep"))
    return stage(found.where("_size > 1").select("_full", "_size", c("_keep.doc_id").alias("_keep_id"), c("_keep._row").alias("_keep_row")))


def find_copies(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, and text_sha256 if ``digest_all`` (else only of survivors)."""
    full = F.sha2(content().cast("binary"), 256)
    rows = stage(survivors(docs.select("doc_id", "text")).select(
        "doc_id", F.monotonically_increasing_id().alias("_row"), F.when(c("_alive"), full).alias("_full"),
        (full if digest_all else F.when(c("_alive"), full)).alias("text_sha256")))
    alive = rows.where("_full is not null")
    joined = alive.join(groups_of(alive), "_full", "left")
    together = joined.select(
        "doc_id", F.when(c("_size").isNull(), c("doc_id")).otherwise(c("_keep_id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(c("_row") == c("_keep_row"), F.lit(True)).alias("kept"), "text_sha256")
    alone = rows.where("_full is null").select(
        "doc_id", c("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return together.unionByName(alone)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are not kept; of rows that share text and doc_id the last by file and place stays.

    Rows are told apart by where they lie, so only lengths, hashes and ids are shuffled, no texts.
    """
    named = named_rows(docs)
    flagged = survivors(named.select("doc_id", "text", *ROW)).where("_alive")
    alive = stage(flagged.select("doc_id", *ROW, F.sha2(content().cast("binary"), 256).alias("_full")))
    best = alive.groupBy("_full").agg(F.count(F.lit(1)).alias("_size"), F.max(F.struct("doc_id", *ROW)).alias("_keep"))
    groups = stage(best.where("_size > 1").select(c("_full").alias("_group"), *[c(f"_keep.{n}").alias(f"_keep{n}") for n in ROW]))
    lost = alive.join(groups, c("_full") == c("_group")).where((c("_row_file") != c("_keep_row_file")) | (c("_row_at") != c("_keep_row_at")))
    return without_rows(named, stage(lost.select(*ROW)))
