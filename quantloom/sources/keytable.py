"""A table of keys seen so far, for de-duplication that never reads all of it again.

Keys are dealt by hash into ``buckets``. For each bucket a Bloom filter of ``bits`` bits is kept, as rows (bucket, word,
mask) that merge by a bitwise or, so filters have a fixed size whatever the table holds. A micro-batch looks its keys up in the filters of
its own buckets; only buckets with a key that the filter knows are read, and only their stored keys are joined. New keys
go to a folder of their batch, partitioned by bucket. ``compact`` merges the folders of old batches.

A batch sees what batches before it wrote and nothing else, and overwrites its own folders. So a batch that is replayed after a
crash, wherever it happened, finds what it found the first time and leaves the same table.

What a lookup read is written beside (``lookups``): buckets with a hit, keys read, keys of the batch.

Sizing: 10 bits per key keep false hits near 1 %; the defaults hold about 1.6 million keys, ``buckets`` and ``bits``
grow with what is planned. Beyond that lookups read more, but results stay right. Null keys are never seen and never stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.session import read_if_there, stage

c = F.col
HASHES = 4


@dataclass(frozen=True)
class KeyTable:
    root: str
    buckets: int = 64
    bits: int = 1 << 18

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(c("key"), F.lit("bucket")), F.lit(self.buckets)).cast("int")

    def marks(self, keys: DataFrame) -> DataFrame:
        """(key, bucket, word, mask): the bits that stand for each key."""
        bit = F.explode(F.array(*[F.pmod(F.xxhash64(c("key"), F.lit(i)), F.lit(self.bits)) for i in range(HASHES)]))
        return keys.select("key", "bucket", bit.alias("_bit")).select(
            "key", "bucket", F.expr("cast(_bit div 64 as int)").alias("word"), F.expr("shiftleft(1L, cast(_bit % 64 as int))").alias("mask"))

    def _filters(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """Filters as the last batch before this one left them."""
        for before in range(batch_id - 1, -1, -1):
            found = read_if_there(spark, f"{self.root}/filters/batch={before}")
            if found is not None:
                return found
        return None

    def seen(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """The distinct keys (column key) of ``keys`` that earlier batches have stored."""
        spark = keys.sparkSession
        asked = stage(keys.select("key").where("key is not null").distinct().withColumn("bucket", self.bucket()))
        filters = self._filters(spark, batch_id)
        if filters is None:
            return asked.select("key").limit(0)
        own = [r.bucket for r in asked.select("bucket").distinct().collect()]  # ``buckets`` rows at most
        hit = self.marks(asked).join(filters.where(c("bucket").isin(own)), ["bucket", "word"]).where(c("mask").bitwiseAND(c("filled")) == c("mask"))
        likely = stage(hit.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n")).where(c("n") == HASHES).select("key", "bucket"))
        wanted = [r.bucket for r in likely.select("bucket").distinct().collect()]
        stored = spark.read.parquet(f"{self.root}/keys").where(c("bucket").isin(wanted) & (c("batch") < batch_id)).select("bucket", "key")
        found = stage(likely.join(stored, ["bucket", "key"], "left_semi").select("key"))
        counts = stored.groupBy("bucket").count().agg(F.count(F.lit(1)).alias("buckets_read"), F.coalesce(F.sum("count"), F.lit(0)).alias("keys_read"))
        counts.withColumns({"batch_id": F.lit(batch_id), "keys_asked": F.lit(asked.count())}).write.mode("overwrite").parquet(f"{self.root}/lookups/batch={batch_id}")
        return found

    def add(self, keys: DataFrame, batch_id: int) -> None:
        """Store the keys of a batch (keys that are stored already do no harm) and extend the filters."""
        spark = keys.sparkSession
        new = stage(keys.select("key").where("key is not null").distinct().withColumn("bucket", self.bucket()))
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/keys/batch={batch_id}")
        filled = self.marks(new).groupBy("bucket", "word").agg(F.bit_or("mask").alias("filled"))
        before = self._filters(spark, batch_id)
        if before is not None:
            filled = filled.unionByName(before).groupBy("bucket", "word").agg(F.bit_or("filled").alias("filled"))
        filled.write.mode("overwrite").parquet(f"{self.root}/filters/batch={batch_id}")

    def lookups(self, spark: SparkSession) -> DataFrame:
        """Per batch: keys asked for, buckets and keys that were read."""
        return spark.read.parquet(f"{self.root}/lookups").select("batch_id", "keys_asked", "buckets_read", "keys_read")

    def compact(self, spark: SparkSession, before: int, into: str) -> KeyTable:
        """A copy of the table in which one folder holds the keys of all batches up to ``before``; the old one stays for its readers."""
        fresh = KeyTable(into, self.buckets, self.bits)
        stored = spark.read.parquet(f"{self.root}/keys").where(c("batch") <= before).select("key", "bucket").distinct()
        stored.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{into}/keys/batch={before}")
        self._filters(spark, before + 1).write.mode("overwrite").parquet(f"{into}/filters/batch={before}")
        return fresh
