"""Sinks: appended snapshots and upserts by key on Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.session import delete_folder, read_if_there, stage

# Snapshot tables and the columns they are partitioned by.
SNAPSHOT_TABLES = {
    "strategy_signals": ["day"], "ensemble_signals": ["day"], "regimes": ["day"], "risk_outputs": ["day"],
    "backtests": ["strategy_name"], "accuracy": ["strategy_name"], "anomalies": ["day"], "weights": ["day"],
    "rewards": ["strategy_name"], "feedback": ["strategy_name"], "predictions": ["day"],
    "feature_store": ["feature_name"], "final_signals": ["day"],
}


def append_snapshot(df: DataFrame, root: str, table: str) -> str:
    """Append rows to a snapshot table; a ``day`` partition is taken from ``ts``."""
    keys = SNAPSHOT_TABLES[table]
    if "day" in keys and "day" not in df.columns:
        df = df.withColumn("day", F.to_date("ts"))
    path = f"{root}/{table}"
    df.write.mode("append").partitionBy(*keys).parquet(path)
    return path


def latest_by_key(df: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """Newest version of each key; ties must not exist in ``version``."""
    rest = [n for n in df.columns if n not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_row")).select(*keys, "_row.*")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with the incoming ones replacing equal keys."""
    both = stored.withColumn("_v", F.lit(0)).unionByName(incoming.withColumn("_v", F.lit(1)))
    return latest_by_key(both, keys, F.col("_v")).drop("_v")


def write_version(df: DataFrame, root: str) -> str:
    """Write a table version to its own folder, so readers of the old one are not disturbed."""
    path = f"{root}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def upsert_partitions(incoming: DataFrame, path: str, keys: list[str], partition: str) -> None:
    """Upsert by key into a Parquet table partitioned by ``partition``, rewriting touched partitions only.

    ``keys`` decide the partition (a key never moves), so only the partitions that ``incoming`` names are read, merged
    and overwritten; all others keep their files. Of repeated incoming keys the row that sorts last stays. The merged rows are
    staged first, so a failed write can be repeated, and a replay of the same rows leaves the same table.
    """
    spark = incoming.sparkSession
    rest = [n for n in incoming.columns if n not in (*keys, partition)]
    single = stage(incoming.groupBy(*keys, partition).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, partition, "_row.*"))
    stored = read_if_there(spark, path)
    if stored is not None:
        # A semi join on the partition column prunes partitions at run time, however many are touched.
        near = stored.select(*single.columns).join(single.select(partition).distinct(), partition, "left_semi")
        single = stage(upsert(near, single, [*keys, partition]))
    single.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def compact_versions(spark: SparkSession, folder: str, keys: list[str], upto: int) -> None:
    """Replace the versions of all micro-batches up to ``upto`` (folders ``batch=N``) by one folder with the newest row per key.

    Readers find the newest version of each key before, during and after: the merged folder takes the place of the last batch,
    and the earlier ones, which hold nothing newer, are removed afterwards.
    """
    rows = spark.read.parquet(f"{folder}/data").where(F.col("batch") <= upto)
    batches = [r.batch for r in rows.select("batch").distinct().collect()]
    newest = stage(latest_by_key(rows.drop("batch"), keys, F.col("batch_id")))
    newest.select(*[n for n in rows.columns if n != "batch"]).write.mode("overwrite").parquet(f"{folder}/data/batch={upto}")
    for batch in batches:
        if batch < upto:
            delete_folder(spark, f"{folder}/data/batch={batch}")
