"""Session helpers: UTC time, the shared checkpoint folder and staged tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin UTC, and let small shuffles keep enough tasks.

    Window features cost much CPU per byte, so merging small shuffle partitions into 1 MB
    tasks would leave most cores idle. Other sizing settings stay with the cluster.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application."""
    context = spark.sparkContext
    if not getattr(context, "_quantloom_shipped", False):
        base = Path(tempfile.mkdtemp(prefix="quantloom-py-")) / "quantloom"
        root = Path(__file__).resolve().parent
        context.addPyFile(shutil.make_archive(str(base), "zip", root.parent, root.name))
        context._quantloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables, taken from ``spark.checkpoint.dir``.

    A private temporary folder is used only where the setting is absent and the
    session is local (tests); on a cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="quantloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the file system remove a staged table when the application ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None before its first write; other read errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage (a lost executor re-reads the table instead of the raw input) and
    lets several later passes scan only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    delete_at_end(spark, path)
    _staged_paths(spark).append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quantloom_path = path
    return back


def _staged_paths(spark: SparkSession) -> list[str]:
    context = spark.sparkContext
    if not hasattr(context, "_quantloom_staged"):
        context._quantloom_staged = []
    return context._quantloom_staged


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system; no error if it is not there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def unstage(*tables: DataFrame) -> None:
    """Delete tables that ``stage`` returned and nothing unwritten reads any more."""
    for df in tables:
        delete_folder(df.sparkSession, df._quantloom_path)
        _staged_paths(df.sparkSession).remove(df._quantloom_path)


@contextmanager
def only_result_stays(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete all tables staged inside the block, but for those put into the list that it yields."""
    before, kept = set(_staged_paths(spark)), []
    yield kept
    keep = before | {df._quantloom_path for df in kept}
    for path in [p for p in _staged_paths(spark) if p not in keep]:
        delete_folder(spark, path)
        _staged_paths(spark).remove(path)
