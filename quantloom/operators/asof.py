"""Backward as-of join without an all-pairs comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.session import stage


def asof_join(
    left: DataFrame,
    right: DataFrame,
    ts: str,
    values: list[str],
    slice_of: Column,
    by: list[str] | None = None,
    spread: list[str] | None = None,
    bucket_rows: int = 4096,
) -> DataFrame:
    """Add to each left row the ``values`` of the last right row with ``right.ts <= left.ts``.

    The left side is staged, so its plan runs once however often it is read here. Both sides are cut into time
    slices (``slice_of``, an expression over ``ts``). Within a slice they are unioned and the last value is carried
    forward; a slice that opens without a right row takes the closing value of the nearest earlier slice, found from
    one summary row per slice. Left rows of one slice are spread by the hash of ``spread`` over as
    many buckets as it takes for about ``bucket_rows`` rows each, so the right side (a reference
    series) is repeated, not the left.

    Every left row comes back once. Those whose time or key is null match nothing; right rows with a null time or key
    are ignored. ``right`` must hold one row per (by, ts). Columns of the left with the name of a value are replaced.
    """
    by = by or []
    keys = [*by, "_slice"]
    left = left.drop(*values)
    sound = F.lit(True)
    for name in (ts, *by):
        sound = sound & F.col(name).isNotNull()
    held = stage(left.withColumn("_slice", F.when(sound, slice_of)))
    cut = held.where("_slice is not null")
    sizes = stage(cut.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / bucket_rows).cast("int").alias("_buckets")))
    salt = F.pmod(F.hash(*(spread or left.columns)), F.col("_buckets"))
    left_cut = cut.join(sizes, keys).withColumn("_salt", salt).drop("_buckets")
    right_cut = right.where(sound).select(*by, ts, F.struct(*values).alias("_value")).withColumn("_slice", slice_of)

    every_slice = sizes.select(*keys).union(right_cut.select(*keys)).distinct()
    closing = right_cut.groupBy(*keys).agg(F.max_by("_value", ts).alias("_close"))
    earlier = Window.partitionBy(*by, F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = every_slice.join(closing, keys, "left").select(
        *keys, F.last("_close", ignorenulls=True).over(earlier).alias("_open")
    )

    payload = F.struct(*[F.col(name) for name in left.columns])
    events = left_cut.select(*keys, "_salt", ts, F.lit(1).alias("_side"), payload.alias("_row")).unionByName(
        right_cut.join(sizes, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1)))
        .select(*keys, "_salt", ts, F.lit(0).alias("_side"), "_value"),
        allowMissingColumns=True,
    )
    so_far = (
        Window.partitionBy(*keys, "_salt").orderBy(ts, "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    matched = (
        events.withColumn("_match", F.last("_value", ignorenulls=True).over(so_far))
        .where(F.col("_side") == 1)
        .join(opening, keys, "left")
        .withColumn("_match", F.coalesce("_match", "_open"))
    ).select("_row.*", *[F.col(f"_match.{name}").alias(name) for name in values])
    return matched.unionByName(held.where("_slice is null").drop("_slice"), allowMissingColumns=True)
