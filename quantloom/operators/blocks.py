"""Cutting long time series into blocks that keep trailing windows exact.

A plain ``Window.partitionBy("symbol")`` puts the whole history of a hot symbol into
one task. Here every row gets its position in the series from per-slice counts, and
rows near a block edge are repeated in the neighbouring block, so window functions
partitioned by (symbol, block) see all the rows they need.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quantloom.settings import Blocks


def index_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slice_of: Column,
    running: dict[str, Column] | None = None,
) -> DataFrame:
    """Add ``pos`` (0-based rank within ``keys``) and running totals from the series start.

    ``slice_of`` must not decrease along ``order``; it only sets how the work is split.
    Rows are ranked inside (keys, slice); slices are stitched with prefix sums over one
    summary row per slice. ``order`` must be unique within ``keys``.
    """
    running = running or {}
    sliced = df.withColumn("_slice", slice_of)
    per_slice = Window.partitionBy(*keys, "_slice").orderBy(*order)
    so_far = per_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = (
        Window.partitionBy(*keys).orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{n}") for n, c in running.items()])
        .select(
            *keys, "_slice",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"),
            *[F.sum(f"_t_{n}").over(earlier).alias(f"_base_{n}") for n in running],
        )
    )
    ranked = sliced.select(
        *keys, "_slice", *[c for c in df.columns if c not in keys],
        (F.row_number().over(per_slice) - 1).alias("_rn"),
        *[F.sum(c).over(so_far).alias(f"_run_{n}") for n, c in running.items()],
    )
    joined = ranked.join(offsets, [*keys, "_slice"])
    totals = []
    for name in running:
        base, run = F.col(f"_base_{name}"), F.col(f"_run_{name}")
        both = F.coalesce(base, F.lit(0.0)) + F.coalesce(run, F.lit(0.0))
        totals.append(F.when(base.isNotNull() | run.isNotNull(), both).alias(name))
    return joined.select(*df.columns, (F.col("_base") + F.col("_rn")).alias("pos"), *totals)


def time_slice(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col(ts)) / seconds)


def with_blocks(indexed: DataFrame, blocks: Blocks) -> DataFrame:
    """Repeat edge rows into neighbouring blocks. ``own`` marks the row's home block."""
    home = F.floor(F.col("pos") / blocks.block_rows)
    offset = F.col("pos") % blocks.block_rows
    targets = F.array_compact(F.array(
        home,
        F.when(offset >= blocks.block_rows - blocks.halo_rows, home + 1),
        F.when((offset < blocks.lookahead_rows) & (home > 0), home - 1),
    ))
    return (
        indexed.withColumn("block", F.explode(targets))
        .withColumn("own", F.col("block") == home)
        .withColumn("sub", F.floor(F.col("pos") / blocks.scan_rows))
    )


def owned(df: DataFrame) -> DataFrame:
    """Drop the repeated rows once all windows are computed."""
    return df.where("own").drop("own", "sub")


@lru_cache(maxsize=None)
def series_window(*extra: str) -> WindowSpec:
    """Rows of one block in series order; shares its sort with :func:`scan_window`."""
    return Window.partitionBy("symbol", "block", *extra).orderBy("sub", "pos")


@lru_cache(maxsize=None)
def scan_window() -> WindowSpec:
    return Window.partitionBy("symbol", "block", "sub").orderBy("pos")


@lru_cache(maxsize=None)
def tail(rows: int) -> WindowSpec:
    """The current row and the ``rows - 1`` rows before it."""
    return series_window().rowsBetween(-(rows - 1), Window.currentRow)


@lru_cache(maxsize=None)
def before(rows: int) -> WindowSpec:
    """The ``rows`` rows before the current one."""
    return series_window().rowsBetween(-rows, -1)


def ema_columns(df: DataFrame, specs: dict[str, tuple[str, float]], blocks: Blocks) -> DataFrame:
    """Exponential averages ``y = a*x + (1-a)*y_prev`` with ``y_0 = x_0``.

    ``specs`` maps an output name to (input column, a). Inside a sub-block the average is
    a running sum of ``x * q^-k`` scaled back by ``q^k`` (q = 1 - a). What came before
    enters through the closing values of the two preceding sub-blocks; anything older
    weighs less than ``q^(2*scan_rows)`` and is below double precision.
    """
    step = F.col("pos") % blocks.scan_rows
    run = scan_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = series_window().rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_k", step.cast("double"))
    local = {}
    for name, (source, alpha) in specs.items():
        q = 1.0 - alpha
        start = F.when(F.col("pos") == 0, F.col(source)).otherwise(F.col(source) * alpha)
        local[f"_l_{name}"] = F.sum(start * F.pow(F.lit(q), -F.col("_k"))).over(run) * F.pow(F.lit(q), F.col("_k"))
    df = df.withColumns(local)
    closing = F.col("_k") == blocks.scan_rows - 1
    df = df.withColumns({
        f"_c_{name}": F.last(F.when(closing, F.col(f"_l_{name}")), ignorenulls=True).over(earlier)
        for name in specs
    })
    df = df.withColumns({
        f"_d_{name}": F.last(
            F.when(closing, F.coalesce(F.col(f"_c_{name}"), F.lit(0.0))), ignorenulls=True
        ).over(earlier)
        for name in specs
    })
    out = {}
    for name, (_, alpha) in specs.items():
        q = 1.0 - alpha
        older = F.coalesce(F.col(f"_d_{name}"), F.lit(0.0)) * (q ** blocks.scan_rows)
        carry = F.coalesce(F.col(f"_c_{name}"), F.lit(0.0)) + older
        out[name] = F.col(f"_l_{name}") + carry * F.pow(F.lit(q), F.col("_k") + 1)
    df = df.withColumns(out)
    drop = [f"{p}{n}" for n in specs for p in ("_l_", "_c_", "_d_")]
    return df.drop("_k", *drop)


def carry_last(df: DataFrame, column: str) -> DataFrame:
    """Fill NULLs of ``column`` with the last earlier value of the symbol, however far back.

    Looks inside the block first; only blocks that open without a value need the summary
    of the blocks before them (one row per block).
    """
    so_far = series_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("symbol").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    closing = (
        df.where("own").groupBy("symbol", "block")
        .agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col("pos"))).alias("_close"))
        .select("symbol", "block", F.last("_close", ignorenulls=True).over(earlier).alias("_carry"))
    )
    inside = df.withColumn("_inside", F.last(column, ignorenulls=True).over(so_far))
    return (
        inside.join(closing, ["symbol", "block"], "left")
        .withColumn(column, F.coalesce("_inside", "_carry"))
        .drop("_inside", "_carry")
    )
