"""Null-safe arithmetic. Division by zero gives NULL and no expression creates NaN."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def lit(value: Column | float | int | str | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def div(numerator: Column, denominator: Column | float) -> Column:
    """``numerator / denominator``, NULL when the denominator is 0."""
    return F.try_divide(numerator, lit(denominator))


def zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clamp ``value``; NULL stays NULL."""
    bounded = value
    if low is not None:
        bounded = F.when(bounded < low, F.lit(low)).otherwise(bounded)
    if high is not None:
        bounded = F.when(bounded > high, F.lit(high)).otherwise(bounded)
    return bounded


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0 (also for NULL)."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def over_min(
    aggregate: Callable[[Column], Column], value: Column, frame: WindowSpec, min_rows: int
) -> Column:
    """Window aggregate that is NULL until ``min_rows`` non-null values are in the frame."""
    result = aggregate(value).over(frame)
    if min_rows <= 1:
        return result
    return F.when(F.count(value).over(frame) >= min_rows, result)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside ``body`` (a one-element transform)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def on_grid(value: Column) -> Column:
    """``value`` to 12 places: what is 0.1 by the numbers equals the limit 0.1, in whatever order doubles were added."""
    return F.round(value, 12)


def numeric_or_null(value: Column) -> Column:
    """Finite double or NULL for text, NaN and infinities."""
    number = value.try_cast("double")
    infinite = number.isin(float("inf"), float("-inf"))
    return F.when(~F.isnan(number) & ~infinite, number)


def first_nonzero(*values: Column) -> Column:
    """First value that is neither NULL nor 0."""
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values])
