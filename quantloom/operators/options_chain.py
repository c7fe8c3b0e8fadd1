"""Options-chain payloads to per-snapshot summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.safe import div, zero

c = F.col

SIDE = "STRUCT<openInterest: DOUBLE, changeinOpenInterest: DOUBLE, impliedVolatility: DOUBLE>"
PAYLOAD = (
    f"STRUCT<records: STRUCT<data: ARRAY<STRUCT<strikePrice: DOUBLE, CE: {SIDE}, PE: {SIDE}>>, "
    "underlyingValue: DOUBLE>>"
)


def parse_chain(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row per strike of each JSON payload, next to the payload's own columns.

    A payload is parsed once: as the only entry of an exploded array it is a column of its own, which neither the filter that
    Spark derives from the second explode nor the fields taken from it repeat.
    """
    keep = [n for n in payloads.columns if n != column]
    parsed = payloads.select(*keep, F.explode(F.array(F.from_json(column, PAYLOAD))).alias("_p"))
    return parsed.select(
        *keep, c("_p.records.underlyingValue").alias("underlying_value"), F.explode("_p.records.data").alias("_s")
    ).select(
        *keep, "underlying_value", c("_s.strikePrice").alias("strike"),
        c("_s.CE.openInterest").alias("call_oi"), c("_s.PE.openInterest").alias("put_oi"),
        c("_s.CE.changeinOpenInterest").alias("call_oi_change"), c("_s.PE.changeinOpenInterest").alias("put_oi_change"),
        c("_s.CE.impliedVolatility").alias("call_iv"), c("_s.PE.impliedVolatility").alias("put_iv"))


def summarize_chain(strikes: DataFrame, skip_zero: bool = False) -> DataFrame:
    """Per (symbol, ts): open interest, put/call ratio, mean volatility, middle strike.

    ``skip_zero`` is the signal layer's reading: volatilities and strikes of 0 do not
    count and the ratio without calls is 1; otherwise that ratio is NULL. The middle is
    the upper one for an even count. Rows are first summed per strike (map-side), so the
    running count that finds the middle sees each strike of a chain once.
    """
    def usable(name: str) -> Column:
        return F.when(c(name) != 0, c(name)) if skip_zero else c(name)

    calls, puts = usable("call_iv"), usable("put_iv")
    sums = ("call_oi", "put_oi", "call_oi_change", "put_oi_change")
    per_strike = strikes.groupBy(F.upper("symbol").alias("symbol"), "ts", usable("strike").alias("strike")).agg(
        *[F.sum(n).alias(n) for n in sums],
        (zero(F.sum(calls)) + zero(F.sum(puts))).alias("_iv"), (F.count(calls) + F.count(puts)).alias("_ivs"),
        F.count("strike").alias("_n"), F.max("underlying_value").alias("underlying_value"))
    chain = Window.partitionBy("symbol", "ts")
    upto = chain.orderBy(c("strike").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = F.when(c("strike").isNotNull(), c("_n"))
    ranked = per_strike.withColumns({
        "_upto": F.sum(counted).over(upto), "_all": F.sum(counted).over(chain)})
    middle = F.min(F.when(c("_upto") > F.floor(c("_all") / 2), c("strike")))
    call_oi, put_oi = zero(F.sum("call_oi")), zero(F.sum("put_oi"))
    ratio = F.when(call_oi > 0, put_oi / call_oi)
    return ranked.groupBy("symbol", "ts").agg(
        (F.coalesce(ratio, F.lit(1.0)) if skip_zero else ratio).alias("pcr"),
        call_oi.alias("call_oi"), put_oi.alias("put_oi"),
        zero(F.sum("call_oi_change")).alias("call_oi_change"), zero(F.sum("put_oi_change")).alias("put_oi_change"),
        div(F.sum("_iv"), F.sum("_ivs")).alias("iv"), middle.alias("max_pain"),
        F.max("underlying_value").alias("underlying_value"))


def last_of_day(snapshots: DataFrame) -> DataFrame:
    """Last snapshot per (symbol, day)."""
    names = [n for n in snapshots.columns if n not in ("symbol", "ts")]
    return (
        snapshots.groupBy("symbol", F.to_date("ts").alias("day"))
        .agg(F.max_by(F.struct(*names), "ts").alias("_s")).select("symbol", "day", "_s.*"))
