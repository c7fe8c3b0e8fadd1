"""Bar files and quote payloads to the bar schema."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.safe import first_nonzero
from quantloom.functions.text import parse_datetime
from quantloom.session import stage

c = F.col

BAR_SCHEMA = (
    "symbol STRING, ts TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, source STRING")


def _pick(df: DataFrame, *names: str) -> Column:
    """First non-empty of the columns that exist, as text."""
    present = [F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def from_table(df: DataFrame, symbol: str, source: str) -> DataFrame:
    """Rename and cast the usual column spellings. Missing volume is 0, missing symbol the given one."""
    def number(name: str) -> Column:
        return _pick(df, name, name.capitalize()).cast("double")

    return df.select(
        F.upper(F.coalesce(_pick(df, "symbol"), F.lit(symbol))).alias("symbol"),
        parse_datetime(_pick(df, "timestamp", "date", "Date", "ts")).alias("ts"),
        *[number(n).alias(n) for n in ("open", "high", "low", "close")],
        F.coalesce(number("volume"), F.lit(0.0)).alias("volume"), F.lit(source).alias("source"))


def read_csv(spark: SparkSession, path: str, symbol: str, source: str = "kaggle_ohlcv") -> DataFrame:
    """Bars from CSV files with a header each; spelling and order of the columns may differ by file.

    The first line of every file is found first, one row per file. The distinct spellings (a handful) reach the
    driver, and the lines of each are parsed by name.
    """
    lines = spark.read.text(path).select("value", c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("start"))
    first = lines.where("start = 0").withColumn("line", F.monotonically_increasing_id())
    headers = stage(first.groupBy("file").agg(F.min_by("value", "line").alias("header")))
    with spark_case_sensitive(spark):
        parts = []
        for (header,) in headers.select("header").distinct().orderBy("header").collect():
            names = next(csv.reader([header.lstrip("\ufeff")]))
            schema = ", ".join(f"`{name.strip().replace('`', '')}` STRING" for name in names)
            own = lines.join(headers.where(c("header") == header), "file").where(c("value") != header)
            parts.append(from_table(own.select(F.from_csv("value", F.lit(schema)).alias("_row")).select("_row.*"), symbol, source))
        out = parts[0] if parts else spark.createDataFrame([], BAR_SCHEMA)
        for more in parts[1:]:
            out = out.unionByName(more)
        return out


class spark_case_sensitive:  # noqa: N801 - used as a statement
    """Case-sensitive column names while a file with 'Open' or 'open' is resolved."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get("spark.sql.caseSensitive")
        self.spark.conf.set("spark.sql.caseSensitive", "true")

    def __exit__(self, *exc: object) -> None:
        self.spark.conf.set("spark.sql.caseSensitive", self.before)


def read_exchange_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    return read_csv(spark, path, symbol, "nse_historical")


def read_labelled_sentences(spark: SparkSession, path: str, text: str = "sentence", label: str = "label") -> DataFrame:
    """Labelled sentences as sentiment events."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return label_events(raw, text, label)


def label_events(raw: DataFrame, text: str, label: str) -> DataFrame:
    lowered = F.lower(F.trim(F.col(label).cast("string")))
    sentiment = (
        F.when(lowered.isin("positive", "bullish", "1"), "bullish")
        .when(lowered.isin("negative", "bearish", "-1"), "bearish").otherwise("neutral"))
    return raw.select(
        F.col(text).alias("text"), sentiment.alias("sentiment"), F.lit("financial_phrasebank").alias("source"))


def _json(path: str) -> Column:
    return F.get_json_object("payload", f"$.{path}").try_cast("double")


def quotes_to_bars(quotes: DataFrame, skip_zero: bool = True) -> DataFrame:
    """Quote JSON (symbol, ts, payload) to one-row bars.

    ``skip_zero`` treats 0 as missing along the fallback chains (platform reading); the
    other reading takes the first present value and the pre-open buy quantity as volume.
    """
    if skip_zero:
        last = F.coalesce(first_nonzero(_json("priceInfo.lastPrice"), _json("priceInfo.close")), F.lit(0.0))
        open_ = F.coalesce(first_nonzero(_json("priceInfo.open")), last)
        high = F.coalesce(first_nonzero(_json("priceInfo.intraDayHighLow.max"), _json("priceInfo.intraDayHigh")), last)
        low = F.coalesce(first_nonzero(_json("priceInfo.intraDayHighLow.min"), _json("priceInfo.intraDayLow")), last)
        volume = first_nonzero(
            _json("marketDeptOrderBook.totalTradedVolume"), _json("preOpenMarket.totalTradedVolume"))
        source = "NSEPython"
    else:
        last = F.coalesce(_json("priceInfo.lastPrice"), F.lit(0.0))
        open_ = F.coalesce(_json("priceInfo.open"), last)
        high = F.coalesce(_json("priceInfo.intraDayHighLow.max"), last)
        low = F.coalesce(_json("priceInfo.intraDayHighLow.min"), last)
        volume = _json("preOpenMarket.totalBuyQuantity")
        source = "nsepython"
    return quotes.select(
        F.upper("symbol").alias("symbol"), "ts", open_.alias("open"), high.alias("high"), low.alias("low"),
        last.alias("close"), F.coalesce(volume, F.lit(0.0)).alias("volume"), F.lit(source).alias("source"))
