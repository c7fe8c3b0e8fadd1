"""Price bars that several tests build."""

from __future__ import annotations

from datetime import datetime, timedelta

BAR_SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def minute_bars(spark, symbol, changes, spread, count=80):
    rows, price = [], 1500.0
    for i in range(count):
        start = price
        price += changes[i % len(changes)]
        rows.append((symbol, datetime(2026, 1, 1, 9) + timedelta(minutes=i), start, max(start, price) + spread,
                     min(start, price) - spread, price, 150000.0 + i))
    return spark.createDataFrame(rows, BAR_SCHEMA)
