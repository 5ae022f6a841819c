"""Small hand-made tables."""

import datetime as dt

from quotelens import schema as S

#: A plain quote: five years, one member, executed on the day it was asked for.
BASE = {
    "rfq_id": "r1",
    "product_type": "P1",
    "underlyings": "AAA",
    "basket_type": "single",
    "autocall_barrier_pct": 0.95,
    "protection_barrier_pct": 0.55,
    "no_call_period_months": 4,
    "observation_frequency": "1M",
    "quoted_implied_vol": 0.27,
    "notional_credits": 120000.0,
    "counterparty": "bank seven",
    "trader_id": "desk two",
    "requested_date": "2024-01-12",
    "executed": True,
    "start_date": "2024-01-12",
    "end_date": "2029-01-12",
    "avg_duration_months": 31.0,
}


def day(text):
    return dt.date.fromisoformat(text) if isinstance(text, str) else text


def quotes(spark, *changes):
    rows = []
    for number, change in enumerate(changes, 1):
        row = {**BASE, "rfq_id": f"r{number}", **change}
        for name in ("requested_date", "start_date", "end_date"):
            row[name] = day(row[name])
        rows.append(tuple(row[f.name] for f in S.QUOTES.fields))
    return spark.createDataFrame(rows, S.QUOTES)


def requests(spark, *changes):
    frame = quotes(spark, *changes)
    return frame.select(*[f.name for f in S.REQUEST.fields])


def series(spark, *rows):
    return spark.createDataFrame([(day(d), u, float(v)) for d, u, v in rows], S.SERIES)


def dimension(spark, *rows):
    return spark.createDataFrame(list(rows), S.DIMENSION)
