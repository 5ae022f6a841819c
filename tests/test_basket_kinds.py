"""Baskets are described once per text and date, with the values of a grouping by quote."""

import pytest
from pyspark.sql import functions as F

from quotelens.operators import baskets

HISTORY = ", ".join(f"{c} double" for c in baskets.HISTORY_COLUMNS)


@pytest.fixture(scope="module")
def market(spark):
    history = spark.createDataFrame([(u, f"2020-01-0{d}", *[float(d * k) for k in range(1, 7)]) for u, d in (("A", 1), ("A", 3), ("B", 2))], f"underlying string, date string, {HISTORY}")
    dimension = spark.createDataFrame([("A", "x", 0.2), ("B", "y", 0.3), ("C", "y", 0.1)], "underlying string, sector string, structural_base_vol double")
    return history.withColumn("date", F.to_date("date")), dimension


def _quotes(spark, rows):
    return spark.createDataFrame(rows, "rfq_id long, underlyings string, requested_date string").withColumn("requested_date", F.to_date("requested_date"))


def test_aggregates_equal_those_grouped_by_quote(spark, market):
    rows = [(1, "A|B", "2020-01-02"), (2, "A|B", "2020-01-02"), (3, "B|C", "2020-01-04"), (4, None, "2020-01-04"), (5, "A", None), (6, "C", "2020-01-01")]
    rows += [(None, "A|B", "2020-01-02"), (7, "A|B", "2020-01-03"), (7, "A|B", "2020-01-03"), (8, "A", "2020-01-03"), (8, "B|C", "2020-01-04")]
    quotes = _quotes(spark, rows)
    plain = quotes.join(baskets.aggregate_members(baskets.member_rows(quotes, *market)), "rfq_id", "left")
    done = baskets.with_aggregates(quotes, *market)
    assert sorted(map(str, done.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_members_are_expanded_once_per_text_and_date(spark, market, monkeypatch):
    expanded = []
    whole = baskets.member_rows
    monkeypatch.setattr(baskets, "member_rows", lambda quotes, *rest: expanded.append(quotes.count()) or whole(quotes, *rest))
    baskets.with_aggregates(_quotes(spark, [(i, "A|B", "2020-01-02") for i in range(50)]), *market)
    assert expanded == [1]
