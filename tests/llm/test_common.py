"""Joins that keep hot keys in place, and tables dealt out by row number."""

import pytest

from quotelens.llm import common


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("limit", [common.BROADCAST_ROWS, 0])
def test_hot_join_equals_a_plain_join(spark, monkeypatch, how, limit):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    left = spark.createDataFrame([("hot", i) for i in range(20)] + [("cold", 1), ("cold", 2), ("alone", 3), (None, 4)], "key string, v int")
    right = spark.createDataFrame([("hot", 20, "h"), ("cold", 2, "c"), ("absent", 9, "a")], "key string, n long, w string")
    rows = lambda frame: sorted(map(str, frame.select("key", "v", "n", "w").collect()))
    assert rows(common.hot_join(left, right, "key", "n", how)) == rows(left.join(right, "key", how))


def test_dealt_rows_are_whole_and_equal_ones_spread(spark):
    frame = spark.range(500).selectExpr("1 AS a", "'same' AS b")
    table = common.dealt(frame, 8)
    sizes = [r["count"] for r in table.groupBy("chunk").count().collect()]
    assert sum(sizes) == 500 and len(sizes) == 8 and max(sizes) < 150
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("llm_chunks")]
