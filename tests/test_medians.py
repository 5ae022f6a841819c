"""Exact medians by counting and narrowing."""

import numpy as np
from pyspark.sql import functions as F

from quotelens.operators.ordered import lower_medians
from quotelens.plans.models import number_stages


def test_medians_are_exact_and_no_column_is_kept_whole(spark):
    generator = np.random.default_rng(3)
    near = 100 + generator.random(501) * 1e-9
    columns = {"near": near, "wide": generator.standard_normal(501) * 10.0 ** generator.integers(-12, 12, 501), "ties": generator.integers(0, 3, 501) * 1.0}
    rows = [(*map(float, row), None, float("nan") if i % 2 else float(i)) for i, row in enumerate(zip(*columns.values()))]
    frame = spark.createDataFrame(rows, "near double, wide double, ties double, nothing double, odd double")
    expected = {c: np.sort(v)[250] for c, v in columns.items()} | {"odd": 250.0}
    assert lower_medians(frame, ["near", "wide", "ties", "nothing", "odd"]) == expected
    even = frame.limit(0).unionByName(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (9.0,)], "near double"), allowMissingColumns=True)
    assert lower_medians(even, ["near"]) == {"near": 2.0}
    stage = number_stages(["ties"], False)[1]
    filled = stage.fit(frame.select(F.col("ties").alias("num_ties"))).transform(spark.createDataFrame([(None,), (7.0,)], "num_ties double"))
    assert [r["imp_ties"] for r in filled.collect()] == [expected["ties"], 7.0]
