"""Permutation importance from swapped shares and trees equals scoring every swapped row."""

import pytest
from pyspark.sql import functions as F

from quotelens import schema as S
from quotelens.operators.metrics import absolute_error
from quotelens.plans import experiments
from quotelens.plans.models import Candidate, fit
from quotelens.session import materialise

FOREST = {"numTrees": 8, "minInstancesPerNode": 4, "maxDepth": 5}


@pytest.fixture(scope="module")
def registry():
    return S.FeatureRegistry(("AAA",))


@pytest.fixture(scope="module")
def frame(spark, registry):
    numeric, _ = registry.select_block("contractual")
    rows = spark.range(160).select(F.col("id").alias("rfq_id"), *[F.rand(seed=i).alias(c) for i, c in enumerate(numeric)])
    # A missing number and a category that the test rows alone have.
    rows = rows.withColumn(numeric[2], F.when(F.col("rfq_id") % 7 > 0, F.col(numeric[2])))
    known = F.when(F.col("rfq_id") % 2 == 0, "1m").otherwise("3m")
    rows = rows.withColumn("observation_frequency_clean", F.when(F.col("rfq_id") > 150, "never seen").otherwise(known))
    return materialise(rows.withColumn("target", 3 * F.col(numeric[0]) - F.col(numeric[1]) ** 2 + (F.col("rfq_id") % 2) * 4.0))


@pytest.mark.parametrize("family, encoding, params", [("ridge", "onehot", {"alpha": 1.0}), ("ridge", "ordinal", {"alpha": 1.0}), ("forest", "onehot", FOREST)])
def test_arrays_equal_rows(frame, registry, family, encoding, params):
    fitted = fit(Candidate("c", family, "contractual", encoding, params), frame.where("rfq_id < 100"), registry)
    rest = frame.where("rfq_id >= 100")
    numeric, categorical = registry.select_block("contractual")
    base = rest.select("rfq_id", "target", *numeric, *categorical)
    slow = experiments._swaps_as_rows(fitted, base, [*numeric, *categorical], 2, 5)
    expected = {(r["_feature"], r["_repeat"]): r["mae"] for r in slow.collect()}
    fast = experiments._swaps_as_arrays(fitted, base, numeric, categorical, 2, 5)
    found = {(r["_feature"], r["_repeat"]): r["mae"] for r in fast.collect()}
    assert found.keys() == expected.keys() and len(found) == 2 * len([*numeric, *categorical])
    assert found == {k: pytest.approx(v, abs=1e-9) for k, v in expected.items()}
    table = experiments.permutation_importance(fitted, rest, registry, repeats=2, seed=5).collect()
    plain = fitted.predict(rest).agg(F.avg(absolute_error("target"))).head()[0]
    for row in table:
        assert row["importance_mean"] == pytest.approx(sum(expected[row["feature"], i] for i in range(2)) / 2 - plain, abs=1e-9)
    assert max(table, key=lambda r: r["importance_mean"])["importance_mean"] > 0.1
