import math

import numpy as np
from pyspark.sql import functions as F

from quotelens.operators import association, drift, selection
from quotelens.operators.wide import pearson, wide_counts, wide_moments


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def sample(spark):
    rows = [
        ("single", "train" if i % 3 else "validation", None if i % 7 == 0 else 1e6 + (i % 11) / 8, float("nan") if i == 40 else float(i % 5), None, None if i % 13 == 0 else float(i))
        for i in range(120)
    ]
    return spark.createDataFrame([*rows, (None, "test", -0.0, 1.0, None, 2.0), (None, "test", 0.0, 1.0, None, 3.0)], "segment string, split string, a double, b double, c double, target double")


def test_counts_and_moments_agree_with_rows_made_long(spark):
    frame, columns = sample(spark).repartition(5), ["a", "b", "c"]
    long = drift.long_numeric(frame, ["segment", "split", "target"], columns)
    keys = ["segment", "split", "feature"]
    shown = lambda rows: sorted(map(str, rows))
    counted = long.where("value is not null").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    assert shown(wide_counts(frame, keys[:2], columns).collect()) == shown(counted.collect())
    wanted = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("v"),
        F.min("value").alias("low"), F.max("value").alias("high"), association.pearson_terms(F.col("value"), F.col("target")).alias("r"),
    )
    some = lambda c: F.when(F.col("n") > 0, F.col(c))
    got = wide_moments(frame, keys[:2], columns, "target").select(*keys, "rows", "n", some("mean"), some("m2") / F.col("n"), "low", "high", pearson())
    for a, b in zip(sorted(got.collect(), key=lambda r: str(r[:3])), sorted(wanted.collect(), key=lambda r: str(r[:3])), strict=True):
        assert a[:5] == b[:5]
        for x, y in zip(a[5:], b[5:]):
            assert x == y or math.isnan(x) and math.isnan(y) or abs(x - y) <= 1e-6 * max(1, abs(y)), (a, b)


def test_drift_and_correlations_make_no_row_per_feature(spark):
    """F8, F12, F14."""
    frame = sample(spark)
    assert "Generate" not in plan(drift.feature_drift(frame, ["a", "b", "c"]))
    assert "Generate" not in plan(association.target_correlations(frame, ["a", "b", "c"], "target"))


def test_bootstrap_weights_are_those_of_the_digest(spark):
    """no row per (row, replicate), the same weights as Spark's own digest gives."""
    pairs = spark.range(900).select(F.col("id").alias("rfq_id"), (F.rand(3) * 9).alias("error_global"), F.when(F.col("id") % 50 > 0, F.rand(4) * 9).alias("error_segmented"))
    pairs = pairs.unionByName(spark.createDataFrame([(None, 1.0, 4.0)], "rfq_id bigint, error_global double, error_segmented double")).localCheckpoint()
    drawn = pairs.select((F.col("error_global") - F.col("error_segmented")).alias("d"), "rfq_id", F.explode(F.sequence(F.lit(0), F.lit(299))).alias("replicate"))
    bits = F.xxhash64(F.lit(42), F.col("rfq_id").cast("string"), F.col("replicate"))
    weight = selection.poisson_weight(F.pmod(bits, F.lit(1 << 53)).cast("double") / float(1 << 53))
    plain = drawn.groupBy("replicate").agg((F.sum(weight * F.col("d")) / F.sum(weight)).alias("x")).toPandas()["x"]
    got = selection.bootstrap_rows(pairs, replicates=300, seed=42)
    assert np.allclose(got.select("ci_95_low", "ci_95_high").head(), np.quantile(plain, [0.025, 0.975]), rtol=0, atol=1e-12)
    assert "Generate" not in plan(got)
    assert selection.bootstrap_rows(pairs.where("rfq_id < 0"), replicates=10).head()["ci_95_low"] is None
