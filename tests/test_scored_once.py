"""F1, F4: metrics read predictions twice, so a learner's are stored instead of scored again."""

import pytest
from pyspark.sql import functions as F

from quotelens import schema as S
from quotelens.plans import experiments, models
from quotelens.plans.models import Candidate
from quotelens.session import materialise

REGISTRY = S.FeatureRegistry(("AAA",))
GRID = [
    Candidate("mean", "constant", params={"strategy": "mean"}),
    Candidate("ridge", "ridge", "contractual", "onehot", {"alpha": 1.0}),
    Candidate("forest", "forest", "contractual", "onehot", {"numTrees": 3, "maxDepth": 2}),
]


@pytest.fixture(scope="module")
def frame(spark):
    numeric, _ = REGISTRY.select_block("contractual")
    rows = spark.range(120).select(F.col("id").alias("rfq_id"), *[F.rand(seed=i).alias(c) for i, c in enumerate(numeric)])
    rows = rows.withColumn("observation_frequency_clean", F.when(F.col("rfq_id") % 2 == 0, "1m").otherwise("3m"))
    rows = rows.withColumn("split", F.when(F.col("rfq_id") < 80, "train").otherwise("validation"))
    rows = rows.withColumn("requested_year", (F.col("rfq_id") / 40).cast("int") + 2000)
    return materialise(rows.withColumn("target", 3 * F.col(numeric[0])))


@pytest.mark.parametrize("loop", ["holdout", "rolling"])
def test_no_row_is_scored_for_each_metric(frame, monkeypatch, loop):
    measured, plain = [], models.regression_metrics

    def metrics(rows, *keys):
        measured.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return plain(rows, *keys)

    monkeypatch.setattr(models, "regression_metrics", metrics)
    if loop == "holdout":
        table = experiments.holdout(frame, GRID, REGISTRY)[0]
    else:
        table = experiments.rolling(frame, GRID, REGISTRY, S.SplitYears(train_end=2001, validation=2002, test_start=2003))
    assert {r["model_name"] for r in table.collect()} == {"mean", "ridge", "forest"}
    assert measured and not any("Python" in plan or "InArrow" in plan for plan in measured)
