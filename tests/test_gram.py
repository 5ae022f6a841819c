"""Ridge fits from Gram matrices against Spark's linear regression, fit by fit."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotelens import schema as S
from quotelens.plans import experiments, gram
from quotelens.plans.models import SEGMENT_BLOCKS, Candidate, evaluate_many, fit, predictions
from quotelens.session import materialise

ONEHOT = Candidate("ridge_onehot", "ridge", "contractual", "onehot", {"alpha": 2.0})
ORDINAL = Candidate("ridge_ordinal", "ridge", "contractual", "ordinal", {"alpha": 0.5})


@pytest.fixture(scope="module")
def registry():
    return S.FeatureRegistry(("AAA",))


@pytest.fixture(scope="module")
def frame(spark, registry):
    """Numbers of unlike size with gaps, a constant one, categories with rare, missing and late values."""
    numeric, text = registry.select_block("contractual")
    rows = spark.range(900).repartition(5).select(F.col("id").alias("rfq_id"))
    for i, c in enumerate(numeric):
        value = F.rand(seed=i) * 10.0 ** (i % 5) + 1000 * (i % 3)
        rows = rows.withColumn(c, F.lit(7.0) if i == 1 else F.when(F.rand(seed=100 + i) > 0.1 * (i % 3), value))
    for i, c in enumerate(text):
        label = F.concat(F.lit("v"), F.floor(F.rand(seed=200 + i) * 5).cast("string"))
        odd = F.when(F.col("rfq_id") % 211 == 0, "rare").when(F.col("rfq_id") % 13 == 0, F.lit(None)).when(F.col("rfq_id") > 850, "late")
        rows = rows.withColumn(c, F.coalesce(odd, label) if i else F.when(F.col("rfq_id") % 13 != 0, F.coalesce(odd, label)))
    rows = rows.withColumn("requested_year", (2016 + F.floor(F.col("rfq_id") / 150)).cast("int"))
    rows = rows.withColumn("segment", F.when(F.col("rfq_id") % 3 == 0, "single").otherwise("worst_of"))
    rows = rows.withColumn("split", F.when(F.col("rfq_id") < 600, "train").when(F.col("rfq_id") < 800, "validation").otherwise("test"))
    target = 3 * F.coalesce(numeric[0], F.lit(2.0)) + F.coalesce(F.col(numeric[2]), F.lit(0.0)) / 50 + (F.col("rfq_id") % 4) + F.randn(seed=5)
    return materialise(rows.withColumn("target", target))


def scored(rows):
    return {(r["model_name"], r["rfq_id"]): r["prediction"] for r in rows.collect()}


def test_equals_linear_regression(frame, registry):
    asked = F.col("requested_year")
    jobs = []
    for year in (2018, 2020):
        for segment in ("single", "worst_of"):
            inside = F.col("segment") == segment
            for c in (ONEHOT, ORDINAL):
                jobs.append((replace(c, name=f"{c.name}-{year}-{segment}"), inside & (asked < year), inside & (asked >= year), {}))
    _, rows = evaluate_many(frame, jobs, registry, ["segment", "requested_year"])
    got = scored(rows)
    count = 0
    for candidate, train, validation, _ in jobs:
        expected = scored(predictions(fit(candidate, frame.where(train), registry), frame.where(validation)))
        count += len(expected)
        for key, value in expected.items():
            # Spark iterates where a column is constant and stops a little short; the normal equations below decide.
            assert got[key] == pytest.approx(value, rel=1e-6)
    assert len(got) == count > 1000


def test_equals_the_normal_equations(frame, registry):
    """Against numpy on the imputed, standardised numbers, without Spark's estimator."""
    numeric, _ = registry.select_block("contractual")
    block = replace(ONEHOT, name="numbers", encoding="ordinal", params={"alpha": 3.0})
    data = frame.select("rfq_id", "split", "target", *numeric).toPandas().sort_values("rfq_id")
    train = data[data["split"] == "train"]
    x = train[numeric].astype(float)
    medians = x.quantile(0.5, interpolation="lower")
    grid = gram.fit_grid(frame, [(0, block, experiments.split_is("train"), experiments.split_is("validation"))], registry, ["split"])
    space = grid.space
    z = x.fillna(medians)
    mean, spread = z.mean(), z.std().replace(0, 1)
    strata = grid.strata
    assert {strata.keys[i] for i in grid.validation[0]} == {("validation",)}
    # The fit of the numbers alone, by the same training set's matrix without its categories.
    matrices = gram.gram_matrices(frame, strata, space)
    own = next(m for i, m in matrices.items() if strata.keys[i] == ("train",))
    fitted = gram.TrainingSet(space, own, medians.to_dict(), {}).ridge(*gram.TrainingSet(space, own, medians.to_dict(), {}).design(numeric, [], "onehot"), 3.0)
    scaled = ((z - mean) / spread).to_numpy()
    y = train["target"].to_numpy()
    weights = np.linalg.solve(scaled.T @ scaled + 3.0 * np.eye(len(numeric)), scaled.T @ (y - y.mean()))
    assert [fitted.weights[space.first[c]] for c in numeric] == pytest.approx(list(weights / spread.to_numpy()), rel=1e-9, abs=1e-11)


def test_one_pass_does_for_all_penalties(frame, registry):
    rows = experiments.tune(frame, [ONEHOT, ORDINAL], registry, trials=6).collect()
    assert len(rows) == 12 and len({r["validation_mae"] for r in rows}) == 12


def test_wide_grids_are_fitted_one_by_one(frame, registry, monkeypatch):
    jobs = [(c, experiments.split_is("train"), experiments.split_is("validation"), {}) for c in (ONEHOT, ORDINAL)]
    narrow = scored(evaluate_many(frame, jobs, registry, ["split"])[1])
    monkeypatch.setattr(gram, "WIDTH", 10)
    assert gram.fit_grid(frame, [(0, *jobs[0][:3])], registry, ["split"]) is None
    wide = scored(evaluate_many(frame, jobs, registry, ["split"])[1])
    assert wide.keys() == narrow.keys() and all(narrow[k] == pytest.approx(v, rel=1e-6) for k, v in wide.items())


def test_registered_grids_run_on_the_smallest_tables(spark):
    from quotelens.catalog import load

    queries = load()[0]
    folder = "/root/testdata/sf0.001"
    parts = queries["benchmark_segmented_rolling"](spark, folder).collect()
    blocks = {(r["segment"], r["feature_block"]) for r in parts}
    assert blocks == {(s, b) for s, names in SEGMENT_BLOCKS.items() for b in names}
    assert len(queries["tune"](spark, folder).collect()) == 40
