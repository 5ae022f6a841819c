"""Extremely random trees: exact sums against brute force, random thresholds, bounds, saving."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quotelens.plans import trees as T

COMMON = {"features": "features", "label": "target", "trees": 12, "min_leaf": 5, "share": 0.8, "max_depth": 6, "seed": 7}


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(600).select("id", *[F.rand(seed=i).alias(f"x{i}") for i in range(3)], (F.col("id") % 3 == 0).cast("double").alias("x3"))
    rows = rows.withColumn("target", 4 * F.col("x0") + 2 * F.col("x3") + F.sin(6 * F.col("x1")))
    rows = VectorAssembler(inputCols=["x0", "x1", "x2", "x3"], outputCol="features").transform(rows)
    return T.materialise(rows)


def _arrays(table):
    frame = table.toPandas()
    return frame[["x0", "x1", "x2", "x3"]].to_numpy(), frame["target"].to_numpy()


def test_nodes_hold_the_means_and_best_drawn_splits_of_their_rows(table, monkeypatch):
    monkeypatch.setattr(T, "CELLS", 40)
    grown = T.grow(table, **{**COMMON, "trees": 3})
    x, y = _arrays(table)
    inside = {root: np.arange(len(x)) for root in range(3)}
    splits = 0
    for node in range(len(grown.feature)):
        # Children follow their parents, so a node's rows are known when it is met.
        rows = inside[node]
        assert grown.value[node] == pytest.approx(y[rows].mean(), abs=1e-9)
        f = grown.feature[node]
        if f < 0:
            continue
        splits += 1
        values, cut = x[rows, f], grown.threshold[node]
        assert values.min() <= cut < values.max()
        inside[grown.left[node]], inside[grown.right[node]] = rows[values <= cut], rows[values > cut]
        assert min((values <= cut).sum(), (values > cut).sum()) >= 5
    assert splits > 30
    for root in range(3):
        ends = grown.leaves(x, root)
        assert all((grown.feature[ends] == -1).tolist())
        assert all(i in inside[e] for i, e in list(enumerate(ends))[::17])


def test_thresholds_are_random_and_uniform_between_the_ends(table):
    grown = T.grow(table, **{**COMMON, "trees": 400, "max_depth": 1, "share": 1.0})
    chosen = grown.threshold[:400][grown.feature[:400] == 0]
    # The best split of x0 is near one half for all trees; random ones spread.
    assert len(set(chosen.tolist())) == len(chosen) > 20 and chosen.std() > 0.03
    alone = VectorAssembler(inputCols=["x2"], outputCol="one").transform(table)
    few = T.grow(alone, **{**COMMON, "features": "one", "trees": 400, "max_depth": 1, "min_leaf": 1})
    cuts = np.sort(few.threshold[:400])
    gap = np.abs(cuts - np.arange(400) / 400).max()
    assert gap < 1.95 / np.sqrt(400)


def test_batches_and_partitions_do_not_change_a_tree(table):
    first, second = T.grow(table.repartition(5), **COMMON), T.grow(table.coalesce(1), **COMMON)
    for a, b in zip(first[1:], second[1:]):
        assert np.array_equal(a, b)


def test_error_falls_below_the_constant_and_a_saved_model_answers_alike(spark, table, tmp_path):
    stage = T.RandomTrees(featuresCol="features", labelCol="target", predictionCol="prediction", seed=3, numTrees=30)
    fitted = Pipeline(stages=[stage]).fit(table.where("id < 450"))
    fitted.write().overwrite().save(str(tmp_path / "model"))
    rest = table.where("id >= 450")
    again = PipelineModel.load(str(tmp_path / "model")).transform(rest).orderBy("id").toPandas()
    frame = fitted.transform(rest).orderBy("id").toPandas()
    assert np.array_equal(frame["prediction"], again["prediction"])
    error, plain = (frame["target"] - frame["prediction"]).abs().mean(), (frame["target"] - frame["target"].mean()).abs().mean()
    assert error < 0.45 * plain


def test_odd_tables(spark, table):
    with pytest.raises(ValueError):
        T.grow(table.where("false"), **COMMON)
    one = T.grow(table.limit(1), **COMMON)
    assert len(one.feature) == 12 and set(one.feature) == {-1}
    same = T.grow(table.withColumn("target", F.lit(2.5)), **COMMON)
    assert len(same.feature) == 12 and np.allclose(same.value, 2.5)
    some = T.grow(table.withColumn("target", F.when(F.col("id") < 100, F.col("target"))), **COMMON)
    assert some.value[0] == pytest.approx(table.where("id < 100").agg(F.avg("target")).head()[0])
