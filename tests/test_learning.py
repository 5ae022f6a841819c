"""Invariants of the learners on a table with a known relation."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotelens import schema as S
from quotelens.operators import scoring
from quotelens.plans import experiments, serving
from quotelens.plans.models import Candidate, evaluate, fit
from quotelens.session import materialise

RIDGE = Candidate("ridge", "ridge", "contractual", "onehot", {"alpha": 1.0})


@pytest.fixture(scope="module")
def registry():
    return S.FeatureRegistry(("AAA",))


@pytest.fixture(scope="module")
def frame(spark, registry):
    rng = np.random.default_rng(11)
    numeric, _ = registry.select_block("contractual")
    cols = {c: F.rand(seed=i) for i, c in enumerate(numeric)}
    rows = spark.range(400).select(F.col("id").alias("rfq_id"), *[e.alias(c) for c, e in cols.items()])
    rows = rows.withColumn("observation_frequency_clean", F.when(F.col("rfq_id") % 2 == 0, "1m").otherwise("3m"))
    rows = rows.withColumn("split", F.when(F.col("rfq_id") < 250, "train").when(F.col("rfq_id") < 325, "validation").otherwise("test"))
    rows = rows.withColumn("target", 3 * F.col(numeric[0]) - 2 * F.col(numeric[1]) + (F.col("rfq_id") % 2) * 4.0)
    return materialise(rows.withColumn("segment", F.lit("single")))


def test_fitted_models_beat_the_constant(frame, registry):
    grid = [Candidate("mean", "constant", params={"strategy": "mean"}), RIDGE, Candidate("boosted", "boosted", "contractual", "native", {"maxIter": 5, "maxDepth": 3})]
    table, scored = experiments.holdout(frame, grid, registry)
    mae = {r["model_name"]: r["validation_mae"] for r in table.collect()}
    assert mae["ridge"] < 0.2 < mae["mean"] and mae["boosted"] < mae["mean"]
    assert scored.groupBy("model_name").count().where("count <> 75").count() == 0


def test_unknown_category_is_scored(frame, registry):
    fitted = fit(RIDGE, frame.where("split = 'train'"), registry)
    odd = frame.where("split = 'test'").withColumn("observation_frequency_clean", F.lit("never seen"))
    assert fitted.predict(odd).where("prediction is null").count() == 0


def test_permutation_importance_ranks_the_driver_first(frame, registry):
    fitted = fit(RIDGE, frame.where("split = 'train'"), registry)
    rows = experiments.permutation_importance(fitted, frame.where("split = 'test'"), registry, repeats=2).orderBy(F.desc("importance_mean")).collect()
    assert rows[0]["feature"] == "observation_frequency_clean" and rows[-1]["importance_mean"] < 0.05


def test_attributions_add_up_to_the_prediction(frame, registry):
    fitted = fit(RIDGE, frame.where("split = 'train'"), registry)
    rows = frame.where("split = 'validation'")
    phi = experiments.attribution(fitted, rows, frame.where("split = 'train'"), registry, max_rows=10, background_rows=1, permutations=2)
    total = phi.groupBy("rfq_id").agg(F.sum("phi").alias("phi"))
    gap = fitted.predict(rows).join(total, "rfq_id").select((F.col("prediction") - F.col("phi")).alias("base")).toPandas()["base"]
    assert len(gap) == 10 and gap.std() == pytest.approx(0.0, abs=1e-9)


def test_tuning_is_seeded(frame, registry):
    first, second = (
        sorted(r["params"] for r in experiments.tune(frame, [RIDGE], registry, trials=2).collect()) for _ in range(2)
    )
    assert first == second and len(set(first)) == 2


def test_saved_model_scores_like_the_fitted_one(spark, frame, registry, tmp_path):
    fitted, metrics, _ = serving.train_final(frame, RIDGE, registry)
    serving.save_model(fitted, str(tmp_path / "model"), scoring.ServingRules(radius=1.0, clipping=False))
    assert serving.evaluate_saved(spark, str(tmp_path / "model"), frame).head()["mae"] == pytest.approx(metrics.head()["mae"])
    assert serving.load_model(spark, str(tmp_path / "model"))[1].radius == 1.0


def test_router_scores_every_row(frame, registry):
    models, scored = serving.train_segmented(frame, {"single": RIDGE}, registry)
    assert serving.unscored_rows(scored, frame.where("split = 'test'")).count() == 0
    assert set(models) == {"single"}


def test_batch_scores_equal_single_scores(spark, registry):
    from helpers import dimension, quotes, series

    history = series(spark, *[(f"2024-01-{d:02d}", "AAA", 0.1 + d / 100) for d in range(1, 28)])
    members = dimension(spark, ("AAA", "s", 0.2))
    rows = quotes(spark, *[{"autocall_barrier_pct": 0.8 + i / 50, "requested_date": f"2024-01-{i + 2:02d}", "start_date": "2024-02-01", "avg_duration_months": 10.0 + i} for i in range(20)])
    from quotelens.plans.features import feature_table

    train = materialise(feature_table(rows, history, members, registry=registry).withColumnRenamed(S.TARGET, "target"))
    fitted = fit(replace(RIDGE, block="contractual"), train, registry)
    ranges = scoring.request_ranges(rows, history)
    rules = scoring.ServingRules(radius=2.0, clipping=True)

    def score(part):
        asked = part.withColumn("request_ord", F.col("rfq_id"))
        return {r["request_ord"]: r for r in serving.score_batch(asked, history, members, fitted, rules, ranges, registry).collect()}

    batch, single = score(rows), score(rows.where("rfq_id = 'r7'"))
    assert len(batch) == 20 and batch["r7"]["predicted_avg_duration_months"] == single["r7"]["predicted_avg_duration_months"]
    for r in batch.values():
        assert r["prediction_interval_lower_months"] <= r["predicted_avg_duration_months"] <= r["prediction_interval_upper_months"]
        assert r["max_market_data_age_days"] == 0 and r["reasons"] == []

    odd = rows.withColumn("underlyings", F.when(F.col("rfq_id") == "r3", "ZZZ").otherwise(F.col("underlyings")))
    odd = odd.withColumn("requested_date", F.when(F.col("rfq_id") == "r4", F.lit("2026-01-01").cast("date")).otherwise(F.col("requested_date")))
    refused = score(odd)
    assert refused["r3"]["reasons"] == ["unknown_member", "no_history"] and refused["r3"]["predicted_avg_duration_months"] is None
    assert refused["r4"]["reasons"] == ["stale_history"] and refused["r5"]["predicted_avg_duration_months"] is not None
    numbered = odd.withColumn("request_ord", F.col("rfq_id"))
    with pytest.raises(serving.RefusedError):
        serving.score_batch(numbered, history, members, fitted, rules, ranges, registry, atomic=True)
    routed = serving.score_batch(numbered, history, members, {"worst_of": fitted}, rules, ranges, registry)
    assert routed.where("request_ord = 'r7'").head()["reasons"] == ["no_model"]


def test_every_label_keeps_its_own_code(spark):
    from quotelens.operators.encoding import fit_encoder

    rows = spark.range(12000).select((F.col("id") % 6000).cast("string").alias("label"), (F.col("id") % 7).cast("double").alias("target"))
    for encoding in ("ordinal", "native"):
        encoder = fit_encoder(rows, ["label"], encoding, "target")
        coded = encoder.encode(rows)
        assert coded.select("code_label").distinct().count() == 6000
        assert coded.agg(F.max("code_label")).head()[0] == 5999.0
    few = fit_encoder(rows.unionByName(rows.where("label < '1'")), ["label"], "onehot", "target")
    assert few.table.count() == 0 and few.encode(rows).where("code_label <> 0").isEmpty()


def test_baselines_are_saved_and_loaded(spark, frame, registry, tmp_path):
    rows = frame.where("split = 'test'")
    for candidate in (Candidate("mean", "constant", params={"strategy": "mean"}), Candidate("median", "group_median", keys=("observation_frequency_clean",))):
        fitted = fit(candidate, frame.where("split = 'train'"), registry)
        path = str(tmp_path / candidate.name)
        serving.save_model(fitted, path, scoring.ServingRules(radius=1.0, clipping=False))
        loaded, _ = serving.load_model(spark, path)
        one, two = (f.predict(rows).select("rfq_id", "prediction").orderBy("rfq_id").collect() for f in (fitted, loaded))
        assert one == two and all(r["prediction"] is not None for r in one)


def test_router_refuses_to_lose_rows(frame, registry):
    with pytest.raises(ValueError, match="no model scores"):
        serving.train_segmented(frame.withColumn("segment", F.when(F.col("rfq_id") % 5 == 0, "other").otherwise(F.col("segment"))), {"single": RIDGE}, registry)


def test_registered_grids_are_whole(monkeypatch):
    from unittest.mock import MagicMock

    from quotelens.catalog import learning
    from quotelens.plans.models import SEGMENT_BLOCKS, default_candidates

    held, rolled, parts, tuned = MagicMock(return_value=(MagicMock(), None)), MagicMock(), MagicMock(), MagicMock()
    for name, mock in (("holdout", held), ("rolling", rolled), ("segmented_rolling", parts), ("tune", tuned)):
        monkeypatch.setattr(learning.experiments, name, mock)
    for build in (learning.benchmark_holdout, learning.benchmark_rolling, learning.benchmark_segmented_rolling, learning.tune):
        build(MagicMock())
    baselines = [c for c in default_candidates() if c.family in ("constant", "group_median")]
    assert rolled.call_args.args[1] == held.call_args.args[1] == [*baselines, learning.RIDGE, learning.RIDGE_ORDINAL, learning.FOREST]
    assert {s: [c.block for c in grid] for s, grid in parts.call_args.args[1].items()} == {s: list(names) for s, names in SEGMENT_BLOCKS.items()}
    assert "trials" not in tuned.call_args.kwargs
