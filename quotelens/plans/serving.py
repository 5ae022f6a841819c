"""Final training, saved models and batch scoring."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens import schema as S
from quotelens.operators import metrics, scoring, selection
from quotelens.operators.encoding import CategoryEncoder
from quotelens.plans.features import feature_table
from quotelens.plans.models import LABEL, Candidate, Fitted, fit, predictions
from quotelens.session import materialise


def calibrate(frame: DataFrame, candidate: Candidate, registry: S.FeatureRegistry) -> tuple[DataFrame, DataFrame]:
    """Fit on train, score validation: (interval calibration, clip decision), one row each."""
    train, validation = frame.where("split = 'train'"), frame.where("split = 'validation'")
    scored = fit(candidate, train, registry).predict(validation).withColumn("actual", F.col(LABEL))
    return selection.conformal_calibrate(scored), selection.clip_decision(scored)


def serving_rules(calibration: DataFrame, clip: DataFrame, candidate: Candidate, strategy: str = "global") -> scoring.ServingRules:
    """The two one-row decisions as plain values."""
    interval, decision = calibration.head(), clip.head()
    return scoring.ServingRules(
        radius=interval["absolute_residual_quantile"],
        clipping=bool(decision["clipping_enabled"]),
        coverage=interval["nominal_coverage"],
        model_name=candidate.name,
        strategy=strategy,
    )


def train_final(frame: DataFrame, candidate: Candidate, registry: S.FeatureRegistry) -> tuple[Fitted, DataFrame, DataFrame]:
    """Fit on train and validation, score test once: (model, test metrics, test predictions)."""
    fitted = fit(candidate, frame.where("split <> 'test'"), registry)
    test = predictions(fitted, frame.where("split = 'test'"))
    return fitted, metrics.regression_metrics(test), test


def train_segmented(
    frame: DataFrame, candidates: Mapping[str, Candidate], registry: S.FeatureRegistry
) -> tuple[dict[str, Fitted], DataFrame]:
    """One final model per segment and their test predictions; raises if a test row is left without one."""
    models, scored = {}, []
    for segment, candidate in candidates.items():
        part = frame.where(F.col("segment") == segment)
        models[segment] = fit(candidate, part.where("split <> 'test'"), registry)
        scored.append(predictions(models[segment], part.where("split = 'test'")).withColumn("segment", F.lit(segment)))
    done = reduce(DataFrame.unionByName, scored)
    missed = unscored_rows(done, frame.where("split = 'test'")).head()
    if missed is not None:
        raise ValueError(f"no model scores {S.ID} {missed[S.ID]}: every segment needs a candidate")
    return models, done


def unscored_rows(scored: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows a router left without a prediction; must be empty."""
    done = scored.where(F.col("prediction").isNotNull()).select(S.ID)
    return expected.select(S.ID).join(done, S.ID, "left_anti")


def save_model(fitted: Fitted, path: str, rules: scoring.ServingRules) -> None:
    """Everything ``predict`` needs: pipeline, encoder table or group table, and one row of metadata."""
    spark, encoder = fitted.spark, fitted.encoder
    if fitted.model is not None:
        fitted.model.write().overwrite().save(f"{path}/pipeline")
    if encoder is not None:
        encoder.table.write.mode("overwrite").parquet(f"{path}/encoder")
    if fitted.groups is not None:
        fitted.groups.write.mode("overwrite").parquet(f"{path}/groups")
    about = {
        "rules": vars(rules),
        "candidate": vars(fitted.candidate),
        "encoder": {"columns": encoder.columns, "encoding": encoder.encoding, "fillers": encoder.fillers} if encoder else None,
        "has": {"model": fitted.model is not None, "groups": fitted.groups is not None},
        "overall": fitted.overall,
    }
    spark.createDataFrame([(json.dumps(about),)], "metadata string").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[Fitted, scoring.ServingRules]:
    about = json.loads(spark.read.schema("metadata string").json(f"{path}/metadata").head()["metadata"])
    candidate = Candidate(**{**about["candidate"], "keys": tuple(about["candidate"]["keys"])})
    coding = about["encoder"]
    encoder = coding and CategoryEncoder(tuple(coding["columns"]), coding["encoding"], spark.read.parquet(f"{path}/encoder"), coding["fillers"])
    fitted = Fitted(
        candidate,
        spark,
        PipelineModel.load(f"{path}/pipeline") if about["has"]["model"] else None,
        encoder,
        spark.read.parquet(f"{path}/groups") if about["has"]["groups"] else None,
        about["overall"],
    )
    return fitted, scoring.ServingRules(**about["rules"])


def evaluate_saved(spark: SparkSession, path: str, frame: DataFrame) -> DataFrame:
    """Unclipped test metrics of a saved model."""
    fitted, _ = load_model(spark, path)
    return metrics.regression_metrics(predictions(fitted, frame.where("split = 'test'")))


class RefusedError(ValueError):
    """A batch with requests that must not be answered."""


def score_batch(
    requests: DataFrame,
    series: DataFrame,
    dimension: DataFrame,
    models: Fitted | Mapping[str, Fitted],
    rules: scoring.ServingRules,
    ranges: DataFrame,
    registry: S.FeatureRegistry,
    *,
    products: DataFrame | None = None,
    history: DataFrame | None = None,
    order: str = "request_ord",
    atomic: bool = False,
) -> DataFrame:
    """Answer the output of ``request_contract``: one row per request, keyed on ``request_ord``.

    A request is refused, with its ``reasons`` and without any figures, when it breaks the contract,
    names a member or product that is not known, has a member without history or with history that
    is too old, or when no model serves its basket type. With ``atomic`` one refused request
    refuses the batch. The rest go through features, routing, clipping, interval and range flags
    in one plan. ``products`` lists the accepted product types (default: those of ``ranges``).
    """
    if products is None:
        products = ranges.select(F.explode("accepted_product_types").alias("product_type"))
    # Features and history join on the quote id, which a request need not have: its number serves.
    keyed = requests.withColumn(S.ID, F.col(order))
    broken = keyed["reasons"] if "reasons" in requests.columns else F.array().cast("array<string>")
    keyed = keyed.withColumn("_contract", broken).drop("reasons")
    covered = scoring.coverage_check(keyed, series, dimension, products)
    unrouted = F.lit(False) if not isinstance(models, Mapping) else ~F.coalesce(F.col("basket_type").isin(*models), F.lit(False))
    reasons = F.array_compact(F.concat("_contract", "reasons", F.array(F.when(unrouted, F.lit("no_model")))))
    judged = materialise(covered.withColumn("reasons", reasons).drop("_contract"))
    if atomic:
        bad = judged.where(F.size("reasons") > 0).orderBy(order).head()
        if bad is not None:
            raise RefusedError(f"request {bad[order]} refused: {bad['reasons']}")
    accepted = judged.where(F.size("reasons") == 0)
    features = feature_table(
        accepted.select(*keyed.drop("_contract").columns), series, dimension, registry=registry, include_target=False, history=history
    ).withColumn(LABEL, F.lit(None).cast("double"))
    if isinstance(models, Mapping):
        routed = [fitted.predict(features.where(F.col("basket_type") == segment)) for segment, fitted in models.items()]
        predicted = reduce(DataFrame.unionByName, routed)
    else:
        predicted = models.predict(features)
    joined = accepted.join(predicted.select(S.ID, "prediction"), S.ID, "left")
    flagged = scoring.ood_flags(joined, ranges)
    done = scoring.score_postprocess(flagged, radius=rules.radius, clipping=rules.clipping)
    answered = done.select(
        order,
        "predicted_avg_duration_months",
        F.lit(rules.model_version).alias("model_version"),
        F.lit(rules.model_name).alias("model_name"),
        F.lit(rules.strategy).alias("serving_strategy"),
        "prediction_interval_lower_months",
        "prediction_interval_upper_months",
        F.lit(rules.coverage).alias("interval_nominal_coverage"),
        "out_of_distribution",
        "warnings",
    )
    return judged.select(order, "reasons", "market_data_as_of", "max_market_data_age_days").join(answered, order, "left")
