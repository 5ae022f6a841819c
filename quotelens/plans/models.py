"""Candidate regressors: baselines as joins, learners as Spark ML pipelines, with a forest of our own (``trees``)."""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, ImputerModel, OneHotEncoder, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens import schema as S
from quotelens.operators import baselines
from quotelens.operators.encoding import CategoryEncoder, fit_encoder
from quotelens.operators.metrics import regression_metrics
from quotelens.operators.ordered import exact_quantiles, lower_medians, null_safe_join
from quotelens.plans import gram
from quotelens.plans.trees import RandomTrees
from quotelens.session import materialise, scratch_folder

LABEL = "target"


@dataclass(frozen=True)
class Candidate:
    """A named model: family, feature block, encoding and hyperparameters."""

    name: str
    family: str
    block: str = "all_without_commercial"
    encoding: str = "ordinal"
    params: dict = field(default_factory=dict, hash=False)
    keys: tuple[str, ...] = ()

    def with_params(self, name: str, **params) -> Candidate:
        return replace(self, name=name, params={**self.params, **params})


def default_candidates(trees: int | None = None) -> list[Candidate]:
    """The standing grid; ``trees`` shortens every ensemble for quick runs."""
    boosted = {"maxIter": trees or 350, "maxDepth": 5, "stepSize": 0.05, "lossType": "absolute"}
    return [
        Candidate("global_mean", "constant", params={"strategy": "mean"}),
        Candidate("global_median", "constant", params={"strategy": "median"}),
        *[Candidate(name, "group_median", "all_without_commercial", keys=keys) for name, keys in S.BASELINE_KEYS.items()],
        Candidate("ridge_onehot", "ridge", encoding="onehot", params={"alpha": 5.0}),
        Candidate("ridge_ordinal", "ridge", encoding="ordinal", params={"alpha": 5.0}),
        Candidate("forest_onehot", "forest", encoding="onehot", params={"numTrees": trees or 200, "minInstancesPerNode": 8, "featureShare": 0.8}),
        Candidate("boosted_squared__all_without_commercial", "boosted", params={**boosted, "maxIter": trees or 250, "lossType": "squared"}),
        Candidate("boosted_native__all_without_commercial", "boosted", encoding="native", params={**boosted, "maxDepth": 6}),
        Candidate("boosted_ordinal__all_without_commercial", "boosted", params={**boosted, "subsamplingRate": 0.9}),
    ]


STABLE_BLOCKS = (
    "global_stable",
    "global_stable_tail",
    "global_stable_no_sector",
    "global_risk_underlying",
    "global_all_underlying",
    "global_tail_underlying",
)
SEGMENT_BLOCKS = {
    "single": ("single_core", "single_without_noise", "single_stable", "single_underlying", "single_underlying_no_sector"),
    "worst_of": ("worst_of_core", "worst_of_without_noise", "worst_of_stable", "worst_of_tail_focus", "worst_of_risk_underlying", "worst_of_tail_underlying"),
}


def stable_candidates(base: Candidate, blocks: Sequence[str] = STABLE_BLOCKS) -> list[Candidate]:
    return [replace(base, name=f"{base.name.split('__')[0]}__{block}", block=block) for block in blocks]


def _estimator(candidate: Candidate, rows: int, spread: float):
    params = dict(candidate.params)
    common = {"featuresCol": "features", "labelCol": LABEL, "predictionCol": "prediction"}
    if candidate.family == "ridge":
        # Against the usual objective, Spark's penalty is divided by the row count and counted in target deviations.
        # Constant columns send its solver to iterations, so these must go on until nothing moves.
        return LinearRegression(**common, tol=1e-10, maxIter=1000, regParam=params.get("alpha", 5.0) * spread / max(rows, 1), elasticNetParam=0.0, standardization=False)
    if candidate.family == "forest":
        return RandomTrees(**common, seed=S.SEED, **params)
    if candidate.family == "boosted":
        return GBTRegressor(**common, seed=S.SEED, **params)
    raise ValueError(f"unknown model family {candidate.family!r}")


class MedianImputer(Estimator):
    """Spark's imputer with exact lower medians, which it would get by keeping every number in one sketch per column."""

    def __init__(self, inputs: Sequence[str], outputs: Sequence[str]):
        super().__init__()
        self.inputs, self.outputs = list(inputs), list(outputs)

    def _fit(self, dataset: DataFrame) -> ImputerModel:
        medians = lower_medians(dataset, self.inputs)
        # The mean of one number is that number.
        one = dataset.sparkSession.createDataFrame([tuple(medians.get(c) for c in self.inputs)], ", ".join(f"{c} double" for c in self.inputs))
        return Imputer(inputCols=self.inputs, outputCols=self.outputs, strategy="mean").fit(one)


def number_stages(numeric: Sequence[str], scaled: bool) -> list:
    """Median-imputed numbers as one vector, standardised for linear models."""
    if not numeric:
        return []
    doubles = ", ".join(f"CAST({c} AS DOUBLE) AS num_{c}" for c in numeric)
    imputed = [f"imp_{c}" for c in numeric]
    stages = [
        SQLTransformer(statement=f"SELECT *, {doubles} FROM __THIS__"),
        MedianImputer([f"num_{c}" for c in numeric], imputed),
        VectorAssembler(inputCols=imputed, outputCol="numbers"),
    ]
    return [*stages, StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True)] if scaled else stages


def build_pipeline(candidate: Candidate, train: DataFrame, registry: S.FeatureRegistry) -> Pipeline:
    """Imputed numbers, the encoder's codes, one learner; ``train`` has been through the encoder."""
    numeric, categorical = registry.select_block(candidate.block)
    linear = candidate.family == "ridge"
    stages = number_stages(numeric, linear)
    inputs = [] if not numeric else ["scaled"] if linear else ["numbers"]
    outputs = [f"code_{c}" for c in categorical]
    if categorical and candidate.encoding == "onehot":
        hot = [f"hot_{c}" for c in categorical]
        stages.append(OneHotEncoder(inputCols=outputs, outputCols=hot, dropLast=False, handleInvalid="keep"))
        outputs = hot
    rows, spread = train.agg(F.count(LABEL), F.coalesce(F.stddev_pop(LABEL), F.lit(0.0))).head() if linear else (0, 0.0)
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*inputs, *outputs], outputCol="features"), _estimator(candidate, rows, spread)])


@dataclass
class Fitted:
    """A fitted candidate, independent of its training rows; ``predict`` adds ``prediction`` to rows that carry its features.

    Learners have an encoder and a pipeline; baselines have a stored table of group values (for
    group medians) and the overall value.
    """

    candidate: Candidate
    spark: SparkSession
    model: PipelineModel | None = None
    encoder: CategoryEncoder | None = None
    groups: DataFrame | None = None
    overall: float | None = None

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            overall = F.lit(self.overall).cast("double")
            if self.groups is None:
                return rows.withColumn("prediction", overall)
            scored = null_safe_join(rows, self.groups, list(self.candidate.keys), "left")
            return scored.withColumn("prediction", F.coalesce("_median", overall)).drop("_median")
        coded = self.encoder.encode(rows) if self.encoder else rows
        return self.model.transform(coded).select(*rows.columns, "prediction")


def fit(candidate: Candidate, train: DataFrame, registry: S.FeatureRegistry) -> Fitted:
    spark = train.sparkSession
    if candidate.family in ("constant", "group_median"):
        strategy = candidate.params.get("strategy", "median")
        overall = train.select(baselines.constant_value(train, strategy, LABEL).alias("value")).limit(1).head()
        groups = None
        if candidate.family == "group_median":
            groups = materialise(exact_quantiles(train, list(candidate.keys), LABEL, {"_median": 0.5}))
        return Fitted(candidate, spark, groups=groups, overall=overall["value"] if overall else None)
    _, categorical = registry.select_block(candidate.block)
    encoder = fit_encoder(train, categorical, candidate.encoding, LABEL) if categorical else None
    coded = encoder.encode(train) if encoder else train
    if candidate.family == "boosted":
        # Boosting cuts its lineage every few iterations where it has a folder for it.
        spark.sparkContext.setCheckpointDir(scratch_folder(spark))
    model = build_pipeline(candidate, coded, registry).fit(coded)
    return Fitted(candidate, spark, model, encoder)


def predictions(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """(model_name, rfq_id, actual, prediction) for scored rows."""
    return fitted.predict(rows).select(
        F.lit(fitted.candidate.name).alias("model_name"), S.ID, F.col(LABEL).alias("actual"), "prediction"
    )


def scores(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """Predictions for metrics, which read them twice: a learner's are stored, so that rows are scored once."""
    scored = predictions(fitted, rows)
    return scored if fitted.model is None else materialise(scored)


def describe(candidate: Candidate, metrics, registry: S.FeatureRegistry) -> dict:
    """Result row of one candidate from its metrics row."""
    numeric, categorical = registry.select_block(candidate.block)
    return {
        "model_name": candidate.name,
        "estimator_class": candidate.family,
        "feature_block": candidate.block,
        "encoding_strategy": candidate.encoding,
        "validation_mae": metrics["mae"],
        "validation_rmse": metrics["rmse"],
        "validation_r2": metrics["r2"],
        "validation_median_absolute_error": metrics["median_absolute_error"],
        "validation_rows": metrics["row_count"],
        "n_numeric_features": len(numeric),
        "n_categorical_features": len(categorical),
        "n_total_features": len(numeric) + len(categorical),
    }


def evaluate(candidate: Candidate, train: DataFrame, validation: DataFrame, registry: S.FeatureRegistry) -> tuple[dict, DataFrame]:
    """Metrics, timings and sizes of one candidate, and its validation predictions."""
    started = time.perf_counter()
    fitted = fit(candidate, train, registry)
    fit_seconds = time.perf_counter() - started
    started = time.perf_counter()
    scored = scores(fitted, validation)
    row = regression_metrics(scored).head()
    predict_seconds = time.perf_counter() - started
    timing = {
        "fit_seconds": fit_seconds,
        "validation_predict_seconds": predict_seconds,
        "validation_rows_per_second_predict": row["row_count"] / predict_seconds if predict_seconds else None,
    }
    return {**describe(candidate, row, registry), **timing}, scored


def evaluate_many(
    frame: DataFrame, jobs: Sequence[tuple[Candidate, Column, Column, dict]], registry: S.FeatureRegistry, by: Sequence[str], parallelism: int = 4, store: bool = False
) -> tuple[list[dict], DataFrame]:
    """Fit each (candidate, train condition, validation condition, labels), then score and measure all in one job.

    Conditions use the columns ``by`` only, which have few values. Ridge candidates share one pass over
    the rows (see ``gram``) and report equal shares of its time; the others are fitted ``parallelism`` at a
    time, as Spark's own tuners do, and report the time they waited for each other too. Returns one row per job, labels
    included, and the predictions with their job number; a ridge without training rows has neither. ``store`` keeps the ridges'
    predictions for the metrics, which pays where few fits share a row.
    """
    linear = [(n, c, train, validation) for n, (c, train, validation, _) in enumerate(jobs) if c.family == "ridge"]
    started = time.perf_counter()
    grid = gram.fit_grid(frame, linear, registry, by) if linear else None
    together = {n for n, *_ in linear} if grid else set()
    fits = dict.fromkeys(together, (time.perf_counter() - started) / max(len(together), 1))
    parts = [gram.score_grid(grid, frame, {n: c.name for n, c, *_ in linear})] if grid and grid.fits else []
    if store:
        parts = [materialise(part) for part in parts]

    def alone(number: int) -> DataFrame:
        candidate, train, validation, _ = jobs[number]
        begun = time.perf_counter()
        fitted = fit(candidate, frame.where(train), registry)
        fits[number] = time.perf_counter() - begun
        return scores(fitted, frame.where(validation)).withColumn("job", F.lit(number))

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        parts += pool.map(alone, [number for number in range(len(jobs)) if number not in together])
    scored = reduce(DataFrame.unionByName, parts)
    measured = {row["job"]: row for row in regression_metrics(scored, ["job"]).collect()}
    rows = [
        {**describe(candidate, measured[n], registry), "fit_seconds": fits[n], **labels}
        for n, (candidate, _, _, labels) in enumerate(jobs)
        if n in measured
    ]
    return rows, scored
