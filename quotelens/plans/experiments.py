"""Experiment loops.  The driver walks over candidates; every fit, score and metric is a Spark job."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoderModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotelens import schema as S
from quotelens.operators.metrics import absolute_error
from quotelens.operators.ordered import positions
from quotelens.operators.selection import seeded_sample
from quotelens.plans.models import LABEL, Candidate, Fitted, evaluate, evaluate_many
from quotelens.plans.trees import BLOCK, TreesModel, joined_batches
from quotelens.session import materialise

RESULT_SCHEMA = (
    "model_name string, estimator_class string, feature_block string, encoding_strategy string, validation_mae double,"
    " validation_rmse double, validation_r2 double, validation_median_absolute_error double, validation_rows bigint,"
    " fit_seconds double, validation_predict_seconds double, validation_rows_per_second_predict double,"
    " n_numeric_features int, n_categorical_features int, n_total_features int"
)


def _table(spark: SparkSession, rows: Sequence[Mapping], extra: str = "") -> DataFrame:
    """One row per fitted candidate: as long as the grid, not as the data."""
    schema = RESULT_SCHEMA + (f", {extra}" if extra else "")
    names = [part.split()[0] for part in schema.replace(", ", ",").split(",")]
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema)


def split_is(name: str) -> Column:
    return F.col("split") == name


def holdout(frame: DataFrame, candidates: Sequence[Candidate], registry: S.FeatureRegistry) -> tuple[DataFrame, DataFrame]:
    """Fit on train, score validation: (metrics by MAE, validation predictions). Ridge candidates share their passes."""
    linear = [c for c in candidates if c.family == "ridge"]
    rows, parts = [], []
    if linear:
        rows, scored = evaluate_many(frame, [(c, split_is("train"), split_is("validation"), {}) for c in linear], registry, ["split"], store=True)
        parts.append(scored.drop("job"))
    for candidate in candidates:
        if candidate.family != "ridge":
            row, scored = evaluate(candidate, frame.where(split_is("train")), frame.where(split_is("validation")), registry)
            rows.append(row)
            parts.append(scored)
    metrics = _table(frame.sparkSession, rows).orderBy("validation_mae", "model_name")
    return metrics, reduce(DataFrame.unionByName, parts)


def fold_years(frame: DataFrame, years: S.SplitYears | None, min_train_years: int = 2) -> list[int]:
    """Validation years of the expanding folds: at most one per calendar year."""
    present = sorted(r["requested_year"] for r in frame.select("requested_year").distinct().collect())
    return [y for i, y in enumerate(present) if i >= min_train_years and (years is None or y <= years.validation)]


FOLD_COLUMNS = "validation_year int, segment string"


def _fold_jobs(frame: DataFrame, candidates: Sequence[Candidate], years: S.SplitYears, segment: str | None) -> list[tuple]:
    inside = F.col("segment") == segment if segment else F.lit(True)
    asked = F.col("requested_year")
    return [
        (c, inside & (asked < year), inside & (asked == year), {"validation_year": year, "segment": segment or "global"})
        for year in fold_years(frame.where(inside), years)
        for c in candidates
    ]


def rolling(frame: DataFrame, candidates: Sequence[Candidate], registry: S.FeatureRegistry, years: S.SplitYears) -> DataFrame:
    """Candidates by expanding yearly folds."""
    rows, _ = evaluate_many(frame, _fold_jobs(frame, candidates, years, None), registry, ["requested_year"], store=True)
    return _table(frame.sparkSession, rows, FOLD_COLUMNS)


def segmented_rolling(
    frame: DataFrame, candidates: Mapping[str, Sequence[Candidate]], registry: S.FeatureRegistry, years: S.SplitYears
) -> DataFrame:
    """Candidates by segment and expanding yearly fold."""
    jobs = [job for segment, grid in candidates.items() for job in _fold_jobs(frame, grid, years, segment)]
    rows, _ = evaluate_many(frame, jobs, registry, ["segment", "requested_year"])
    return _table(frame.sparkSession, rows, FOLD_COLUMNS)


def segmented(
    frame: DataFrame, candidates: Mapping[str, Sequence[Candidate]], registry: S.FeatureRegistry
) -> tuple[DataFrame, DataFrame]:
    """One model per segment on the holdout: (metrics, predictions)."""
    sizes = {
        r["segment"]: r["n"]
        for r in frame.where("split = 'train'").groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    jobs = []
    for segment, grid in candidates.items():
        inside = F.col("segment") == segment
        jobs += [(c, inside & split_is("train"), inside & split_is("validation"), {"segment": segment, "train_rows": sizes.get(segment, 0)}) for c in grid]
    rows, scored = evaluate_many(frame, jobs, registry, ["segment", "split"])
    return _table(frame.sparkSession, rows, "segment string, train_rows bigint"), scored


def evaluate_strategy(
    frame: DataFrame,
    global_candidate: Candidate,
    segment_candidates: Mapping[str, Candidate],
    registry: S.FeatureRegistry,
    years: S.SplitYears,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Global model against a per-segment router: (summary, global rows, routed rows)."""
    from quotelens.operators.metrics import weighted_fold_mae

    whole, whole_rows = holdout(frame, [global_candidate], registry)
    grids = {s: [c] for s, c in segment_candidates.items()}
    parts, part_rows = segmented(frame, grids, registry)
    whole_folds = rolling(frame, [global_candidate], registry, years)
    part_folds = weighted_fold_mae(segmented_rolling(frame, grids, registry, years))

    def folds(table: DataFrame, column: str) -> list:
        return [F.avg(column).alias("rolling_mae_mean"), F.max(column).alias("rolling_mae_max")]

    weighted = F.try_divide(F.sum(F.col("validation_mae") * F.col("validation_rows")), F.sum("validation_rows"))
    keyed = F.lit(1).alias("_one")
    first = whole.agg(weighted.alias("validation_mae"), F.sum("validation_rows").alias("validation_rows")).select("*", keyed).join(
        whole_folds.agg(*folds(whole_folds, "validation_mae")).select("*", keyed), "_one"
    ).withColumn("strategy", F.lit("global"))
    second = parts.agg(weighted.alias("validation_mae"), F.sum("validation_rows").alias("validation_rows")).select("*", keyed).join(
        part_folds.agg(*folds(part_folds, "weighted_validation_mae")).select("*", keyed), "_one"
    ).withColumn("strategy", F.lit("segmented_by_basket_type"))
    return first.unionByName(second).drop("_one"), whole_rows, part_rows


# --------------------------------------------------------------------------------------
# Random search
# --------------------------------------------------------------------------------------

# Declared ranges: (low, high, scale).
SEARCH_SPACES = {
    "boosted": {
        "maxIter": (150, 900, "int"),
        "maxDepth": (3, 8, "int"),
        "stepSize": (0.01, 0.15, "log"),
        "minInstancesPerNode": (10, 120, "int"),
        "subsamplingRate": (0.65, 1.0, "linear"),
        "maxBins": (64, 255, "int"),
    },
    "forest": {"numTrees": (100, 400, "int"), "minInstancesPerNode": (4, 40, "int"), "maxDepth": (6, 14, "int")},
    "ridge": {"alpha": (0.01, 100.0, "log")},
}


def draw_params(space: Mapping[str, tuple], generator: random.Random) -> dict:
    drawn = {}
    for name, (low, high, scale) in space.items():
        if scale == "int":
            drawn[name] = generator.randint(int(low), int(high))
        elif scale == "log":
            drawn[name] = math.exp(generator.uniform(math.log(low), math.log(high)))
        else:
            drawn[name] = generator.uniform(low, high)
    return drawn


def tune(
    frame: DataFrame,
    candidates: Sequence[Candidate],
    registry: S.FeatureRegistry,
    *,
    trials: int = 20,
    spaces: Mapping[str, Mapping[str, tuple]] | None = None,
    seed: int = S.SEED,
    parallelism: int = 4,
) -> DataFrame:
    """Seeded random search for the lowest validation MAE: one row per trial.

    Trials of ridge candidates share one pass; the others are independent Spark jobs submitted from a
    thread pool, as Spark's own tuners do.
    """
    spaces = spaces or SEARCH_SPACES
    work = []
    for candidate in candidates:
        generator = random.Random(f"{seed}:{candidate.name}")
        for trial in range(trials):
            params = draw_params(spaces[candidate.family], generator)
            shown = ",".join(f"{k}={v}" for k, v in sorted(params.items()))
            labels = {"base_model_name": candidate.name, "trial": trial, "params": shown}
            work.append((candidate.with_params(f"{candidate.name}#{trial}", **params), labels))

    def run(job):
        candidate, labels = job
        result, _ = evaluate(candidate, frame.where(split_is("train")), frame.where(split_is("validation")), registry)
        return {**result, **labels}

    linear = [(c, split_is("train"), split_is("validation"), labels) for c, labels in work if c.family == "ridge"]
    rows = evaluate_many(frame, linear, registry, ["split"])[0] if linear else []
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        rows += pool.map(run, [job for job in work if job[0].family != "ridge"])
    return _table(frame.sparkSession, rows, "base_model_name string, trial int, params string")


# --------------------------------------------------------------------------------------
# Importance and attribution
# --------------------------------------------------------------------------------------


def permutation_importance(
    fitted: Fitted, rows: DataFrame, registry: S.FeatureRegistry, *, repeats: int = 5, seed: int = S.SEED
) -> DataFrame:
    """Rise of the MAE when one feature is shuffled: mean and spread over repeats.

    A repeat pairs every row with the row at the same place of another digest order, which is an
    exact permutation and one equi-join. Where the learner allows it, a pair yields the predictions of
    all swaps as one array: a linear model's changes by the feature's share of the prediction, and of a forest
    only the trees that split on the feature answer anew. Other learners score each pair once per feature.
    """
    numeric, categorical = registry.select_block(fitted.candidate.block)
    features = [*numeric, *categorical]
    base = rows.select(S.ID, LABEL, *features)
    plain = fitted.predict(base).agg(F.avg(absolute_error(LABEL)).alias("mae")).scalar()
    errors = _swaps_as_arrays(fitted, base, numeric, categorical, repeats, seed)
    if errors is None:
        errors = _swaps_as_rows(fitted, base, features, repeats, seed)
    return errors.groupBy(F.col("_feature").alias("feature")).agg(
        (F.avg("mae") - plain).alias("importance_mean"), F.stddev_pop("mae").alias("importance_std")
    )


def _placed(rows: DataFrame, seed: int, salt: str) -> DataFrame:
    keyed = rows.withColumn("_digest", F.md5(F.concat_ws(":", F.lit(f"{seed}:{salt}"), F.col(S.ID).cast("string"))))
    return positions(keyed, [], ["_digest", S.ID], F.substring("_digest", 1, 4), "_place").drop("_digest")


def _swaps_as_arrays(
    fitted: Fitted, base: DataFrame, numeric: Sequence[str], categorical: Sequence[str], repeats: int, seed: int
) -> DataFrame | None:
    """(_feature, _repeat, mae) for learners that need no scoring of whole rows; else None."""
    learner = fitted.model.stages[-1] if fitted.model is not None else None
    if not isinstance(learner, (LinearRegressionModel, TreesModel)):
        return None
    sizes = [1] * len(categorical)
    for stage in fitted.model.stages:
        if isinstance(stage, OneHotEncoderModel):
            # The encoder keeps a place for values that it doesn't know.
            sizes = [size + 1 for size in stage.categorySizes]
    features, widths = [*numeric, *categorical], [1] * len(numeric) + sizes
    ends = list(accumulate(widths, initial=0))
    coded = fitted.encoder.encode(base) if fitted.encoder else base
    inputs = PipelineModel(fitted.model.stages[:-1]).transform(coded).select(S.ID, LABEL, vector_to_array("features").alias("_x"))
    if isinstance(learner, LinearRegressionModel):
        weights = F.array(*[F.lit(float(w)) for w in learner.coefficients])
        shares = F.zip_with("_x", weights, lambda x, w: x * w)

        def share(start: int, width: int) -> Column:
            return F.aggregate(F.slice(shares, start + 1, width), F.lit(0.0), lambda total, s: total + s)

        inputs = inputs.select(S.ID, LABEL, F.array(*[share(e, w) for e, w in zip(ends, widths)]).alias("_x"))
        whole = F.aggregate("_x", F.lit(float(learner.intercept)), lambda total, s: total + s)
        # The shares stand once in a row; each swap exchanges one of them.
        swaps = F.transform(F.zip_with("_x", "_other", lambda own, other: other - own), lambda change: whole + change)
    else:
        groups = [list(range(e, e + w)) for e, w in zip(ends, widths)]
        shared = base.sparkSession.sparkContext.broadcast(learner.trees)

        def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in joined_batches(batches, max(1, BLOCK // (2 * ends[-1]))):
                own, other = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("_x", "_other"))
                changed = shared.value.swapped(own, other, groups)
                lists = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * np.int32(len(groups)), changed.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(LABEL), batch.column("_repeat"), lists], [LABEL, "_repeat", "_swaps"])

        swaps = None
    own, parts = materialise(_placed(inputs, seed, "own")), []
    for repeat in range(repeats):
        partner = _placed(own.select(S.ID, F.col("_x").alias("_other")), seed, f"repeat{repeat}").select("_place", "_other")
        parts.append(own.join(partner, "_place").select(LABEL, F.lit(repeat).alias("_repeat"), "_x", "_other"))
    pairs = reduce(DataFrame.unionByName, parts)
    if swaps is None:
        scored = pairs.mapInArrow(swapped, f"{LABEL} {pairs.schema[LABEL].dataType.simpleString()}, _repeat int, _swaps array<double>")
    else:
        scored = pairs.select(LABEL, "_repeat", swaps.alias("_swaps"))
    means = scored.groupBy("_repeat").agg(F.array(*[F.avg(F.abs(F.col(LABEL) - F.col("_swaps")[i])) for i in range(len(features))]).alias("_mae"))
    named = means.select("_repeat", F.posexplode("_mae").alias("_at", "mae"))
    return named.select("_repeat", "mae", F.array(*[F.lit(c) for c in features])[F.col("_at")].alias("_feature"))


def _swaps_as_rows(fitted: Fitted, base: DataFrame, features: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """(_feature, _repeat, mae) for any learner: each pair is scored once per feature, all in one plan."""
    own = _placed(base, seed, "own")
    shuffled = []
    for repeat in range(repeats):
        partner = _placed(base, seed, f"repeat{repeat}").select("_place", *[F.col(c).alias(f"p_{c}") for c in features])
        paired = own.join(partner, "_place").withColumn("_feature", F.explode(F.array(*[F.lit(c) for c in features])))
        swapped = paired.select(
            S.ID,
            LABEL,
            "_feature",
            F.lit(repeat).alias("_repeat"),
            *[F.when(F.col("_feature") == c, F.col(f"p_{c}")).otherwise(F.col(c)).alias(c) for c in features],
        )
        shuffled.append(swapped)
    scored = fitted.predict(reduce(DataFrame.unionByName, shuffled))
    return scored.groupBy("_feature", "_repeat").agg(F.avg(absolute_error(LABEL)).alias("mae"))


def attribution(
    fitted: Fitted,
    rows: DataFrame,
    background: DataFrame,
    registry: S.FeatureRegistry,
    *,
    max_rows: int = 1000,
    background_rows: int | None = None,
    permutations: int = 8,
    seed: int = S.SEED,
) -> DataFrame:
    """Monte-Carlo Shapley values: (model_name, rfq_id, feature, value, phi).

    For each sampled row and permutation, features switch one by one from a background row to the
    row itself, and each switch is credited with the change of the prediction.  All steps of all
    rows are scored in one plan.  The row sample is the operator's own parameter; background rows
    are drawn from the whole background unless ``background_rows`` names a number.
    """
    numeric, categorical = registry.select_block(fitted.candidate.block)
    features = [*numeric, *categorical]
    sample = seeded_sample(rows.select(S.ID, LABEL, *features), max_rows, seed)
    pool = background.select(S.ID, *features)
    if background_rows is not None:
        pool = seeded_sample(pool, background_rows, seed + 1)
    # A digest order spreads the numbering of a whole background over many tasks.
    pool = pool.withColumn("_digest", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(S.ID).cast("string"))))
    numbered = positions(pool, [], ["_digest", S.ID], F.substring("_digest", 1, 4), "_slot").select(
        "_slot", *[F.col(c).alias(f"b_{c}") for c in features]
    )
    size = numbered.agg(F.count(F.lit(1)).alias("n")).scalar()
    key = F.col(S.ID).cast("string")
    order = F.transform(
        F.array_sort(
            F.transform(
                F.array(*[F.lit(c) for c in features]),
                lambda c: F.struct(F.xxhash64(F.lit(seed), key, F.col("_draw"), c).alias("h"), c.alias("c")),
            )
        ),
        lambda e: e["c"],
    )
    walks = (
        sample.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
        .withColumn("_slot", F.pmod(F.xxhash64(F.lit(seed + 2), key, F.col("_draw")), size))
        .join(numbered, "_slot")
        .withColumn("_order", order)
        .withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    )
    mixed = walks.select(
        S.ID,
        LABEL,
        "_draw",
        "_step",
        F.try_element_at("_order", F.when(F.col("_step") > 0, F.col("_step")).otherwise(F.lit(len(features) + 1))).alias("feature"),
        *[F.col(c).alias(f"own_{c}") for c in features],
        *[
            F.when(F.array_position("_order", c) <= F.col("_step"), F.col(c)).otherwise(F.col(f"b_{c}")).alias(c)
            for c in features
        ],
    )
    shown = F.coalesce(*[F.when(F.col("feature") == c, F.col(f"own_{c}").cast("string")) for c in features])
    scored = fitted.predict(mixed).select(S.ID, "_draw", "_step", "feature", shown.alias("value"), "prediction")
    # One group is one walk: as many rows as there are features, plus one.
    walk = Window.partitionBy(S.ID, "_draw").orderBy("_step")
    gains = scored.withColumn("_gain", F.col("prediction") - F.lag("prediction").over(walk)).where("_step > 0")
    return gains.groupBy(S.ID, "feature").agg(F.avg("_gain").alias("phi"), F.max("value").alias("value")).select(
        F.lit(fitted.candidate.name).alias("model_name"), S.ID, "feature", "value", "phi"
    )
