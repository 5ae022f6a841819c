"""Learners on the stored feature table: checked by invariants in the tests, not by SQL.

Ensembles have their full size. The boosted candidates are fitted by ``model_boosted`` alone, as one
fit is thousands of small Spark jobs; ``plans.models.default_candidates`` is the whole grid.
"""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens import schema as S
from quotelens.catalog.base import query, rs
from quotelens.catalog.quality import REQUEST_BASKET_SQL, REQUEST_REASONS_SQL
from quotelens.operators import scoring
from quotelens.operators.encoding import fit_encoder
from quotelens.operators.quality import request_contract
from quotelens.plans import experiments, serving
from quotelens.plans.models import SEGMENT_BLOCKS, Candidate, default_candidates, fit, predictions, stable_candidates
from quotelens.session import materialise
from quotelens.sources import sinks

RIDGE = Candidate("ridge_onehot", "ridge", "compact_core", "onehot", {"alpha": 5.0})
RIDGE_ORDINAL = Candidate("ridge_ordinal", "ridge", "all_without_commercial", "ordinal", {"alpha": 5.0})
FOREST = Candidate("forest_onehot", "forest", "compact_core", "onehot", {"numTrees": 200, "minInstancesPerNode": 8, "featureShare": 0.8})
BOOSTED = Candidate("boosted_native__compact_core", "boosted", "compact_core", "native", {"maxIter": 350, "maxDepth": 6, "stepSize": 0.05, "lossType": "absolute"})
BOOSTED_SQUARED = Candidate("boosted_squared__compact_core", "boosted", "compact_core", "ordinal", {"maxIter": 250, "maxDepth": 5, "stepSize": 0.05, "lossType": "squared"})
MEAN = Candidate("global_mean", "constant", params={"strategy": "mean"})
MEDIAN = Candidate("median_by_product_frequency_maturity", "group_median", keys=S.BASELINE_KEYS["median_by_product_frequency_maturity"])
_SHORT = ["model_name", "estimator_class", "feature_block", "encoding_strategy", "validation_mae", "validation_rmse", "validation_r2", "validation_rows", "n_total_features"]


def _holdout_predictions(d, candidate):
    frame = d.model_frame
    fitted = fit(candidate, frame.where("split = 'train'"), d.registry)
    return predictions(fitted, frame.where("split = 'validation'"))


@query("model_ridge")
def model_ridge(d):
    return _holdout_predictions(d, RIDGE)


@query("model_forest")
def model_forest(d):
    return _holdout_predictions(d, FOREST)


@query("model_boosted")
def model_boosted(d):
    """Both losses, by model name, fitted side by side: each fit is a long row of jobs too short to fill the cores."""
    # Stored before the threads ask for it.
    d.model_frame  # noqa: B018
    with ThreadPoolExecutor(max_workers=2) as pool:
        absolute, squared = pool.map(lambda candidate: _holdout_predictions(d, candidate), (BOOSTED, BOOSTED_SQUARED))
    return absolute.unionByName(squared)


@query("prep_impute_scale")
def prep_impute_scale(d):
    """Median-imputed, standardised numbers of the compact block, as the linear pipeline sees them."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    from quotelens.plans.models import number_stages

    frame = d.model_frame
    numeric, _ = d.registry.select_block("compact_core")
    model = Pipeline(stages=number_stages(numeric, True)).fit(frame.where("split = 'train'"))
    return model.transform(frame).select("rfq_id", "split", vector_to_array("scaled").alias("scaled"))


@query("prep_native_cat")
def prep_native_cat(d):
    """Codes of the native encoding: every training value, ordered by its mean target."""
    _, categorical = d.registry.select_block("compact_core")
    # Fitting and encoding read a few columns, stored without the others.
    frame = materialise(d.model_columns("rfq_id", "split", "target", *categorical))
    encoder = fit_encoder(frame.where("split = 'train'"), categorical, "native", "target")
    return encoder.encode(frame).select("rfq_id", *encoder.outputs)


def _unboosted():
    return [*(c for c in default_candidates() if c.family in ("constant", "group_median")), RIDGE, RIDGE_ORDINAL, FOREST]


@query("benchmark_holdout")
def benchmark_holdout(d):
    """Every baseline of the standing grid, both linear encodings and the forest."""
    table, _ = experiments.holdout(d.model_frame, _unboosted(), d.registry)
    return table.select(*_SHORT)


@query("benchmark_rolling")
def benchmark_rolling(d):
    """The candidates of ``benchmark_holdout`` over the folds."""
    return experiments.rolling(d.model_frame.where("split <> 'test'"), _unboosted(), d.registry, d.split_years).select("validation_year", *_SHORT)


def _segment_grids(blocks):
    return {s: [replace(RIDGE, name=f"ridge__{b}", block=b) for b in names] for s, names in blocks.items()}


@query("benchmark_segmented")
def benchmark_segmented(d):
    """Every block of each segment."""
    table, _ = experiments.segmented(d.model_frame, _segment_grids(SEGMENT_BLOCKS), d.registry)
    return table.select("segment", "train_rows", *_SHORT)


@query("benchmark_segmented_rolling")
def benchmark_segmented_rolling(d):
    """Every block of each segment over the folds."""
    table = experiments.segmented_rolling(d.model_frame.where("split <> 'test'"), _segment_grids(SEGMENT_BLOCKS), d.registry, d.split_years)
    return table.select("segment", "validation_year", *_SHORT)


@query("benchmark_stable")
def benchmark_stable(d):
    table, _ = experiments.holdout(d.model_frame, stable_candidates(RIDGE), d.registry)
    return table.select(*_SHORT)


@query("tune")
def tune(d):
    """The operator's default number of trials for each linear candidate over its whole declared range."""
    return experiments.tune(d.model_frame, [RIDGE, RIDGE_ORDINAL], d.registry).select("base_model_name", "trial", "params", *_SHORT)


@query("permutation_importance")
def permutation_importance(d):
    frame = d.model_frame
    fitted = fit(RIDGE, frame.where("split <> 'test'"), d.registry)
    return experiments.permutation_importance(fitted, frame.where("split = 'test'"), d.registry)


@query("permutation_importance_forest")
def permutation_importance_forest(d):
    frame = d.model_frame
    fitted = fit(FOREST, frame.where("split <> 'test'"), d.registry)
    return experiments.permutation_importance(fitted, frame.where("split = 'test'"), d.registry)


@query("attribution")
def attribution(d):
    frame = d.model_frame
    fitted = fit(RIDGE, frame.where("split = 'train'"), d.registry)
    return experiments.attribution(fitted, frame.where("split = 'validation'"), frame.where("split = 'train'"), d.registry)


@query("evaluate_strategy")
def evaluate_strategy(d):
    segments = {s: Candidate(f"median_{s}", "group_median", keys=("product_type", "observation_frequency_clean")) for s in ("single", "worst_of")}
    frame = d.contract_frame.where("split <> 'test'")
    summary, _, _ = experiments.evaluate_strategy(frame, MEDIAN, segments, d.registry, d.split_years)
    return summary


@query("train_final")
def train_final(d):
    _, metrics, _ = serving.train_final(d.model_frame, RIDGE, d.registry)
    return metrics


@query("train_segmented")
def train_segmented(d):
    candidates = {"single": replace(RIDGE, block="single_stable"), "worst_of": RIDGE}
    _, scored = serving.train_segmented(d.model_frame, candidates, d.registry)
    return scored


@query("evaluate_saved")
def evaluate_saved(d):
    from quotelens.session import scratch_folder

    frame, path = d.model_frame, f"{scratch_folder(d.spark)}/model"
    fitted, _, _ = serving.train_final(frame, RIDGE, d.registry)
    serving.save_model(fitted, path, scoring.ServingRules(radius=5.0, clipping=True, model_name=RIDGE.name))
    return serving.evaluate_saved(d.spark, path, frame)


def _requests(d):
    """Quotes as requests through the contract, some with an unknown member, some asked for long after their history."""
    asked = F.col("requested_date")
    late = F.when(asked >= F.lit("2001-05-01").cast("date"), F.date_add(asked, 400)).otherwise(asked)
    named = F.when(F.month(asked) == 5, F.concat("underlyings", F.lit("|ZZZ"))).otherwise(F.col("underlyings"))
    rows = d.quotes.withColumns({"requested_date": late, "underlyings": named, "request_ord": F.col("rfq_id")})
    return request_contract(rows.select("request_ord", *[f.name for f in S.REQUEST.fields]))


_LATE = "CASE WHEN requested_date >= DATE '2001-05-01' THEN requested_date + 400 ELSE requested_date END"


@query(
    "score_refusals",
    f"""SELECT q.rfq_id AS request_ord, concat_ws(',', CASE WHEN {_LATE} > q.start_date THEN 'requested_after_start' END, CASE WHEN month(q.requested_date) = 5 AND q.basket_type = 'single' THEN 'basket_size' END,
 CASE WHEN a.unknown_members > 0 THEN 'unknown_member' END, CASE WHEN q.product_type NOT IN (SELECT product_type FROM sup_v WHERE avg_duration_months > 55) THEN 'unknown_product' END,
 CASE WHEN a.members_without_history > 0 THEN 'no_history' END, CASE WHEN a.max_market_data_age_days > 10 THEN 'stale_history' END) AS reasons,
 a.market_data_as_of, a.max_market_data_age_days FROM quotes_v q LEFT JOIN req_age_v a ON a.rfq_id = q.rfq_id""",
)
def score_refusals(d):
    """Which requests batch scoring refuses and why, with the dates its answer would rest on."""
    fitted = fit(MEAN, d.contract_frame.where("split = 'train'"), d.registry)
    products = d.supervised.where("avg_duration_months > 55").select("product_type").distinct()
    ranges = scoring.request_ranges(d.development, d.series)
    rules = scoring.ServingRules(radius=5.0, clipping=True)
    done = serving.score_batch(_requests(d), d.series, d.dimension, fitted, rules, ranges, d.registry, products=products, history=d.stored_history)
    return done.select("request_ord", F.array_join("reasons", ",").alias("reasons"), "market_data_as_of", "max_market_data_age_days")


@query("score_batch")
def score_batch(d):
    """Requests answered or refused by a model fitted, calibrated and clipped on earlier years."""
    frame = d.model_frame
    calibration, clip = serving.calibrate(frame, RIDGE, d.registry)
    rules = serving.serving_rules(calibration, clip, RIDGE)
    fitted, _, _ = serving.train_final(frame, RIDGE, d.registry)
    ranges = scoring.request_ranges(d.development, d.series)
    scored = serving.score_batch(_requests(d), d.series, d.dimension, fitted, rules, ranges, d.registry, history=d.stored_history)
    return scored.withColumns({"warnings": F.array_join("warnings", "; "), "reasons": F.array_join("reasons", ",")})


_READ_SQL = f"""SELECT product_type, {REQUEST_BASKET_SQL} AS underlyings, basket_type, {rs('autocall_barrier_pct', 'protection_barrier_pct')}, no_call_period_months,
 observation_frequency, {rs('quoted_implied_vol', 'notional_credits')}, coalesce(counterparty, 'UNKNOWN') AS counterparty, coalesce(trader_id, 'UNKNOWN') AS trader_id, requested_date, start_date, end_date,
 {REQUEST_REASONS_SQL} AS reasons FROM quotes_v"""


def _read_back(d, kind, write):
    from quotelens.session import scratch_folder
    from quotelens.sources import readers

    path = f"{scratch_folder(d.spark)}/requests"
    write(d.quotes.select(*[f.name for f in S.REQUEST.fields]), path)
    return request_contract(readers.read_requests(d.spark, path, kind)).drop("request_ord").withColumn("reasons", F.array_join("reasons", ","))


@query("read_requests", _READ_SQL)
def read_requests(d):
    """Quotes written as a request CSV and read back through the declared request schema."""
    return _read_back(d, "csv", lambda rows, path: sinks.write_table(rows, path, "csv"))


@query("read_requests_json", _READ_SQL)
def read_requests_json(d):
    """Quotes written as JSON lists, one per partition, and read back in items cut by byte range."""
    return _read_back(d, "json", sinks.write_json_lists)
