"""Baselines, encodings, metrics, selection, calibration and scoring with exact SQL."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens import functions as fn
from quotelens import schema as S
from quotelens.catalog.base import basket_sql, cte, freq_sql, query, r, rs
from quotelens.catalog.statistics import _signal_sql  # noqa: F401  (keeps the shared expressions loaded)
from quotelens.operators import baselines, encoding, metrics, scoring, selection
from quotelens.plans import experiments
from quotelens.plans.models import Candidate
from quotelens.session import materialise
from quotelens.sources import sinks

cte(
    "csup_v",
    "SELECT c.*, s.split, s.segment, s.requested_quarter AS block, c.avg_duration_months AS target FROM contract_v c JOIN sup_v s ON s.rfq_id = c.rfq_id",
)
cte("ctrain_v", "SELECT * FROM csup_v WHERE split = 'train'")
cte("cval_v", "SELECT * FROM csup_v WHERE split = 'validation'")


def _group_sql(name: str, keys: tuple[str, ...], train: str = "ctrain_v", rows: str = "cval_v") -> str:
    on = " AND ".join(f"g.{k} IS NOT DISTINCT FROM v.{k}" for k in keys)
    return (
        f"SELECT '{name}' AS model_name, v.rfq_id, v.target AS actual, coalesce(g.m, (SELECT median(target) FROM {train})) AS prediction FROM {rows} v"
        f" LEFT JOIN (SELECT {', '.join(keys)}, median(target) AS m FROM {train} GROUP BY {', '.join(keys)}) g ON {on}"
    )


cte(
    "base_pred_v",
    " UNION ALL ".join(_group_sql(n, k) for n, k in S.BASELINE_KEYS.items())
    + " UNION ALL SELECT 'global_mean', rfq_id, target, (SELECT avg(target) FROM ctrain_v) FROM cval_v UNION ALL SELECT 'global_median', rfq_id, target, (SELECT median(target) FROM ctrain_v) FROM cval_v",
)


def _pred(d, name: str, rows: DataFrame | None = None) -> DataFrame:
    frame = d.contract_frame
    train = frame.where("split = 'train'")
    rows = frame.where("split = 'validation'") if rows is None else rows
    return baselines.group_median(train, rows, S.BASELINE_KEYS[name], "target").withColumn("actual", F.col("target"))


def _all_predictions(d, segments: DataFrame | None = None) -> DataFrame:
    """(model_name, rfq_id, actual, prediction) of every baseline; with ``segment``, if a table of them by id is given."""
    frame = d.contract_frame
    train, validation = frame.where("split = 'train'"), frame.where("split = 'validation'")
    keep = []
    if segments is not None:
        # Joined to the rows before each gets one row per model.
        validation, keep = validation.drop("segment").join(segments, "rfq_id"), ["segment"]
    medians = baselines.group_medians(train, validation, S.BASELINE_KEYS, "target", keep)
    constants = [
        baselines.constant(train, validation, how, "target").select(
            *keep, F.lit(f"global_{how}").alias("model_name"), "rfq_id", F.col("target").alias("actual"), "prediction"
        )
        for how in ("mean", "median")
    ]
    return reduce(DataFrame.unionByName, [medians, *constants])


BEST = "median_by_product_frequency_maturity"
cte("pred_v", f"SELECT p.*, v.* EXCLUDE (rfq_id) FROM base_pred_v p JOIN cval_v v ON v.rfq_id = p.rfq_id WHERE p.model_name = '{BEST}'")
cte("pred2_v", "SELECT * FROM base_pred_v WHERE model_name = 'median_by_product_basket'")

# ---- baselines and encodings ---------------------------------------------------------


@query("baseline_constant", f"SELECT model_name, rfq_id, {rs('actual', 'prediction')} FROM base_pred_v WHERE model_name LIKE 'global_%'")
def baseline_constant(d):
    return _all_predictions(d).where("model_name like 'global_%'")


@query("baseline_group_median", f"SELECT model_name, rfq_id, {rs('actual', 'prediction')} FROM base_pred_v WHERE model_name LIKE 'median_by_%'")
def baseline_group_median(d):
    return _all_predictions(d).where("model_name like 'median_by_%'")


_ENC = ("product_type", "counterparty", "observation_frequency", "basket_signature")
cte(
    "enc_src_v",
    "SELECT rfq_id, split, product_type, CASE WHEN requested_month = 3 THEN NULL ELSE counterparty END AS counterparty, observation_frequency, basket_signature FROM csup_v",
)
cte("enc_rows_v", " UNION ALL ".join(f"SELECT rfq_id, split, '{c}' AS feature, {c} AS value FROM enc_src_v" for c in _ENC))
cte(
    "enc_vocab_v",
    """SELECT feature, value, n, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS code FROM (SELECT feature, value, count(*) AS n FROM enc_rows_v
 WHERE split = 'train' AND value IS NOT NULL GROUP BY 1, 2)""",
)
cte(
    "enc_filled_v",
    """SELECT e.rfq_id, e.split, e.feature, coalesce(e.value, f.filler) AS value FROM enc_rows_v e LEFT JOIN (SELECT feature, arg_min(value, struct_pack(a := -n, b := value)) AS filler FROM enc_vocab_v GROUP BY feature) f ON f.feature = e.feature""",
)


def _enc_frame(d):
    return d.contract_frame.withColumn("counterparty", F.when(F.col("requested_month") != 3, F.col("counterparty")))


@query(
    "prep_ordinal",
    "SELECT e.rfq_id, e.feature, e.value, coalesce(v.code, -1) AS code FROM enc_filled_v e LEFT JOIN enc_vocab_v v ON v.feature = e.feature AND v.value = e.value",
)
def prep_ordinal(d):
    frame = _enc_frame(d)
    return encoding.ordinal_codes(frame.where("split = 'train'"), frame, _ENC, ["rfq_id"])


@query(
    "prep_onehot",
    "SELECT e.rfq_id, e.feature, CASE WHEN v.n >= 10 THEN e.value ELSE 'infrequent' END AS category FROM enc_filled_v e LEFT JOIN enc_vocab_v v ON v.feature = e.feature AND v.value = e.value",
)
def prep_onehot(d):
    frame = _enc_frame(d)
    return encoding.pooled_categories(frame.where("split = 'train'"), frame, _ENC, ["rfq_id"])


# ---- metrics -------------------------------------------------------------------------


def metric_sql(prefix: str = "") -> str:
    r2 = "1 - sum((actual - prediction)^2)/nullif(var_pop(actual)*count(*), 0)"
    return (
        f"{r('avg(abs(actual - prediction))')} AS {prefix}mae, {r('sqrt(avg((actual - prediction)^2))')} AS {prefix}rmse, {r(r2)} AS {prefix}r2,"
        f" {r('median(abs(actual - prediction))')} AS {prefix}median_absolute_error"
    )


@query("regression_metrics", f"SELECT model_name, count(*) AS row_count, {metric_sql()} FROM base_pred_v GROUP BY model_name")
def regression_metrics(d):
    return metrics.regression_metrics(_all_predictions(d), ["model_name"])


_ERR = "avg(abs(actual - prediction))"


@query(
    "segment_mae",
    " UNION ALL ".join(
        f"SELECT '{c}' AS segment_column, CAST({c} AS VARCHAR) AS segment_value, {r(_ERR)} AS mae, count(*) AS count FROM pred_v GROUP BY 2" for c in ("requested_year", "basket_type", "product_type")
    ),
)
def segment_mae(d):
    rows = _pred(d, BEST)
    parts = [
        metrics.segment_mae(rows, c).select(F.lit(c).alias("segment_column"), F.col(c).cast("string").alias("segment_value"), "mae", "count")
        for c in ("requested_year", "basket_type", "product_type")
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "bucket_mae",
    f"""SELECT b AS duration_bucket, {r('avg(abs(actual - prediction))')} AS mae, count(actual) AS count FROM (VALUES ('0-12'),('12-24'),('24-36'),('36-60'),('60+')) v(b) LEFT JOIN
 (SELECT *, CASE WHEN actual <= -0.01 THEN NULL WHEN actual <= 12 THEN '0-12' WHEN actual <= 24 THEN '12-24' WHEN actual <= 36 THEN '24-36' WHEN actual <= 60 THEN '36-60' ELSE '60+' END AS k FROM pred_v) p ON p.k = v.b GROUP BY b""",
)
def bucket_mae(d):
    return metrics.bucket_mae(_pred(d, BEST))


@query("member_mae", f"SELECT u AS underlying, {r(_ERR)} AS mae, count(*) AS count FROM pred_v p, unnest({basket_sql('p.underlyings')}) AS t(u) GROUP BY u")
def member_mae(d):
    return metrics.member_mae(_pred(d, BEST))


# ---- fold tables ---------------------------------------------------------------------

FOLD_MODELS = [Candidate("global_mean", "constant", params={"strategy": "mean"}), Candidate("median_by_product_type", "group_median", keys=("product_type",))]
cte("cdev_v", "SELECT * FROM csup_v WHERE split <> 'test'")


def _fold_sql(segment: str | None) -> str:
    src = "(SELECT * FROM cdev_v" + (f" WHERE segment = '{segment}'" if segment else "") + ")"
    pairs = f"SELECT f.validation_year, f.role, q.product_type, q.target FROM {src} q JOIN fold_map_v f ON f.year = q.requested_year"
    train, val = f"(SELECT * FROM ({pairs}) WHERE role = 'train')", f"(SELECT * FROM ({pairs}) WHERE role = 'validation')"
    scored = f"""SELECT 'global_mean' AS model_name, v.validation_year, v.target AS actual, m.m AS prediction FROM {val} v JOIN (SELECT validation_year, avg(target) AS m FROM {train} GROUP BY 1) m ON m.validation_year = v.validation_year
 UNION ALL SELECT 'median_by_product_type', v.validation_year, v.target, coalesce(g.m, o.m) FROM {val} v LEFT JOIN (SELECT validation_year, product_type, median(target) AS m FROM {train} GROUP BY 1, 2) g
 ON g.validation_year = v.validation_year AND g.product_type = v.product_type JOIN (SELECT validation_year, median(target) AS m FROM {train} GROUP BY 1) o ON o.validation_year = v.validation_year"""
    return (
        f"SELECT '{segment or 'global'}' AS segment, model_name, validation_year, count(*) AS validation_rows, avg(abs(actual - prediction)) AS validation_mae, sqrt(avg((actual - prediction)^2)) AS validation_rmse,"
        f" 1 - sum((actual - prediction)^2)/nullif(var_pop(actual)*count(*), 0) AS validation_r2 FROM ({scored}) GROUP BY model_name, validation_year"
    )


cte("folds_v", _fold_sql(None))
cte("seg_folds_v", " UNION ALL ".join(_fold_sql(s) for s in ("single", "worst_of")))
_ROLL = f"""{r('avg(validation_mae)')} AS rolling_mae_mean, {r('stddev_samp(validation_mae)')} AS rolling_mae_std, {r('min(validation_mae)')} AS rolling_mae_min, {r('max(validation_mae)')} AS rolling_mae_max,
 {r('avg(validation_rmse)')} AS rolling_rmse_mean, {r('avg(validation_r2)')} AS rolling_r2_mean, min(validation_rows) AS min_validation_rows, max(validation_rows) AS max_validation_rows, count(*) AS n_folds"""


def _folds(d):
    return experiments.rolling(d.contract_frame.where("split <> 'test'"), FOLD_MODELS, d.registry, d.split_years)


@query("benchmark_rolling_baselines", f"SELECT segment, model_name, validation_year, validation_rows, {rs('validation_mae', 'validation_rmse', 'validation_r2')} FROM folds_v")
def benchmark_rolling_baselines(d):
    return _folds(d).select("segment", "model_name", "validation_year", "validation_rows", "validation_mae", "validation_rmse", "validation_r2")


@query("rolling_summary", f"SELECT model_name, {_ROLL} FROM folds_v GROUP BY model_name")
def rolling_summary(d):
    return metrics.rolling_summary(_folds(d), ["model_name"])


@query(
    "weighted_fold_mae",
    f"""SELECT validation_year, {r('sum(validation_mae*validation_rows)/sum(validation_rows)')} AS weighted_validation_mae, CAST(sum(validation_rows) AS BIGINT) AS validation_rows, string_agg(segment, ',' ORDER BY segment) AS segments,
 string_agg(model_name, ' + ' ORDER BY model_name) AS portfolio_model_names FROM seg_folds_v WHERE model_name = 'median_by_product_type' GROUP BY validation_year""",
)
def weighted_fold_mae(d):
    grid = {s: FOLD_MODELS[1:] for s in ("single", "worst_of")}
    frame = d.contract_frame.where("split <> 'test'")
    return metrics.weighted_fold_mae(experiments.segmented_rolling(frame, grid, d.registry, d.split_years))


cte(
    "seg_results_v",
    " UNION ALL ".join(
        f"SELECT '{s}' AS segment, model_name, count(*) AS validation_rows, (SELECT count(*) FROM ctrain_v WHERE segment = '{s}') AS train_rows, avg(abs(actual - prediction)) AS validation_mae FROM ("
        f"SELECT 'global_mean' AS model_name, target AS actual, (SELECT avg(target) FROM ctrain_v WHERE segment = '{s}') AS prediction FROM cval_v WHERE segment = '{s}' UNION ALL SELECT model_name, actual, prediction FROM ("
        + _group_sql("median_by_product_type", ("product_type",), f"(SELECT * FROM ctrain_v WHERE segment = '{s}')", f"(SELECT * FROM cval_v WHERE segment = '{s}')")
        + ")) GROUP BY model_name"
        for s in ("single", "worst_of")
    ),
)


def _segment_results(d):
    table, _ = experiments.segmented(d.contract_frame, {s: FOLD_MODELS for s in ("single", "worst_of")}, d.registry)
    return table


@query("segmented_summary", f"SELECT segment, model_name, {r('validation_mae')} AS validation_mae, train_rows, validation_rows FROM seg_results_v")
def segmented_summary(d):
    return metrics.segmented_summary(_segment_results(d)).select("segment", "model_name", "validation_mae", "train_rows", "validation_rows")


# ---- rankings ------------------------------------------------------------------------

cte(
    "ranked_v",
    "SELECT v.segment, p.model_name, avg(abs(p.actual - p.prediction)) AS validation_mae FROM base_pred_v p JOIN cval_v v ON v.rfq_id = p.rfq_id GROUP BY 1, 2",
)


def _ranked(d) -> DataFrame:
    segments = d.contract_frame.select("rfq_id", "segment")
    rows = _all_predictions(d, segments)
    # Nine places: models that predict alike must tie whatever the order of the sums.
    return rows.groupBy("segment", "model_name").agg(F.round(F.avg(metrics.absolute_error()), 9).alias("validation_mae"))


cte("ranks9_v", "SELECT segment, model_name, round(validation_mae, 9) AS validation_mae FROM ranked_v")


@query(
    "top_n_per_segment",
    f"""SELECT segment, place, model_name, {r('validation_mae')} AS validation_mae FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY segment, place) AS k FROM (
 SELECT *, row_number() OVER (PARTITION BY segment ORDER BY validation_mae, model_name) AS place FROM ranks9_v) WHERE place <= 3) WHERE k = 1""",
)
def top_n_per_segment(d):
    return selection.top_n_per_segment(_ranked(d), 3)


@query(
    "best_per_group",
    f"SELECT segment, model_name, {r('validation_mae')} AS validation_mae FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY validation_mae, model_name) AS k FROM ranks9_v) WHERE k = 1",
)
def best_per_group(d):
    return selection.best_per_group(_ranked(d), ["segment"], "validation_mae")


@query("top_k", f"SELECT segment, model_name, {r('validation_mae')} AS validation_mae FROM ranks9_v ORDER BY validation_mae, segment, model_name LIMIT 10")
def top_k(d):
    return _ranked(d).orderBy("validation_mae", "segment", "model_name").limit(10)


@query("sort_multi", f"SELECT segment, model_name, {r('nullif(validation_mae, 0)')} AS validation_mae FROM ranks9_v ORDER BY segment, validation_mae NULLS LAST, model_name")
def sort_multi(d):
    return _ranked(d).orderBy("segment", F.col("validation_mae").asc_nulls_last(), "model_name")


cte(
    "experiments_v",
    """SELECT 'segmented_benchmark' AS source, 'temporal_holdout' AS evaluation_protocol, segment, model_name, validation_mae, CAST(NULL AS DOUBLE) AS rolling_mae_mean FROM ranks9_v
 UNION ALL SELECT 'global_rolling', 'rolling_yearly', 'global', model_name, NULL, round(avg(validation_mae), 9) FROM folds_v GROUP BY model_name""",
)


def _experiments(d):
    first = _ranked(d).select(F.lit("segmented_benchmark").alias("source"), F.lit("temporal_holdout").alias("evaluation_protocol"), "segment", "model_name", "validation_mae")
    second = metrics.rolling_summary(_folds(d), ["model_name"]).select(
        F.lit("global_rolling").alias("source"),
        F.lit("rolling_yearly").alias("evaluation_protocol"),
        F.lit("all").alias("segment"),
        "model_name",
        F.round("rolling_mae_mean", 9).alias("rolling_mae_mean"),
    )
    return first, second


@query(
    "experiment_summary",
    f"""SELECT source, evaluation_protocol, segment, model_name, {rs('validation_mae', 'rolling_mae_mean')}, CASE WHEN evaluation_protocol = 'temporal_holdout' THEN 'validation_mae' ELSE 'rolling_mae_mean' END AS selection_metric,
 {r('coalesce(validation_mae, rolling_mae_mean)')} AS selection_mae FROM experiments_v""",
)
def experiment_summary(d):
    return selection.sort_summary(selection.experiment_summary(*_experiments(d)))


@query(
    "experiment_best",
    f"""SELECT evaluation_protocol, segment, model_name, {r('s')} AS selection_mae FROM (SELECT *, coalesce(validation_mae, rolling_mae_mean) AS s,
 row_number() OVER (PARTITION BY evaluation_protocol, segment ORDER BY coalesce(validation_mae, rolling_mae_mean), model_name) AS k FROM experiments_v) WHERE k = 1""",
)
def experiment_best(d):
    summary = selection.experiment_summary(*_experiments(d))
    best = selection.best_per_group(summary, ["evaluation_protocol", "segment"], "selection_mae")
    return best.select("evaluation_protocol", "segment", "model_name", "selection_mae")


@query("union_tables", f"SELECT source, model_name, {rs('validation_mae', 'rolling_mae_mean')} FROM experiments_v")
def union_tables(d):
    return selection.union_tables(*_experiments(d)).select("source", "model_name", "validation_mae", "rolling_mae_mean")


@query(
    "prediction_store",
    """SELECT model_name, count(*) FILTER (WHERE v.rfq_id IS NULL) AS unexpected_rows, (SELECT count(*) FROM cval_v WHERE segment = 'worst_of') - count(v.rfq_id) AS missing_rows
 FROM base_pred_v p LEFT JOIN (SELECT rfq_id FROM cval_v WHERE segment = 'worst_of') v ON v.rfq_id = p.rfq_id GROUP BY model_name""",
)
def prediction_store(d):
    """Predictions written by model, read back, and checked against another row set."""
    from quotelens.session import scratch_folder

    path = f"{scratch_folder(d.spark)}/predictions"
    sinks.write_predictions(_all_predictions(d), path)
    expected = d.contract_frame.where("split = 'validation' and segment = 'worst_of'").select("rfq_id")
    return sinks.prediction_mismatches(sinks.read_predictions(d.spark, path), expected)


@query("write_table", f"SELECT model_name, rfq_id, {rs('actual', 'prediction')} FROM base_pred_v WHERE model_name = 'global_mean'")
def write_table(d):
    """A report table written as CSV, JSON and parquet; the CSV copy is read back with its schema."""
    from quotelens.session import scratch_folder

    folder = scratch_folder(d.spark)
    table = _all_predictions(d).where("model_name = 'global_mean'")
    for kind in ("parquet", "json", "csv"):
        sinks.write_table(table, f"{folder}/{kind}", kind)
    return d.spark.read.schema("model_name string, rfq_id bigint, actual double, prediction double").csv(f"{folder}/csv", header=True)


# ---- selection -----------------------------------------------------------------------

cte(
    "paired_v",
    "SELECT p.rfq_id, p.block, abs(p.actual - p.prediction) AS error_global, abs(q.actual - q.prediction) AS error_segmented FROM pred_v p JOIN pred2_v q ON q.rfq_id = p.rfq_id",
)


def _paired(d):
    first, second = _pred(d, BEST), _pred(d, "median_by_product_basket")
    blocks = d.contract_frame.select("rfq_id", "block")
    # Stored: a bootstrap reads the pairs for the replicates and again for the point estimate.
    return materialise(selection.paired_errors(first, second).join(blocks, "rfq_id"))


@query("paired_errors", f"SELECT rfq_id, block, {rs('error_global', 'error_segmented')} FROM paired_v")
def paired_errors(d):
    return _paired(d)


cte("blocks_v", "SELECT block, sum(error_global) AS g, sum(error_segmented) AS s, count(*) AS n, row_number() OVER (ORDER BY block) - 1 AS slot FROM paired_v GROUP BY block")
cte(
    "replicates_v",
    """SELECT rep, (sum(g) - sum(s))/sum(n) AS difference FROM (SELECT r.rep, b.g, b.s, b.n FROM (SELECT a.rep, c.draw,
 CAST('0x' || substr(md5('42:' || a.rep || ':' || c.draw), 1, 8) AS BIGINT) % (SELECT count(*) FROM blocks_v) AS slot FROM range(5000) a(rep), range((SELECT count(*) FROM blocks_v)) c(draw)) r JOIN blocks_v b ON b.slot = r.slot) GROUP BY rep""",
)
cte(
    "interval_v",
    """SELECT (SELECT avg(error_global) - avg(error_segmented) FROM paired_v) AS point_estimate, (SELECT count(*) FROM paired_v) AS n_observations,
 quantile_cont(difference, 0.025) AS ci_95_low, quantile_cont(difference, 0.975) AS ci_95_high, (SELECT count(*) FROM blocks_v) AS n_blocks FROM replicates_v""",
)
_CI = f"{rs('point_estimate', 'ci_95_low', 'ci_95_high')}, n_observations, n_blocks, 5000 AS n_bootstrap, 'requested_quarter' AS block_unit, ci_95_low > 0 OR ci_95_high < 0 AS significant_at_5pct"


@query("bootstrap_blocks", f"SELECT {_CI} FROM interval_v")
def bootstrap_blocks(d):
    return selection.bootstrap_blocks(_paired(d))


_DECIDED = "((ci_95_low > 0 OR ci_95_high < 0) AND abs(point_estimate) >= 0.25)"


@query(
    "choose_strategy",
    f"""SELECT {_CI}, CASE WHEN {_DECIDED} AND point_estimate > 0 THEN 'segmented_by_basket_type' ELSE 'global' END AS preferred_strategy,
 CASE WHEN {_DECIDED} THEN 'validation_quarter_block_bootstrap_significant' ELSE 'not_significant_or_not_material_default_to_simpler_model' END AS decision_basis FROM interval_v""",
)
def choose_strategy(d):
    return selection.choose_strategy(selection.bootstrap_blocks(_paired(d)))


@query("bootstrap_rows")
def bootstrap_rows(d):
    return selection.bootstrap_rows(_paired(d))


cte("resid_v", "SELECT abs(actual - prediction) AS e FROM pred_v")


@query(
    "conformal_calibrate",
    f"""SELECT 0.9E0 AS nominal_coverage, {r('q')} AS absolute_residual_quantile, {r('(SELECT avg(CASE WHEN e <= q THEN 1.0E0 ELSE 0.0E0 END) FROM resid_v)')} AS empirical_coverage, (SELECT count(*) FROM resid_v) AS calibration_rows
 FROM (SELECT e AS q FROM (SELECT e, row_number() OVER (ORDER BY e) AS k, count(*) OVER () AS n FROM resid_v) WHERE k = CAST(ceil((n - 1)*0.9E0) AS BIGINT) + 1)""",
)
def conformal_calibrate(d):
    return selection.conformal_calibrate(_pred(d, BEST))


_LOW = "greatest(CAST(no_call_period_months AS DOUBLE), observation_interval_months)"
_SHIFTED = "prediction*1.5E0"
cte("shifted_v", f"SELECT *, {_SHIFTED} AS raw_p, least(greatest({_SHIFTED}, {_LOW}), nominal_maturity_months) AS clip_p FROM pred_v")


def _clip_metrics(variant, column):
    r2 = f"1 - sum((actual - {column})^2)/nullif(var_pop(actual)*count(*), 0)"
    return (
        f"{r(f'avg(abs(actual - {column}))')} AS {variant}_mae, {r(f'sqrt(avg((actual - {column})^2))')} AS {variant}_rmse, {r(r2)} AS {variant}_r2, {r(f'median(abs(actual - {column}))')} AS {variant}_median_absolute_error"
    )


@query("clip_decision", f"SELECT {_clip_metrics('raw', 'raw_p')}, {_clip_metrics('clipped', 'clip_p')}, avg(abs(actual - clip_p)) <= avg(abs(actual - raw_p)) AS clipping_enabled FROM shifted_v")
def clip_decision(d):
    return selection.clip_decision(_pred(d, BEST).withColumn("prediction", F.col("prediction") * 1.5))


# ---- serving -------------------------------------------------------------------------

cte(
    "ranges_v",
    "SELECT "
    + ", ".join(f"CAST(min({c}) AS DOUBLE) AS {c}_min, CAST(max({c}) AS DOUBLE) AS {c}_max" for c in S.RANGE_FIELDS)
    + ", list_sort(list_distinct(list(product_type))) AS products, list_sort(list_distinct(list(observation_frequency))) AS frequencies FROM dev_v",
)


@query(
    "request_ranges",
    "SELECT " + rs(*[f"{c}_{b}" for c in S.RANGE_FIELDS for b in ("min", "max")])
    + ", array_to_string(products, ',') AS accepted_product_types, array_to_string(frequencies, ',') AS accepted_observation_frequencies, (SELECT max(date) FROM series_v) AS market_data_as_of, 10 AS max_market_data_staleness_days FROM ranges_v",
)
def request_ranges(d):
    out = scoring.request_ranges(d.development, d.series)
    return out.withColumns({c: F.array_join(c, ",") for c in ("accepted_product_types", "accepted_observation_frequencies")})


def _message(name):
    v, lo, hi = f"CAST(q.{name} AS DOUBLE)", f"b.{name}_min", f"b.{name}_max"
    return f"CASE WHEN {v} < {lo} OR {v} > {hi} THEN printf('{name}=%g is outside the training range [%g, %g]', {v}, {lo}, {hi}) END"


_MESSAGES = ", ".join(_message(c) for c in S.RANGE_FIELDS)


@query(
    "ood_flags",
    f"SELECT rfq_id, start_date, concat_ws('; ', {_MESSAGES}) AS warnings, coalesce({_MESSAGES}) IS NOT NULL AS out_of_distribution FROM dirty_quotes_v q, ranges_v b",
)
def ood_flags(d):
    flagged = scoring.ood_flags(d.dirty_quotes, scoring.request_ranges(d.development, d.series))
    return flagged.select("rfq_id", "start_date", F.array_join("warnings", "; ").alias("warnings"), "out_of_distribution")


cte("req_v", f"SELECT rfq_id, product_type, requested_date + CASE WHEN requested_date >= DATE '2001-05-01' THEN 400 ELSE 0 END AS requested_date, CASE WHEN month(requested_date) = 5 THEN underlyings || '|ZZZ' ELSE underlyings END AS underlyings FROM quotes_v")
cte("req_members_v", "SELECT r.rfq_id, r.requested_date, u AS underlying FROM req_v r, unnest(string_split(r.underlyings, '|')) AS t(u)")
cte(
    "req_age_v",
    """SELECT m.rfq_id, count(*) FILTER (WHERE d.underlying IS NULL) AS unknown_members, min(m.date) AS market_data_as_of, CAST(max(date_diff('day', m.date, m.requested_date)) AS INT) AS max_market_data_age_days,
 count(*) FILTER (WHERE m.date IS NULL) AS members_without_history FROM (SELECT a.*, s.date FROM req_members_v a ASOF LEFT JOIN series_v s ON s.underlying = a.underlying AND a.requested_date >= s.date) m
 LEFT JOIN dimension_v d ON d.underlying = m.underlying GROUP BY m.rfq_id""",
)


@query(
    "coverage_check",
    """SELECT r.rfq_id, a.unknown_members, a.members_without_history, a.market_data_as_of, a.max_market_data_age_days, concat_ws(',', CASE WHEN unknown_members > 0 THEN 'unknown_member' END,
 CASE WHEN r.product_type NOT IN (SELECT product_type FROM sup_v WHERE avg_duration_months > 55) THEN 'unknown_product' END, CASE WHEN members_without_history > 0 THEN 'no_history' END, CASE WHEN max_market_data_age_days > 10 THEN 'stale_history' END) AS reasons
 FROM req_v r LEFT JOIN req_age_v a ON a.rfq_id = r.rfq_id""",
)
def coverage_check(d):
    asked = F.col("requested_date")
    requests = d.quotes.select(
        "rfq_id",
        "product_type",
        F.when(asked >= F.lit("2001-05-01").cast("date"), F.date_add(asked, 400)).otherwise(asked).alias("requested_date"),
        F.when(F.month(asked) == 5, F.concat("underlyings", F.lit("|ZZZ"))).otherwise(F.col("underlyings")).alias("underlyings"),
    )
    products = d.supervised.where("avg_duration_months > 55").select("product_type").distinct()
    checked = scoring.coverage_check(requests, d.series, d.dimension, products)
    return checked.select(
        "rfq_id", "unknown_members", "members_without_history", "market_data_as_of", "max_market_data_age_days", F.array_join("reasons", ",").alias("reasons")
    )


@query(
    "score_postprocess",
    f"""SELECT rfq_id, round(clip_p, 4) AS predicted_avg_duration_months, round(greatest(greatest(clip_p - 7.5E0, 0.0E0), {_LOW}), 4) AS prediction_interval_lower_months,
 round(least(clip_p + 7.5E0, nominal_maturity_months), 4) AS prediction_interval_upper_months FROM shifted_v""",
)
def score_postprocess(d):
    rows = _pred(d, BEST).withColumn("prediction", F.col("prediction") * 1.5)
    done = scoring.score_postprocess(rows, radius=7.5, clipping=True)
    return done.select("rfq_id", "predicted_avg_duration_months", "prediction_interval_lower_months", "prediction_interval_upper_months")


# ---- attribution tables --------------------------------------------------------------

LINEAR = {"autocall_barrier_pct": 3.0, "quoted_implied_vol": -2.0, "nominal_maturity_months": 0.1, "no_call_period_months": 0.4, "basket_size": -0.2, "notional_credits": 0.000001}
GROUPED = ("product_type", "basket_type", "counterparty")
MODELS = {"linear_a": 1.0, "linear_b": -0.5}
cte(
    "attr_v",
    " UNION ALL ".join(
        f"SELECT '{m}' AS model_name, rfq_id, '{c}' AS feature, CAST({c} AS VARCHAR) AS value, {w * k:.10f}*({c} - (SELECT avg({c}) FROM ctrain_v)) AS phi FROM cval_v"
        for m, k in MODELS.items()
        for c, w in LINEAR.items()
    )
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{m}', v.rfq_id, '{c}', v.{c}, {k:.10f}*(g.m - (SELECT avg(target) FROM ctrain_v)) FROM cval_v v JOIN (SELECT {c}, avg(target) AS m FROM ctrain_v GROUP BY 1) g ON g.{c} = v.{c}"
        for m, k in MODELS.items()
        for c in GROUPED
    ),
)


def _attributions(d) -> DataFrame:
    """Exact attributions of two additive models fitted on train, for the validation rows."""
    frame = d.contract_frame
    train, rows = frame.where("split = 'train'"), frame.where("split = 'validation'")
    centre = train.agg(*[F.avg(c).alias(c) for c in LINEAR], F.avg("target").alias("target"))
    means = {c: centre.select(c).scalar() for c in [*LINEAR, "target"]}
    parts = []
    for model, scale in MODELS.items():
        for c, weight in LINEAR.items():
            phi = F.lit(float(f"{weight * scale:.10f}")) * (F.col(c) - means[c])
            parts.append(rows.select(F.lit(model).alias("model_name"), "rfq_id", F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"), phi.alias("phi")))
        for c in GROUPED:
            effect = train.groupBy(c).agg(F.avg("target").alias("_m"))
            phi = F.lit(scale) * (F.col("_m") - means["target"])
            parts.append(rows.join(effect, c).select(F.lit(model).alias("model_name"), "rfq_id", F.lit(c).alias("feature"), F.col(c).alias("value"), phi.alias("phi")))
    return reduce(DataFrame.unionByName, parts)


cte("attr_basic_v", "SELECT model_name, feature, avg(abs(phi)) AS mean_abs_attribution, avg(phi) AS mean_attribution FROM attr_v GROUP BY 1, 2")
cte(
    "attr_rho_v",
    """SELECT model_name, feature, CASE WHEN min(x) < max(x) AND min(phi) < max(phi) THEN corr(ry, rx) END AS rho FROM (SELECT model_name, feature, x, phi,
 rank() OVER (PARTITION BY model_name, feature ORDER BY x) + (count(*) OVER (PARTITION BY model_name, feature, x) - 1)/2.0E0 AS rx,
 rank() OVER (PARTITION BY model_name, feature ORDER BY phi) + (count(*) OVER (PARTITION BY model_name, feature, phi) - 1)/2.0E0 AS ry FROM (SELECT *, TRY_CAST(value AS DOUBLE) AS x FROM attr_v) WHERE x IS NOT NULL) GROUP BY 1, 2""",
)
cte(
    "attr_sum_v",
    """SELECT b.*, r.rho, row_number() OVER (PARTITION BY b.model_name ORDER BY mean_abs_attribution DESC, b.feature) AS attribution_rank FROM attr_basic_v b LEFT JOIN attr_rho_v r ON r.model_name = b.model_name AND r.feature = b.feature""",
)
_DIR = "CASE WHEN rho IS NULL THEN 'not_applicable' WHEN rho > 0.05 THEN 'positive' WHEN rho < -0.05 THEN 'negative' ELSE 'mixed_or_flat' END"


@query(
    "attribution_summary",
    f"SELECT model_name, feature, {rs('mean_abs_attribution', 'mean_attribution')}, {r('rho')} AS value_attribution_spearman, {_DIR} AS direction, attribution_rank FROM attr_sum_v",
)
def attribution_summary(d):
    return selection.attribution_summary(_attributions(d))


@query("attribution_rank", "SELECT model_name, feature, attribution_rank FROM attr_sum_v")
def attribution_rank(d):
    return selection.attribution_summary(_attributions(d)).select("model_name", "feature", "attribution_rank")


@query(
    "categorical_effects",
    f"""SELECT model_name, feature, value AS category, {r('m')} AS mean, n AS count FROM (SELECT *, row_number() OVER (PARTITION BY model_name, feature ORDER BY n DESC, value) AS k FROM (
 SELECT model_name, feature, value, avg(phi) AS m, count(phi) AS n FROM attr_v WHERE feature IN ({', '.join(f"'{c}'" for c in GROUPED)}) GROUP BY 1, 2, 3)) WHERE k <= 25""",
)
def categorical_effects(d):
    return selection.categorical_effects(_attributions(d), GROUPED)


_CSIG_COLS = list(LINEAR)
cte(
    "csig_v",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, 'numeric' AS feature_type, corr(ry, rx) AS rho FROM (SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2.0E0 AS rx, rank() OVER (ORDER BY target) + (count(*) OVER (PARTITION BY target) - 1)/2.0E0 AS ry FROM ctrain_v)"
        for c in _CSIG_COLS
    )
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', 'categorical', NULL" for c in GROUPED),
)
cte(
    "consensus_v",
    """SELECT feature, count(DISTINCT model_name) AS model_count, avg(attribution_rank) AS avg_rank, max(attribution_rank) AS worst_rank, avg(share) AS avg_relative_mean_abs, max(share) AS max_relative_mean_abs
 FROM (SELECT *, mean_abs_attribution/sum(mean_abs_attribution) OVER (PARTITION BY model_name) AS share FROM attr_sum_v) GROUP BY feature""",
)


def _signal(d):
    from quotelens.operators.association import feature_signal_report

    return feature_signal_report(d.contract_frame.where("split = 'train'"), _CSIG_COLS, list(GROUPED), "target")


_SIGDIR = "CASE WHEN s.feature_type = 'categorical' THEN 'categorical_not_ordered' " + _DIR.removeprefix("CASE ")


@query(
    "join_signal",
    f"SELECT c.feature, s.feature_type, {r('s.rho')} AS train_target_spearman, {_SIGDIR} AS target_correlation_direction, {r('c.mean_abs_attribution')} AS mean_abs_attribution, c.model_name FROM attr_basic_v c LEFT JOIN csig_v s ON s.feature = c.feature",
)
def join_signal(d):
    summary = selection.attribution_summary(_attributions(d)).select("model_name", "feature", "mean_abs_attribution")
    return selection.join_signal(summary, _signal(d))


@query(
    "pruning_candidates",
    f"""SELECT c.feature, model_count, {r('avg_rank')} AS avg_rank, worst_rank, {rs('avg_relative_mean_abs', 'max_relative_mean_abs')}, s.feature_type, {r('s.rho')} AS train_target_spearman, {_SIGDIR} AS target_correlation_direction,
 {r('abs(s.rho)')} AS abs_train_target_spearman, model_count >= 2 AND avg_rank >= 32 AND max_relative_mean_abs < 0.01 AND coalesce(abs(s.rho), 0) < 0.08 AS pruning_candidate FROM consensus_v c LEFT JOIN csig_v s ON s.feature = c.feature""",
)
def pruning_candidates(d):
    return selection.pruning_candidates(selection.attribution_summary(_attributions(d)), _signal(d))
