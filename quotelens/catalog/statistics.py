"""Drift, association and hypothesis statistics."""

from pyspark.sql import functions as F

from quotelens import functions as fn
from quotelens import schema as S
from quotelens.catalog.base import cte, query, r, rs
from quotelens.catalog.pointintime import _registry
from quotelens.operators import association, drift
from quotelens.operators.ordered import running_sums, value_counts

REG = _registry()
NUMERIC = ["autocall_barrier_pct", "protection_barrier_pct", "no_call_period_months", "quoted_implied_vol", "notional_credits", "avg_duration_months", "basket_size"]
TEXT = ["product_type", "basket_type", "observation_frequency", "counterparty", "trader_id", "segment"]
COMPARED = ("validation", "test")


def ks_p_sql(x: str) -> str:
    series = f"list_sum([(CASE WHEN k % 2 = 1 THEN 2.0E0 ELSE -2.0E0 END) * exp(-2.0E0*k*k*{x}*{x}) FOR k IN range(1, 101)])"
    return f"CASE WHEN {x} < 0.2 THEN 1.0E0 ELSE greatest(0.0E0, least(1.0E0, {series})) END"


def status_sql(*checks: tuple[str, str]) -> str:
    def any_of(i):
        return " OR ".join(f"coalesce(abs({c}) >= {S.DRIFT_LIMITS[n][i]}, false)" for c, n in checks)

    return f"CASE WHEN {any_of(1)} THEN 'fail' WHEN {any_of(0)} THEN 'warning' ELSE 'pass' END"


cte(
    "long_v",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, split, CAST({c} AS DOUBLE) AS value FROM sup_v" for c in NUMERIC),
)
cte(
    "ecdf_v",
    """SELECT feature, value, lead(value) OVER w - value AS step, sum(n_train) OVER w / sum(n_train) OVER p AS f_train, sum(n_validation) OVER w / sum(n_validation) OVER p AS f_validation,
 sum(n_test) OVER w / sum(n_test) OVER p AS f_test FROM (SELECT feature, value, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'validation') AS n_validation,
 count(*) FILTER (WHERE split = 'test') AS n_test FROM long_v WHERE value IS NOT NULL GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature ORDER BY value), p AS (PARTITION BY feature)""",
)
cte(
    "distance_v",
    " UNION ALL ".join(
        f"SELECT feature, '{s}' AS split, max(abs(f_train - f_{s})) AS ks_statistic, sum(abs(f_train - f_{s})*coalesce(step, 0)) AS wasserstein_distance FROM ecdf_v GROUP BY feature"
        for s in COMPARED
    ),
)
cte(
    "numeric_drift_v",
    f"""SELECT *, {status_sql(('ks_statistic', 'ks'), ('standardized_mean_shift', 'shift'))} AS status FROM (
 SELECT d.split, d.feature, t.n AS train_rows, c.n AS compared_rows, t.m AS train_mean, c.m AS compared_mean, CASE WHEN t.lo < t.hi THEN (c.m - t.m)/t.sd END AS standardized_mean_shift,
 d.ks_statistic, sqrt(CAST(t.n AS DOUBLE)*c.n/(t.n + c.n))*d.ks_statistic AS x, d.wasserstein_distance FROM distance_v d
 JOIN (SELECT feature, count(value) AS n, avg(value) AS m, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi FROM long_v WHERE split = 'train' GROUP BY feature) t ON t.feature = d.feature
 JOIN (SELECT feature, split, count(value) AS n, avg(value) AS m FROM long_v GROUP BY feature, split) c ON c.feature = d.feature AND c.split = d.split)""",
)


@query("ks_two_sample", f"SELECT feature, {r('ks_statistic')} AS ks_statistic FROM distance_v WHERE split = 'validation'")
def ks_two_sample(d):
    long = drift.long_numeric(d.supervised, ["split"], NUMERIC)
    return drift.two_sample(long, ["feature"], "split", "train", "validation").select("feature", "ks_statistic")


@query("wasserstein", f"SELECT feature, {r('wasserstein_distance')} AS wasserstein_distance FROM distance_v WHERE split = 'test'")
def wasserstein(d):
    long = drift.long_numeric(d.supervised, ["split"], NUMERIC)
    return drift.two_sample(long, ["feature"], "split", "train", "test").select("feature", "wasserstein_distance")


@query(
    "numeric_drift",
    f"SELECT split, feature, train_rows, compared_rows, {rs('train_mean', 'compared_mean', 'standardized_mean_shift', 'ks_statistic', 'wasserstein_distance')}, {r(ks_p_sql('x'))} AS ks_p_value, status FROM numeric_drift_v",
)
def numeric_drift(d):
    return drift.numeric_drift(d.supervised, NUMERIC, COMPARED)


cte(
    "cat_long_v",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, split, coalesce(CAST({c} AS VARCHAR), '__missing__') AS value FROM sup_v" for c in TEXT),
)
cte(
    "cat_share_v",
    """SELECT feature, value, n_train, n_validation, n_test, n_train/sum(n_train) OVER p AS p_train, n_validation/sum(n_validation) OVER p AS p_validation, n_test/sum(n_test) OVER p AS p_test
 FROM (SELECT feature, value, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'validation') AS n_validation, count(*) FILTER (WHERE split = 'test') AS n_test
 FROM cat_long_v GROUP BY 1, 2) WINDOW p AS (PARTITION BY feature)""",
)
cte(
    "cat_drift_v",
    " UNION ALL ".join(
        f"""SELECT '{s}' AS split, feature, count(*) FILTER (WHERE n_train > 0) AS train_categories, count(*) FILTER (WHERE n_{s} > 0) AS compared_categories,
 greatest(sum(CASE WHEN p_train > 0 THEN p_train*log2(2*p_train/(p_train + p_{s})) ELSE 0 END + CASE WHEN p_{s} > 0 THEN p_{s}*log2(2*p_{s}/(p_train + p_{s})) ELSE 0 END)/2, 0.0) AS jensen_shannon_divergence,
 max(abs(p_{s} - p_train)) AS max_category_share_delta FROM cat_share_v GROUP BY feature"""
        for s in COMPARED
    ),
)
_CAT_STATUS = status_sql(("jensen_shannon_divergence", "js"), ("max_category_share_delta", "share"))


@query(
    "categorical_drift",
    f"SELECT split, feature, train_categories, compared_categories, {rs('jensen_shannon_divergence', 'max_category_share_delta')}, {_CAT_STATUS} AS status FROM cat_drift_v",
)
def categorical_drift(d):
    return drift.categorical_drift(d.supervised, TEXT, COMPARED)


_DIRTY = [f.name for f in S.QUOTES.fields]
cte("dirty_split_v", "SELECT *, CASE WHEN year(requested_date) <= 1998 THEN 'train' WHEN year(requested_date) = 1999 THEN 'validation' ELSE 'test' END AS split FROM dirty_quotes_v")
cte(
    "missing_v",
    " UNION ALL ".join(
        f"""SELECT '{s}' AS split, '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 1.0E0 ELSE 0.0E0 END) FILTER (WHERE split = 'train') AS train_missing_rate,
 avg(CASE WHEN {c} IS NULL THEN 1.0E0 ELSE 0.0E0 END) FILTER (WHERE split = '{s}') AS compared_missing_rate FROM dirty_split_v"""
        for s in COMPARED
        for c in _DIRTY
    ),
)
_MISS_STATUS = status_sql(("compared_missing_rate - train_missing_rate", "missing"))


@query(
    "missingness_drift",
    f"SELECT split, feature, {rs('train_missing_rate', 'compared_missing_rate')}, {r('compared_missing_rate - train_missing_rate')} AS missing_rate_delta, {_MISS_STATUS} AS status FROM missing_v",
)
def missingness_drift(d):
    from quotelens.operators.splits import temporal_split

    return drift.missingness_drift(temporal_split(d.dirty_quotes, d.split_years), _DIRTY, COMPARED)


@query("drift_status", "SELECT split, feature, status FROM numeric_drift_v")
def drift_status(d):
    return drift.numeric_drift(d.supervised, NUMERIC, COMPARED).select("split", "feature", "status")


@query(
    "drift_status_counts",
    f"""SELECT 'numeric_drift' AS "table", status, count(*) AS row_count FROM numeric_drift_v GROUP BY 2 UNION ALL SELECT 'categorical_drift', {_CAT_STATUS} AS status, count(*) FROM cat_drift_v GROUP BY 2
 UNION ALL SELECT 'missingness_drift', {_MISS_STATUS} AS status, count(*) FROM missing_v GROUP BY 2""",
)
def drift_status_counts(d):
    from quotelens.operators.splits import temporal_split

    return drift.drift_status_counts(
        numeric_drift=drift.numeric_drift(d.supervised, NUMERIC, COMPARED),
        categorical_drift=drift.categorical_drift(d.supervised, TEXT, COMPARED),
        missingness_drift=drift.missingness_drift(temporal_split(d.dirty_quotes, d.split_years), _DIRTY, COMPARED),
    )


# ---- features ------------------------------------------------------------------------

_CASTS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in REG.numeric)
_LIST = ", ".join(REG.numeric)
cte(
    "flong_v",
    f"SELECT * FROM (SELECT segment, split, target, {_CASTS} FROM model_v) UNPIVOT INCLUDE NULLS (value FOR feature IN ({_LIST}))",
)


def corr_sql(x: str, y: str, where: str) -> str:
    both = f"{where} AND {x} IS NOT NULL AND {y} IS NOT NULL"
    return (
        f"CASE WHEN min({x}) FILTER (WHERE {both}) < max({x}) FILTER (WHERE {both}) AND min({y}) FILTER (WHERE {both}) < max({y}) FILTER (WHERE {both})"
        f" THEN corr({y}, {x}) FILTER (WHERE {both}) END"
    )


cte(
    "fdrift_v",
    f"""SELECT m.*, e.ks_statistic, e.wasserstein_distance FROM (SELECT segment, feature,
 {', '.join(f"avg(value) FILTER (WHERE split = '{s}') AS {s}_mean, quantile_cont(value, 0.95) FILTER (WHERE split = '{s}') AS {s}_p95, avg(CASE WHEN value IS NULL THEN 1.0E0 ELSE 0.0E0 END) FILTER (WHERE split = '{s}') AS {s}_missing_rate, count(value) FILTER (WHERE split = '{s}') AS n_{s}, " + corr_sql('value', 'target', f"split = '{s}'") + f" AS {s}_target_corr" for s in ("train", "validation"))},
 CASE WHEN min(value) FILTER (WHERE split = 'train') < max(value) FILTER (WHERE split = 'train') THEN stddev_pop(value) FILTER (WHERE split = 'train') END AS sd
 FROM flong_v WHERE segment IN ('single','worst_of') GROUP BY 1, 2) m LEFT JOIN (SELECT segment, feature, max(abs(ft - fv)) AS ks_statistic, sum(abs(ft - fv)*coalesce(step, 0)) AS wasserstein_distance FROM (
 SELECT segment, feature, lead(value) OVER w - value AS step, sum(nt) OVER w/sum(nt) OVER p AS ft, sum(nv) OVER w/sum(nv) OVER p AS fv FROM (SELECT segment, feature, value,
 count(*) FILTER (WHERE split = 'train') AS nt, count(*) FILTER (WHERE split = 'validation') AS nv FROM flong_v WHERE value IS NOT NULL AND split <> 'test' GROUP BY 1, 2, 3)
 WINDOW w AS (PARTITION BY segment, feature ORDER BY value), p AS (PARTITION BY segment, feature)) GROUP BY 1, 2) e ON e.segment = m.segment AND e.feature = m.feature""",
)
_SHIFT = "(validation_mean - train_mean)/sd"


@query(
    "feature_drift",
    f"""SELECT segment, feature, {rs('train_mean', 'validation_mean', 'train_p95', 'validation_p95', 'train_missing_rate', 'validation_missing_rate', 'ks_statistic', 'wasserstein_distance', 'train_target_corr', 'validation_target_corr')},
 {r('validation_missing_rate - train_missing_rate')} AS missing_rate_delta, {r(_SHIFT)} AS validation_shift_in_train_sd, {r(f'abs({_SHIFT})')} AS abs_validation_shift_in_train_sd FROM fdrift_v""",
)
def feature_drift(d):
    return drift.feature_drift(d.model_frame, list(REG.numeric)).drop("ks_p_value")


_C1, _C2 = "train_target_corr", "validation_target_corr"


@query(
    "correlation_stability",
    f"""SELECT segment, feature, {rs(_C1, _C2)}, CASE WHEN {_C1} IS NOT NULL AND {_C2} IS NOT NULL THEN {r(f'abs({_C1} - {_C2})')} WHEN {_C1} IS NOT NULL OR {_C2} IS NOT NULL THEN 0.0E0 END AS corr_range,
 coalesce({_C1}*{_C2} < 0, false) AS validation_sign_flip_vs_train, {r(f'abs({_SHIFT})')} AS abs_validation_shift_in_train_sd FROM fdrift_v""",
)
def correlation_stability(d):
    return drift.correlation_stability(drift.feature_drift(d.model_frame, list(REG.numeric)))


_CONSTANT = "CASE WHEN split = 'test' THEN 1.0E0 ELSE notional_credits END"


@query(
    "pearson_safe",
    f"SELECT split, {r(corr_sql('quoted_implied_vol', 'avg_duration_months', 'true'))} AS varying, {r(corr_sql('c', 'avg_duration_months', 'true'))} AS constant_in_test FROM (SELECT *, {_CONSTANT} AS c FROM sup_v) GROUP BY split",
)
def pearson_safe(d):
    constant = F.when(F.col("split") == "test", 1.0).otherwise(F.col("notional_credits"))
    return d.supervised.withColumn("c", constant).groupBy("split").agg(
        association.pearson_terms(F.col("quoted_implied_vol"), F.col(S.TARGET)).alias("varying"),
        association.pearson_terms(F.col("c"), F.col(S.TARGET)).alias("constant_in_test"),
    )


@query(
    "target_correlations",
    f"SELECT feature, {r(corr_sql('value', 'target', 'true'))} AS correlation_with_target FROM flong_v WHERE split <> 'test' GROUP BY feature",
)
def target_correlations(d):
    """One pass over the numbers, which are therefore not stored."""
    rows = d.model_columns("split", "target", *REG.numeric).where("split <> 'test'")
    return association.target_correlations(rows, list(REG.numeric), "target")


cte("pairs_v", "SELECT feature, split, segment, value, target FROM flong_v WHERE value IS NOT NULL AND target IS NOT NULL")


def _rank_sql(keys: str, source: str) -> str:
    return f"""SELECT {keys}, count(*) AS pair_rows, CASE WHEN min(value) < max(value) AND min(target) < max(target) THEN corr(ry, rx) END AS rho FROM (
 SELECT {keys}, value, target, rank() OVER (PARTITION BY {keys} ORDER BY value) + (count(*) OVER (PARTITION BY {keys}, value) - 1)/2.0E0 AS rx,
 rank() OVER (PARTITION BY {keys} ORDER BY target) + (count(*) OVER (PARTITION BY {keys}, target) - 1)/2.0E0 AS ry FROM {source}) GROUP BY {keys}"""


cte("train_pairs_v", "SELECT * FROM pairs_v WHERE split = 'train'")
cte("rho_v", _rank_sql("feature", "train_pairs_v"))


@query(
    "avg_rank",
    f"""SELECT split, notional_credits, {r("rank() OVER (PARTITION BY split ORDER BY notional_credits) + (count(*) OVER (PARTITION BY split, notional_credits) - 1)/2.0E0")} AS average_rank, rfq_id FROM sup_v""".replace(
        "notional_credits,", f"{r('notional_credits')} AS notional_credits,", 1
    ),
)
def avg_rank(d):
    from quotelens.operators.ordered import null_safe_join

    counts = value_counts(d.supervised, ["split"], "notional_credits")
    ranks = running_sums(counts, ["split"], "notional_credits", ["n"]).select(
        "split", "notional_credits", fn.average_rank(F.col("n_before"), F.col("n")).alias("average_rank")
    )
    rows = d.supervised.select("rfq_id", "split", "notional_credits")
    return null_safe_join(rows, ranks, ["split", "notional_credits"])


@query("spearman", f"SELECT feature, pair_rows, {r('rho')} AS spearman FROM rho_v")
def spearman(d):
    train = d.model_frame.where("split = 'train'")
    return association.spearman(drift.long_numeric(train, ["target"], list(REG.numeric)), ["feature"])


_DIRECTION = "CASE WHEN rho IS NULL THEN 'not_applicable' WHEN rho > 0.05 THEN 'positive' WHEN rho < -0.05 THEN 'negative' ELSE 'mixed_or_flat' END"
cte("ctext_v", f"SELECT * FROM (SELECT segment, split, target, {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in REG.categorical)} FROM model_v) UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(REG.categorical)}))")
cte(
    "signal_report_v",
    f"""SELECT f.feature, 'numeric' AS feature_type, rho AS train_target_spearman, {_DIRECTION} AS target_correlation_direction, count(DISTINCT f.value) AS n_unique,
 avg(CASE WHEN f.value IS NULL THEN 1.0E0 ELSE 0.0E0 END) AS missing_rate FROM flong_v f LEFT JOIN rho_v r ON r.feature = f.feature WHERE f.split = 'train' GROUP BY f.feature, rho
 UNION ALL SELECT feature, 'categorical', NULL, 'categorical_not_ordered', count(DISTINCT value), avg(CASE WHEN value IS NULL THEN 1.0E0 ELSE 0.0E0 END) FROM ctext_v WHERE split = 'train' GROUP BY feature""",
)


@query("feature_signal_report", f"SELECT feature, feature_type, {r('train_target_spearman')} AS train_target_spearman, target_correlation_direction, n_unique, {r('missing_rate')} AS missing_rate FROM signal_report_v")
def feature_signal_report(d):
    train = d.model_frame.where("split = 'train'")
    return association.feature_signal_report(train, list(REG.numeric), list(REG.categorical), "target")


def _signal_sql(keys: str, numbers: str, texts: str) -> str:
    comma = f"{keys}, " if keys else ""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in [*keys.split(","), "feature"] if k.strip())
    return f"""SELECT {comma}feature, 'numeric' AS feature_type, CASE WHEN pair_rows >= 30 THEN abs(rho) END AS signal FROM ({_rank_sql(comma + 'feature', numbers)})
 UNION ALL SELECT a.* EXCLUDE (n, sd, varies), CASE WHEN a.n >= 30 AND a.varies AND b.g >= 2 THEN b.span/a.sd END FROM (SELECT {comma}feature, 'categorical' AS feature_type, count(*) AS n, stddev_samp(target) AS sd, min(target) < max(target) AS varies FROM {texts} GROUP BY {comma}feature) a
 LEFT JOIN (SELECT {comma}feature, max(m) - min(m) AS span, count(*) AS g FROM (SELECT {comma}feature, value, median(target) AS m FROM {texts} GROUP BY {comma}feature, value HAVING count(*) >= 20) GROUP BY {comma}feature) b ON {on}"""


cte("train_texts_v", "SELECT * FROM ctext_v WHERE split = 'train' AND value IS NOT NULL AND target IS NOT NULL")
cte("signal_v", _signal_sql("", "train_pairs_v", "train_texts_v"))


@query("feature_signal", f"SELECT feature, feature_type, {r('signal')} AS signal FROM signal_v")
def feature_signal(d):
    train = d.model_frame.where("split = 'train'")
    return association.feature_signal(train, list(REG.numeric), list(REG.categorical))


_SCOPED = "SELECT {c}, 'global' AS scope FROM {t} WHERE split <> 'test' UNION ALL SELECT {c}, segment AS scope FROM {t} WHERE split <> 'test' AND segment <> 'other'"
_BLOCKS = ("all_without_noise", "compact_core", "worst_of_core")
_WANTED = set().union(*[REG.block_columns(b) for b in _BLOCKS])
_IN = ", ".join(f"'{c}'" for c in sorted(_WANTED))
cte("scope_pairs_v", f"SELECT * FROM ({_SCOPED.format(c='feature, split, value, target', t='pairs_v')}) WHERE feature IN ({_IN})")
cte("scope_texts_v", f"SELECT * FROM ({_SCOPED.format(c='feature, split, value, target', t='ctext_v')}) WHERE feature IN ({_IN}) AND value IS NOT NULL AND target IS NOT NULL")
cte("scope_signal_v", _signal_sql("scope, split", "scope_pairs_v", "scope_texts_v"))
_WIDE = ", ".join(
    f"max(CASE WHEN scope = '{sc}' AND split = '{sp}' THEN signal END) AS {sc}_{sp}_signal" for sp in ("train", "validation") for sc in association.SCOPES
)


def _block_in(block):
    return "feature IN (" + ", ".join(f"'{c}'" for c in sorted(REG.block_columns(block))) + ")"


_BEST = "greatest(round(global_train_signal, 9), round(single_train_signal, 9), round(worst_of_train_signal, 9))"


@query(
    "feature_signal_by_scope",
    f"""SELECT feature, feature_type, {rs(*[f'{sc}_{sp}_signal' for sp in ('train', 'validation') for sc in association.SCOPES])}, {', '.join(f'{_block_in(b)} AS in_{b}' for b in _BLOCKS)},
 concat_ws('+', {', '.join(f"CASE WHEN {_block_in(b)} THEN '{b}' END" for b in _BLOCKS)}) AS presence_pattern,
 CASE {' '.join(f"WHEN round({sc}_train_signal, 9) = {_BEST} THEN '{sc}'" for sc in association.SCOPES)} ELSE '' END AS highest_train_signal_scope FROM (SELECT feature, feature_type, {_WIDE} FROM scope_signal_v GROUP BY feature, feature_type)""",
)
def feature_signal_by_scope(d):
    return association.feature_signal_by_scope(d.model_frame, REG)


# ---- independence tests --------------------------------------------------------------

cte(
    "bias_cells_v",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, coalesce({c}, '__missing__') AS value, CAST(count(*) FILTER (WHERE executed) AS DOUBLE) AS o1, CAST(count(*) FILTER (WHERE NOT executed) AS DOUBLE) AS o0 FROM quotes_v GROUP BY 2"
        for c in S.BIAS_CATEGORICAL
    ),
)


def _cell(o, t):
    e = f"({t}*(o1 + o0)/(t1 + t0))"
    gap = f"abs({o} - {e})"
    return f"CASE WHEN k = 2 THEN ({gap} - least({gap}, 0.5E0))^2 ELSE {gap}^2 END/{e}"


cte(
    "chi2_v",
    f"""SELECT feature, sum({_cell('o1', 't1')} + {_cell('o0', 't0')}) AS statistic, max(k) - 1 AS dof FROM (SELECT *, sum(o1) OVER p AS t1, sum(o0) OVER p AS t0, count(*) OVER p AS k FROM bias_cells_v WINDOW p AS (PARTITION BY feature)) GROUP BY feature""",
)
_A, _X = "(dof/2.0E0)", "(statistic/2.0E0)"
CHI2_P = f"1.0E0 - list_sum([exp({_A}*ln({_X}) - {_X} + n*ln({_X}) - lgamma({_A} + n + 1.0E0)) FOR n IN range(0, 400)])"


@query("chi2_independence", f"SELECT feature, {r('statistic')} AS statistic, dof, {r(CHI2_P)} AS p_value FROM chi2_v")
def chi2_independence(d):
    return association.chi2_independence(d.quotes, "executed", S.BIAS_CATEGORICAL)


cte("bias_long_v", " UNION ALL ".join(f"SELECT '{c}' AS feature, executed, CAST({c} AS DOUBLE) AS value FROM quotes_v" for c in S.BIAS_NUMERIC))
cte(
    "bias_v",
    f"""SELECT e.feature AS variable, 'ks_2samp' AS test, m.n1 AS n_executed_true, m.n0 AS n_executed_false, m.m1 AS mean_executed_true, m.m0 AS mean_executed_false, e.d AS statistic,
 {ks_p_sql('(sqrt(CAST(m.n1 AS DOUBLE)*m.n0/(m.n1 + m.n0))*e.d)')} AS p_value FROM (SELECT feature, max(abs(f1 - f0)) AS d FROM (SELECT feature, sum(c1) OVER w/sum(c1) OVER p AS f1, sum(c0) OVER w/sum(c0) OVER p AS f0
 FROM (SELECT feature, value, count(*) FILTER (WHERE executed) AS c1, count(*) FILTER (WHERE NOT executed) AS c0 FROM bias_long_v GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature ORDER BY value), p AS (PARTITION BY feature)) GROUP BY feature) e
 JOIN (SELECT feature, count(value) FILTER (WHERE executed) AS n1, count(value) FILTER (WHERE NOT executed) AS n0, avg(value) FILTER (WHERE executed) AS m1, avg(value) FILTER (WHERE NOT executed) AS m0 FROM bias_long_v GROUP BY feature) m ON m.feature = e.feature
 UNION ALL SELECT feature, 'chi2_contingency', (SELECT count(*) FROM quotes_v WHERE executed), (SELECT count(*) FROM quotes_v WHERE NOT executed), NULL, NULL, statistic, {CHI2_P} FROM chi2_v""",
)


@query(
    "selection_bias",
    f"""SELECT variable, test, n_executed_true, n_executed_false, {rs('mean_executed_true', 'mean_executed_false', 'statistic', 'p_value')}, p_value < 0.05 AS significant_alpha, p_value < 0.005 AS significant_bonferroni,
 {r('least(1.0E0, p_value*10)')} AS adjusted_p_value FROM bias_v""",
)
def selection_bias(d):
    return association.selection_bias(d.quotes)
