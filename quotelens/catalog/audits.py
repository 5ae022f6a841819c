"""Populations, splits, folds and descriptive tables."""

from pyspark.sql import functions as F

from quotelens import functions as fn
from quotelens import schema as S
from quotelens.catalog.base import SPLIT_CASE, cte, freq_sql, label_sql, query, r, rs
from quotelens.catalog.expressions import DURATION_OPEN, JOINED
from quotelens.operators import audit, splits

# ---- populations ---------------------------------------------------------------------


@query("flt_trainable", "SELECT rfq_id FROM dirty_quotes_v WHERE executed AND avg_duration_months IS NOT NULL")
def flt_trainable(d):
    return splits.trainable(d.dirty_quotes).select("rfq_id")


@query("flt_executed_only", "SELECT rfq_id, executed FROM dirty_quotes_v WHERE executed IS NOT DISTINCT FROM true")
def flt_executed_only(d):
    return splits.executed_only(d.dirty_quotes).select("rfq_id", "executed")


@query("flt_exclude_test", "SELECT rfq_id, split FROM sup_v WHERE split <> 'test'")
def flt_exclude_test(d):
    return splits.exclude_test(d.supervised).select("rfq_id", "split")


@query("flt_decision_splits", "SELECT rfq_id, split FROM sup_v WHERE split IN ('train','validation')")
def flt_decision_splits(d):
    return splits.decision_rows(d.supervised).select("rfq_id", "split")


@query("flt_segment", "SELECT rfq_id, segment, split FROM sup_v WHERE segment = 'worst_of' AND split = 'train'")
def flt_segment(d):
    return d.supervised.where("segment = 'worst_of' and split = 'train'").select("rfq_id", "segment", "split")


# ---- splits and folds ----------------------------------------------------------------


@query("temporal_split", f"SELECT rfq_id, {SPLIT_CASE.format(d='requested_date')} AS split FROM quotes_v")
def temporal_split(d):
    return splits.temporal_split(d.quotes, d.split_years).select("rfq_id", "split")


@query(
    "temporal_split_fallback",
    """SELECT rfq_id, CASE WHEN k < floor(n*0.7) THEN 'train' WHEN k < floor(n*0.85) THEN 'validation' ELSE 'test' END AS split FROM (
 SELECT rfq_id, row_number() OVER (ORDER BY requested_date, md5(CAST(rfq_id AS VARCHAR))) - 1 AS k, CAST((SELECT count(*) FROM quotes_v) AS DOUBLE) AS n FROM quotes_v)""",
)
def temporal_split_fallback(d):
    return splits.chronological_split(d.quotes).select("rfq_id", "split")


@query(
    "rolling_folds",
    "SELECT q.rfq_id, f.validation_year, f.train_end_year, f.role FROM sup_v q JOIN fold_map_v f ON f.year = year(q.requested_date)",
)
def rolling_folds(d):
    return splits.rolling_folds(d.supervised, d.split_years).select("rfq_id", "validation_year", "train_end_year", "role")


_FOLD = "'train<=' || f.train_end_year || ', validation=' || f.validation_year"


def _mix_sql(column):
    return f"""(SELECT fold, string_agg(v || ': ' || n || ' (' || printf('%.1f', round(100.0E0*n/t, 2)) || '%)', '; ' ORDER BY n DESC, v) AS txt FROM (
 SELECT {_FOLD} AS fold, q.{column} AS v, count(*) AS n, sum(count(*)) OVER (PARTITION BY {_FOLD}) AS t FROM dev_v q
 JOIN dev_folds_v f ON f.year = q.requested_year WHERE f.role = 'validation' GROUP BY 1, 2) GROUP BY fold)"""


cte("dev_folds_v", "SELECT * FROM fold_map_v")
cte("fold_names_v", f"SELECT DISTINCT {_FOLD} AS fold, f.validation_year FROM dev_folds_v f")


def _seen_sql(source, value):
    return f"""SELECT n.fold, v.value, bool_or(v.y < n.validation_year) AS in_train, bool_or(v.y = n.validation_year) AS in_validation
 FROM fold_names_v n, (SELECT DISTINCT {value} AS value, requested_year AS y FROM {source}) v GROUP BY n.fold, v.value"""


cte("fold_products_v", _seen_sql("dev_v", "product_type"))
cte("fold_members_v", _seen_sql("dev_members_v", "underlying"))


def _listed(table, condition):
    return f"coalesce((SELECT {JOINED.format(l='v')} FROM (SELECT list_sort(list(value)) AS v FROM {table} s WHERE s.fold = n.fold AND {condition})), '')"


@query(
    "rolling_audit",
    f"""SELECT n.fold, n.validation_year,
 (SELECT CASE WHEN min(year) = max(year) THEN CAST(min(year) AS VARCHAR) ELSE min(year) || '-' || max(year) END FROM dev_folds_v f WHERE f.validation_year = n.validation_year AND role = 'train') AS train_years,
 (SELECT count(*) FROM dev_v q WHERE q.requested_year < n.validation_year) AS train_rows,
 (SELECT count(*) FROM dev_v q WHERE q.requested_year = n.validation_year) AS validation_rows,
 p.txt AS validation_product_distribution, b.txt AS validation_basket_distribution,
 (SELECT count(*) FROM fold_members_v s WHERE s.fold = n.fold AND in_validation) AS validation_underlyings,
 {_listed('fold_products_v', 'in_validation AND NOT in_train')} AS unseen_products_in_validation,
 {_listed('fold_members_v', 'in_validation AND NOT in_train')} AS unseen_underlyings_in_validation,
 {_listed('fold_products_v', 'NOT in_validation')} AS products_absent_from_validation,
 {_listed('fold_members_v', 'NOT in_validation')} AS underlyings_absent_from_validation
 FROM fold_names_v n LEFT JOIN {_mix_sql('product_type')} p ON p.fold = n.fold LEFT JOIN {_mix_sql('basket_type')} b ON b.fold = n.fold""",
)
def rolling_audit(d):
    return audit.rolling_audit(d.development, d.split_years)


cte(
    "presence_v",
    """SELECT basket_type, underlying, bool_or(split = 'train') AS in_train, bool_or(split = 'validation') AS in_validation FROM dev_members_v GROUP BY basket_type, underlying""",
)
cte(
    "viability_v",
    f"""SELECT *, (train_rows >= 1000)::INT + (validation_rows >= 200)::INT + (years >= 3)::INT + (products >= 1)::INT + (underlyings_present >= 1)::INT + (len(missing) = 0)::INT AS viability_checks_passed
 FROM (SELECT basket_type AS segment, count(*) AS total_rows, count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'validation') AS validation_rows,
 count(DISTINCT requested_year) AS years, CASE WHEN min(requested_year) = max(requested_year) THEN CAST(min(requested_year) AS VARCHAR) ELSE min(requested_year) || '-' || max(requested_year) END AS years_present,
 count(DISTINCT product_type) AS products, list_sort(list_distinct(list(product_type))) AS product_list,
 (SELECT count(*) FROM presence_v p WHERE p.basket_type = s.basket_type) AS underlyings_present,
 coalesce((SELECT list_sort(list(underlying)) FROM presence_v p WHERE p.basket_type = s.basket_type AND in_validation AND NOT in_train), []) AS missing,
 avg(avg_duration_months) AS target_mean, median(avg_duration_months) AS target_median, stddev_samp(avg_duration_months) AS target_std FROM dev_v s GROUP BY basket_type)""",
)


@query(
    "segment_viability",
    f"""SELECT segment, total_rows, train_rows, validation_rows, years_present, {JOINED.format(l='product_list')} AS products_present, underlyings_present,
 {rs('target_mean', 'target_median', 'target_std')}, {JOINED.format(l='missing')} AS missing_validation_underlyings_in_train, viability_checks_passed, 6 AS viability_checks_total,
 viability_checks_passed = 6 AS is_viable_for_segment_model, CASE WHEN viability_checks_passed = 6 THEN 'viable_to_test' ELSE 'keep_global_or_compare_carefully' END AS recommendation FROM viability_v""",
)
def segment_viability(d):
    return audit.segment_viability(d.development)


cte(
    "product_viability_v",
    f"""SELECT product_type, count(*) AS total_rows, count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'validation') AS validation_rows,
 count(DISTINCT requested_year) AS years_present, list_sort(list_distinct(list(basket_type))) AS bl FROM dev_v GROUP BY product_type""",
)


@query(
    "product_viability",
    f"SELECT * EXCLUDE (bl), {JOINED.format(l='bl')} AS basket_types, train_rows >= 1000 AND validation_rows >= 200 AND years_present >= 3 AS is_viable_for_product_model FROM product_viability_v",
)
def product_viability(d):
    return audit.product_viability(d.development)


@query(
    "split_findings",
    f"""SELECT rule, {r('observed')} AS observed, {r('threshold')} AS threshold, passed FROM (
 SELECT 'top_product_share' AS rule, max(n)/sum(n) AS observed, 0.35E0 AS threshold, max(n)/sum(n) <= 0.35 AS passed FROM (SELECT count(*) AS n FROM dev_v GROUP BY product_type)
 UNION ALL SELECT 'top_year_share', max(n)/sum(n), 0.25E0, max(n)/sum(n) <= 0.25 FROM (SELECT count(*) AS n FROM dev_v GROUP BY requested_year)
 UNION ALL SELECT 'missing_members_' || split, CAST((SELECT count(DISTINCT underlying) FROM dev_members_v) - count(DISTINCT underlying) AS DOUBLE), 0.0E0,
 (SELECT count(DISTINCT underlying) FROM dev_members_v) = count(DISTINCT underlying) FROM dev_members_v GROUP BY split
 UNION ALL SELECT 'rolling_folds', CAST(count(*) AS DOUBLE), 1.0E0, count(*) >= 1 FROM fold_names_v
 UNION ALL SELECT 'segment_viable_' || segment, CAST(viability_checks_passed AS DOUBLE), 6.0E0, viability_checks_passed = 6 FROM viability_v
 UNION ALL SELECT 'viable_products', CAST(count(*) FILTER (WHERE ok) AS DOUBLE), CAST(count(*) AS DOUBLE), count(*) FILTER (WHERE ok) = count(*) FROM (SELECT train_rows >= 1000 AND validation_rows >= 200 AND years_present >= 3 AS ok FROM product_viability_v))""",
)
def split_findings(d):
    return audit.split_findings(d.development, d.split_years)


# ---- target --------------------------------------------------------------------------

_T = "avg_duration_months"


def _labelled(d):
    frame = d.supervised.withColumn("target", F.col(_T))
    return frame.withColumn("duration_bucket", fn.duration_bucket(F.col("target"), open_start=True))


cte("lab_v", f"SELECT *, avg_duration_months AS target, {DURATION_OPEN} AS duration_bucket FROM sup_v")

_DIST = f"""count(*) AS row_count, {r('avg(target)')} AS mean, {r('stddev_samp(target)')} AS std, {r('min(target)')} AS min, {r('max(target)')} AS max,
 {r('quantile_cont(target, 0.10)')} AS p10, {r('quantile_cont(target, 0.25)')} AS p25, {r('quantile_cont(target, 0.5)')} AS median, {r('quantile_cont(target, 0.75)')} AS p75,
 {r('quantile_cont(target, 0.90)')} AS p90, {r('quantile_cont(target, 0.95)')} AS p95, {r('avg(CASE WHEN target >= 60 THEN 1.0E0 ELSE 0.0E0 END)')} AS duration_60_plus_rate"""


@query("target_distribution", f"SELECT segment, split, {_DIST} FROM lab_v GROUP BY segment, split")
def target_distribution(d):
    return audit.target_distribution(_labelled(d), ["segment", "split"])


@query("target_distribution_by_product", f"SELECT product_type, segment, split, {_DIST} FROM lab_v GROUP BY product_type, segment, split")
def target_distribution_by_product(d):
    return audit.target_distribution(_labelled(d), ["product_type", "segment", "split"])


cte(
    "fence_v",
    """SELECT segment, q1 - 1.5E0*(q3 - q1) AS low_threshold, q3 + 1.5E0*(q3 - q1) AS high_threshold FROM (
 SELECT segment, quantile_cont(target, 0.25) AS q1, quantile_cont(target, 0.75) AS q3 FROM lab_v WHERE split = 'train' GROUP BY segment)""",
)


@query(
    "outlier_summary",
    f"""SELECT l.segment, l.split, count(*) AS row_count, {r('min(low_threshold)')} AS low_threshold, {r('min(high_threshold)')} AS high_threshold,
 count(*) FILTER (WHERE target < low_threshold OR target > high_threshold) AS outlier_rows,
 {r('avg(CASE WHEN target < low_threshold OR target > high_threshold THEN 1.0E0 ELSE 0.0E0 END)')} AS outlier_rate,
 count(*) FILTER (WHERE target >= 60) AS duration_60_plus_rows, {r('avg(CASE WHEN target >= 60 THEN 1.0E0 ELSE 0.0E0 END)')} AS duration_60_plus_rate
 FROM lab_v l LEFT JOIN fence_v f ON f.segment = l.segment GROUP BY l.segment, l.split""",
)
def outlier_summary(d):
    return audit.outlier_summary(_labelled(d))


@query(
    "outlier_rows",
    f"SELECT l.segment, l.split, l.rfq_id, l.requested_date, l.product_type, {r('l.target')} AS target, {r('f.high_threshold')} AS segment_high_outlier_threshold FROM lab_v l JOIN fence_v f ON f.segment = l.segment WHERE l.target > f.high_threshold",
)
def outlier_rows(d):
    return audit.outlier_rows(_labelled(d), ["rfq_id", "requested_date", "product_type"])


_MIX = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", segment, split, {c} AS value, count(*) AS n FROM lab_v GROUP BY segment, split, {c}" for c in audit.MIX_COLUMNS[:3]
) + """ UNION ALL SELECT 'duration_bucket', g.segment, g.split, v.value, count(l.rfq_id) FROM (SELECT DISTINCT segment, split FROM lab_v) g
 CROSS JOIN (VALUES ('<=12'),('12-24'),('24-36'),('36-60'),('60+')) v(value) LEFT JOIN lab_v l ON l.segment = g.segment AND l.split = g.split AND l.duration_bucket = v.value GROUP BY 2, 3, 4"""


@query("categorical_mix", f"SELECT \"column\", segment, split, value, n AS row_count, {r('n/sum(n) OVER (PARTITION BY \"column\", segment, split)')} AS share FROM ({_MIX})")
def categorical_mix(d):
    return audit.categorical_mix(_labelled(d))


@query("share_in_group", f"SELECT segment, split, product_type, n, {r('n/sum(n) OVER (PARTITION BY segment, split)')} AS share FROM (SELECT segment, split, product_type, count(*) AS n FROM lab_v GROUP BY 1, 2, 3)")
def share_in_group(d):
    counts = d.supervised.groupBy("segment", "split", "product_type").agg(F.count(F.lit(1)).alias("n"))
    return audit.share_in_group(counts, ["segment", "split"], "n")


# ---- categories ----------------------------------------------------------------------

_QCOLS = {
    "product_type": "product_type",
    "basket_type": "basket_type",
    "observation_frequency_clean": label_sql(freq_sql("observation_frequency")),
    "counterparty": "counterparty",
    "trader_id": "trader_id",
    "underlyings": "underlyings",
}
cte(
    "cats_v",
    " UNION ALL ".join(f"SELECT '{n}' AS feature, 'rfq' AS observation_level, {c} AS value, split, avg_duration_months AS target FROM sup_v" for n, c in _QCOLS.items())
    + """ UNION ALL SELECT 'underlying', 'underlying', u, q.split, q.avg_duration_months FROM sup_v q, unnest(string_split(q.underlyings, '|')) AS t(u)
 UNION ALL SELECT 'sector', 'underlying', dm.sector, q.split, q.avg_duration_months FROM sup_v q, unnest(string_split(q.underlyings, '|')) AS t(u) LEFT JOIN dimension_v dm ON dm.underlying = t.u""",
)


@query(
    "categorical_summary",
    f"""SELECT feature, observation_level, count(*) AS cardinality, count(*) FILTER (WHERE n < 20) AS rare_categories_lt_20,
 arg_min(value, struct_pack(a := -n, b := value)) AS top_category, max(n) AS top_category_count, {r('max(m) - min(m)')} AS target_mean_range
 FROM (SELECT feature, observation_level, value, count(*) AS n, avg(target) AS m FROM cats_v WHERE split <> 'test' GROUP BY 1, 2, 3) GROUP BY feature, observation_level""",
)
def categorical_summary(d):
    return audit.categorical_summary(d.development, d.dimension)


@query("temporal_category_counts", "SELECT split, feature, observation_level, value AS category, count(*) AS count FROM cats_v GROUP BY 1, 2, 3, 4")
def temporal_category_counts(d):
    return audit.temporal_category_counts(d.supervised, d.dimension)


_UNSEEN = """SELECT c.feature, c.split, c.observation_level, count(DISTINCT c.value) FILTER (WHERE t.value IS NULL) AS unseen_categories,
 count(*) FILTER (WHERE t.value IS NULL) AS affected_rows, {share} AS affected_row_share,
 coalesce(array_to_string(list_slice(list_sort(list_distinct(list(c.value) FILTER (WHERE t.value IS NULL))), 1, 25), '|'), '') AS unseen_category_values
 FROM cats_v c LEFT JOIN (SELECT DISTINCT feature, value FROM cats_v WHERE split = 'train') t ON t.feature = c.feature AND t.value = c.value
 WHERE c.split IN ('validation','test') GROUP BY c.feature, c.split, c.observation_level"""


@query("unseen_categories", _UNSEEN.format(share=r("count(*) FILTER (WHERE t.value IS NULL)/count(*)")))
def unseen_categories(d):
    return audit.unseen_categories(d.supervised, d.dimension, include_test=True)


@query(
    "unseen_left_anti",
    """SELECT DISTINCT underlyings, trader_id FROM sup_v v WHERE split = 'validation' AND NOT EXISTS (SELECT 1 FROM sup_v t
 WHERE t.split = 'train' AND t.underlyings = v.underlyings AND t.trader_id = v.trader_id)""",
)
def unseen_left_anti(d):
    pair = ["underlyings", "trader_id"]
    later, train = d.supervised.where("split = 'validation'"), d.supervised.where("split = 'train'")
    return later.join(train.select(*pair), pair, "left_anti").select(*pair).distinct()


@query(
    "group_target_stats",
    f"SELECT product_type, basket_type, count(avg_duration_months) AS count, {r('avg(avg_duration_months)')} AS mean, {r('median(avg_duration_months)')} AS median, {r('stddev_samp(avg_duration_months)')} AS std FROM dev_v GROUP BY 1, 2",
)
def group_target_stats(d):
    return audit.group_target_stats(d.development)


_STATS = f"{r('avg(avg_duration_months)')} AS target_mean, {r('median(avg_duration_months)')} AS target_median, {r('stddev_samp(avg_duration_months)')} AS target_std"
_PCT = "round(100.0E0*count(*)/(SELECT count(*) FROM dev_v), 2)"


@query(
    "product_summary",
    f"""SELECT product_type, count(*) AS trainable_rows, {_PCT} AS pct_total, array_to_string(list_sort(list_distinct(list(basket_type))), ', ') AS basket_type_associated,
 {r('avg(basket_size)')} AS mean_underlyings, min(requested_date) AS min_requested_date, max(requested_date) AS max_requested_date, {_STATS} FROM dev_v GROUP BY product_type""",
)
def product_summary(d):
    return audit.product_summary(d.development)


@query("basket_summary", f"SELECT basket_type, count(*) AS trainable_rows, count(DISTINCT product_type) AS products, {_PCT} AS pct_total, {_STATS} FROM dev_v GROUP BY basket_type")
def basket_summary(d):
    return audit.basket_summary(d.development)


@query(
    "year_summary",
    f"SELECT requested_year, count(*) AS trainable_rows, count(DISTINCT product_type) AS product_types, count(DISTINCT basket_type) AS basket_types, {_PCT} AS pct_total, {_STATS} FROM dev_v GROUP BY requested_year",
)
def year_summary(d):
    return audit.year_summary(d.development)


@query(
    "split_summary",
    f"""SELECT split, count(*) AS row_count, round(100.0E0*count(*)/(SELECT count(*) FROM sup_v), 2) AS pct_total, min(requested_date) AS min_requested_date, max(requested_date) AS max_requested_date,
 count(DISTINCT product_type) AS product_types, count(DISTINCT basket_type) AS basket_types, {_STATS} FROM sup_v GROUP BY split""",
)
def split_summary(d):
    return audit.split_summary(d.supervised)


@query(
    "member_summary",
    f"""SELECT d.underlying, d.sector, {r('d.structural_base_vol')} AS structural_base_vol, coalesce(u.n, 0) AS total_appearances, coalesce(u.y, 0) AS years_present, coalesce(u.s, 0) AS splits_present,
 coalesce(u.b, '') AS basket_types, coalesce(u.p, '') AS products FROM dimension_v d LEFT JOIN (SELECT underlying, count(*) AS n, count(DISTINCT requested_year) AS y, count(DISTINCT split) AS s,
 array_to_string(list_sort(list_distinct(list(basket_type))), ', ') AS b, array_to_string(list_sort(list_distinct(list(product_type))), ', ') AS p FROM dev_members_v GROUP BY underlying) u ON u.underlying = d.underlying""",
)
def member_summary(d):
    return audit.member_summary(d.development, d.dimension)


_SPLITS = ("test", "train", "validation")


@query("crosstab", "SELECT product_type, " + ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS {s}" for s in _SPLITS) + " FROM sup_v GROUP BY product_type")
def crosstab(d):
    return audit.crosstab(d.supervised, "product_type", "split", _SPLITS)


@query(
    "crosstab_members",
    "SELECT u AS underlying, " + ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS {s}" for s in _SPLITS) + " FROM sup_v q, unnest(string_split(q.underlyings, '|')) AS t(u) GROUP BY u",
)
def crosstab_members(d):
    return audit.crosstab(audit.member_usage_rows(d.supervised), "underlying", "split", _SPLITS)


@query(
    "period_counts",
    """SELECT 'year' AS grain, CAST(requested_year AS VARCHAR) AS period, 'all' AS category, count(*) AS row_count FROM dev_v GROUP BY 2
 UNION ALL SELECT 'quarter', requested_quarter, 'all', count(*) FROM dev_v GROUP BY 2 UNION ALL SELECT 'year_product', CAST(requested_year AS VARCHAR), product_type, count(*) FROM dev_v GROUP BY 2, 3
 UNION ALL SELECT 'year_basket', CAST(requested_year AS VARCHAR), basket_type, count(*) FROM dev_v GROUP BY 2, 3""",
)
def period_counts(d):
    return audit.period_counts(d.development)


@query("executed_counts", "SELECT executed, count(*) AS row_count FROM dirty_quotes_v GROUP BY executed")
def executed_counts(d):
    return audit.executed_counts(d.dirty_quotes)


@query(
    "value_counts",
    """SELECT 'product_type' AS feature, product_type AS value, count(*) AS row_count FROM dev_v GROUP BY 2 UNION ALL SELECT 'basket_type', basket_type, count(*) FROM dev_v GROUP BY 2
 UNION ALL SELECT 'underlying', underlying, count(*) FROM dev_members_v GROUP BY 2""",
)
def value_counts(d):
    return audit.value_counts(d.development)


@query(
    "count_share_text",
    """SELECT split, string_agg(v || ': ' || n || ' (' || printf('%.1f', round(100.0E0*n/t, 2)) || '%)', '; ' ORDER BY n DESC, v) AS products FROM (
 SELECT split, product_type AS v, count(*) AS n, sum(count(*)) OVER (PARTITION BY split) AS t FROM sup_v GROUP BY 1, 2) GROUP BY split""",
)
def count_share_text(d):
    return audit.count_share_text(d.supervised, ["split"], "product_type", "products")


@query("monthly_target", f"SELECT requested_month, {r('avg(avg_duration_months)')} AS avg_duration_months FROM dev_v GROUP BY 1")
def monthly_target(d):
    return audit.monthly_target(d.development)


@query("monthly_series", f"SELECT CAST(date_trunc('month', date) AS DATE) AS date, underlying, {r('avg(realized_vol_63d)')} AS realized_vol_63d FROM series_v GROUP BY 1, 2")
def monthly_series(d):
    return audit.monthly_series(d.series)


@query(
    "maturity_excess",
    """SELECT t AS threshold_months, count(*) FILTER (WHERE e > t) AS row_count, round(100.0E0*count(*) FILTER (WHERE e > t)/count(*), 2) AS percent FROM (
 SELECT avg_duration_months - date_diff('day', start_date, end_date)/30.4375E0 AS e FROM quotes_v WHERE avg_duration_months IS NOT NULL), (VALUES (0.0E0),(0.1E0),(0.5E0),(1.0E0),(2.0E0),(3.0E0),(6.0E0),(12.0E0)) v(t) GROUP BY t""",
)
def maturity_excess(d):
    return audit.maturity_excess(d.quotes)


@query(
    "eda_summary",
    f"""SELECT (SELECT count(*) FROM quotes_v) AS rfq_rows, (SELECT min(requested_date) FROM quotes_v) AS date_min, (SELECT max(requested_date) FROM quotes_v) AS date_max,
 (SELECT count(*) FROM quotes_v WHERE avg_duration_months IS NULL) AS target_missing_rows, count(*) AS trainable_rows, count(*) FILTER (WHERE split <> 'test') AS development_rows,
 count(DISTINCT requested_year) AS years, count(DISTINCT product_type) AS product_types, count(DISTINCT basket_type) AS basket_types,
 {r("avg(avg_duration_months) FILTER (WHERE split <> 'test')")} AS target_mean, {r("stddev_samp(avg_duration_months) FILTER (WHERE split <> 'test')")} AS target_std,
 {r("median(avg_duration_months) FILTER (WHERE split <> 'test')")} AS target_median FROM sup_v""",
)
def eda_summary(d):
    return audit.eda_summary(d.quotes, d.supervised)


# ---- set operations and ordering -----------------------------------------------------


@query(
    "set_difference",
    "SELECT trader_id, underlyings FROM sup_v WHERE split = 'test' EXCEPT SELECT trader_id, underlyings FROM sup_v WHERE split = 'train'",
)
def set_difference(d):
    pair = ["trader_id", "underlyings"]
    return d.supervised.where("split = 'test'").select(*pair).subtract(d.supervised.where("split = 'train'").select(*pair))


@query(
    "set_intersection",
    "SELECT rfq_id FROM sup_v WHERE split = 'validation' INTERSECT SELECT rfq_id FROM members_v WHERE underlying = 'PROMO'",
)
def set_intersection(d):
    from quotelens.operators.baskets import explode_basket

    chosen = explode_basket(d.quotes).where("underlying = 'PROMO'").select("rfq_id")
    return d.supervised.where("split = 'validation'").select("rfq_id").join(chosen, "rfq_id", "left_semi")


@query(
    "dedupe_first",
    "SELECT product_type, segment, rfq_id FROM (SELECT *, row_number() OVER (PARTITION BY product_type, segment ORDER BY avg_duration_months DESC, rfq_id) AS k FROM sup_v) WHERE k = 1",
)
def dedupe_first(d):
    """First row per key after a sort, as one minimum per group instead of a sort."""
    order = F.struct((-F.col(_T)).alias("t"), F.col("rfq_id").alias("i"))
    return d.supervised.groupBy("product_type", "segment").agg(F.min_by("rfq_id", order).alias("rfq_id"))


@query(
    "seeded_sample",
    # The limit is the operator: at most 1000 rows in digest order.
    "SELECT rfq_id, split FROM sup_v WHERE split = 'validation' ORDER BY md5('42:' || CAST(rfq_id AS VARCHAR)), rfq_id LIMIT 1000",
)
def seeded_sample(d):
    from quotelens.operators.selection import seeded_sample as sample

    return sample(d.supervised.where("split = 'validation'")).select("rfq_id", "split")
