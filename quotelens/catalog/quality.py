"""Readers, table checks and the request contract."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelens import functions as fn
from quotelens import schema as S
from quotelens.catalog.base import basket_sql, cte, freq_sql, query, r, rs
from quotelens.operators import audit, quality, sketches
from quotelens.session import materialise, scratch_folder
from quotelens.sources import readers, sinks

# ---- sources -------------------------------------------------------------------------

cte(
    "raw_quotes_v",
    """SELECT CAST(rfq_id AS VARCHAR) AS rfq_id, product_type, underlyings, basket_type,
 CAST(autocall_barrier_pct AS VARCHAR) AS autocall_barrier_pct,
 CASE WHEN rfq_id % 17 = 0 THEN 'n/a' ELSE CAST(protection_barrier_pct AS VARCHAR) END AS protection_barrier_pct,
 CASE WHEN rfq_id % 2 = 0 THEN CAST(no_call_period_months AS VARCHAR) || '.0' ELSE CAST(no_call_period_months AS VARCHAR) END AS no_call_period_months,
 observation_frequency,
 CASE WHEN rfq_id % 13 = 0 THEN 'Infinity' ELSE CAST(quoted_implied_vol AS VARCHAR) END AS quoted_implied_vol,
 CAST(notional_credits AS VARCHAR) AS notional_credits, counterparty, trader_id,
 CASE WHEN rfq_id % 11 = 0 THEN 'soon' ELSE ' ' || CAST(requested_date AS VARCHAR) END AS requested_date,
 CASE rfq_id % 4 WHEN 0 THEN CASE WHEN executed THEN ' True' ELSE 'FALSE ' END WHEN 1 THEN CASE WHEN executed THEN 'sí' ELSE 'no' END
 WHEN 2 THEN CASE WHEN executed THEN '1' ELSE '0' END ELSE CASE WHEN executed THEN 'Yes' WHEN rfq_id % 19 = 0 THEN 'maybe' ELSE 'n' END END AS executed,
 CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, CAST(avg_duration_months AS VARCHAR) AS avg_duration_months
 FROM quotes_v""",
)


def raw_quotes(d):
    """Quotes as the text a CSV would hold, with unreadable cells."""
    key, done = F.col("rfq_id"), F.col("executed")
    text = {c: F.col(c).cast("string") for c in d.quotes.columns}
    text["protection_barrier_pct"] = F.when(key % 17 == 0, "n/a").otherwise(text["protection_barrier_pct"])
    text["no_call_period_months"] = F.when(key % 2 == 0, F.concat(text["no_call_period_months"], F.lit(".0"))).otherwise(text["no_call_period_months"])
    text["quoted_implied_vol"] = F.when(key % 13 == 0, "Infinity").otherwise(text["quoted_implied_vol"])
    text["requested_date"] = F.when(key % 11 == 0, "soon").otherwise(F.concat(F.lit(" "), text["requested_date"]))
    text["executed"] = (
        F.when(key % 4 == 0, F.when(done, " True").otherwise("FALSE "))
        .when(key % 4 == 1, F.when(done, "sí").otherwise("no"))
        .when(key % 4 == 2, F.when(done, "1").otherwise("0"))
        .otherwise(F.when(done, "Yes").when(key % 19 == 0, "maybe").otherwise("n"))
    )
    return d.quotes.select(*[c.alias(n) for n, c in text.items()])


def as_csv(raw, first):
    """Write text columns as CSV, some moved to the front and one that no schema knows, and return the path."""
    path = f"{scratch_folder(raw.sparkSession)}/csv"
    rest = [c for c in raw.columns if c not in first]
    raw.select(*first, F.lit("x").alias("another_column"), *rest).write.csv(path, header=True)
    return path


BOOL_SQL = "CASE WHEN lower(trim(executed)) IN ('true','1','yes','y','si','sí') THEN true WHEN lower(trim(executed)) IN ('false','0','no','n') THEN false END"


@query(
    "read_quotes",
    f"""SELECT rfq_id, product_type, underlyings, basket_type, {r('TRY_CAST(autocall_barrier_pct AS DOUBLE)')} AS autocall_barrier_pct,
 {r('TRY_CAST(protection_barrier_pct AS DOUBLE)')} AS protection_barrier_pct, CAST(TRY_CAST(no_call_period_months AS DOUBLE) AS INT) AS no_call_period_months,
 observation_frequency, CASE WHEN quoted_implied_vol <> 'Infinity' THEN {r('TRY_CAST(quoted_implied_vol AS DOUBLE)')} END AS quoted_implied_vol,
 {r('TRY_CAST(notional_credits AS DOUBLE)')} AS notional_credits, counterparty, trader_id, TRY_CAST(trim(requested_date) AS DATE) AS requested_date,
 {BOOL_SQL} AS executed, TRY_CAST(start_date AS DATE) AS start_date, TRY_CAST(end_date AS DATE) AS end_date,
 {r('TRY_CAST(avg_duration_months AS DOUBLE)')} AS avg_duration_months FROM raw_quotes_v""",
)
def read_quotes(d):
    path = as_csv(raw_quotes(d), ["executed", "rfq_id", "product_type", "basket_type", "trader_id"])
    return readers.read_quotes(d.spark, path, strict=False)


@query("read_series", f"SELECT CASE WHEN day(date) = 9 THEN NULL ELSE date END AS date, underlying, {r('realized_vol_63d')} AS realized_vol_63d FROM series_v")
def read_series(d):
    raw = d.series.select(
        F.when(F.dayofmonth("date") == 9, "31/31/1999").otherwise(F.col("date").cast("string")).alias("date"),
        "underlying",
        F.col("realized_vol_63d").cast("string").alias("realized_vol_63d"),
    )
    return readers.read_series(d.spark, as_csv(raw, ["realized_vol_63d", "date"]))


@query("read_dimension", f"SELECT underlying, sector, {r('structural_base_vol')} AS structural_base_vol FROM dimension_v")
def read_dimension(d):
    raw = d.dimension.select(*[F.col(c).cast("string").alias(c) for c in d.dimension.columns])
    return readers.read_dimension(d.spark, as_csv(raw, ["sector"]))


@query("parse_boolean", f"SELECT rfq_id, executed AS raw, {BOOL_SQL} AS executed, {BOOL_SQL} IS NULL AS refused FROM raw_quotes_v")
def parse_boolean(d):
    flag = fn.parse_boolean(F.col("executed"))
    return raw_quotes(d).select("rfq_id", F.col("executed").alias("raw"), flag.alias("executed"), flag.isNull().alias("refused"))


def _profile_sql(table, columns):
    parts = []
    for name, numeric in columns:
        number = (lambda f: r(f"{f}(CAST({name} AS DOUBLE))")) if numeric else (lambda f: "CAST(NULL AS DOUBLE)")

        def quartile(p, alias):
            return (r(f"quantile_cont(CAST({name} AS DOUBLE), {p})") if numeric else "CAST(NULL AS DOUBLE)") + f" AS {alias}"

        parts.append(
            f"SELECT '{table}' AS \"table\", '{name}' AS \"column\", count(*) AS row_count, count(*) - count({name}) AS null_rows,"
            f" count(DISTINCT {name}) AS distinct_values, {number('min')} AS min, {number('max')} AS max, {number('avg')} AS mean,"
            f" {', '.join(quartile(p, n) for p, n in ((0.25, 'q25'), (0.5, 'median'), (0.75, 'q75')))} FROM {table}_src"
        )
    return " UNION ALL ".join(parts)


cte("quotes_src", "SELECT * FROM dirty_quotes_v")
cte("series_src", "SELECT * FROM dirty_series_v")
cte("dimension_src", "SELECT * FROM dirty_dimension_v")
_PROFILED = {
    "quotes": [(f.name, isinstance(f.dataType, (T.DoubleType, T.IntegerType)) or f.name == "rfq_id") for f in S.QUOTES.fields],
    "series": [("date", False), ("underlying", False), ("realized_vol_63d", True)],
    "dimension": [("underlying", False), ("sector", False), ("structural_base_vol", True)],
}


@query("profile_tables", " UNION ALL ".join(_profile_sql(t, c) for t, c in _PROFILED.items()))
def profile_tables(d):
    """Exact profile of every column of the three tables."""
    tables = {"quotes": d.dirty_quotes, "series": d.dirty_series, "dimension": d.dirty_dimension}
    return reduce(DataFrame.unionByName, [audit.profile_columns(frame, name) for name, frame in tables.items()])


@query("profile_tables_approx")
def profile_tables_approx(d):
    """The profile from sketches, one state row per file and column of the stored tables."""
    tables = {"quotes": d.dirty_quotes, "series": d.dirty_series, "dimension": d.dirty_dimension}
    merged = [sketches.merge_sketches(sketches.column_sketches(materialise(frame)), name) for name, frame in tables.items()]
    return reduce(DataFrame.unionByName, merged)


@query("dataset_fingerprint")
def dataset_fingerprint(d):
    return (
        sinks.table_fingerprint(d.quotes, "quotes")
        .unionByName(sinks.table_fingerprint(d.series, "series"))
        .unionByName(sinks.table_fingerprint(d.dimension, "dimension"))
    )


# ---- quality rules -------------------------------------------------------------------

_REQUIRED = [f.name for f in S.QUOTES.fields if f.name != S.TARGET]
_QUOTE_RULES = {
    **{f"{c}_not_null": f"{c} IS NULL" for c in _REQUIRED},
    "basket_type_vocabulary": "basket_type NOT IN ('single','worst_of')",
    "autocall_range": "autocall_barrier_pct NOT BETWEEN 0.5 AND 2.0",
    "protection_range": "protection_barrier_pct NOT BETWEEN 0.0 AND 1.5",
    "no_call_not_negative": "no_call_period_months < 0",
    "implied_vol_range": "quoted_implied_vol NOT BETWEEN 0.0 AND 2.0",
    "notional_positive": "notional_credits <= 0",
    "target_not_negative": "avg_duration_months < 0",
}
_SERIES_RULES = {
    "date_not_null": "date IS NULL",
    "underlying_not_null": "underlying IS NULL",
    "realized_vol_63d_not_null": "realized_vol_63d IS NULL",
    "realized_vol_range": "realized_vol_63d NOT BETWEEN 0.0 AND 2.0",
}
_DIMENSION_RULES = {
    "underlying_not_null": "underlying IS NULL",
    "sector_not_null": "sector IS NULL",
    "structural_base_vol_not_null": "structural_base_vol IS NULL",
    "base_vol_range": "structural_base_vol NOT BETWEEN 0.0 AND 2.0",
}


def _rules_sql(rules, table):
    return " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {c}) AS violations FROM {table}" for n, c in rules.items())


_DIM_SQL = _rules_sql(_DIMENSION_RULES, "dirty_dimension_v") + (
    " UNION ALL SELECT 'underlying_unique', count(*) FROM (SELECT underlying FROM dirty_dimension_v GROUP BY underlying HAVING count(*) > 1)"
)


@query("dq_schema_quotes", _rules_sql(_QUOTE_RULES, "dirty_quotes_v"))
def dq_schema_quotes(d):
    return quality.count_violations(d.dirty_quotes, quality.quote_rules())


@query("dq_schema_series", _rules_sql(_SERIES_RULES, "dirty_series_v"))
def dq_schema_series(d):
    return quality.count_violations(d.dirty_series, quality.series_rules())


@query("dq_schema_dimension", _DIM_SQL)
def dq_schema_dimension(d):
    return quality.dimension_report(d.dirty_dimension)


@query("dq_unique_id", "SELECT rfq_id, count(*) AS copies FROM dirty_quotes_v GROUP BY rfq_id HAVING count(*) > 1")
def dq_unique_id(d):
    return quality.duplicate_keys(d.dirty_quotes, ["rfq_id"])


@query("dq_date_order", "SELECT rfq_id, start_date, end_date FROM dirty_quotes_v WHERE end_date <= start_date")
def dq_date_order(d):
    return quality.date_order(d.dirty_quotes)


@query("dq_start_after_request", "SELECT rfq_id, requested_date, start_date FROM dirty_quotes_v WHERE start_date < requested_date")
def dq_start_after_request(d):
    return quality.start_after_request(d.dirty_quotes)


@query(
    "dq_no_call_within_maturity",
    f"SELECT rfq_id, no_call_period_months, {r('(end_date - start_date)/30.4375E0')} AS maturity_months FROM dirty_quotes_v"
    " WHERE no_call_period_months > date_diff('day', start_date, end_date)/30.4375E0",
)
def dq_no_call_within_maturity(d):
    return quality.no_call_within_maturity(d.dirty_quotes)


@query(
    "dq_target_iff_executed",
    f"SELECT rfq_id, executed, {r('avg_duration_months')} AS avg_duration_months FROM dirty_quotes_v WHERE (avg_duration_months IS NOT NULL) <> coalesce(executed, false)",
)
def dq_target_iff_executed(d):
    return quality.target_iff_executed(d.dirty_quotes)


@query(
    "dq_frequency_vocab",
    f"SELECT observation_frequency, count(*) AS row_count FROM dirty_quotes_v WHERE observation_frequency IS NOT NULL AND {freq_sql('observation_frequency')} IS NULL GROUP BY observation_frequency",
)
def dq_frequency_vocab(d):
    return quality.frequency_vocabulary(d.dirty_quotes)


@query("dq_series_unique", "SELECT underlying, date, count(*) AS copies FROM dirty_series_v GROUP BY underlying, date HAVING count(*) > 1")
def dq_series_unique(d):
    return quality.duplicate_keys(d.dirty_series, ["underlying", "date"])


@query(
    "dq_series_gap",
    """SELECT underlying, max(g) AS max_gap_days, coalesce(max(g) > 14, false) AS too_long FROM (SELECT underlying,
 date_diff('day', lag(date) OVER (PARTITION BY underlying ORDER BY date), date) AS g FROM dirty_series_v) GROUP BY underlying""",
)
def dq_series_gap(d):
    return quality.series_gaps(d.dirty_series)


cte(
    "dirty_members_v",
    f"SELECT q.rfq_id, q.requested_date, u AS underlying FROM dirty_quotes_v q, unnest({basket_sql('q.underlyings')}) AS t(u)",
)


@query(
    "dq_membership",
    "SELECT underlying, count(*) AS mentions FROM dirty_members_v WHERE underlying NOT IN (SELECT underlying FROM dimension_v) GROUP BY underlying",
)
def dq_membership(d):
    return quality.unknown_members(d.dirty_quotes, d.dimension)


_B = basket_sql("underlyings")


@query(
    "dq_basket_size",
    f"SELECT rfq_id, basket_type, len({_B}) AS members FROM dirty_quotes_v WHERE (basket_type = 'single' AND len({_B}) <> 1) OR (basket_type = 'worst_of' AND len({_B}) < 2)",
)
def dq_basket_size(d):
    return quality.basket_size(d.dirty_quotes)


@query("dq_basket_duplicates", f"SELECT rfq_id, underlyings FROM dirty_quotes_v WHERE len({_B}) <> len(list_distinct({_B}))")
def dq_basket_duplicates(d):
    return quality.basket_duplicates(d.dirty_quotes)


_COVER = """SELECT m.rfq_id, count(*) FILTER (WHERE f.first IS NULL OR f.first > m.requested_date) AS uncovered_members
 FROM dirty_members_v m LEFT JOIN (SELECT underlying, min(date) AS first FROM series_v GROUP BY underlying) f ON f.underlying = m.underlying
 GROUP BY m.rfq_id HAVING count(*) FILTER (WHERE f.first IS NULL OR f.first > m.requested_date) > 0"""


@query("dq_history_coverage", _COVER)
def dq_history_coverage(d):
    return quality.history_coverage(d.dirty_quotes, d.series)


_STEPS = [
    ("quotes", "schema", f"SELECT CAST(sum(violations) AS BIGINT) FROM ({_rules_sql(_QUOTE_RULES, 'dirty_quotes_v')})"),
    ("quotes", "unique_id", "SELECT count(*) FROM (SELECT rfq_id FROM dirty_quotes_v GROUP BY rfq_id HAVING count(*) > 1)"),
    ("quotes", "date_order", "SELECT count(*) FROM dirty_quotes_v WHERE end_date <= start_date"),
    ("quotes", "start_after_request", "SELECT count(*) FROM dirty_quotes_v WHERE start_date < requested_date"),
    ("quotes", "no_call_within_maturity", "SELECT count(*) FROM dirty_quotes_v WHERE no_call_period_months > date_diff('day', start_date, end_date)/30.4375E0"),
    ("quotes", "target_iff_executed", "SELECT count(*) FROM dirty_quotes_v WHERE (avg_duration_months IS NOT NULL) <> coalesce(executed, false)"),
    ("quotes", "frequency_vocabulary", f"SELECT count(DISTINCT observation_frequency) FROM dirty_quotes_v WHERE {freq_sql('observation_frequency')} IS NULL"),
    ("series", "schema", f"SELECT CAST(sum(violations) AS BIGINT) FROM ({_rules_sql(_SERIES_RULES, 'dirty_series_v')})"),
    ("series", "unique_key", "SELECT count(*) FROM (SELECT underlying FROM dirty_series_v GROUP BY underlying, date HAVING count(*) > 1)"),
    ("series", "gap", "SELECT count(*) FROM (SELECT underlying, max(g) AS g FROM (SELECT underlying, date_diff('day', lag(date) OVER (PARTITION BY underlying ORDER BY date), date) AS g FROM dirty_series_v) GROUP BY underlying) WHERE g > 14"),
    ("dimension", "schema", f"SELECT CAST(sum(violations) AS BIGINT) FROM ({_DIM_SQL})"),
    ("baskets", "membership", "SELECT count(DISTINCT underlying) FROM dirty_members_v WHERE underlying NOT IN (SELECT underlying FROM dirty_dimension_v)"),
    ("baskets", "duplicate_members", f"SELECT count(*) FROM dirty_quotes_v WHERE len({_B}) <> len(list_distinct({_B}))"),
    ("baskets", "size", f"SELECT count(*) FROM dirty_quotes_v WHERE (basket_type = 'single' AND len({_B}) <> 1) OR (basket_type = 'worst_of' AND len({_B}) < 2)"),
    ("baskets", "history_coverage", f"SELECT count(*) FROM ({_COVER.replace('FROM series_v', 'FROM dirty_series_v')})"),
]


@query(
    "validate_all",
    " UNION ALL ".join(f"SELECT {i} AS step, '{t}' AS \"table\", '{n}' AS rule, ({q}) AS violations" for i, (t, n, q) in enumerate(_STEPS, 1)),
)
def validate_all(d):
    return quality.validate_all(d.dirty_quotes, d.dirty_series, d.dirty_dimension)


_MAT = "date_diff('day', start_date, end_date)/30.4375E0"
_U = f"[upper(y) FOR y IN {_B}]"
_BROKEN = {
    "missing_value": " OR ".join(f"{f.name} IS NULL" for f in S.REQUEST.fields if f.name not in ("counterparty", "trader_id")),
    "basket_type": "basket_type NOT IN ('single','worst_of')",
    "autocall_range": "autocall_barrier_pct NOT BETWEEN 0.5 AND 2.0",
    "protection_range": "protection_barrier_pct <= 0 OR protection_barrier_pct > 1.5",
    "no_call_negative": "no_call_period_months < 0",
    "implied_vol_range": "quoted_implied_vol NOT BETWEEN 0 AND 2.0",
    "notional_not_positive": "notional_credits <= 0",
    "empty_basket": f"len({_U}) = 0",
    "duplicate_members": f"len({_U}) <> len(list_distinct({_U}))",
    "frequency": f"{freq_sql('observation_frequency')} IS NULL",
    "date_order": "end_date <= start_date",
    "requested_after_start": "requested_date > start_date",
    "no_call_beyond_maturity": f"no_call_period_months > {_MAT}",
    "basket_size": f"(basket_type = 'single' AND len({_U}) <> 1) OR (basket_type = 'worst_of' AND len({_U}) < 2)",
}


REQUEST_BASKET_SQL = f"array_to_string({_U}, '|')"
REQUEST_REASONS_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _BROKEN.items()) + ")"


@query(
    "request_contract",
    f"SELECT rfq_id AS request_ord, {REQUEST_BASKET_SQL} AS underlyings, coalesce(counterparty, 'UNKNOWN') AS counterparty, {REQUEST_REASONS_SQL} AS reasons FROM dirty_quotes_v",
)
def request_contract(d):
    requests = d.dirty_quotes.withColumn("request_ord", F.col("rfq_id"))
    checked = quality.request_contract(requests)
    return checked.select("request_ord", "underlyings", "counterparty", F.array_join("reasons", ",").alias("reasons"))
