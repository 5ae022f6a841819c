"""Scalar, string, date and array expressions over the quote table."""

from pyspark.sql import functions as F

from quotelens import functions as fn
from quotelens import schema as S
from quotelens.catalog.base import INDICATORS, MEMBERS, PAIRS, SPREADS, TERMS, basket_sql, cte, freq_sql, label_sql, query, r, select_terms
from quotelens.operators import audit
from quotelens.plans.features import contract_columns, contract_terms

_F = freq_sql("observation_frequency")


@query("fn_frequency_months", f"SELECT rfq_id, observation_frequency, {r(_F)} AS months FROM dirty_quotes_v")
def fn_frequency_months(d):
    return d.dirty_quotes.select("rfq_id", "observation_frequency", fn.frequency_months(F.col("observation_frequency")).alias("months"))


@query("fn_frequency_label", f"SELECT rfq_id, {label_sql(_F)} AS label FROM dirty_quotes_v")
def fn_frequency_label(d):
    return d.dirty_quotes.select("rfq_id", fn.frequency_label(fn.frequency_months(F.col("observation_frequency"))).alias("label"))


@query("fn_parse_basket", f"SELECT rfq_id, array_to_string({basket_sql('underlyings')}, '/') AS members, len({basket_sql('underlyings')}) AS n FROM dirty_quotes_v")
def fn_parse_basket(d):
    members = fn.parse_basket(F.col("underlyings"))
    return d.dirty_quotes.select("rfq_id", F.array_join(members, "/").alias("members"), F.size(members).alias("n"))


@query("fn_basket_signature", f"SELECT rfq_id, array_to_string(list_sort({basket_sql('underlyings')}), '|') AS signature FROM dirty_quotes_v")
def fn_basket_signature(d):
    return d.dirty_quotes.select("rfq_id", fn.basket_signature(fn.parse_basket(F.col("underlyings"))).alias("signature"))


@query("fn_month_diff", f"SELECT rfq_id, {r('(end_date - start_date)/30.4375E0')} AS months FROM dirty_quotes_v")
def fn_month_diff(d):
    return d.dirty_quotes.select("rfq_id", fn.month_diff(F.col("start_date"), F.col("end_date")).alias("months"))


@query(
    "fn_safe_divide",
    f"SELECT rfq_id, CASE WHEN protection_barrier_pct <> 0 THEN {r('autocall_barrier_pct/protection_barrier_pct')} END AS ratio FROM dirty_quotes_v",
)
def fn_safe_divide(d):
    return d.dirty_quotes.select("rfq_id", fn.safe_divide(F.col("autocall_barrier_pct"), F.col("protection_barrier_pct")).alias("ratio"))


@query("fn_multi_hot", "SELECT rfq_id, " + select_terms({f"underlying_{m}": INDICATORS[f"underlying_{m}"] for m in MEMBERS}) + " FROM contract_v")
def fn_multi_hot(d):
    members = fn.parse_basket(F.col("underlyings"))
    return d.quotes.select("rfq_id", *[fn.member_indicator(members, m).alias(f"underlying_{m}") for m in d.members])


@query("fn_pair_indicators", "SELECT rfq_id, " + select_terms({f"pair_{a}_{b}": INDICATORS[f"pair_{a}_{b}"] for a, b in PAIRS}) + " FROM contract_v")
def fn_pair_indicators(d):
    members = fn.parse_basket(F.col("underlyings"))
    return d.quotes.select("rfq_id", *[fn.pair_indicator(members, a, b).alias(f"pair_{a}_{b}") for a, b in d.registry.pairs])


@query("fn_primary_member", "SELECT rfq_id, primary_underlying FROM contract_v")
def fn_primary_member(d):
    return d.quotes.select("rfq_id", fn.primary_member(fn.parse_basket(F.col("underlyings"))).alias("primary_underlying"))


@query("fn_date_parts", "SELECT rfq_id, requested_year, requested_month, requested_quarter FROM contract_v")
def fn_date_parts(d):
    return contract_columns(d.quotes, d.registry).select("rfq_id", "requested_year", "requested_month", "requested_quarter")


_M = "date_diff('day', start_date, end_date)/30.4375E0"


@query(
    "fn_maturity_bucket",
    f"""SELECT rfq_id, CASE WHEN {_M} <= -0.01 THEN NULL WHEN {_M} <= 24 THEN '0-24m' WHEN {_M} <= 36 THEN '24-36m' WHEN {_M} <= 60 THEN '36-60m'
 WHEN {_M} <= 84 THEN '60-84m' ELSE '84m+' END AS bucket FROM dirty_quotes_v""",
)
def fn_maturity_bucket(d):
    return d.dirty_quotes.select("rfq_id", fn.maturity_bucket(fn.month_diff(F.col("start_date"), F.col("end_date"))).alias("bucket"))


def _duration(first, low):
    v = "avg_duration_months"
    return (
        f"CASE WHEN {v} IS NULL {low} THEN NULL WHEN {v} <= 12 THEN '{first}' WHEN {v} <= 24 THEN '12-24' WHEN {v} <= 36 THEN '24-36'"
        f" WHEN {v} <= 60 THEN '36-60' ELSE '60+' END"
    )


DURATION_OPEN = _duration("<=12", "")
DURATION_CLOSED = _duration("0-12", "OR avg_duration_months <= -0.01")


@query("fn_duration_bucket", f"SELECT rfq_id, {DURATION_CLOSED} AS closed_bucket, {DURATION_OPEN} AS open_bucket FROM dirty_quotes_v")
def fn_duration_bucket(d):
    months = F.col("avg_duration_months")
    return d.dirty_quotes.select(
        "rfq_id", fn.duration_bucket(months).alias("closed_bucket"), fn.duration_bucket(months, open_start=True).alias("open_bucket")
    )


@query(
    "fn_segment",
    f"SELECT rfq_id, CASE WHEN len({basket_sql('underlyings')}) = 1 THEN 'single' WHEN basket_type = 'worst_of' THEN 'worst_of' ELSE 'other' END AS segment FROM dirty_quotes_v",
)
def fn_segment(d):
    return d.dirty_quotes.select("rfq_id", fn.segment(F.size(fn.parse_basket(F.col("underlyings"))), F.col("basket_type")).alias("segment"))


_TERM_NAMES = [*TERMS, "callable_maturity_months", "observation_interval_months", "nominal_maturity_months"]


@query("fn_contract_terms", "SELECT rfq_id, is_worst_of, is_single_underlying, is_daily_observation, " + ", ".join(f"{r(c)} AS {c}" for c in _TERM_NAMES) + " FROM features_v")
def fn_contract_terms(d):
    frame = contract_columns(d.quotes, d.registry).withColumns(contract_terms())
    return frame.select("rfq_id", "is_worst_of", "is_single_underlying", "is_daily_observation", *_TERM_NAMES)


_WHOLE = ("basket_complexity_score", "has_multiple_sectors")


@query("fn_vol_spreads", "SELECT rfq_id, " + ", ".join(c if c in _WHOLE else f"{r(c)} AS {c}" for c in SPREADS) + " FROM features_v")
def fn_vol_spreads(d):
    return d.features().select("rfq_id", *SPREADS)


@query("fn_fill_unknown", "SELECT rfq_id, coalesce(counterparty, 'UNKNOWN') AS counterparty, coalesce(trader_id, 'UNKNOWN') AS trader_id FROM dirty_quotes_v")
def fn_fill_unknown(d):
    return d.dirty_quotes.fillna(S.UNKNOWN, ["counterparty", "trader_id"]).select("rfq_id", "counterparty", "trader_id")


@query(
    "fn_inf_to_null",
    f"SELECT rfq_id, CASE WHEN protection_barrier_pct = 0 THEN NULL ELSE {r('1.0E0/protection_barrier_pct')} END AS inverse, CASE WHEN notional_credits > 0 THEN {r('ln(notional_credits)')} END AS log_notional FROM dirty_quotes_v",
)
def fn_inf_to_null(d):
    zero = F.col("protection_barrier_pct") == 0
    inverse = F.when(zero, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), F.col("protection_barrier_pct")))
    logs = F.when(F.col("notional_credits") == 0, F.lit(float("-inf"))).otherwise(F.log("notional_credits"))
    return d.dirty_quotes.select(
        "rfq_id", fn.null_if_not_finite(inverse).alias("inverse"), fn.null_if_not_finite(logs).alias("log_notional")
    )


@query(
    "fn_clip_contract",
    f"""SELECT rfq_id, {r('least(greatest(notional_credits/1000.0E0, greatest(CAST(no_call_period_months AS DOUBLE), observation_interval_months)), nominal_maturity_months)')} AS clipped FROM contract_v""",
)
def fn_clip_contract(d):
    months = fn.frequency_months(F.col("observation_frequency"))
    lower = F.greatest(F.col("no_call_period_months").cast("double"), months)
    upper = fn.month_diff(F.col("start_date"), F.col("end_date"))
    return d.quotes.select("rfq_id", fn.clip_to_contract(F.col("notional_credits") / 1000.0, lower, upper).alias("clipped"))


@query(
    "fn_period_text",
    """SELECT rfq_id, strftime(requested_date, '%Y-%m') AS month_text, year(requested_date) || 'Q' || quarter(requested_date) AS quarter_text,
 CASE WHEN year(requested_date) = year(end_date) THEN CAST(year(end_date) AS VARCHAR) ELSE year(requested_date) || '-' || year(end_date) END AS year_range FROM dirty_quotes_v""",
)
def fn_period_text(d):
    asked = F.col("requested_date")
    return d.dirty_quotes.select(
        "rfq_id",
        fn.month_text(asked).alias("month_text"),
        fn.quarter_text(asked).alias("quarter_text"),
        fn.year_range_text(F.year(asked), F.year("end_date")).alias("year_range"),
    )


JOINED = """CASE WHEN len({l}) > 20 THEN array_to_string(list_slice({l}, 1, 20), ', ') || ' ... (+' || CAST(len({l}) - 20 AS VARCHAR) || ')' ELSE array_to_string({l}, ', ') END"""


@query(
    "fn_join_values",
    f"SELECT product_type, {JOINED.format(l='v')} AS traders FROM (SELECT product_type, list_sort(list_distinct(list(trader_id))) AS v FROM quotes_v GROUP BY product_type)",
)
def fn_join_values(d):
    return audit.joined_values(d.quotes, ["product_type"], "trader_id", "traders")


@query("fn_round_response", "SELECT rfq_id, round(notional_credits/7.0E0, 4) AS rounded FROM quotes_v")
def fn_round_response(d):
    return d.quotes.select("rfq_id", F.round(F.col("notional_credits") / 7.0, 4).alias("rounded"))
