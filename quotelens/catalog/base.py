"""Registry of queries over a data folder, with the SQL each one must agree with.

The SQL is DuckDB text over the same parquet tables, composed from the shared table expressions in
``CTES``.  Floating columns are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.plans.views import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PLACES = 6
# Lifts exact decimal ties off the rounding edge, where the last bit of a sum would decide.
NUDGE = "1.0000000000001"


_DOMAINS: dict[tuple[str, str], Domain] = {}


def domain(spark: SparkSession, folder: str) -> Domain:
    """The views over a folder, derived and stored once per session; anew where their scratch files are gone."""
    key = (spark.sparkContext.applicationId, folder)
    known = _DOMAINS.get(key)
    if known is None or known.spark is not spark or not known.stored():
        known = _DOMAINS[key] = Domain(spark, folder)
    return known


def query(name: str, sql: str | None = None):
    """Register a plan builder over a ``Domain``; double columns are rounded to six places."""

    def register(build: Callable[[Domain], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(build(domain(spark, folder)))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return build

    return register


def rounded(frame: DataFrame) -> DataFrame:
    doubles = {f.name for f in frame.schema.fields if f.dataType.typeName() in ("double", "float")}
    if not doubles:
        return frame
    return frame.select(*[_round(F.col(c)).alias(c) if c in doubles else F.col(c) for c in frame.columns])


def _round(column: Column) -> Column:
    return F.round(column * float(NUDGE), PLACES)


def r(expression: str) -> str:
    """SQL rounding that matches ``rounded``; adding zero turns -0.0 into 0.0."""
    return f"(round(({expression}) * {NUDGE}E0, {PLACES}) + 0.0)"


def rs(*columns: str) -> str:
    return ", ".join(f"{r(c)} AS {c}" for c in columns)


# --------------------------------------------------------------------------------------
# Shared table expressions, in dependency order.  Only the ones a query names are included.
# --------------------------------------------------------------------------------------

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def with_ctes(body: str) -> str:
    import re

    def names_in(text: str) -> set[str]:
        return {name for name in CTES if re.search(rf"\b{name}\b", text)}

    needed, frontier = set(), names_in(body)
    while frontier:
        needed |= frontier
        frontier = set().union(*[names_in(CTES[n]) for n in frontier]) - needed
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


FREQ_CASE = """CASE {key} WHEN '1m' THEN 1.0E0 WHEN 'monthly' THEN 1.0E0 WHEN 'mensual' THEN 1.0E0 WHEN 'm' THEN 1.0E0
 WHEN '1 month' THEN 1.0E0 WHEN '2m' THEN 2.0E0 WHEN '2 months' THEN 2.0E0 WHEN '3m' THEN 3.0E0 WHEN 'quarterly' THEN 3.0E0
 WHEN 'trimestral' THEN 3.0E0 WHEN 'q' THEN 3.0E0 WHEN '3 months' THEN 3.0E0 WHEN '6m' THEN 6.0E0 WHEN '6 months' THEN 6.0E0
 WHEN '1y' THEN 12.0E0 WHEN '12m' THEN 12.0E0 WHEN 'annual' THEN 12.0E0 WHEN 'anual' THEN 12.0E0 WHEN 'y' THEN 12.0E0
 WHEN '1d' THEN 1.0E0/21.0E0 END"""


def freq_sql(column: str) -> str:
    return FREQ_CASE.format(key=f"lower(trim({column}))")


def label_sql(months: str) -> str:
    return f"CASE WHEN abs({months} - 1.0E0/21.0E0) < 1e-8 THEN 'daily' ELSE CAST(CAST({months} AS INT) AS VARCHAR) || 'm' END"


def basket_sql(column: str) -> str:
    return f"[trim(x) FOR x IN string_split({column}, '|') IF trim(x) <> '']"


cte(
    "dimension_v",
    """SELECT p_type AS underlying,
 CASE WHEN p_type IN ('STANDARD','PROMO') THEN 'core' WHEN p_type IN ('SMALL','MEDIUM') THEN 'mid' ELSE 'tail' END AS sector,
 CAST(count(*) AS DOUBLE)/CAST((SELECT count(*) FROM part) AS DOUBLE) AS structural_base_vol
 FROM part GROUP BY p_type""",
)
cte(
    "series_v",
    """SELECT CAST(l.l_shipdate AS DATE) AS date, p.p_type AS underlying,
 0.05E0 + CAST(sum(CAST(round(l.l_discount*100) AS BIGINT)) AS DOUBLE)/CAST(count(*) AS DOUBLE)/100.0E0 AS realized_vol_63d
 FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY CAST(l.l_shipdate AS DATE), p.p_type""",
)
cte(
    "quotes_v",
    """SELECT o.o_orderkey AS rfq_id, o.o_orderpriority AS product_type, b.underlyings,
 CASE WHEN b.n = 1 THEN 'single' ELSE 'worst_of' END AS basket_type,
 0.95E0 + CAST(o.o_orderkey % 46 AS DOUBLE)/100.0E0 AS autocall_barrier_pct,
 0.50E0 + CAST(o.o_orderkey % 36 AS DOUBLE)/100.0E0 AS protection_barrier_pct,
 CAST(o.o_orderkey % 7 AS INT) AS no_call_period_months,
 CASE o.o_orderkey % 18 WHEN 0 THEN '1M' WHEN 1 THEN 'Monthly' WHEN 2 THEN 'mensual' WHEN 3 THEN 'M'
 WHEN 4 THEN '1 month' WHEN 5 THEN '2M' WHEN 6 THEN '3M' WHEN 7 THEN 'Quarterly' WHEN 8 THEN 'trimestral'
 WHEN 9 THEN 'Q' WHEN 10 THEN '3 months' WHEN 11 THEN '6M' WHEN 12 THEN '1Y' WHEN 13 THEN '12M'
 WHEN 14 THEN 'Annual' WHEN 15 THEN 'anual' WHEN 16 THEN 'Y' ELSE '1D' END AS observation_frequency,
 0.10E0 + CAST(o.o_orderkey % 50 AS DOUBLE)/100.0E0 AS quoted_implied_vol,
 o.o_totalprice AS notional_credits, c.c_mktsegment AS counterparty, n.n_name AS trader_id,
 CAST(o.o_orderdate AS DATE) AS requested_date, o.o_orderstatus <> 'P' AS executed,
 CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 3 AS INT) AS start_date,
 CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 3 + 365*(1 + o.o_orderkey % 8) AS INT) AS end_date,
 CASE WHEN o.o_orderstatus <> 'P' THEN 6.0E0 + CAST(b.q AS DOUBLE)/CAST(b.k AS DOUBLE) END AS avg_duration_months
 FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
 JOIN (SELECT l.l_orderkey, string_agg(DISTINCT p.p_type, '|' ORDER BY p.p_type) AS underlyings, count(DISTINCT p.p_type) AS n,
 sum(CAST(l.l_quantity AS BIGINT)) AS q, count(*) AS k
 FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY l.l_orderkey) b ON b.l_orderkey = o.o_orderkey""",
)
# The same tables with faults planted by key, so that every rule has something to find.
cte(
    "dirty_quotes_v",
    """SELECT rfq_id - CASE WHEN rfq_id % 97 = 1 THEN 1 ELSE 0 END AS rfq_id,
 product_type,
 CASE WHEN rfq_id % 61 = 0 THEN underlyings || '| ZZZ |' WHEN rfq_id % 59 = 0 THEN underlyings || '|' || split_part(underlyings, '|', 1) ELSE underlyings END AS underlyings,
 CASE WHEN rfq_id % 53 = 0 THEN 'single' WHEN rfq_id % 31 = 0 THEN 'best_of' ELSE basket_type END AS basket_type,
 CASE WHEN rfq_id % 47 = 0 THEN 3.0E0 ELSE autocall_barrier_pct END AS autocall_barrier_pct,
 CASE WHEN rfq_id % 43 = 0 THEN 0.0E0 WHEN rfq_id % 101 = 0 THEN -0.1E0 ELSE protection_barrier_pct END AS protection_barrier_pct,
 CASE WHEN rfq_id % 79 = 0 THEN 400 WHEN rfq_id % 103 = 0 THEN -1 ELSE no_call_period_months END AS no_call_period_months,
 CASE WHEN rfq_id % 71 = 0 THEN 'every blue moon' WHEN rfq_id % 67 = 0 THEN 'fortnightly' ELSE observation_frequency END AS observation_frequency,
 CASE WHEN rfq_id % 41 = 0 THEN 2.5E0 ELSE quoted_implied_vol END AS quoted_implied_vol,
 CASE WHEN rfq_id % 37 = 0 THEN 0.0E0 ELSE notional_credits END AS notional_credits,
 CASE WHEN rfq_id % 29 = 0 THEN NULL ELSE counterparty END AS counterparty, trader_id, requested_date,
 CASE WHEN rfq_id % 23 = 0 THEN NULL ELSE executed END AS executed,
 CASE WHEN rfq_id % 83 = 0 THEN requested_date - 5 ELSE start_date END AS start_date,
 CASE WHEN rfq_id % 89 = 0 THEN start_date - 1 ELSE end_date END AS end_date,
 CASE WHEN rfq_id % 73 = 0 THEN NULL WHEN rfq_id % 107 = 0 THEN -1.0E0 ELSE avg_duration_months END AS avg_duration_months
 FROM quotes_v""",
)
cte(
    "dirty_series_v",
    """SELECT CASE WHEN day(date) = 15 THEN date - 1 WHEN year(date) >= 1998 THEN date + 30 ELSE date END AS date,
 CASE WHEN day(date) = 9 THEN NULL ELSE underlying END AS underlying,
 CASE WHEN day(date) = 7 THEN realized_vol_63d + 3.0E0 WHEN day(date) = 8 THEN NULL ELSE realized_vol_63d END AS realized_vol_63d
 FROM series_v""",
)
cte(
    "dirty_dimension_v",
    """SELECT CASE WHEN underlying = 'PROMO' THEN 'STANDARD' ELSE underlying END AS underlying,
 CASE WHEN underlying = 'LARGE' THEN NULL ELSE sector END AS sector,
 CASE WHEN underlying = 'SMALL' THEN structural_base_vol + 2.0E0 ELSE structural_base_vol END AS structural_base_vol
 FROM dimension_v""",
)
cte(
    "members_v",
    """SELECT rfq_id, requested_date, basket_type, product_type, list_position(m, u) - 1 AS position, u AS underlying, avg_duration_months
 FROM (SELECT *, string_split(underlyings, '|') AS m FROM quotes_v) q, unnest(q.m) AS t(u)""",
)
cte(
    "hist_v",
    """SELECT *, realized_vol_63d_21d_mean - realized_vol_63d_126d_mean AS realized_vol_63d_trend_21d_126d,
 CASE WHEN realized_vol_63d_126d_std > 0 THEN (realized_vol_63d - realized_vol_63d_126d_mean)/realized_vol_63d_126d_std END AS realized_vol_63d_zscore_126d
 FROM (SELECT date, underlying, realized_vol_63d,
 avg(realized_vol_63d) OVER (PARTITION BY underlying ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS realized_vol_63d_21d_mean,
 avg(realized_vol_63d) OVER (PARTITION BY underlying ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) AS realized_vol_63d_126d_mean,
 stddev_samp(realized_vol_63d) OVER (PARTITION BY underlying ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) AS realized_vol_63d_126d_std,
 realized_vol_63d - lag(realized_vol_63d, 21) OVER (PARTITION BY underlying ORDER BY date) AS realized_vol_63d_change_21d
 FROM series_v)""",
)
cte(
    "member_rows_v",
    """SELECT m.*, h.date, h.realized_vol_63d, h.realized_vol_63d_21d_mean, h.realized_vol_63d_126d_mean,
 h.realized_vol_63d_trend_21d_126d, h.realized_vol_63d_zscore_126d, h.realized_vol_63d_change_21d, d.sector, d.structural_base_vol
 FROM members_v m ASOF LEFT JOIN hist_v h ON m.underlying = h.underlying AND m.requested_date >= h.date
 LEFT JOIN dimension_v d ON d.underlying = m.underlying""",
)
cte(
    "sector_counts_v",
    "SELECT rfq_id, sector, count(*) AS c FROM member_rows_v WHERE sector IS NOT NULL GROUP BY rfq_id, sector",
)
cte(
    "sector_v",
    """SELECT rfq_id, count(*) AS sector_count, max(c) AS dominant_sector_count,
 arg_min(sector, struct_pack(a := -c, b := sector)) AS dominant_sector FROM sector_counts_v GROUP BY rfq_id""",
)
cte(
    "ranks_v",
    """SELECT rfq_id,
 max(CASE WHEN sd = 1 THEN sector END) AS highest_vol_sector,
 max(CASE WHEN sd = 1 THEN underlying END) AS highest_structural_vol_underlying,
 max(CASE WHEN sd = 2 THEN underlying END) AS second_highest_structural_vol_underlying,
 max(CASE WHEN sa = 1 THEN underlying END) AS lowest_structural_vol_underlying,
 max(CASE WHEN rd = 1 AND realized_vol_63d IS NOT NULL THEN underlying END) AS highest_realized_vol_underlying,
 max(CASE WHEN rd = 2 AND realized_vol_63d IS NOT NULL THEN underlying END) AS second_highest_realized_vol_underlying,
 max(CASE WHEN ra = 1 AND realized_vol_63d IS NOT NULL THEN underlying END) AS lowest_realized_vol_underlying
 FROM (SELECT *, row_number() OVER (PARTITION BY rfq_id ORDER BY structural_base_vol DESC, position) AS sd,
 row_number() OVER (PARTITION BY rfq_id ORDER BY structural_base_vol, position) AS sa,
 row_number() OVER (PARTITION BY rfq_id ORDER BY realized_vol_63d DESC NULLS LAST, position) AS rd,
 row_number() OVER (PARTITION BY rfq_id ORDER BY realized_vol_63d NULLS LAST, position) AS ra
 FROM member_rows_v) GROUP BY rfq_id""",
)
_HIST = {
    "basket_realized_vol_21d": "realized_vol_63d_21d_mean",
    "basket_realized_vol_126d": "realized_vol_63d_126d_mean",
    "basket_realized_vol_trend": "realized_vol_63d_trend_21d_126d",
    "basket_realized_vol_zscore": "realized_vol_63d_zscore_126d",
    "basket_realized_vol_change_21d": "realized_vol_63d_change_21d",
}
cte(
    "agg_v",
    "SELECT rfq_id, "
    + ", ".join(
        f"avg({m}) AS {m}_mean, min({m}) AS {m}_min, max({m}) AS {m}_max, max({m}) - min({m}) AS {m}_range, "
        f"list_extract(list_sort(list({m}) FILTER ({m} IS NOT NULL), 'DESC'), 2) AS {m}_second_highest"
        for m in ("structural_base_vol", "realized_vol_63d")
    )
    + ", "
    + ", ".join(f"avg({s}) AS {n}_mean, max({s}) AS {n}_max" for n, s in _HIST.items())
    + " FROM member_rows_v GROUP BY rfq_id",
)


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN CAST({a} AS DOUBLE)/CAST({b} AS DOUBLE) END"


MEMBERS = Domain.members
PAIRS = [(a, b) for i, a in enumerate(MEMBERS) for b in MEMBERS[i + 1 :]]

cte(
    "contract_v",
    f"""SELECT *, {label_sql("observation_interval_months")} AS observation_frequency_clean,
 CASE WHEN abs(observation_interval_months - 1.0E0/21.0E0) < 1e-8 THEN 1 ELSE 0 END AS is_daily_observation,
 greatest(nominal_maturity_months - no_call_period_months, 0.0E0) AS callable_maturity_months,
 CASE WHEN basket_type = 'worst_of' THEN 1 ELSE 0 END AS is_worst_of,
 CASE WHEN basket_size = 1 THEN 1 ELSE 0 END AS is_single_underlying,
 array_to_string(list_sort(m), '|') AS basket_signature,
 CASE WHEN basket_size = 1 THEN m[1] ELSE 'MULTI' END AS primary_underlying,
 year(requested_date) AS requested_year, month(requested_date) AS requested_month, quarter(requested_date) AS requested_quarter,
 CASE WHEN nominal_maturity_months <= 24 THEN '0-24m' WHEN nominal_maturity_months <= 36 THEN '24-36m'
 WHEN nominal_maturity_months <= 60 THEN '36-60m' WHEN nominal_maturity_months <= 84 THEN '60-84m' ELSE '84m+' END AS nominal_maturity_bucket
 FROM (SELECT *, {freq_sql("observation_frequency")} AS observation_interval_months, {basket_sql("underlyings")} AS m,
 len({basket_sql("underlyings")}) AS basket_size,
 date_diff('day', start_date, end_date)/30.4375E0 AS nominal_maturity_months FROM quotes_v)""",
)
cte(
    "joined_v",
    """SELECT c.*, a.* EXCLUDE (rfq_id), s.sector_count, s.dominant_sector_count, coalesce(s.dominant_sector, 'UNKNOWN') AS dominant_sector,
 coalesce(k.highest_vol_sector, 'UNKNOWN') AS highest_vol_sector,
 coalesce(k.highest_structural_vol_underlying, 'UNKNOWN') AS highest_structural_vol_underlying,
 coalesce(k.second_highest_structural_vol_underlying, 'UNKNOWN') AS second_highest_structural_vol_underlying,
 coalesce(k.lowest_structural_vol_underlying, 'UNKNOWN') AS lowest_structural_vol_underlying,
 coalesce(k.highest_realized_vol_underlying, 'UNKNOWN') AS highest_realized_vol_underlying,
 coalesce(k.second_highest_realized_vol_underlying, 'UNKNOWN') AS second_highest_realized_vol_underlying,
 coalesce(k.lowest_realized_vol_underlying, 'UNKNOWN') AS lowest_realized_vol_underlying
 FROM contract_v c LEFT JOIN agg_v a ON a.rfq_id = c.rfq_id LEFT JOIN sector_v s ON s.rfq_id = c.rfq_id LEFT JOIN ranks_v k ON k.rfq_id = c.rfq_id""",
)
TERMS = {
    "barrier_gap_pct": "autocall_barrier_pct - protection_barrier_pct",
    "autocall_barrier_above_par_pct": "autocall_barrier_pct - 1.0E0",
    "protection_buffer_pct": "1.0E0 - protection_barrier_pct",
    "autocall_to_protection_ratio": _div("autocall_barrier_pct", "protection_barrier_pct"),
    "no_call_fraction_of_maturity": _div("no_call_period_months", "nominal_maturity_months"),
    "no_call_observation_count": _div("no_call_period_months", "observation_interval_months"),
    "estimated_observation_count": _div("nominal_maturity_months", "observation_interval_months"),
    "post_no_call_observation_count": _div("callable_maturity_months", "observation_interval_months"),
    "log_notional_credits": "ln(1 + notional_credits)",
}
SPREADS = {
    "basket_complexity_score": "basket_size * is_worst_of",
    "worst_of_pressure": "basket_size * is_worst_of * autocall_barrier_pct",
    "worst_of_vol_pressure": "basket_size * is_worst_of * structural_base_vol_max",
    "structural_base_vol_top2_spread": "coalesce(structural_base_vol_max - structural_base_vol_second_highest, 0.0E0)",
    "realized_vol_63d_top2_spread": "coalesce(realized_vol_63d_max - realized_vol_63d_second_highest, 0.0E0)",
    "worst_of_structural_base_vol_range": "is_worst_of * structural_base_vol_range",
    "worst_of_structural_vol_top2_spread": "is_worst_of * coalesce(structural_base_vol_max - structural_base_vol_second_highest, 0.0E0)",
    "worst_of_realized_vol_63d_range": "is_worst_of * realized_vol_63d_range",
    "worst_of_realized_vol_top2_spread": "is_worst_of * coalesce(realized_vol_63d_max - realized_vol_63d_second_highest, 0.0E0)",
    "sector_concentration": _div("dominant_sector_count", "basket_size"),
    "has_multiple_sectors": "CASE WHEN sector_count > 1 THEN 1 ELSE 0 END",
    "implied_minus_realized_vol_mean": "quoted_implied_vol - realized_vol_63d_mean",
    "quoted_minus_structural_vol_mean": "quoted_implied_vol - structural_base_vol_mean",
    "realized_minus_structural_vol_mean": "realized_vol_63d_mean - structural_base_vol_mean",
    "realized_to_structural_vol_ratio": _div("realized_vol_63d_mean", "structural_base_vol_mean"),
    "quoted_to_realized_vol_ratio": _div("quoted_implied_vol", "realized_vol_63d_mean"),
    "quoted_to_structural_vol_ratio": _div("quoted_implied_vol", "structural_base_vol_mean"),
    "realized_vol_dispersion_ratio": _div("realized_vol_63d_range", "realized_vol_63d_mean"),
    "structural_vol_dispersion_ratio": _div("structural_base_vol_range", "structural_base_vol_mean"),
}
INDICATORS = {
    **{f"underlying_{m}": f"CASE WHEN list_contains(m, '{m}') THEN 1 ELSE 0 END" for m in MEMBERS},
    **{f"pair_{a}_{b}": f"CASE WHEN list_contains(m, '{a}') AND list_contains(m, '{b}') THEN 1 ELSE 0 END" for a, b in PAIRS},
}


def select_terms(terms: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in terms.items())


cte("features_v", f"SELECT *, {select_terms({**TERMS, **SPREADS, **INDICATORS})} FROM joined_v")
SPLIT_CASE = "CASE WHEN year({d}) <= 1998 THEN 'train' WHEN year({d}) = 1999 THEN 'validation' WHEN year({d}) >= 2000 THEN 'test' END"
cte(
    "sup_v",
    f"""SELECT *, {SPLIT_CASE.format(d="requested_date")} AS split, year(requested_date) AS requested_year,
 CAST(year(requested_date) AS VARCHAR) || 'Q' || CAST(quarter(requested_date) AS VARCHAR) AS requested_quarter,
 strftime(requested_date, '%Y-%m') AS requested_month, len(string_split(underlyings, '|')) AS basket_size,
 CASE WHEN len(string_split(underlyings, '|')) = 1 THEN 'single' WHEN basket_type = 'worst_of' THEN 'worst_of' ELSE 'other' END AS segment
 FROM quotes_v WHERE executed AND avg_duration_months IS NOT NULL""",
)
_STEADY = [
    "avg_duration_months", "autocall_barrier_pct", "protection_barrier_pct", "callable_maturity_months", "observation_interval_months",
    "notional_credits", "nominal_maturity_months", "quoted_implied_vol", *TERMS, *[s for s in SPREADS if s not in ("basket_complexity_score", "has_multiple_sectors")],
    *[f"{m}_{h}" for m in ("structural_base_vol", "realized_vol_63d") for h in ("mean", "min", "max", "range", "second_highest")],
    *[f"{n}_{h}" for n in _HIST for h in ("mean", "max")],
]
# Doubles kept to nine places, as in the stored model frame.
cte(
    "model_v",
    f"SELECT f.* REPLACE ({', '.join(f'round(f.{c} * {NUDGE}E0, 9) + 0.0 AS {c}' for c in _STEADY)}), s.split, s.segment, round(f.avg_duration_months * {NUDGE}E0, 9) AS target FROM features_v f JOIN sup_v s ON s.rfq_id = f.rfq_id",
)
cte("dev_v", "SELECT * FROM sup_v WHERE split <> 'test'")
cte(
    "dev_members_v",
    "SELECT d.rfq_id, d.product_type, d.basket_type, d.requested_year, d.split, d.avg_duration_months, u AS underlying FROM dev_v d, unnest(string_split(d.underlyings, '|')) AS t(u)",
)
cte(
    "fold_map_v",
    """SELECT v.y AS validation_year, max(t.y) FILTER (WHERE t.y < v.y) OVER (PARTITION BY v.y) AS train_end_year, t.y AS year,
 CASE WHEN t.y = v.y THEN 'validation' ELSE 'train' END AS role
 FROM (SELECT y, row_number() OVER (ORDER BY y) AS k FROM (SELECT DISTINCT year(requested_date) AS y FROM sup_v)) v
 JOIN (SELECT DISTINCT year(requested_date) AS y FROM sup_v) t ON t.y <= v.y WHERE v.k > 2 AND v.y <= 1999""",
)
