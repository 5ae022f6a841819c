"""Basket expansion, as-of joins, trailing windows and the feature table."""

from pyspark.sql import functions as F

from quotelens.catalog.base import INDICATORS, SPREADS, TERMS, cte, query, r, rs
from quotelens.operators import audit, baskets, splits
from quotelens.operators.asof import asof_join

HIST = [
    "realized_vol_63d_21d_mean",
    "realized_vol_63d_126d_mean",
    "realized_vol_63d_126d_std",
    "realized_vol_63d_trend_21d_126d",
    "realized_vol_63d_zscore_126d",
    "realized_vol_63d_change_21d",
]

# ---- joins ---------------------------------------------------------------------------


@query("explode_basket", "SELECT rfq_id, position, underlying FROM members_v")
def explode_basket(d):
    return baskets.explode_basket(d.quotes)


@query("join_dimension", f"SELECT m.rfq_id, m.underlying, d.sector, {r('d.structural_base_vol')} AS structural_base_vol FROM members_v m LEFT JOIN dimension_v d ON d.underlying = m.underlying")
def join_dimension(d):
    return baskets.join_dimension(baskets.explode_basket(d.quotes), d.dimension).drop("position")


@query(
    "asof_join",
    f"SELECT m.rfq_id, m.underlying, m.requested_date, s.date, {r('s.realized_vol_63d')} AS realized_vol_63d FROM members_v m ASOF LEFT JOIN series_v s ON m.underlying = s.underlying AND m.requested_date >= s.date",
)
def asof_series(d):
    members = baskets.explode_basket(d.quotes, "requested_date")
    joined = asof_join(members, d.series, by="underlying", left_time="requested_date", history_time="date", values=["realized_vol_63d"])
    return joined.drop("position")


@query(
    "asof_join_events",
    f"""SELECT p.event_id, p.user_id, p.ts, v.ts AS view_ts, {r('v.value')} AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
 ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def asof_join_events(d):
    """The same operator on instants: the last view before each purchase of the user."""
    events = d.table("events")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof_join(bought, views, by="user_id", left_time="ts", history_time="view_ts", values=["view_value"], unit="day")


@query(
    "asof_latest_date",
    """SELECT rfq_id, min(date) AS market_data_as_of, CAST(max(date_diff('day', date, requested_date)) AS INT) AS max_market_data_age_days,
 count(*) FILTER (WHERE date IS NULL) AS members_without_history FROM (SELECT m.rfq_id, m.requested_date, s.date FROM members_v m
 ASOF LEFT JOIN series_v s ON m.underlying = s.underlying AND m.requested_date >= s.date) GROUP BY rfq_id""",
)
def asof_latest_date(d):
    from quotelens.operators.scoring import asof_latest_date as latest

    return latest(d.quotes, d.series)


_AGG = {
    "agg_structural": ["structural_base_vol_mean", "structural_base_vol_min", "structural_base_vol_max", "structural_base_vol_range"],
    "agg_realized": [
        "realized_vol_63d_mean",
        "realized_vol_63d_min",
        "realized_vol_63d_max",
        "realized_vol_63d_second_highest",
        "realized_vol_63d_range",
    ],
    "agg_second_highest": ["structural_base_vol_second_highest", "realized_vol_63d_second_highest"],
    "agg_basket_history": [
        f"basket_realized_vol_{n}_{h}" for n in ("21d", "126d", "trend", "zscore", "change_21d") for h in ("mean", "max")
    ],
}
ALL_AGG = list(dict.fromkeys(c for cs in _AGG.values() for c in cs))
_TEXT = [
    "dominant_sector",
    "highest_vol_sector",
    "highest_structural_vol_underlying",
    "second_highest_structural_vol_underlying",
    "lowest_structural_vol_underlying",
    "highest_realized_vol_underlying",
    "second_highest_realized_vol_underlying",
    "lowest_realized_vol_underlying",
]


@query("join_feature_groups", "SELECT rfq_id, basket_type, sector_count, " + rs(*ALL_AGG) + ", " + ", ".join(_TEXT) + " FROM joined_v")
def join_feature_groups(d):
    grouped = baskets.aggregate_members(d.member_rows)
    return d.quotes.select("rfq_id", "basket_type").join(grouped, "rfq_id", "left").select(
        "rfq_id", "basket_type", "sector_count", *ALL_AGG, *_TEXT
    )


_CONTRACT_DOUBLE = {
    "autocall_barrier_pct", "protection_barrier_pct", "callable_maturity_months", "observation_interval_months", "notional_credits",
    "nominal_maturity_months", "quoted_implied_vol", *TERMS, *ALL_AGG,
    *[s for s in SPREADS if s not in ("basket_complexity_score", "has_multiple_sectors")],
}


def feature_select(registry, *extra: str) -> str:
    names = [*registry.numeric, *registry.categorical]
    return ", ".join([*extra, *[f"{r(c)} AS {c}" if c in _CONTRACT_DOUBLE else c for c in names]])


def _registry():
    from quotelens.plans.views import Domain
    from quotelens.schema import FeatureRegistry

    return FeatureRegistry(Domain.members)


@query("feature_table", f"SELECT rfq_id, {r('avg_duration_months')} AS avg_duration_months, {feature_select(_registry())} FROM features_v")
def features(d):
    return d.features()


@query(
    "combined_frame",
    f"SELECT rfq_id, underlyings, requested_date, {r('avg_duration_months')} AS avg_duration_months, {feature_select(_registry())} FROM features_v WHERE executed AND avg_duration_months IS NOT NULL",
)
def combined_frame(d):
    return d.features("underlyings", "requested_date", quotes=splits.trainable(d.stored_quotes))


@query("select_block", f"SELECT rfq_id, {', '.join(f'{r(c)} AS {c}' if c in _CONTRACT_DOUBLE else c for b in [_registry().select_block('compact_core')] for c in [*b[0], *b[1]])} FROM features_v")
def select_block(d):
    numeric, categorical = d.registry.select_block("compact_core")
    return d.features().select("rfq_id", *numeric, *categorical)


@query(
    "reference_usage",
    f"""SELECT d.underlying, d.sector, {r('d.structural_base_vol')} AS structural_base_vol, coalesce(u.n, 0) AS rfq_mentions, {r('u.t')} AS target_mean FROM dimension_v d
 LEFT JOIN (SELECT underlying, count(*) AS n, avg(avg_duration_months) AS t FROM dev_members_v GROUP BY underlying) u ON u.underlying = d.underlying""",
)
def reference_usage(d):
    return audit.reference_usage(d.development, d.dimension)


# ---- windows -------------------------------------------------------------------------


def _history(*columns):
    def build(d):
        return d.history.select("underlying", "date", *columns)

    return build


for _name, _column in {
    "roll_mean_21": HIST[0],
    "roll_mean_126": HIST[1],
    "roll_std_126": HIST[2],
    "vol_trend": HIST[3],
    "vol_zscore": HIST[4],
    "vol_change_21": HIST[5],
}.items():
    query(_name, f"SELECT underlying, date, {r(_column)} AS {_column} FROM hist_v")(_history(_column))


@query("rolling_history", f"SELECT underlying, date, {rs('realized_vol_63d', *HIST)} FROM hist_v")
def rolling_history(d):
    return d.history


def _aggregated(*columns):
    def build(d):
        return baskets.aggregate_members(d.member_rows).select("rfq_id", *columns)

    return build


query("rank_structural", "SELECT rfq_id, " + ", ".join(_TEXT[1:5]) + " FROM joined_v")(_aggregated(*_TEXT[1:5]))
query("rank_realized", "SELECT rfq_id, " + ", ".join(_TEXT[5:]) + " FROM joined_v")(_aggregated(*_TEXT[5:]))
query("agg_sector", "SELECT rfq_id, sector_count, dominant_sector_count, dominant_sector FROM joined_v")(
    _aggregated("sector_count", "dominant_sector_count", "dominant_sector")
)
for _name, _columns in _AGG.items():
    query(_name, f"SELECT rfq_id, {rs(*_columns)} FROM joined_v")(_aggregated(*_columns))
