"""The feature plan: one row per quote, every model column, nothing from after the request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens import functions as fn
from quotelens import schema as S
from quotelens.operators.baskets import with_aggregates
from quotelens.operators.rolling import rolling_history


def contract_columns(quotes: DataFrame, registry: S.FeatureRegistry) -> DataFrame:
    """Columns that need only the quote row itself."""
    months = fn.frequency_months(F.col("observation_frequency"))
    base = quotes.withColumns(
        {
            "observation_interval_months": months,
            "observation_frequency_clean": fn.frequency_label(months),
            "_members": fn.parse_basket(F.col("underlyings")),
            "nominal_maturity_months": fn.month_diff(F.col("start_date"), F.col("end_date")),
        }
    )
    members = F.col("_members")
    return base.withColumns(
        {
            "is_daily_observation": F.coalesce(F.col("observation_frequency_clean") == "daily", F.lit(False)).cast("int"),
            "basket_size": F.size(members),
            "basket_signature": fn.basket_signature(members),
            "primary_underlying": fn.primary_member(members),
            "requested_year": F.year("requested_date"),
            "requested_month": F.month("requested_date"),
            "requested_quarter": F.quarter("requested_date"),
            "nominal_maturity_bucket": fn.maturity_bucket(F.col("nominal_maturity_months")),
            **{f"underlying_{m}": fn.member_indicator(members, m) for m in registry.members},
            **{f"pair_{a}_{b}": fn.pair_indicator(members, a, b) for a, b in registry.pairs},
        }
    ).drop("_members")


def contract_terms() -> dict[str, Column]:
    """Ratios and counts of the contract itself."""
    c = F.col
    callable_months = F.greatest(c("nominal_maturity_months") - c("no_call_period_months"), F.lit(0.0))
    interval = c("observation_interval_months")
    return {
        "barrier_gap_pct": c("autocall_barrier_pct") - c("protection_barrier_pct"),
        "autocall_barrier_above_par_pct": c("autocall_barrier_pct") - 1.0,
        "protection_buffer_pct": 1.0 - c("protection_barrier_pct"),
        "autocall_to_protection_ratio": fn.safe_divide(c("autocall_barrier_pct"), c("protection_barrier_pct")),
        "no_call_fraction_of_maturity": fn.safe_divide(c("no_call_period_months"), c("nominal_maturity_months")),
        "callable_maturity_months": callable_months,
        "no_call_observation_count": fn.safe_divide(c("no_call_period_months"), interval),
        "estimated_observation_count": fn.safe_divide(c("nominal_maturity_months"), interval),
        "post_no_call_observation_count": fn.safe_divide(callable_months, interval),
        "is_worst_of": F.coalesce(c("basket_type") == "worst_of", F.lit(False)).cast("int"),
        "is_single_underlying": F.coalesce(c("basket_size") == 1, F.lit(False)).cast("int"),
        "log_notional_credits": F.log1p("notional_credits"),
    }


def spread_terms() -> dict[str, Column]:
    """Spreads and ratios between quoted, realized and structural volatility."""
    c = F.col

    def top_two(measure: str) -> Column:
        return F.coalesce(c(f"{measure}_max") - c(f"{measure}_second_highest"), F.lit(0.0))

    structural, realized = "structural_base_vol", "realized_vol_63d"
    complexity = c("basket_size") * c("is_worst_of")
    return {
        "basket_complexity_score": complexity,
        "worst_of_pressure": complexity * c("autocall_barrier_pct"),
        "worst_of_vol_pressure": complexity * c(f"{structural}_max"),
        "structural_base_vol_top2_spread": top_two(structural),
        "realized_vol_63d_top2_spread": top_two(realized),
        "worst_of_structural_base_vol_range": c("is_worst_of") * c(f"{structural}_range"),
        "worst_of_structural_vol_top2_spread": c("is_worst_of") * top_two(structural),
        "worst_of_realized_vol_63d_range": c("is_worst_of") * c(f"{realized}_range"),
        "worst_of_realized_vol_top2_spread": c("is_worst_of") * top_two(realized),
        "sector_concentration": fn.safe_divide(c("dominant_sector_count"), c("basket_size")),
        "has_multiple_sectors": F.coalesce(c("sector_count") > 1, F.lit(False)).cast("int"),
        "implied_minus_realized_vol_mean": c("quoted_implied_vol") - c(f"{realized}_mean"),
        "quoted_minus_structural_vol_mean": c("quoted_implied_vol") - c(f"{structural}_mean"),
        "realized_minus_structural_vol_mean": c(f"{realized}_mean") - c(f"{structural}_mean"),
        "realized_to_structural_vol_ratio": fn.safe_divide(c(f"{realized}_mean"), c(f"{structural}_mean")),
        "quoted_to_realized_vol_ratio": fn.safe_divide(c("quoted_implied_vol"), c(f"{realized}_mean")),
        "quoted_to_structural_vol_ratio": fn.safe_divide(c("quoted_implied_vol"), c(f"{structural}_mean")),
        "realized_vol_dispersion_ratio": fn.safe_divide(c(f"{realized}_range"), c(f"{realized}_mean")),
        "structural_vol_dispersion_ratio": fn.safe_divide(c(f"{structural}_range"), c(f"{structural}_mean")),
    }


_TEXT_WITH_DEFAULT = [
    name for name in (*S.BASKET_TEXT, "nominal_maturity_bucket")
]


def feature_table(
    quotes: DataFrame,
    series: DataFrame,
    dimension: DataFrame,
    *,
    registry: S.FeatureRegistry | None = None,
    keep: tuple[str, ...] = (),
    include_target: bool = True,
    history: DataFrame | None = None,
) -> DataFrame:
    """Key, ``keep`` columns, numeric features, categorical features and, if asked, the target.

    ``history`` is a stored ``rolling_history(series)``; pass it when several batches share it.
    """
    registry = registry or S.FeatureRegistry()
    history = rolling_history(series) if history is None else history
    wide = contract_columns(with_aggregates(quotes, history, dimension), registry)
    wide = wide.fillna(S.UNKNOWN, subset=_TEXT_WITH_DEFAULT)
    wide = wide.withColumns(contract_terms()).withColumns(spread_terms())
    features = [*registry.numeric, *registry.categorical]
    extra = [name for name in keep if name not in features]
    if include_target and S.TARGET in quotes.columns:
        extra.append(S.TARGET)
    return wide.select(S.ID, *extra, *features)
