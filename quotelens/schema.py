"""Table schemas, vocabularies, thresholds and the feature registry.

Everything in this module is configuration: plain values that decide which columns a plan
produces.  No data passes through it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import types as T

TARGET = "avg_duration_months"
ID = "rfq_id"
DAYS_PER_MONTH = 30.4375
UNKNOWN = "UNKNOWN"

# --------------------------------------------------------------------------------------
# Table schemas
# --------------------------------------------------------------------------------------


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


QUOTES = _struct(
    ("rfq_id", T.StringType()),
    ("product_type", T.StringType()),
    ("underlyings", T.StringType()),
    ("basket_type", T.StringType()),
    ("autocall_barrier_pct", T.DoubleType()),
    ("protection_barrier_pct", T.DoubleType()),
    ("no_call_period_months", T.IntegerType()),
    ("observation_frequency", T.StringType()),
    ("quoted_implied_vol", T.DoubleType()),
    ("notional_credits", T.DoubleType()),
    ("counterparty", T.StringType()),
    ("trader_id", T.StringType()),
    ("requested_date", T.DateType()),
    ("executed", T.BooleanType()),
    ("start_date", T.DateType()),
    ("end_date", T.DateType()),
    ("avg_duration_months", T.DoubleType()),
)
SERIES = _struct(
    ("date", T.DateType()),
    ("underlying", T.StringType()),
    ("realized_vol_63d", T.DoubleType()),
)
DIMENSION = _struct(
    ("underlying", T.StringType()),
    ("sector", T.StringType()),
    ("structural_base_vol", T.DoubleType()),
)
HISTORY_ONLY_COLUMNS = ("rfq_id", "executed", "avg_duration_months")
REQUEST = T.StructType([f for f in QUOTES.fields if f.name not in HISTORY_ONLY_COLUMNS])

# --------------------------------------------------------------------------------------
# These must equal the published vocabulary for results to agree.
# --------------------------------------------------------------------------------------

KNOWN_MEMBERS = (
    "BSKR", "CLNE", "CORL", "DRC", "HTTX", "JEDI", "KYBR",
    "MNDO", "NABO", "POBK", "REBL", "SITH", "TECH", "WOOK",
)

FREQUENCY_MONTHS = {
    "1m": 1.0,
    "monthly": 1.0,
    "mensual": 1.0,
    "m": 1.0,
    "1 month": 1.0,
    "2m": 2.0,
    "2 months": 2.0,
    "3m": 3.0,
    "quarterly": 3.0,
    "trimestral": 3.0,
    "q": 3.0,
    "3 months": 3.0,
    "6m": 6.0,
    "6 months": 6.0,
    "1y": 12.0,
    "12m": 12.0,
    "annual": 12.0,
    "anual": 12.0,
    "y": 12.0,
    "1d": 1.0 / 21.0,
}

TRUE_WORDS = ("true", "1", "yes", "y", "si", "sí")
FALSE_WORDS = ("false", "0", "no", "n")

MATURITY_EDGES = (24, 36, 60, 84)
MATURITY_LABELS = ("0-24m", "24-36m", "36-60m", "60-84m", "84m+")
DURATION_EDGES = (12, 24, 36, 60)
DURATION_LABELS = ("0-12", "12-24", "24-36", "36-60", "60+")
DURATION_LABELS_OPEN = ("<=12", "12-24", "24-36", "36-60", "60+")

MAX_SERIES_GAP_DAYS = 14
MAX_STALENESS_DAYS = 10
LONG_DURATION_MONTHS = 60.0
RARE_CATEGORY_ROWS = 20
MAX_JOINED_VALUES = 20
MAX_UNSEEN_VALUES = 25
EXCESS_THRESHOLDS = (0.0, 0.1, 0.5, 1.0, 2.0, 3.0, 6.0, 12.0)

DRIFT_LIMITS = {
    "ks": (0.10, 0.20),
    "shift": (0.25, 0.50),
    "js": (0.05, 0.10),
    "share": (0.10, 0.20),
    "missing": (0.05, 0.10),
}
SEGMENT_RULES = {"train_rows": 1000, "validation_rows": 200, "years": 3, "products": 1, "members": 1}
CONCENTRATION_LIMITS = {"top_product_share": 0.35, "top_year_share": 0.25}
SIGNIFICANCE_LEVEL = 0.05
BIAS_NUMERIC = (
    "autocall_barrier_pct",
    "protection_barrier_pct",
    "quoted_implied_vol",
    "notional_credits",
    "no_call_period_months",
)
BIAS_CATEGORICAL = ("basket_type", "product_type", "observation_frequency", "trader_id", "counterparty")
RANGE_FIELDS = (
    "autocall_barrier_pct",
    "protection_barrier_pct",
    "no_call_period_months",
    "quoted_implied_vol",
    "notional_credits",
)
QUOTE_CATEGORICALS = (
    "product_type",
    "basket_type",
    "observation_frequency_clean",
    "counterparty",
    "trader_id",
    "underlyings",
)
MEMBER_CATEGORICALS = ("underlying", "sector")
NOMINAL_COVERAGE = 0.90
MIN_MATERIAL_GAIN_MONTHS = 0.25
BOOTSTRAP_REPLICATES = 5000
SEED = 42

# Key sets of the group-median baselines.
BASELINE_KEYS = {
    "median_by_product_type": ("product_type",),
    "median_by_product_basket": ("product_type", "basket_type"),
    "median_by_basket_type": ("basket_type",),
    "median_by_product_frequency": ("product_type", "observation_frequency_clean"),
    "median_by_product_maturity_bucket": ("product_type", "nominal_maturity_bucket"),
    "median_by_product_frequency_maturity": (
        "product_type",
        "observation_frequency_clean",
        "nominal_maturity_bucket",
    ),
    "median_by_product_basket_size": ("product_type", "basket_size"),
    "median_by_single_worstof": ("is_worst_of",),
    "median_by_product_single_worstof": ("product_type", "is_worst_of"),
}

# Feature names by theme.  "@members" and "@pairs" stand for the indicator columns.
CONTRACT_NUMERIC = (
    "autocall_barrier_pct",
    "protection_barrier_pct",
    "barrier_gap_pct",
    "autocall_barrier_above_par_pct",
    "protection_buffer_pct",
    "autocall_to_protection_ratio",
    "no_call_period_months",
    "no_call_fraction_of_maturity",
    "callable_maturity_months",
    "observation_interval_months",
    "is_daily_observation",
    "no_call_observation_count",
    "estimated_observation_count",
    "post_no_call_observation_count",
    "notional_credits",
    "log_notional_credits",
    "nominal_maturity_months",
)
DATE_NUMERIC = ("requested_year", "requested_month", "requested_quarter")
BASKET_NUMERIC = (
    "basket_size",
    "is_worst_of",
    "is_single_underlying",
    "@members",
    "@pairs",
    "basket_complexity_score",
    "worst_of_pressure",
    "worst_of_vol_pressure",
    "structural_base_vol_mean",
    "structural_base_vol_min",
    "structural_base_vol_max",
    "structural_base_vol_second_highest",
    "structural_base_vol_range",
    "structural_base_vol_top2_spread",
    "structural_vol_dispersion_ratio",
    "sector_count",
    "sector_concentration",
    "has_multiple_sectors",
    "realized_vol_63d_second_highest",
    "realized_vol_63d_top2_spread",
    "worst_of_structural_base_vol_range",
    "worst_of_structural_vol_top2_spread",
    "worst_of_realized_vol_63d_range",
    "worst_of_realized_vol_top2_spread",
)
MARKET_NUMERIC = (
    "quoted_implied_vol",
    "realized_vol_63d_mean",
    "realized_vol_63d_min",
    "realized_vol_63d_max",
    "realized_vol_63d_range",
    "basket_realized_vol_21d_mean",
    "basket_realized_vol_21d_max",
    "basket_realized_vol_126d_mean",
    "basket_realized_vol_126d_max",
    "basket_realized_vol_trend_mean",
    "basket_realized_vol_trend_max",
    "basket_realized_vol_zscore_mean",
    "basket_realized_vol_zscore_max",
    "basket_realized_vol_change_21d_mean",
    "basket_realized_vol_change_21d_max",
    "implied_minus_realized_vol_mean",
    "quoted_minus_structural_vol_mean",
    "realized_minus_structural_vol_mean",
    "realized_to_structural_vol_ratio",
    "quoted_to_realized_vol_ratio",
    "quoted_to_structural_vol_ratio",
    "realized_vol_dispersion_ratio",
)
STRUCTURAL_RANK_TEXT = (
    "highest_structural_vol_underlying",
    "second_highest_structural_vol_underlying",
    "lowest_structural_vol_underlying",
)
REALIZED_RANK_TEXT = (
    "highest_realized_vol_underlying",
    "second_highest_realized_vol_underlying",
    "lowest_realized_vol_underlying",
)
CONTRACT_TEXT = ("observation_frequency_clean",)
PRODUCT_TEXT = ("product_type", "basket_type", "nominal_maturity_bucket")
BASKET_TEXT = (
    "basket_signature",
    "primary_underlying",
    "dominant_sector",
    "highest_vol_sector",
    *STRUCTURAL_RANK_TEXT,
    *REALIZED_RANK_TEXT,
)
COMMERCIAL_TEXT = ("counterparty", "trader_id")
NOISE_CANDIDATES = (
    "requested_month",
    "requested_quarter",
    "notional_credits",
    "log_notional_credits",
    "quoted_to_structural_vol_ratio",
    "quoted_minus_structural_vol_mean",
    "realized_minus_structural_vol_mean",
    "quoted_to_realized_vol_ratio",
    "implied_minus_realized_vol_mean",
    "no_call_observation_count",
)
COMPACT_CORE = (
    "nominal_maturity_months",
    "callable_maturity_months",
    "autocall_barrier_pct",
    "protection_barrier_pct",
    "barrier_gap_pct",
    "no_call_period_months",
    "observation_interval_months",
    "basket_size",
    "is_worst_of",
    "basket_complexity_score",
    "worst_of_vol_pressure",
    "structural_base_vol_min",
    "structural_base_vol_max",
    "structural_base_vol_range",
    "structural_vol_dispersion_ratio",
    "sector_count",
    "sector_concentration",
    "realized_vol_63d_min",
    "realized_vol_63d_max",
    "basket_realized_vol_21d_mean",
    "basket_realized_vol_126d_mean",
    "basket_realized_vol_trend_mean",
    "basket_realized_vol_zscore_mean",
    "product_type",
    "observation_frequency_clean",
    "dominant_sector",
    "highest_vol_sector",
)
SEGMENT_TERMS = (
    "nominal_maturity_months",
    "callable_maturity_months",
    "autocall_barrier_pct",
    "protection_barrier_pct",
    "barrier_gap_pct",
    "no_call_period_months",
    "no_call_fraction_of_maturity",
    "observation_interval_months",
    "is_daily_observation",
    "estimated_observation_count",
    "post_no_call_observation_count",
)
SINGLE_CORE = (
    *SEGMENT_TERMS,
    "quoted_implied_vol",
    "structural_base_vol_mean",
    "realized_vol_63d_mean",
    "basket_realized_vol_21d_mean",
    "basket_realized_vol_126d_mean",
    "basket_realized_vol_trend_mean",
    "basket_realized_vol_zscore_mean",
    "basket_realized_vol_change_21d_mean",
    "requested_year",
    "product_type",
    "observation_frequency_clean",
    "nominal_maturity_bucket",
    "dominant_sector",
)
WORST_OF_CORE = (
    *SEGMENT_TERMS,
    "basket_size",
    "@members",
    "@pairs",
    "basket_complexity_score",
    "worst_of_pressure",
    "worst_of_vol_pressure",
    "structural_base_vol_mean",
    "structural_base_vol_min",
    "structural_base_vol_max",
    "structural_base_vol_second_highest",
    "structural_base_vol_range",
    "structural_base_vol_top2_spread",
    "sector_count",
    "sector_concentration",
    "has_multiple_sectors",
    "quoted_implied_vol",
    "realized_vol_63d_mean",
    "realized_vol_63d_min",
    "realized_vol_63d_max",
    "realized_vol_63d_second_highest",
    "realized_vol_63d_range",
    "realized_vol_63d_top2_spread",
    "worst_of_structural_base_vol_range",
    "worst_of_structural_vol_top2_spread",
    "worst_of_realized_vol_63d_range",
    "worst_of_realized_vol_top2_spread",
    "basket_realized_vol_21d_mean",
    "basket_realized_vol_21d_max",
    "basket_realized_vol_126d_mean",
    "basket_realized_vol_126d_max",
    "basket_realized_vol_trend_mean",
    "basket_realized_vol_trend_max",
    "basket_realized_vol_zscore_mean",
    "basket_realized_vol_zscore_max",
    "implied_minus_realized_vol_mean",
    "realized_to_structural_vol_ratio",
    "structural_vol_dispersion_ratio",
    "realized_vol_dispersion_ratio",
    "requested_year",
    "product_type",
    "basket_type",
    "basket_signature",
    "observation_frequency_clean",
    "nominal_maturity_bucket",
    "dominant_sector",
    "highest_vol_sector",
    *STRUCTURAL_RANK_TEXT,
    *REALIZED_RANK_TEXT,
)
TAIL_EXCLUSIONS = (
    "structural_base_vol_mean",
    "realized_vol_63d_mean",
    "basket_realized_vol_21d_mean",
    "basket_realized_vol_126d_mean",
)
TOP_RISK_TEXT = ("highest_structural_vol_underlying", "highest_realized_vol_underlying")


@dataclass(frozen=True)
class Block:
    """A named feature subset: a parent list or block, minus and plus some columns."""

    parent: str | tuple[str, ...]
    minus: tuple[str, ...] = ()
    plus: tuple[str, ...] = ()


BLOCKS = {
    "contractual": Block(CONTRACT_NUMERIC + CONTRACT_TEXT),
    "product": Block(PRODUCT_TEXT),
    "basket": Block(BASKET_NUMERIC + BASKET_TEXT),
    "market": Block(MARKET_NUMERIC),
    "date": Block(DATE_NUMERIC),
    "commercial": Block(COMMERCIAL_TEXT),
    "all_features": Block(
        CONTRACT_NUMERIC + DATE_NUMERIC + BASKET_NUMERIC + MARKET_NUMERIC
        + CONTRACT_TEXT + PRODUCT_TEXT + BASKET_TEXT + COMMERCIAL_TEXT
    ),
    "all_without_commercial": Block("all_features", minus=COMMERCIAL_TEXT),
    "all_without_noise": Block("all_without_commercial", minus=NOISE_CANDIDATES),
    "compact_core": Block(COMPACT_CORE),
    "single_core": Block(SINGLE_CORE),
    "single_without_noise": Block(
        "single_core",
        minus=(
            "requested_year",
            "post_no_call_observation_count",
            "basket_realized_vol_zscore_mean",
            "basket_realized_vol_change_21d_mean",
        ),
    ),
    "single_stable": Block("single_without_noise", minus=("basket_realized_vol_trend_mean",)),
    "single_underlying": Block("single_stable", plus=("primary_underlying",)),
    "single_underlying_no_sector": Block("single_underlying", minus=("dominant_sector",)),
    "worst_of_core": Block(WORST_OF_CORE),
    "worst_of_without_noise": Block(
        "worst_of_core",
        minus=(
            "requested_year",
            "post_no_call_observation_count",
            "basket_realized_vol_zscore_mean",
            "basket_realized_vol_zscore_max",
            "implied_minus_realized_vol_mean",
            "realized_vol_dispersion_ratio",
        ),
    ),
    "worst_of_stable": Block(
        "worst_of_without_noise",
        minus=(
            "basket_realized_vol_trend_mean",
            "basket_realized_vol_trend_max",
            "realized_to_structural_vol_ratio",
        ),
    ),
    "worst_of_tail_focus": Block("worst_of_stable", minus=TAIL_EXCLUSIONS),
    "worst_of_risk_underlying": Block(
        "worst_of_stable", plus=STRUCTURAL_RANK_TEXT + REALIZED_RANK_TEXT
    ),
    "worst_of_tail_underlying": Block(
        "worst_of_tail_focus", plus=STRUCTURAL_RANK_TEXT + REALIZED_RANK_TEXT
    ),
    "global_stable": Block(
        "all_without_noise",
        minus=(
            "requested_year",
            "post_no_call_observation_count",
            "basket_realized_vol_trend_mean",
            "basket_realized_vol_trend_max",
            "basket_realized_vol_zscore_mean",
            "basket_realized_vol_zscore_max",
            "basket_realized_vol_change_21d_mean",
            "basket_realized_vol_change_21d_max",
            "realized_to_structural_vol_ratio",
            "realized_vol_dispersion_ratio",
        ),
    ),
    "global_stable_tail": Block("global_stable", minus=TAIL_EXCLUSIONS),
    "global_stable_no_sector": Block(
        "global_stable", minus=("dominant_sector", "highest_vol_sector")
    ),
    "global_risk_underlying": Block("global_stable", plus=TOP_RISK_TEXT),
    "global_all_underlying": Block("global_risk_underlying", plus=("primary_underlying",)),
    "global_tail_underlying": Block("global_stable_tail", plus=TOP_RISK_TEXT),
}


@dataclass(frozen=True)
class FeatureRegistry:
    """Feature names and blocks for one member vocabulary."""

    members: tuple[str, ...] = KNOWN_MEMBERS
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def indicators(self) -> tuple[str, ...]:
        return tuple(f"underlying_{name}" for name in self.members)

    @property
    def pairs(self) -> tuple[tuple[str, str], ...]:
        return tuple(combinations(self.members, 2))

    @property
    def pair_indicators(self) -> tuple[str, ...]:
        return tuple(f"pair_{left}_{right}" for left, right in self.pairs)

    def _expand(self, names: tuple[str, ...]) -> tuple[str, ...]:
        out: list[str] = []
        for name in names:
            if name == "@members":
                out.extend(self.indicators)
            elif name == "@pairs":
                out.extend(self.pair_indicators)
            else:
                out.append(name)
        return tuple(out)

    @property
    def numeric(self) -> tuple[str, ...]:
        return self._expand(CONTRACT_NUMERIC + DATE_NUMERIC + BASKET_NUMERIC + MARKET_NUMERIC)

    @property
    def categorical(self) -> tuple[str, ...]:
        return CONTRACT_TEXT + PRODUCT_TEXT + BASKET_TEXT + COMMERCIAL_TEXT

    def block_columns(self, name: str) -> tuple[str, ...]:
        if name not in BLOCKS:
            raise ValueError(f"unknown feature block {name!r}; known blocks: {sorted(BLOCKS)}")
        block = BLOCKS[name]
        parent = (
            self.block_columns(block.parent)
            if isinstance(block.parent, str)
            else self._expand(block.parent)
        )
        dropped = set(block.minus)
        kept = [column for column in parent if column not in dropped]
        return tuple(dict.fromkeys([*kept, *block.plus]))

    def select_block(self, name: str) -> tuple[list[str], list[str]]:
        """Numeric and categorical columns of a block, in registry order."""
        chosen = set(self.block_columns(name))
        return (
            [column for column in self.numeric if column in chosen],
            [column for column in self.categorical if column in chosen],
        )


@dataclass(frozen=True)
class SplitYears:
    """Calendar rule of the holdout: train up to, validation in, test from."""

    train_end: int = 2021
    validation: int = 2022
    test_start: int = 2023
