"""Data-quality predicates.  Each returns its violations; ``validate_all`` returns one report."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelens import functions as fn
from quotelens import schema as S
from quotelens.operators.baskets import explode_basket


class ValidationError(ValueError):
    """Raised by fail-fast validation; names the first broken rule."""


def _between(name: str, low: float, high: float) -> Column:
    return F.col(name).between(low, high)


def quote_rules(protection_floor_open: bool = False) -> dict[str, Column]:
    """Row predicates of the quote table; a row passes when the predicate is true."""
    required = [f.name for f in S.QUOTES.fields if f.name != S.TARGET]
    protection = _between("protection_barrier_pct", 0.0, 1.5)
    if protection_floor_open:
        protection = protection & (F.col("protection_barrier_pct") > 0)
    return {
        **{f"{name}_not_null": F.col(name).isNotNull() for name in required},
        "basket_type_vocabulary": F.col("basket_type").isin("single", "worst_of"),
        "autocall_range": _between("autocall_barrier_pct", 0.5, 2.0),
        "protection_range": protection,
        "no_call_not_negative": F.col("no_call_period_months") >= 0,
        "implied_vol_range": _between("quoted_implied_vol", 0.0, 2.0),
        "notional_positive": F.col("notional_credits") > 0,
        "target_not_negative": F.col(S.TARGET) >= 0,
    }


def series_rules() -> dict[str, Column]:
    return {
        "date_not_null": F.col("date").isNotNull(),
        "underlying_not_null": F.col("underlying").isNotNull(),
        "realized_vol_63d_not_null": F.col("realized_vol_63d").isNotNull(),
        "realized_vol_range": _between("realized_vol_63d", 0.0, 2.0),
    }


def dimension_rules() -> dict[str, Column]:
    return {
        "underlying_not_null": F.col("underlying").isNotNull(),
        "sector_not_null": F.col("sector").isNotNull(),
        "structural_base_vol_not_null": F.col("structural_base_vol").isNotNull(),
        "base_vol_range": _between("structural_base_vol", 0.0, 2.0),
    }


def count_violations(frame: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations) in a single pass; a null check result is not a violation."""
    counts = frame.agg(*[F.count_if(~ok).alias(name) for name, ok in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def dimension_report(dimension: DataFrame) -> DataFrame:
    """Row rules of the dimension plus the number of keys that occur more than once."""
    repeated = duplicate_keys(dimension, ["underlying"]).agg(F.count(F.lit(1)).alias("violations"))
    return count_violations(dimension, dimension_rules()).unionByName(
        repeated.select(F.lit("underlying_unique").alias("rule"), "violations")
    )


def duplicate_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def _maturity() -> Column:
    return fn.month_diff(F.col("start_date"), F.col("end_date"))


def row_breaks() -> dict[str, Column]:
    """Cross-column conditions that break a quote row."""
    members = fn.parse_basket(F.col("underlyings"))
    size = F.size(members)
    single, worst_of = F.col("basket_type") == "single", F.col("basket_type") == "worst_of"
    return {
        "date_order": F.col("end_date") <= F.col("start_date"),
        "start_after_request": F.col("start_date") < F.col("requested_date"),
        "no_call_within_maturity": F.col("no_call_period_months") > _maturity(),
        "target_iff_executed": F.col(S.TARGET).isNotNull() != F.coalesce(F.col("executed"), F.lit(False)),
        "duplicate_members": size != F.size(F.array_distinct(members)),
        "size": (single & (size != 1)) | (worst_of & (size < 2)),
    }


def date_order(quotes: DataFrame) -> DataFrame:
    return quotes.where(row_breaks()["date_order"]).select(S.ID, "start_date", "end_date")


def start_after_request(quotes: DataFrame) -> DataFrame:
    return quotes.where(row_breaks()["start_after_request"]).select(S.ID, "requested_date", "start_date")


def no_call_within_maturity(quotes: DataFrame) -> DataFrame:
    return quotes.where(row_breaks()["no_call_within_maturity"]).select(
        S.ID, "no_call_period_months", _maturity().alias("maturity_months")
    )


def target_iff_executed(quotes: DataFrame) -> DataFrame:
    return quotes.where(row_breaks()["target_iff_executed"]).select(S.ID, "executed", S.TARGET)


def basket_duplicates(quotes: DataFrame) -> DataFrame:
    return quotes.where(row_breaks()["duplicate_members"]).select(S.ID, "underlyings")


def basket_size(quotes: DataFrame) -> DataFrame:
    members = F.size(fn.parse_basket(F.col("underlyings")))
    return quotes.where(row_breaks()["size"]).select(S.ID, "basket_type", members.alias("members"))


def frequency_vocabulary(quotes: DataFrame) -> DataFrame:
    """Spellings outside the vocabulary, with how many rows use each."""
    seen = quotes.where("observation_frequency is not null").groupBy("observation_frequency").agg(
        F.count(F.lit(1)).alias("row_count")
    )
    return seen.where(fn.frequency_months(F.col("observation_frequency")).isNull())


def series_gaps(series: DataFrame, limit: int = S.MAX_SERIES_GAP_DAYS) -> DataFrame:
    """Largest day gap per member and whether it breaks the limit.

    The series is bucketed by month: gaps inside a month come from a lag, gaps between months
    from the first and last dates of each (member, month), so a long member is never one task.
    """
    placed = series.select("underlying", "date", F.date_trunc("month", "date").alias("_bucket"))
    placed = placed.repartition("underlying", "_bucket")
    inside = Window.partitionBy("underlying", "_bucket").orderBy("date")
    stepped = placed.withColumn("_step", F.datediff("date", F.lag("date").over(inside)))
    months = stepped.groupBy("underlying", "_bucket").agg(
        F.max("_step").alias("_step"), F.min("date").alias("_first"), F.max("date").alias("_last")
    )
    across = Window.partitionBy("underlying").orderBy("_bucket")
    jump = F.datediff("_first", F.lag("_last").over(across))
    return (
        months.withColumn("_jump", jump)
        .groupBy("underlying")
        .agg(F.max(F.greatest("_step", "_jump")).alias("max_gap_days"))
        .withColumn("too_long", F.coalesce(F.col("max_gap_days") > limit, F.lit(False)))
    )


def unknown_members(quotes: DataFrame, dimension: DataFrame) -> DataFrame:
    """Members that the dimension does not list, with how many baskets mention them."""
    mentions = explode_basket(quotes).groupBy("underlying").agg(F.count(F.lit(1)).alias("mentions"))
    return mentions.join(dimension.select("underlying"), "underlying", "left_anti")


def history_coverage(quotes: DataFrame, series: DataFrame) -> DataFrame:
    """Quotes with a member that has no series row on or before the request date."""
    first = series.groupBy("underlying").agg(F.min("date").alias("_first"))
    members = explode_basket(quotes, "requested_date").join(first, "underlying", "left")
    missing = F.col("_first").isNull() | (F.col("_first") > F.col("requested_date"))
    return (
        members.groupBy(S.ID)
        .agg(F.count_if(missing).alias("uncovered_members"))
        .where("uncovered_members > 0")
    )


def validate_all(
    quotes: DataFrame, series: DataFrame, dimension: DataFrame, *, fail_fast: bool = False
) -> DataFrame:
    """(step, table, rule, violations) in the order in which the rules are meant to be read.

    All conditions that need only one quote row are counted in one scan of the quotes.
    """
    rules, breaks = quote_rules(), row_breaks()
    row_rules = {
        "schema": (1, "quotes", sum((F.count_if(~ok) for ok in rules.values()), start=F.lit(0))),
        **{
            name: (step, table, F.count_if(breaks[name]))
            for name, step, table in (
                ("date_order", 3, "quotes"),
                ("start_after_request", 4, "quotes"),
                ("no_call_within_maturity", 5, "quotes"),
                ("target_iff_executed", 6, "quotes"),
                ("duplicate_members", 13, "baskets"),
                ("size", 14, "baskets"),
            )
        },
    }
    counted = quotes.agg(*[count.alias(name) for name, (_, _, count) in row_rules.items()])
    one_scan = counted.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(step).alias("step"), F.lit(table).alias("table"), F.lit(name).alias("rule"), F.col(name).alias("violations")
                    )
                    for name, (step, table, _) in row_rules.items()
                ]
            )
        ).alias("_r")
    ).select("_r.*")

    def labelled(step: int, table: str, rule: str, total: DataFrame) -> DataFrame:
        return total.select(F.lit(step).alias("step"), F.lit(table).alias("table"), F.lit(rule).alias("rule"), "violations")

    def summed(step: int, table: str, rule: str, frame: DataFrame) -> DataFrame:
        return labelled(step, table, rule, frame.agg(F.count(F.lit(1)).alias("violations")))

    def schema(step: int, table: str, frame: DataFrame) -> DataFrame:
        return labelled(step, table, "schema", frame.agg(F.sum("violations").alias("violations")))

    steps = [
        one_scan,
        summed(2, "quotes", "unique_id", duplicate_keys(quotes, [S.ID])),
        summed(7, "quotes", "frequency_vocabulary", frequency_vocabulary(quotes)),
        schema(8, "series", count_violations(series, series_rules())),
        summed(9, "series", "unique_key", duplicate_keys(series, ["underlying", "date"])),
        summed(10, "series", "gap", series_gaps(series).where("too_long")),
        schema(11, "dimension", dimension_report(dimension)),
        summed(12, "baskets", "membership", unknown_members(quotes, dimension)),
        summed(15, "baskets", "history_coverage", history_coverage(quotes, series)),
    ]
    report = reduce(DataFrame.unionByName, steps)
    if fail_fast:
        # The report has one row per rule, whatever the size of the tables.
        broken = report.where("violations > 0").orderBy("step").head()
        if broken is not None:
            raise ValidationError(f"{broken['table']}.{broken['rule']}: {broken['violations']} violations")
    return report


# --------------------------------------------------------------------------------------
# Request contract
# --------------------------------------------------------------------------------------


def check_request_columns(columns: list[str]) -> None:
    """Refuse unknown columns and missing required ones before any row is read."""
    known = {f.name for f in S.REQUEST.fields}
    extra = sorted(set(columns) - known - set(S.HISTORY_ONLY_COLUMNS) - {"request_ord"})
    optional = {"counterparty", "trader_id"}
    absent = sorted(known - optional - set(columns))
    if extra or absent:
        raise ValidationError(f"unknown request columns {extra}, missing columns {absent}")


def request_contract(requests: DataFrame, *, atomic: bool = False) -> DataFrame:
    """Normalised requests with ``reasons``: the list of rules each row breaks.

    History-only columns are dropped, members are uppercased, and protection must be above zero.
    With ``atomic`` one bad row refuses the whole batch.
    """
    check_request_columns(requests.columns)
    frame = requests.drop(*S.HISTORY_ONLY_COLUMNS)
    for name in ("counterparty", "trader_id"):
        if name not in frame.columns:
            frame = frame.withColumn(name, F.lit(S.UNKNOWN))
        frame = frame.withColumn(name, F.coalesce(name, F.lit(S.UNKNOWN)))
    members = F.transform(fn.parse_basket(F.col("underlyings")), lambda name: F.upper(name))
    frame = frame.withColumn("_members", members).withColumns(
        {
            "underlyings": F.array_join("_members", "|"),
            "observation_frequency": F.trim("observation_frequency"),
        }
    )
    size = F.coalesce(F.size("_members"), F.lit(0))
    maturity = fn.month_diff(F.col("start_date"), F.col("end_date"))
    required = [f.name for f in S.REQUEST.fields if f.name not in ("counterparty", "trader_id")]
    any_null = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in required])
    broken = {
        "missing_value": any_null,
        "basket_type": ~F.col("basket_type").isin("single", "worst_of"),
        "autocall_range": ~_between("autocall_barrier_pct", 0.5, 2.0),
        "protection_range": ~((F.col("protection_barrier_pct") > 0) & (F.col("protection_barrier_pct") <= 1.5)),
        "no_call_negative": F.col("no_call_period_months") < 0,
        "implied_vol_range": ~_between("quoted_implied_vol", 0.0, 2.0),
        "notional_not_positive": F.col("notional_credits") <= 0,
        "empty_basket": size == 0,
        "duplicate_members": size != F.size(F.array_distinct("_members")),
        "frequency": fn.frequency_months(F.col("observation_frequency")).isNull(),
        "date_order": F.col("end_date") <= F.col("start_date"),
        "requested_after_start": F.col("requested_date") > F.col("start_date"),
        "no_call_beyond_maturity": F.col("no_call_period_months") > maturity,
        "basket_size": ((F.col("basket_type") == "single") & (size != 1))
        | ((F.col("basket_type") == "worst_of") & (size < 2)),
    }
    reasons = F.array_compact(
        F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in broken.items()])
    )
    checked = frame.withColumn("reasons", reasons).drop("_members")
    if atomic:
        bad = checked.where(F.size("reasons") > 0).head()
        if bad is not None:
            raise ValidationError(f"batch refused: {bad['reasons']}")
    return checked
