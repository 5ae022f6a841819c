"""Batch scoring around a fitted model: coverage, range flags, clipping and intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens import functions as fn
from quotelens import schema as S
from quotelens.operators.asof import asof_join
from quotelens.operators.baskets import explode_basket


def request_ranges(development: DataFrame, series: DataFrame) -> DataFrame:
    """One row: min and max of five terms, accepted vocabularies, and the last series date.

    The two vocabularies hold the distinct products and frequency spellings of the contract
    catalogue, not data values.
    """
    bounds = development.agg(
        *[F.min(c).cast("double").alias(f"{c}_min") for c in S.RANGE_FIELDS],
        *[F.max(c).cast("double").alias(f"{c}_max") for c in S.RANGE_FIELDS],
        F.array_sort(F.collect_set("product_type")).alias("accepted_product_types"),
        F.array_sort(F.collect_set("observation_frequency")).alias("accepted_observation_frequencies"),
    )
    latest = series.agg(F.max("date").alias("market_data_as_of"))
    return (
        bounds.withColumn("_one", F.lit(1)).join(latest.withColumn("_one", F.lit(1)), "_one").drop("_one")
        .withColumn("max_market_data_staleness_days", F.lit(S.MAX_STALENESS_DAYS))
    )


def asof_latest_date(requests: DataFrame, series: DataFrame, id_column: str = S.ID) -> DataFrame:
    """Per request: oldest of the latest member dates, largest age, and members without history."""
    members = explode_basket(requests, "requested_date", id_column=id_column)
    dated = asof_join(
        members,
        series.withColumn("_seen_on", F.col("date")),
        by="underlying",
        left_time="requested_date",
        history_time="date",
        values=["_seen_on"],
    )
    age = F.datediff("requested_date", "date")
    return dated.groupBy(id_column).agg(
        F.min("date").alias("market_data_as_of"),
        F.max(age).alias("max_market_data_age_days"),
        F.count_if(F.col("date").isNull()).alias("members_without_history"),
    )


def coverage_check(
    requests: DataFrame,
    series: DataFrame,
    dimension: DataFrame,
    products: DataFrame,
    *,
    id_column: str = S.ID,
    max_age: int = S.MAX_STALENESS_DAYS,
) -> DataFrame:
    """Requests with ``reasons``: unknown member, unknown product, no history, stale history.

    ``products`` lists the accepted product types in one column; an empty list accepts all.
    """
    known = dimension.select("underlying", F.lit(True).alias("_known")).distinct()
    unknown = (
        explode_basket(requests, id_column=id_column)
        .join(known, "underlying", "left")
        .groupBy(id_column)
        .agg(F.count_if(F.col("_known").isNull()).alias("unknown_members"))
    )
    accepted = products.select(F.col(products.columns[0]).alias("product_type"), F.lit(True).alias("_accepted")).distinct()
    any_product = products.agg(F.count(F.lit(1)).alias("n")).scalar()
    ages = asof_latest_date(requests, series, id_column)
    joined = (
        requests.join(unknown, id_column, "left")
        .join(ages, id_column, "left")
        .join(accepted, "product_type", "left")
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.coalesce("unknown_members", F.lit(0)) > 0, F.lit("unknown_member")),
            F.when(F.col("_accepted").isNull() & (any_product > 0), F.lit("unknown_product")),
            F.when(F.coalesce("members_without_history", F.lit(0)) > 0, F.lit("no_history")),
            F.when(F.col("max_market_data_age_days") > max_age, F.lit("stale_history")),
        )
    )
    return joined.withColumn("reasons", reasons).drop("_accepted")


def ood_flags(requests: DataFrame, ranges: DataFrame) -> DataFrame:
    """Flag and message list for terms outside the one-row training range."""
    bounded = requests.withColumn("_one", F.lit(1)).join(
        ranges.select(
            F.lit(1).alias("_one"), *[f"{c}_min" for c in S.RANGE_FIELDS], *[f"{c}_max" for c in S.RANGE_FIELDS]
        ),
        "_one",
    )

    def message(name: str) -> Column:
        value, low, high = F.col(name).cast("double"), F.col(f"{name}_min"), F.col(f"{name}_max")
        shown = [fn.general_text(v) for v in (value, low, high)]
        text = F.format_string(f"{name}=%s is outside the training range [%s, %s]", *shown)
        return F.when((value < low) | (value > high), text)

    warnings = F.array_compact(F.array(*[message(c) for c in S.RANGE_FIELDS]))
    return (
        bounded.withColumn("warnings", warnings)
        .withColumn("out_of_distribution", F.size("warnings") > 0)
        .drop("_one", *[f"{c}_min" for c in S.RANGE_FIELDS], *[f"{c}_max" for c in S.RANGE_FIELDS])
    )


@dataclass(frozen=True)
class ServingRules:
    """What calibration decided: interval radius, its coverage, and whether to clip."""

    radius: float | None
    clipping: bool
    coverage: float = S.NOMINAL_COVERAGE
    model_name: str = "unknown"
    strategy: str = "global"
    model_version: str = "1"


def score_postprocess(
    rows: DataFrame, *, radius: Column | float | None, clipping: Column | bool, prediction: str = "prediction"
) -> DataFrame:
    """Clip, interval and rounding for raw predictions beside their contract terms."""
    months = fn.frequency_months(F.col("observation_frequency"))
    lower = F.greatest(F.col("no_call_period_months").cast("double"), months)
    upper = fn.month_diff(F.col("start_date"), F.col("end_date"))
    clip = clipping if isinstance(clipping, Column) else F.lit(clipping)
    reach = radius if isinstance(radius, Column) else F.lit(radius).cast("double")
    raw = F.col(prediction)
    bounded = rows.withColumns({"_lower": lower, "_upper": upper, "_reach": reach, "_clip": clip})
    bounded = bounded.withColumn(
        "_value", F.when(F.col("_clip"), fn.clip_to_contract(raw, F.col("_lower"), F.col("_upper"))).otherwise(raw)
    )
    low = F.greatest(F.col("_value") - F.col("_reach"), F.lit(0.0))
    high = F.col("_value") + F.col("_reach")
    known = F.col("_reach").isNotNull()
    return bounded.withColumns(
        {
            "predicted_avg_duration_months": F.round("_value", 4),
            "prediction_interval_lower_months": F.when(
                known, F.round(F.when(F.col("_clip"), F.greatest(low, F.col("_lower"))).otherwise(low), 4)
            ),
            "prediction_interval_upper_months": F.when(
                known, F.round(F.when(F.col("_clip"), F.least(high, F.col("_upper"))).otherwise(high), 4)
            ),
        }
    ).drop("_lower", "_upper", "_reach", "_clip", "_value")
