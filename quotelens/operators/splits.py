"""Populations, calendar splits and expanding yearly folds.  A split is always a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens import functions as fn
from quotelens import schema as S
from quotelens.operators.ordered import positions

DECISION_SPLITS = ("train", "validation")


def trainable(quotes: DataFrame) -> DataFrame:
    return quotes.where(F.col("executed") & F.col(S.TARGET).isNotNull())


def executed_only(quotes: DataFrame) -> DataFrame:
    """Rows flagged true; a missing flag is not an execution."""
    return quotes.where(F.col("executed").eqNullSafe(F.lit(True)))


def decision_rows(frame: DataFrame, split: str = "split") -> DataFrame:
    return frame.where(F.col(split).isin(*DECISION_SPLITS))


def exclude_test(frame: DataFrame, split: str = "split", include_test: bool = False) -> DataFrame:
    return frame if include_test else frame.where(F.col(split) != "test")


def split_label(year: Column, years: S.SplitYears) -> Column:
    return (
        F.when(year <= years.train_end, "train")
        .when(year == years.validation, "validation")
        .when(year >= years.test_start, "test")
    )


def temporal_split(frame: DataFrame, years: S.SplitYears, date: str = "requested_date") -> DataFrame:
    return frame.withColumn("split", split_label(F.year(date), years))


def chronological_split(
    frame: DataFrame, date: str = "requested_date", id_column: str = S.ID
) -> DataFrame:
    """70/15/15 by row count along the date; days are ordered inside by a digest of the id.

    The digest spreads one crowded day over 256 buckets, so no day is sorted in one task.
    """
    keyed = frame.withColumn("_digest", F.md5(F.col(id_column).cast("string")))
    bucket = F.struct(F.col(date).alias("d"), F.substring("_digest", 1, 2).alias("h"))
    placed = positions(keyed, [], [date, "_digest"], bucket, "_place")
    total = frame.agg(F.count(F.lit(1)).alias("rows")).scalar()
    share = F.col("_place")
    label = (
        F.when(share < F.floor(total * F.lit(0.7)), "train")
        .when(share < F.floor(total * F.lit(0.85)), "validation")
        .otherwise("test")
    )
    return placed.withColumn("split", label).drop("_place", "_digest")


def split_or_fallback(frame: DataFrame, years: S.SplitYears, date: str = "requested_date") -> DataFrame:
    """Calendar split, or the chronological one when a calendar part would be empty."""
    labelled = temporal_split(frame, years, date)
    # Three booleans decide which plan to use; nothing else reaches the driver.
    present = labelled.agg(
        *[F.coalesce(F.bool_or(F.col("split") == name), F.lit(False)).alias(name) for name in ("train", "validation", "test")]
    ).head()
    return labelled if all(present) else chronological_split(frame, date)


def fold_map(
    frame: DataFrame,
    years: S.SplitYears | None,
    date: str = "requested_date",
    min_train_years: int = 2,
) -> DataFrame:
    """(validation_year, train_end_year, role, year): which years each expanding fold uses.

    Built from the distinct years only, so it has at most years-squared rows.
    """
    present = frame.select(F.year(date).alias("year")).where("year is not null").distinct()
    ordered = present.agg(F.array_sort(F.collect_list("year")).alias("_years"))
    each = ordered.select("_years", F.posexplode("_years").alias("_at", "validation_year")).where(
        F.col("_at") >= min_train_years
    )
    if years is not None:
        each = each.where(F.col("validation_year") <= years.validation)
    used = each.select(
        "validation_year",
        F.element_at("_years", F.col("_at")).alias("train_end_year"),
        F.explode(F.slice("_years", F.lit(1), F.col("_at") + 1)).alias("year"),
    )
    role = F.when(F.col("year") == F.col("validation_year"), "validation").otherwise("train")
    return used.withColumn("role", role)


def rolling_folds(frame: DataFrame, years: S.SplitYears | None, date: str = "requested_date") -> DataFrame:
    """Fold membership: every row once per fold that uses its year."""
    keyed = frame.withColumn("year", F.year(date))
    return keyed.join(fold_map(frame, years, date), "year")


def fold_text(train_end: Column, validation: Column) -> Column:
    return F.concat(F.lit("train<="), train_end.cast("string"), F.lit(", validation="), validation.cast("string"))


def supervised(quotes: DataFrame, years: S.SplitYears) -> DataFrame:
    """Trainable quotes with split, calendar texts, basket list and segment."""
    members = fn.parse_basket(F.col("underlyings"))
    frame = temporal_split(trainable(quotes), years)
    frame = frame.withColumns(
        {
            "requested_year": F.year("requested_date"),
            "requested_quarter": fn.quarter_text(F.col("requested_date")),
            "requested_month": fn.month_text(F.col("requested_date")),
            "basket_size": F.size(members),
        }
    )
    return frame.withColumn("segment", fn.segment(F.col("basket_size"), F.col("basket_type")))
