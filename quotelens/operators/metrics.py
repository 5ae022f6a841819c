"""Regression metrics and error slices over (actual, prediction) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens import functions as fn
from quotelens import schema as S
from quotelens.operators.ordered import exact_quantiles, null_safe_join


def absolute_error(actual: str = "actual", prediction: str = "prediction") -> Column:
    return F.abs(F.col(actual) - F.col(prediction))


def regression_metrics(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R2 and median absolute error per group.

    The total sum of squares is ``n`` times the population variance, which Spark merges from
    partial aggregates, so the rows are read once for the three means.
    """
    keys = list(keys)
    error = F.col("actual") - F.col("prediction")
    spread = F.var_pop("actual") * F.count(F.lit(1))
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1.0 - F.try_divide(F.sum(error * error), spread)).alias("r2"),
    )
    middle = exact_quantiles(
        rows.withColumn("_error", absolute_error()), keys, "_error", {"median_absolute_error": 0.5}
    )
    return null_safe_join(sums, middle, keys) if keys else _single(sums, middle)


def _single(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put two one-row results side by side."""
    return (
        left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one").drop("_one")
    )


def segment_mae(rows: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """MAE per value of a column, missing values kept as their own group."""
    return (
        rows.groupBy(*keys, column)
        .agg(F.avg(absolute_error()).alias("mae"), F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("mae"), F.desc("count"))
    )


def bucket_mae(rows: DataFrame) -> DataFrame:
    """MAE per duration class; classes without rows stay, with count 0."""
    label = fn.duration_bucket(F.col("actual"))
    errors = rows.groupBy(label.alias("duration_bucket")).agg(
        F.avg(absolute_error()).alias("mae"), F.count(F.lit(1)).alias("count")
    )
    classes = rows.sparkSession.createDataFrame([(name,) for name in S.DURATION_LABELS], "duration_bucket string")
    return classes.join(errors, "duration_bucket", "left").fillna(0, subset=["count"])


def member_mae(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """MAE per basket member; a quote counts once for each of its members."""
    exploded = rows.withColumn("underlying", F.explode(fn.parse_basket(F.col("underlyings"))))
    return segment_mae(exploded, "underlying", keys)


def rolling_summary(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, spread and worst fold per model from a table of fold metrics."""
    return folds.groupBy(*keys).agg(
        F.avg("validation_mae").alias("rolling_mae_mean"),
        F.stddev_samp("validation_mae").alias("rolling_mae_std"),
        F.min("validation_mae").alias("rolling_mae_min"),
        F.max("validation_mae").alias("rolling_mae_max"),
        F.avg("validation_rmse").alias("rolling_rmse_mean"),
        F.avg("validation_r2").alias("rolling_r2_mean"),
        F.min("validation_rows").alias("min_validation_rows"),
        F.max("validation_rows").alias("max_validation_rows"),
        F.count(F.lit(1)).alias("n_folds"),
    )


def weighted_fold_mae(folds: DataFrame) -> DataFrame:
    """Row-weighted MAE per year over segments, for years with one model per segment."""
    per_segment = folds.groupBy("validation_year", "segment").agg(
        F.count_distinct("model_name").alias("models"),
        F.sum(F.col("validation_mae") * F.col("validation_rows")).alias("weighted"),
        F.sum("validation_rows").alias("row_count"),
        F.array_sort(F.collect_set("model_name")).alias("names"),
    )
    return (
        per_segment.groupBy("validation_year")
        .agg(
            F.max("models").alias("models"),
            F.try_divide(F.sum("weighted"), F.sum("row_count")).alias("weighted_validation_mae"),
            F.sum("row_count").alias("validation_rows"),
            F.array_join(F.array_sort(F.collect_set("segment")), ",").alias("segments"),
            F.array_join(F.array_sort(F.flatten(F.collect_list("names"))), " + ").alias("portfolio_model_names"),
        )
        .where("models = 1 and validation_rows > 0")
        .drop("models")
    )


def segmented_summary(results: DataFrame) -> DataFrame:
    keys = ["segment", "model_name", "feature_block", "encoding_strategy"]
    return results.groupBy(*keys).agg(
        F.avg("validation_mae").alias("validation_mae"),
        F.min("n_total_features").alias("n_total_features"),
        F.min("train_rows").alias("train_rows"),
        F.min("validation_rows").alias("validation_rows"),
    )
