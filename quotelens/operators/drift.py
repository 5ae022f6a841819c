"""Distribution shift between the training split and later ones.

Numeric comparisons start from value counts per (feature, value): repeated values collapse before
the shuffle, and the cumulative distribution is then built in buckets (see ``ordered``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens import functions as fn
from quotelens.operators.ordered import null_safe_join, quantile_at, running_sums
from quotelens.operators.wide import pearson, wide_counts, wide_moments

MISSING = "__missing__"


def long_numeric(frame: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per (row, numeric column): ``ids``, ``feature``, ``value`` as double."""
    typed = frame.select(*ids, *[F.col(c).cast("double").alias(f"v_{c}") for c in columns])
    return typed.select(
        *ids,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v_{c}").alias("value")) for c in columns])
        ).alias("_kv"),
    ).select(*ids, "_kv.feature", "_kv.value")


def long_text(frame: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per (row, categorical column), values as text and nulls kept."""
    return frame.select(
        *ids,
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]
            )
        ).alias("_kv"),
    ).select(*ids, "_kv.feature", "_kv.value")


def split_counts(long: DataFrame, keys: Sequence[str], split: str, names: Sequence[str]) -> DataFrame:
    """Rows per (keys, value) with one count column per split."""
    return (
        long.where(F.col("value").isNotNull())
        .groupBy(*keys, "value")
        .agg(*[F.count_if(F.col(split) == name).alias(f"n_{name}") for name in names])
    )


def ecdf_distances(
    ranked: DataFrame, keys: Sequence[str], base: str, other: str
) -> DataFrame:
    """KS statistic and Wasserstein distance from ``running_sums`` over two count columns."""
    gap = F.abs(F.try_divide(_num(base), _den(base)) - F.try_divide(_num(other), _den(other)))
    step = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    return ranked.groupBy(*keys).agg(
        F.max(gap).alias("ks_statistic"),
        F.sum(gap * step).alias("wasserstein_distance"),
        F.max(f"n_{base}_total").alias("_n_base"),
        F.max(f"n_{other}_total").alias("_n_other"),
    )


def _num(name: str) -> Column:
    return (F.col(f"n_{name}_before") + F.col(f"n_{name}")).cast("double")


def _den(name: str) -> Column:
    return F.col(f"n_{name}_total").cast("double")


def two_sample(long: DataFrame, keys: Sequence[str], split: str, base: str, other: str) -> DataFrame:
    """KS (with asymptotic p-value) and Wasserstein per key between two split labels."""
    counts = split_counts(long.where(F.col(split).isin(base, other)), keys, split, (base, other))
    ranked = running_sums(counts, keys, "value", [f"n_{base}", f"n_{other}"])
    out = ecdf_distances(ranked, keys, base, other)
    both = (F.col("_n_base") > 0) & (F.col("_n_other") > 0)
    return out.where(both).select(
        *keys,
        "ks_statistic",
        fn.ks_sf(F.col("ks_statistic"), F.col("_n_base"), F.col("_n_other")).alias("ks_p_value"),
        "wasserstein_distance",
    )


def numeric_drift(
    frame: DataFrame, columns: Sequence[str], compared: Sequence[str] = ("validation",), split: str = "split"
) -> DataFrame:
    """Per (split, numeric column): rows, means, shift in train SD, KS, Wasserstein, status."""
    names = ("train", *compared)
    long = long_numeric(frame, [split], columns)
    moments = long.where(F.col("value").isNotNull()).groupBy("feature").agg(
        *[F.count_if(F.col(split) == n).alias(f"rows_{n}") for n in names],
        *[F.avg(F.when(F.col(split) == n, F.col("value"))).alias(f"mean_{n}") for n in names],
        F.stddev_pop(F.when(F.col(split) == "train", F.col("value"))).alias("_sd"),
        F.min(F.when(F.col(split) == "train", F.col("value"))).alias("_low"),
        F.max(F.when(F.col(split) == "train", F.col("value"))).alias("_high"),
    )
    ranked = running_sums(
        split_counts(long, ["feature"], split, names), ["feature"], "value", [f"n_{n}" for n in names]
    )
    distances = ranked.groupBy("feature").agg(
        *[
            agg
            for n in compared
            for agg in (
                F.max(_gap("train", n)).alias(f"ks_{n}"),
                F.sum(_gap("train", n) * F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))).alias(f"w_{n}"),
            )
        ]
    )
    sd = F.when(F.col("_low") < F.col("_high"), F.col("_sd"))
    wide = moments.join(distances, "feature")
    per_split = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("split"),
                    F.col("rows_train").alias("train_rows"),
                    F.col(f"rows_{n}").alias("compared_rows"),
                    F.col("mean_train").alias("train_mean"),
                    F.col(f"mean_{n}").alias("compared_mean"),
                    F.try_divide(F.col(f"mean_{n}") - F.col("mean_train"), sd).alias("standardized_mean_shift"),
                    F.col(f"ks_{n}").alias("ks_statistic"),
                    F.col(f"w_{n}").alias("wasserstein_distance"),
                )
                for n in compared
            ]
        )
    )
    out = wide.select("feature", per_split.alias("_row")).select("feature", "_row.*")
    return out.where("train_rows > 0 and compared_rows > 0").withColumns(
        {
            "ks_p_value": fn.ks_sf(F.col("ks_statistic"), F.col("train_rows"), F.col("compared_rows")),
            "status": fn.drift_status(
                (F.col("ks_statistic"), "ks"), (F.col("standardized_mean_shift"), "shift")
            ),
        }
    )


def _gap(base: str, other: str) -> Column:
    return F.abs(F.try_divide(_num(base), _den(base)) - F.try_divide(_num(other), _den(other)))


def categorical_drift(
    frame: DataFrame, columns: Sequence[str], compared: Sequence[str] = ("validation",), split: str = "split"
) -> DataFrame:
    """Per (split, column): category counts, base-2 Jensen-Shannon divergence, largest share move."""
    long = long_text(frame, [split], columns).fillna(MISSING, subset=["value"])
    names = ("train", *compared)
    counts = long.groupBy("feature", "value").agg(
        *[F.count_if(F.col(split) == n).alias(f"n_{n}") for n in names]
    )
    totals = counts.groupBy("feature").agg(*[F.sum(f"n_{n}").alias(f"t_{n}") for n in names])
    shares = counts.join(totals, "feature").select(
        "feature",
        *[f"n_{n}" for n in names],
        *[F.coalesce(F.try_divide(F.col(f"n_{n}").cast("double"), F.col(f"t_{n}").cast("double")), F.lit(0.0)).alias(f"p_{n}") for n in names],
    )

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def divergence(n: str) -> Column:
        p, q = F.col("p_train"), F.col(f"p_{n}")
        middle = (p + q) / 2
        return F.sum((part(p, middle) + part(q, middle)) / 2)

    wide = shares.groupBy("feature").agg(
        F.count_if(F.col("n_train") > 0).alias("train_categories"),
        *[F.count_if(F.col(f"n_{n}") > 0).alias(f"k_{n}") for n in compared],
        *[divergence(n).alias(f"js_{n}") for n in compared],
        *[F.max(F.abs(F.col(f"p_{n}") - F.col("p_train"))).alias(f"d_{n}") for n in compared],
    )
    per_split = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("split"),
                    F.col("train_categories"),
                    F.col(f"k_{n}").alias("compared_categories"),
                    F.greatest(F.col(f"js_{n}"), F.lit(0.0)).alias("jensen_shannon_divergence"),
                    F.col(f"d_{n}").alias("max_category_share_delta"),
                )
                for n in compared
            ]
        )
    )
    out = wide.select("feature", per_split.alias("_row")).select("feature", "_row.*")
    return out.withColumn(
        "status",
        fn.drift_status(
            (F.col("jensen_shannon_divergence"), "js"), (F.col("max_category_share_delta"), "share")
        ),
    )


def missingness_drift(
    frame: DataFrame, columns: Sequence[str], compared: Sequence[str] = ("validation",), split: str = "split"
) -> DataFrame:
    """Null-rate change per column, from one pass over the wide rows."""
    def rate(column: str, name: str) -> Column:
        inside = F.col(split) == name
        return F.try_divide(
            F.count_if(inside & F.col(column).isNull()).cast("double"), F.count_if(inside).cast("double")
        )

    wide = frame.agg(
        *[rate(c, n).alias(f"{n}__{c}") for c in columns for n in ("train", *compared)]
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("split"),
                    F.lit(c).alias("feature"),
                    F.col(f"train__{c}").alias("train_missing_rate"),
                    F.col(f"{n}__{c}").alias("compared_missing_rate"),
                )
                for n in compared
                for c in columns
            ]
        )
    )
    out = wide.select(rows.alias("_row")).select("_row.*")
    delta = F.col("compared_missing_rate") - F.col("train_missing_rate")
    return out.withColumn("missing_rate_delta", delta).withColumn(
        "status", fn.drift_status((F.col("missing_rate_delta"), "missing"))
    )


def drift_status_counts(**tables: DataFrame) -> DataFrame:
    """Rows per (table, status) over named drift tables."""
    out = None
    for name, table in tables.items():
        part = table.groupBy("status").agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table"), "status", "row_count"
        )
        out = part if out is None else out.unionByName(part)
    return out


def feature_drift(
    frame: DataFrame,
    features: Sequence[str],
    *,
    target: str = "target",
    segment: str = "segment",
    split: str = "split",
    segments: Sequence[str] = ("single", "worst_of"),
) -> DataFrame:
    """Per (segment, feature): train against validation, with target correlation in both."""
    names = ("train", "validation")
    kept = frame.where(F.col(segment).isin(*segments) & F.col(split).isin(*names))
    keys = [segment, "feature"]

    moments = wide_moments(kept, [segment, split], features, target).groupBy(*keys).agg(
        *[agg for n in names for agg in _side(n, split)]
    )
    counts = wide_counts(kept, [segment, split], features).groupBy(*keys, "value").agg(
        *[F.sum(F.when(F.col(split) == n, F.col("n")).otherwise(0)).alias(f"n_{n}") for n in names]
    )
    ranked = running_sums(counts, keys, "value", ["n_train", "n_validation"])
    shape = ranked.groupBy(*keys).agg(
        quantile_at(F.col("value"), 0.95, "n_train").alias("train_p95"),
        quantile_at(F.col("value"), 0.95, "n_validation").alias("validation_p95"),
        F.max(_gap("train", "validation")).alias("ks_statistic"),
        F.sum(
            _gap("train", "validation") * F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
        ).alias("wasserstein_distance"),
    )
    wide = null_safe_join(moments, shape, keys, "left")
    shift = F.try_divide(
        F.col("validation_mean") - F.col("train_mean"),
        F.when(F.col("_train_low") < F.col("_train_high"), F.col("_train_sd")),
    )
    return wide.select(
        segment,
        "feature",
        "train_mean",
        "validation_mean",
        "train_p95",
        "validation_p95",
        "train_missing_rate",
        "validation_missing_rate",
        (F.col("validation_missing_rate") - F.col("train_missing_rate")).alias("missing_rate_delta"),
        "ks_statistic",
        fn.ks_sf(F.col("ks_statistic"), F.col("_train_n"), F.col("_validation_n")).alias("ks_p_value"),
        "wasserstein_distance",
        shift.alias("validation_shift_in_train_sd"),
        "train_target_corr",
        "validation_target_corr",
        F.abs(shift).alias("abs_validation_shift_in_train_sd"),
    )


def _side(name: str, split: str) -> list[Column]:
    """One split's columns from the row of ``wide_moments`` that it has per (segment, feature)."""

    def of(column: Column) -> Column:
        return F.max(F.when(F.col(split) == name, column))

    some = F.col("n") > 0
    return [
        F.coalesce(of(F.col("n")), F.lit(0)).alias(f"_{name}_n"),
        of(F.when(some, F.col("mean"))).alias(f"{name}_mean"),
        of(F.when(some, F.sqrt(F.col("m2") / F.col("n")))).alias(f"_{name}_sd"),
        of(F.col("low")).alias(f"_{name}_low"),
        of(F.col("high")).alias(f"_{name}_high"),
        of((F.col("rows") - F.col("n")).cast("double") / F.col("rows")).alias(f"{name}_missing_rate"),
        of(pearson()).alias(f"{name}_target_corr"),
    ]


def correlation_stability(drift: DataFrame) -> DataFrame:
    """Spread and sign change of the target correlation between train and validation."""
    train, validation = F.col("train_target_corr"), F.col("validation_target_corr")
    known = train.isNotNull() & validation.isNotNull()
    spread = F.when(known, F.abs(train - validation)).when(
        train.isNotNull() | validation.isNotNull(), F.lit(0.0)
    )
    flip = F.coalesce(known & (train * validation < 0), F.lit(False))
    return drift.select(
        "segment",
        "feature",
        "train_target_corr",
        "validation_target_corr",
        spread.alias("corr_range"),
        flip.alias("validation_sign_flip_vs_train"),
        "abs_validation_shift_in_train_sd",
    )
