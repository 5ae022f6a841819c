"""Correlation, rank correlation, feature signal and independence tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens import functions as fn
from quotelens import schema as S
from quotelens.operators.drift import MISSING, long_numeric, long_text, two_sample
from quotelens.operators.ordered import exact_quantiles, null_safe_join, running_sums
from quotelens.operators.wide import pearson, wide_moments

MIN_SIGNAL_ROWS = 30
MIN_CATEGORY_ROWS = 20


def pearson_terms(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null when either side does not vary."""
    both = x.isNotNull() & y.isNotNull()
    left, right = F.when(both, x), F.when(both, y)
    varies = (F.min(left) < F.max(left)) & (F.min(right) < F.max(right))
    ratio = F.try_divide(F.covar_pop(left, right), F.stddev_pop(left) * F.stddev_pop(right))
    return F.when(varies, ratio)


def target_correlations(frame: DataFrame, features: Sequence[str], target: str = S.TARGET) -> DataFrame:
    """Pearson correlation of every numeric feature with the target, strongest first."""
    out = wide_moments(frame, [], features, target).select("feature", pearson().alias("correlation_with_target"))
    return out.orderBy(F.abs("correlation_with_target").desc_nulls_last(), "feature")


def spearman(long: DataFrame, keys: Sequence[str], x: str = "value", y: str = "target") -> DataFrame:
    """Rank correlation per key over pairwise complete rows: ``spearman``, ``pair_rows``.

    Equal pairs collapse first.  Ranks of ``y`` are joined onto the pairs, pairs are summed per
    ``x``, and ranks of ``x`` come from the running count of that sum, so there is one join and
    no key is ranked in a single task.
    """
    keys = list(keys)
    pairs = (
        long.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, x, y)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    y_counts = pairs.groupBy(*keys, y).agg(F.sum("n").alias("n"))
    y_ranks = running_sums(y_counts, keys, y, ["n"]).select(
        *keys, y, (fn.average_rank(F.col("n_before"), F.col("n")) - (F.col("n_total") + 1) / 2).alias("_ry")
    )
    ranked = null_safe_join(pairs, y_ranks, [*keys, y])
    per_x = ranked.groupBy(*keys, x).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("_ry")).alias("_sum_ry"),
        F.sum(F.col("n") * F.col("_ry") * F.col("_ry")).alias("_sum_ry2"),
    )
    x_ranks = running_sums(per_x, keys, x, ["n"]).withColumn(
        "_rx", fn.average_rank(F.col("n_before"), F.col("n")) - (F.col("n_total") + 1) / 2
    )
    out = x_ranks.groupBy(*keys).agg(
        F.sum("n").alias("pair_rows"),
        F.sum(F.col("_rx") * F.col("_sum_ry")).alias("_xy"),
        F.sum(F.col("n") * F.col("_rx") * F.col("_rx")).alias("_xx"),
        F.sum("_sum_ry2").alias("_yy"),
    )
    return out.select(
        *keys, "pair_rows", F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy"))).alias("spearman")
    )


def direction(value: Column, threshold: float = 0.05) -> Column:
    return (
        F.when(value.isNull(), "not_applicable")
        .when(value > threshold, "positive")
        .when(value < -threshold, "negative")
        .otherwise("mixed_or_flat")
    )


def feature_signal_report(
    frame: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str = S.TARGET
) -> DataFrame:
    """Per feature: rank correlation with the target, its direction, distinct values, null rate."""
    frame = frame.withColumn("_target", F.col(target))
    numbers = long_numeric(frame, ["_target"], numeric)
    texts = long_text(frame, ["_target"], categorical)

    def shape(long: DataFrame, kind: str) -> DataFrame:
        per_value = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        return per_value.groupBy("feature").agg(
            F.lit(kind).alias("feature_type"),
            F.count("value").alias("n_unique"),
            F.try_divide(
                F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).cast("double"),
                F.sum("n").cast("double"),
            ).alias("missing_rate"),
        )

    rho = spearman(numbers.withColumnRenamed("_target", "target"), ["feature"])
    numeric_rows = shape(numbers, "numeric").join(rho, "feature", "left").select(
        "feature",
        "feature_type",
        F.col("spearman").alias("train_target_spearman"),
        direction(F.col("spearman")).alias("target_correlation_direction"),
        "n_unique",
        "missing_rate",
    )
    text_rows = shape(texts, "categorical").select(
        "feature",
        "feature_type",
        F.lit(None).cast("double").alias("train_target_spearman"),
        F.lit("categorical_not_ordered").alias("target_correlation_direction"),
        "n_unique",
        "missing_rate",
    )
    return numeric_rows.unionByName(text_rows)


def feature_signal(
    frame: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    *,
    keys: Sequence[str] = (),
    target: str = "target",
) -> DataFrame:
    """Strength per feature: |rank correlation|, or the spread of category medians in target SDs.

    Null unless there are at least 30 complete rows; only categories with 20 rows count.
    """
    keys = list(keys)
    strong_enough = F.when(F.col("pair_rows") >= MIN_SIGNAL_ROWS, F.abs("spearman"))
    ranked = spearman(long_numeric(frame, [*keys, target], numeric), [*keys, "feature"], y=target)
    numeric_rows = ranked.select(
        *keys, "feature", F.lit("numeric").alias("feature_type"), strong_enough.alias("signal")
    )
    if not categorical:
        return numeric_rows
    texts = long_text(frame, [*keys, target], categorical).where(
        F.col("value").isNotNull() & F.col(target).isNotNull()
    )
    group = [*keys, "feature"]
    sizes = texts.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("size"))
    medians = exact_quantiles(texts, [*group, "value"], target, {"median": 0.5})
    kept = null_safe_join(sizes, medians, [*group, "value"]).where(F.col("size") >= MIN_CATEGORY_ROWS)
    spans = kept.groupBy(*group).agg(
        (F.max("median") - F.min("median")).alias("span"), F.count(F.lit(1)).alias("groups")
    )
    spread = texts.groupBy(*group).agg(
        F.stddev_samp(target).alias("sd"), F.count(F.lit(1)).alias("rows"),
        (F.min(target) < F.max(target)).alias("varies"),
    )
    joined = null_safe_join(spread, spans, group, "left")
    usable = (F.col("rows") >= MIN_SIGNAL_ROWS) & F.col("varies") & (F.col("groups") >= 2)
    text_rows = joined.select(
        *keys,
        "feature",
        F.lit("categorical").alias("feature_type"),
        F.when(usable, F.try_divide("span", "sd")).alias("signal"),
    )
    return numeric_rows.unionByName(text_rows)


SCOPES = ("global", "single", "worst_of")


def feature_signal_by_scope(
    frame: DataFrame,
    registry: S.FeatureRegistry,
    blocks: Sequence[str] = ("all_without_noise", "compact_core", "worst_of_core"),
    *,
    target: str = "target",
) -> DataFrame:
    """Signal over all rows, single and worst-of rows, in train and validation, per feature."""
    members = {block: set(registry.block_columns(block)) for block in blocks}
    wanted = set().union(*members.values())
    numeric = [c for c in registry.numeric if c in wanted]
    categorical = [c for c in registry.categorical if c in wanted]
    scoped = frame.where(F.col("split").isin("train", "validation")).withColumn(
        "scope",
        F.explode(
            F.array_compact(
                F.array(
                    F.lit("global"),
                    F.when(F.col("is_single_underlying") == 1, F.lit("single")),
                    F.when(F.col("is_worst_of") == 1, F.lit("worst_of")),
                )
            )
        ),
    )
    signals = feature_signal(scoped, numeric, categorical, keys=["scope", "split"], target=target)
    wide = signals.groupBy("feature", "feature_type").agg(
        *[
            F.max(F.when((F.col("scope") == scope) & (F.col("split") == split), F.col("signal"))).alias(
                f"{scope}_{split}_signal"
            )
            for split in ("train", "validation")
            for scope in SCOPES
        ]
    )
    # Signals equal to nine places tie; the wider scope then wins.
    level = {scope: F.round(f"{scope}_train_signal", 9) for scope in SCOPES}
    best = F.greatest(*level.values())
    strongest = F.lit("")
    for scope in reversed(SCOPES):
        strongest = F.when(level[scope] == best, F.lit(scope)).otherwise(strongest)
    return wide.withColumns(
        {
            **{f"in_{block}": F.col("feature").isin(*sorted(members[block])) for block in blocks},
            "presence_pattern": F.concat_ws(
                "+",
                *[F.when(F.col("feature").isin(*sorted(members[block])), F.lit(block)) for block in blocks],
            ),
            "highest_train_signal_scope": strongest,
        }
    )


def chi2_independence(frame: DataFrame, flag: str, columns: Sequence[str]) -> DataFrame:
    """Chi-squared of a two-valued flag against each column, with Yates' correction on 2x2."""
    long = long_text(frame, [flag], columns).fillna(MISSING, subset=["value"])
    cells = long.where(F.col(flag).isNotNull()).groupBy("feature", "value").agg(
        F.count_if(F.col(flag)).cast("double").alias("o1"),
        F.count_if(~F.col(flag)).cast("double").alias("o0"),
    )
    totals = cells.groupBy("feature").agg(
        F.sum("o1").alias("t1"), F.sum("o0").alias("t0"), F.count(F.lit(1)).alias("k")
    )
    joined = cells.join(totals, "feature")
    everything = F.col("t1") + F.col("t0")

    def cell(observed: str, side: str) -> Column:
        expected = F.col(side) * (F.col("o1") + F.col("o0")) / everything
        gap = F.abs(F.col(observed) - expected)
        corrected = F.when(F.col("k") == 2, gap - F.least(gap, F.lit(0.5))).otherwise(gap)
        return F.try_divide(corrected * corrected, expected)

    out = joined.groupBy("feature").agg(
        F.sum(cell("o1", "t1") + cell("o0", "t0")).alias("statistic"),
        (F.max("k") - 1).alias("dof"),
    )
    return out.withColumn("p_value", fn.chi2_sf(F.col("statistic"), F.col("dof")))


def selection_bias(quotes: DataFrame) -> DataFrame:
    """Executed against not executed: KS on five terms, chi-squared on five categories."""
    tests = len(S.BIAS_NUMERIC) + len(S.BIAS_CATEGORICAL)
    label = F.when(F.col("executed"), "yes").when(~F.col("executed"), "no")
    flagged = quotes.withColumn("_side", label)
    long = long_numeric(flagged, ["_side"], S.BIAS_NUMERIC)
    means = long.groupBy("feature").agg(
        F.count_if((F.col("_side") == "yes") & F.col("value").isNotNull()).alias("n_executed_true"),
        F.count_if((F.col("_side") == "no") & F.col("value").isNotNull()).alias("n_executed_false"),
        F.avg(F.when(F.col("_side") == "yes", F.col("value"))).alias("mean_executed_true"),
        F.avg(F.when(F.col("_side") == "no", F.col("value"))).alias("mean_executed_false"),
    )
    ks = two_sample(long, ["feature"], "_side", "yes", "no").join(means, "feature").select(
        F.col("feature").alias("variable"),
        F.lit("ks_2samp").alias("test"),
        "n_executed_true",
        "n_executed_false",
        "mean_executed_true",
        "mean_executed_false",
        F.col("ks_statistic").alias("statistic"),
        F.col("ks_p_value").alias("p_value"),
    )
    present = long_text(flagged, ["_side"], S.BIAS_CATEGORICAL).groupBy("feature").agg(
        F.count_if((F.col("_side") == "yes") & F.col("value").isNotNull()).alias("n_executed_true"),
        F.count_if((F.col("_side") == "no") & F.col("value").isNotNull()).alias("n_executed_false"),
    )
    chi2 = chi2_independence(quotes, "executed", S.BIAS_CATEGORICAL).join(present, "feature").select(
        F.col("feature").alias("variable"),
        F.lit("chi2_contingency").alias("test"),
        "n_executed_true",
        "n_executed_false",
        F.lit(None).cast("double").alias("mean_executed_true"),
        F.lit(None).cast("double").alias("mean_executed_false"),
        "statistic",
        "p_value",
    )
    return ks.unionByName(chi2).withColumns(
        {
            "significant_alpha": F.col("p_value") < S.SIGNIFICANCE_LEVEL,
            "significant_bonferroni": F.col("p_value") < S.SIGNIFICANCE_LEVEL / tests,
            "adjusted_p_value": F.least(F.lit(1.0), F.col("p_value") * tests),
        }
    )
