"""Choosing between strategies: paired errors, bootstraps, calibration and rankings."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelens import functions as fn
from quotelens import schema as S
from quotelens.operators.metrics import absolute_error, regression_metrics
from quotelens.operators.ordered import exact_quantiles, running_sums, value_counts

RANKABLE = ("validation_mae", "validation_rmse", "validation_median_absolute_error")


def paired_errors(first: DataFrame, second: DataFrame, id_column: str = S.ID) -> DataFrame:
    """Absolute errors of two candidates on the rows that both score."""
    left = first.select(id_column, absolute_error().alias("error_global"))
    right = second.select(id_column, absolute_error().alias("error_segmented"))
    return left.join(right, id_column)


def _interval(replicates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Percentile interval of the replicate differences beside the plain difference."""
    bounds = exact_quantiles(replicates, [], "difference", {"ci_95_low": 0.025, "ci_95_high": 0.975})
    point = pairs.agg(
        (F.avg("error_global") - F.avg("error_segmented")).alias("point_estimate"),
        F.count(F.lit(1)).alias("n_observations"),
    )
    joined = point.withColumn("_one", F.lit(1)).join(bounds.withColumn("_one", F.lit(1)), "_one").drop("_one")
    outside = (F.col("ci_95_low") > 0) | (F.col("ci_95_high") < 0)
    return joined.withColumn("significant_at_5pct", F.coalesce(outside, F.lit(False)))


def poisson_weight(uniform: Column) -> Column:
    """Poisson(1) draw from a uniform number by inverting the cumulative distribution, as far as doubles tell steps apart."""
    total, chain, k = math.exp(-1.0), F.when(uniform < math.exp(-1.0), F.lit(0)), 0
    while True:
        k += 1
        further = total + math.exp(-1.0) / math.factorial(k)
        if further == total:
            return chain.otherwise(F.lit(k))
        total = further
        chain = chain.when(uniform < total, F.lit(k))


#: Replicates by rows that are weighted at a time, so that they stay in cache.
_TILE = (512, 128)


def _poisson_steps() -> np.ndarray:
    """Where the cumulative distribution of ``poisson_weight`` steps up, as integers of 53 bits."""
    totals, k = [math.exp(-1.0)], 1
    while (further := totals[-1] + math.exp(-1.0) / math.factorial(k)) != totals[-1]:
        totals.append(further)
        k += 1
    # uniform < total for uniform = bits / 2^53 means bits < total * 2^53, a product that is exact.
    return np.array([math.ceil(t * 2.0**53) for t in totals], np.int64)


def _digest(h: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of the ints ``number`` (a column) seeded with each of ``h``."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    x = (h + p5 + np.uint64(4))[None, :] ^ (number.astype(np.uint64) * p1)[:, None]
    x = ((x << np.uint64(23)) | (x >> np.uint64(41))) * p2 + p3
    x ^= x >> np.uint64(33)
    x *= p2
    x ^= x >> np.uint64(29)
    x *= p3
    x ^= x >> np.uint64(32)
    return x


def _weighted_sums(batches: Iterator[pa.RecordBatch], replicates: int) -> Iterator[pa.RecordBatch]:
    """Per replicate, over a task's rows: the weighted sum of ``d`` (null without any ``d``) and the sum of the weights."""
    steps = _poisson_steps()
    # Weights by the first 12 of 53 bits; 255 where a step lies inside.
    edges = np.arange(4097, dtype=np.int64) << 41
    lower, upper = np.searchsorted(steps, edges[:-1], "right"), np.searchsorted(steps, edges[1:] - 1, "right")
    table = np.where(lower == upper, lower, 255).astype(np.uint8)
    weighted, weights, seen, known = np.zeros(replicates), np.zeros(replicates, np.int64), False, False
    numbers, mask = np.arange(replicates), np.uint64((1 << 53) - 1)
    for batch in batches:
        h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        there = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        d = np.where(there, batch.column(1).to_numpy(zero_copy_only=False), 0.0)
        seen, known = seen or len(h) > 0, known or bool(there.any())
        for row in range(0, len(h), _TILE[0]):
            own, gap = h[row : row + _TILE[0]], d[row : row + _TILE[0]]
            for first in range(0, replicates, _TILE[1]):
                bits = (_digest(own, numbers[first : first + _TILE[1]]) & mask).view(np.int64)
                weight = table[bits >> 41]
                unsure = weight == 255
                if unsure.any():
                    weight[unsure] = np.searchsorted(steps, bits[unsure], "right")
                weighted[first : first + _TILE[1]] += weight.astype(np.float64) @ gap
                weights[first : first + _TILE[1]] += weight.sum(1, dtype=np.int64)
    if seen:
        sums = pa.array(weighted) if known else pa.nulls(replicates, pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), sums, pa.array(weights)], ["replicate", "weighted", "weights"])


def bootstrap_rows(
    pairs: DataFrame, *, replicates: int = S.BOOTSTRAP_REPLICATES, seed: int = S.SEED, id_column: str = S.ID
) -> DataFrame:
    """Row bootstrap of the mean error difference.

    Each row gets an independent Poisson(1) weight per replicate, hashed from (seed, row,
    replicate): the large-sample form of drawing n rows with replacement.  Weights are summed on
    the map side, so the shuffle carries replicates, not rows, and a lost task redraws the same
    weights.
    """
    # The digest of (seed, row) is taken once per row; a task goes on from it with the replicate's number.
    rows = pairs.select(F.xxhash64(F.lit(seed), F.col(id_column).cast("string")).alias("h"), (F.col("error_global") - F.col("error_segmented")).cast("double").alias("d"))
    # Few bytes but much work per row, so every core gets a share.
    rows = rows.repartition(max(1, pairs.sparkSession.sparkContext.defaultParallelism) * 4)
    parts = rows.mapInArrow(lambda batches: _weighted_sums(batches, replicates), "replicate int, weighted double, weights bigint")
    sums = parts.groupBy("replicate").agg(F.try_divide(F.sum("weighted"), F.sum("weights").cast("double")).alias("difference"))
    return _interval(sums, pairs).withColumn("n_bootstrap", F.lit(replicates))


def bootstrap_blocks(
    pairs: DataFrame, *, block: str = "block", replicates: int = S.BOOTSTRAP_REPLICATES, seed: int = S.SEED
) -> DataFrame:
    """Quarter-block bootstrap: whole blocks are drawn, so only block sums are resampled.

    The drawn block is a digest of (seed, replicate, draw); block sums number one per quarter.
    """
    sums = pairs.groupBy(block).agg(
        F.sum("error_global").alias("g"), F.sum("error_segmented").alias("s"), F.count(F.lit(1)).alias("n")
    )
    # One row per calendar quarter: numbering them in one window is bounded by the calendar.
    numbered = sums.withColumn("slot", F.row_number().over(Window.orderBy(block)) - 1)
    blocks = sums.agg(F.count(F.lit(1)).alias("n")).scalar()
    spark = pairs.sparkSession
    draws = (
        spark.range(replicates)
        .withColumnRenamed("id", "replicate")
        .withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    )
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("draw").cast("string")))
    slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % blocks
    drawn = draws.withColumn("slot", slot).join(numbered, "slot")
    differences = drawn.groupBy("replicate").agg(
        ((F.sum("g") - F.sum("s")) / F.sum("n")).alias("difference")
    )
    return _interval(differences, pairs).withColumns(
        {"n_bootstrap": F.lit(replicates), "n_blocks": blocks, "block_unit": F.lit("requested_quarter")}
    )


def choose_strategy(interval: DataFrame) -> DataFrame:
    """Segmented only when the block interval excludes zero and the gain is material."""
    material = F.abs("point_estimate") >= S.MIN_MATERIAL_GAIN_MONTHS
    decided = F.coalesce(F.col("significant_at_5pct") & material, F.lit(False))
    return interval.withColumns(
        {
            "preferred_strategy": F.when(decided & (F.col("point_estimate") > 0), "segmented_by_basket_type").otherwise("global"),
            "decision_basis": F.when(decided, "validation_quarter_block_bootstrap_significant").otherwise(
                "not_significant_or_not_material_default_to_simpler_model"
            ),
        }
    )


def conformal_calibrate(rows: DataFrame, coverage: float = S.NOMINAL_COVERAGE) -> DataFrame:
    """Residual quantile by the "higher" rule, from running counts, and the coverage it reaches."""
    residuals = rows.select(absolute_error().alias("residual"))
    ranked = running_sums(value_counts(residuals, [], "residual"), [], "residual", ["n"])
    place = F.ceil((F.col("n_total") - 1) * F.lit(coverage))
    covered = F.col("n_before") + F.col("n")
    holds = (F.col("n_before") <= place) & (place < covered)
    return ranked.agg(
        F.max(F.when(holds, F.col("residual"))).alias("absolute_residual_quantile"),
        F.max(F.when(holds, covered / F.col("n_total"))).alias("empirical_coverage"),
        F.max("n_total").alias("calibration_rows"),
    ).withColumn("nominal_coverage", F.lit(coverage))


def clip_decision(rows: DataFrame) -> DataFrame:
    """Metrics of raw and clipped predictions, and whether clipping is worth keeping.

    ``rows`` carry actual, prediction, no_call_period_months, observation_interval_months and
    nominal_maturity_months.
    """
    lower = F.greatest(F.col("no_call_period_months").cast("double"), F.col("observation_interval_months"))
    clipped = fn.clip_to_contract(F.col("prediction"), lower, F.col("nominal_maturity_months"))
    both = rows.select(
        "actual",
        F.explode(
            F.array(
                F.struct(F.lit("raw").alias("variant"), F.col("prediction").alias("prediction")),
                F.struct(F.lit("clipped").alias("variant"), clipped.alias("prediction")),
            )
        ).alias("_v"),
    ).select("actual", "_v.variant", "_v.prediction")
    metrics = regression_metrics(both, ["variant"])
    return metrics.agg(
        *[
            F.max(F.when(F.col("variant") == v, F.col(m))).alias(f"{v}_{m}")
            for v in ("raw", "clipped")
            for m in ("mae", "rmse", "r2", "median_absolute_error")
        ]
    ).withColumn("clipping_enabled", F.col("clipped_mae") <= F.col("raw_mae"))


# --------------------------------------------------------------------------------------
# Rankings over result tables
# --------------------------------------------------------------------------------------


def best_per_group(results: DataFrame, keys: Sequence[str], metric: str, tie: str = "model_name") -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(metric).asc(), F.col(tie).asc())
    kept = results.where(F.col(metric).isNotNull())
    return kept.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def top_n_per_segment(results: DataFrame, n: int, metric: str = "validation_mae") -> DataFrame:
    """First ``n`` models per segment; only validation metrics may rank, names appear once."""
    if metric not in RANKABLE:
        raise ValueError(f"{metric!r} cannot rank candidates; use one of {RANKABLE}")
    if metric not in results.columns:
        raise ValueError(f"no column {metric!r} to rank by")
    order = Window.partitionBy("segment").orderBy(metric, "validation_mae", "model_name")
    ranked = results.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    first = Window.partitionBy("model_name").orderBy("segment", "place")
    return (
        ranked.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select("segment", "place", "model_name", metric)
    )


def union_tables(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def experiment_summary(*tables: DataFrame) -> DataFrame:
    """All result tables in one schema, each row with the metric it may be selected by."""
    united = union_tables(*tables)
    for name in ("validation_mae", "rolling_mae_mean"):
        if name not in united.columns:
            united = united.withColumn(name, F.lit(None).cast("double"))
    holdout = F.col("evaluation_protocol") == "temporal_holdout"
    blank = F.coalesce("segment", F.lit("")).isin("", "all")
    return united.withColumns(
        {
            "segment": F.when(blank, "global").otherwise(F.col("segment")),
            "selection_metric": F.when(holdout, "validation_mae").otherwise("rolling_mae_mean"),
            "selection_mae": F.when(holdout, F.col("validation_mae")).otherwise(F.col("rolling_mae_mean")),
        }
    )


def sort_summary(summary: DataFrame) -> DataFrame:
    return summary.orderBy(
        "evaluation_protocol", "segment", F.col("selection_mae").asc_nulls_last(), "model_name"
    )


def seeded_sample(frame: DataFrame, rows: int = 1000, seed: int = S.SEED, id_column: str = S.ID) -> DataFrame:
    """Up to ``rows`` rows ordered by a digest of the id: the same rows under any partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")))
    return frame.orderBy(digest, id_column).limit(rows)


# --------------------------------------------------------------------------------------
# Attribution tables
# --------------------------------------------------------------------------------------


def attribution_summary(attributions: DataFrame) -> DataFrame:
    """Mean attribution, direction and rank per (model, feature)."""
    from quotelens.operators.association import direction, spearman

    keys = ["model_name", "feature"]
    basic = attributions.groupBy(*keys).agg(
        F.avg(F.abs("phi")).alias("mean_abs_attribution"), F.avg("phi").alias("mean_attribution")
    )
    numbers = attributions.select(*keys, F.col("value").try_cast("double").alias("value"), "phi")
    rho = spearman(numbers, keys, "value", "phi").select(*keys, F.col("spearman").alias("value_attribution_spearman"))
    out = basic.join(rho, keys, "left")
    order = Window.partitionBy("model_name").orderBy(F.desc("mean_abs_attribution"), "feature")
    return out.withColumns(
        {
            "direction": direction(F.col("value_attribution_spearman")),
            "attribution_rank": F.row_number().over(order),
        }
    )


def categorical_effects(attributions: DataFrame, features: Sequence[str], limit: int = 25) -> DataFrame:
    """Mean attribution per category of each categorical feature, most frequent first."""
    keys = ["model_name", "feature"]
    per_value = (
        attributions.where(F.col("feature").isin(*features))
        .groupBy(*keys, F.col("value").alias("category"))
        .agg(F.avg("phi").alias("mean"), F.count("phi").alias("count"))
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), F.col("category").asc_nulls_first())
    return per_value.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= limit).drop("_rn")


def join_signal(consensus: DataFrame, signal: DataFrame) -> DataFrame:
    return consensus.join(
        signal.select("feature", "feature_type", "train_target_spearman", "target_correlation_direction"),
        "feature",
        "left",
    )


def pruning_candidates(summary: DataFrame, signal: DataFrame) -> DataFrame:
    """Features that every model ranks low, contributes little to and that correlate weakly."""
    totals = summary.groupBy("model_name").agg(F.sum("mean_abs_attribution").alias("_total"))
    shares = summary.join(totals, "model_name").withColumn(
        "share", F.try_divide("mean_abs_attribution", "_total")
    )
    consensus = shares.groupBy("feature").agg(
        F.count_distinct("model_name").alias("model_count"),
        F.avg("attribution_rank").alias("avg_rank"),
        F.max("attribution_rank").alias("worst_rank"),
        F.avg("share").alias("avg_relative_mean_abs"),
        F.max("share").alias("max_relative_mean_abs"),
    )
    rho = F.abs("train_target_spearman")
    weak = (
        (F.col("model_count") >= 2)
        & (F.col("avg_rank") >= 32)
        & (F.col("max_relative_mean_abs") < 0.01)
        & (F.coalesce(rho, F.lit(0.0)) < 0.08)
    )
    return join_signal(consensus, signal).withColumns(
        {"abs_train_target_spearman": rho, "pruning_candidate": F.coalesce(weak, F.lit(False))}
    )
