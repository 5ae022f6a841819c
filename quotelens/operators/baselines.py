"""Constant and group-median baselines: fitted tables joined to the rows they score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens import schema as S
from quotelens.operators.ordered import exact_quantiles, null_safe_join, quantile_at, running_sums
from quotelens.session import materialise


def constant_value(train: DataFrame, strategy: str = "mean", target: str = S.TARGET) -> Column:
    """Mean or exact median of the training target, as a scalar subquery."""
    if strategy == "mean":
        return train.agg(F.avg(target).alias("value")).scalar()
    if strategy == "median":
        return exact_quantiles(train, [], target, {"value": 0.5}).scalar()
    raise ValueError(f"unknown strategy {strategy!r}")


def constant(train: DataFrame, rows: DataFrame, strategy: str = "mean", target: str = S.TARGET) -> DataFrame:
    return rows.withColumn("prediction", constant_value(train, strategy, target))


def group_median(
    train: DataFrame, rows: DataFrame, keys: Sequence[str], target: str = S.TARGET
) -> DataFrame:
    """Median of the key group seen in training; the overall median for a new key."""
    table = exact_quantiles(train, list(keys), target, {"_median": 0.5})
    overall = constant_value(train, "median", target)
    scored = null_safe_join(rows, table, list(keys), "left")
    return scored.withColumn("prediction", F.coalesce("_median", overall)).drop("_median")


def group_medians(
    train: DataFrame, rows: DataFrame, key_sets: Mapping[str, Sequence[str]], target: str = S.TARGET, keep: Sequence[str] = ()
) -> DataFrame:
    """Every group-median baseline in one plan: (``keep``, model_name, rfq_id, actual, prediction).

    Equal (keys, target) are counted before they are unpivoted to one (model, key) pair per key set, so all tables are
    fitted by one grouping. Scoring looks each distinct combination of the keys up once, for all models, and
    joins the predictions to the rows as one array; the rows are unpivoted last.
    """
    names = list(dict.fromkeys(key for keys in key_sets.values() for key in keys))

    def keyed(frame: DataFrame, *others: str) -> DataFrame:
        pairs = F.array(
            *[
                F.struct(F.lit(name).alias("model_name"), F.to_json(F.struct(*keys)).alias("_key"))
                for name, keys in key_sets.items()
            ]
        )
        return frame.select(*others, F.explode(pairs).alias("_p")).select(*others, "_p.model_name", "_p._key")

    known = train.where(F.col(target).isNotNull()).groupBy(*names, F.col(target).alias("_target")).agg(F.count(F.lit(1)).alias("n"))
    pairs = ["model_name", "_key"]
    counts = keyed(known, "_target", "n").groupBy(*pairs, "_target").agg(F.sum("n").alias("n"))
    ranked = running_sums(counts, pairs, "_target", ["n"])
    # Stored, so that its size is known when it is joined.
    table = materialise(ranked.groupBy(*pairs).agg(quantile_at(F.col("_target"), 0.5).alias("_median")))
    overall = constant_value(train, "median", target)
    combinations = rows.select(*names).distinct()
    found = keyed(combinations, *names).join(table, pairs, "left")
    answers = found.groupBy(*names).agg(F.collect_list(F.struct("model_name", F.coalesce("_median", overall).alias("prediction"))).alias("_answers"))
    scored = null_safe_join(rows.select(S.ID, *keep, F.col(target).alias("actual"), *[F.col(c).alias(f"_in_{c}") for c in names]), answers.select(*[F.col(c).alias(f"_in_{c}") for c in names], "_answers"), [f"_in_{c}" for c in names])
    unpivoted = scored.select(*keep, S.ID, "actual", F.explode("_answers").alias("_a"))
    return unpivoted.select(*keep, "_a.model_name", S.ID, "actual", "_a.prediction")
