"""Backward as-of join.

The probe side is first reduced to its distinct (key, time) pairs, so a key with a third of all
rows shrinks to at most one probe per instant before anything is sorted.  Both sides are then cut
into time buckets, the last observation is carried forward inside each bucket, and the last
observation of earlier buckets comes from a small (key, bucket) table.  The answer is attached to
the full left side by an ordinary equi-join, which adaptive execution may broadcast or split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_UNIT = "month"


def asof_lookup(
    probes: DataFrame,
    history: DataFrame,
    *,
    by: str,
    probe_time: str,
    history_time: str,
    values: Sequence[str],
    unit: str = BUCKET_UNIT,
) -> DataFrame:
    """One row per distinct probe (``by``, ``probe_time``) with the last earlier-or-equal values."""
    distinct_probes = probes.select(by, F.col(probe_time).alias("_t")).where(
        F.col(by).isNotNull() & F.col("_t").isNotNull()
    ).distinct()
    payload = F.struct(F.col(history_time).alias("_at"), *[F.col(v) for v in values])
    observed = history.where(F.col(by).isNotNull() & F.col(history_time).isNotNull()).select(
        by, F.col(history_time).alias("_t"), F.lit(0).alias("_side"), payload.alias("_seen")
    )
    marks = observed.unionByName(
        distinct_probes.withColumn("_side", F.lit(1)), allowMissingColumns=True
    ).withColumn("_bucket", F.date_trunc(unit, "_t")).repartition(by, "_bucket")

    inside = Window.partitionBy(by, "_bucket").orderBy("_t", "_side")
    filled = marks.withColumn(
        "_seen",
        F.last("_seen", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
    ).where("_side = 1")

    # One row per (key, bucket): bounded by the calendar, whatever the number of rows.
    closing = marks.groupBy(by, "_bucket").agg(F.max("_seen").alias("_closing"))
    earlier = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = closing.select(
        by, "_bucket", F.last("_closing", ignorenulls=True).over(earlier).alias("_carry")
    )
    found = filled.join(carried, [by, "_bucket"], "left").withColumn(
        "_hit", F.coalesce("_seen", "_carry")
    )
    return found.select(
        by,
        F.col("_t").alias(probe_time),
        F.col("_hit._at").alias(history_time),
        *[F.col(f"_hit.{v}").alias(v) for v in values],
    )


def asof_join(
    left: DataFrame,
    history: DataFrame,
    *,
    by: str,
    left_time: str,
    history_time: str,
    values: Sequence[str],
    unit: str = BUCKET_UNIT,
) -> DataFrame:
    """Left rows with the last history row at or before their time; nulls when there is none."""
    lookup = asof_lookup(
        left,
        history,
        by=by,
        probe_time=left_time,
        history_time=history_time,
        values=values,
        unit=unit,
    )
    return left.join(lookup, [by, left_time], "left")
