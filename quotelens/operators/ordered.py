"""Order statistics without ever sorting one key in one task.

A running total over an ordered key is split in two levels: rows are cut into value buckets by a
monotone function of the value, each (key, bucket) is summed on its own, and the small table of
bucket totals supplies what lies before.  A key that holds a third of all rows is then spread
over as many tasks as it has buckets.  Inputs are value counts, so repeated values collapse on
the map side before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_OCTAVE = 1024
FINEST_STEP = float(2**20)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key; right keys are dropped."""
    renamed = right.select(
        *[F.col(key).alias(f"__r_{key}") for key in keys],
        *[column for column in right.columns if column not in keys],
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"__r_{key}")) for key in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"__r_{key}" for key in keys])


def value_counts(frame: DataFrame, keys: Sequence[str], value: str, **sums: Column) -> DataFrame:
    """Rows per (keys, value), nulls left out, with optional extra sums."""
    extra = [F.sum(column).alias(name) for name, column in sums.items()]
    return (
        frame.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"), *extra)
    )


def order_bucket(value: Column) -> Column:
    """Bucket number, non-decreasing in the value: even steps of its logarithm on either side of 0.

    It depends on the value alone, so no pass over the data is needed to choose the cuts and a
    recomputed task lands every row in the same bucket.  Neighbouring buckets are 0.07% apart.
    """
    size = F.floor(F.log2(F.abs(value) * FINEST_STEP + 1.0) * BUCKETS_PER_OCTAVE)
    return F.when(value < 0, -size).otherwise(size)


def running_sums(
    counts: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str]
) -> DataFrame:
    """Add ``<s>_before`` and ``<s>_total`` for each sum, and ``next_value``.

    ``counts`` holds one row per (keys, value).  ``_before`` covers strictly smaller values.
    """
    keys = list(keys)
    if not keys:
        return running_sums(counts.withColumn("_all", F.lit(0)), ["_all"], value, sums).drop("_all")
    # Shared by the local sums and the bucket totals, so the counts are moved once.
    placed = counts.withColumn("_bucket", order_bucket(F.col(value).cast("double")))
    placed = placed.repartition(*keys, "_bucket")

    inside = Window.partitionBy(*keys, "_bucket").orderBy(value)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select(
        "*",
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums],
        F.lead(value).over(inside).alias("_next_inside"),
    )
    totals = placed.groupBy(*keys, "_bucket").agg(
        *[F.sum(s).alias(f"_{s}_bucket") for s in sums], F.min(value).alias("_first")
    )
    across = Window.partitionBy(*keys).orderBy("_bucket")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = totals.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_{s}_bucket").over(earlier), F.lit(0)).alias(f"_{s}_carry") for s in sums],
        *[F.sum(f"_{s}_bucket").over(whole).alias(f"{s}_total") for s in sums],
        F.lead("_first").over(across).alias("_next_bucket"),
    )
    joined = null_safe_join(local, carried, [*keys, "_bucket"])
    return joined.select(
        *counts.columns,
        *[(F.col(f"{s}_before") + F.col(f"_{s}_carry")).alias(f"{s}_before") for s in sums],
        *[f"{s}_total" for s in sums],
        F.coalesce("_next_inside", "_next_bucket").alias("next_value"),
    )


def quantile_at(value: Column, probability: float, n: str = "n") -> Column:
    """Aggregate over ``running_sums`` rows: the linearly interpolated quantile of sum ``n``."""
    place = (F.col(f"{n}_total") - 1) * F.lit(float(probability))
    low, high = F.floor(place), F.ceil(place)

    def at(index: Column) -> Column:
        before = F.col(f"{n}_before")
        hit = (before <= index) & (index < before + F.col(n))
        return F.max(F.when(hit, value.cast("double")))

    fraction = F.max(place - low)
    return at(low) + (at(high) - at(low)) * fraction


def exact_quantiles(
    frame: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]
) -> DataFrame:
    """Exact interpolated quantiles per group, one row per group that has a value."""
    ranked = running_sums(value_counts(frame, keys, value), keys, value, ["n"])
    aggregates = [quantile_at(F.col(value), p).alias(name) for name, p in probabilities.items()]
    return ranked.groupBy(*keys).agg(*aggregates) if keys else ranked.agg(*aggregates)


def median_by(frame: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return exact_quantiles(frame, keys, value, {name: 0.5})


def _part_sizes(batches: Iterator[pa.RecordBatch], ranges: Sequence[tuple[float, float] | None], parts: int) -> Iterator[pa.RecordBatch]:
    """(c, part, n, low, high) of the numbers of each column inside its range, for some batches at a time."""
    batches = iter(batches)
    while held := list(islice(batches, 10)):
        for number, between in enumerate(ranges):
            values = np.concatenate([batch.column(number).to_numpy(zero_copy_only=False) for batch in held]).astype(np.float64)
            values = np.sort(values[~np.isnan(values)] if between is None else values[(values >= between[0]) & (values <= between[1])])
            if not len(values):
                continue
            if between is None:
                # As ``order_bucket``; infinite numbers have buckets of their own.
                with np.errstate(over="ignore"):
                    size = np.minimum(np.floor(np.log2(np.abs(values) * FINEST_STEP + 1.0) * BUCKETS_PER_OCTAVE), 2.0**61)
                part = np.sign(values) * np.where(np.isinf(values), 2.0**62, size)
            else:
                part = np.floor((values - between[0]) / (between[1] - between[0]) * parts)
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            ends = np.r_[starts[1:], len(part)]
            columns = [np.full(len(starts), number, np.int32), part[starts].astype(np.int64), ends - starts, values[starts], values[ends - 1]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["c", "part", "n", "low", "high"])


def lower_medians(frame: DataFrame, columns: Sequence[str], parts: int = 1024) -> dict[str, float]:
    """The exact lower median of each column that has a number, by counting and narrowing.

    A pass counts the values in parts of each column's range; the part that holds the median is the next
    pass' range, until it holds one value. Tasks add up before the shuffle, and the driver gets one row per column
    and pass. The first parts are even steps of the logarithm, later ones even, so a handful of passes does for doubles.
    """
    found: dict[str, float] = {}
    totals: dict[str, int] = {}
    open_: dict[str, tuple[float, float, int] | None] = dict.fromkeys(columns)
    while open_:
        names, ranges = list(open_), [state and state[:2] for state in open_.values()]
        numbers = frame.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names)])
        pieces = numbers.mapInArrow(lambda batches, ranges=ranges: _part_sizes(batches, ranges, parts), "c int, part bigint, n bigint, low double, high double")
        sizes = pieces.groupBy("c", "part").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        # One row per column and part.
        before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        rows = F.sum("n").over(Window.partitionBy("c"))
        skipped = F.lit(0)
        if totals:
            rows = F.element_at(F.array(*[F.lit(totals[c]) for c in names]), F.col("c") + 1)
            skipped = F.element_at(F.array(*[F.lit(open_[c][2]) for c in names]), F.col("c") + 1)
        placed = sizes.select("*", (skipped + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("before"), rows.alias("rows"))
        middle = F.floor((F.col("rows") - 1) / 2)
        hits = placed.where((F.col("before") <= middle) & (middle < F.col("before") + F.col("n"))).collect()
        totals = totals or {names[r["c"]]: r["rows"] for r in hits}
        open_ = {}
        for r in hits:
            if r["low"] == r["high"]:
                found[names[r["c"]]] = r["low"]
            else:
                open_[names[r["c"]]] = (r["low"], r["high"], r["before"])
    return found


def positions(
    frame: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "position"
) -> DataFrame:
    """Exact 0-based position of each row within its key.

    ``bucket`` must be non-decreasing along ``order``; it decides how finely one key is spread.
    """
    keys = list(keys)
    placed = frame.withColumn("_bucket", bucket).repartition(*keys, "_bucket")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    sizes = placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket")
    carry = sizes.select(
        *keys,
        "_bucket",
        F.coalesce(
            F.sum("_size").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_carry"),
    )
    local = placed.withColumn("_inside", F.row_number().over(inside) - 1)
    joined = null_safe_join(local, carry, [*keys, "_bucket"])
    return joined.withColumn(name, F.col("_inside") + F.col("_carry")).drop(
        "_bucket", "_inside", "_carry"
    )
