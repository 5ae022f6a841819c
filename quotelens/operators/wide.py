"""Sums over many numeric columns at once, added up inside tasks.

A row per (row, column) costs more than the sums themselves, so rows stay as wide as they are: a task adds
up its batches column by column, and only counts or moments per (keys, column) are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Batches whose equal values are counted together.
HELD = 10

MOMENTS = ("rows", "n", "mean", "m2", "low", "high", "pairs", "x_mean", "y_mean", "xx", "yy", "xy", "x_low", "x_high", "y_low", "y_high")
_COUNTS = ("rows", "n", "pairs")


def _groups(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """The key values of a batch (its first columns) and the rows of each."""
    codes = np.zeros(batch.num_rows, np.int64)
    for i in range(keys):
        coded = batch.column(i).dictionary_encode(null_encoding="encode")
        codes = codes * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
    _, first, of = np.unique(codes, return_index=True, return_inverse=True)
    for number, row in enumerate(first):
        yield tuple(batch.column(i)[int(row)].as_py() for i in range(keys)), np.flatnonzero(of == number)


def _numbers(batch: pa.RecordBatch, place: int) -> tuple[np.ndarray, np.ndarray]:
    """A column's values and which of them are there; nulls are not told from NaN by the values alone."""
    column = batch.column(place)
    return column.to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _typed(frame: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, str]:
    """Keys first, then the columns as doubles, under names that may not clash; and the keys' schema."""
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]
    typed = frame.select(*kept, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    return typed, "".join(f"_k{i} {typed.schema[f'_k{i}'].dataType.simpleString()}, " for i in range(len(keys)))


def _named(frame: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> list[Column]:
    names = F.array(*[F.lit(c) for c in columns])
    return [*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keys)], F.element_at(names, F.col("_c") + 1).alias("feature")]


def _key_arrays(typed: DataFrame, keys: int) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(typed.schema[f"_k{i}"].dataType) for i in range(keys)]


def wide_counts(frame: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, ``feature``, ``value``, ``n``): rows per value of each numeric column, nulls left out."""
    typed, schema = _typed(frame, keys, columns)
    k, kinds, names = len(keys), _key_arrays(typed, len(keys)), typed.columns[: len(keys)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        while held := [b for b in islice(batches, HELD) if b.num_rows]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            groups = list(_groups(rows, k))
            for place in range(len(columns)):
                values, there = _numbers(rows, k + place)
                for key, own in groups:
                    # Zero has one sign, as in Spark's groups.
                    found, n = np.unique(values[own][there[own]] + 0.0, return_counts=True)
                    if len(found):
                        arrays = [pa.array([v], kind).take(pa.array(np.zeros(len(found), np.int32))) for v, kind in zip(key, kinds)]
                        arrays += [pa.array(np.full(len(found), place, np.int32)), pa.array(found), pa.array(n.astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(arrays, [*names, "_c", "value", "n"])

    pieces = typed.mapInArrow(count, f"{schema}_c int, value double, n bigint")
    return pieces.groupBy(*names, "_c", "value").agg(F.sum("n").alias("n")).select(*_named(pieces, keys, columns), "value", "n")


def _centred(x: np.ndarray, there: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per column of ``x``: count, mean of x and y, centred sums of squares and products, lowest and highest of both, where ``there``."""
    n = there.sum(0)
    least = np.maximum(n, 1)
    xs, ys = np.where(there, x, 0.0), np.where(there, y[:, None], 0.0)
    mx, my = xs.sum(0) / least, ys.sum(0) / least
    dx, dy = np.where(there, x - mx, 0.0), np.where(there, y[:, None] - my, 0.0)
    low = lambda v: np.fmin.reduce(np.where(there, v, np.inf), 0)
    high = lambda v: np.max(np.where(there, v, -np.inf), 0)
    return n, mx, my, (dx * dx).sum(0), (dy * dy).sum(0), (dx * dy).sum(0), low(x), high(x), low(y[:, None]), high(y[:, None])


def _joined(a: dict, b: dict) -> dict:
    """Moments of two sets of rows together, centred anew."""
    out = {c: a[c] + b[c] for c in _COUNTS}
    out |= {c: np.fmin(a[c], b[c]) for c in ("low", "x_low", "y_low")} | {c: np.maximum(a[c], b[c]) for c in ("high", "x_high", "y_high")}

    def merge(n: str, means: tuple[str, str], squares: str) -> None:
        weight = a[n] * b[n] / np.maximum(out[n], 1)
        gaps = [np.where(weight > 0, b[m] - a[m], 0.0) for m in means]
        out[squares] = a[squares] + b[squares] + gaps[0] * gaps[1] * weight
        for m in means:
            out[m] = (a[n] * a[m] + b[n] * b[m]) / np.maximum(out[n], 1)

    merge("n", ("mean", "mean"), "m2")
    merge("pairs", ("x_mean", "x_mean"), "xx")
    merge("pairs", ("y_mean", "y_mean"), "yy")
    merge("pairs", ("x_mean", "y_mean"), "xy")
    return out


def wide_moments(frame: DataFrame, keys: Sequence[str], columns: Sequence[str], target: str) -> DataFrame:
    """One row per (keys, ``feature``): ``MOMENTS`` of each numeric column, alone and in rows that have a target.

    ``m2``, ``xx``, ``yy`` and ``xy`` are centred sums; extremes are null without values.
    """
    typed, schema = _typed(frame, keys, [target, *columns])
    k, kinds, names, width = len(keys), _key_arrays(typed, len(keys)), typed.columns[: len(keys)], len(columns)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, dict] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            y, known = _numbers(batch, k)
            both = [_numbers(batch, k + 1 + i) for i in range(width)]
            x, there = np.array([v for v, _ in both]).T, np.array([t for _, t in both]).T
            for key, own in _groups(batch, k):
                with np.errstate(all="ignore"):
                    n, mean, _, m2, *_, = alone = _centred(x[own], there[own], np.zeros(len(own)))
                    paired = _centred(x[own], there[own] & known[own, None], y[own])
                    part = {"rows": np.full(width, len(own)), "n": n, "mean": mean, "m2": m2, "low": alone[6], "high": alone[7]}
                    part |= dict(zip(("pairs", "x_mean", "y_mean", "xx", "yy", "xy", "x_low", "x_high", "y_low", "y_high"), paired))
                    total[key] = _joined(total[key], part) if key in total else part
        for key, sums in total.items():
            arrays = [pa.array([v] * width, kind) for v, kind in zip(key, kinds)]
            arrays.append(pa.array(np.arange(width, dtype=np.int32)))
            arrays += [pa.array(sums[c].astype(np.int64 if c in _COUNTS else np.float64)) for c in MOMENTS]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "_c", *MOMENTS])

    fields = ", ".join(f"{c} {'bigint' if c in _COUNTS else 'double'}" for c in MOMENTS)
    parts = typed.mapInArrow(add, f"{schema}_c int, {fields}")
    # A task gives one row per key and column; sums are centred on the mean of all tasks.
    whole = Window.partitionBy(*names, "_c")

    def middle(mean: str, n: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col(mean) * F.col(n)).over(whole), F.sum(n).over(whole).cast("double")), F.lit(0.0))

    centred = parts.withColumns({"_m": middle("mean", "n"), "_x": middle("x_mean", "pairs"), "_y": middle("y_mean", "pairs")})
    gap, dx, dy = F.col("mean") - F.col("_m"), F.col("x_mean") - F.col("_x"), F.col("y_mean") - F.col("_y")

    def square(sums: str, n: str, product: Column) -> Column:
        return F.sum(F.when(F.col(n) > 0, F.col(sums) + F.col(n) * product).otherwise(F.lit(0.0))).alias(sums)

    def extreme(name: str, n: str) -> Column:
        return (F.min if name.endswith("low") else F.max)(F.when(F.col(n) > 0, F.col(name))).alias(name)

    out = centred.groupBy(*names, "_c").agg(
        *[F.sum(c).alias(c) for c in _COUNTS],
        F.max("_m").alias("mean"), F.max("_x").alias("x_mean"), F.max("_y").alias("y_mean"),
        square("m2", "n", gap * gap), square("xx", "pairs", dx * dx), square("yy", "pairs", dy * dy), square("xy", "pairs", dx * dy),
        *[extreme(c, "n") for c in ("low", "high")],
        *[extreme(c, "pairs") for c in ("x_low", "x_high", "y_low", "y_high")],
    )
    return out.select(*_named(out, keys, columns), *MOMENTS)


def pearson() -> Column:
    """Correlation from a row of ``wide_moments``; null when either side does not vary."""
    varies = (F.col("x_low") < F.col("x_high")) & (F.col("y_low") < F.col("y_high"))
    n = F.col("pairs").cast("double")
    ratio = F.try_divide(F.col("xy") / n, F.sqrt(F.col("xx") / n) * F.sqrt(F.col("yy") / n))
    return F.when(varies, ratio)
