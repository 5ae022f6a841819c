"""Trailing row windows over the series, chunked so that one long key is spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelens.functions import safe_divide
from quotelens.operators.ordered import positions

SHORT_ROWS = 21
LONG_ROWS = 126
CHUNK_ROWS = 4096

HISTORY_COLUMNS = (
    "realized_vol_63d",
    "realized_vol_63d_21d_mean",
    "realized_vol_63d_126d_mean",
    "realized_vol_63d_trend_21d_126d",
    "realized_vol_63d_zscore_126d",
    "realized_vol_63d_change_21d",
)


def chunked(
    series: DataFrame, by: str, time: str, reach: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Cut each key into runs of ``chunk_rows`` rows, each led in by the ``reach`` rows before it.

    Adds ``position``, ``chunk`` and ``is_lead_in``.  A window over (key, chunk) then equals the
    window over the whole key on every row that is not a lead-in row.
    """
    if chunk_rows < reach:
        raise ValueError("a chunk must be at least as long as the window reaches back")
    placed = positions(series, [by], [time], F.date_trunc("month", F.col(time)))
    home = F.floor(F.col("position") / chunk_rows)
    at_end = F.col("position") % chunk_rows >= chunk_rows - reach
    targets = F.when(at_end, F.array(home, home + 1)).otherwise(F.array(home))
    return (
        placed.withColumn("_home", home)
        .withColumn("chunk", F.explode(targets))
        .withColumn("is_lead_in", F.col("chunk") != F.col("_home"))
        .drop("_home")
    )


def rolling_history(
    series: DataFrame,
    *,
    by: str = "underlying",
    time: str = "date",
    value: str = "realized_vol_63d",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Series with its trailing means, deviation, trend, z-score and 21-row change."""
    rows = chunked(series, by, time, LONG_ROWS - 1, chunk_rows)
    ordered = Window.partitionBy(by, "chunk").orderBy("position")
    short = ordered.rowsBetween(-(SHORT_ROWS - 1), 0)
    long = ordered.rowsBetween(-(LONG_ROWS - 1), 0)
    measured = rows.select(
        "*",
        F.avg(value).over(short).alias(f"{value}_21d_mean"),
        F.avg(value).over(long).alias(f"{value}_126d_mean"),
        F.stddev_samp(value).over(long).alias(f"{value}_126d_std"),
        F.lag(value, SHORT_ROWS).over(ordered).alias("_lagged"),
    ).where(~F.col("is_lead_in"))
    return measured.select(
        *series.columns,
        f"{value}_21d_mean",
        f"{value}_126d_mean",
        f"{value}_126d_std",
        (F.col(f"{value}_21d_mean") - F.col(f"{value}_126d_mean")).alias(f"{value}_trend_21d_126d"),
        safe_divide(
            F.col(value) - F.col(f"{value}_126d_mean"), F.col(f"{value}_126d_std")
        ).alias(f"{value}_zscore_126d"),
        (F.col(value) - F.col("_lagged")).alias(f"{value}_change_21d"),
    )
