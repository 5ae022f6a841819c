"""Exact profiles, and sketches per file that stay within their stated errors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotelens.operators import audit, sketches

SCHEMA = "file bigint, x double, word string, nothing double"


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(20000).select(
        # A column that has the name of one of the state's.
        F.col("id").alias("file"),
        F.when(F.col("id") % 10 > 0, F.exp(4 * F.rand(seed=3))).alias("x"),
        F.concat(F.lit("w"), (F.col("id") * F.col("id")) % 1009).alias("word"),
        F.lit(None).cast("double").alias("nothing"),
    )
    return rows.repartition(4)


def test_exact_profile(table):
    got = {r["column"]: r for r in audit.profile_columns(table, "t").collect()}
    frame = table.toPandas()
    assert got["file"]["distinct_values"] == 20000 and got["word"]["distinct_values"] == frame["word"].nunique()
    assert got["x"]["null_rows"] == 2000 and got["word"]["median"] is None
    assert [got["x"][q] for q in ("q25", "median", "q75")] == pytest.approx(list(frame["x"].quantile([0.25, 0.5, 0.75])), rel=1e-12)
    assert (got["nothing"]["distinct_values"], got["nothing"]["null_rows"], got["nothing"]["q25"]) == (0, 20000, None)


def test_new_files_alone_are_sketched_and_errors_stay_in_bounds(spark, table, tmp_path):
    folder, state = str(tmp_path / "data"), str(tmp_path / "state")
    asked = []

    def read(files):
        asked.append(len(files))
        return spark.read.schema(SCHEMA).parquet(*files)

    table.where("file < 12000").write.parquet(folder)
    first = sketches.refresh_sketches(spark, folder, read, state)
    assert {r["row_count"] for r in sketches.merge_sketches(first, "t").collect()} == {12000}
    table.where("file >= 12000").coalesce(1).write.mode("append").parquet(folder)
    both = sketches.refresh_sketches(spark, folder, read, state)
    again = sketches.refresh_sketches(spark, folder, read, state)
    assert len(asked) == 2 and asked[1] == 1 and again.count() == both.count()

    got = {r["column"]: r for r in sketches.merge_sketches(again, "t").collect()}
    frame = table.toPandas()
    assert (got["x"]["row_count"], got["x"]["null_rows"]) == (20000, 2000)
    assert got["x"]["mean"] == pytest.approx(frame["x"].mean(), rel=1e-12)
    error = 4 * 1.04 / math.sqrt(2**sketches.LOG_REGISTERS)
    for name in ("file", "word"):
        assert got[name]["approx_distinct"] == pytest.approx(frame[name].nunique(), rel=error)
    values = np.sort(frame["x"].dropna())
    for percent in (25, 50, 75):
        rank = np.searchsorted(values, got["x"][f"approx_q{percent}"]) / len(values)
        assert abs(rank - percent / 100) <= 2 * sketches.RANK_ERROR
    assert got["nothing"]["approx_q50"] is None and got["nothing"]["approx_distinct"] == 0 and got["word"]["min"] is None


def test_a_table_without_files(spark, tmp_path):
    (tmp_path / "data").mkdir()
    state = sketches.refresh_sketches(spark, str(tmp_path / "data"), lambda files: spark.read.schema(SCHEMA).parquet(*files), str(tmp_path / "state"))
    assert sketches.merge_sketches(state, "t").count() == 0
