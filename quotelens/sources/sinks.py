"""Writers, the prediction store and content fingerprints."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens import schema as S

PREDICTION_COLUMNS = ("model_name", "rfq_id", "actual", "prediction")


def write_table(frame: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Write a report table as parquet, CSV or JSON; nested columns become JSON text in CSV."""
    if kind == "csv":
        nested = {f.name for f in frame.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
        frame = frame.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in frame.columns])
    writer = frame.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown table kind {kind!r}")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Validation predictions, one folder per model, so error analysis reads only what it needs."""
    write_table(predictions.select(*PREDICTION_COLUMNS), path, partition_by=("model_name",))


def read_predictions(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    stored = spark.read.parquet(path)
    return stored.where(F.col("model_name").isin(*models)) if models else stored


def prediction_mismatches(predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """Per model: stored rows that are not expected, and expected rows that are not stored.

    ``expected`` lists the validation ids.  Both sides carry one row per id and model.
    """
    models = predictions.select("model_name").distinct()
    surplus = predictions.join(expected.select(S.ID), S.ID, "left_anti").groupBy("model_name").agg(
        F.count(F.lit(1)).alias("unexpected_rows")
    )
    matched = predictions.join(expected.select(S.ID), S.ID, "left_semi").groupBy("model_name").agg(
        F.count_distinct(S.ID).alias("_matched")
    )
    wanted = expected.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        models.join(surplus, "model_name", "left")
        .join(matched, "model_name", "left")
        .select(
            "model_name",
            F.coalesce("unexpected_rows", F.lit(0)).alias("unexpected_rows"),
            (wanted - F.coalesce("_matched", F.lit(0))).alias("missing_rows"),
        )
    )


def check_predictions(predictions: DataFrame, expected: DataFrame, models: list[str]) -> None:
    """Raise when a wanted model is absent or its stored rows do not match the split."""
    report = {r["model_name"]: r for r in prediction_mismatches(predictions, expected).collect()}
    absent = sorted(set(models) - set(report))
    if absent:
        raise ValueError(f"no stored predictions for {absent}")
    stale = [m for m in models if report[m]["unexpected_rows"] or report[m]["missing_rows"]]
    if stale:
        raise ValueError(f"stored predictions of {stale} do not match the current split")


def table_fingerprint(frame: DataFrame, name: str) -> DataFrame:
    """Order-insensitive content hash: row count and the sum of row hashes (duplicates count)."""
    row_hash = F.xxhash64(*[F.col(c).cast("string") for c in frame.columns]).cast("decimal(38,0)")
    return frame.agg(
        F.lit(name).alias("table"),
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(row_hash), F.lit(0)).cast("string").alias("content_sum"),
    ).withColumn(
        "fingerprint", F.substring(F.sha2(F.concat_ws(":", "row_count", "content_sum"), 256), 1, 12)
    )


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per file, each hashed where it is read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256")
    )


def write_json_lists(frame: DataFrame, path: str) -> None:
    """Each partition as one file that holds one JSON list, nulls written; a frame without rows writes no list."""

    def listed(batches):
        opened = False
        for batch in batches:
            for texts, mark in ((batch.column(0)[:1], "," if opened else "["), (batch.column(0)[1:], ",")):
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(mark, texts, "")], names=["value"])
            opened = opened or len(batch) > 0
        if opened:
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])

    items = frame.select(F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"}).alias("value"))
    items.mapInArrow(listed, "value string").write.mode("overwrite").text(path)
