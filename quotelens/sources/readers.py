"""Readers with declared schemas: CSV, JSON and Parquet into typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelens import functions as fn
from quotelens import schema as S
from quotelens.operators.ordered import positions
from quotelens.session import materialise
from quotelens.sources.json_lists import json_items


def _raw(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV columns as text, found by header name in any order; other columns are not read.

    A bad value then nulls one cell and not the row; a missing column is an error.
    """
    frame = spark.read.csv(path, header=True, inferSchema=False)
    missing = [f.name for f in schema.fields if f.name not in frame.columns]
    if missing:
        raise ValueError(f"{path} has no columns {missing}")
    return frame.select(*[f.name for f in schema.fields])


def typed(column: Column, kind: T.DataType) -> Column:
    """Text to the declared type; a value that does not parse becomes null."""
    if isinstance(kind, T.BooleanType):
        return fn.parse_boolean(column)
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, T.DateType):
        return F.trim(column).try_cast(kind)
    number = F.trim(column).try_cast("double")
    if isinstance(kind, T.IntegerType):
        # "3.0" is a whole number written by a tool that had nulls in the column.
        return F.when(number == F.floor(number), number.try_cast("int"))
    return fn.null_if_not_finite(number)


def apply_schema(frame: DataFrame, schema: T.StructType) -> DataFrame:
    return frame.select(*[typed(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields])


def bad_booleans(frame: DataFrame, column: str) -> DataFrame:
    """Spellings the flag parser refuses, with their counts; a missing value counts as one."""
    refused = frame.where(fn.parse_boolean(F.col(column)).isNull())
    return refused.groupBy(F.coalesce(F.col(column), F.lit("<missing>")).alias("value")).agg(
        F.count(F.lit(1)).alias("row_count")
    )


def require_booleans(frame: DataFrame, column: str) -> None:
    """Raise with up to ten refused spellings; only those ten reach the driver."""
    refused = [row["value"] for row in bad_booleans(frame, column).orderBy("value").limit(10).collect()]
    if refused:
        raise ValueError(f"unsupported or missing boolean values in {column}: {refused}")


def read_quotes(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    raw = _raw(spark, path, S.QUOTES)
    if strict:
        require_booleans(raw, "executed")
    return apply_schema(raw, S.QUOTES)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return apply_schema(_raw(spark, path, S.SERIES), S.SERIES)


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    return apply_schema(_raw(spark, path, S.DIMENSION), S.DIMENSION)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet columns of a table in declared order; types are cast, extra columns are not read."""
    frame = spark.read.parquet(path)
    return frame.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_requests(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Scoring requests from a JSON list/object or a CSV, numbered in file order.

    JSON is read with the declared fields and columns that only history has, each as text, so
    nothing is inferred from values; any other key is kept, for the contract to refuse. Rows are
    numbered by file name and place in the file, also over several files. A list is cut into items across
    partitions (see ``json_lists``), so a file of any size is read.
    """
    kind = kind or ("json" if path.endswith(".json") else "csv")
    known = [f.name for f in S.REQUEST.fields]
    if kind == "json":
        names = [*known, *S.HISTORY_ONLY_COLUMNS]
        parsed = F.from_json("item", "map<string,string>")
        refused = F.raise_error(F.concat(F.lit("not a JSON object in "), "_file", F.lit(": "), F.left("item", F.lit(200))))
        items = json_items(spark, path).select("_number", F.coalesce(parsed, refused.cast("map<string,string>")).alias("_item"))
        items = items.withColumn("_keys", F.map_keys("_item"))
        # Items are stored as columns; the map stays only where it has other keys.
        other = F.when(F.size(F.array_except("_keys", F.array(*map(F.lit, names)))) > 0, F.col("_item"))
        rows = materialise(items.select("_number", "_keys", *[F.col("_item")[n].alias(n) for n in names], other.alias("_other")))
        keys = rows.select("_keys").distinct().select(F.explode("_keys").alias("k")).distinct()
        found = [r["k"] for r in keys.orderBy(~F.col("k").isin(*names), "k").limit(len(names) + 10).collect()]
        extra = [k for k in found if k not in names][:10]
        frame = rows.select(F.col("_number").alias("request_ord"), *[n for n in names if n in found], *[F.col("_other")[n].alias(n) for n in extra])
    else:
        frame = spark.read.csv(path, header=True)
        extra = [c for c in frame.columns if c not in known]
        place = {"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_place": F.monotonically_increasing_id()}
        frame = frame.withColumns(place)
        order = ["_file", "_start", "_place"]
        # Equal ranges of the file order, stored so that both uses see one cut.
        ranged = materialise(frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
        frame = positions(ranged, [], order, F.col("_range"), "request_ord").drop(*order, "_range")
    fields = [f for f in S.REQUEST.fields if f.name in frame.columns]
    other = [c for c in frame.columns if c not in {*known, "request_ord"}]
    return frame.select("request_ord", *[typed(F.col(f.name), f.dataType).alias(f.name) for f in fields], *other)


def discover_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every CSV in a folder that has rows and more than one column, by file stem."""
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path", "length")
    )
    tables = {}
    # Only file names are listed here, never their content.
    for row in listed.orderBy("path").collect():
        if row["length"] == 0:
            continue
        frame = spark.read.csv(row["path"], header=True)
        if len(frame.columns) > 1 and not frame.isEmpty():
            tables[row["path"].rsplit("/", 1)[-1].removesuffix(".csv")] = frame
    return tables
