"""Category encodings as joins against a fitted vocabulary table.

A vocabulary is a table (feature, value, code, n), so its size never limits what can be encoded and
nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens import schema as S
from quotelens.operators.drift import long_text
from quotelens.operators.ordered import positions
from quotelens.session import materialise

MIN_CATEGORY_ROWS = 10
INFREQUENT = "infrequent"


def numbered(values: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of (feature, value, ...) with ``code`` 0, 1, 2, ... per feature in the given order.

    Buckets are ranges of the whole order that Spark samples to equal sizes, so a feature whose
    values share their first characters is spread as well as any. The cut is stored before it is
    used twice, since another sample could cut elsewhere.
    """
    ranged = values.repartitionByRange("feature", *order).withColumn("_range", F.spark_partition_id())
    return positions(materialise(ranged), ["feature"], order, F.col("_range"), "code").drop("_range")


def value_table(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct training values per column and their row counts."""
    long = long_text(train, [], columns).where(F.col("value").isNotNull())
    return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct training values per column, coded 0, 1, 2, ... in alphabetical order."""
    return numbered(value_table(train, columns), ["value"])


def most_frequent(vocab: DataFrame) -> DataFrame:
    """Imputation value per column: the most frequent, alphabetically first on a tie."""
    best = F.min_by("value", F.struct((-F.col("n")).alias("c"), F.col("value").alias("v")))
    return vocab.groupBy("feature").agg(best.alias("filler"))


def ordinal_codes(train: DataFrame, rows: DataFrame, columns: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Long (ids, feature, code): missing takes the most frequent value, unknown takes -1."""
    vocab = vocabulary(train, columns)
    long = long_text(rows, ids, columns).join(most_frequent(vocab), "feature", "left")
    long = long.withColumn("value", F.coalesce("value", "filler")).drop("filler")
    return long.join(vocab.select("feature", "value", "code"), ["feature", "value"], "left").select(
        *ids, "feature", "value", F.coalesce("code", F.lit(-1)).alias("code")
    )


def pooled_categories(
    train: DataFrame, rows: DataFrame, columns: Sequence[str], ids: Sequence[str], min_rows: int = MIN_CATEGORY_ROWS
) -> DataFrame:
    """Long (ids, feature, category): values with few training rows, or none, share one pool."""
    vocab = vocabulary(train, columns)
    common = vocab.where(F.col("n") >= min_rows).select("feature", "value", F.col("value").alias("category"))
    long = long_text(rows, ids, columns).join(most_frequent(vocab), "feature", "left")
    long = long.withColumn("value", F.coalesce("value", "filler")).drop("filler")
    return long.join(common, ["feature", "value"], "left").select(
        *ids, "feature", F.coalesce("category", F.lit(INFREQUENT)).alias("category")
    )


def fill_unknown(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    return frame.fillna(S.UNKNOWN, list(columns))


@dataclass
class CategoryEncoder:
    """Codes of category columns as a stored table: (feature, value, code), and a filler per column.

    ``ordinal`` codes follow the alphabet and give -1 to values not seen in training; ``native``
    codes follow the mean training target, so that one threshold of a tree parts values as a split
    over categories would; ``onehot`` codes start at 1, and rare and new values share 0.
    """

    columns: tuple[str, ...]
    encoding: str
    table: DataFrame
    fillers: dict[str, str]

    def encode(self, rows: DataFrame) -> DataFrame:
        """Add ``code_<column>``; one equi-join per column, whose side Spark may broadcast by its known size."""
        other = 0.0 if self.encoding == "onehot" else -1.0
        for column in self.columns:
            codes = self.table.where(F.col("feature") == column).select(F.col("value").alias("_value"), F.col("code").cast("double").alias("_code"))
            filled = F.coalesce(F.col(column).cast("string"), F.lit(self.fillers.get(column)))
            rows = (
                rows.withColumn("_filled", filled)
                .join(codes, F.col("_filled") == F.col("_value"), "left")
                .withColumn(f"code_{column}", F.coalesce("_code", F.lit(other)))
                .drop("_filled", "_value", "_code")
            )
        return rows

    @property
    def outputs(self) -> list[str]:
        return [f"code_{c}" for c in self.columns]


def fit_encoder(train: DataFrame, columns: Sequence[str], encoding: str, target: str) -> CategoryEncoder:
    """Fit codes on every training value; only the one-hot encoding pools values with fewer than ten rows."""
    if encoding == "native":
        wide = train.select(*columns, F.col(target).alias("_target"))
        long = wide.select("_target", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_p"))
        values = (
            long.select("_target", "_p.*").where(F.col("value").isNotNull())
            .groupBy("feature", "value")
            .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("_target"), F.lit(0.0)).alias("mean"))
        )
        codes = numbered(values, ["mean", "value"])
    else:
        values = value_table(train, columns)
        kept = values.where(F.col("n") >= MIN_CATEGORY_ROWS) if encoding == "onehot" else values
        codes = numbered(kept, ["value"]).withColumn("code", F.col("code") + (1 if encoding == "onehot" else 0))
    # One filler per column, so what is collected is as long as the list of columns.
    fillers = {r["feature"]: r["filler"] for r in most_frequent(values).collect()}
    return CategoryEncoder(tuple(columns), encoding, materialise(codes.select("feature", "value", "code")), fillers)
