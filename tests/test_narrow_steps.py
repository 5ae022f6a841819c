from pyspark.sql import functions as F

from quotelens import schema as S
from quotelens.catalog import learning
from quotelens.plans import gram


def test_native_codes_need_no_stored_model_rows(spark, monkeypatch):
    """only the encoded columns are stored."""
    stored = []

    class Views:
        registry = S.FeatureRegistry()

        def model_columns(self, *columns):
            stored.append(columns)
            rows = [(i, "train" if i % 4 else "test", float(i), *[f"v{i % 3}"] * (len(columns) - 3)) for i in range(40)]
            return spark.createDataFrame(rows, "rfq_id bigint, split string, target double, " + ", ".join(f"{c} string" for c in columns[3:]))

    got = learning.prep_native_cat(Views())
    _, categorical = Views.registry.select_block("compact_core")
    assert stored == [("rfq_id", "split", "target", *categorical)]
    assert got.count() == 40 and got.columns == ["rfq_id", *[f"code_{c}" for c in categorical]]


def test_grid_medians_make_no_row_per_feature(spark, monkeypatch):
    """values are counted over wide rows; missing and NaN are left out."""
    plans = []
    monkeypatch.setattr(gram, "running_sums", lambda counts, *rest, keep=gram.running_sums: plans.append(counts._jdf.queryExecution().optimizedPlan().toString()) or keep(counts, *rest))
    frame = spark.createDataFrame([("train" if i % 2 else "test", float(i), None if i % 5 == 0 else float("nan") if i == 3 else float(i * 7 % 11), None) for i in range(60)], "split string, target double, x double, empty double")
    strata = gram.Strata(frame, ["split"], [F.col("split") == "train", F.lit(True)])
    got = gram.lower_medians(frame, strata, strata.sets, ["x", "empty"])
    for medians, names in zip(got, (["train"], ["train", "test"])):
        values = sorted(r["x"] for r in frame.where(F.col("split").isin(names)).collect() if r["x"] is not None and r["x"] == r["x"])
        assert medians == {"x": values[(len(values) - 1) // 2]}
    assert "Generate" not in plans[0]
