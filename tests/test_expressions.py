import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quotelens import functions as fn
from quotelens.operators.association import pearson_terms


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).head()["y"]


@pytest.mark.parametrize(
    ("text", "months", "label"),
    [
        ("1M", 1.0, "1m"), ("Monthly", 1.0, "1m"), ("mensual", 1.0, "1m"), ("M", 1.0, "1m"), ("1 month", 1.0, "1m"),
        ("2M", 2.0, "2m"), ("3M", 3.0, "3m"), ("Quarterly", 3.0, "3m"), (" trimestral ", 3.0, "3m"), ("Q", 3.0, "3m"),
        ("6M", 6.0, "6m"), ("1Y", 12.0, "12m"), ("12M", 12.0, "12m"), ("Annual", 12.0, "12m"), ("anual", 12.0, "12m"),
        ("1D", 1 / 21, "daily"), ("every blue moon", None, None),
    ],
)
def test_frequency(spark, text, months, label):
    got = one(spark, text, "string", fn.frequency_months)
    assert got == (pytest.approx(months) if months else None)
    assert one(spark, text, "string", lambda c: fn.frequency_label(fn.frequency_months(c))) == label


def test_basket_text(spark):
    assert one(spark, "KYBR| CORL |", "string", fn.parse_basket) == ["KYBR", "CORL"]
    for text in ("KYBR|CORL", "CORL|KYBR"):
        assert one(spark, text, "string", lambda c: fn.basket_signature(fn.parse_basket(c))) == "CORL|KYBR"


def test_boolean_spellings(spark):
    rows = spark.createDataFrame([("True",), ("false",), ("1",), ("0",), (" SÍ ",), ("maybe",), (None,)], "x string")
    assert [r[0] for r in rows.select(fn.parse_boolean(F.col("x"))).collect()] == [True, False, True, False, True, None, None]


@pytest.mark.parametrize(
    ("months", "maturity", "duration"),
    [(-1.0, None, None), (0.0, "0-24m", "0-12"), (24.0, "0-24m", "12-24"), (24.1, "24-36m", "24-36"), (84.0, "60-84m", "60+"), (85.0, "84m+", "60+")],
)
def test_bins_are_right_closed(spark, months, maturity, duration):
    assert one(spark, months, "double", fn.maturity_bucket) == maturity
    assert one(spark, months, "double", fn.duration_bucket) == duration


def test_clip_upper_wins_when_bounds_cross(spark):
    frame = spark.range(1).select(fn.clip_to_contract(F.lit(5.0), F.lit(20.0), F.lit(12.0)).alias("y"))
    assert frame.head()["y"] == 12.0


@pytest.mark.parametrize(
    ("value", "text"),
    [(0.0, "0"), (3.0, "3"), (0.95, "0.95"), (250000.0, "250000"), (1234567.0, "1.23457e+06"), (0.0001, "0.0001"), (0.00001234, "1.234e-05"), (-2.5, "-2.5")],
)
def test_general_text(spark, value, text):
    assert text == "%g" % value
    assert one(spark, value, "double", fn.general_text) == text


def test_tail_probabilities(spark):
    row = spark.range(1).select(
        fn.chi2_sf(F.lit(3.841458820694124), F.lit(1)).alias("a"),
        fn.chi2_sf(F.lit(18.307038053275146), F.lit(10)).alias("b"),
        fn.chi2_sf(F.lit(4000.0), F.lit(5)).alias("c"),
        fn.ks_sf(F.lit(0.19206), F.lit(100), F.lit(100)).alias("d"),
    ).head()
    assert row["a"] == pytest.approx(0.05, abs=1e-9)
    assert row["b"] == pytest.approx(0.05, abs=1e-9)
    assert row["c"] == 0.0
    assert row["d"] == pytest.approx(0.05, abs=2e-3)


def test_pearson_of_a_constant_is_null(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert frame.agg(pearson_terms(F.col("x"), F.col("y"))).head()[0] is None


def test_join_sorted_counts_the_rest(spark):
    values = F.array(*[F.lit(f"v{i:02d}") for i in range(20)])
    text = spark.range(1).select(fn.join_sorted(values, F.lit(23))).head()[0]
    assert text.endswith("v19 ... (+3)")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=2, max_size=40))
def test_order_bucket_is_monotone(spark, values):
    from quotelens.operators.ordered import order_bucket

    rows = spark.createDataFrame([(float(v),) for v in values], "x double")
    pairs = sorted((r["x"], r["b"]) for r in rows.select("x", order_bucket(F.col("x")).alias("b")).collect())
    assert all(a[1] <= b[1] for a, b in zip(pairs, pairs[1:]))
