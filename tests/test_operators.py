import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import dimension, quotes, requests, series
from quotelens import schema as S
from quotelens.operators import association, audit, baselines, drift, metrics, quality, scoring, selection, splits
from quotelens.operators.asof import asof_join
from quotelens.operators.ordered import exact_quantiles, positions, running_sums, value_counts
from quotelens.operators.rolling import rolling_history
from quotelens.plans.features import feature_table


def skewed(spark, rows=4000, seed=7):
    """One key holds most rows, many values repeat."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(rows) < 0.7, "hot", rng.choice(["a", "b", None], rows))
    value = np.round(rng.lognormal(0, 2, rows) * rng.choice([-1, 1], rows), 2)
    pdf = pd.DataFrame({"k": key, "v": value, "y": np.round(value + rng.normal(0, 3, rows), 1), "id": np.arange(rows)})
    return pdf, spark.createDataFrame(pdf.astype({"k": object}).where(pdf.notna(), None), "k string, v double, y double, id bigint").repartition(5)


def test_running_sums_and_quantiles_match_numpy(spark):
    pdf, frame = skewed(spark)
    got = {r["k"]: r for r in exact_quantiles(frame, ["k"], "v", {"q": 0.9, "m": 0.5}).collect()}
    for key, group in pdf.groupby("k", dropna=False):
        row = got[None if pd.isna(key) else key]
        assert row["q"] == pytest.approx(np.quantile(group["v"], 0.9))
        assert row["m"] == pytest.approx(group["v"].median())
    counts = value_counts(frame, [], "v")
    ranked = running_sums(counts, [], "v", ["n"]).toPandas().sort_values("v")
    assert (ranked["n_before"].to_numpy() == np.r_[0, ranked["n"].cumsum().to_numpy()[:-1]]).all()
    assert np.allclose(ranked["next_value"].to_numpy()[:-1], ranked["v"].to_numpy()[1:])


def test_positions_are_exact(spark):
    pdf, frame = skewed(spark)
    got = positions(frame, ["k"], ["id"], F.floor(F.col("id") / 100)).toPandas()
    assert (got.sort_values("id").groupby("k", dropna=False).cumcount().to_numpy() == got.sort_values("id")["position"].to_numpy()).all()


def test_two_sample_and_spearman_match_brute_force(spark):
    pdf, frame = skewed(spark)
    labelled = frame.withColumn("split", F.when(F.col("id") % 3 == 0, "validation").otherwise("train"))
    long = drift.long_numeric(labelled, ["split"], ["v"])
    row = drift.two_sample(long, ["feature"], "split", "train", "validation").head()
    left, right = pdf[pdf.id % 3 != 0]["v"].to_numpy(), pdf[pdf.id % 3 == 0]["v"].to_numpy()
    grid = np.unique(pdf["v"])
    gap = np.abs(np.searchsorted(np.sort(left), grid, "right") / len(left) - np.searchsorted(np.sort(right), grid, "right") / len(right))
    assert row["ks_statistic"] == pytest.approx(gap.max())
    assert row["wasserstein_distance"] == pytest.approx((gap[:-1] * np.diff(grid)).sum())
    rho = association.spearman(frame.select("k", F.col("v").alias("value"), F.col("y").alias("target")), ["k"]).collect()
    for r in rho:
        group = pdf[pdf["k"].isna()] if r["k"] is None else pdf[pdf["k"] == r["k"]]
        assert r["spearman"] == pytest.approx(group["v"].rank().corr(group["y"].rank()))


def test_asof_matches_pandas_under_any_partitioning(spark):
    rng = np.random.default_rng(3)
    days = pd.date_range("2020-01-01", "2021-12-31")
    right = pd.DataFrame({"u": "hot", "date": rng.choice(days, 90, replace=False)})
    right = pd.concat([right, pd.DataFrame({"u": "cold", "date": rng.choice(days, 2, replace=False)})], ignore_index=True)
    right["v"] = np.arange(len(right), dtype=float)
    left = pd.DataFrame({"id": np.arange(500), "u": rng.choice(["hot", "cold", "none"], 500), "t": rng.choice(days, 500)})
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("date"), left_on="t", right_on="date", by="u").set_index("id")["v"]
    lf = spark.createDataFrame(left).withColumn("t", F.to_date("t"))
    rf = spark.createDataFrame(right).withColumn("date", F.to_date("date"))
    for parts in (1, 7):
        got = asof_join(lf.repartition(parts), rf.repartition(parts), by="u", left_time="t", history_time="date", values=["v"]).toPandas().set_index("id")["v"]
        pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_chunked_windows_match_pandas(spark):
    rng = np.random.default_rng(5)
    days = pd.date_range("2019-01-01", periods=700)
    pdf = pd.concat([pd.DataFrame({"date": days[:n], "underlying": u, "realized_vol_63d": rng.random(n)}) for u, n in (("A", 700), ("B", 130), ("C", 1))])
    frame = spark.createDataFrame(pdf).withColumn("date", F.to_date("date"))
    got = rolling_history(frame, chunk_rows=128).toPandas().sort_values(["underlying", "date"]).reset_index(drop=True)
    assert len(got) == len(pdf)
    by = pdf.sort_values(["underlying", "date"]).groupby("underlying")["realized_vol_63d"]
    assert np.allclose(got["realized_vol_63d_21d_mean"], by.transform(lambda s: s.rolling(21, 1).mean()))
    assert np.allclose(got["realized_vol_63d_126d_std"], by.transform(lambda s: s.rolling(126, 2).std()), equal_nan=True)
    assert np.allclose(got["realized_vol_63d_change_21d"], by.transform(lambda s: s - s.shift(21)), equal_nan=True)


def test_golden_feature_row_sees_no_future(spark):
    row = feature_table(
        quotes(spark, {}),
        series(spark, ("2024-01-02", "AAA", 0.18), ("2024-01-20", "AAA", 0.9)),
        dimension(spark, ("AAA", "Sector", 0.25)),
        registry=S.FeatureRegistry(("AAA", "BBB")),
        include_target=False,
    ).head().asDict()
    want = {
        "realized_vol_63d_mean": 0.18, "basket_realized_vol_21d_mean": 0.18, "basket_realized_vol_trend_mean": 0.0, "barrier_gap_pct": 0.4,
        "autocall_barrier_above_par_pct": -0.05, "protection_buffer_pct": 0.45, "autocall_to_protection_ratio": 0.95 / 0.55, "no_call_observation_count": 4.0,
        "is_single_underlying": 1, "is_worst_of": 0, "basket_complexity_score": 0, "worst_of_pressure": 0, "sector_concentration": 1.0,
        "has_multiple_sectors": 0, "quoted_minus_structural_vol_mean": 0.02, "realized_minus_structural_vol_mean": -0.07,
        "realized_to_structural_vol_ratio": 0.72, "quoted_to_realized_vol_ratio": 1.5, "quoted_to_structural_vol_ratio": 1.08,
        "realized_vol_dispersion_ratio": 0.0, "structural_vol_dispersion_ratio": 0.0, "realized_vol_63d_top2_spread": 0.0,
        "structural_base_vol_top2_spread": 0.0, "is_daily_observation": 0, "underlying_AAA": 1, "pair_AAA_BBB": 0,
    }
    for name, value in want.items():
        assert row[name] == pytest.approx(value, abs=1e-12), name
    for name in ("primary_underlying", "basket_signature", "highest_structural_vol_underlying", "lowest_realized_vol_underlying"):
        assert row[name] == "AAA"
    assert row["second_highest_realized_vol_underlying"] == row["second_highest_structural_vol_underlying"] == "UNKNOWN"
    assert row["callable_maturity_months"] < row["nominal_maturity_months"]
    assert not {"executed", "avg_duration_months", "start_date", "end_date", "requested_date"} & set(row)


def test_ties_follow_basket_order_and_unknown_members_stay_null(spark):
    table = feature_table(
        quotes(spark, {"underlyings": "BBB|AAA|CCC", "basket_type": "worst_of"}, {"underlyings": "ZZZ"}),
        series(spark, ("2024-01-01", "AAA", 0.3), ("2024-01-01", "BBB", 0.3)),
        dimension(spark, ("AAA", "s2", 0.2), ("BBB", "s1", 0.2), ("CCC", "s2", 0.1)),
    )
    rows = {r["rfq_id"]: r for r in table.collect()}
    assert rows["r1"]["highest_structural_vol_underlying"] == "BBB" and rows["r1"]["second_highest_realized_vol_underlying"] == "AAA"
    assert rows["r1"]["dominant_sector"] == "s2" and rows["r1"]["sector_count"] == 2
    assert rows["r2"]["realized_vol_63d_mean"] is None and rows["r2"]["dominant_sector"] == "UNKNOWN"


def test_block_sizes():
    registry = S.FeatureRegistry()
    sizes = {"contractual": 18, "product": 3, "basket": 137, "market": 22, "date": 3, "commercial": 2, "all_features": 185, "all_without_commercial": 183,
             "all_without_noise": 173, "compact_core": 27, "single_core": 24, "single_without_noise": 20, "single_stable": 19, "single_underlying": 20,
             "single_underlying_no_sector": 19, "worst_of_core": 166, "worst_of_without_noise": 160, "worst_of_stable": 157, "worst_of_tail_focus": 153,
             "worst_of_risk_underlying": 157, "worst_of_tail_underlying": 153, "global_stable": 163, "global_stable_tail": 159, "global_stable_no_sector": 161,
             "global_risk_underlying": 163, "global_all_underlying": 163, "global_tail_underlying": 159}
    assert {name: len(registry.block_columns(name)) for name in S.BLOCKS} == sizes
    numeric, categorical = registry.select_block("all_without_commercial")
    assert "pair_CORL_KYBR" in numeric and "counterparty" not in categorical and S.TARGET not in numeric
    with pytest.raises(ValueError):
        registry.select_block("nothing")


def test_validation_report_and_fail_fast(spark):
    good = quotes(spark, {}, {"underlyings": "AAA|BBB", "basket_type": "worst_of"})
    history = series(spark, ("2024-01-01", "AAA", 0.2), ("2024-01-01", "BBB", 0.2))
    members = dimension(spark, ("AAA", "s", 0.2), ("BBB", "s", 0.2))
    assert quality.validate_all(good, history, members, fail_fast=True).where("violations > 0").count() == 0
    bad = quotes(spark, {"underlyings": "AAA|AAA", "basket_type": "worst_of"})
    with pytest.raises(quality.ValidationError, match="duplicate_members"):
        quality.validate_all(bad, history, members, fail_fast=True)
    with pytest.raises(quality.ValidationError, match="membership"):
        quality.validate_all(good, history, dimension(spark, ("AAA", "s", 0.2)), fail_fast=True)
    gaps = {r["underlying"]: r for r in quality.series_gaps(series(spark, ("2024-01-30", "A", 0.1), ("2024-02-20", "A", 0.1), ("2024-02-21", "A", 0.1))).collect()}
    assert gaps["A"]["max_gap_days"] == 21 and gaps["A"]["too_long"]


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, None),
        ({"underlyings": " aaa "}, None),
        ({"end_date": "2024-01-12", "no_call_period_months": 0}, "date_order"),
        ({"requested_date": "2024-01-16"}, "requested_after_start"),
        ({"no_call_period_months": 80}, "no_call_beyond_maturity"),
        ({"underlyings": "AAA|aaa", "basket_type": "worst_of"}, "duplicate_members"),
        ({"basket_type": "worst_of"}, "basket_size"),
        ({"underlyings": "AAA|BBB"}, "basket_size"),
        ({"observation_frequency": "every blue moon"}, "frequency"),
        ({"protection_barrier_pct": 0.0}, "protection_range"),
    ],
)
def test_request_contract(spark, change, reason):
    row = quality.request_contract(requests(spark, change)).head()
    assert row["reasons"] == ([reason] if reason else [])
    assert row["underlyings"] == row["underlyings"].upper()


def test_request_columns_and_atomic_batches(spark):
    assert "executed" not in quality.request_contract(quotes(spark, {})).columns
    with pytest.raises(quality.ValidationError, match="unexpected"):
        quality.request_contract(requests(spark, {}).withColumn("unexpected", F.lit(1)))
    with pytest.raises(quality.ValidationError, match="date_order"):
        quality.request_contract(requests(spark, {}, {"end_date": "2020-01-01"}), atomic=True)


def test_splits_and_folds(spark):
    frame = quotes(spark, *[{"requested_date": f"{y}-01-01"} for y in (2020, 2021, 2022, 2023)])
    years = S.SplitYears()
    assert {r["requested_date"].year: r["split"] for r in splits.temporal_split(frame, years).collect()} == {2020: "train", 2021: "train", 2022: "validation", 2023: "test"}
    capped = splits.fold_map(frame, years).select("validation_year", "train_end_year").distinct().collect()
    assert [tuple(r) for r in capped] == [(2022, 2021)]
    assert splits.fold_map(frame, None).select("validation_year").distinct().count() == 2
    one_year = quotes(spark, *[{"requested_date": f"2020-01-{d:02d}"} for d in range(1, 21)])
    counts = {r["split"]: r["count"] for r in splits.split_or_fallback(one_year, years).groupBy("split").count().collect()}
    assert counts == {"train": 14, "validation": 3, "test": 3}


def test_executed_filter_keeps_only_explicit_true(spark):
    frame = quotes(spark, *[{"executed": e} for e in (True, True, True, True, False, None)])
    assert splits.executed_only(frame).count() == 4


def test_categorical_grain(spark):
    frame = quotes(spark, {"product_type": "one"}, {"product_type": "two", "underlyings": "AAA|BBB|CCC", "basket_type": "worst_of"})
    members = dimension(spark, ("AAA", "Tech", 0.1), ("BBB", "Energy", 0.1), ("CCC", "Health", 0.1))
    rows = {r["feature"]: r for r in audit.categorical_summary(frame, members).collect()}
    assert rows["product_type"]["top_category_count"] == 1 and rows["product_type"]["observation_level"] == "rfq"
    assert rows["underlying"]["top_category_count"] == 2 and rows["underlying"]["top_category"] == "AAA"


def test_unseen_share(spark):
    frame = quotes(spark, *[{"product_type": p, "requested_date": f"{y}-01-01"} for p, y in (("P1", 2020), ("P1", 2021), ("P2", 2022), ("P2", 2023))])
    labelled = splits.temporal_split(frame, S.SplitYears())
    rows = {r["feature"]: r for r in audit.unseen_categories(labelled, dimension(spark, ("AAA", "Tech", 0.1))).collect()}
    assert {r["split"] for r in rows.values()} == {"validation"}
    assert rows["product_type"]["unseen_categories"] == 1 and rows["product_type"]["affected_row_share"] == 1.0


def test_ranking_refuses_test_metrics(spark):
    table = spark.createDataFrame([("single", "s_a", 2.0), ("single", "s_b", 1.0), ("worst_of", "w_a", 4.0), ("worst_of", "w_b", 3.0)], "segment string, model_name string, validation_mae double")
    assert [r["model_name"] for r in selection.top_n_per_segment(table, 1).orderBy("segment").collect()] == ["s_b", "w_b"]
    with pytest.raises(ValueError):
        selection.top_n_per_segment(table.withColumn("test_mae", F.lit(1.0)), 1, "test_mae")


def test_metrics_and_error_slices(spark):
    rows = spark.createDataFrame([(20.0, 22.0), (30.0, 29.0)], "actual double, prediction double")
    got = metrics.regression_metrics(rows).head()
    assert (got["mae"], got["median_absolute_error"]) == (1.5, 1.5) and got["r2"] == pytest.approx(0.9)
    buckets = {r["duration_bucket"]: r["count"] for r in metrics.bucket_mae(rows).collect()}
    assert buckets == {"0-12": 0, "12-24": 1, "24-36": 1, "36-60": 0, "60+": 0}


def test_group_median_falls_back_for_new_keys(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 10.0)], "k string, target double")
    rows = spark.createDataFrame([("a",), ("new",), (None,)], "k string")
    got = {r["k"]: r["prediction"] for r in baselines.group_median(train, rows, ["k"], "target").collect()}
    assert got == {"a": 2.0, "new": 3.0, None: 10.0}


def test_conformal_uses_the_higher_order_statistic(spark):
    rng = np.random.default_rng(1)
    residual = np.round(rng.random(137) * 9, 3)
    rows = spark.createDataFrame([(float(r), 0.0) for r in residual], "actual double, prediction double")
    got = selection.conformal_calibrate(rows).head()
    want = np.quantile(residual, 0.9, method="higher")
    assert got["absolute_residual_quantile"] == want and got["empirical_coverage"] == pytest.approx((residual <= want).mean())


def test_bootstraps_agree_with_numpy(spark):
    rng = np.random.default_rng(2)
    a, b = rng.gamma(2, 2, 300), rng.gamma(2, 2.2, 300)
    pairs = spark.createDataFrame([(i, float(x), float(y), f"Q{i % 4}") for i, (x, y) in enumerate(zip(a, b))], "rfq_id bigint, error_global double, error_segmented double, block string")
    draws = rng.integers(0, 300, (4000, 300))
    low, high = np.percentile((a - b)[draws].mean(axis=1), [2.5, 97.5])
    got = selection.bootstrap_rows(pairs, replicates=2000).head()
    assert got["ci_95_low"] == pytest.approx(low, abs=0.08) and got["ci_95_high"] == pytest.approx(high, abs=0.08)
    again = selection.bootstrap_rows(pairs.repartition(7), replicates=2000).head()
    assert again["ci_95_low"] == pytest.approx(got["ci_95_low"])
    blocks = selection.choose_strategy(selection.bootstrap_blocks(pairs, replicates=500)).head()
    assert blocks["n_blocks"] == 4 and blocks["ci_95_low"] <= blocks["point_estimate"] <= blocks["ci_95_high"]


def test_coverage_reasons(spark):
    asked = quotes(spark, {}, {"underlyings": "ZZZ"}, {"requested_date": "2024-03-01"}, {"requested_date": "2023-01-01"}, {"product_type": "P9"})
    history, members = series(spark, ("2024-01-10", "AAA", 0.2)), dimension(spark, ("AAA", "s", 0.2))
    got = scoring.coverage_check(asked, history, members, spark.createDataFrame([("P1",)], "p string"))
    assert {r["rfq_id"]: r["reasons"] for r in got.collect()} == {
        "r1": [], "r2": ["unknown_member", "no_history"], "r3": ["stale_history"], "r4": ["no_history"], "r5": ["unknown_product"]
    }


def test_out_of_range_message(spark):
    ranges = scoring.request_ranges(quotes(spark, {}, {"notional_credits": 250000.0}), series(spark, ("2024-01-10", "AAA", 0.2)))
    row = scoring.ood_flags(quotes(spark, {"notional_credits": 1500000.0}), ranges).head()
    assert row["out_of_distribution"] and row["warnings"] == ["notional_credits=1.5e+06 is outside the training range [120000, 250000]"]
