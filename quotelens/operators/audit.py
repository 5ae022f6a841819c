"""Descriptive tables: target shape, category counts, coverage, viability and headline figures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelens import functions as fn
from quotelens import schema as S
from quotelens.operators import ordered
from quotelens.operators.baskets import explode_basket
from quotelens.operators.drift import MISSING, long_text
from quotelens.operators.ordered import exact_quantiles, null_safe_join
from quotelens.operators.sketches import numeric_columns
from quotelens.operators.splits import fold_map, fold_text

def _rows() -> Column:
    return F.count(F.lit(1))


def first_values(frame: DataFrame, keys: Sequence[str], value: str, limit: int) -> DataFrame:
    """Number of distinct values per key and the alphabetically first ``limit`` of them.

    A row-number filter keeps at most ``limit`` values per key on each task before the shuffle,
    so no list grows with the number of values.
    """
    distinct = frame.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    order = Window.partitionBy(*keys).orderBy(value)
    head = distinct.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= limit)
    lists = head.groupBy(*keys).agg(F.collect_list(value).alias("first"))
    sizes = distinct.groupBy(*keys).agg(_rows().alias("distinct_values"))
    return null_safe_join(sizes, lists, keys)


def joined_values(frame: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Per key: sorted values as text, at most 20, with how many more there are."""
    parts = first_values(frame, keys, value, S.MAX_JOINED_VALUES)
    return parts.select(*keys, fn.join_sorted(F.col("first"), F.col("distinct_values")).alias(name))


def target_stats(column: str = S.TARGET) -> list[Column]:
    return [F.avg(column).alias("target_mean"), F.stddev_samp(column).alias("target_std")]


def with_median(frame: DataFrame, grouped: DataFrame, keys: Sequence[str], column: str = S.TARGET, name: str = "target_median") -> DataFrame:
    middle = exact_quantiles(frame, keys, column, {name: 0.5})
    return null_safe_join(grouped, middle, keys, "left")


# --------------------------------------------------------------------------------------
# Target
# --------------------------------------------------------------------------------------

TARGET_QUANTILES = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}


def target_distribution(frame: DataFrame, keys: Sequence[str], target: str = "target") -> DataFrame:
    basic = frame.groupBy(*keys).agg(
        _rows().alias("row_count"),
        F.avg(target).alias("mean"),
        F.stddev_samp(target).alias("std"),
        F.min(target).alias("min"),
        F.max(target).alias("max"),
        F.avg(F.coalesce(F.col(target) >= S.LONG_DURATION_MONTHS, F.lit(False)).cast("double")).alias("duration_60_plus_rate"),
    )
    return null_safe_join(basic, exact_quantiles(frame, keys, target, TARGET_QUANTILES), keys, "left")


def outlier_fences(frame: DataFrame, target: str = "target") -> DataFrame:
    """Tukey fences per segment, from train rows only."""
    train = frame.where(F.col("split") == "train")
    quartiles = exact_quantiles(train, ["segment"], target, {"q1": 0.25, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return quartiles.select(
        "segment", (F.col("q1") - reach).alias("low_threshold"), (F.col("q3") + reach).alias("high_threshold")
    )


def outlier_summary(frame: DataFrame, target: str = "target") -> DataFrame:
    fenced = null_safe_join(frame, outlier_fences(frame, target), ["segment"], "left")
    value = F.col(target)
    outside = F.coalesce((value < F.col("low_threshold")) | (value > F.col("high_threshold")), F.lit(False))
    long = F.coalesce(value >= S.LONG_DURATION_MONTHS, F.lit(False))
    return fenced.groupBy("segment", "split").agg(
        _rows().alias("row_count"),
        F.min("low_threshold").alias("low_threshold"),
        F.min("high_threshold").alias("high_threshold"),
        F.count_if(outside).alias("outlier_rows"),
        F.avg(outside.cast("double")).alias("outlier_rate"),
        F.count_if(long).alias("duration_60_plus_rows"),
        F.avg(long.cast("double")).alias("duration_60_plus_rate"),
    )


def outlier_rows(frame: DataFrame, columns: Sequence[str], target: str = "target") -> DataFrame:
    """Rows above the high fence of their segment, largest target first."""
    fenced = null_safe_join(frame, outlier_fences(frame, target), ["segment"])
    return (
        fenced.where(F.col(target) > F.col("high_threshold"))
        .select("segment", "split", *columns, target, F.col("high_threshold").alias("segment_high_outlier_threshold"))
        .orderBy("segment", F.desc(target))
    )


def share_in_group(counts: DataFrame, keys: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """Share of each row's value in its group total; groups hold one row per category."""
    totals = counts.groupBy(*keys).agg(F.sum(value).alias("_total"))
    return null_safe_join(counts, totals, keys).withColumn(
        name, F.try_divide(F.col(value).cast("double"), F.col("_total").cast("double"))
    ).drop("_total")


MIX_COLUMNS = ("product_type", "basket_type", "observation_frequency", "duration_bucket")


def categorical_mix(frame: DataFrame, columns: Sequence[str] = MIX_COLUMNS) -> DataFrame:
    """Count and share per (segment, split, value); duration classes without rows are kept."""
    counts = long_text(frame, ["segment", "split"], columns).groupBy(
        F.col("feature").alias("column"), "segment", "split", "value"
    ).agg(_rows().alias("row_count"))
    if "duration_bucket" in columns:
        groups = counts.select("segment", "split").distinct()
        grid = groups.select(
            F.lit("duration_bucket").alias("column"),
            "segment",
            "split",
            F.explode(F.array(*[F.lit(v) for v in S.DURATION_LABELS_OPEN])).alias("value"),
            F.lit(0).cast("bigint").alias("row_count"),
        )
        counts = counts.unionByName(grid).groupBy("column", "segment", "split", "value").agg(
            F.sum("row_count").alias("row_count")
        )
    return share_in_group(counts, ["column", "segment", "split"], "row_count")


# --------------------------------------------------------------------------------------
# Categories
# --------------------------------------------------------------------------------------


def _category_rows(quotes: DataFrame, dimension: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Long (ids, observation_level, feature, value): quote grain and member grain kept apart."""
    months = fn.frequency_months(F.col("observation_frequency"))
    labelled = quotes.withColumn("observation_frequency_clean", fn.frequency_label(months))
    per_quote = long_text(labelled, ids, S.QUOTE_CATEGORICALS).withColumn("observation_level", F.lit("rfq"))
    exploded = labelled.select(*ids, F.explode(fn.parse_basket(F.col("underlyings"))).alias("underlying"))
    members = exploded.join(dimension.select("underlying", "sector"), "underlying", "left")
    per_member = long_text(members, ids, S.MEMBER_CATEGORICALS).withColumn(
        "observation_level", F.lit("underlying")
    )
    return per_quote.unionByName(per_member)


def categorical_summary(quotes: DataFrame, dimension: DataFrame, target: str = S.TARGET) -> DataFrame:
    rows = _category_rows(quotes, dimension, [target])
    per_value = rows.groupBy("feature", "observation_level", "value").agg(
        _rows().alias("n"), F.avg(target).alias("mean")
    )
    # Largest count first, then the alphabetically first value.
    top = F.min_by("value", F.struct((-F.col("n")).alias("c"), F.coalesce("value", F.lit(MISSING)).alias("v")))
    return per_value.groupBy("feature", "observation_level").agg(
        _rows().alias("cardinality"),
        F.count_if(F.col("n") < S.RARE_CATEGORY_ROWS).alias("rare_categories_lt_20"),
        top.alias("top_category"),
        F.max("n").alias("top_category_count"),
        (F.max("mean") - F.min("mean")).alias("target_mean_range"),
    )


def temporal_category_counts(quotes: DataFrame, dimension: DataFrame, split: str = "split") -> DataFrame:
    return (
        _category_rows(quotes, dimension, [split])
        .groupBy(split, "feature", "observation_level", F.col("value").alias("category"))
        .agg(_rows().alias("count"))
    )


def unseen_categories(
    quotes: DataFrame, dimension: DataFrame, *, include_test: bool = False, split: str = "split"
) -> DataFrame:
    """Categories of a later split that train never shows, and the share of rows they touch."""
    compared = ["validation", "test"] if include_test else ["validation"]
    counts = temporal_category_counts(quotes, dimension, split).withColumn(
        "category", F.coalesce("category", F.lit(MISSING))
    )
    train = counts.where(F.col(split) == "train").select("feature", "category")
    later = counts.where(F.col(split).isin(*compared))
    unseen = later.join(train, ["feature", "category"], "left_anti")
    totals = later.groupBy("feature", split, "observation_level").agg(F.sum("count").alias("_total"))
    touched = unseen.groupBy("feature", split).agg(F.sum("count").alias("affected_rows"))
    named = first_values(unseen, ["feature", split], "category", S.MAX_UNSEEN_VALUES)
    return (
        totals.join(touched, ["feature", split], "left")
        .join(named, ["feature", split], "left")
        .select(
            "feature",
            split,
            "observation_level",
            F.coalesce("distinct_values", F.lit(0)).alias("unseen_categories"),
            F.coalesce("affected_rows", F.lit(0)).alias("affected_rows"),
            F.coalesce(F.try_divide(F.col("affected_rows").cast("double"), F.col("_total").cast("double")), F.lit(0.0)).alias("affected_row_share"),
            F.coalesce(F.array_join(F.sort_array("first"), "|"), F.lit("")).alias("unseen_category_values"),
        )
    )


def group_target_stats(quotes: DataFrame, keys: Sequence[str] = ("product_type", "basket_type")) -> DataFrame:
    grouped = quotes.groupBy(*keys).agg(
        F.count(S.TARGET).alias("count"), F.avg(S.TARGET).alias("mean"), F.stddev_samp(S.TARGET).alias("std")
    )
    return with_median(quotes, grouped, list(keys), name="median")


# --------------------------------------------------------------------------------------
# Split audit
# --------------------------------------------------------------------------------------


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, 2)


def _grand_total(frame: DataFrame) -> Column:
    return frame.agg(_rows().alias("n")).scalar()


def product_summary(frame: DataFrame) -> DataFrame:
    key = ["product_type"]
    grouped = frame.groupBy(*key).agg(
        _rows().alias("trainable_rows"),
        F.avg("basket_size").alias("mean_underlyings"),
        F.min("requested_date").alias("min_requested_date"),
        F.max("requested_date").alias("max_requested_date"),
        *target_stats(),
    )
    named = joined_values(frame, key, "basket_type", "basket_type_associated")
    out = with_median(frame, null_safe_join(grouped, named, key, "left"), key)
    return out.withColumn("pct_total", percent(F.col("trainable_rows"), _grand_total(frame)))


def basket_summary(frame: DataFrame) -> DataFrame:
    grouped = frame.groupBy("basket_type").agg(
        _rows().alias("trainable_rows"), F.count_distinct("product_type").alias("products"), *target_stats()
    )
    return with_median(frame, grouped, ["basket_type"]).withColumn(
        "pct_total", percent(F.col("trainable_rows"), _grand_total(frame))
    )


def year_summary(frame: DataFrame) -> DataFrame:
    grouped = frame.groupBy("requested_year").agg(
        _rows().alias("trainable_rows"),
        F.count_distinct("product_type").alias("product_types"),
        F.count_distinct("basket_type").alias("basket_types"),
        *target_stats(),
    )
    return with_median(frame, grouped, ["requested_year"]).withColumn(
        "pct_total", percent(F.col("trainable_rows"), _grand_total(frame))
    )


def split_summary(frame: DataFrame) -> DataFrame:
    grouped = frame.groupBy("split").agg(
        _rows().alias("row_count"),
        F.min("requested_date").alias("min_requested_date"),
        F.max("requested_date").alias("max_requested_date"),
        F.count_distinct("product_type").alias("product_types"),
        F.count_distinct("basket_type").alias("basket_types"),
        *target_stats(),
    )
    return with_median(frame, grouped, ["split"]).withColumn(
        "pct_total", percent(F.col("row_count"), _grand_total(frame))
    )


def member_usage_rows(frame: DataFrame) -> DataFrame:
    return explode_basket(frame, "product_type", "basket_type", "requested_year", "split")


def member_summary(frame: DataFrame, dimension: DataFrame) -> DataFrame:
    """Dimension rows with how often, when and where each member appears."""
    members, key = member_usage_rows(frame), ["underlying"]
    usage = members.groupBy(*key).agg(
        _rows().alias("total_appearances"),
        F.count_distinct("requested_year").alias("years_present"),
        F.count_distinct("split").alias("splits_present"),
    )
    baskets = joined_values(members, key, "basket_type", "basket_types")
    products = joined_values(members, key, "product_type", "products")
    out = dimension.join(usage, key, "left").join(baskets, key, "left").join(products, key, "left")
    return out.fillna(0, ["total_appearances", "years_present", "splits_present"]).fillna("", ["basket_types", "products"])


def crosstab(frame: DataFrame, index: str, columns: str, values: Sequence) -> DataFrame:
    """Pivoted counts with explicit column values, so Spark needs no pass to discover them."""
    return frame.groupBy(index).pivot(columns, list(values)).agg(_rows()).fillna(0)


def period_counts(frame: DataFrame) -> DataFrame:
    """Long (grain, period, member, rows): year, quarter, year by product, year by basket type."""
    year = F.col("requested_year").cast("string")
    cells = F.explode(
        F.array(
            F.struct(F.lit("year").alias("grain"), year.alias("period"), F.lit("all").alias("category")),
            F.struct(F.lit("quarter").alias("grain"), F.col("requested_quarter").alias("period"), F.lit("all").alias("category")),
            F.struct(F.lit("year_product").alias("grain"), year.alias("period"), F.col("product_type").alias("category")),
            F.struct(F.lit("year_basket").alias("grain"), year.alias("period"), F.col("basket_type").alias("category")),
        )
    )
    return frame.select(cells.alias("_c")).groupBy("_c.grain", "_c.period", "_c.category").agg(_rows().alias("row_count"))


def executed_counts(quotes: DataFrame) -> DataFrame:
    return quotes.groupBy("executed").agg(_rows().alias("row_count"))


def value_counts(frame: DataFrame) -> DataFrame:
    """Rows per product, basket type and member, most frequent first."""
    per_quote = long_text(frame, [], ["product_type", "basket_type"])
    per_member = long_text(explode_basket(frame), [], ["underlying"])
    return (
        per_quote.unionByName(per_member)
        .groupBy("feature", "value")
        .agg(_rows().alias("row_count"))
        .orderBy("feature", F.desc("row_count"), "value")
    )


def count_share_text(frame: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """``value: n (p%)`` in count order, joined by semicolons; one entry per category."""
    counts = frame.groupBy(*keys, column).agg(_rows().alias("n"))
    return _share_text(share_in_group(counts, keys, "n"), keys, column, name)


def _share_text(shares: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    value = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    shown = F.format_number(F.round(F.col("share") * 100, 2), 1)
    text = F.concat(value, F.lit(": "), F.col("n").cast("string"), F.lit(" ("), shown, F.lit("%)"))
    entry = F.struct((-F.col("n")).alias("c"), value.alias("v"), text.alias("t"))
    listed = F.sort_array(F.collect_list(entry))
    return shares.groupBy(*keys).agg(
        F.array_join(F.transform(listed, lambda e: e["t"]), "; ").alias(name)
    )


def rolling_audit(frame: DataFrame, years: S.SplitYears | None) -> DataFrame:
    """Per expanding fold: sizes, mixes, and products or members missing on either side.

    Quotes are first counted per (year, value); folds multiply only those small counts.
    """
    folds = fold_map(frame, years).withColumn("fold", fold_text(F.col("train_end_year"), F.col("validation_year")))
    key = ["fold"]
    dated = frame.withColumn("year", F.year("requested_date"))
    members = explode_basket(dated, "year").select("year", F.col("underlying").alias("value"))
    year_rows = dated.groupBy("year").agg(_rows().alias("n"))
    validation, train = F.col("role") == "validation", F.col("role") == "train"

    sizes = folds.join(year_rows, "year").groupBy("fold", "validation_year").agg(
        fn.year_range_text(F.min(F.when(train, F.col("year"))), F.max(F.when(train, F.col("year")))).alias("train_years"),
        F.sum(F.when(train, F.col("n")).otherwise(0)).alias("train_rows"),
        F.sum(F.when(validation, F.col("n")).otherwise(0)).alias("validation_rows"),
    )

    # The list of folds is as long as the calendar, so it travels as one scalar.
    fold_list = folds.agg(F.collect_set(F.struct("fold", "validation_year"))).scalar()

    def seen(source: DataFrame) -> DataFrame:
        """(fold, value, in_train, in_validation) for every value of the whole frame."""
        per_value = source.where("value is not null").groupBy("value").agg(F.collect_set("year").alias("_years"))
        each = per_value.select("value", "_years", F.explode(fold_list).alias("_f")).select(
            "value", "_years", "_f.fold", "_f.validation_year"
        )
        return each.select(
            "fold",
            "value",
            F.exists("_years", lambda y: y < F.col("validation_year")).alias("in_train"),
            F.array_contains("_years", F.col("validation_year")).alias("in_validation"),
        )

    products = seen(dated.select("year", F.col("product_type").alias("value")))
    member_sets = seen(members)

    def mix(column: str, name: str) -> DataFrame:
        rows = folds.where(validation).join(
            dated.groupBy("year", column).agg(_rows().alias("n")), "year"
        )
        return _share_text(share_in_group(rows.select("fold", column, "n"), key, "n"), key, column, name)

    def listed(source: DataFrame, condition: Column, name: str) -> DataFrame:
        return joined_values(source.where(condition), key, "value", name)

    unseen = F.col("in_validation") & ~F.col("in_train")
    absent = ~F.col("in_validation")
    parts = [
        mix("product_type", "validation_product_distribution"),
        mix("basket_type", "validation_basket_distribution"),
        member_sets.groupBy("fold").agg(F.count_if(F.col("in_validation")).alias("validation_underlyings")),
        listed(products, unseen, "unseen_products_in_validation"),
        listed(member_sets, unseen, "unseen_underlyings_in_validation"),
        listed(products, absent, "products_absent_from_validation"),
        listed(member_sets, absent, "underlyings_absent_from_validation"),
    ]
    out = reduce(lambda a, b: a.join(b, "fold", "left"), parts, sizes)
    return out.fillna(
        "",
        [
            "unseen_products_in_validation",
            "unseen_underlyings_in_validation",
            "products_absent_from_validation",
            "underlyings_absent_from_validation",
        ],
    )


def segment_viability(frame: DataFrame) -> DataFrame:
    """Six checks per basket type and the recommendation they lead to."""
    key, rules = ["basket_type"], S.SEGMENT_RULES
    members = explode_basket(frame, "basket_type", "split")
    grouped = frame.groupBy(*key).agg(
        _rows().alias("total_rows"),
        F.count_if(F.col("split") == "train").alias("train_rows"),
        F.count_if(F.col("split") == "validation").alias("validation_rows"),
        F.count_distinct("requested_year").alias("_years"),
        fn.year_range_text(F.min("requested_year"), F.max("requested_year")).alias("years_present"),
        F.count_distinct("product_type").alias("_products"),
        *target_stats(),
    )
    presence = members.groupBy("basket_type", "underlying").agg(
        F.bool_or(F.col("split") == "train").alias("in_train"),
        F.bool_or(F.col("split") == "validation").alias("in_validation"),
    )
    gap = F.col("in_validation") & ~F.col("in_train")
    cover = presence.groupBy(*key).agg(_rows().alias("underlyings_present"), F.count_if(gap).alias("_missing"))
    out = with_median(frame, grouped, key)
    for part in (
        joined_values(frame, key, "product_type", "products_present"),
        cover,
        joined_values(presence.where(gap), key, "underlying", "missing_validation_underlyings_in_train"),
    ):
        out = null_safe_join(out, part, key, "left")
    checks = [
        F.col("train_rows") >= rules["train_rows"],
        F.col("validation_rows") >= rules["validation_rows"],
        F.col("_years") >= rules["years"],
        F.col("_products") >= rules["products"],
        F.coalesce("underlyings_present", F.lit(0)) >= rules["members"],
        F.coalesce("_missing", F.lit(0)) == 0,
    ]
    passed = reduce(lambda a, b: a + b, [check.cast("int") for check in checks])
    return (
        out.withColumn("viability_checks_passed", passed)
        .withColumn("viability_checks_total", F.lit(len(checks)))
        .withColumn("is_viable_for_segment_model", F.col("viability_checks_passed") == len(checks))
        .withColumn(
            "recommendation",
            F.when(F.col("is_viable_for_segment_model"), "viable_to_test").otherwise("keep_global_or_compare_carefully"),
        )
        .withColumn("underlyings_present", F.coalesce("underlyings_present", F.lit(0)))
        .withColumn("missing_validation_underlyings_in_train", F.coalesce("missing_validation_underlyings_in_train", F.lit("")))
        .withColumnRenamed("basket_type", "segment")
        .drop("_years", "_products", "_missing")
    )


def product_viability(frame: DataFrame) -> DataFrame:
    key, rules = ["product_type"], S.SEGMENT_RULES
    grouped = frame.groupBy(*key).agg(
        _rows().alias("total_rows"),
        F.count_if(F.col("split") == "train").alias("train_rows"),
        F.count_if(F.col("split") == "validation").alias("validation_rows"),
        F.count_distinct("requested_year").alias("years_present"),
    )
    named = joined_values(frame, key, "basket_type", "basket_types")
    viable = (
        (F.col("train_rows") >= rules["train_rows"])
        & (F.col("validation_rows") >= rules["validation_rows"])
        & (F.col("years_present") >= rules["years"])
    )
    return null_safe_join(grouped, named, key, "left").withColumn("is_viable_for_product_model", viable)


def split_findings(frame: DataFrame, years: S.SplitYears | None) -> DataFrame:
    """Rule conclusions as rows (rule, observed, threshold, passed)."""
    total = _grand_total(frame)

    def top_share(column: str, rule: str) -> DataFrame:
        most = frame.groupBy(column).agg(_rows().alias("n")).agg(F.max("n").alias("n"))
        observed = F.try_divide(F.col("n").cast("double"), total.cast("double"))
        limit = S.CONCENTRATION_LIMITS[rule]
        return most.select(F.lit(rule).alias("rule"), observed.alias("observed"), F.lit(limit).alias("threshold"), (observed <= limit).alias("passed"))

    members = explode_basket(frame, "split").select("split", "underlying").distinct()
    everyone = members.select("underlying").distinct().agg(_rows().alias("n")).scalar()
    missing = members.groupBy("split").agg(_rows().alias("n")).select(
        F.concat(F.lit("missing_members_"), F.col("split")).alias("rule"),
        (everyone - F.col("n")).cast("double").alias("observed"),
        F.lit(0.0).alias("threshold"),
        (everyone == F.col("n")).alias("passed"),
    )
    folds = fold_map(frame, years).select("validation_year").distinct().agg(_rows().alias("n")).select(
        F.lit("rolling_folds").alias("rule"), F.col("n").cast("double").alias("observed"),
        F.lit(1.0).alias("threshold"), (F.col("n") >= 1).alias("passed"),
    )
    segments = segment_viability(frame).select(
        F.concat(F.lit("segment_viable_"), F.col("segment")).alias("rule"),
        F.col("viability_checks_passed").cast("double").alias("observed"),
        F.col("viability_checks_total").cast("double").alias("threshold"),
        F.col("is_viable_for_segment_model").alias("passed"),
    )
    products = product_viability(frame).agg(
        F.count_if("is_viable_for_product_model").cast("double").alias("ok"), _rows().cast("double").alias("n")
    ).select(
        F.lit("viable_products").alias("rule"), F.col("ok").alias("observed"), F.col("n").alias("threshold"),
        (F.col("ok") == F.col("n")).alias("passed"),
    )
    parts = [top_share("product_type", "top_product_share"), top_share("requested_year", "top_year_share"), missing, folds, segments, products]
    return reduce(DataFrame.unionByName, parts)


# --------------------------------------------------------------------------------------
# Exploration
# --------------------------------------------------------------------------------------


def monthly_target(frame: DataFrame) -> DataFrame:
    return frame.groupBy(fn.month_text(F.col("requested_date")).alias("requested_month")).agg(
        F.avg(S.TARGET).alias("avg_duration_months")
    )


def monthly_series(series: DataFrame) -> DataFrame:
    return series.groupBy(F.trunc("date", "MM").alias("date"), "underlying").agg(
        F.avg("realized_vol_63d").alias("realized_vol_63d")
    )


def reference_usage(frame: DataFrame, dimension: DataFrame) -> DataFrame:
    usage = explode_basket(frame, S.TARGET).groupBy("underlying").agg(
        _rows().alias("rfq_mentions"), F.avg(S.TARGET).alias("target_mean")
    )
    return dimension.join(usage, "underlying", "left").fillna(0, ["rfq_mentions"])


def maturity_excess(quotes: DataFrame) -> DataFrame:
    """Rows whose target outlasts the contract by more than each threshold."""
    excess = F.col(S.TARGET) - fn.month_diff(F.col("start_date"), F.col("end_date"))
    known = quotes.where(F.col(S.TARGET).isNotNull())
    counts = known.agg(
        _rows().alias("_all"), *[F.count_if(excess > t).alias(f"t{i}") for i, t in enumerate(S.EXCESS_THRESHOLDS)]
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(t).alias("threshold_months"), F.col(f"t{i}").alias("row_count"))
                for i, t in enumerate(S.EXCESS_THRESHOLDS)
            ]
        )
    )
    out = counts.select("_all", rows.alias("_r")).select("_all", "_r.*")
    return out.withColumn("percent", percent(F.col("row_count"), F.col("_all"))).drop("_all")


def eda_summary(quotes: DataFrame, frame: DataFrame) -> DataFrame:
    """One row of headline figures: all quotes, supervised rows and development rows."""
    development = F.col("split").isin("train", "validation")
    target = F.when(development, F.col(S.TARGET))
    everything = quotes.agg(
        _rows().alias("rfq_rows"),
        F.min("requested_date").alias("date_min"),
        F.max("requested_date").alias("date_max"),
        F.count_if(F.col(S.TARGET).isNull()).alias("target_missing_rows"),
    )
    kept = frame.agg(
        _rows().alias("trainable_rows"),
        F.count_if(development).alias("development_rows"),
        F.count_distinct("requested_year").alias("years"),
        F.count_distinct("product_type").alias("product_types"),
        F.count_distinct("basket_type").alias("basket_types"),
        F.avg(target).alias("target_mean"),
        F.stddev_samp(target).alias("target_std"),
    )
    middle = exact_quantiles(frame.where(development), [], S.TARGET, {"target_median": 0.5})
    out = everything.withColumn("_one", F.lit(1))
    for part in (kept, middle):
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def profile_columns(frame: DataFrame, table: str) -> DataFrame:
    """Per column: rows, nulls, distinct values, min, max, mean and quartiles, all exact (``sketches`` has the cheap form).

    Columns are unpivoted to text once; figures of numeric columns come from the cast value.
    """
    long = long_text(frame, [], frame.columns)
    number = F.when(F.col("feature").isin(*numeric_columns(frame)), F.col("value").try_cast("double"))
    plain = long.groupBy("feature").agg(
        F.lit(table).alias("table"),
        _rows().alias("row_count"),
        F.count_if(F.col("value").isNull()).alias("null_rows"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        F.avg(number).alias("mean"),
    )
    # One row per value, whatever its number of rows: the count of a column's values is then a plain count.
    distinct = ordered.value_counts(long, ["feature"], "value").groupBy("feature").agg(_rows().alias("distinct_values"))
    quartiles = exact_quantiles(long.select("feature", number.alias("number")), ["feature"], "number", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    joined = plain.join(distinct, "feature", "left").join(quartiles, "feature", "left")
    return joined.withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0).cast("bigint"))).withColumnRenamed("feature", "column")
