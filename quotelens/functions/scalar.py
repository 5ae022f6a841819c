"""Scalar, string, date and array expressions used across the plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelens import schema as S

__all__ = [
    "average_rank",
    "basket_signature",
    "clip_to_contract",
    "drift_status",
    "duration_bucket",
    "finite",
    "frequency_label",
    "general_text",
    "frequency_months",
    "join_sorted",
    "maturity_bucket",
    "member_indicator",
    "month_diff",
    "month_text",
    "null_if_not_finite",
    "pair_indicator",
    "parse_basket",
    "parse_boolean",
    "primary_member",
    "quarter_text",
    "right_closed",
    "safe_divide",
    "segment",
    "year_range_text",
]


def _normalised(text: Column) -> Column:
    return F.lower(F.trim(text))


def parse_boolean(text: Column) -> Column:
    """Strict flag parser: null for anything outside the accepted spellings."""
    word = _normalised(text)
    return F.when(word.isin(*S.TRUE_WORDS), True).when(word.isin(*S.FALSE_WORDS), False)


def frequency_months(text: Column) -> Column:
    """Observation interval in months; null when the spelling is not in the vocabulary."""
    pairs = [F.lit(item) for pair in S.FREQUENCY_MONTHS.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), _normalised(text))


def frequency_label(months: Column) -> Column:
    daily = F.abs(months - F.lit(1.0 / 21.0)) < 1e-8
    return F.when(daily, F.lit("daily")).when(
        months.isNotNull(), F.concat(months.cast("int").cast("string"), F.lit("m"))
    )


def parse_basket(text: Column) -> Column:
    """Split on the bar, trim each part, drop empty parts; order is kept."""
    parts = F.transform(F.split(text, r"\|"), lambda part: F.trim(part))
    return F.filter(parts, lambda part: part != "")


def basket_signature(members: Column) -> Column:
    return F.array_join(F.array_sort(members), "|")


def member_indicator(members: Column, name: str) -> Column:
    return F.array_contains(members, name).cast("int")


def pair_indicator(members: Column, left: str, right: str) -> Column:
    return (F.array_contains(members, left) & F.array_contains(members, right)).cast("int")


def primary_member(members: Column) -> Column:
    return F.when(F.size(members) == 1, F.element_at(members, 1)).otherwise(F.lit("MULTI"))


def month_diff(start: Column, end: Column) -> Column:
    return F.datediff(end, start) / F.lit(S.DAYS_PER_MONTH)


def finite(value: Column) -> Column:
    # NaN sorts above infinity, so one comparison rules out both.
    return F.abs(value) < F.lit(float("inf"))


def null_if_not_finite(value: Column) -> Column:
    return F.when(finite(value), value)


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double; null for a zero denominator or a non-finite result."""
    return null_if_not_finite(F.try_divide(numerator.cast("double"), denominator.cast("double")))


def right_closed(value: Column, edges: Sequence[float], labels: Sequence[str], floor=None) -> Column:
    """Label of the first interval (a, b] that holds ``value``; the last one is open ended."""
    label = F.lit(None).cast("string") if floor is None else F.when(value <= floor, None)
    chain = F.when(value.isNull(), label) if floor is None else label.when(value.isNull(), None)
    for edge, name in zip(edges, labels):
        chain = chain.when(value <= edge, F.lit(name))
    return chain.otherwise(F.lit(labels[-1]))


def maturity_bucket(months: Column) -> Column:
    return right_closed(months, S.MATURITY_EDGES, S.MATURITY_LABELS, floor=-0.01)


def duration_bucket(months: Column, open_start: bool = False) -> Column:
    """Duration class; the closed variant leaves values at or below -0.01 unlabelled."""
    if open_start:
        return right_closed(months, S.DURATION_EDGES, S.DURATION_LABELS_OPEN)
    return right_closed(months, S.DURATION_EDGES, S.DURATION_LABELS, floor=-0.01)


def segment(basket_size: Column, basket_type: Column) -> Column:
    return (
        F.when(basket_size == 1, F.lit("single"))
        .when(basket_type == "worst_of", F.lit("worst_of"))
        .otherwise(F.lit("other"))
    )


def clip_to_contract(value: Column, lower: Column, upper: Column) -> Column:
    """Clip to [lower, upper]; the upper bound wins when the bounds cross."""
    return F.least(F.greatest(value, lower), upper)


def quarter_text(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


def month_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def year_range_text(first: Column, last: Column) -> Column:
    return (
        F.when(first.isNull(), F.lit(""))
        .when(first == last, first.cast("string"))
        .otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))
    )


def join_sorted(values: Column, total: Column, limit: int = S.MAX_JOINED_VALUES) -> Column:
    """Text list of the first ``limit`` values, followed by how many more there are."""
    head = F.array_join(F.slice(F.sort_array(values), 1, limit), ", ")
    more = F.concat(head, F.lit(" ... (+"), (total - limit).cast("string"), F.lit(")"))
    return F.when(total > limit, more).otherwise(F.coalesce(head, F.lit("")))


def average_rank(before: Column, ties: Column) -> Column:
    """Rank with ties averaged, from the number of smaller rows and the size of the tie."""
    return before + (ties + F.lit(1)) / F.lit(2.0)


def drift_status(*checks: tuple[Column, str]) -> Column:
    """``fail``/``warning``/``pass`` from (effect size, limit name) pairs; nulls never trigger."""
    warning, failure = F.lit(False), F.lit(False)
    for effect, name in checks:
        low, high = S.DRIFT_LIMITS[name]
        warning = warning | F.coalesce(F.abs(effect) >= low, F.lit(False))
        failure = failure | F.coalesce(F.abs(effect) >= high, F.lit(False))
    return F.when(failure, "fail").when(warning, "warning").otherwise("pass")


def general_text(value: Column) -> Column:
    """Number as text with six significant digits and no padding, as ``%g`` prints it."""
    magnitude = F.abs(value)
    exponent = F.floor(F.log10(magnitude))

    def trimmed(number: Column) -> Column:
        text = number.cast("decimal(30,12)").cast("string")
        return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")

    chain = F.when(value.isNull(), None).when(value == 0, F.lit("0"))
    for power in range(-4, 6):
        chain = chain.when(exponent == power, trimmed(F.round(value, 5 - power)))
    mantissa = trimmed(F.round(value / F.pow(F.lit(10.0), exponent), 5))
    sign = F.when(exponent < 0, "-").otherwise("+")
    power_text = F.lpad(F.abs(exponent).cast("string"), 2, "0")
    return chain.otherwise(F.concat(mantissa, F.lit("e"), sign, power_text))
