"""Tail probabilities as column expressions, so no statistic has to visit the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ks_sf(statistic: Column, n_left: Column, n_right: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value, 2 * sum (-1)^(k-1) exp(-2 k^2 x^2)."""
    left, right = n_left.cast("double"), n_right.cast("double")
    x = statistic * F.sqrt(left * right / (left + right))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda total, k: total
        + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2.0 * k * k * x * x),
    )
    # Below 0.2 the alternating series needs more terms than it is worth: the value is 1.
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def _log_gamma_half(dof: Column) -> Column:
    """log Gamma(dof / 2 + 1) for whole dof, built from the recurrence of Gamma."""
    odd = dof % 2 == 1
    base = F.when(odd, F.lit(math.log(math.sqrt(math.pi)))).otherwise(F.lit(0.0))
    steps = F.when(odd, (dof + 1) / 2).otherwise(dof / 2).cast("int")
    shift = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    return F.aggregate(
        F.sequence(F.lit(1), steps), base, lambda total, j: total + F.log(j - shift)
    )


def chi2_sf(statistic: Column, dof: Column) -> Column:
    """Upper tail of the chi-squared law, from the series of the lower incomplete gamma."""
    a, x = dof / F.lit(2.0), statistic / F.lit(2.0)
    terms = (x + 12 * F.sqrt(x) + 80).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(state, n):
        term = state["term"] * x / (a + n)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), terms), start, add, lambda state: state["total"])
    lower = F.exp(a * F.log(x) - x - _log_gamma_half(dof) + F.log(series))
    far = x > a + 40 * F.sqrt(a) + 300
    return (
        F.when(statistic.isNull() | dof.isNull(), None)
        .when(statistic <= 0, F.lit(1.0))
        .when(far, F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - lower))
    )
