"""Numeric expressions shared by scoring and evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """The value as DOUBLE, or NULL for NaN and infinities."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def clamp_finite(c: str | Column, limit: float | None = None) -> Column:
    """NaN and NULL become 0; infinities become 0, or +-limit when one is given."""
    x = col(c).cast("double")
    if limit is None:
        return F.coalesce(finite(x), F.lit(0.0))
    bounded = F.greatest(F.least(x, F.lit(float(limit))), F.lit(-float(limit)))
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(bounded)


def sigmoid(c: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-finite(c)))


def mean_of(*columns: str | Column) -> Column:
    """Mean over the non-NULL arguments, NULL when there are none."""
    cs = [col(c) for c in columns]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0))
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cs), F.lit(0))
    return F.when(n > 0, total / n)


def neg_log10(p: str | Column, floor: float = 1e-300) -> Column:
    x = col(p)  # greatest and least pass over NULL, so a missing p-value is kept apart
    return F.when(x.isNotNull(), -F.log10(F.least(F.greatest(x, F.lit(floor)), F.lit(1.0))))


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Round for reports.

    Half-way cases of already short decimals are nudged upwards, so that they do not depend on
    the last bit of a sum; adding 0 turns -0.0 into 0.0.
    """
    nudge = 1.234 * 10.0 ** -(digits + 5) if digits >= 6 else 0.0
    return F.round(col(c) + F.lit(nudge), digits) + F.lit(0.0)


def _log_choose(n: Column, k: Column) -> Column:
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(
        steps, F.lit(0.0), lambda acc, i: acc + F.log((n - i + 1).cast("double") / i.cast("double"))
    )


def hypergeom_sf(overlap: Column, population: Column, truth: Column, draws: Column) -> Column:
    """P(X >= overlap) for ``draws`` draws without replacement.

    The first probability comes from logs of binomials; the rest follow by the ratio of
    neighbouring terms, summed in log space so that neither tail underflows. Work per row
    is linear in the number of draws.
    """
    m, n, d = (c.cast("bigint") for c in (population, truth, draws))
    low = F.greatest(overlap.cast("bigint"), d - (m - n), F.lit(0).cast("bigint"))
    high = F.least(n, d)
    first = _log_choose(n, low) + _log_choose(m - n, d - low) - _log_choose(m, d)
    later = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))

    def step(acc: Column, j: Column) -> Column:
        ratio = ((n - j) * (d - j)).cast("double") / ((j + 1) * (m - n - d + j + 1)).cast("double")
        term = acc["term"] + F.log(ratio)
        top = F.greatest(acc["total"], term)
        total = top + F.log1p(F.exp(F.least(acc["total"], term) - top))
        return F.struct(term.alias("term"), total.alias("total"))

    start = F.struct(first.alias("term"), first.alias("total"))
    log_p = F.aggregate(later, start, step, lambda acc: acc["total"])
    return (
        F.when((m <= 0) | (n <= 0) | (d <= 0), F.lit(None).cast("double"))
        .when(overlap <= 0, F.lit(1.0))
        .when(low > high, F.lit(0.0))
        .otherwise(F.least(F.exp(log_p), F.lit(1.0)))
    )
