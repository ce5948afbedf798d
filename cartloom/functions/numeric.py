"""Column helpers for the arithmetic the reports share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
DAYS_PER_MONTH = 30.44


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: Column | str) -> Column:
    return col(c).cast("double")


def round_even(c: Column | str, digits: int) -> Column:
    """Half-even rounding of the scaled double (Spark's ``round`` is half-up)."""
    scale = float(10**digits)
    return F.rint(dbl(c) * F.lit(scale)) / F.lit(scale)


def ratio(num: Column | str, den: Column | str) -> Column:
    """Double division; a zero or null denominator gives null."""
    return F.try_divide(dbl(num), dbl(den))


def pct(num: Column | str, den: Column | str, digits: int = 4) -> Column:
    return round_even(ratio(num, den) * F.lit(100.0), digits)


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0))


def total(c: Column | str) -> Column:
    """Sum that is 0, not null, when there is nothing to add."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def flag_count(condition: Column) -> Column:
    """Number of rows where the condition holds (null counts as false)."""
    return F.count(F.when(condition, F.lit(1)))


def whole_days(later: Column | str, earlier: Column | str) -> Column:
    """Elapsed whole days, floored; not a count of midnights."""
    micros = F.unix_micros(col(later)) - F.unix_micros(col(earlier))
    return F.floor(micros / F.lit(float(MICROS_PER_DAY))).cast("bigint")


def stamp_text(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss")


def right_closed_band(c: Column | str, edges: list[float], labels: list[str]) -> Column:
    """Label of the interval (edge[i], edge[i+1]] holding the value, else null."""
    value = dbl(c)
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels))):
        inside = value > F.lit(float(low))
        if not math.isinf(high):
            inside = inside & (value <= F.lit(float(high)))
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def normal_cdf(z: Column | str) -> Column:
    """Standard normal distribution function.

    Error function by formula 7.1.26 of Abramowitz and Stegun (absolute
    error below 1.5e-7); its coefficients are fixed values.
    """
    x = dbl(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * F.abs(x))
    poly = F.lit(0.0)
    for a in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = (poly + F.lit(a)) * t
    erf = F.signum(x) * (F.lit(1.0) - poly * F.exp(-x * x))
    return F.lit(0.5) * (F.lit(1.0) + erf)
