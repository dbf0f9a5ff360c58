"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 2) -> Column:
    """Rounds half away from zero on the decimal value, as SQL numeric does."""
    return F.round(x.cast("decimal(38,10)"), places).cast("double")


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    return half_up(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), places)


def month(ts: str) -> Column:
    return F.to_date(F.date_trunc("MONTH", F.col(ts)))


def week(ts: str) -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("WEEK", F.col(ts)))


def version_key(column: str) -> Column:
    """Sorts 4.9 before 4.10."""
    return F.transform(F.split(column, "[.]"), lambda x: x.cast("int"))


def digamma(x: Column) -> Column:
    """Derivative of the logarithm of the gamma function for x > 0: six steps of its recurrence, then the asymptotic series."""
    y = x + 6
    series = F.ln(y) - 1 / (2 * y) - 1 / (12 * F.pow(y, 2)) + 1 / (120 * F.pow(y, 4)) - 1 / (252 * F.pow(y, 6))
    for k in range(6):
        series = series - 1 / (x + k)
    return series


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: eight steps of its recurrence, then Stirling's series."""
    y = x + 8
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7)) + 1 / (1188 * F.pow(y, 9))
    for k in range(8):
        series = series - F.ln(x + k)
    return series


def gamma_upper(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function; 1 for x <= 0, null for a <= 0 otherwise.

    Below a + 1 the power series of the lower tail, above it the continued fraction (Lentz); both need some
    multiples of sqrt(a) steps, and a row takes only its own number of them.
    """
    a, x = a.cast("double"), x.cast("double")
    front = F.exp(a * F.ln(x) - x - ln_gamma(a))
    steps = F.sequence(F.lit(1), F.ceil(100 + 12 * F.sqrt(a)).cast("int"))
    series = F.aggregate(
        steps,
        F.struct((1 / a).alias("term"), (1 / a).alias("total")),
        lambda s, k: F.struct((s["term"] * x / (a + k)).alias("term"), (s["total"] + s["term"] * x / (a + k)).alias("total")),
        lambda s: s["total"],
    )

    def lentz(s: Column, k: Column) -> Column:
        step, b = -k * (k - a), x + 1 - a + 2 * k
        d, c = 1 / (step * s["d"] + b), b + step / s["c"]
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    start = 1 / (x + 1 - a)
    fraction = F.aggregate(steps, F.struct(F.lit(1e300).alias("c"), start.alias("d"), start.alias("h")), lentz, lambda s: s["h"])
    return F.when(x <= 0, 1.0).when(a <= 0, F.lit(None)).when(x < a + 1, F.greatest(F.lit(0.0), 1 - front * series)).otherwise(F.when(x.isNotNull() & a.isNotNull(), front * fraction))


def normal_upper(z: Column | str) -> Column:
    """Upper tail of the standard normal."""
    z = (F.col(z) if isinstance(z, str) else z).cast("double")
    far = gamma_upper(F.lit(0.5), z * z / 2) / 2
    return F.when(z >= 0, far).otherwise(1 - far)


def chi_square_upper(chi2: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution; 1 where the statistic is 0."""
    return gamma_upper(dof / 2, chi2 / 2)
