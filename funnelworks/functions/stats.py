"""Normal-distribution helpers for the experiment tests (AB-2, AB-5...AB-7).

Quantiles are fixed literals computed once with the standard library; the tails are column expressions.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms of the series below SERIES_UP_TO, and levels of the continued fraction from there on: both then
# agree with math.erfc to about 1e-15.
SERIES_TERMS, FRACTION_LEVELS, SERIES_UP_TO = 60, 80, 2.5


def z_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _series(x: Column) -> Column:
    """1 - erf(x): exp(-x^2) 2x/sqrt(pi) times the sum of (2x^2)^n / (2n+1)!!, summed from the last term inwards."""
    nested = F.aggregate(F.sequence(F.lit(SERIES_TERMS), F.lit(1), F.lit(-1)), F.lit(1.0),
                         lambda acc, n: F.lit(1.0) + acc * 2 * x * x / (2 * n + 1))
    return 1 - F.exp(-x * x) * 2 * x / math.sqrt(math.pi) * nested


def _fraction(x: Column) -> Column:
    """exp(-x^2)/sqrt(pi) / (x + (1/2)/(x + (2/2)/(x + (3/2)/(x + ...))))."""
    below = F.aggregate(F.sequence(F.lit(FRACTION_LEVELS), F.lit(1), F.lit(-1)), F.lit(0.0),
                        lambda acc, k: k / 2 / (x + acc))
    return F.exp(-x * x) / math.sqrt(math.pi) / (x + below)


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0 (NULL stays NULL), as column expressions."""
    x = x.cast("double")
    return F.when(x < SERIES_UP_TO, _series(x)).when(x.isNotNull(), _fraction(x))


def two_sided_p(z: Column) -> Column:
    """P(|Z| >= |z|) for a standard normal Z."""
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def chi2_1df_p(stat: Column) -> Column:
    """Upper tail of a chi-square with one degree of freedom."""
    return erfc(F.sqrt(stat / F.lit(2.0)))
