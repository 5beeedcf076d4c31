"""Special functions that the tests need, without further libraries."""

from __future__ import annotations

from math import erf, erfc, exp, lgamma, log, sqrt


def norm_cdf(x: float) -> float:
    """Standard normal distribution function."""
    return 0.5 * (1 + erf(x / sqrt(2)))


def chi2_1_sf(x: float) -> float:
    """Upper tail of chi-squared with one degree of freedom."""
    return erfc(sqrt(max(x, 0.0) / 2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's recurrence."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 300):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + numerator / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_sf(t: float, df: float) -> float:
    """Upper tail of Student's t."""
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def kolmogorov_sf(d: float, n: int) -> float:
    """Asymptotic upper tail of the Kolmogorov-Smirnov distance for n points, with Stephens' correction."""
    x = d * (sqrt(n) + 0.12 + 0.11 / sqrt(n))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * exp(-2 * k * k * x * x) for k in range(1, 101))))
