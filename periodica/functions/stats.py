"""Student t interval of a mean, normal CRPS."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

Z = 1.959963984540054  # 97.5 % point of the normal


def t_coverage(t: float, df: int) -> float:
    """P(|T| < t) for whole degrees of freedom (finite trigonometric sum)."""
    theta = math.atan2(t, math.sqrt(df))
    c, s = math.cos(theta), math.sin(theta)
    if df == 1:
        return 2 * theta / math.pi
    term = total = c if df % 2 else 1.0
    for k in range(3 if df % 2 else 2, df - 1, 2):
        term *= c * c * (k - 1) / k
        total += term
    return 2 / math.pi * (theta + s * total) if df % 2 else s * total


def t_critical(df: int, level: float = 0.95) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_coverage(mid, df) < level else (lo, mid)
    return (lo + hi) / 2


T_TABLE = [t_critical(df) for df in range(1, 61)]


def t_point(df: Column) -> Column:
    """97.5 % point: exact to 60 degrees of freedom, then the asymptotic series."""
    z, n = Z, df.cast("double")
    series = (
        F.lit(z) + F.try_divide(F.lit((z**3 + z) / 4), n)
        + F.try_divide(F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96), n * n)
        + F.try_divide(F.lit((3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384), n * n * n)
    )
    table = F.array(*[F.lit(x) for x in T_TABLE])
    exact = F.try_element_at(table, df.cast("int"))
    return F.when(df < 1, None).when(df <= len(T_TABLE), exact).otherwise(series)


def t_interval(value: Column | str, min_n: int = 2) -> tuple[Column, Column]:
    """Aggregates for the lower and upper 95 % bound of a mean, null below ``min_n`` rows."""
    v = col(value)
    n = F.count(v)
    half = t_point(F.greatest(n - 1, F.lit(1))) * F.stddev_samp(v) / F.sqrt(n.cast("double"))
    return (F.when(n >= min_n, F.avg(v) - half), F.when(n >= min_n, F.avg(v) + half))


# Hart's rational approximation of the upper tail of the normal, highest power first.
_TAIL_UP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
            221.213596169931, 220.206867912376)
_TAIL_DOWN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
              637.333633378831, 793.826512519948, 440.413735824752)
_TAIL_FROM = 7.07106781186547  # a continued fraction from here on


def _horner(terms: tuple[float, ...], x: Column) -> Column:
    out = F.lit(terms[0])
    for t in terms[1:]:
        out = out * x + F.lit(t)
    return out


def normal_cdf(z: Column | str) -> Column:
    """P(N(0, 1) < z) to fourteen places, as one expression."""
    z = col(z).cast("double")
    a = F.abs(z)
    fraction = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    bell = F.exp(-a * a / 2)
    near = bell * _horner(_TAIL_UP, a) / _horner(_TAIL_DOWN, a)
    tail = F.when(a < _TAIL_FROM, near).otherwise(bell / fraction / math.sqrt(2 * math.pi))
    return F.when(z > 0, 1 - tail).otherwise(tail)


def normal_crps(actual: Column | str, mu: Column | str, sigma: Column | str) -> Column:
    """Closed-form CRPS of N(mu, sigma); null where sigma is not positive."""
    actual, mu, sigma = (col(c).cast("double") for c in (actual, mu, sigma))
    z = (actual - mu) / F.when(sigma > 0, sigma)
    pdf = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return sigma * (z * (2 * normal_cdf(z) - 1) + 2 * pdf - 1 / math.sqrt(math.pi))


def normal_cdf_sql(z: str) -> str:
    """The same in SQL."""
    def horner(terms):
        out = f"{terms[0]}::DOUBLE"
        for t in terms[1:]:
            out = f"({out}*abs({z})+{t}::DOUBLE)"
        return out

    fraction = f"(abs({z})+0.65)"
    for k in (4, 3, 2, 1):
        fraction = f"(abs({z})+{k}/{fraction})"
    bell = f"exp(-({z})*({z})/2)"
    tail = (f"CASE WHEN abs({z})<{_TAIL_FROM} THEN {bell}*{horner(_TAIL_UP)}/{horner(_TAIL_DOWN)} "
            f"ELSE {bell}/{fraction}/sqrt(2*pi()) END")
    return f"(CASE WHEN ({z})>0 THEN 1-({tail}) ELSE {tail} END)"
