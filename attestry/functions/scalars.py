"""Expressions shared by the operators; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash32(*parts) -> Column:
    """A 32-bit number from md5 of the parts joined by colons: the same in every engine and partitioning."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def recode(column: Column, codes: dict) -> Column:
    """Codes to labels; unlisted codes and null become null."""
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), column)


def is_missing(name: str, zero_is_missing: bool = False) -> Column:
    null = F.col(name).isNull()
    return null | F.coalesce(F.col(name) == 0, F.lit(False)) if zero_is_missing else null


def one_hot(name: str, levels: list[str]) -> list[Column]:
    """All levels as doubles; a null is zero in each."""
    return [F.coalesce((F.col(name) == v).cast("double"), F.lit(0.0)).alias(f"{name}_{v}") for v in levels]


def normalise(column: Column) -> Column:
    """Null and empty alike; lists by semicolon in sorted order."""
    return F.array_join(F.array_sort(F.split(F.coalesce(column, F.lit("")), ";")), ";")


def one_hot_seen(train: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """values with name_<level> columns for the levels seen in train, in order; a level that is new, or null, is zero in each.

    Levels of a category are few by contract, so they are read to the driver.
    """
    levels = [r[0] for r in train.where(F.col(name).isNotNull()).select(name).distinct().orderBy(name).collect()]
    return values.select("*", *one_hot(name, levels))


def clip_logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.ln(q / (1 - q))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(F.lit(0.0), x) + F.log1p(F.exp(-F.abs(x)))


def log_factorial(n: Column) -> Column:
    """ln n! for whole n >= 0: the sum for small n, Stirling's series from 20 on, right to 1e-13 of it."""
    x = n.cast("double")
    far = (x + 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    near = F.element_at(F.array(*[F.lit(math.lgamma(k + 1)) for k in range(20)]), F.least(n + 1, F.lit(20)).cast("int"))
    return F.when(n < 20, near).otherwise(far)


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def binomial_quantile(q: float, n: int, p: float) -> int:
    total = 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if total >= q - 1e-12:
            return k
    return n
