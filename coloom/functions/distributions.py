"""Tail probabilities as column expressions.

Spark SQL has no error function or incomplete beta, so both are written as short
folds over a fixed range of integers and run inside the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients (g = 7, n = 9) of the log-gamma function.
LANCZOS = [
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
]


def log_gamma(x: Column) -> Column:
    """ln Γ(x) for x >= 0.5."""
    y = x - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(c) / (y + i)
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(series)


def _fraction(a: Column, b: Column, x: Column, steps: int) -> Column:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300

    def keep(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def advance(acc: Column, num: Column) -> Column:
        d = 1 / keep(1 + num * acc["d"])
        c = keep(1 + num / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    def even(i: Column) -> Column:
        return i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i))

    def odd(i: Column) -> Column:
        return -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))

    nums = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(steps)),
            lambda i: F.array(F.when(i == 0, F.lit(0.0)).otherwise(even(i)), odd(i)),
        )
    )
    d0 = 1 / keep(1 + F.element_at(nums, 2))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))
    rest = F.slice(nums, 3, 2 * steps)
    return F.aggregate(rest, start, advance, lambda acc: acc["h"])


def beta_inc(a: Column, b: Column, x: Column, steps: int = 200) -> Column:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = (c.cast("double") for c in (a, b, x))
    front = F.exp(
        log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)
    )
    direct = x < (a + 1) / (a + b + 2)
    value = F.when(direct, front * _fraction(a, b, x, steps) / a).otherwise(
        1 - front * _fraction(b, a, 1 - x, steps) / b
    )
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(value)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) of Student's t."""
    return beta_inc(df / 2, F.lit(0.5), df / (df + t * t))


def f_upper(f: Column, df1: Column, df2: Column) -> Column:
    """P(F > f)."""
    f = F.when(f < 0, F.lit(0.0)).otherwise(f)
    return beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def normal_upper(z: Column, steps: int = 160) -> Column:
    """P(Z > z) of the standard normal for z >= 0."""
    z = F.when(z > 9, F.lit(9.0)).otherwise(z.cast("double"))
    step = lambda acc, i: F.struct(
        (acc["term"] * z * z / (2 * i + 1)).alias("term"),
        (acc["sum"] + acc["term"] * z * z / (2 * i + 1)).alias("sum"),
    )
    start = F.struct(z.alias("term"), z.alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc["sum"])
    tail = 0.5 - series * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return F.when(tail < 0, F.lit(0.0)).otherwise(tail)


def stars(p: Column) -> Column:
    return (
        F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
    )
