"""Distribution functions for statistics on grouped counts, and their columns over small grouped tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(x: float) -> float:
    return math.erfc(-x / math.sqrt(2)) / 2


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-15 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = i * (a - i)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function; the continued fraction is taken on the side where it converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value, c, d = 1.0, 1.0, 0.0
    for step in range(100_000):
        m = step // 2
        if step == 0:
            part = 1.0
        elif step % 2:
            part = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            part = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + part * d or 1e-300)
        c = 1 + part / c or 1e-300
        value *= c * d
        if step and abs(c * d - 1) < 1e-15:
            break
    return front * (value - 1)


def solved(f, low: float, high: float) -> float:
    """Where a falling function crosses 0."""
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    return (low + high) / 2


def beta_quantile(q: float, a: float, b: float) -> float:
    return solved(lambda x: q - beta_cdf(a, b, x), 0.0, 1.0)


def gamma_quantile(q: float, shape: float, rate: float) -> float:
    high = shape + 20 + 20 * math.sqrt(shape + 1)
    return solved(lambda x: gamma_q(shape, x) - (1 - q), 0.0, high) / rate


def poisson_interval(count: int, level: float = 0.95) -> tuple[float, float]:
    """Exact interval of a Poisson mean."""
    a = (1 - level) / 2
    low = 0.0 if count == 0 else solved(lambda m: a - (1 - gamma_q(count, m)), 0, count)
    high = solved(lambda m: gamma_q(count + 1, m) - a, count, count + 20 + 10 * math.sqrt(count + 1))
    return low, high


def log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def binomial_p(k: int, n: int, p: float) -> float:
    """Exact two-sided test: the probability of all outcomes that are no likelier than ``k``, a few rounding errors aside."""
    if n == 0 or p <= 0 or p >= 1:
        return 1.0
    log_pmf = lambda i: log_choose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p)
    most = log_pmf(k) + 1e-7
    at_least = lambda i: 1.0 if i <= 0 else 0.0 if i > n else beta_cdf(i, n - i + 1, p)
    mode = min(n, int((n + 1) * p))
    if log_pmf(mode) <= most:
        return 1.0
    # the two slopes of the distribution are monotone, so the far end is found by halving
    if k < mode:
        low, high = mode, n + 1
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if log_pmf(mid) <= most else (mid, high)
        return min(1.0, 1 - at_least(k + 1) + at_least(high))
    low, high = -1, mode
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if log_pmf(mid) <= most else (low, mid)
    return min(1.0, at_least(k) + (1 - at_least(low + 1)))


def hypergeometric_tail(k: int, population: int, marked: int, drawn: int) -> float:
    """The probability of ``k`` marked or more among those drawn."""
    first = max(k, 0, drawn + marked - population)
    last = min(marked, drawn)
    if first > last:
        return 0.0
    i = np.arange(first, last, dtype=float)
    steps = np.log(marked - i) + np.log(drawn - i) - np.log(i + 1) - np.log(population - marked - drawn + i + 1)
    logs = log_choose(marked, first) + log_choose(population - marked, drawn - first) - log_choose(population, drawn) + np.concatenate(([0.0], np.cumsum(steps)))
    return min(1.0, float(np.exp(logs).sum())) if k > max(0, drawn + marked - population) else 1.0


def column(f, *args: Column) -> Column:
    """A numeric function of columns, for grouped tables that are small; null where an argument is."""
    @F.pandas_udf("double")
    def over(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([None if any(pd.isna(x) for x in row) else f(*row) for row in rows.itertuples(index=False)], dtype="float64")

    return over(F.struct(*[x.alias(f"x{k}") for k, x in enumerate(args)]))
