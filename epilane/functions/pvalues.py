"""Two-sided p-values: the normal tail as a column, Student's t as an Arrow-batched
function. Spark has neither distribution."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

DEGREE = 30
MOST_TERMS = 100_000


def log_gamma(z: np.ndarray) -> np.ndarray:
    """Log gamma for positive arguments: Stirling's series above a shift of 10."""
    shift = np.zeros_like(z)
    w = z.copy()
    for _ in range(10):
        small = w < 10.0
        shift = np.where(small, shift + np.log(np.where(small, w, 1.0)), shift)
        w = np.where(small, w + 1.0, w)
    inv = 1.0 / w
    square = inv * inv
    series = inv * (
        1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188)))
    )
    return (w - 0.5) * np.log(w) - w + 0.5 * np.log(2 * np.pi) + series - shift


def _incomplete_beta(x: np.ndarray, a: np.ndarray, b: float) -> np.ndarray:
    """Regularised incomplete beta function by a modified Lentz continued fraction."""
    both = np.full_like(a, b)
    front = np.exp(
        log_gamma(a + b) - log_gamma(a) - log_gamma(both) + a * np.log(x) + b * np.log1p(-x)
    )
    swap = x >= (a + 1.0) / (a + b + 2.0)
    first, second = np.where(swap, b, a), np.where(swap, a, b)
    at = np.where(swap, 1.0 - x, x)

    tiny = 1e-300

    def nonzero(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    total = np.zeros_like(at)
    live = np.arange(len(at))  # values whose fraction still changes
    p, q, z = first, second, at
    c = np.ones_like(z)
    d = 1.0 / nonzero(1.0 - (p + q) * z / (p + 1.0))
    h = d.copy()
    m = 0
    while len(live):
        m += 1
        if m > MOST_TERMS:
            raise ArithmeticError("the continued fraction does not converge")
        even = m * (q - m) * z / ((p + 2 * m - 1.0) * (p + 2 * m))
        d = 1.0 / nonzero(1.0 + even * d)
        c = nonzero(1.0 + even / c)
        h = h * d * c
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1.0))
        d = 1.0 / nonzero(1.0 + odd * d)
        c = nonzero(1.0 + odd / c)
        step = d * c
        h = h * step
        open_ = np.abs(step - 1.0) >= 1e-15
        if not open_.all():
            total[live[~open_]] = h[~open_]
            live = live[open_]
            p, q, z, c, d, h = (v[open_] for v in (p, q, z, c, d, h))
    part = front * total / first
    return np.where(swap, 1.0 - part, part)


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom."""
    out = np.full(len(t), np.nan)
    tv, dv = t.to_numpy(float), df.to_numpy(float)
    ok = np.isfinite(tv) & np.isfinite(dv) & (dv > 0)
    if ok.any():
        x = dv[ok] / (dv[ok] + tv[ok] ** 2)
        inner = (x > 0) & (x < 1)
        value = np.where(x >= 1, 1.0, 0.0)
        value[inner] = _incomplete_beta(x[inner], dv[ok][inner] / 2.0, 0.5)
        out[ok] = value
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def _scaled_tail(x: float) -> float:
    """exp(x^2) erfc(x) for x >= 0."""
    if x < 5:
        return math.exp(x * x) * math.erfc(x)
    fraction = x
    for k in range(60, 0, -1):
        fraction = x + k / 2 / fraction
    return 1 / (math.sqrt(math.pi) * fraction)


def _tail_powers() -> np.ndarray:
    """Coefficients by power of y = 2t - 1 of exp(x^2) erfc(x) / t with t = 2 / (2 + x)."""
    n = DEGREE + 10
    nodes = np.cos(np.pi * (np.arange(n) + 0.5) / n)
    values = [_scaled_tail(2 * (2 / (y + 1) - 1)) / ((y + 1) / 2) for y in nodes]
    series = np.polynomial.chebyshev.chebfit(nodes, values, DEGREE)
    return np.polynomial.chebyshev.cheb2poly(series)


_POWERS = _tail_powers().tolist()


def normal_two_sided(z: Column | str) -> Column:
    """P(|Z| >= |z|) for a standard normal Z, in built-in functions; null for null or NaN."""
    z = F.col(z) if isinstance(z, str) else z
    x = F.abs(z) / F.lit(math.sqrt(2))
    t = F.lit(2.0) / (x + 2.0)
    y = 2 * t - 1
    total = F.lit(_POWERS[-1])
    for c in reversed(_POWERS[:-1]):
        total = total * y + F.lit(c)
    value = F.when(x > 40, F.lit(0.0)).otherwise(t * F.exp(-x * x) * total)
    return F.when(~F.isnan(z), F.when(z == 0, F.lit(1.0)).otherwise(value))
