"""Two-sided p-value of Student's t, for the few summary rows of a test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_gamma_ratio(a: float) -> float:
    """log of gamma(a + 1/2) / gamma(a), without the cancellation of two large logarithms.

    The recurrence moves the argument up, where the series needs few terms.
    """
    steps = 32
    low = math.fsum(math.log1p(0.5 / (a + i)) for i in range(steps))
    c = a + steps
    series = -1.0 / (8.0 * c) + 1.0 / (192.0 * c**3) - 1.0 / (640.0 * c**5) + 17.0 / (14336.0 * c**7)
    return 0.5 * math.log(c) + series - low


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(32)


def _log_cosh(w: np.ndarray) -> np.ndarray:
    return np.log1p(2.0 * np.sinh(w / 2.0) ** 2)


def two_sided_p(t: float, df: float) -> float | None:
    """P(|T| >= |t|) for ``df`` degrees of freedom; None where undefined."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return None
    if math.isinf(t):
        return 0.0
    # With x = sqrt(df) sinh(w) the tail is the integral of cosh(w)^-df, which is summed in units of
    # its decay, by Gauss-Legendre panels, until nothing is added.
    start = math.asinh(abs(t) / math.sqrt(df))
    unit = 1.0 / max(math.sqrt(df), df * math.tanh(start))
    level = float(_log_cosh(np.array(start)))
    total, panel = 0.0, 0
    while True:
        w = start + unit * (panel + (1.0 + _NODES) / 2.0)
        part = float(_WEIGHTS @ np.exp(-df * (_log_cosh(w) - level))) / 2.0
        total += part
        if part <= 1e-18 * total:
            break
        panel += 1
    log_front = _log_gamma_ratio(df / 2.0) - math.lgamma(0.5) - df * level + math.log(2.0 * unit)
    return min(1.0, math.exp(log_front) * total)


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([two_sided_p(a, b) for a, b in zip(t, df)], dtype="float64")
