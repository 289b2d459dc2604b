"""p-values of result rows, a batch at a time (Spark SQL has neither erf nor lgamma)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES, WEIGHTS = np.polynomial.legendre.leggauss(128)


def _each(f, x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(f, x), float, len(x))


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * _each(math.erfc, -z / math.sqrt(2.0))


def student_two_sided(t, df) -> np.ndarray:
    """P(|T| > t): normal above 200 degrees of freedom, else the integral of the density; 1 for missing figures.

    With u = sqrt(df) tan(a) the tail becomes a smooth integral of cos(a)^(df-1) over a
    finite range, which Gauss-Legendre quadrature solves to full precision.
    """
    t, df = np.broadcast_arrays(np.abs(np.atleast_1d(np.asarray(t, float))), np.trunc(np.atleast_1d(np.asarray(df, float))))
    out = np.ones(t.shape)
    known = (df > 0) & (t >= 1e-10)
    wide = known & (df > 200)
    out[wide] = 2.0 * (1.0 - normal_cdf(t[wide]))
    near = known & (df <= 200)
    if near.any():
        x, n = t[near], df[near]
        lo, hi = np.arctan(x / np.sqrt(n)), math.pi / 2
        angles = ((hi - lo) / 2)[:, None] * NODES + ((hi + lo) / 2)[:, None]
        area = (hi - lo) / 2 * (WEIGHTS * np.cos(angles) ** (n - 1)[:, None]).sum(axis=1)
        log_c = _each(math.lgamma, (n + 1) / 2) - _each(math.lgamma, n / 2) - 0.5 * math.log(math.pi)
        out[near] = np.clip(2.0 * np.exp(log_c) * area, 0.0, 1.0)
    return out


def chi_square_upper(chi2, df) -> np.ndarray:
    """Cube-root normal approximation of P(X > chi2); 1 for missing figures."""
    chi2, df = np.broadcast_arrays(np.atleast_1d(np.asarray(chi2, float)), np.trunc(np.atleast_1d(np.asarray(df, float))))
    out = np.ones(chi2.shape)
    known = (df > 0) & ~np.isnan(chi2)
    h = 2.0 / (9.0 * df[known])
    z = (np.cbrt(chi2[known] / df[known]) - (1.0 - h)) / np.sqrt(h)
    out[known] = np.clip(1.0 - normal_cdf(z), 0.0, 1.0)
    return out


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_two_sided(t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan)))


@F.pandas_udf(T.DoubleType())
def chi2_p_value(chi2: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi_square_upper(chi2.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan)))
