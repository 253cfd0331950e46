"""One set of formulas for two back ends: NumPy arrays on the driver and Spark columns in plans."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F


class Arrays:
    """NumPy back end."""

    exp, log, log1p, sqrt, abs = np.exp, np.log, np.log1p, np.sqrt, np.abs
    where, maximum, minimum = np.where, np.maximum, np.minimum

    @staticmethod
    def lit(x):
        return x


class Columns:
    """Spark back end; expressions stay inside generated code."""

    exp, log, log1p, sqrt, abs = F.exp, F.log, F.log1p, F.sqrt, F.abs

    @staticmethod
    def lit(x):
        return F.lit(float(x))

    @staticmethod
    def where(condition, yes, no):
        yes, no = (F.lit(float(v)) if isinstance(v, int | float) else v for v in (yes, no))
        return F.when(condition, yes).otherwise(no)

    @staticmethod
    def maximum(a, b):
        return F.greatest(a, F.lit(float(b)) if isinstance(b, int | float) else b)

    @staticmethod
    def minimum(a, b):
        return F.least(a, F.lit(float(b)) if isinstance(b, int | float) else b)


#: Fixed values of a rational approximation of the complementary error function (absolute error below 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x, xp=Arrays):
    """Complementary error function to 1.2e-7 in both back ends (Spark has no erf)."""
    z = xp.abs(x)
    t = 1.0 / (1.0 + 0.5 * z)
    poly = ERFC[-1]
    for c in reversed(ERFC[:-1]):
        poly = c + t * poly
    tail = t * xp.exp(-1.0 * z * z + poly)
    return xp.where(x >= 0, tail, 2.0 - tail)


def normal_cdf(x, xp=Arrays):
    return 0.5 * erfc(-1.0 * x / math.sqrt(2), xp)


def normal_pdf(x, xp=Arrays):
    return xp.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def erfc_sql(x: str) -> str:
    """The same approximation as SQL text over expression ``x``."""
    t = f"(1.0e0/(1.0e0+0.5e0*abs({x})))"
    poly = f"({ERFC[-1]}e0)"
    for c in reversed(ERFC[:-1]):
        poly = f"(({c}e0)+{t}*{poly})"
    tail = f"({t}*exp(-(({x})*({x}))+{poly}))"
    return f"(CASE WHEN {x} >= 0 THEN {tail} ELSE 2.0e0-{tail} END)"
