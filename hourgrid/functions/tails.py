"""Two-sided tail probabilities for result rows (Spark has no erf or incomplete beta).

These run on one row per test, after all aggregation, as Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|)."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0))).astype("float64")


def _t_tail(t: float, dof: float) -> float:
    """Two-sided Student tail by integrating the density over the angle t = sqrt(dof) tan(theta)."""
    if dof < 1:
        return float("nan")
    theta = math.atan(abs(t) / math.sqrt(dof))
    norm = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi)
    nodes, weights = np.polynomial.legendre.leggauss(200)
    half = (math.pi / 2 - theta) / 2
    x = theta + half * (nodes + 1)
    return float(min(1.0, 2 * norm * half * np.sum(weights * np.cos(x) ** (dof - 1))))


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(a) or pd.isna(b) else _t_tail(float(a), float(b)) for a, b in zip(t, dof)], dtype="float64"
    )
