"""Independence-test arithmetic as column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Clamps of the test statistic.
EPSILON = 1e-10


def critical_z(alpha: float) -> float:
    """|z| below this is independent at level ``alpha``."""
    if alpha <= 0.0:
        return math.inf
    return abs(NormalDist().inv_cdf(min(alpha, 1.0) / 2.0))  # the lower tail keeps its digits


def z_score(c_z: Column, c_x: Column, c_y: Column, c_xy: Column) -> Column:
    """Dependence score of four neighbourhood counts, in doubles throughout (the products overflow BIGINT)."""
    z, x, y, xy = (c.cast("double") for c in (c_z, c_x, c_y, c_xy))
    rho = (z * xy - x * y) / (z * z)
    spread = F.greatest(x * y * (z - x) * (z - y), F.lit(EPSILON))
    sigma = F.sqrt(spread / (z * z * z * z * (z - 1.0) + F.lit(EPSILON)))
    return (
        F.when(sigma > EPSILON, rho / sigma)
        .when(F.abs(rho) > EPSILON, F.signum(rho) * F.lit(float("inf")))
        .otherwise(F.lit(0.0))
    )


def independent(c_z: Column, c_x: Column, c_y: Column, c_xy: Column, alpha: float) -> Column:
    """True when the test does not reject; one or no cell left to count never separates."""
    return F.when(c_z <= 1, F.lit(False)).otherwise(
        F.abs(z_score(c_z, c_x, c_y, c_xy)) < F.lit(critical_z(alpha))
    )


@F.pandas_udf(T.DoubleType())
def rounded_exp(x: pd.Series) -> pd.Series:
    """exp as the C library rounds it: Spark's own is a last digit off for one value in ten, enough to order products that are equal."""
    return pd.Series([math.exp(v) if v < 709.0 else float(np.exp(v)) for v in x.to_numpy(dtype=float, na_value=np.nan)], x.index, float)


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """2 (1 - Phi(|z|)) = erfc(|z| / sqrt 2), whole batches at a time: Spark has no erf, and its higher-order functions
    would evaluate z anew in every term. A series of positive terms near zero, a continued fraction further out."""
    x = np.abs(z.to_numpy(dtype=float, na_value=np.nan)) / math.sqrt(2.0)
    with np.errstate(over="ignore", invalid="ignore"):
        low = np.minimum(x, 2.5)
        term = total = low
        for n in range(1, 61):
            term = term * 2.0 * low * low / (2.0 * n + 1.0)
            total = total + term
        near = 1.0 - 2.0 / math.sqrt(math.pi) * np.exp(-low * low) * total
        high = np.maximum(x, 2.5)
        fraction = high
        for k in range(60, 0, -1):
            fraction = high + k / 2.0 / fraction
        far = np.exp(-high * high) / (math.sqrt(math.pi) * fraction)
    return pd.Series(np.where(x < 2.5, near, far)).where(~np.isnan(x)).set_axis(z.index)


def effective_alpha(
    base: float,
    motif_strength: Column,
    pair_strength: Column,
    *,
    motif_alpha: float = 0.20,
    pair_alpha: float = 0.20,
    motif_min: float = 0.0,
    gamma: float = 1.0,
) -> Column:
    """Level raised by a directed prior and an undirected one; the larger wins, clipped to [0, 1]."""
    unit = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    m, p = unit(motif_strength), unit(pair_strength)
    raised = F.when((m > 0) & (m >= motif_min), base + F.pow(m, F.lit(float(gamma))) * (motif_alpha - base))
    lifted = F.when(p > 0, base + p * (pair_alpha - base))
    best = F.greatest(F.lit(float(base)), F.coalesce(raised, F.lit(float(base))), F.coalesce(lifted, F.lit(float(base))))
    return F.least(F.greatest(best, F.lit(0.0)), F.lit(1.0))
