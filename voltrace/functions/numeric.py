"""Scalar rules that every operator shares: what is missing is NULL, guarded logarithms and divisions, rounding for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added before the logarithm of a realized variance.
LOG_EPS = 1e-12


def nan_to_null(x: Column) -> Column:
    """NaN, the sources' missing value, as NULL."""
    return F.when(~F.isnan(x), x)


def reported(x: Column, digits: int = 6) -> Column:
    """Rounded for a result table, without negative zero. Only for the outermost select."""
    return F.round(x, digits) + F.lit(0.0)


def log_vol(variance: Column) -> Column:
    """A variance on the log-volatility scale, 0.5 ln(variance); NULL unless positive."""
    return F.when(variance > 0, 0.5 * F.ln(variance))


def log_variance(x: Column) -> Column:
    """ln(x + LOG_EPS): a regressor of the heterogeneous autoregression."""
    return F.ln(x + F.lit(LOG_EPS))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over complete pairs from sums; NULL for fewer than two pairs or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    top = F.covar_pop(a, b)
    return F.try_divide(top, F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
