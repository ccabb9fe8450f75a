"""Dunning's log-likelihood ratio, as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_likelihood(k: Column, n: Column, p: Column) -> Column:
    """Of k events in n trials at the rate p."""
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return k * F.log(p) + (n - k) * F.log(1 - p)


def dunning(k: Column, n: Column, k_other: Column, n_other: Column) -> Column:
    """Log-likelihood ratio that an event is likelier in the first sample; 0 if it is not."""
    p = (k + k_other) / (n + n_other)
    value = 2 * (
        log_likelihood(k, n, k / n)
        + log_likelihood(k_other, n_other, k_other / n_other)
        - log_likelihood(k, n, p)
        - log_likelihood(k_other, n_other, p)
    )
    return F.when((n > 0) & (n_other > 0) & (k * n_other > k_other * n), value).otherwise(F.lit(0.0))
