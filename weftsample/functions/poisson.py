"""Poisson numbers by inversion: the smallest n with P(N <= n) >= u.

Spark has no Poisson function.  A join with a table of distribution functions
would shuffle all rows on their weight, and most rows share a few weights, so
the inversion runs row-locally on Arrow batches instead: two doubles in, one
long out.  Within a batch each distinct mean is worked out once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Fixed values.
TAIL_WIDTH = 12.0  # standard deviations kept on each side of the mean
TAIL_EXTRA = 20.0  # and this many more; together they leave out < 1e-20
SMALL_MEAN = 32.0  # below it rows are stepped through together


def poisson_block(mean: float) -> tuple[int, np.ndarray]:
    """``(first, cdf)``: the distribution function at first, first + 1, ...

    Probabilities are built outward from the mode, relative to it, and divided
    by their sum.  Nothing under- or overflows, whatever the mean.
    """
    reach = TAIL_WIDTH * math.sqrt(mean) + TAIL_EXTRA
    first = max(0, math.floor(mean - reach))
    last = math.ceil(mean + reach)
    mode = math.floor(mean)
    up = np.cumsum(np.log(mean) - np.log(np.arange(mode + 1, last + 1)))
    down = np.cumsum(np.log(np.arange(mode, first, -1)) - np.log(mean))[::-1]
    weight = np.exp(np.concatenate([down, [0.0], up]))
    cdf = np.cumsum(weight)
    cdf /= cdf[-1]
    return first, cdf


def poisson_quantile(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson numbers for uniforms ``u`` in (0, 1) and positive means."""
    drawn = np.zeros(len(u), dtype=np.int64)
    small = mean <= SMALL_MEAN
    drawn[small] = _step_through(u[small], mean[small])
    if not small.all():
        large = np.flatnonzero(~small)
        means, which = np.unique(mean[large], return_inverse=True)
        order = np.argsort(which, kind="stable")
        groups = np.split(large[order], np.cumsum(np.bincount(which))[:-1])
        for one_mean, rows in zip(means, groups):
            first, cdf = poisson_block(float(one_mean))
            place = np.searchsorted(cdf, u[rows], side="left")
            drawn[rows] = first + np.minimum(place, len(cdf) - 1)
    return drawn


def _step_through(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Add up probabilities for all rows at once, dropping rows as they finish."""
    drawn = np.zeros(len(u), dtype=np.int64)
    chance = np.exp(-mean)
    total = chance.copy()
    open_rows = np.flatnonzero(u > total)
    n = 0
    while len(open_rows):
        n += 1
        chance[open_rows] *= mean[open_rows] / n
        total[open_rows] += chance[open_rows]
        drawn[open_rows] = n
        limit = mean[open_rows] + TAIL_WIDTH * np.sqrt(mean[open_rows]) + TAIL_EXTRA
        open_rows = open_rows[(u[open_rows] > total[open_rows]) & (n < limit)]
    return drawn


@F.pandas_udf(LongType())
def poisson_number(u: pd.Series, mean: pd.Series) -> pd.Series:
    """Copies of rows that are known to draw some, ``u > exp(-mean)``.

    The caller's exp() may differ from numpy's in the last bit, hence the 1.
    """
    return pd.Series(np.maximum(poisson_quantile(u.to_numpy(), mean.to_numpy()), 1))
