"""Exact null distributions of the rank tests, for few values without ties, and when they are used.

Mann-Whitney: U of n and m values without ties is counted by the Gaussian binomial coefficient, the product over i to n of
(1 - q^(m + i)) / (1 - q^i). It is used where the smaller side has at most 8 values, none is tied and n m is at most CELLS.
Signed ranks: the sum of positive ranks of n values is counted by the product over i to n of (1 + q^i). It is used for at most
50 values without ties, where none was zero. Elsewhere the normal approximation holds. Counts are whole numbers of any size.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

SMALLER_SIDE, SIGNED, CELLS = 8, 50, 2_000_000


@functools.lru_cache(maxsize=64)
def rank_sum_counts(n: int, m: int) -> np.ndarray:
    """How many ways of dealing n + m ranks give each U from 0 to n m."""
    n, m = min(n, m), max(n, m)
    size = n * m + 1
    counts = np.zeros(size, object)
    counts[0] = 1
    for i in range(1, n + 1):
        if m + i < size:
            counts[m + i :] -= counts[: size - m - i].copy()
        padded = np.concatenate([counts, np.zeros(-size % i, object)]).reshape(-1, i)
        counts = np.add.accumulate(padded, axis=0).ravel()[:size]  # division by 1 - q^i
    return counts


@functools.lru_cache(maxsize=64)
def signed_rank_counts(n: int) -> np.ndarray:
    """How many choices of signs give each sum of positive ranks from 0 to n (n + 1) / 2."""
    counts = np.zeros(n * (n + 1) // 2 + 1, object)
    counts[0] = 1
    for i in range(1, n + 1):
        counts[i:] += counts[:-i].copy()
    return counts


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("greater", "less", "two_sided")]))
def rank_sum_p(n: pd.Series, m: pd.Series, u: pd.Series, tied: pd.Series) -> pd.DataFrame:
    """Exact p of U; null where the normal approximation holds."""
    out = []
    for a, b, own, ties in zip(n, m, u, tied):
        if ties or not 0 < min(a, b) <= SMALLER_SIDE or a * b > CELLS:
            out.append((None, None, None))
            continue
        counts = rank_sum_counts(int(a), int(b))
        own, whole = int(own), int(sum(counts))
        up, down = int(sum(counts[own:])) / whole, int(sum(counts[: own + 1])) / whole
        out.append((up, down, min(1.0, 2 * min(up, down))))
    return pd.DataFrame(out, columns=["greater", "less", "two_sided"], dtype="float64")


@F.pandas_udf(DoubleType())
def signed_rank_p(n: pd.Series, w_plus: pd.Series, tied: pd.Series) -> pd.Series:
    """Exact two-sided p of the sum of positive ranks; null where the normal approximation holds."""
    out = []
    for k, w, ties in zip(n, w_plus, tied):
        if ties or not 0 < k <= SIGNED:
            out.append(None)
            continue
        counts, w = signed_rank_counts(int(k)), int(w)
        out.append(min(1.0, 2 * min(int(sum(counts[w:])), int(sum(counts[: w + 1]))) / 2 ** int(k)))
    return pd.Series(out, dtype="float64")
