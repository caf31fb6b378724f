"""Arrays as vectors: products, sparse tops, and the nearest of two dictionaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def keep_top(vec: str, k: int) -> Column:
    """The vector with what is below its kth largest value, or not above 0, set to 0; ties at the kth are kept."""
    least = F.element_at(F.sort_array(vec, asc=False), F.least(F.lit(k), F.size(vec)))
    return F.when(F.size(vec) > 0, F.transform(vec, lambda x: F.when((x >= least) & (x > 0), x).otherwise(F.lit(0.0).cast("float")))).otherwise(F.col(vec))


def norm_scale(rows: DataFrame, vec: str, train: Column) -> DataFrame:
    """One row: scale, sqrt(width) over the mean norm of the training rows; 1 if that is 0."""
    own = rows.where(train).agg(F.avg(norm(vec)).alias("m"), F.max(F.size(vec)).alias("width"))
    return own.select(F.when(F.col("m") > 0, F.sqrt("width") / F.col("m")).otherwise(1.0).alias("scale"))


#: Blocks of a side, and vectors of a block: no fewer than the first, no more than the second.
SIDE, LEAST, MOST = 24, 1024, 1 << 17
#: Products that are in memory at once.
PRODUCTS = 1 << 22


def _nearest(x: np.ndarray, y: np.ndarray, names: np.ndarray, same: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the name and cosine of the row of y that is nearest to 9 places, the first of equal ones; same: names
    of x that don't count."""
    at, top = np.zeros(len(x), np.int64), np.zeros(len(x))
    step = max(1, PRODUCTS // len(y))
    for i in range(0, len(x), step):
        s = x[i : i + step] @ y.T
        if same is not None:
            own = np.searchsorted(names, same[i : i + step])
            hit = np.flatnonzero(own < len(names))
            hit = hit[names[own[hit]] == same[i : i + step][hit]]
            s[hit, own[hit]] = -2
        best = s.max(1)
        # equal vectors may differ in the last bits of their products: rows with more than one candidate are looked at again
        near = s >= (best - 2e-9)[:, None]
        at[i : i + step] = near.argmax(1)
        for r in np.flatnonzero(near.sum(1) > 1):
            there = np.flatnonzero(near[r])
            at[i + r] = there[np.round(s[r, there], 9).argmax()]
        top[i : i + step] = s[np.arange(len(s)), at[i : i + step]]
    return names[at], top


def best_match(left: DataFrame, right: DataFrame, key: str, vec: str, block: int | None = None, skip_same: bool = False) -> DataFrame:
    """(key, match, cosine): for each left vector the right one with the largest cosine to 9 places, then the least key.

    Both sides are dealt by a hash into blocks; each pair of blocks is one product of matrices in a task, a slice of rows
    at a time, which hands on a row for each left vector, and max_by() takes the best over blocks. A side has SIDE blocks,
    or fewer if it is small, so a vector travels SIDE times however many there are, until blocks hold MOST vectors; beyond
    that blocks get more, not larger. block: vectors of a block, if given. An exact best match takes all products; nothing
    of either side is gathered whole.
    """
    width = f"{key} long, match long, cosine double"

    def count(n: int) -> int:
        own = block or min(MOST, max(LEAST, -(-n // SIDE)))
        return max(1, -(-n // own))

    m, n = (count(df.count()) for df in (left, right))

    def blocks(df: DataFrame, own: int) -> DataFrame:
        return df.select(F.col(key).cast("long").alias(key), F.col(vec).alias(vec), F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(own)).alias("_own"))

    def numbers(k: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias("_n")

    dealt = blocks(left, m).select(F.col("_own").alias("_b"), numbers(n).alias("_other"), key, vec)
    facing = blocks(right, n).select(numbers(m).alias("_fb"), F.col("_own").alias("_fo"), key, vec)

    def unit(df: pd.DataFrame) -> np.ndarray:
        own = np.stack(df[vec].to_numpy()).astype(float)
        own /= np.linalg.norm(own, axis=1, keepdims=True) + 1e-12
        return own

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({key: [], "match": [], "cosine": []})
        x, y = x.sort_values(key), y.sort_values(key)
        match, top = _nearest(unit(x), unit(y), y[key].to_numpy(), x[key].to_numpy() if skip_same else None)
        return pd.DataFrame({key: x[key].to_numpy(), "match": match, "cosine": top})

    best = dealt.groupBy("_b", "_other").cogroup(facing.groupBy("_fb", "_fo")).applyInPandas(product, width)
    return best.groupBy(key).agg(F.max_by("match", F.struct(F.round("cosine", 9), -F.col("match"))).alias("match"), F.max("cosine").alias("cosine"))
