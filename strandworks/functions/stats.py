"""Statistics as column expressions and grouped plans. Tails that Spark lacks are vectorised over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strandworks.functions.exact import rank_sum_p, signed_rank_p
from strandworks.functions.running import running, running_sums, with_ranges


def cohens_d(value: Column, in_a: Column, kind: str = "sample") -> Column:
    """Aggregate: effect size between the rows where in_a holds and those where it doesn't.

    kind `sample`: sample variances, 1e-12 inside the root; `population`: population variances, 1e-10 inside the root;
    `outside`: population variances, 1e-8 added to the root.
    """
    a, b = F.when(in_a, value), F.when(~in_a, value)
    var = F.var_samp if kind == "sample" else F.var_pop
    pooled = (var(a) + var(b)) / 2
    spread = F.sqrt(pooled) + 1e-8 if kind == "outside" else F.sqrt(pooled + (1e-12 if kind == "sample" else 1e-10))
    return (F.avg(a) - F.avg(b)) / spread


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal; rational approximation 26.2.17 of Abramowitz and Stegun, error below 7.5e-8."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    # fixed values of the published approximation
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _betacf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / np.where(abs(c) < tiny, tiny, c)
            d = 1 / np.where(abs(d) < tiny, tiny, d)
            h = h * c * d
    return h


def _student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    x = df / (df + t * t)
    a, b = df / 2, np.full_like(df, 0.5)
    log = np.array([math.lgamma(p + 0.5) - math.lgamma(p) - math.lgamma(0.5) for p in a])
    front = np.exp(log + a * np.log(np.maximum(x, 1e-300)) + b * np.log(np.maximum(1 - x, 1e-300)))
    low = x < (a + 1) / (a + b + 2)
    return np.where(t == 0, 1.0, np.where(low, front * _betacf(a, b, x) / a, 1 - front * _betacf(b, a, 1 - x) / b))


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t; null below one degree of freedom."""
    good = t.notna() & (df >= 1)
    out = pd.Series(np.full(len(t), np.nan))
    if good.any():
        out[good.to_numpy()] = _student_two_sided(t[good].to_numpy(float), df[good].to_numpy(float))
    return out.where(out.notna(), None)


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided p of Fisher's exact test on a 2 x 2 table: the sum over tables no likelier than the given one."""

    def one(a: int, b: int, c: int, d: int) -> float:
        rows, cols, n = a + b, a + c, a + b + c + d
        ln = lambda k, m: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
        k = np.arange(max(0, cols - (n - rows)), min(rows, cols) + 1)
        logs = np.array([ln(int(i), rows) + ln(cols - int(i), n - rows) - ln(cols, n) for i in k])
        own = logs[a - k[0]]
        return float(min(1.0, np.exp(logs[logs <= own + 1e-7]).sum()))

    return pd.Series([one(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d)])


def average_rank(by: list[str], value: str) -> Column:
    """Ranks from 1 with ties averaged, inside groups."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def with_bh(rows: DataFrame, p: str, by: list[str], out: str = "q") -> DataFrame:
    """rows with Benjamini-Hochberg q inside groups: n p / rank, made monotone from the largest p down, from 0 to 1.

    Equal p have one q, that of the last of them in rank, so sums run over a group's distinct p, and by ranges. A null p has a
    null q and doesn't count.
    """
    counted = rows.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_m"))
    ranks = running(with_ranges(counted, by, p), by, p, ["_m"])
    n = counted.groupBy(*by).agg(F.sum("_m").alias("_n"))
    raw = (ranks.join(n, by) if by else ranks.crossJoin(n)).withColumn("_raw", F.col(p) * F.col("_n") / F.col("_m_upto"))  # without groups, one row
    q = running(raw, by, p, ["_raw"], falling=True, least=True)
    return rows.join(q.select(*by, p, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "_raw_upto")).alias(out)), [*by, p], "left")


def mann_whitney(rows: DataFrame, value: str, in_a: Column, by: list[str]) -> DataFrame:
    """by, n_a, n_b, u, z, p_greater, p_less, p_two_sided, exact: normal approximation with tie and continuity corrections, but
    exact where one side has at most 8 values and none is tied (functions/exact.py).

    Ranks come from counts of each distinct value, so equal values never meet as rows, and counts are added up by ranges.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.when(in_a, 1)).alias("a"), F.count(F.lit(1)).alias("m"))
    ranked = running_sums(counted, by, value, ["m"]).withColumn("rank", F.col("m_upto") - (F.col("m") - 1) / 2)
    sums = ranked.groupBy(*by).agg(
        F.sum("a").alias("n_a"), F.sum(F.col("m") - F.col("a")).alias("n_b"), F.sum(F.col("a") * F.col("rank")).alias("_ra"), F.sum(F.pow(F.col("m").cast("double"), 3) - F.col("m")).alias("_ties")
    )
    n, pairs = F.col("n_a") + F.col("n_b"), F.col("n_a").cast("double") * F.col("n_b")
    u = F.col("_ra") - F.col("n_a") * (F.col("n_a") + 1) / 2
    spread = F.sqrt(pairs / 12 * (n + 1 - F.col("_ties") / F.nullif(n * (n - 1.0), F.lit(0.0))))
    out = sums.withColumn("u", u).withColumn("_s", spread)
    z = F.when(F.col("_s") > 0, (F.col("u") - pairs / 2 - 0.5) / F.col("_s"))
    below = F.when(F.col("_s") > 0, (F.col("u") - pairs / 2 + 0.5) / F.col("_s"))
    z2 = F.when(F.col("_s") > 0, (F.abs(F.col("u") - pairs / 2) - 0.5) / F.col("_s"))
    exact = rank_sum_p("n_a", "n_b", "u", F.col("_ties") > 0)
    whole = out.select(*by, "n_a", "n_b", "u", z.alias("z"), normal_tail(z).alias("_g"), normal_tail(-below).alias("_l"), F.least(F.lit(1.0), 2 * normal_tail(z2)).alias("_t"), exact.alias("_e"))
    sides = [F.coalesce(f"_e.{e}", n).alias(f"p_{e}") for e, n in (("greater", "_g"), ("less", "_l"), ("two_sided", "_t"))]
    return whole.select(*by, "n_a", "n_b", "u", "z", *sides, F.col("_e.greater").isNotNull().alias("exact"))


def wilcoxon(pairs: DataFrame, difference: str, by: list[str]) -> DataFrame:
    """by, n, w_plus, w_minus, z, p_two_sided, exact of the signed-rank test; zero differences are dropped. Normal approximation
    with tie correction, but exact for at most 50 differences without ties and zeros (functions/exact.py)."""
    own = pairs.where(F.col(difference) != 0).withColumn("_abs", F.abs(difference))
    counted = own.groupBy(*by, "_abs").agg(F.count(F.when(F.col(difference) > 0, 1)).alias("plus"), F.count(F.lit(1)).alias("m"))
    ranked = running_sums(counted, by, "_abs", ["m"]).withColumn("rank", F.col("m_upto") - (F.col("m") - 1) / 2)
    sums = ranked.groupBy(*by).agg(
        F.sum("m").alias("n"), F.sum(F.col("plus") * F.col("rank")).alias("w_plus"), F.sum((F.col("m") - F.col("plus")) * F.col("rank")).alias("w_minus"), F.sum(F.pow(F.col("m").cast("double"), 3) - F.col("m")).alias("_ties")
    )
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    z = F.when(spread > 0, (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / spread)
    zeros = pairs.where(F.col(difference) == 0).groupBy(*by).agg(F.count(F.lit(1)).alias("_zeros"))
    sums = sums.join(zeros, by, "left") if by else sums.crossJoin(zeros)  # without groups, a row each
    exact = signed_rank_p("n", "w_plus", (F.col("_ties") > 0) | (F.coalesce("_zeros", F.lit(0)) > 0))
    whole = sums.select(*by, "n", "w_plus", "w_minus", z.alias("z"), F.least(F.lit(1.0), 2 * normal_tail(-z)).alias("_t"), exact.alias("_e"))
    return whole.select(*by, "n", "w_plus", "w_minus", "z", F.coalesce("_e", "_t").alias("p_two_sided"), F.col("_e").isNotNull().alias("exact"))


def spearman(rows: DataFrame, x: str, y: str, by: list[str], least: int = 3) -> DataFrame:
    """by, n, rho: correlation of average ranks over the rows with both values; null below `least` rows."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    own = ranked(ranked(both, x, by, "_x"), y, by, "_y")
    out = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("rho"))
    return out.withColumn("rho", F.when(F.col("n") >= least, F.col("rho")))


def correlation_t(r: Column, n: Column) -> Column:
    """t of a correlation, clipped at 0.999999 either way."""
    c = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), r))
    return c * F.sqrt((n - 2) / (1 - c * c))


def chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Yates-corrected chi-square of a 2 x 2 table; null where a margin is empty."""
    n, rows, cols = a + b + c + d, (a + b) * (c + d), (a + c) * (b + d)
    gap = F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2.0)
    return F.when((rows > 0) & (cols > 0), n * gap * gap / (rows.cast("double") * cols))


def chi_square_p(x: Column) -> Column:
    """Upper tail with one degree of freedom."""
    return F.least(F.lit(1.0), 2 * normal_tail(F.sqrt(x)))


def association(a: Column, b: Column, c: Column, d: Column) -> Column:
    """(test, statistic, p) of a 2 x 2 table: Yates-corrected chi-square; Fisher's exact test, without a statistic, where a
    margin is empty and so no chi-square is to be had; null where a cell is missing or negative, or all are 0."""
    good = F.least(*[F.coalesce(x, F.lit(-1)) for x in (a, b, c, d)]) >= 0
    good = good & (a + b + c + d > 0)
    chi = chi_square(a, b, c, d)
    cells = [F.when(good & chi.isNull(), x.cast("long")).otherwise(F.lit(0)) for x in (a, b, c, d)]  # only where it is used
    test = F.when(good & chi.isNotNull(), "chi_square").when(good, "fisher")
    p = F.when(good & chi.isNotNull(), chi_square_p(chi)).when(good, fisher_p(*cells))
    return F.struct(test.alias("test"), F.when(good, chi).alias("statistic"), p.alias("p"))


def design_effect(rows: DataFrame, cluster: str, value: str) -> DataFrame:
    """One row: n, clusters, icc, mean_size, deff, n_eff, from an unbalanced one-way analysis of variance.

    A negative icc counts as 0 in deff; with fewer than two clusters, or one row in each, icc and deff are null.
    """
    per = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("m"), F.avg(value).alias("mean"), F.var_pop(value).alias("v"))
    s = per.agg(
        F.sum("m").alias("n"), F.count(F.lit(1)).alias("clusters"), F.sum(F.col("m") * F.col("m")).alias("m2"), F.sum(F.col("m") * F.col("mean")).alias("t"),
        F.sum(F.col("m") * F.col("mean") * F.col("mean")).alias("t2"), F.sum(F.col("m") * F.col("v")).alias("within"),
    )
    n, k = F.col("n"), F.col("clusters")
    enough = (k >= 2) & (n > k)
    msb = F.when(enough, (F.col("t2") - F.col("t") * F.col("t") / n) / (k - 1))
    msw = F.when(enough, F.col("within") / (n - k))
    size = F.when(enough, (n - F.col("m2") / n) / (k - 1))
    whole = msb + (size - 1) * msw
    icc = F.when(whole > 0, (msb - msw) / whole).when(enough, 0.0)
    out = s.select("n", "clusters", icc.alias("icc"), (n / F.nullif(k, F.lit(0))).alias("mean_size"))
    deff = F.when(F.col("icc").isNotNull(), 1 + (F.col("mean_size") - 1) * F.greatest(F.lit(0.0), F.col("icc")))
    return out.withColumn("deff", deff).withColumn("n_eff", F.when(F.col("deff") > 0, F.col("n") / F.col("deff")).otherwise(F.col("n").cast("double")))


def percentiles(rows: DataFrame, by: list[str], value: str, fractions: list[float], bins: int = 1024, places: DataFrame | None = None) -> DataFrame:
    """by, frac, n, value: exact percentiles with linear interpolation; null and NaN are left out.

    Counts over `bins` ranges of a group's values tell which range holds a rank; ranks are then found among the distinct
    values of that range alone, so no task puts a group in order. places: one row with a column `_places`; if given,
    groups have so many values, the rows being those above 0 and the rest 0.
    """
    keys = by or ["_all"]
    own = rows.select(*by, *([] if by else [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    if places is not None:
        own = own.where("_v > 0")
    ends = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    slot = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins).cast("int"))).otherwise(0)
    dealt = own.join(ends.select(*keys, "_lo", "_hi"), keys).withColumn("_bin", slot).select(*keys, "_bin", "_v")
    counts = dealt.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bin")) - F.col("_c"))
    n = F.col("_n")
    wanted = ends.select(*keys, "_n") if places is None else ends.select(*keys, "_n").join(F.broadcast(places))  # one row
    whole = n if places is None else F.col("_places")
    wanted = wanted.withColumn("_whole", whole).withColumn("frac", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    at = (F.col("_whole") - 1) * F.col("frac")
    # the fraction of a whole number of ranks is one, whatever its rounding
    wanted = wanted.withColumn("_at", F.when(F.abs(at - F.round(at)) < 1e-9, F.round(at)).otherwise(at)).withColumn("_zeros", F.col("_whole") - n)
    ranks = wanted.select(*keys, "frac", "_n", "_whole", "_at", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank"), "_zeros").distinct()
    inside = ranks.withColumn("_r", F.col("_rank") - F.col("_zeros")).where("_r >= 0").join(counts, keys).where("_r >= _before AND _r < _before + _c").withColumn("_r", F.col("_r") - F.col("_before"))
    distinct = dealt.join(inside.select(*keys, "_bin").distinct(), [*keys, "_bin"], "left_semi").groupBy(*keys, "_bin", "_v").agg(F.count(F.lit(1)).alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*keys, "_bin").orderBy("_v"))
    ranked = distinct.withColumn("_upto", upto)
    found = inside.select(*keys, "_bin", "frac", "_rank", "_r").join(ranked, [*keys, "_bin"]).where("_r < _upto AND _r >= _upto - _m").select(*keys, "frac", "_rank", "_v")
    both = ranks.join(found, [*keys, "frac", "_rank"], "left").withColumn("_v", F.coalesce("_v", F.lit(0.0)))
    low, high = F.min(F.struct("_rank", "_v"))["_v"], F.max(F.struct("_rank", "_v"))["_v"]
    out = both.groupBy(*keys, "frac", "_at").agg(F.max("_whole").alias("n"), low.alias("_zl"), high.alias("_zh"))
    return out.select(*by, "frac", "n", (F.col("_zl") + (F.col("_zh") - F.col("_zl")) * (F.col("_at") - F.floor("_at"))).alias("value"))


def compare(rows: DataFrame, value: str, in_a: Column, by: list[str], direction: str = "greater") -> DataFrame:
    """by, n_a, n_b, median_a, median_b, u, p, d: one-sided (or two-sided) rank test with medians and the population effect size.

    direction: `greater` (a lies above b), `less` or `two_sided`. p is the normal approximation with tie and continuity
    corrections.
    """
    named = rows.withColumn("_in_a", in_a)
    test = mann_whitney(named, value, F.col("_in_a"), by)
    middle = percentiles(named.where(F.col("_in_a").isNotNull()), [*by, "_in_a"], value, [0.5]).groupBy(*by).agg(F.max(F.when(F.col("_in_a"), F.col("value"))).alias("median_a"), F.max(F.when(~F.col("_in_a"), F.col("value"))).alias("median_b"))
    effect = named.groupBy(*by).agg(cohens_d(F.col(value), F.col("_in_a"), "population").alias("d")) if by else named.agg(cohens_d(F.col(value), F.col("_in_a"), "population").alias("d"))
    p = {"greater": "p_greater", "less": "p_less", "two_sided": "p_two_sided"}[direction]
    if not by:  # a row each
        return test.crossJoin(middle).crossJoin(effect).select("n_a", "n_b", "median_a", "median_b", "u", F.col(p).alias("p"), "d")
    return test.join(middle, by).join(effect, by).select(*by, "n_a", "n_b", "median_a", "median_b", "u", F.col(p).alias("p"), "d")


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation by Student's t; 1 where the correlation is null."""
    return F.coalesce(student_p(correlation_t(r, n), (n - 2).cast("double")), F.lit(1.0))


def ranked(rows: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """rows with average ranks from 1 in `out`. Ranks are found among a group's distinct values, not its rows, and by ranges."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_m"))
    found = running_sums(counted, by, value, ["_m"]).select(*by, value, (F.col("_m_upto") - (F.col("_m") - 1) / 2).alias(out))
    return rows.join(found, [*by, value], "left")


def rank_correlations(rows: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """by, a, b, n, rho: Spearman's correlation of every two of the columns, over rows that have all of them."""
    own = rows.dropna(subset=values).select(*by, *values)
    for v in values:
        own = ranked(own, v, by, f"_rank_{v}")
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :]]
    wide = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.corr(f"_rank_{a}", f"_rank_{b}").alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("rho")) for i, (a, b) in enumerate(pairs)])).alias("_p")
    return wide.select(*by, "n", each).select(*by, "_p.a", "_p.b", "n", "_p.rho")


def summarize(rows: DataFrame, by: list[str], values: list[str], population: bool = False) -> DataFrame:
    """by, and for each value its mean, std and count, named value_mean, value_std, value_count. population: std with n, not n - 1."""
    std = F.stddev_pop if population else F.stddev_samp
    return rows.groupBy(*by).agg(*[f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", std), ("count", F.count))])


def mean_of_present(*values: Column) -> Column:
    """Mean of those values that are there; null if none is."""
    there = F.filter(F.array(*values), lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there))


def mean_pm_std(mean: Column, std: Column, places: int = 3) -> Column:
    return F.format_string(f"%.{places}f±%.{places}f", mean, F.coalesce(std, F.lit(0.0)))


def significant(p: Column, d: Column, level: float = 0.05) -> Column:
    return (p < level) & (d > 0)


def verdict(low: Column, high: Column) -> Column:
    """What an interval says: positive, negative, or inconclusive where it holds 0."""
    return F.when(low > 0, "positive").when(high < 0, "negative").otherwise("inconclusive")
