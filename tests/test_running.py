"""Running sums by ranges against sums over sorted rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.functions import running, stats


def _values(r):
    """Groups with heavy tails, one narrow band, ties at whole numbers, both signs, and ends."""
    narrow = {1.0 + k * 2.0**-45 for k in range(200)}
    out = {("tail", math.exp(r.gauss(0, 40)) * r.choice([-1, 1])) for _ in range(300)}
    out |= {("band", x) for x in narrow} | {("ends", x) for x in (float("-inf"), -1e308, -5e-324, 0.0, 5e-324, 1e308, float("inf"), float("nan"))}
    return sorted(out, key=str) + [("whole", float(k)) for k in range(-40, 40)] + [("one", 3.5)]


@pytest.mark.parametrize("most", [1, 7, 10**6])
def test_running_sums(spark, most):
    r = random.Random(most)
    rows = [(g, v, r.randrange(5), r.random()) for g, v in _values(r)]
    df = spark.createDataFrame(rows, "g string, v double, m long, x double").repartition(5)
    got = {(x.g, repr(x.v)): (x.m_upto, x.x_upto) for x in running.running_sums(df, ["g"], "v", ["m", "x"], most).collect()}
    least = {(x.g, repr(x.v)): x.x_upto for x in running.running(running.with_ranges(df, ["g"], "v", most), ["g"], "v", ["x"], falling=True, least=True).collect()}
    assert len(got) == len(rows)
    for g in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (math.isnan(x[1]), x[1]))
        for k, (_, v, _, x) in enumerate(own):
            assert got[g, repr(v)] == (sum(y[2] for y in own[: k + 1]), pytest.approx(sum(y[3] for y in own[: k + 1])))
            assert least[g, repr(v)] == min(y[3] for y in own[k:])


def test_heavy_ranges_are_dealt_again(spark):
    df = spark.createDataFrame([(1.0 + k * 2.0**-30,) for k in range(1000)], "v double")
    ranges = running.with_ranges(df, [], "v", 50).groupBy("_range").agg(F.count("*").alias("n")).collect()
    assert len(ranges) >= 20 and max(x.n for x in ranges) <= 100
    assert running.with_ranges(df, [], "v").select("_range").distinct().count() == 1


def test_ranks_of_a_tied_and_a_skewed_group(spark):
    r = np.random.default_rng(1)
    tied, skewed = r.integers(0, 3, 400).astype(float), np.exp(r.normal(0, 30, 400))
    rows = [(g, i, float(v)) for g, own in (("tied", tied), ("skewed", skewed)) for i, v in enumerate(own)]
    got = {(x.g, x.i): x.rank for x in stats.ranked(spark.createDataFrame(rows, "g string, i int, v double"), "v", ["g"], "rank").collect()}
    for g, own in (("tied", tied), ("skewed", skewed)):
        order = {v: (np.sum(own < v) + np.sum(own <= v) + 1) / 2 for v in set(own.tolist())}
        assert all(got[g, i] == order[v] for i, v in enumerate(own.tolist()))
