import math
import random

import pytest
from pyspark.sql import functions as F

from strandworks.operators import layers


def test_sign_crossings_by_hand(spark):
    series = {
        "between": [(0, 2.0), (4, 1.0), (6, -3.0), (8, 1.0)],  # the first of two, unevenly spaced
        "up": [(3, 1.0), (1, -1.0)],
        "zero": [(0, 1.0), (1, 0.0), (2, -1.0)],
        "after": [(0, 0.0), (1, -1.0), (2, 3.0)],
        "none": [(0, 1.0), (1, 2.0)],
        "gap": [(0, 1.0), (1, None), (2, math.nan), (3, -1.0)],
    }
    rows = spark.createDataFrame([(g, k, v) for g, s in series.items() for k, v in s], "g string, depth int, v double")
    got = {r.g: (r.low, r.high, r.crossing) for r in layers.sign_crossings(rows, ["g"], "depth", "v").collect()}
    assert got == {"between": (4, 6, 4.5), "up": (1, 3, 2.0), "after": (1, 2, 1.25)}


def test_trends_of_values_that_differ_in_their_last_bits_when_worked_out_again(spark):
    rows = [("m", layer, f, layer * 0.5 + ((7 * f + layer) % 11) / 7) for layer in range(8) for f in range(40)]
    plain = spark.createDataFrame(rows, "model string, layer int, feature int, v double")
    shaky = plain.withColumn("v", F.col("v") + F.udf(lambda: random.random() * 1e-12, "double").asNondeterministic()())
    (want,), (got,) = (layers.depth_trends(x, "model", "layer", "v").collect() for x in (plain.withColumn("v", F.col("v") + F.col("feature") * 1e-13), shaky))
    assert (got.n_layers, got.n_pairs) == (8, 320) and got.macro_rho == pytest.approx(want.macro_rho) and got.feature_rho == pytest.approx(want.feature_rho, abs=1e-3)
