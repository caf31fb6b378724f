"""Percentiles, tails, orders, weights and intervals against plain computations and known values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.functions import ordering, stats
from strandworks.operators import annotations, concepts, features, graphs, interventions, layers, resampling, sequences


def test_percentiles_against_numpy(spark):
    r = random.Random(1)
    rows = [("a", r.choice([0.0, 1.0, 1.0, r.random()])) for _ in range(300)] + [("b", 5.0)] * 3 + [("c", r.gauss(0, 9)) for _ in range(41)] + [("a", None), ("c", math.nan)]
    df = spark.createDataFrame(rows, "g string, v double")
    fracs = [0.0, 0.025, 0.5, 0.9, 1.0]
    got = {(x.g, x.frac): (x.n, x.value) for x in stats.percentiles(df, ["g"], "v", fracs, bins=7).collect()}
    for g in "abc":
        own = [v for k, v in rows if k == g and v is not None and not math.isnan(v)]
        for f in fracs:
            assert got[g, f][0] == len(own) and abs(got[g, f][1] - np.percentile(own, 100 * f)) < 1e-12
    own = [v for _, v in rows if v is not None and not math.isnan(v)]
    assert abs(stats.percentiles(df, [], "v", [0.3]).first().value - np.percentile(own, 30)) < 1e-12
    places = spark.createDataFrame([(400,)], "_places long")
    sparse = spark.createDataFrame([(1, float(i)) for i in range(1, 61)], "feature int, z double")
    full = np.concatenate([np.zeros(340), np.arange(1, 61)])
    got = {x.frac: x.value for x in stats.percentiles(sparse, ["feature"], "z", [0.1, 0.85, 0.9], places=places).collect()}
    assert all(abs(got[f] - np.percentile(full, 100 * f)) < 1e-12 for f in got)
    assert stats.percentiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_tails_against_known_values(spark):
    rows = spark.createDataFrame([(1.959963985, 10.0, 2.228138852), (0.0, 1.0, 12.7062047), (-1.0, 500.0, 1.964719837)], "z double, df double, t double")
    out = rows.select(stats.normal_tail(F.col("z")).alias("n"), stats.student_p(F.col("t"), F.col("df")).alias("p")).collect()
    assert np.allclose([x.n for x in out], [0.025, 0.5, 0.841344746], atol=1e-6) and np.allclose([x.p for x in out], 0.05, atol=1e-7)
    tables = spark.createDataFrame([(3, 1, 1, 3), (8, 2, 1, 5), (0, 5, 5, 0)], "a int, b int, c int, d int")
    p = [x.p for x in tables.select(stats.fisher_p("a", "b", "c", "d").alias("p")).collect()]
    assert np.allclose(p, [34 / 70, 0.03496503496, 2 / 252], atol=1e-9)
    assert abs(spark.range(1).select(stats.chi_square_p(F.lit(3.841458821)).alias("p")).first().p - 0.05) < 1e-6


def test_hashed_numbers_are_those_of_a_sort(spark):
    keys = [f"k{i}" for i in range(3000)] + ["same"] * 3
    df = spark.createDataFrame([(k, i % 3) for i, k in enumerate(keys)], "k string, g int").repartition(5)
    import hashlib

    order = sorted(keys, key=lambda k: (hashlib.md5(f"7:{k}".encode()).hexdigest(), k))
    got = sorted((x._index, x.k) for x in ordering.hashed_index(df, "k", 7).collect())
    assert [k for _, k in got] == order and [i for i, _ in got] == list(range(len(keys)))
    assert sorted(x.k for x in ordering.first_hashed(df, "k", 20, 7).collect()) == sorted(order[:20])
    assert {r.g: r.n for r in ordering.first_hashed(df, "k", 5, 7, ["g"]).groupBy("g").agg(F.count("*").alias("n")).collect()} == {0: 5, 1: 5, 2: 5}


def test_weights_and_intervals(spark):
    units = spark.createDataFrame([(i, i % 4) for i in range(40)], "uid int, cluster int")
    own = resampling.unit_weights(units, "uid", 6, 1).groupBy("b").agg(F.sum("w").alias("n")).collect()
    assert len(own) == 6 and {x.n for x in own} == {40}
    two = resampling.cluster_weights(units, "uid", "cluster", 6, 1, two_stage=True)
    assert {x.n for x in two.groupBy("b").agg(F.sum("w").alias("n")).collect()} == {40}  # clusters of one size
    whole = resampling.cluster_weights(units, "uid", "cluster", 6, 1).join(units, "uid").groupBy("b", "cluster").agg(F.count_distinct("w").alias("k"), F.count("*").alias("n")).collect()
    assert all(x.k == 1 and x.n == 10 for x in whole)
    trace = spark.createDataFrame([(float(x),) for x in range(-3, 8)], "v double")
    got = resampling.intervals(trace, [], "v", F.lit(2.5)).first()
    sd = np.std(range(-3, 8), ddof=1)
    assert abs(got.normal_lo - (2.5 - 1.96 * sd)) < 1e-9 and got.normal_lo < 2.5 < got.normal_hi
    assert abs(got.pct_lo - np.percentile(range(-3, 8), 2.5)) < 1e-9 and abs(got.frac_pos - 7 / 11) < 1e-9 and abs(got.p_le_0 - 4 / 11) < 1e-9


def test_grouped_resamples_equal_a_loop(spark, monkeypatch):
    r = random.Random(4)
    contrib = [(perm, "s", u, f, r.random(), r.randint(0, 3), r.random()) for perm in range(3) for u in range(6) for f in range(4) if r.random() < 0.8]
    lengths = {u: 10 + u for u in range(6)}
    weights = [(b, u, w) for b in range(5) for u in range(6) if (w := r.randint(0, 2))]
    std = {f: 0.5 + f for f in range(5)}  # no chain adds to the last feature
    monkeypatch.setattr(resampling, "BLOCK_FEATURES", 2)
    monkeypatch.setattr(resampling, "BLOCK_CHAINS", 2)
    got = resampling.weighted_deltas(
        spark.createDataFrame(contrib, "perm int, kind string, uid int, feature int, active_sum double, active_n int, all_sum double"), spark.createDataFrame(weights, "b int, uid int, w int"),
        spark.createDataFrame(list(std.items()), "feature int, std double"), spark.createDataFrame(list(lengths.items()), "uid int, length int"), 5, 2, ("s",),
    )
    table = {(p, u, f): (a, n, g) for p, _, u, f, a, n, g in contrib}
    assert got.count() == 5 * 5
    for x in got.collect():
        w = {u: k for b, u, k in weights if b == x.b}
        total = sum(k * lengths[u] for u, k in w.items())

        def d(p):
            a, n, g = (sum(k * table.get((p, u, x.feature), (0, 0, 0))[i] for u, k in w.items()) for i in range(3))
            return (a / max(n, 1) - g / max(total, 1)) / (std[x.feature] + 1e-6)

        assert abs(x.delta - (d(0) - (d(1) + d(2)) / 2)) < 1e-9


def test_annotations(spark):
    r = np.random.default_rng(2)
    z = np.maximum(r.normal(size=(60, 3)), 0)
    z[:, 2] = 0
    y = (z[:, 0] > 0.5).astype(float)
    acts = spark.createDataFrame([(0, i, f, float(z[i, f])) for i in range(60) for f in range(3) if z[i, f] > 0], "uid int, position int, feature int, z double")
    marks = spark.createDataFrame([(0, i, float(y[i]), 1.0) for i in range(60)], "uid int, position int, y double, flat double")
    got = {(x.feature, x.annotation): (x.r, x.p) for x in annotations.correlations(acts, marks, ["y", "flat"], spark.range(3).withColumnRenamed("id", "feature")).collect()}
    assert all(abs(got[f, "y"][0] - np.corrcoef(z[:, f], y)[0, 1]) < 1e-9 for f in (0, 1))
    assert got[2, "y"] == (0.0, 1.0) and got[0, "flat"] == (0.0, 1.0)


def test_segments_features_layers(spark):
    marks = spark.createDataFrame([("h", 0, p) for p in (0, 1, 2, 5, 6, 9)] + [("e", 0, 3)], "concept string, uid int, position int")
    own = concepts.segment_concepts(marks)
    assert own.where("concept = 'h'").select("domain").distinct().count() == 3 and concepts.frequent(own, 2).select("concept").distinct().count() == 1
    rates = spark.createDataFrame([(i, i / 50) for i in range(50)], "feature int, rate double")
    target = features.top(rates, "rate", 10)
    picked = features.rate_matched(rates, target, 1, bins=4).collect()
    assert not {x.feature for x in picked} & {x.feature for x in target.collect()} and 0 < len(picked) <= 10 and {x.bin for x in picked} <= {3}
    x = np.random.default_rng(1).normal(size=(30, 4))
    y = x + 0.1
    got = features.reconstruction(spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>"), "x", "y").first()
    assert abs(got.explained - (1 - ((x - y) ** 2).sum() / ((x - x.mean(0)) ** 2).sum())) < 1e-9
    series = spark.createDataFrame([("m", 0, 1.0), ("m", 3, 1.5), ("m", 6, -2.0), ("m", 9, 1.5)], "g string, layer int, v double")
    assert layers.largest_change(series, ["g"], "layer", "v").first()[1:] == (3, 6, -3.5)


def test_controls_and_chains(spark):
    places = spark.createDataFrame([(0, p) for p in range(12)], "uid int, position int")
    contact = spark.createDataFrame([(0, 0, 4), (0, 4, 0), (0, 1, 5), (0, 2, 11)], "uid int, src int, dst int")
    got = graphs.matched_controls(places, contact, 1).collect()
    real = {(0, 4), (1, 5), (2, 11)}
    assert {(x.src, x.dst) for x in got} == real and all(x.c_src is None or (x.c_dst - x.c_src == x.dst - x.src and (x.c_src, x.c_dst) not in real) for x in got)
    scores = spark.createDataFrame([("a", "x", 5.0, 1), ("a", "y", 5.0, 0), ("a", "z", 1.0, 2)], "uid string, chain string, score double, ordinal int")
    assert graphs.best_chain(scores, ["uid"], "chain", "score", "ordinal").first().chain == "y"
    a = spark.createDataFrame([(1, 5.0), (1, 6.0)], "uid int, p double")
    b = spark.createDataFrame([(1, 5.5), (1, 9.0), (2, 1.0)], "uid int, p double")
    assert sorted((x.anchor, x.control) for x in sequences.greedy_controls(a, b, "uid", "p").collect()) == [(5.0, 5.5), (6.0, 9.0)]


def test_labels_of_models(spark):
    rows = spark.createDataFrame([(1, list(range(5, 205))), (2, [])], "k int, t array<int>")
    got = {x.k: x.y for x in rows.select("k", interventions.next_labels("t").alias("y")).collect()}
    assert got[1] == [*range(6, 205), -100] and got[2] == []
    for x in interventions.masked_labels(rows, "k", "t", 3, 25, 1).collect():
        assert len(x.inputs) == len(x.labels) == len(x.t)
        assert all(y in (-100, t) and (i == t or y == t) for t, i, y in zip(x.t, x.inputs, x.labels))
    share = sum(y >= 0 for y in x.labels if x.k == 1) if x.k == 1 else None
    assert share is None or 10 < share < 55


@pytest.mark.parametrize("direction, want", [("greater", 0.0143), ("less", 0.9956), ("two_sided", 0.0286)])
def test_compare_by_hand(spark, direction, want):
    rows = spark.createDataFrame([(1, v, True) for v in (5.0, 6.0, 7.0, 8.0)] + [(1, v, False) for v in (1.0, 2.0, 3.0, 4.0)], "g int, v double, a boolean")
    got = stats.compare(rows, "v", F.col("a"), ["g"], direction).first()
    assert got.u == 16 and got.median_a == 6.5 and got.median_b == 2.5 and abs(got.p - want) < 0.01  # exact p beside the approximation


def test_correlation_trace_of_values_that_differ_in_their_last_bits_when_worked_out_again(spark):
    values = spark.createDataFrame([(u, layer, 10.0 * layer + u) for u in range(6) for layer in range(7)], "uid int, layer int, v double")
    plain = spark.createDataFrame([(layer, float(layer * layer)) for layer in range(7)], "layer int, score double")
    shaky = plain.withColumn("score", F.col("score") + F.udf(lambda: random.random() * 1e-9, "double").asNondeterministic()())
    weights = spark.createDataFrame([(b, u, 1 + (u + b) % 3) for b in range(3) for u in range(6)], "b int, uid int, w int")
    got = resampling.correlation_trace(values, "uid", "layer", "v", shaky, weights).collect()
    assert len(got) == 3 and all(r.rho == pytest.approx(1.0) for r in got)
