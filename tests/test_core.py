import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from strandworks.functions import stats
from strandworks.functions.ordering import within_group_permutation
from strandworks.operators import alignment, graphs, locality, sequences, vectors


def test_cohens_d_by_hand(spark):
    rows = spark.createDataFrame([(float(x), True) for x in range(1, 6)] + [(float(x), False) for x in range(4, 9)], "v double, a boolean")
    d = rows.agg(stats.cohens_d(F.col("v"), F.col("a")).alias("d"), stats.cohens_d(F.col("v"), ~F.col("a")).alias("e")).first()
    assert abs(d.d + 1.8973665961) < 1e-9 and abs(d.d + d.e) < 1e-12


def test_bh_with_ties(spark):
    rows = spark.createDataFrame([(i, 1, p) for i, p in enumerate([0.01, 0.01, 0.03, 0.2, 0.9])], "k int, g int, p double")
    q = [r.q for r in stats.with_bh(rows, "p", ["g"]).orderBy("k").collect()]
    assert np.allclose(q, [0.025, 0.025, 0.05, 0.25, 0.9])


def test_permutations_stay_in_their_groups(spark):
    rows = spark.createDataFrame([(u, p) for u, n in enumerate([10, 7, 13, 5]) for p in range(n)], "uid int, position int")
    got = within_group_permutation(rows, ["uid"], "position", 3).collect()
    for perm, uid, n in [(p, u, n) for p in range(4) for u, n in enumerate([10, 7, 13, 5])]:
        own = [r for r in got if r.perm == perm and r.uid == uid]
        assert sorted(r.position for r in own) == sorted(r.source for r in own) == list(range(n))


def test_sparse_locality_equals_dense(spark):
    r = np.random.default_rng(3)
    lengths, k = [12, 9, 15], 3
    z = np.maximum(r.normal(size=(sum(lengths), k)), 0)
    place = [(u, p) for u, n in enumerate(lengths) for p in range(n)]
    near = [[j for j, (v, q) in enumerate(place) if v == u and 0 < abs(q - p) <= 2] for u, p in place]
    smooth = np.array([z[n].mean(0) if n else np.zeros(k) for n in near])
    on = z > np.percentile(z, 70, axis=0)
    want = [(smooth[on[:, f], f].mean() - smooth[:, f].mean()) / (z[:, f].std() + 1e-6) for f in range(k)]
    acts = spark.createDataFrame([(0, u, p, f, float(z[i, f])) for i, (u, p) in enumerate(place) for f in range(k) if z[i, f] > 0], "perm int, uid int, position int, feature int, z double")
    places = spark.createDataFrame(place, "uid int, position int")
    edges = graphs.weighted(graphs.band_edges(places, 2)).withColumn("kind", F.lit("band"))
    got = locality.locality(acts, places, edges, locality.feature_stats(acts, places, [0.3])).orderBy("feature").collect()
    assert np.allclose([x.d for x in got], want)


def test_contact_grid_against_all_pairs(spark):
    r = random.Random(2)
    rows = [(u, p, *[r.uniform(-9, 9) for _ in range(3)]) for u in range(2) for p in range(30)] + [(2, 0, 0.0, 0.0, 0.0), (2, 5, 6.0, 0.0, 0.0)]
    want = {(a[0], a[1], b[1]) for a, b in itertools.product(rows, rows) if a[0] == b[0] and abs(a[1] - b[1]) >= 3 and sum((x - y) ** 2 for x, y in zip(a[2:], b[2:])) ** 0.5 <= 6}
    got = graphs.contact_edges(spark.createDataFrame(rows, "uid int, position int, x double, y double, z double"), 6.0, 3).collect()
    assert len(got) == len(want) and {(e.uid, e.src, e.dst) for e in got} == want and (2, 0, 5) in want


def test_islands_and_alignment(spark):
    rows = spark.createDataFrame([("a", p, m) for p, m in enumerate("xxyyxz")], "uid string, position int, mark string")
    assert [r.run for r in graphs.islands(rows, ["uid"], "position", "mark").orderBy("position").collect()] == [0, 0, 2, 2, 4, 5]
    pair = spark.createDataFrame([("ACDEF", "ACEF"), (None, "A")], "a string, b string")
    got = [[(p.a_pos, p.b_pos) for p in r.places] for r in alignment.aligned_places(pair, "a", "b").collect()]
    assert [(0, 0), (3, 2), (4, 3)] == [p for p in got[0] if p != (1, 1)] and got[1] == []


def test_best_match_of_a_table_with_itself(spark):
    own = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0])], "k long, v array<double>")
    got = {r.k: r.match for r in vectors.best_match(own, own, "k", "v", block=2, skip_same=True).collect()}
    assert got == {0: 1, 1: 0, 2: 1}


def test_best_match_takes_the_least_of_keys_that_are_equal_to_nine_places(spark):
    rows = [(1, [1.0, 0.0]), (5, [1.0, 1e-6]), (9, [2.0, 0.0]), (12, [0.0, 1.0])]
    own = spark.createDataFrame(rows, "k long, v array<double>")
    for block in (None, 1, 2):
        assert {r.k: r.match for r in vectors.best_match(own, own, "k", "v", block=block, skip_same=True).collect()} == {1: 5, 5: 1, 9: 1, 12: 5}


def test_dataset_summary_reads_the_texts_once(spark):
    from strandworks.plans import core

    plan = core.dataset_summary(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan and "regexp_replace" not in plan
