"""Exact null distributions against enumeration, when they are used, and other small methods against plain loops."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from strandworks.functions import exact, stats
from strandworks.operators import annotations, graphs, sequences
from strandworks.sources import readers as R


@pytest.mark.parametrize("n, m", [(1, 1), (1, 9), (3, 4), (5, 5), (6, 4), (8, 3)])
def test_rank_sum_counts(n, m):
    want = [0] * (n * m + 1)
    for ranks in itertools.combinations(range(n + m), n):
        want[sum(ranks) - n * (n - 1) // 2] += 1
    assert exact.rank_sum_counts(n, m).tolist() == want == exact.rank_sum_counts(m, n).tolist()


def test_counts_of_large_samples_are_whole():
    counts = exact.rank_sum_counts(8, 2000)
    assert int(sum(counts)) == math.comb(2008, 8) and counts.min() == 1 and all(counts == counts[::-1])
    assert int(sum(exact.signed_rank_counts(50))) == 2**50 and exact.signed_rank_counts(3).tolist() == [1, 1, 1, 2, 1, 1, 1]


def test_when_tests_are_exact(spark):
    rows = [("few", float(v), v < 3) for v in range(7)] + [("tied", 1.0, True), ("tied", 1.0, False), ("tied", 2.0, False)] + [("many", v + 0.5, v % 2 == 0) for v in range(40)] + [("one side", 1.0, True)]
    got = {x.g: x for x in stats.mann_whitney(spark.createDataFrame(rows, "g string, v double, a boolean"), "v", F.col("a"), ["g"]).collect()}
    assert {g: x.exact for g, x in got.items()} == {"few": True, "tied": False, "many": False, "one side": False}
    assert got["few"].u == 0 and got["few"].p_less == pytest.approx(1 / 35) and got["few"].p_greater == 1 and got["few"].p_two_sided == pytest.approx(2 / 35)
    diffs = [("few", d) for d in (1.0, 2.0, 3.0, -4.0, 5.0)] + [("zero", d) for d in (0.0, 1.0, 2.0)] + [("tied", d) for d in (1.0, -1.0, 2.0)] + [("many", float(d)) for d in range(1, 52)]
    got = {x.g: x for x in stats.wilcoxon(spark.createDataFrame(diffs, "g string, d double"), "d", ["g"]).collect()}
    assert {g: x.exact for g, x in got.items()} == {"few": True, "zero": False, "tied": False, "many": False}
    assert got["few"].w_plus == 11 and got["few"].p_two_sided == pytest.approx(2 * 7 / 32)


def test_association(spark):
    rows = [(1, 10, 20, 30, 5), (2, 0, 0, 3, 9), (3, None, 1, 1, 1), (4, 0, 0, 0, 0), (5, -1, 2, 3, 4)]
    got = {x.k: x.t for x in spark.createDataFrame(rows, "k int, a int, b int, c int, d int").select("k", stats.association(*map(F.col, "abcd")).alias("t")).collect()}
    assert got[1].test == "chi_square" and got[1].statistic == pytest.approx(65 * (abs(10 * 5 - 20 * 30) - 32.5) ** 2 / (30 * 35 * 40 * 25))
    assert (got[2].test, got[2].statistic, got[2].p) == ("fisher", None, 1.0)
    assert all((got[k].test, got[k].statistic, got[k].p) == (None, None, None) for k in (3, 4, 5))


@pytest.mark.parametrize("seed", range(5))
def test_nearest_free_against_a_scan(seed):
    r = random.Random(seed)
    anchors, free = [float(r.randrange(60)) for _ in range(r.randrange(40))], sorted(float(r.randrange(60)) for _ in range(r.randrange(40)))
    want, left = [], list(free)
    for a in sorted(anchors):
        if left:
            k = min(range(len(left)), key=lambda i: (abs(left[i] - a), left[i]))
            want.append((a, left.pop(k)))
    assert sequences.nearest_free(anchors, free) == want


def test_nearest_free_of_a_million_places():
    found = sequences.nearest_free([float(i) for i in range(1_000_000)], [500_000.5] * 600_000)
    assert len(found) == 600_000 and {c for _, c in found} == {500_000.5}


def test_degree_matched_null(spark):
    places = spark.createDataFrame([(u, p) for u, n in ((1, 9), (2, 40), (3, 1)) for p in range(n)], "uid int, position int")
    edges = graphs.band_edges(places, 3).where("uid = 2 OR src < 4").unionByName(graphs.band_edges(places, 8).where("uid = 1 AND src = 8"))
    want = {(x.uid, x.src): x.n for x in edges.groupBy("uid", "src").agg(F.count("*").alias("n")).collect()}
    null = [(x.uid, x.src, x.dst) for x in graphs.degree_matched_null(places, edges, 5).collect()]
    assert len(set(null)) == len(null) and all(s != d for _, s, d in null) and want[1, 8] == 8
    assert {k: sum((u, s) == k for u, s, _ in null) for k in want} == want and {d for u, _, d in null if u == 2} <= set(range(40))


def test_degree_matched_null_draws_for_every_place_anew(spark):
    places = spark.createDataFrame([(1, p) for p in range(60)], "uid int, position int")
    null = graphs.degree_matched_null(places, graphs.band_edges(places, 2), 5).collect()
    partners = {s: frozenset(x.dst for x in null if x.src == s) for s in range(60)}
    # with one order of the chain for all places, two places that share a partner share its neighbour in that order too
    beside: dict = {}
    for own in partners.values():
        for d in own:
            beside.setdefault(d, set()).update(own - {d})
    assert max(len(x) for x in beside.values()) > 8


def test_cascade_and_groups(spark):
    rows = [("x", 3, "AAAA"), ("x", 1, "AA"), ("x", 2, "AAAB"), ("x", 5, "AAAA"), ("y", 4, "AAAAAAA"), ("y", 6, None), ("y", 7, "aaaa")]
    got = {x.n: x.reason for x in sequences.cascade(spark.createDataFrame(rows, "k string, n int, s string"), "s", "k", "n", "A", 3, 5).collect()}
    assert got == {1: "short", 2: "alphabet", 3: "ok", 5: "duplicate", 4: "long", 6: "short", 7: "ok"}
    classes = spark.createDataFrame([(c,) for c in ("H", "B", "S", "", "-", "Q", None)], "c string")
    assert [x.g for x in classes.select(annotations.structure_group(F.col("c")).alias("g")).collect()] == ["helix", "strand", "turn", "coil", "coil", None, None]


def test_cells_written_again(spark, tmp_path):
    path = str(tmp_path / "cells")
    cells = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "model string, layer int")
    assert R.missing_cells(cells, spark, path).count() == 3
    rows = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.7), ("a", 2, 0.1)], "model string, layer int, v double")
    R.write_cells(rows, path)
    (tmp_path / "cells" / "model=a" / "layer=2" / "part-from-a-broken-run.parquet").write_bytes((next((tmp_path / "cells" / "model=a" / "layer=2").glob("*.parquet"))).read_bytes())
    R.write_cells(rows, path)
    assert sorted(tuple(x) for x in spark.read.parquet(path).select("model", "layer", "v").collect()) == [("a", 1, 0.5), ("a", 1, 0.7), ("a", 2, 0.1)]
    R.write_cells(rows.where("layer = 2").selectExpr("model", "layer", "v + 1 AS v"), path)
    assert sorted(x.v for x in spark.read.parquet(path).collect()) == [0.5, 0.7, 1.1]
    assert [tuple(x) for x in R.missing_cells(cells, spark, path).collect()] == [("b", 1)]
