"""Sums over a chain's packed places against row-by-row joins of the same scores."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandworks.functions.ordering import within_group_permutation
from strandworks.operators import chainwise, graphs, locality, resampling


@pytest.fixture(scope="module")
def tables(spark):
    r = np.random.default_rng(5)
    lengths = {"a": 12, "b": 1, "c": 30, "none": 7}
    places = [(u, 3 * p + 2) for u, n in lengths.items() for p in range(n)]
    acts = [(u, p, f, float(z)) for u, p in places if u != "none" for f in range(6) if (z := r.normal()) > 0]
    places = spark.createDataFrame(places, "uid string, position int")
    acts = spark.createDataFrame(acts, "uid string, position int, feature int, z double")
    near = graphs.band_edges(places, 6).select(F.lit("near").alias("kind"), "uid", "src", "dst")
    far = graphs.band_edges(places, 15).where("sep > 9 AND uid = 'c'").select(F.lit("far").alias("kind"), "uid", "src", "dst")
    return acts, places, near.unionByName(far)


def _rows(df):
    return sorted((x.perm, x.kind, x.feature, round(x.frac, 9), x.n_active, round(x.d, 9) + 0.0) for x in df.collect())


def test_scores_equal_those_of_joins(spark, tables, monkeypatch):
    acts, places, edges = tables
    stats = locality.feature_stats(acts, places, [0.1, 0.3, 0.5])
    moved = locality.permuted_acts(acts, within_group_permutation(places, ["uid"], "position", 3))
    want = _rows(locality.locality(moved, places, graphs.weighted(edges, ["kind"]), stats, 2))
    assert _rows(chainwise.chain_scores(acts, places, edges, stats, 3, ("near", "far"), 2)) == want
    monkeypatch.setattr(chainwise, "CELLS", 60)  # two features of the longest chain at a time
    chunk = chainwise._sums(1, ("near",), 42)
    whole = chainwise.chain_sums(acts, places, edges, stats, 1, ("near",)).where("uid = 'c'").toPandas()
    left = acts.where("uid = 'c'").toPandas().assign(mask=0, levels=3)
    left = left[["uid", "position", "feature", "z", "mask", "levels"]]
    spots = places.where("uid = 'c'").toPandas().assign(feature=-1, z=0.0, mask=0, levels=0)
    got = chunk(pd.concat([left, spots]), edges.where("uid = 'c'").toPandas())
    keys = ["perm", "kind", "feature", "level"]
    assert np.allclose(got.sort_values(keys)["all_sum"].to_numpy(), whole.sort_values(keys)["all_sum"].to_numpy())


def test_contributions_add_up_to_scores(spark, tables):
    acts, places, edges = tables
    stats = locality.feature_stats(acts, places, [0.3])
    own = resampling.contributions(acts, places, edges, stats, 2, ("near", "far"))
    assert own.where("uid = 'none'").count() == 0 and own.select("uid").distinct().count() == 3
    chains = places.groupBy("uid").agg(F.count(F.lit(1)).alias("length"))
    once = chains.select(F.lit(0).alias("b"), "uid", F.lit(1).alias("w"))
    deltas = {(x.kind, x.feature): x.delta for x in resampling.weighted_deltas(own, once, stats, chains, 1, 2, ("near", "far")).collect()}
    want = locality.deltas(chainwise.chain_scores(acts, places, edges, stats, 2, ("near", "far"), 0))
    assert {(x.kind, x.feature): pytest.approx(x.delta) for x in want.collect()} == deltas
