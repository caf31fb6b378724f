"""Locality sums of a chain in one pass: all permutations, graphs and thresholds over its places, packed as arrays.

A chain's activations and edges meet once. In the task, activations are a places x features block, permutations index its
rows, and a graph is its edges sorted by src: smoothed values are sums over those stretches. What leaves the task is
a sum for each permutation, graph, feature and threshold, so activations are shuffled once, however many of these there
are. A chain's activations have to fit a task; `locality.locality` joins row by row and takes chains of any size, and
graphs that leave their chain.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the block of places x features that is worked on at a time.
CELLS = 4_000_000


def _sources(uid: object, position: np.ndarray, perms: int, seed: int) -> list[np.ndarray]:
    """For each permutation the index each place takes its value from; 0 is the identity. As ordering.within_group_permutation."""
    out = [np.arange(len(position))]
    for perm in range(1, perms + 1):
        keys = [hashlib.md5(f"{seed}:{perm}:{uid}:{p}".encode()).hexdigest() for p in position.tolist()]
        out.append(np.array(sorted(range(len(position)), key=lambda i: (keys[i], position[i])), np.int64))
    return out


def _smoothed(src: np.ndarray, dst: np.ndarray, starts: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that have edges, and the means of their neighbours' rows. src ascends; starts: where each place's edges begin."""
    sums = np.add.reduceat(z[dst], starts, axis=0)
    return src[starts], sums / np.diff(np.append(starts, len(src)))[:, None]


def _sums(perms: int, kinds: tuple[str, ...], seed: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["uid", "perm", "kind", "feature", "level", "active_n", "active_sum", "all_sum"]
        if left.empty:  # edges without places
            return pd.DataFrame(columns=names)
        uid = left["uid"].iloc[0]
        feature, at, z, mask = (left[c].to_numpy() for c in ("feature", "position", "z", "mask"))
        position = np.unique(at[feature < 0])
        own = feature >= 0
        feature, row, z, mask = feature[own], np.searchsorted(position, at[own]), z[own], mask[own]
        levels = int(left["levels"].max())
        found, column = np.unique(feature, return_inverse=True)
        sources = _sources(uid, position, perms, seed)
        graphs = []
        for kind in kinds:
            e = right[right["kind"] == kind]
            src, dst = np.searchsorted(position, e["src"].to_numpy(np.int64)), np.searchsorted(position, e["dst"].to_numpy(np.int64))
            order = np.argsort(src, kind="stable")
            src, dst = src[order], dst[order]
            graphs.append((src, dst, np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]])) if len(src) else src))
        out = []
        step = max(1, CELLS // max(1, len(position)))
        for first in range(0, len(found), step):
            here = (column >= first) & (column < first + step)
            n = min(step, len(found) - first)
            block, marks = np.zeros((len(position), n)), np.zeros((len(position), n), np.int64)
            block[row[here], column[here] - first], marks[row[here], column[here] - first] = z[here], mask[here]
            counts = [((marks >> k) & 1).sum(axis=0) for k in range(levels)]
            for perm, source in enumerate(sources):
                moved, on = block[source], marks[source]
                for kind, (src, dst, starts) in zip(kinds, graphs):
                    if len(src):
                        places, means = _smoothed(src, dst, starts, moved)
                        whole, near = means.sum(axis=0), [(means * ((on[places] >> k) & 1)).sum(axis=0) for k in range(levels)]
                    else:
                        whole, near = np.zeros(n), [np.zeros(n)] * levels
                    for k in range(levels):
                        out.append(pd.DataFrame({"perm": perm, "kind": kind, "feature": found[first : first + n], "level": k, "active_n": counts[k], "active_sum": near[k], "all_sum": whole}))
        if not out:
            return pd.DataFrame(columns=names)
        return pd.concat(out, ignore_index=True).assign(uid=uid)[names]

    return run


def chain_sums(acts: DataFrame, places: DataFrame, edges: DataFrame, stats: DataFrame, perms: int, kinds: tuple[str, ...], seed: int = 42) -> DataFrame:
    """(uid, perm, kind, feature, level, active_n, active_sum, all_sum): what each chain adds to the sums behind a score.

    acts: (uid, position, feature, z > 0); edges: (kind, uid, src, dst) inside chains, of the given kinds; stats: (feature,
    frac, threshold), level k being the k-th smallest frac. Every place's smoothed value is the mean over its edges.
    """
    steps = stats.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("frac", "threshold"))).alias("_t"))
    mask = F.expr("aggregate(transform(_t, (x, i) -> IF(z > x.threshold, shiftleft(1L, i), 0L)), 0L, (a, b) -> a + b)")
    own = acts.join(steps, "feature").select("uid", F.col("position").cast("long").alias("position"), F.col("feature").cast("long").alias("feature"), F.col("z").cast("double").alias("z"), mask.alias("mask"), F.size("_t").alias("levels"))
    every = places.select("uid", F.col("position").cast("long").alias("position"), F.lit(-1).cast("long").alias("feature"), F.lit(0.0).alias("z"), F.lit(0).cast("long").alias("mask"), F.lit(0).alias("levels"))
    uid = places.schema["uid"].dataType.simpleString()
    both = own.unionByName(every).groupBy("uid").cogroup(edges.select("kind", "uid", "src", "dst").groupBy("uid"))
    return both.applyInPandas(_sums(perms, kinds, seed), f"uid {uid}, perm int, kind string, feature long, level int, active_n long, active_sum double, all_sum double")


def chain_scores(acts: DataFrame, places: DataFrame, edges: DataFrame, stats: DataFrame, perms: int, kinds: tuple[str, ...], min_active: int = 5, seed: int = 42) -> DataFrame:
    """(perm, kind, feature, frac, n_active, d), as locality.locality gives for activations at every permutation.

    stats: (feature, frac, std, threshold), cut from its lineage: it is read twice.
    """
    sums = chain_sums(acts, places, edges, stats, perms, kinds, seed).groupBy("perm", "kind", "feature", "level").agg(*[F.sum(c).alias(c) for c in ("active_n", "active_sum", "all_sum")])
    level = stats.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("frac", "std"))).alias("_t")).select("feature", F.posexplode("_t").alias("level", "t")).select("feature", "level", "t.frac", "t.std")
    total = places.agg(F.count(F.lit(1)).alias("_places"))  # one row
    d = (F.col("active_sum") / F.greatest("active_n", F.lit(1)) - F.col("all_sum") / F.col("_places")) / (F.col("std") + 1e-6)
    out = sums.join(level, ["feature", "level"]).join(F.broadcast(total))
    return out.select("perm", "kind", "feature", "frac", F.col("active_n").alias("n_active"), F.when(F.col("active_n") < min_active, 0.0).otherwise(d).alias("d"))
