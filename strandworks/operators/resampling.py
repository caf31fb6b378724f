"""Splits, stratified samples, cluster bootstraps: draws are hashes, so any engine can repeat them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions.lineage import cut
from strandworks.functions.ordering import hash_number, hashed_index, shuffle_key
from strandworks.functions.stats import cohens_d, percentiles, ranked
from strandworks.operators.chainwise import chain_sums

#: Features and chains of a block whose weights and contributions are multiplied in one task.
BLOCK_FEATURES, BLOCK_CHAINS = 64, 4096


def validation_split(units: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """units with `is_val`: the first max(1, round(n * share)) of them in the pseudorandom order."""
    n = units.agg(F.count(F.lit(1)).alias("_n"))  # one row
    first = F.col("_index") < F.greatest(F.lit(1), F.floor(F.col("_n") * share + 0.5))
    return hashed_index(units, key, seed).join(F.broadcast(n)).withColumn("is_val", first).drop("_index", "_n")


def grouped_split(units: DataFrame, key: str, group: str, share: float, seed: int, rounded: bool = True) -> DataFrame:
    """(group, n, chosen): whole groups in pseudorandom order until round(n * share) units are reached (or its floor).

    The last one may overshoot. Windows run over groups, not units.
    """
    sizes = units.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(shuffle_key(seed, group), group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("n").over(Window.partitionBy())
    target = F.round(whole * share) if rounded else F.floor(whole * share)
    return sizes.select(group, "n", (before < target).alias("chosen"))


def apportioned(units: DataFrame, group: str, total: int) -> DataFrame:
    """(group, n, quota): largest remainders, ties to the later group by name; the quotas sum to total."""
    sizes = units.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    exact = sizes.withColumn("_x", F.col("n") * F.lit(total) / F.sum("n").over(whole)).withColumn("_f", F.floor("_x"))
    left = F.lit(total) - F.sum("_f").over(whole)
    order = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_x") - F.col("_f"), 12)), F.desc(group)))
    return exact.withColumn("_left", left).withColumn("_r", order).select(group, "n", (F.col("_f") + (F.col("_r") <= F.col("_left")).cast("int")).cast("long").alias("quota"))


def stratified(units: DataFrame, key: str, group: str, total: int, seed: int) -> DataFrame:
    """The units that the quotas take of each group in pseudorandom order."""
    ranked = units.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(shuffle_key(seed, key), key)))
    return ranked.join(apportioned(units, group, total).select(group, "quota"), group).where("_r <= quota").drop("_r", "quota")


def cluster_weights(units: DataFrame, key: str, cluster: str, resamples: int, seed: int, two_stage: bool = False) -> DataFrame:
    """(b, key, w) for w > 0: how often each resample draws each unit, clusters being drawn with replacement.

    One stage: a drawn cluster brings all its units once. Two stages: it brings as many draws of its units.
    """
    clusters = units.groupBy(cluster).agg(F.count(F.lit(1)).alias("m"))
    k = clusters.count()
    numbered = hashed_index(clusters, cluster, seed, out="_c")
    draws = units.sparkSession.range(resamples * k).select((F.floor(F.col("id") / max(1, k)) + 1).cast("int").alias("b"), (F.col("id") % max(1, k)).alias("slot"))
    drawn = draws.withColumn("_c", hash_number(seed, "b", "slot") % max(1, k)).join(numbered, "_c")
    if not two_stage:
        times = drawn.groupBy("b", cluster).agg(F.count(F.lit(1)).alias("w"))
        return times.join(units.select(key, cluster), cluster).select("b", key, "w")
    members = units.select(key, cluster, (F.row_number().over(Window.partitionBy(cluster).orderBy(key)) - 1).alias("_m"))
    again = drawn.select("b", "slot", cluster, "m", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)).alias("turn")).withColumn("_m", hash_number(seed + 1, "b", "slot", "turn") % F.col("m"))
    return again.join(members, [cluster, "_m"]).groupBy("b", key).agg(F.count(F.lit(1)).alias("w"))


def contributions(acts: DataFrame, places: DataFrame, edges: DataFrame, stats: DataFrame, perms: int, kinds: tuple[str, ...]) -> DataFrame:
    """(perm, kind, uid, feature, active_sum, active_n, all_sum): what each chain adds to the sums behind a score.

    stats: (feature, frac, threshold) with one threshold a feature. Rows that add nothing are left out. A resample then
    only weighs these rows.
    """
    own = chain_sums(acts, places, edges, stats, perms, kinds)
    return own.where("active_n > 0 OR all_sum <> 0").select("perm", "kind", "uid", "feature", "active_sum", "active_n", "all_sum")


def unit_weights(units: DataFrame, key: str, resamples: int, seed: int) -> DataFrame:
    """(b, key, w) for w > 0: units drawn one by one with replacement, as many as there are."""
    own = units.select(key, F.col(key).alias("_unit"))
    return cluster_weights(own, key, "_unit", resamples, seed)


def least_active(contrib: DataFrame, least: int) -> DataFrame:
    """contrib with the active sums of the observed rows (perm 0) set to 0 where a chain has fewer than `least` active places.

    Shuffled rows stay as they are: they are what is subtracted.
    """
    few = (F.col("perm") == 0) & (F.col("active_n") < least)
    return contrib.withColumn("active_sum", F.when(few, 0.0).otherwise(F.col("active_sum"))).withColumn("active_n", F.when(few, F.lit(0)).otherwise(F.col("active_n")))


def _product(resamples: int):
    """Sums of a block of chains for a block of features in all resamples: weights times contributions, as one product."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["perm", "kind", "feature", "sums"])
        weight = np.frombuffer(b"".join(right["w"]), np.uint32).reshape(-1, resamples).astype(np.float64)
        row = pd.Series(np.arange(len(right)), index=right["uid"].to_numpy()).reindex(left["uid"].to_numpy())
        left = left[row.notna().to_numpy()]
        row = row.dropna().to_numpy(np.int64)
        column, keys = pd.MultiIndex.from_frame(left[["perm", "kind", "feature"]]).factorize()
        block = np.zeros((len(right), 3, len(keys)))
        block[row, :, column] = left[["active_sum", "active_n", "all_sum"]].to_numpy(np.float64)
        sums = (weight.T @ block.reshape(len(right), -1)).reshape(resamples, 3, len(keys))
        out = keys.to_frame(index=False, name=["perm", "kind", "feature"])
        return out.assign(sums=[np.ascontiguousarray(sums[:, :, k]).tobytes() for k in range(len(keys))])

    return run


def _parts_of_deltas(resamples: int, perms: int):
    """Of a feature in a graph: what its sums say at the identity less the mean over permutations, for each resample."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        near, whole = np.zeros(resamples), np.zeros(resamples)
        for perm, own in rows.groupby("perm")["sums"]:
            total = sum(np.frombuffer(x, np.float64).reshape(resamples, 3) for x in own)
            share = 1.0 if perm == 0 else -1.0 / max(perms, 1)
            near += share * total[:, 0] / np.maximum(total[:, 1], 1)
            whole += share * total[:, 2]
        return pd.DataFrame({"kind": rows["kind"].iloc[0], "feature": rows["feature"].iloc[0], "b": np.arange(resamples), "near": near, "whole": whole})

    return run


def _packed(resamples: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"uid": [key[0]], "w": [np.bincount(rows["b"], rows["w"], minlength=resamples).astype(np.uint32).tobytes()]})

    return run


def weighted_deltas(contrib: DataFrame, weights: DataFrame, stats: DataFrame, sizes: DataFrame, resamples: int, perms: int, kinds: tuple[str, ...]) -> DataFrame:
    """(b, kind, feature, delta): observed score less the mean over permutations, for resamples 0 to `resamples` - 1.

    contrib: as above; weights: (b, uid, w); stats: (feature, std); sizes: (uid, length). All are read several times, so
    cut them. Features and chains are dealt in blocks. Each chain's weights travel as one array to each block of
    features, contributions travel once, and what leaves a block is an array of sums for each permutation, graph and
    feature: no row is made for a resample, a chain and a feature. Denominators are at least 1; permutations without a
    row, and features that none of the drawn chains adds to, count as 0.
    """
    uid = contrib.schema["uid"].dataType.simpleString()
    chains = F.pmod(F.xxhash64("uid"), F.lit(-(-sizes.count() // BLOCK_CHAINS) or 1))
    packed = weights.select("uid", "b", "w").groupBy("uid").applyInPandas(_packed(resamples), f"uid {uid}, w binary").withColumn("chains", chains)
    own = contrib.withColumn("features", F.floor(F.col("feature") / BLOCK_FEATURES)).withColumn("chains", chains)
    spread = packed.join(own.select("features", "chains").distinct(), "chains").select(*[F.col(c).alias(c) for c in ("features", "chains", "uid", "w")])
    keys = ["features", "chains"]
    sums = own.select(*[F.col(c).alias(c) for c in own.columns]).groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(_product(resamples), "perm int, kind string, feature long, sums binary")
    parts = sums.groupBy("kind", "feature").applyInPandas(_parts_of_deltas(resamples, perms), "kind string, feature long, b int, near double, whole double")
    n = weights.join(sizes, "uid").groupBy("b").agg(F.sum(F.col("w") * F.col("length")).alias("_n"))
    std = stats.select(F.col("feature").cast("long").alias("feature"), "std").distinct()
    found = parts.join(F.broadcast(n), "b", "left").join(std, "feature")  # a row for each resample
    delta = (F.col("near") - F.col("whole") / F.greatest(F.coalesce("_n", F.lit(1)), F.lit(1))) / (F.col("std") + 1e-6)
    cells = std.select("feature", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    none = cells.join(contrib.select("kind", F.col("feature").cast("long").alias("feature")).distinct(), ["kind", "feature"], "left_anti")
    zeros = none.select(F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"), "kind", "feature", F.lit(0.0).alias("delta"))
    return found.select("b", "kind", "feature", delta.alias("delta")).unionByName(zeros)


def group_effects(values: DataFrame, value: str, in_a: Column, by: list[str]) -> DataFrame:
    """(by, d): effect size between two groups of features in each resample."""
    return values.groupBy(*by).agg(cohens_d(F.col(value), in_a).alias("d"))


def weighted_means(values: DataFrame, key: str, value: str, weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(b, by, mean): mean of the drawn units' values in each resample; units without a value don't count."""
    own = values.where(F.col(value).isNotNull() & ~F.isnan(value)).join(weights, key)
    return own.groupBy("b", *(by or [])).agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("mean"))


def paired_differences(values: DataFrame, key: str, kind: str, value: str, a: str, b: str, weights: DataFrame) -> DataFrame:
    """(b, mean_a, mean_b, difference) of each resample, over units that have both kinds: the same draws for both."""
    wide = values.groupBy(key).agg(*[F.avg(F.when(F.col(kind) == k, F.col(value))).alias(n) for k, n in ((a, "_x"), (b, "_y"))]).where("_x IS NOT NULL AND _y IS NOT NULL")
    means = [(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(n) for c, n in (("_x", "mean_a"), ("_y", "mean_b"))]
    return wide.join(weights, key).groupBy("b").agg(*means).withColumn("difference", F.col("mean_a") - F.col("mean_b"))


def correlation_trace(values: DataFrame, key: str, layer: str, value: str, against: DataFrame, weights: DataFrame) -> DataFrame:
    """(b, rho): in each resample the rank correlation over layers of the drawn units' means with `against` (layer, score).

    Draws are shared by the layers. Means are cut before they are ranked: a sum of doubles that is worked out twice may
    differ in its last bits, and a rank is found by its value.
    """
    means = cut(weighted_means(values, key, value, weights, [layer]).join(against, layer))
    both = ranked(ranked(means, "mean", ["b"], "_x"), "score", ["b"], "_y")
    return both.groupBy("b").agg(F.corr("_x", "_y").alias("rho"))


def intervals(trace: DataFrame, by: list[str], value: str, point: Column) -> DataFrame:
    """by, point, boot_mean, boot_sd, normal and percentile 95 % bounds, share above 0 and share not above 0, of resampled values."""
    sums = trace.groupBy(*by).agg(
        point.alias("point"), F.avg(value).alias("boot_mean"), F.stddev_samp(value).alias("boot_sd"), F.avg((F.col(value) > 0).cast("double")).alias("frac_pos"), F.avg((F.col(value) <= 0).cast("double")).alias("p_le_0")
    )
    ends = percentiles(trace, by, value, [0.025, 0.975])
    at = [F.max(F.when(F.col("frac") == f, F.col("value"))).alias(n) for f, n in ((0.025, "pct_lo"), (0.975, "pct_hi"))]
    ends = ends.groupBy(*by).agg(*at)
    out = sums.join(ends, by) if by else sums.crossJoin(ends)  # without groups, a row each
    return out.withColumn("normal_lo", F.col("point") - 1.96 * F.col("boot_sd")).withColumn("normal_hi", F.col("point") + 1.96 * F.col("boot_sd"))


def cluster_keys(units: DataFrame, key: str, paths: DataFrame, depth: int) -> DataFrame:
    """(key, cluster): the first `depth` dotted parts of a unit's path; a unit without one is a cluster of its own.

    paths: (key, path).
    """
    known = paths.select(key, F.concat_ws(".", F.slice(F.split("path", r"\."), 1, depth)).alias("cluster"))
    return units.select(key).join(known, key, "left").withColumn("cluster", F.coalesce("cluster", F.concat(F.lit("__singleton__"), F.col(key).cast("string"))))


def cluster_stats(units: DataFrame, cluster: str) -> DataFrame:
    """One row: clusters, units, and least, most, mean and middle of the clusters' sizes."""
    sizes = units.groupBy(cluster).agg(F.count(F.lit(1)).alias("m"))
    middle = percentiles(sizes, [], "m", [0.5]).select(F.col("value").alias("middle"))
    return sizes.agg(F.count(F.lit(1)).alias("clusters"), F.sum("m").alias("units"), F.min("m").alias("least"), F.max("m").alias("most"), F.avg("m").alias("mean")).crossJoin(middle)  # a row each
