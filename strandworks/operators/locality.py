"""The locality score: how much larger neighbour means are where a feature is active, over sparse activations.

Activations are rows (uid, position, feature, z) with z > 0 only; what zero rows add is restored in closed form, from
the number of places. For feature j, with smoothed_i the mean of z over i's neighbours:

    d = (mean of smoothed over active places - mean of smoothed over all places) / (population std of z + 1e-6)

Over all places smoothed sums to sum_j z_j c_j, c_j being the sum of 1 / degree over the places that have j as a
neighbour; over active places it is a sum over edges whose src is active. No row is made for a zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions.lineage import cut
from strandworks.functions.stats import percentiles, spearman
from strandworks.operators.graphs import matched_controls
from strandworks.operators.vectors import dot, norm


def feature_stats(acts: DataFrame, places: DataFrame, fractions: list[float]) -> DataFrame:
    """(feature, frac, n, mean, std, threshold): per feature over all places, zeros included.

    threshold: the exact percentile 1 - frac with linear interpolation.
    """
    total = places.agg(F.count(F.lit(1)).alias("_places"))
    cuts = percentiles(acts, ["feature"], "z", [1 - f for f in fractions], places=total)
    cuts = cuts.select("feature", F.round(1 - F.col("frac"), 12).alias("frac"), F.col("value").alias("threshold"))
    return spread_stats(acts, places).join(cuts, "feature").select("feature", "frac", "n", "mean", "std", "threshold")


def spread_stats(acts: DataFrame, places: DataFrame) -> DataFrame:
    """(feature, n, mean, std): active places, mean and population deviation over all places."""
    total = places.agg(F.count(F.lit(1)).alias("_places"))
    sums = acts.where("z > 0").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("_s1"), F.sum(F.col("z") * F.col("z")).alias("_s2")).join(F.broadcast(total))  # one row
    mean = F.col("_s1") / F.col("_places")
    return sums.select("feature", "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("_s2") / F.col("_places") - mean * mean)).alias("std"))


def fixed_stats(acts: DataFrame, places: DataFrame, factors: list[float]) -> DataFrame:
    """As feature_stats, with thresholds that are factors of the median of all activations above 0; frac is the factor."""
    middle = percentiles(acts.where("z > 0"), [], "z", [0.5]).select(F.col("value").alias("_s"))  # one row
    steps = F.explode(F.array(*[F.lit(float(f)) for f in factors])).alias("frac")
    return spread_stats(acts, places).join(F.broadcast(middle)).select("*", steps).select("feature", "frac", "n", "mean", "std", (F.col("frac") * F.col("_s")).alias("threshold"))


def locality(acts: DataFrame, places: DataFrame, edges: DataFrame, stats: DataFrame, min_active: int = 5) -> DataFrame:
    """(perm, kind, feature, frac, n_active, d).

    acts: (perm, uid, position, feature, z > 0); edges: (kind, uid, src, dst, w) with w = 1 / degree, and `other`, the
    chain of dst, where edges leave their chain; stats as above, fixed over permutations. Every join is on a chain's
    places, dealt by their keys.
    """
    total = places.agg(F.count(F.lit(1)).alias("_places"))
    edges = edges if "other" in edges.columns else edges.withColumn("other", F.col("uid"))
    pull = edges.groupBy("kind", F.col("other").alias("uid"), F.col("dst").alias("position")).agg(F.sum("w").alias("_c"))
    everywhere = acts.join(pull, ["uid", "position"]).groupBy("perm", "kind", "feature").agg(F.sum(F.col("z") * F.col("_c")).alias("_all"))
    judged = acts.join(stats.select("feature", "frac", "threshold", "std"), "feature")
    # no place is left out here, so that features which are nowhere active keep their row
    n_active = judged.groupBy("perm", "feature", "frac").agg(F.count(F.when(F.col("z") > F.col("threshold"), 1)).alias("n_active"), F.max("std").alias("std"))
    pushed = judged.where("z > threshold").select("perm", "uid", F.col("position").alias("src"), "feature", "frac").join(edges, ["uid", "src"])
    beside = acts.select("perm", F.col("uid").alias("other"), F.col("position").alias("dst"), "feature", "z")
    near = pushed.join(beside, ["perm", "other", "dst", "feature"]).groupBy("perm", "kind", "feature", "frac").agg(F.sum(F.col("z") * F.col("w")).alias("_near"))
    kinds = edges.select("kind").distinct()
    grid = n_active.join(F.broadcast(kinds))  # one row a graph
    out = grid.join(everywhere, ["perm", "kind", "feature"], "left").join(near, ["perm", "kind", "feature", "frac"], "left").join(F.broadcast(total))
    n = F.coalesce("n_active", F.lit(0))
    d = (F.coalesce("_near", F.lit(0.0)) / F.greatest(n, F.lit(1)) - F.coalesce("_all", F.lit(0.0)) / F.col("_places")) / (F.col("std") + 1e-6)
    return out.select("perm", "kind", "feature", "frac", n.alias("n_active"), F.when(n < min_active, 0.0).otherwise(d).alias("d"))


def permuted_acts(acts: DataFrame, permutation: DataFrame) -> DataFrame:
    """(perm, uid, position, feature, z): activations moved by (perm, uid, position, source)."""
    moved = acts.select("uid", F.col("position").alias("source"), "feature", "z")
    return permutation.join(moved, ["uid", "source"]).select("perm", "uid", "position", "feature", "z")


def deltas(scores: DataFrame) -> DataFrame:
    """(kind, feature, frac, observed, shuffled, delta): score at the identity against the mean over permutations."""
    out = scores.groupBy("kind", "feature", "frac").agg(F.max(F.when(F.col("perm") == 0, F.col("d"))).alias("observed"), F.avg(F.when(F.col("perm") > 0, F.col("d"))).alias("shuffled"))
    return out.withColumn("delta", F.col("observed") - F.coalesce("shuffled", F.lit(0.0)))


def score_table(scores: DataFrame, kinds: tuple[str, ...] = ("struct", "seq")) -> DataFrame:
    """A row for each feature: observed, shuffled mean and delta of each kind of graph, in columns named by kind."""
    own = deltas(scores)
    cells = [F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k in kinds for c in ("observed", "shuffled", "delta")]
    return own.groupBy("feature").agg(*cells)


def setting_stability(values: DataFrame, setting: str, key: str, value: str) -> DataFrame:
    """(low, high, n, rho): rank correlation of the keys' values between each setting and the next one."""
    values = cut(values.select(setting, key, value))  # ranks are found by value, so values are worked out once
    steps = values.select(setting).distinct().select(F.col(setting).alias("low"), F.lead(setting).over(Window.orderBy(setting)).alias("high")).where("high IS NOT NULL")  # a row for each setting
    a = values.join(F.broadcast(steps), F.col(setting) == F.col("low")).select("low", "high", key, F.col(value).alias("_a"))
    both = a.join(values.select(F.col(setting).alias("high"), key, F.col(value).alias("_b")), ["high", key])
    return spearman(both, "_a", "_b", ["low", "high"])


def deviation(values: DataFrame, by: list[str], base: str, others: list[str], floor: float = 0.01) -> DataFrame:
    """by and max_dev_pct: how far the others lie at most from the base, in per cent of its size, which is `floor` at least."""
    far = F.greatest(*[F.abs(F.col(o) - F.col(base)) for o in others]) if len(others) > 1 else F.abs(F.col(others[0]) - F.col(base))
    return values.select(*by, base, *others, (100 * far / F.greatest(F.abs(base), F.lit(floor))).alias("max_dev_pct"))


def null_summary(deltas_: DataFrame, by: str, value: str, base: str) -> DataFrame:
    """(by, n, mean, median, frac_pos, p95, ratio): deltas under each graph; ratio: their mean over that of the graph `base`."""
    ends = percentiles(deltas_, [by], value, [0.5, 0.95]).groupBy(by).agg(*[F.max(F.when(F.col("frac") == f, F.col("value"))).alias(n) for f, n in ((0.5, "median"), (0.95, "p95"))])
    sums = deltas_.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("double")).alias("frac_pos"))
    whole = deltas_.where(F.col(by) == base).agg(F.avg(value).alias("_base"))  # one row
    return sums.join(ends, by).join(F.broadcast(whole)).select(by, "n", "mean", "median", "frac_pos", "p95", (F.col("mean") / F.nullif("_base", F.lit(0.0))).alias("ratio"))


def dense_scores(values: DataFrame, edges: DataFrame, frac: float) -> DataFrame:
    """(feature, d) where values may be negative and so no zero is left out: values (uid, position, feature, z)."""
    cuts = percentiles(values, ["feature"], "z", [1 - frac]).select("feature", F.col("value").alias("threshold"))
    stat = values.groupBy("feature").agg(F.stddev_pop("z").alias("std")).join(cuts, "feature")
    near = edges.join(values.select("uid", F.col("position").alias("dst"), "feature", "z"), ["uid", "dst"]).groupBy("uid", F.col("src").alias("position"), "feature").agg(F.avg("z").alias("s"))
    own = values.join(near, ["uid", "position", "feature"], "left").join(stat, "feature").withColumn("s", F.coalesce("s", F.lit(0.0)))
    on = F.col("z") > F.col("threshold")
    return own.groupBy("feature").agg(F.coalesce((F.avg(F.when(on, F.col("s"))) - F.avg("s")) / (F.max("std") + 1e-6), F.lit(0.0)).alias("d"))


def chain_cosine(vectors: DataFrame, contacts: DataFrame, seed: int, least: int = 5) -> DataFrame:
    """(uid, contact, control, locality): mean cosine of a chain's contacts less that of as many pairs out of contact.

    vectors: (uid, position, vec); each contact is matched by a pair of the same separation. Chains shorter than `least`,
    without contacts or without controls have no row.
    """
    unit = vectors.select("uid", "position", "vec", norm("vec").alias("n"))
    pairs = matched_controls(vectors, contacts, seed)
    both = pairs.select("uid", "src", "dst", F.lit(1).alias("true")).unionByName(pairs.where("c_src IS NOT NULL").select("uid", F.col("c_src").alias("src"), F.col("c_dst").alias("dst"), F.lit(0).alias("true")))
    a = unit.select("uid", F.col("position").alias("src"), F.col("vec").alias("va"), F.col("n").alias("na"))
    b = unit.select("uid", F.col("position").alias("dst"), F.col("vec").alias("vb"), F.col("n").alias("nb"))
    cosine = both.join(a, ["uid", "src"]).join(b, ["uid", "dst"]).select("uid", "true", (dot("va", "vb") / ((F.col("na") + 1e-12) * (F.col("nb") + 1e-12))).alias("s"))
    means = cosine.groupBy("uid").agg(F.avg(F.when(F.col("true") == 1, F.col("s"))).alias("contact"), F.avg(F.when(F.col("true") == 0, F.col("s"))).alias("control"))
    long = vectors.groupBy("uid").agg(F.count(F.lit(1)).alias("_l")).where(F.col("_l") >= least).select("uid")
    return means.where("contact IS NOT NULL AND control IS NOT NULL").join(long, "uid", "left_semi").withColumn("locality", F.col("contact") - F.col("control"))


def group_ratios(values: DataFrame, group: str) -> DataFrame:
    """(group, feature, enrichment): mean of a feature over a group's rows, over its mean over all rows + 1e-6."""
    inside, whole = values.groupBy(group, "feature").agg(F.avg("z").alias("_m")), values.groupBy("feature").agg(F.avg("z").alias("_w"))
    return inside.join(whole, "feature").select(group, "feature", (F.col("_m") / (F.col("_w") + 1e-6)).alias("enrichment"))


def enrichment(acts: DataFrame, places: DataFrame, groups: DataFrame, least: int = 50, above: float = 5.0, top: int = 50) -> DataFrame:
    """(fold, feature, enrichment): mean in a group over the global mean + 1e-6, where above the bound.

    groups: (uid, fold); only the `top` groups by places are tried, and of those the ones with `least` places or more.
    """
    sized = places.join(groups, "uid").groupBy("fold").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("m"), "fold").limit(top).where(F.col("m") >= least)
    total = places.agg(F.count(F.lit(1)).alias("_places"))
    everywhere = acts.groupBy("feature").agg(F.sum("z").alias("_s")).join(F.broadcast(total))
    inside = acts.join(groups, "uid").join(F.broadcast(sized), "fold").groupBy("fold", "feature").agg((F.sum("z") / F.max("m")).alias("mean"))  # at most `top` rows
    ratio = F.col("mean") / (F.col("_s") / F.col("_places") + 1e-6)
    return inside.join(everywhere, "feature").select("fold", "feature", ratio.alias("enrichment")).where(F.col("enrichment") > above)


