"""Features against annotations of places: correlations, their p and q, and how many features say something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.functions.lineage import cut
from strandworks.functions.stats import correlation_p, percentiles, rank_correlations, with_bh

#: One-letter classes of secondary structure (fixed values).
STRUCTURE_GROUPS = {"helix": ("H", "G", "I"), "strand": ("E", "B"), "turn": ("T", "S"), "coil": ("-", "C", "", " ")}
BURIED, EXPOSED = 0.1, 0.4


def in_classes(column: str, classes: tuple) -> Column:
    """1.0 where the class is one of those, 0.0 elsewhere, null included."""
    return F.coalesce(F.col(column).isin(*classes), F.lit(False)).cast("double")


def structure_group(column: Column) -> Column:
    """helix, strand, turn or coil; null for a class that is none of them, and where there is none."""
    out: Column | None = None
    for group, classes in STRUCTURE_GROUPS.items():
        out = F.when(column.isin(*classes), group) if out is None else out.when(column.isin(*classes), group)
    return out


def surface_kind(column: str, buried: float = BURIED, exposed: float = EXPOSED) -> Column:
    """`buried`, `exposed`, or null between the bounds."""
    return F.when(F.col(column) < buried, "buried").when(F.col(column) > exposed, "exposed")


def above_median(rows: DataFrame, value: str, out: str) -> DataFrame:
    """rows with whether the value is above the median of all that have one; null where there is none."""
    middle = percentiles(rows, [], value, [0.5]).select(F.col("value").alias("_middle"))  # one row
    return rows.join(F.broadcast(middle), how="left").withColumn(out, F.when(~F.isnan(value), F.col(value) > F.col("_middle"))).drop("_middle")


def correlations(acts: DataFrame, marks: DataFrame, names: list[str], features: DataFrame | None = None) -> DataFrame:
    """(feature, annotation, n, r, p): Pearson's r of every feature with every annotation, over the places of marks.

    acts: (uid, position, feature, z > 0); what zeros add is known from the sums over marks, so no row is made for a
    zero. marks: (uid, position, names...). Without variance on either side r is 0 and p is 1; features: (feature), to
    have rows for features that are nowhere active too.
    """
    whole = marks.agg(F.count(F.lit(1)).alias("n"), *[f.alias(n) for c in names for f, n in ((F.sum(c), f"_y_{c}"), (F.sum(F.col(c) * F.col(c)), f"_yy_{c}"))])  # one row
    own = acts.where("z > 0").join(marks, ["uid", "position"])
    sums = own.groupBy("feature").agg(F.sum("z").alias("_z"), F.sum(F.col("z") * F.col("z")).alias("_zz"), *[F.sum(F.col("z") * F.col(c)).alias(f"_zy_{c}") for c in names])
    sums = sums if features is None else features.select("feature").distinct().join(sums, "feature", "left")
    wide = sums.join(F.broadcast(whole))
    zero = F.lit(0.0)

    def r(c: str) -> Column:
        n, z, zz, zy, y, yy = F.col("n"), F.coalesce("_z", zero), F.coalesce("_zz", zero), F.coalesce(f"_zy_{c}", zero), F.col(f"_y_{c}"), F.col(f"_yy_{c}")
        spread = (n * zz - z * z) * (n * yy - y * y)
        # relative to what it is the difference of, rounding leaves no variance where there is none
        return F.when((n * zz - z * z > 1e-12 * n * zz) & (n * yy - y * y > 1e-12 * n * yy), (n * zy - z * y) / F.sqrt(spread)).otherwise(0.0)

    long = wide.select("feature", "n", F.explode(F.array(*[F.struct(F.lit(c).alias("annotation"), r(c).alias("r")) for c in names])).alias("_c")).select("feature", "_c.annotation", "n", "_c.r")
    r_ = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col("r")))
    return long.withColumn("r", r_).withColumn("p", correlation_p(F.col("r"), F.col("n")))


def interpretability(acts: DataFrame, marks: DataFrame, names: list[str], features: DataFrame | None = None) -> DataFrame:
    """correlations with q: Benjamini-Hochberg over the features of each annotation on its own."""
    return with_bh(cut(correlations(acts, marks, names, features)), "p", ["annotation"])  # q is found by p, so p is worked out once


def any_significant(tested: DataFrame, level: float = 0.05) -> DataFrame:
    """(feature, significant): whether any annotation's own q is below the level. tested: (feature, annotation, q)."""
    return tested.groupBy("feature").agg(F.max(F.coalesce(F.col("q") < level, F.lit(False))).alias("significant"))


def least_p(tested: DataFrame, level: float = 0.05) -> DataFrame:
    """(feature, p, q, significant): the least p over the annotations, and its q over the features. Not any_significant:
    here the correction comes after the choice."""
    least = cut(tested.groupBy("feature").agg(F.min("p").alias("p")))  # q is found by p, so p is worked out once
    return with_bh(least, "p", []).withColumn("significant", F.col("q") < level)


def share_significant(flags: DataFrame) -> DataFrame:
    """One row: features, significant, pct of a table (feature, significant)."""
    hits = F.sum(F.col("significant").cast("int"))
    return flags.agg(F.count(F.lit(1)).alias("features"), F.coalesce(hits, F.lit(0)).alias("significant"), (100 * hits / F.count(F.lit(1))).alias("pct"))


def rank_annotation(values: DataFrame, annotation: str, name: str) -> DataFrame:
    """(feature, annotation, n, r, p): rank correlation of each feature with a continuous annotation.

    values: (uid, position, feature, z, annotation), zeros included; places without the annotation don't count.
    """
    out = rank_correlations(values, ["z", annotation], ["feature"]).select("feature", F.lit(name).alias("annotation"), "n", F.coalesce("rho", F.lit(0.0)).alias("r"))
    return out.withColumn("p", correlation_p(F.col("r"), F.col("n")))


def frequent_sites(marks: DataFrame, names: list[str], least: int = 10) -> list[str]:
    """Those of the binary annotations that mark `least` places or more. One row comes to the driver."""
    row = marks.agg(*[F.sum((F.col(n) > 0).cast("int")).alias(n) for n in names]).first()
    return [n for n in names if (row[n] or 0) >= least]


def extended(values: DataFrame, marks: DataFrame, continuous: list[str], sites: list[str], least: int = 10, level: float = 0.05) -> DataFrame:
    """(feature, significant) over continuous annotations by ranks and binary sites by Pearson's r, each with its own q;
    sites that mark fewer than `least` places are left out."""
    joined = values.join(marks, ["uid", "position"])
    found = [rank_annotation(joined, c, c) for c in continuous]
    kept = frequent_sites(marks, sites, least)
    if kept:
        found.append(correlations(values, marks, kept, values))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return any_significant(with_bh(cut(out), "p", ["annotation"]), level)
