"""How well features mark concepts: precision by place, recall by domain, selection on one split, report on another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandworks.operators.graphs import islands

THRESHOLDS = (0.0, 0.15, 0.5, 0.6, 0.8)


def hierarchy_concepts(places: DataFrame, path: DataFrame, depth: int) -> DataFrame:
    """(concept, uid, position, domain): every level of a chain's dotted path is a concept, the chain is the domain.

    path: (uid, path).
    """
    parts = F.split("path", r"\.")
    levels = path.select("uid", F.explode(F.sequence(F.lit(1), F.least(F.lit(depth), F.size(parts)))).alias("_k"), parts.alias("_p")).select("uid", F.concat_ws(".", F.slice("_p", 1, F.col("_k"))).alias("concept"))
    return places.join(levels, "uid").select("concept", "uid", "position", F.concat_ws("/", F.lit("chain"), "uid").alias("domain"))


def segment_concepts(marks: DataFrame, concept: str = "concept") -> DataFrame:
    """(concept, uid, position, domain): marked places, each unbroken stretch of a concept in a chain being a domain.

    marks: (concept, uid, position), a place once for each concept it has.
    """
    found = islands(marks.select("uid", "position", F.col(concept).alias("concept")), ["uid"], "position", "concept")
    return found.select("concept", "uid", "position", F.concat_ws("/", F.lit("run"), "uid", "run").alias("domain"))


def frequent(concepts: DataFrame, least: int = 10) -> DataFrame:
    """concepts of those concepts only that have `least` domains or more."""
    kept = concepts.groupBy("concept").agg(F.count_distinct("domain").alias("_d")).where(F.col("_d") >= least).select("concept")
    return concepts.join(kept, "concept", "left_semi")


def scaled(acts: DataFrame) -> DataFrame:
    """acts with z over its feature's maximum; a maximum of 0 or less counts as 1."""
    top = acts.groupBy("feature").agg(F.max("z").alias("_m")).withColumn("_m", F.when(F.col("_m") <= 0, 1.0).otherwise(F.col("_m")))
    return acts.join(top, "feature").withColumn("z", F.col("z") / F.col("_m")).drop("_m")


def scores(acts: DataFrame, concepts: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(concept, feature, threshold, precision, recall, f1) for pairs that meet in some place.

    acts: (uid, position, feature, z) scaled to 1; a place counts if z is above the threshold, for threshold 0 any z > 0.
    Precision is over places, recall over domains; pairs are found by the places they share, never by all with all.
    """
    steps = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    on = acts.select("uid", "position", "feature", "z", steps).where("z > threshold")
    fired = on.groupBy("feature", "threshold").agg(F.count(F.lit(1)).alias("_fired"))
    domains = concepts.groupBy("concept").agg(F.count_distinct("domain").alias("_domains"))
    hits = on.join(concepts, ["uid", "position"]).groupBy("concept", "feature", "threshold").agg(F.count(F.lit(1)).alias("_hit"), F.count_distinct("domain").alias("_found"))
    both = hits.join(fired, ["feature", "threshold"]).join(domains, "concept")
    p, r = F.col("_hit") / F.col("_fired"), F.col("_found") / F.col("_domains")
    return both.select("concept", "feature", "threshold", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def best_threshold(scored: DataFrame) -> DataFrame:
    """The best threshold of each (concept, feature): highest f1, then the lowest threshold."""
    order = Window.partitionBy("concept", "feature").orderBy(F.desc(F.round("f1", 12)), "threshold")
    return scored.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def best_feature(scored: DataFrame) -> DataFrame:
    """The best feature of each concept: highest f1, then the lowest threshold, then the lowest feature."""
    order = Window.partitionBy("concept").orderBy(F.desc(F.round("f1", 12)), "feature", "threshold")
    return best_threshold(scored).withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def best_concept(scored: DataFrame) -> DataFrame:
    """The best concept of each feature."""
    order = Window.partitionBy("feature").orderBy(F.desc(F.round("f1", 12)), "concept")
    return best_threshold(scored).withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def tested(selected: DataFrame, test_scores: DataFrame) -> DataFrame:
    """What was selected on one split, with its scores on the other; 0 where it never meets the concept there."""
    other = test_scores.select("concept", "feature", "threshold", F.col("f1").alias("test_f1"), F.col("precision").alias("test_precision"), F.col("recall").alias("test_recall"))
    out = selected.withColumnsRenamed({"f1": "val_f1", "precision": "val_precision", "recall": "val_recall"}).join(other, ["concept", "feature", "threshold"], "left")
    return out.fillna(0.0, ["test_f1", "test_precision", "test_recall"])


def select_and_test(acts: DataFrame, concepts: DataFrame, validation: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, least: int = 1) -> DataFrame:
    """(concept, feature, threshold, val_..., test_...): each concept's best feature and threshold on the validation chains,
    with precision, recall and f1 on the others.

    acts: scaled over all chains; validation: (uid); concepts with fewer than `least` domains are left out, and those
    that the validation chains or the others don't have.
    """
    own = frequent(concepts, least) if least > 1 else concepts

    def part(df: DataFrame, how: str) -> DataFrame:
        return df.join(validation.select("uid").distinct(), "uid", how)

    test = part(own, "left_anti")
    chosen = best_feature(scores(part(acts, "left_semi"), part(own, "left_semi"), thresholds))
    chosen = chosen.join(test.select("concept").distinct(), "concept", "left_semi")
    return tested(chosen, scores(part(acts, "left_anti"), test, thresholds))


def aligned(tested_: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: rows, aligned: how many have an f1 above the bound on both splits."""
    both = (F.col("val_f1") > least) & (F.col("test_f1") > least)
    return tested_.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(both.cast("int")), F.lit(0)).alias("aligned"))
