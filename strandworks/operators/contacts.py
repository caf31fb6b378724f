"""Contact prediction from vectors at the places of chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandworks.operators.vectors import dot, norm


def apc_scores(vectors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(uid, i, j, score), i < j: cosine of two places less what their row and column means explain.

    vectors: (uid, position, vec). A row's mean is the product of its unit vector with the chain's mean unit vector, and
    the mean of all is that vector's square, so only pairs i < j are made. by: further columns that a chain is keyed by.
    """
    keys = ["uid", *(by or [])]
    length = norm("vec")
    unit = vectors.select(*keys, "position", F.transform("vec", lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0)).alias("u"))
    dims = unit.select(*keys, F.posexplode("u").alias("k", "x")).groupBy(*keys, "k").agg(F.avg("x").alias("x"))
    # one vector for each chain
    middle = dims.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("_s")).select(*keys, F.col("_s.x").alias("mean"))
    rows = unit.join(middle, keys).select(*keys, "position", "u", dot("u", "mean").alias("r"), dot("mean", "mean").alias("w"))
    a = rows.select(*keys, F.col("position").alias("i"), F.col("u").alias("ua"), F.col("r").alias("ra"), "w")
    b = rows.select(*keys, F.col("position").alias("j"), F.col("u").alias("ub"), F.col("r").alias("rb"))
    pairs = a.join(b, keys).where("i < j")
    return pairs.select(*keys, "i", "j", (dot("ua", "ub") - F.col("ra") * F.col("rb") / (F.col("w") + 1e-8)).alias("score"))


def top_precision(scores: DataFrame, contacts: DataFrame, lengths: DataFrame, share: float = 0.2, gap: int = 12, by: list[str] | None = None) -> DataFrame:
    """(by, uid, k, precision): of the k = max(1, int(share * length)) best pairs at least `gap` apart, those in contact.

    contacts: (uid, src, dst); chains without a contact are left out.
    """
    keys = [*(by or []), "uid"]
    true = contacts.where("src < dst").select("uid", F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1).alias("_c")).distinct()
    pairs = scores.where(F.col("j") - F.col("i") >= gap).join(true, ["uid", "i", "j"], "left").join(lengths.join(true.select("uid").distinct(), "uid", "left_semi"), "uid")
    k = F.greatest(F.lit(1), F.floor(F.col("length") * share).cast("int"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "i", "j"))
    return pairs.withColumn("k", k).withColumn("_r", rank).where("_r <= k").groupBy(*keys).agg(F.max("k").alias("k"), F.avg(F.coalesce("_c", F.lit(0)).cast("double")).alias("precision"))


def evaluable(chains: DataFrame, contacts: DataFrame, least: int = 24, most: int = 1000, gap: int = 12) -> DataFrame:
    """(uid, length) of the chains that can be evaluated: a structure of the sequence's length, within bounds, with a contact.

    chains: (uid, length, resolved), resolved null where there is no structure.
    """
    true = contacts.where(F.col("dst") - F.col("src") >= gap).select("uid").distinct()
    good = F.col("resolved").isNotNull() & (F.col("resolved") == F.col("length")) & F.col("length").between(least, most)
    return chains.where(good).join(true, "uid", "left_semi").select("uid", "length")


def subset_precision(vectors: DataFrame, subsets: DataFrame, contacts: DataFrame, lengths: DataFrame, share: float = 0.2, gap: int = 12) -> DataFrame:
    """(kind, uid, k, precision): contact precision from the chosen features only. subsets: (kind, feature), a small table."""
    own = subsets.groupBy("kind").agg(F.array_sort(F.collect_set("feature")).alias("_f"))  # a row for each kind
    cut = vectors.join(F.broadcast(own)).select("kind", "uid", "position", F.transform("_f", lambda f: F.get("vec", f.cast("int"))).alias("vec"))
    return top_precision(apc_scores(cut, ["kind"]), contacts, lengths, share, gap, ["kind"])


def collapsed(precision: DataFrame, draw: str = r"_\d+$") -> DataFrame:
    """(kind, uid, precision): the draws of one random kind (kind_0, kind_1, ...) averaged for each chain."""
    return precision.groupBy(F.regexp_replace("kind", draw, "").alias("kind"), "uid").agg(F.avg("precision").alias("precision"))
