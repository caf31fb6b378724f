"""Connected components of a graph too large for any one machine: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered


def _either(pairs: DataFrame) -> DataFrame:
    """Both structs of each row; no union, which would leave the one partition of a small frame."""
    return pairs.select(F.explode(F.array("x", "y")).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is tied to the least of u and its neighbours. edges: (u, v) with u > v."""
    both = _either(edges.select(F.struct("u", "v").alias("x"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")).alias("y")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its neighbours below it are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.struct(F.col("v").alias("u"), F.col("m").alias("v")).alias("x"), F.struct("u", F.col("m").alias("v")).alias("y"))
    return _either(tied).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b), two long columns; root is the component's least node.

    The links are rewritten until they are stars: every node above has one node below it, which has none. A node's
    neighbours are only ever folded by min(), so one with very many of them is summed up before it is dealt. Loops and
    repeated links don't matter; without links the result is empty.
    """

    def is_stars(e: DataFrame) -> bool:
        ends = [F.struct(F.col(end).alias("n"), F.lit(above).alias("above"), F.lit(1 - above).alias("below")) for end, above in (("u", 1), ("v", 0))]
        seen = _either(e.select(ends[0].alias("x"), ends[1].alias("y"))).groupBy("n").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
        return seen.where("above > 1 OR (above > 0 AND below > 0)").isEmpty()

    now, _ = gathered(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not is_stars(now):
        now, _ = gathered(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
