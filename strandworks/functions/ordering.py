"""Pseudorandom orders that any engine can repeat: the MD5 of a seed and a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(seed: int, *cols: str | Column) -> Column:
    """A key to order by; equal seeds give equal orders in every engine that has MD5."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]).cast("binary"))


def hash_number(seed: int, *cols: str | Column) -> Column:
    """A whole number from 0 to 2^32 - 1 from the same key."""
    return F.conv(F.substring(shuffle_key(seed, *cols), 1, 8), 16, 10).cast("long")


def within_group_permutation(rows: DataFrame, group: list[str], position: str, perms: int, seed: int = 42) -> DataFrame:
    """(perm, *group, position, source): for each permutation the place whose value moves to `position`; 0 is the identity.

    Both sides rank the same rows, once by place and once by the pseudorandom key, inside (perm, group): no place is
    lost, none leaves its group.
    """
    many = rows.select(*group, position).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(perms))))
    keys = ["perm", *group]
    straight = many.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(position)))
    mixed = many.select(*keys, F.col(position).alias("source"), F.row_number().over(Window.partitionBy(*keys).orderBy(shuffle_key(seed, "perm", *group, position), position)).alias("_rank"))
    moved = straight.join(mixed, [*keys, "_rank"]).select(*keys, position, "source")
    same = rows.select(F.lit(0).alias("perm"), *group, position, F.col(position).alias("source"))
    return same.unionByName(moved)


def hashed_index(rows: DataFrame, key: str, seed: int, by: list[str] | None = None, out: str = "_index") -> DataFrame:
    """rows with their number, from 0, in the pseudorandom order of key, of the whole or of each group.

    Counts over 4096 ranges of the hash tell where a range begins, and rows are numbered inside their range: no task
    puts a group in order. Equal keys are numbered in any order.
    """
    by = by or []
    keyed = rows.withColumn("_hash", shuffle_key(seed, key)).withColumn("_range", F.substring("_hash", 1, 3))
    counts = keyed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_c"))
    ends = F.sum("_c").over(Window.partitionBy(*by).orderBy("_range"))
    begins = counts.select(*by, "_range", (ends - F.col("_c")).alias("_begin"))
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_hash", key)) - 1
    joined = keyed.join(begins if by else F.broadcast(begins), [*by, "_range"])  # without groups, 4096 rows at most
    return joined.withColumn(out, F.col("_begin") + inside).select(*rows.columns, out)


def first_hashed(rows: DataFrame, key: str, n: int | Column, seed: int, by: list[str] | None = None) -> DataFrame:
    """n rows chosen without replacement by the pseudorandom order, of the whole or of each group."""
    return hashed_index(rows, key, seed, by, "_rank").where(F.col("_rank") < n).drop("_rank")
