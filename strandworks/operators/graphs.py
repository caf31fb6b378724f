"""Neighbour graphs over positions in chains: edges are directed rows (uid, src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions.ordering import hash_number, hashed_index, shuffle_key


def band_edges(residues: DataFrame, width: int) -> DataFrame:
    """(uid, src, dst, sep): places of a chain at most `width` apart, not the place itself.

    Each place names its possible neighbours and an equi-join keeps those that exist, so cost is linear in the places.
    """
    offsets = F.explode(F.array(*[F.lit(k) for k in range(-width, width + 1) if k]))
    wanted = residues.select("uid", F.col("position").alias("src"), offsets.alias("_k")).select("uid", "src", (F.col("src") + F.col("_k")).alias("dst"), F.abs("_k").alias("sep"))
    return wanted.join(residues.select("uid", F.col("position").alias("dst")), ["uid", "dst"]).select("uid", "src", "dst", "sep")


def between_tokens(edges: DataFrame, tokens: DataFrame) -> DataFrame:
    """Edges whose ends lie in different tokens; tokens: (uid, position, token)."""
    src = tokens.select("uid", F.col("position").alias("src"), F.col("token").alias("_a"))
    dst = tokens.select("uid", F.col("position").alias("dst"), F.col("token").alias("_b"))
    return edges.join(src, ["uid", "src"]).join(dst, ["uid", "dst"]).where("_a <> _b").drop("_a", "_b")


def contact_edges(coords: DataFrame, cutoff: float, gap: int, zero: bool = True) -> DataFrame:
    """(uid, src, dst, sep, dist): places of a chain at most `cutoff` apart in space and at least `gap` along it.

    A grid with cells of side `cutoff`: a place meets only those in its own and the 26 cells round it, by an equi-join
    on chain and cell. zero: whether distance 0 counts (it doesn't for true contacts).
    """
    cell = [F.floor(F.col(c) / cutoff).alias(f"c{c}") for c in "xyz"]
    a = coords.select("uid", F.col("position").alias("src"), *[F.col(c).alias(f"a{c}") for c in "xyz"], *cell)
    near = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("ijk", (x, y, z))]) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]))
    a = a.withColumn("_n", near).select("uid", "src", "ax", "ay", "az", *[(F.col(f"c{c}") + F.col("_n")[n]).alias(f"c{c}") for c, n in zip("xyz", "ijk")])
    b = coords.select("uid", F.col("position").alias("dst"), *[F.col(c).alias(f"b{c}") for c in "xyz"], *cell)
    dist = F.sqrt(sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz"), F.lit(0.0)))
    met = a.join(b, ["uid", "cx", "cy", "cz"]).withColumn("sep", F.abs(F.col("src") - F.col("dst"))).where((F.col("src") != F.col("dst")) & (F.col("sep") >= gap)).withColumn("dist", dist)
    return met.where((F.col("dist") <= cutoff) & (F.lit(True) if zero else F.col("dist") > 0)).select("uid", "src", "dst", "sep", "dist")


def neighbour_counts(residues: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, position, degree), 0 for places without an edge."""
    degree = edges.groupBy("uid", F.col("src").alias("position")).agg(F.count(F.lit(1)).alias("degree"))
    return residues.select("uid", "position").join(degree, ["uid", "position"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def weighted(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Edges with w = 1 / degree of their src (in each of `by`)."""
    keys = [*(by or []), "uid", "src"]
    return edges.join(edges.groupBy(*keys).agg((1 / F.count(F.lit(1))).alias("w")), keys)


def neighbour_means(residues: DataFrame, edges: DataFrame, values: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(uid, position, by, smoothed): mean of the neighbours' values, 0 without neighbours; for each of `by` that has values."""
    keys = ["uid", "position", *(by or [])]
    own = edges.join(values.select("uid", F.col("position").alias("dst"), *(by or []), F.col(value).alias("_v")), ["uid", "dst"])
    mean = own.groupBy("uid", F.col("src").alias("position"), *(by or [])).agg(F.avg("_v").alias("smoothed"))
    places = residues.select("uid", "position")
    if by:
        places = places.crossJoin(F.broadcast(values.select(*by).distinct()))  # a result row each
    return places.join(mean, keys, "left").withColumn("smoothed", F.coalesce("smoothed", F.lit(0.0)))


def degree_matched_null(residues: DataFrame, edges: DataFrame, seed: int) -> DataFrame:
    """(uid, src, dst): as many partners for each place as it has edges, by a pseudorandom order of its chain.

    Every place has an order of its own over all other places of its chain, so the partners of one say nothing of those
    of another. Places choose one by one, so the graph is directed. Ranked pairs are those of a chain only.
    """
    degree = neighbour_counts(residues, edges).where("degree > 0").select("uid", F.col("position").alias("src"), "degree")
    pairs = degree.join(residues.select("uid", F.col("position").alias("dst")), "uid").where("src <> dst")
    rank = F.row_number().over(Window.partitionBy("uid", "src").orderBy(shuffle_key(seed, "uid", "src", "dst"), "dst"))
    return pairs.withColumn("_r", rank).where("_r <= degree").select("uid", "src", "dst")


def global_null(residues: DataFrame, edges: DataFrame, seed: int) -> DataFrame:
    """(uid, src, other, dst): for every edge a partner from the places of all chains, drawn with replacement."""
    n = residues.agg(F.count(F.lit(1)).alias("_n"))  # one row
    numbered = hashed_index(residues.select(F.struct("uid", "position").alias("place"), F.concat_ws(":", "uid", "position").alias("_k")), "_k", seed)
    drawn = edges.join(F.broadcast(n)).select("uid", "src", (hash_number(seed + 1, "uid", "src", "dst") % F.col("_n")).alias("_index"))
    return drawn.join(numbered, "_index").select("uid", "src", F.col("place.uid").alias("other"), F.col("place.position").alias("dst"))


def matched_controls(residues: DataFrame, contacts: DataFrame, seed: int) -> DataFrame:
    """(uid, src, dst, c_src, c_dst) for contacts with src < dst: a pair of the chain with the same separation and out of
    contact, drawn with replacement; null where there is none."""
    true = contacts.where("src < dst").select("uid", "src", "dst", (F.col("dst") - F.col("src")).alias("sep")).distinct()
    places = residues.select("uid", "position")
    wanted = true.select("uid", "sep").distinct().join(places, "uid").select("uid", "sep", F.col("position").alias("c_src"), (F.col("position") + F.col("sep")).alias("c_dst"))
    there = wanted.join(places.withColumnRenamed("position", "c_dst"), ["uid", "c_dst"], "left_semi")
    free = there.join(true.select("uid", F.col("src").alias("c_src"), F.col("dst").alias("c_dst")), ["uid", "c_src", "c_dst"], "left_anti")
    numbered = free.withColumn("_i", F.row_number().over(Window.partitionBy("uid", "sep").orderBy("c_src")) - 1)
    sizes = free.groupBy("uid", "sep").agg(F.count(F.lit(1)).alias("_m"))
    picked = true.join(sizes, ["uid", "sep"], "left").withColumn("_i", hash_number(seed, "uid", "src", "dst") % F.col("_m"))
    return picked.join(numbered, ["uid", "sep", "_i"], "left").select("uid", "src", "dst", "c_src", "c_dst")


def best_chain(scores: DataFrame, by: list[str], chain: str, score: str, ordinal: str) -> DataFrame:
    """(by, chain): the chain of each group with the best score, the first of equal ones."""
    return scores.groupBy(*by).agg(F.max_by(chain, F.struct(F.col(score), -F.col(ordinal))).alias(chain))


def islands(rows: DataFrame, group: list[str], position: str, mark: str) -> DataFrame:
    """rows with `run`: the first place of the stretch of places in a row that share group and mark."""
    order = F.row_number().over(Window.partitionBy(*group, mark).orderBy(position))
    keyed = rows.withColumn("_island", F.col(position) - order)
    return keyed.withColumn("run", F.min(position).over(Window.partitionBy(*group, mark, "_island"))).drop("_island")


def project_tokens(values: DataFrame, spans: DataFrame, value: str) -> DataFrame:
    """(uid, position, feature, value): token values brought to places; spans: (uid, token, position, w)."""
    return values.join(spans, ["uid", "token"]).groupBy("uid", "position", "feature").agg(F.sum(F.col(value) * F.col("w")).alias(value))


