"""Series of values along layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions.lineage import cut
from strandworks.functions.stats import correlation_p, spearman


def sign_crossings(rows: DataFrame, by: list[str], layer: str, value: str) -> DataFrame:
    """(by, low, high, crossing): the first two layers in a row between which the value changes sign, and where it is 0.

    Where is interpolated linearly. A pair with a zero, null or NaN isn't looked at; groups without a change have no row.
    """
    w = Window.partitionBy(*by).orderBy(layer)
    a, b, low, high = map(F.col, ("_a", "_b", "low", "high"))
    pairs = rows.select(*by, F.col(layer).alias("low"), F.col(value).alias("_a"), F.lead(layer).over(w).alias("high"), F.lead(value).over(w).alias("_b"))
    changed = pairs.where(~F.isnan("_a") & ~F.isnan("_b") & (((a > 0) & (b < 0)) | ((a < 0) & (b > 0))))
    first = changed.groupBy(*by).agg(F.min(F.struct("low", "high", (low + a / (a - b) * (high - low)).alias("crossing"))).alias("_c"))
    return first.select(*by, "_c.low", "_c.high", "_c.crossing")


def relative_depth(layer: str, blocks: str) -> Column:
    """A layer's place from 0 to 1 among a model's blocks."""
    return F.col(layer) / F.greatest(F.col(blocks) - 1, F.lit(1))


def matched_depths(layers: DataFrame, a: str, b: str) -> DataFrame:
    """(layer_a, layer_b, depth_a, depth_b): each layer of model a with the nearest one of model b by relative depth.

    layers: (model, layer, blocks); ties to the lower layer. There are few layers, so the pairs are few.
    """
    own = layers.select("model", "layer", relative_depth("layer", "blocks").alias("depth"))
    x = own.where(F.col("model") == a).select(F.col("layer").alias("layer_a"), F.col("depth").alias("depth_a"))
    y = own.where(F.col("model") == b).select(F.col("layer").alias("layer_b"), F.col("depth").alias("depth_b"))
    near = F.min_by(F.struct("layer_b", "depth_b"), F.struct(F.round(F.abs(F.col("depth_a") - F.col("depth_b")), 9), F.col("layer_b")))
    return x.crossJoin(F.broadcast(y)).groupBy("layer_a", "depth_a").agg(near.alias("_n")).select("layer_a", "_n.layer_b", "depth_a", "_n.depth_b")


def largest_change(rows: DataFrame, by: list[str], layer: str, value: str) -> DataFrame:
    """(by, low, high, change): the two layers in a row between which the value changes most, the first of equal ones."""
    w = Window.partitionBy(*by).orderBy(layer)
    pairs = rows.select(*by, F.col(layer).alias("low"), F.lead(layer).over(w).alias("high"), (F.lead(value).over(w) - F.col(value)).alias("change")).where("change IS NOT NULL AND NOT isnan(change)")
    most = F.max_by(F.struct("low", "high", "change"), F.struct(F.abs("change"), -F.col("low")))
    return pairs.groupBy(*by).agg(most.alias("_m")).select(*by, "_m.low", "_m.high", "_m.change")


def near_neighbours(rows: DataFrame, by: list[str], layer: str, value: str, within: float) -> DataFrame:
    """(by, layer, value, smooth): whether a layer's value is within a bound of both the layer before and the one after.

    The first and the last layer have no row.
    """
    w = Window.partitionBy(*by).orderBy(layer)
    beside = rows.select(*by, layer, value, F.lag(value).over(w).alias("_a"), F.lead(value).over(w).alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    return beside.select(*by, layer, value, ((F.abs(F.col(value) - F.col("_a")) <= within) & (F.abs(F.col(value) - F.col("_b")) <= within)).alias("smooth"))


def depth_trends(values: DataFrame, model: str, layer: str, value: str, layers: int = 3, pairs: int = 10, level: float = 0.05) -> DataFrame:
    """(model, n_layers, macro_rho, n_pairs, feature_rho, feature_p, significant): does the value rise with depth?

    macro: over the layers' means; feature: over every feature's value against its layer. Null rho below `layers` layers
    or `pairs` pairs. values: a row for each feature and layer. Values and means are cut before they are ranked: a sum of
    doubles that is worked out twice may differ in its last bits, and a rank is found by its value.
    """
    values = cut(values)
    means = cut(values.groupBy(model, layer).agg(F.avg(value).alias("_mean")))
    macro = spearman(means, layer, "_mean", [model], layers).select(model, F.col("n").alias("n_layers"), F.col("rho").alias("macro_rho"))
    each = spearman(values, layer, value, [model], pairs).select(model, F.col("n").alias("n_pairs"), F.col("rho").alias("feature_rho"))
    out = macro.join(each, model).where(F.col("n_layers") >= layers).withColumn("feature_p", F.when(F.col("feature_rho").isNotNull(), correlation_p(F.col("feature_rho"), F.col("n_pairs"))))
    return out.withColumn("significant", F.coalesce((F.col("feature_p") < level) & (F.col("feature_rho") > 0), F.lit(False)))


def shape(rows: DataFrame, by: list[str], layer: str, value: str, turn: float) -> DataFrame:
    """(by, r, peak, trough, early, late): correlation with depth, layers of the largest and least value, means up to and after `turn`."""
    early = F.col(layer) <= turn
    return rows.groupBy(*by).agg(
        F.corr(F.col(layer).cast("double"), value).alias("r"), F.max_by(layer, value).alias("peak"), F.min_by(layer, value).alias("trough"), F.avg(F.when(early, F.col(value))).alias("early"), F.avg(F.when(~early, F.col(value))).alias("late")
    )


def control_metadata(meta: DataFrame, chains: DataFrame, weight_seed: int, most: int = 0) -> DataFrame:
    """What a control of random weights takes over from each reference layer, and what follows for its training.

    meta: (model, layer, embed_dim, sae_hidden_dim, k_sparse, k_aux, dead_threshold), all but the first three null where
    unknown; chains: (model, layer, uid, ordinal, length, is_val). Only the first `most` chains of a layer count, if given.
    The hidden size is a whole multiple of embed_dim, 8 where unknown. Epochs: about four million training places, and
    four at least; without training chains all places count.
    """
    turn = F.row_number().over(Window.partitionBy("model", "layer").orderBy("ordinal"))
    own = chains.withColumn("_turn", turn).where(F.col("_turn") <= most) if most else chains
    sums = own.groupBy("model", "layer").agg(
        F.count(F.lit(1)).alias("num_proteins"), F.sum("length").alias("total_residues"), F.count(F.when(F.col("is_val"), 1)).alias("num_val"), F.sum(F.when(~F.col("is_val"), F.col("length"))).alias("_train")
    )
    train = F.coalesce("_train", "total_residues")
    epochs = F.greatest(F.lit(4).cast("long"), F.floor(4_000_000 / F.greatest(train, F.lit(1))))
    hidden = F.expr("embed_dim * (coalesce(sae_hidden_dim, embed_dim * 8) div embed_dim)")
    known = [F.coalesce(c, F.lit(d)).alias(c) for c, d in (("k_sparse", 256), ("k_aux", 64), ("dead_threshold", 1_000_000))]
    out = meta.join(sums, ["model", "layer"])
    return out.select(F.concat(F.lit("RANDOM-INIT "), "model").alias("model"), "layer", "embed_dim", hidden.alias("sae_hidden_dim"), *known, "num_proteins", "total_residues", "num_val", epochs.alias("epochs"), F.lit("randomized_weights").alias("control"), F.lit(weight_seed).alias("weight_seed"))
