"""Tables about models: training labels of token sequences, and what changing features does to predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.functions.ordering import hash_number
from strandworks.functions.stats import ranked


def next_labels(tokens: str, ignore: int = -100) -> Column:
    """Labels of a causal model: each place's next token, the last place ignored."""
    return F.when(F.size(tokens) > 0, F.concat(F.slice(tokens, 2, F.greatest(F.lit(0), F.size(tokens) - 1)), F.array(F.lit(ignore)))).otherwise(F.col(tokens))


def masked_labels(rows: DataFrame, key: str, tokens: str, mask: int, vocabulary: int, seed: int, share: float = 0.15, ignore: int = -100) -> DataFrame:
    """rows with `inputs` and `labels` of a masked model.

    A hash of key and place chooses `share` of the places; of ten of those eight become the mask, one a token of the
    vocabulary, one stays. Labels are the tokens at the chosen places and ignored elsewhere.
    """

    def draw(salt: int, i: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(key), i, F.lit(seed), F.lit(salt)), F.lit(1_000_000)) / 1_000_000.0

    chosen = lambda i: draw(0, i) < share
    own = F.when(F.lit(True), F.col(tokens))
    inputs = F.transform(own, lambda t, i: F.when(~chosen(i), t).when(draw(1, i) < 0.8, F.lit(mask)).when(draw(1, i) < 0.9, F.floor(draw(2, i) * vocabulary).cast("int")).otherwise(t))
    return rows.withColumn("inputs", inputs).withColumn("labels", F.transform(own, lambda t, i: F.when(chosen(i), t).otherwise(F.lit(ignore))))


def specificity(events: DataFrame, by: list[str], contact: str, other: str) -> DataFrame:
    """by, n, contact, other, specificity: mean effect on contacts less that on the matched other pairs, where both are known."""
    both = events.where(F.col(contact).isNotNull() & F.col(other).isNotNull())
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(contact).alias("contact"), F.avg(other).alias("other"), F.avg(F.col(contact) - F.col(other)).alias("specificity"))


def dose_slopes(events: DataFrame, by: list[str], scale: str, effect: str) -> DataFrame:
    """by, slope: least-squares slope of an effect over the scales of an intervention."""
    return events.groupBy(*by).agg(F.regr_slope(effect, scale).alias("slope"))


def faithfulness(losses: DataFrame, by: list[str], clean: str, spliced: str, ablated: str, least: float = 0.1) -> DataFrame:
    """by, n, delta, recovered: mean rise of the loss when a reconstruction is spliced in, and the share of what ablation
    costs that it keeps, over rows in which ablation costs more than `least`."""
    room = F.col(ablated) - F.col(clean)
    kept = F.when(room > least, 1 - (F.col(spliced) - F.col(clean)) / room)
    return losses.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(spliced) - F.col(clean)).alias("delta"), F.avg(kept).alias("recovered"))


def divergence(p: str, q: str) -> Column:
    """Kullback-Leibler divergence of two arrays of probabilities; 0 where p is 0."""
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.ln(a / b)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def attribution(effects: DataFrame, key: str, effect: str, score: str, share: float = 0.05, seed: int = 42) -> DataFrame:
    """One row: n, rho (rank correlation of score and size of effect), top, chance, ratio: mean size of effect of the
    `share` of keys with the highest score, of as many drawn by a hash, and the one over the other."""
    own = effects.select(key, F.abs(effect).alias("_e"), F.col(score).alias("_s")).dropna()
    rho = ranked(ranked(own, "_e", [], "_x"), "_s", [], "_y").agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("rho"))
    k = max(1, int(own.count() * share))
    top = own.orderBy(F.desc("_s"), key).limit(k).agg(F.avg("_e").alias("top"))  # features are few
    chance = own.orderBy(hash_number(seed, key), key).limit(k).agg(F.avg("_e").alias("chance"))
    return rho.crossJoin(top).crossJoin(chance).withColumn("ratio", F.col("top") / F.nullif("chance", F.lit(0.0)))  # a row each
