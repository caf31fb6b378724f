"""Tables of features: chosen sets, rates, and how well a sparse code gives its input back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions.ordering import first_hashed, shuffle_key
from strandworks.functions.stats import percentiles


def top(scores: DataFrame, metric: str, k: int, lowest: bool = False) -> DataFrame:
    """The k features with the highest (or lowest) metric; ties to the lower feature."""
    return scores.orderBy(F.asc(metric) if lowest else F.desc(metric), "feature").limit(k)


def with_rank(scores: DataFrame, metric: str) -> DataFrame:
    """scores with `rank` from 1, highest metric first, ties to the lower feature. One row for each feature, so the window is small."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), "feature")))


def feature_sets(scores: DataFrame, metric: str, k: int, seed: int) -> DataFrame:
    """(kind, feature): the top k, the bottom k, k of the middle half by percent rank, and k others of all, disjoint from the top."""
    ranked = scores.select("feature", metric, F.percent_rank().over(Window.orderBy(metric, "feature")).alias("_r"))  # a row for each feature
    best = top(scores, metric, k).select("feature")
    middle = ranked.where("_r > 0.25 AND _r < 0.75").select("feature")
    others = scores.select("feature").join(best, "feature", "left_anti")
    kinds = {"top": best, "bottom": top(scores, metric, k, lowest=True).select("feature"), "middle": first_hashed(middle, "feature", k, seed), "random": first_hashed(others, "feature", k, seed + 1)}
    out: DataFrame | None = None
    for kind, df in kinds.items():
        own = df.select(F.lit(kind).alias("kind"), "feature")
        out = own if out is None else out.unionByName(own)
    return out


def rate_bins(rates: DataFrame, rate: str = "rate", bins: int = 20) -> DataFrame:
    """rates with `bin`: by quantiles of the rates above 0, the first and last bin open; a rate on an edge is in the upper bin."""
    edges = percentiles(rates.where(F.col(rate) > 0), [], rate, [i / bins for i in range(1, bins)])
    inner = edges.agg(F.array_sort(F.collect_list("value")).alias("_edges"))  # one row of bins - 1 numbers
    return rates.join(F.broadcast(inner)).withColumn("bin", F.size(F.filter("_edges", lambda e: e <= F.col(rate)))).drop("_edges")


def rate_matched(rates: DataFrame, target: DataFrame, seed: int, bins: int = 20) -> DataFrame:
    """(feature, bin): features outside the target, as many from each bin of rates as the target has there, or all there are.

    rates: (feature, rate); target: (feature).
    """
    binned = rate_bins(rates, bins=bins).select("feature", "bin")
    wanted = target.select("feature").join(binned, "feature").groupBy("bin").agg(F.count(F.lit(1)).alias("_want"))
    pool = binned.join(target.select("feature"), "feature", "left_anti")
    turn = F.row_number().over(Window.partitionBy("bin").orderBy(shuffle_key(seed, "feature"), "feature"))
    return pool.join(wanted, "bin").withColumn("_turn", turn).where("_turn <= _want").select("feature", "bin")


def firing(acts: DataFrame, places: DataFrame, features: DataFrame, dense: float = 0.5) -> DataFrame:
    """(feature, rate, dead, dense) of all features, those that are nowhere active included. features: (feature)."""
    n = places.agg(F.count(F.lit(1)).alias("_n"))  # one row
    fired = acts.where("z > 0").groupBy("feature").agg(F.count(F.lit(1)).alias("_f"))
    rate = F.coalesce("_f", F.lit(0)) / F.col("_n")
    return features.select("feature").distinct().join(fired, "feature", "left").join(F.broadcast(n)).select("feature", rate.alias("rate"), F.col("_f").isNull().alias("dead"), (rate > dense).alias("dense"))


def firing_summary(rates: DataFrame) -> DataFrame:
    """One row: features, dead, dense, median rate, pct_dead."""
    middle = percentiles(rates, [], "rate", [0.5]).select(F.col("value").alias("median"))
    sums = rates.agg(F.count(F.lit(1)).alias("features"), F.sum(F.col("dead").cast("int")).alias("dead"), F.sum(F.col("dense").cast("int")).alias("dense"))
    return sums.crossJoin(middle).withColumn("pct_dead", 100 * F.col("dead") / F.col("features"))  # a row each


def active_per_place(acts: DataFrame, places: DataFrame) -> DataFrame:
    """One row: l0, the mean count of active features of a place."""
    n = places.agg(F.count(F.lit(1)).alias("_n"))
    return acts.where("z > 0").agg(F.count(F.lit(1)).alias("_a")).crossJoin(n).select((F.col("_a") / F.col("_n")).alias("l0"))  # a row each


def reconstruction(rows: DataFrame, x: str, xhat: str) -> DataFrame:
    """One row: n, explained (1 - squared residuals over squared deviations from each dimension's mean), norm_ratio, cosine.

    x and xhat: arrays of one width. Two-level sums over places and dimensions, no row is held whole.
    """
    pairs = rows.select(F.posexplode(F.arrays_zip(F.col(x).alias("a"), F.col(xhat).alias("b"))).alias("dim", "p")).select("dim", F.col("p.a").cast("double").alias("a"), F.col("p.b").cast("double").alias("b"))
    dims = pairs.groupBy("dim").agg(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("ssr"), (F.count("a") * F.var_pop("a")).alias("sst"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    dot = F.aggregate(F.zip_with(x, xhat, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    rowwise = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(norm(xhat) / F.nullif(norm(x), F.lit(0.0))).alias("norm_ratio"), F.avg(dot / F.nullif(norm(x) * norm(xhat), F.lit(0.0))).alias("cosine"))
    whole = dims.agg((1 - F.sum("ssr") / F.nullif(F.sum("sst"), F.lit(0.0))).alias("explained"))
    return rowwise.crossJoin(whole).select("n", "explained", "norm_ratio", "cosine")  # a row each


def gap_flag(train: Column, held_out: Column, most: float = 0.10) -> Column:
    """Whether explained variance falls by more than `most` from the training to the held-out split."""
    return (train - held_out) > most


def top_chain(acts: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """(feature, uid, position, z): where each feature is largest, among chains (uid) if given; ties to the lower place."""
    own = acts if chains is None else acts.join(chains.select("uid").distinct(), "uid", "left_semi")
    first = F.max_by(F.struct("uid", "position", "z"), F.struct(F.col("z"), -F.col("uid"), -F.col("position")))
    return own.groupBy("feature").agg(first.alias("_t")).select("feature", "_t.uid", "_t.position", "_t.z")


def anchors(acts: DataFrame, features: DataFrame) -> DataFrame:
    """(uid, feature, position): the place of each chain at which a chosen feature is largest, the first of equal ones."""
    own = acts.join(features.select("feature").distinct(), "feature", "left_semi")
    return own.groupBy("uid", "feature").agg(F.max_by("position", F.struct(F.col("z"), -F.col("position"))).alias("position"))


def standardized(rows: DataFrame, columns: list[str], train: Column, by: list[str] | None = None) -> DataFrame:
    """rows with each column less its mean over its deviation + 1e-6, both of the training rows."""
    own = rows.where(train)
    sums = [f.alias(n) for c in columns for f, n in ((F.avg(c), f"_m_{c}"), (F.stddev_pop(c), f"_s_{c}"))]
    stats = own.groupBy(*by).agg(*sums) if by else own.agg(*sums)
    joined = rows.join(stats, by) if by else rows.join(F.broadcast(stats))  # without groups, one row
    return joined.select(*[((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-6)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def without_tails(rows: DataFrame, by: list[str], value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """rows whose value lies between two percentiles of its group, both included."""
    ends = percentiles(rows, by, value, [low, high]).groupBy(*by).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    joined = rows.join(ends, by) if by else rows.join(F.broadcast(ends))  # without groups, one row
    return joined.where(F.col(value).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def with_scores(features: DataFrame, *scores: DataFrame) -> DataFrame:
    """features with the columns of tables keyed by feature, null where one has no row."""
    for s in scores:
        features = features.join(s, "feature", "left")
    return features


def probe(rows: DataFrame, columns: list[str], label: str, train: Column, least: int = 5) -> DataFrame:
    """One row: n_train, n_test, positives, f1, auroc of a balanced logistic regression on the test rows.

    Null scores if either class has fewer than `least` training rows. Trained by Spark ML over all training rows.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    own = rows.withColumn("_train", train).withColumn("_y", F.col(label).cast("double"))
    counts = own.groupBy("_train").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos")).collect()  # two rows
    n = {r._train: (r.n, int(r.pos or 0)) for r in counts}
    (a, pos), (b, _) = n.get(True, (0, 0)), n.get(False, (0, 0))
    row: tuple = (a, b, pos, None, None)
    if pos >= least and a - pos >= least and b:
        weighted = own.withColumn("_w", F.when(F.col("_y") == 1, a / (2.0 * pos)).otherwise(a / (2.0 * (a - pos))))
        vectors = VectorAssembler(inputCols=columns, outputCol="_x").transform(weighted).select("_train", "_y", "_w", "_x")
        model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=100, regParam=1.0 / a).fit(vectors.where("_train"))
        scored = model.transform(vectors.where("NOT _train"))
        c = scored.agg(F.sum(((F.col("prediction") == 1) & (F.col("_y") == 1)).cast("int")).alias("tp"), F.sum("prediction").alias("p"), F.sum("_y").alias("y")).first()
        both = 0 < c.y < b
        auroc = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="_y").evaluate(scored) if both else None
        row = (a, b, pos, 2.0 * c.tp / (c.p + c.y) if c.p + c.y else 0.0, auroc)
    return rows.sparkSession.createDataFrame([row], "n_train long, n_test long, positives long, f1 double, auroc double")
