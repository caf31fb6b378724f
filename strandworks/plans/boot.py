"""Bootstrap queries: sums of chains, weights of resamples, scores and intervals, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.functions import stats
from strandworks.functions.lineage import cut
from strandworks.operators import graphs, locality, resampling
from strandworks.plans import bindings as B
from strandworks.plans import scores as S
from strandworks.plans.registry import query, rounded

RESAMPLES, MANY, PERMS = 20, 1000, 2
_STRUCT = "edge AS (SELECT 'struct' AS kind, uid, src, uid AS other, dst FROM contact)"
_CONTRIB = (
    f"{S.scores_sql(PERMS, _STRUCT)}, ct AS (SELECT pz.perm, k.kind, pz.uid, pz.feature, coalesce(sum(m) FILTER (WHERE z > t), 0) AS active_sum, count(*) FILTER (WHERE z > t) AS active_n, coalesce(sum(m), 0) AS all_sum "
    "FROM pz CROSS JOIN (SELECT DISTINCT kind FROM edge) k JOIN st ON st.feature = pz.feature LEFT JOIN sm ON sm.perm = pz.perm AND sm.kind = k.kind AND sm.uid = pz.uid AND sm.position = pz.position AND sm.feature = pz.feature GROUP BY ALL)"
)


def draws_sql(units: str, key: str, resamples: int, seed: int, name: str = "w") -> str:
    """CTE (b, key, w): units drawn one by one with replacement."""
    return (
        f"{name}u AS (SELECT {key}, row_number() OVER (ORDER BY md5(concat_ws(':', {seed}, {key})), {key}) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {units})), "
        f"{name} AS (SELECT b, u.{key}, count(*) AS w FROM (SELECT b, ('0x' || substr(md5(concat_ws(':', {seed}, b, x.i)), 1, 8))::BIGINT % x.n AS j FROM {name}u x, (SELECT unnest(range(1, {resamples + 1})) AS b)) s JOIN {name}u u ON u.i = s.j GROUP BY ALL)"
    )


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.places(spark, sf_dir).groupBy("uid").agg(F.count(F.lit(1)).alias("length"))


def _contrib(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Contributions of chains, and the stats, which stay those of all data in every resample."""
    places, acts = B.places(spark, sf_dir), B.acts(spark, sf_dir)
    stat = cut(locality.feature_stats(acts, places, [0.1]))
    contact = graphs.contact_edges(B.coords(spark, sf_dir), max(S.CUTOFFS), 3).select(F.lit("struct").alias("kind"), "uid", "src", "dst")
    return resampling.contributions(acts, places, contact, stat, PERMS, ("struct",)), stat


@query(B.sql(*S._BASE, then=f"{_CONTRIB} SELECT CAST(perm AS BIGINT) AS perm, kind, uid, feature, round(active_sum, 6) + 0.0 AS active_sum, active_n, round(all_sum, 6) + 0.0 AS all_sum FROM ct WHERE active_n > 0 OR all_sum > 0"))
def boot_contrib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every chain adds to the sums behind a score, observed (perm 0) and shuffled."""
    return rounded(_contrib(spark, sf_dir)[0].where("active_n > 0 OR all_sum > 0"))


@query(B.sql(*S._BASE, then=f"{_CONTRIB} SELECT CAST(perm AS BIGINT) AS perm, kind, uid, feature, round(CASE WHEN perm = 0 AND active_n < 3 THEN 0 ELSE active_sum END, 6) + 0.0 AS active_sum, CASE WHEN perm = 0 AND active_n < 3 THEN 0 ELSE active_n END AS active_n, round(all_sum, 6) + 0.0 AS all_sum FROM ct WHERE active_n > 0 OR all_sum > 0"))
def boot_contrib_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resampling.least_active(_contrib(spark, sf_dir)[0].where("active_n > 0 OR all_sum > 0"), 3))


@query("WITH u AS (SELECT c_custkey AS uid FROM customer), " + draws_sql("u", "uid", RESAMPLES, 3) + " SELECT CAST(b AS BIGINT) AS b, uid, w FROM w")
def unit_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"))
    return rounded(resampling.unit_weights(units, "uid", RESAMPLES, 3))


_TWO = (
    "c AS (SELECT cluster, count(*) AS m, row_number() OVER (ORDER BY md5(concat_ws(':', 5, cluster)), cluster) - 1 AS c, count(*) OVER () AS k FROM units GROUP BY cluster), dr AS (SELECT b, x.c AS slot, ('0x' || substr(md5(concat_ws(':', 5, b, x.c)), 1, 8))::BIGINT % x.k AS j FROM c x, (SELECT unnest(range(1, 6)) AS b)), "
    "mb AS (SELECT uid, cluster, row_number() OVER (PARTITION BY cluster ORDER BY uid) - 1 AS i FROM units), tn AS (SELECT dr.b, slot, c.cluster, c.m, unnest(range(0, c.m)) AS turn FROM dr JOIN c ON c.c = dr.j), pk AS (SELECT b, cluster, ('0x' || substr(md5(concat_ws(':', 6, b, slot, turn)), 1, 8))::BIGINT % m AS i FROM tn) "
    "SELECT CAST(b AS BIGINT) AS b, uid, count(*) AS w FROM pk JOIN mb USING (cluster, i) GROUP BY b, uid"
)


@query(B.sql("units", then=_TWO))
def two_stage_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters drawn with replacement, and in each as many draws of its units."""
    return rounded(resampling.cluster_weights(B.customers(spark, sf_dir).select("uid", "cluster"), "uid", "cluster", 5, 5, two_stage=True))


_SIGMA = "sg AS (SELECT feature, stddev_pop(z) AS s FROM dense GROUP BY feature)"
_DELTAS = (
    f"{_CONTRIB}, {draws_sql('places', 'uid', MANY, 11)}, wa AS (SELECT * FROM w UNION ALL SELECT 0, uid, 1 FROM wu), ln AS (SELECT uid, count(*) AS length FROM places GROUP BY uid), nb AS (SELECT b, sum(w * length) AS n FROM wa JOIN ln USING (uid) GROUP BY b), {_SIGMA}, "
    "ws AS (SELECT b, perm, feature, sum(w * active_sum) AS a, sum(w * active_n) AS c, sum(w * all_sum) AS g FROM ct JOIN wa USING (uid) GROUP BY ALL), wd AS (SELECT ws.b, perm, feature, (a / greatest(c, 1) - g / greatest(n, 1)) / (s + 1e-6) AS d FROM ws JOIN nb USING (b) JOIN sg USING (feature)), "
    "bd AS (SELECT b, feature, max(d) FILTER (WHERE perm = 0) - avg(d) FILTER (WHERE perm > 0) AS delta FROM wd GROUP BY b, feature)"
)


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of all resamples; b = 0 is the data itself."""
    chains = _chains(spark, sf_dir)
    contrib, stat = _contrib(spark, sf_dir)
    drawn = resampling.unit_weights(chains, "uid", MANY, 11).unionByName(chains.select(F.lit(0).alias("b"), "uid", F.lit(1).alias("w")))
    return resampling.weighted_deltas(cut(contrib), cut(drawn), stat, chains, MANY + 1, PERMS, ("struct",))


@query(B.sql(*S._BASE, then=f"{_DELTAS} SELECT CAST(b AS BIGINT) AS b, 'struct' AS kind, feature, round(delta, 6) + 0.0 AS delta FROM bd"))
def boot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_deltas(spark, sf_dir))


_GROUPS = "(avg(delta) FILTER (WHERE feature < 32) - avg(delta) FILTER (WHERE feature >= 32)) / sqrt((var_samp(delta) FILTER (WHERE feature < 32) + var_samp(delta) FILTER (WHERE feature >= 32)) / 2 + 1e-12)"
_ENDS = "round(avg(v), 5) + 0.0 AS boot_mean, round(stddev_samp(v), 5) AS boot_sd, round(avg(CAST(v > 0 AS INT)), 5) AS frac_pos, round(avg(CAST(v <= 0 AS INT)), 5) AS p_le_0, round(quantile_cont(v, 0.025), 5) + 0.0 AS pct_lo, round(quantile_cont(v, 0.975), 5) + 0.0 AS pct_hi, round(max(p) - 1.96 * stddev_samp(v), 5) + 0.0 AS normal_lo, round(max(p) + 1.96 * stddev_samp(v), 5) + 0.0 AS normal_hi"


@query(B.sql(*S._BASE, then=f"{_DELTAS}, e AS (SELECT b, {_GROUPS} AS v FROM bd GROUP BY b), t AS (SELECT v, (SELECT v FROM e WHERE b = 0) AS p FROM e WHERE b > 0) SELECT round(max(p), 5) + 0.0 AS point, {_ENDS} FROM t"))
def boot_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effect size between two groups of features, resampled by chains, with both kinds of interval."""
    effects = cut(resampling.group_effects(_deltas(spark, sf_dir), "delta", F.col("feature") < 32, ["b"]))  # a row a resample, read several times
    point = effects.where("b = 0").select(F.col("d").alias("p"))  # one row
    return rounded(resampling.intervals(effects.where("b > 0").join(F.broadcast(point)), [], "d", F.max("p")), 5)


_SPENT = "sp AS (SELECT o_custkey AS uid, o_orderstatus AS kind, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL)"


def _spent(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return own.groupBy(F.col("o_custkey").alias("uid"), F.col("o_orderstatus").alias("kind")).agg(F.avg("o_totalprice").cast("double").alias("v"))


@query(f"WITH {_SPENT}, {draws_sql('sp', 'uid', RESAMPLES, 13)}, m AS (SELECT kind, b, sum(w * v) / sum(w) AS v FROM sp JOIN w USING (uid) GROUP BY ALL), t AS (SELECT kind, m.v, p FROM m JOIN (SELECT kind, avg(v) AS p FROM sp GROUP BY kind) USING (kind)) SELECT kind, round(max(p), 5) AS point, {_ENDS} FROM t GROUP BY kind")
def mean_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of two kinds by resamples that both share."""
    own = _spent(spark, sf_dir)
    trace = resampling.weighted_means(own, "uid", "v", resampling.unit_weights(own.select("uid").distinct(), "uid", RESAMPLES, 13), ["kind"])
    points = own.groupBy("kind").agg(F.avg("v").alias("p"))  # a row for each kind
    return rounded(resampling.intervals(trace.join(F.broadcast(points), "kind"), ["kind"], "mean", F.max("p")), 5)


@query(
    f"WITH {_SPENT}, x AS (SELECT uid, max(v) FILTER (WHERE kind = 'F') AS a, max(v) FILTER (WHERE kind = 'O') AS b_ FROM sp GROUP BY uid HAVING a IS NOT NULL AND b_ IS NOT NULL), cl AS (SELECT c_custkey AS uid, n_name AS cluster FROM customer JOIN nation ON c_nationkey = n_nationkey), "
    + draws_sql("cl", "cluster", RESAMPLES, 17)
    + f", m AS (SELECT b, sum(w * (a - b_)) / sum(w) AS v FROM x JOIN cl USING (uid) JOIN w USING (cluster) GROUP BY b), t AS (SELECT v, (SELECT avg(a - b_) FROM x) AS p FROM m) SELECT round(max(p), 5) + 0.0 AS point, {_ENDS} FROM t"
)
def paired_boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference between two kinds over customers that have both, resampled by whole nations, the same draws for both."""
    c, n = B.table(spark, sf_dir, "customer"), B.table(spark, sf_dir, "nation")
    units = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("uid"), F.col("n_name").alias("cluster"))
    own = _spent(spark, sf_dir)
    trace = resampling.paired_differences(own, "uid", "kind", "v", "F", "O", resampling.cluster_weights(units, "uid", "cluster", RESAMPLES, 17))
    whole = resampling.paired_differences(own, "uid", "kind", "v", "F", "O", units.select(F.lit(0).alias("b"), "uid", F.lit(1).alias("w"))).select(F.col("difference").alias("p"))  # one row
    return rounded(resampling.intervals(trace.join(F.broadcast(whole)), [], "difference", F.max("p")), 5)


@query(
    "WITH y AS (SELECT o_custkey AS uid, year(o_orderdate) AS layer, avg(o_totalprice) AS v FROM orders GROUP BY ALL), sc AS (SELECT year(o_orderdate) AS layer, CAST(count(*) AS DOUBLE) AS score FROM orders GROUP BY ALL), "
    + draws_sql("y", "uid", RESAMPLES, 19)
    + ", m AS (SELECT b, layer, sum(w * v) / sum(w) AS mean FROM y JOIN w USING (uid) GROUP BY ALL), r AS (SELECT b, rank() OVER (PARTITION BY b ORDER BY mean) + (count(*) OVER (PARTITION BY b, mean) - 1) / 2 AS x, rank() OVER (PARTITION BY b ORDER BY score) + (count(*) OVER (PARTITION BY b, score) - 1) / 2 AS y FROM m JOIN sc USING (layer)) SELECT CAST(b AS BIGINT) AS b, round(corr(x, y), 6) + 0.0 AS rho FROM r GROUP BY b"
)
def correlation_boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation over years of resampled customers' mean prices with the number of orders."""
    orders = B.table(spark, sf_dir, "orders")
    own = orders.groupBy(F.col("o_custkey").alias("uid"), F.year("o_orderdate").alias("layer")).agg(F.avg("o_totalprice").cast("double").alias("v"))
    against = orders.groupBy(F.year("o_orderdate").alias("layer")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return rounded(resampling.correlation_trace(own, "uid", "layer", "v", against, resampling.unit_weights(own.select("uid").distinct(), "uid", RESAMPLES, 19)))


@query(
    B.sql(
        "units",
        then="g AS (SELECT cluster, count(*) AS m, avg(value) AS mean, var_pop(value) AS v FROM units GROUP BY cluster), s AS (SELECT sum(m) AS n, count(*) AS k, sum(m * m) AS m2, sum(m * mean) AS t, sum(m * mean * mean) AS t2, sum(m * v) AS within FROM g), a AS (SELECT n, k, (t2 - t * t / n) / (k - 1) AS msb, within / (n - k) AS msw, (n - m2 / n) / (k - 1) AS m0 FROM s), "
        "i AS (SELECT n, k, (msb - msw) / (msb + (m0 - 1) * msw) AS icc, n / k AS size FROM a), d AS (SELECT *, 1 + (size - 1) * greatest(0, icc) AS deff FROM i) SELECT CAST(n AS BIGINT) AS n, k AS clusters, round(icc, 6) + 0.0 AS icc, round(size, 6) AS mean_size, round(deff, 6) AS deff, round(n / deff, 6) AS n_eff FROM d",
    )
)
def design_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.design_effect(B.customers(spark, sf_dir), "cluster", "value"))


@query(B.sql("units", then="g AS (SELECT cluster, count(*) AS m FROM units GROUP BY cluster) SELECT count(*) AS clusters, CAST(sum(m) AS BIGINT) AS units, min(m) AS least, max(m) AS most, round(avg(m), 6) AS mean, round(median(m), 6) AS middle FROM g"))
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resampling.cluster_stats(B.customers(spark, sf_dir), "cluster"))
