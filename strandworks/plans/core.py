"""The analytics queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.functions import stats
from strandworks.functions.lineage import cut
from strandworks.operators import graphs, locality, resampling, sequences, vectors
from strandworks.plans import bindings as B
from strandworks.plans.registry import query, rounded

ALPHABET = "A-Z"
_REASON = "CASE WHEN length(sequence) < 50 THEN 'short' WHEN length(sequence) > 1024 THEN 'long' WHEN NOT regexp_full_match(sequence, '[A-Z]+') THEN 'alphabet' ELSE 'ok' END"
_KEY = "md5(concat_ws(':', 42, uid))"
_D = "(avg(v) FILTER (WHERE a) - avg(v) FILTER (WHERE NOT a))"
_LINES = "l AS (SELECT l_linestatus AS g, l_returnflag = 'A' AS a, l_quantity AS v FROM lineitem WHERE l_returnflag IN ('A', 'R'))"


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.contact_edges(B.coords(spark, sf_dir), 0.2, 3)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    return own.select(F.col("l_linestatus").alias("g"), (F.col("l_returnflag") == "A").alias("a"), F.col("l_quantity").alias("v"))


@query(B.sql("domains", then=f"SELECT {_REASON} AS reason, count(*) AS n FROM domains GROUP BY 1"))
def seq_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.domains(spark, sf_dir).groupBy(sequences.filter_reason(F.col("sequence"), ALPHABET, 50, 1024).alias("reason")).agg(F.count(F.lit(1)).alias("n")))


@query(B.sql("domains", then=f"r AS (SELECT fold, file_ordinal, {_REASON} AS reason FROM domains), f AS (SELECT fold, min(file_ordinal) AS first FROM r WHERE reason = 'ok' GROUP BY fold) SELECT CASE WHEN reason = 'ok' AND file_ordinal > first THEN 'duplicate' ELSE reason END AS reason, count(*) AS n FROM r LEFT JOIN f ON f.fold = r.fold GROUP BY 1"))
def filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why rows are left out, a second one of a fold included."""
    own = sequences.cascade(B.domains(spark, sf_dir), "sequence", "fold", "file_ordinal", ALPHABET, 50, 1024)
    return rounded(own.groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


@query(B.sql("domains", then="SELECT sequence, min(uid) AS uid FROM domains WHERE sequence <> '' GROUP BY sequence"))
def seq_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.first_per_key(B.domains(spark, sf_dir).where("sequence <> ''").select("sequence", "uid", "file_ordinal"), "sequence", "file_ordinal").select("sequence", "uid")


@query(B.sql("domains", then="r AS (SELECT uid, fold, row_number() OVER (PARTITION BY fold ORDER BY file_ordinal) AS turn FROM domains) SELECT uid, fold, turn FROM r ORDER BY turn, fold LIMIT 100"))
def roundrobin_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequences.round_robin(B.domains(spark, sf_dir), "fold", "file_ordinal", 100).select("uid", "fold", "turn"))


@query(
    B.sql(
        "domains",
        then="s AS (SELECT fold, count(*) AS n FROM domains GROUP BY fold), x AS (SELECT *, n * 100 / sum(n) OVER () AS e FROM s), f AS (SELECT *, floor(e) AS k, row_number() OVER (ORDER BY round(e - floor(e), 12) DESC, fold DESC) AS r FROM x) "
        "SELECT fold, n, CAST(k + CASE WHEN r <= 100 - sum(k) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f",
    )
)
def stratified_apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.apportioned(B.domains(spark, sf_dir), "fold", 100)


@query(B.sql("domains", then=f"r AS (SELECT uid, row_number() OVER (ORDER BY {_KEY}, uid) AS k, count(*) OVER () AS n FROM domains) SELECT uid, k <= greatest(1, floor(n * 0.1 + 0.5)) AS is_val FROM r"))
def protein_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.validation_split(B.domains(spark, sf_dir).select("uid"), "uid", 0.1, 42)


@query(
    B.sql(
        "domains",
        then="s AS (SELECT fold, count(*) AS n FROM domains GROUP BY fold), c AS (SELECT fold, n, coalesce(sum(n) OVER (ORDER BY md5(concat_ws(':', 42, fold)), fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM s) SELECT fold, n, b < round(t * 0.5) AS chosen FROM c",
    )
)
def fold_disjoint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.grouped_split(B.domains(spark, sf_dir), "uid", "fold", 0.5, 42)


@query("SELECT d.source, round(avg(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END), 6) + 0.0 AS coverage FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY d.source")
def coverage_by_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = B.table(spark, sf_dir, "labels").select("doc_id", F.lit(1.0).alias("m")).distinct()
    return rounded(B.table(spark, sf_dir, "documents").select("doc_id", "source").join(marked, "doc_id", "left").groupBy("source").agg(F.avg(F.coalesce("m", F.lit(0.0))).alias("coverage")))


@query(B.sql("domains", then="SELECT count(*) AS n, count(DISTINCT fold) AS folds, CAST(sum(length(sequence)) AS BIGINT) AS total, min(length(sequence)) AS least, max(length(sequence)) AS most, round(avg(length(sequence)), 6) AS mean, round(median(length(sequence)), 6) AS middle FROM domains"))
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cut(B.domains(spark, sf_dir).select("fold", F.length("sequence").alias("n")))  # texts are read once, their lengths several times
    n = F.col("n")
    middle = stats.percentiles(own, [], "n", [0.5]).select(F.col("value").alias("middle"))
    sums = own.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fold").alias("folds"), F.sum(n).alias("total"), F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"))
    return rounded(sums.crossJoin(middle))  # a row each


@query(B.sql("places", "band", then="SELECT uid, src, dst FROM band"))
def band_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.band_edges(B.places(spark, sf_dir), 2).select("uid", "src", "dst"))


@query(B.sql("places", "band", then="SELECT uid, src, dst FROM band WHERE src // 3 <> dst // 3"))
def inter_token_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = B.places(spark, sf_dir).withColumn("token", F.expr("position div 3"))
    return rounded(graphs.between_tokens(graphs.band_edges(B.places(spark, sf_dir), 2), tokens).select("uid", "src", "dst"))


@query(B.sql("coords", "contact", then="SELECT uid, src, dst, sep, round(dist, 6) AS dist FROM contact"))
def contact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_contacts(spark, sf_dir))


@query(B.sql("coords", "contact", "places", then="SELECT p.uid, p.position, count(c.dst) AS degree FROM places p LEFT JOIN contact c ON p.uid = c.uid AND p.position = c.src GROUP BY ALL"))
def burial_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.neighbour_counts(B.places(spark, sf_dir), _contacts(spark, sf_dir)))


@query(
    B.sql(
        "coords", "contact", "places",
        then="d AS (SELECT uid, src, count(*) AS degree FROM contact GROUP BY ALL), r AS (SELECT d.uid, d.src, p.position AS dst, degree, row_number() OVER (PARTITION BY d.uid, d.src ORDER BY md5(concat_ws(':', 7, d.uid, d.src, p.position)), p.position) AS k FROM d JOIN places p ON d.uid = p.uid AND p.position <> d.src) SELECT uid, src, dst FROM r WHERE k <= degree",
    )
)
def degree_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.degree_matched_null(B.places(spark, sf_dir), _contacts(spark, sf_dir), 7))


_LOCAL = (
    "st AS (SELECT feature, stddev_pop(z) AS s, quantile_cont(z, 0.9) AS t FROM dense GROUP BY feature), sm AS (SELECT d.uid, d.position, d.feature, avg(n.z) AS m FROM dense d JOIN band b ON d.uid = b.uid AND d.position = b.src JOIN dense n ON n.uid = b.uid AND n.position = b.dst AND n.feature = d.feature GROUP BY ALL), "
    "w AS (SELECT d.feature, d.z > st.t AS a, coalesce(sm.m, 0) AS m, st.s FROM dense d JOIN st ON st.feature = d.feature LEFT JOIN sm ON sm.uid = d.uid AND sm.position = d.position AND sm.feature = d.feature) "
    "SELECT feature, count(*) FILTER (WHERE a) AS n_active, round(CASE WHEN count(*) FILTER (WHERE a) < 5 THEN 0 ELSE (avg(m) FILTER (WHERE a) - avg(m)) / (max(s) + 1e-6) END, 6) + 0.0 AS d FROM w GROUP BY feature"
)


def _scores(spark: SparkSession, sf_dir: str, perms: int) -> DataFrame:
    acts, places = B.acts(spark, sf_dir), B.places(spark, sf_dir)
    edges = graphs.weighted(graphs.band_edges(places, 2)).withColumn("kind", F.lit("band"))
    moved = locality.permuted_acts(acts, graphs_permutation(places, perms))
    return locality.locality(moved, places, edges, locality.feature_stats(acts, places, [0.1]))


def graphs_permutation(places: DataFrame, perms: int) -> DataFrame:
    from strandworks.functions.ordering import within_group_permutation

    return within_group_permutation(places, ["uid"], "position", perms) if perms else places.select(F.lit(0).alias("perm"), "uid", "position", F.col("position").alias("source"))


@query(B.sql("dense", "places", "band", then=_LOCAL))
def locality_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scores(spark, sf_dir, 0).select("feature", "n_active", "d"))


@query(f"WITH {_LINES} SELECT g, round({_D} / sqrt((var_samp(v) FILTER (WHERE a) + var_samp(v) FILTER (WHERE NOT a)) / 2 + 1e-12), 6) + 0.0 AS d FROM l GROUP BY g")
def cohens_d_samp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_lines(spark, sf_dir).groupBy("g").agg(stats.cohens_d(F.col("v"), F.col("a")).alias("d")))


@query(f"WITH {_LINES} SELECT g, round({_D} / sqrt((var_pop(v) FILTER (WHERE a) + var_pop(v) FILTER (WHERE NOT a)) / 2 + 1e-10), 6) + 0.0 AS d FROM l GROUP BY g")
def cohens_d_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_lines(spark, sf_dir).groupBy("g").agg(stats.cohens_d(F.col("v"), F.col("a"), "population").alias("d")))


@query(
    f"WITH {_LINES}, r AS (SELECT g, a, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2 AS k FROM l) "
    "SELECT g, count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE NOT a) AS n_b, round(sum(k) FILTER (WHERE a) - count(*) FILTER (WHERE a) * (count(*) FILTER (WHERE a) + 1) / 2, 6) AS u FROM r GROUP BY g"
)
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.mann_whitney(_lines(spark, sf_dir), "v", F.col("a"), ["g"]).select("g", "n_a", "n_b", "u"))


@query(
    "WITH r AS (SELECT o_orderpriority AS g, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2 AS x, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2 AS y FROM orders) "
    "SELECT g, count(*) AS n, round(corr(x, y), 6) + 0.0 AS rho FROM r GROUP BY g"
)
def spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), "o_totalprice", "o_custkey")
    return rounded(stats.spearman(own, "o_totalprice", "o_custkey", ["g"]))


@query(B.sql("dense", then="SELECT feature, round(coalesce(corr(v, CAST(label < 3 AS DOUBLE)), 0), 6) + 0.0 AS r FROM dense GROUP BY feature"))
def feature_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.values(spark, sf_dir).groupBy("feature").agg(F.coalesce(F.corr("z", (F.col("label") < 3).cast("double")), F.lit(0.0)).alias("r")))


_P = "p AS (SELECT p_partkey AS k, p_size AS g, p_retailprice / (SELECT max(p_retailprice) + 1 FROM part) AS p FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, k) AS n, count(*) OVER (PARTITION BY g) AS m FROM p)"


@query(f"WITH {_P} SELECT k, g, round(least(1.0, min(p * m / n) OVER (PARTITION BY g ORDER BY p DESC, k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM r")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = B.table(spark, sf_dir, "part")
    top = part.agg((F.max("p_retailprice") + 1).alias("_m"))  # one row
    rows = part.join(F.broadcast(top)).select(F.col("p_partkey").alias("k"), F.col("p_size").alias("g"), (F.col("p_retailprice") / F.col("_m")).alias("p"))
    return rounded(stats.with_bh(rows, "p", ["g"]).select("k", "g", "q"))


@query("SELECT o_orderstatus AS g, round(regr_slope(o_totalprice, o_custkey), 6) + 0.0 AS slope FROM orders GROUP BY 1")
def ols_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("g")).agg(F.regr_slope("o_totalprice", "o_custkey").alias("slope")))


@query(
    B.sql(
        "units",
        then="c AS (SELECT cluster, row_number() OVER (ORDER BY md5(concat_ws(':', 5, cluster)), cluster) - 1 AS c, count(*) OVER () AS k FROM (SELECT DISTINCT cluster FROM units)), s AS (SELECT b, slot, ('0x' || substr(md5(concat_ws(':', 5, b, slot)), 1, 8))::BIGINT % k AS c FROM (SELECT unnest(range(1, 21)) AS b), (SELECT c AS slot, k FROM c)) "
        "SELECT CAST(s.b AS BIGINT) AS b, uid, count(*) AS w FROM s JOIN c ON s.c = c.c JOIN units u ON u.cluster = c.cluster GROUP BY ALL",
    )
)
def cluster_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resampling.cluster_weights(B.customers(spark, sf_dir).select("uid", "cluster"), "uid", "cluster", 20, 5))


@query("WITH e AS (SELECT user_id AS uid, event_type AS mark, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position FROM events), i AS (SELECT *, position - row_number() OVER (PARTITION BY uid, mark ORDER BY position) AS k FROM e) SELECT uid, mark, min(position) AS run, count(*) AS n FROM i GROUP BY uid, mark, k")
def concept_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = B.event_chains(spark, sf_dir).select("uid", F.col("event_type").alias("mark"), "position")
    return rounded(graphs.islands(chains, ["uid"], "position", "mark").groupBy("uid", "mark", "run").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0 AND x >= list_reverse_sort(embedding)[8])) AS BIGINT) AS kept FROM embeddings")
def topk_sparsify(spark: SparkSession, sf_dir: str) -> DataFrame:
    sparse = B.table(spark, sf_dir, "embeddings").withColumn("s", vectors.keep_top("embedding", 8))
    return rounded(sparse.select("vec_id", F.size(F.filter("s", lambda x: x > 0)).alias("kept")))


@query(B.sql("dense", then="SELECT feature, round(avg(CAST(z > 0 AS DOUBLE)), 6) AS rate FROM dense GROUP BY feature"))
def firing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = B.places(spark, sf_dir).agg(F.count(F.lit(1)).alias("_n"))  # one row
    return rounded(B.acts(spark, sf_dir).groupBy("feature").agg(F.count(F.lit(1)).alias("f")).join(F.broadcast(n)).select("feature", (F.col("f") / F.col("_n")).alias("rate")))


@query("SELECT g, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT o_custkey AS g, count(*) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) FULL JOIN (SELECT o_custkey AS g, count(*) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) USING (g)")
def full_outer_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = B.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "g")
    a, b = (orders.where(F.col("o_orderstatus") == s).groupBy("g").agg(F.count(F.lit(1)).alias(n)) for s, n in (("F", "a"), ("O", "b")))
    return rounded(a.join(b, "g", "full").fillna(0, ["a", "b"]))


@query("SELECT year(l_shipdate) AS depth, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A'), 6) AS A, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'N'), 6) AS N, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS R FROM lineitem GROUP BY 1")
def depth_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("depth")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity")))
