"""More analytics queries: tests, sweeps, concepts, resamples and comparisons of cells, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.functions import stats
from strandworks.operators import concepts, contacts, graphs, layers, locality, vectors
from strandworks.plans import bindings as B
from strandworks.plans.registry import query, rounded

CUTOFFS, WINDOWS, GAPS = (0.1, 0.15, 0.2), (1, 2, 3), (3, 6)


@query(B.sql("places", "vectors", then="SELECT p.uid, p.position, v.label FROM places p JOIN vectors v ON p.uid = v.uid AND p.position = v.position"))
def residue_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.places(spark, sf_dir).join(B.vectors(spark, sf_dir).select("uid", "position", "label"), ["uid", "position"]))


@query(B.sql("dense", "places", "band", then="SELECT p.uid, p.position, round(coalesce(avg(d.z), 0), 6) + 0.0 AS smoothed FROM places p LEFT JOIN band b ON p.uid = b.uid AND p.position = b.src LEFT JOIN (SELECT uid, position, sum(z) AS z FROM dense GROUP BY ALL) d ON d.uid = b.uid AND d.position = b.dst GROUP BY p.uid, p.position"))
def neighbor_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbour means of each place's activation summed over all features."""
    places = B.places(spark, sf_dir)
    own = B.values(spark, sf_dir).groupBy("uid", "position").agg(F.sum(F.greatest("z", F.lit(0.0))).alias("z"))
    return rounded(graphs.neighbour_means(places, graphs.band_edges(places, 2), own, "z"))


@query(B.sql("dense", "places", "band", then="f AS (SELECT DISTINCT feature FROM dense) SELECT p.uid, p.position, f.feature, round(coalesce(avg(d.z), 0), 6) + 0.0 AS smoothed FROM places p CROSS JOIN f LEFT JOIN band b ON p.uid = b.uid AND p.position = b.src LEFT JOIN dense d ON d.uid = b.uid AND d.position = b.dst AND d.feature = f.feature GROUP BY p.uid, p.position, f.feature"))
def neighbor_mean_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbour means of every feature on its own."""
    places = B.places(spark, sf_dir)
    own = B.values(spark, sf_dir).withColumn("z", F.greatest("z", F.lit(0.0)))
    return rounded(graphs.neighbour_means(places, graphs.band_edges(places, 2), own, "z", ["feature"]))


@query(B.sql("coords", "contact", then=f"c AS (SELECT unnest({list(CUTOFFS)}::DOUBLE[]) AS cutoff) SELECT c.cutoff, count(*) AS edges, count(DISTINCT uid) AS chains, round(avg(sep), 6) AS mean_sep FROM contact JOIN c ON dist <= c.cutoff GROUP BY c.cutoff"))
def cutoff_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graphs.contact_edges(B.coords(spark, sf_dir), max(CUTOFFS), 3)  # found once, at the widest cutoff
    many = edges.withColumn("cutoff", F.explode(F.array(*map(F.lit, CUTOFFS)))).where("dist <= cutoff")
    return rounded(many.groupBy("cutoff").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("uid").alias("chains"), F.avg("sep").alias("mean_sep")))


@query(B.sql("places", then=f"w AS (SELECT unnest({list(WINDOWS)}) AS width) SELECT CAST(w.width AS BIGINT) AS width, count(*) AS edges, count(*) FILTER (WHERE a.position // 3 <> b.position // 3) AS between_tokens FROM places a JOIN places b ON a.uid = b.uid AND a.position <> b.position JOIN w ON abs(a.position - b.position) <= w.width GROUP BY w.width"))
def window_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = graphs.band_edges(B.places(spark, sf_dir), max(WINDOWS)).withColumn("width", F.explode(F.array(*map(F.lit, WINDOWS)))).where("sep <= width")
    return rounded(many.groupBy("width").agg(F.count(F.lit(1)).alias("edges"), F.count(F.when(F.expr("src div 3 <> dst div 3"), 1)).alias("between_tokens")))


@query(B.sql("coords", "contact", then=f"g AS (SELECT unnest({list(GAPS)}) AS gap) SELECT CAST(g.gap AS BIGINT) AS gap, count(*) AS edges FROM contact JOIN g ON sep >= g.gap GROUP BY g.gap"))
def gap_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = graphs.contact_edges(B.coords(spark, sf_dir), max(CUTOFFS), min(GAPS)).withColumn("gap", F.explode(F.array(*map(F.lit, GAPS)))).where("sep >= gap")
    return rounded(many.groupBy("gap").agg(F.count(F.lit(1)).alias("edges")))


@query(B.sql("dense", then="s AS (SELECT median(z) AS s FROM dense WHERE z > 0), f AS (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS factor), n AS (SELECT count(*) / count(DISTINCT feature) AS n FROM dense) SELECT feature, factor, count(*) AS active, round(count(*) / max(n), 6) AS rate FROM dense, s, f, n WHERE z > s * factor GROUP BY feature, factor"))
def fixed_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places above 0.5, 1 and 2 times the median of all activations above 0."""
    acts = B.acts(spark, sf_dir)
    middle = stats.percentiles(acts, [], "z", [0.5]).select(F.col("value").alias("_s"))  # one row
    n = B.places(spark, sf_dir).agg(F.count(F.lit(1)).alias("_n"))  # one row
    many = acts.withColumn("factor", F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0))))).join(F.broadcast(middle)).where("z > _s * factor")
    counts = many.groupBy("feature", "factor").agg(F.count(F.lit(1)).alias("active")).join(F.broadcast(n))
    return rounded(counts.select("feature", "factor", "active", (F.col("active") / F.col("_n")).alias("rate")))


_ENRICHED = "m AS (SELECT label, feature, avg(z) AS mean FROM dense GROUP BY ALL), g AS (SELECT feature, avg(z) AS whole FROM dense GROUP BY feature)"


@query(B.sql("dense", then=f"{_ENRICHED} SELECT CAST(label AS BIGINT) AS label, feature, round(mean / (whole + 1e-6), 6) AS enrichment FROM m JOIN g USING (feature) WHERE mean / (whole + 1e-6) > 1.1"))
def fold_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.values(spark, sf_dir).withColumn("z", F.greatest("z", F.lit(0.0)))
    return rounded(locality.group_ratios(own, "label").where("enrichment > 1.1"))


_PRF = (
    "a AS (SELECT feature, label, position, uid, z / max(z) OVER (PARTITION BY feature) AS z FROM dense), t AS (SELECT unnest([0.0, 0.15, 0.5, 0.6, 0.8]::DOUBLE[]) AS threshold), o AS (SELECT a.*, threshold FROM a JOIN t ON z > threshold), "
    "f AS (SELECT feature, threshold, count(*) AS fired FROM o GROUP BY ALL), d AS (SELECT label, count(DISTINCT uid) AS domains FROM dense GROUP BY label), h AS (SELECT label, feature, threshold, count(*) AS hit, count(DISTINCT uid) AS found FROM o GROUP BY ALL), "
    "s AS (SELECT label, feature, threshold, hit / fired AS p, found / domains AS r FROM h JOIN f USING (feature, threshold) JOIN d USING (label)), prf AS (SELECT *, 2 * p * r / (p + r) AS f1 FROM s)"
)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = B.vectors(spark, sf_dir).select(F.col("label").alias("concept"), "uid", "position", F.col("uid").alias("domain"))
    return concepts.scores(concepts.scaled(B.acts(spark, sf_dir)), marks)


@query(B.sql("dense", then=f"{_PRF} SELECT CAST(label AS BIGINT) AS concept, feature, threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM prf"))
def concept_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir))


@query(B.sql("dense", then=f"{_PRF}, b AS (SELECT *, row_number() OVER (PARTITION BY label, feature ORDER BY round(f1, 12) DESC, threshold) AS k FROM prf), c AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(f1, 12) DESC, label) AS j FROM b WHERE k = 1) SELECT feature, CAST(label AS BIGINT) AS concept, threshold, round(f1, 6) AS f1 FROM c WHERE j = 1"))
def feature_best_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(concepts.best_concept(_scored(spark, sf_dir)).select("feature", "concept", "threshold", "f1"))


_DIFF = "d AS (SELECT l_returnflag AS g, l_quantity - CAST(25 AS DOUBLE) AS d FROM lineitem WHERE l_quantity <> 25), r AS (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2 AS k FROM d)"


@query(f"WITH {_DIFF} SELECT g, count(*) AS n, round(coalesce(sum(k) FILTER (WHERE d > 0), 0), 6) AS w_plus, round(coalesce(sum(k) FILTER (WHERE d < 0), 0), 6) AS w_minus FROM r GROUP BY g")
def wilcoxon_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_quantity").cast("double") - 25.0).alias("d"))
    return rounded(stats.wilcoxon(own, "d", ["g"]).select("g", "n", "w_plus", "w_minus"))


_TABLE = "t AS (SELECT l_linestatus AS g, count(*) FILTER (WHERE l_returnflag = 'A' AND l_quantity > 25)::DOUBLE AS a, count(*) FILTER (WHERE l_returnflag = 'A' AND l_quantity <= 25)::DOUBLE AS b, count(*) FILTER (WHERE l_returnflag <> 'A' AND l_quantity > 25)::DOUBLE AS c, count(*) FILTER (WHERE l_returnflag <> 'A' AND l_quantity <= 25)::DOUBLE AS d FROM lineitem GROUP BY 1)"


@query(f"WITH {_TABLE} SELECT g, round(CASE WHEN (a+b)*(c+d) > 0 AND (a+c)*(b+d) > 0 THEN (a+b+c+d) * pow(greatest(0, abs(a*d - b*c) - (a+b+c+d) / 2), 2) / ((a+b)*(c+d)*(a+c)*(b+d)) END, 6) AS chi2 FROM t")
def chi2_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, q = F.col("l_returnflag") == "A", F.col("l_quantity") > 25
    cells = [F.count(F.when(x, 1)).cast("double").alias(n) for n, x in zip("abcd", (a & q, a & ~q, ~a & q, ~a & ~q))]
    counts = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("g")).agg(*cells)
    return rounded(counts.select("g", stats.chi_square(*map(F.col, "abcd")).alias("chi2")))


@query("WITH p AS (SELECT p_size AS g, p_retailprice / (SELECT max(p_retailprice) + 1 FROM part) AS q FROM part), t AS (SELECT unnest([0.5, 0.7, 0.9]::DOUBLE[]) AS level) SELECT level, CAST(sum(CAST(q < level AS INT)) AS BIGINT) AS passed, count(*) AS n FROM p, t GROUP BY level")
def q_threshold_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = B.table(spark, sf_dir, "part")
    top = part.agg((F.max("p_retailprice") + 1).alias("_m"))  # one row
    many = part.join(F.broadcast(top)).select((F.col("p_retailprice") / F.col("_m")).alias("q"), F.explode(F.array(*map(F.lit, (0.5, 0.7, 0.9)))).alias("level"))
    return rounded(many.groupBy("level").agg(F.sum((F.col("q") < F.col("level")).cast("int")).alias("passed"), F.count(F.lit(1)).alias("n")))


@query("WITH m AS (SELECT l_returnflag AS g, year(l_shipdate) AS depth, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL) SELECT g, round(corr(depth, v), 6) + 0.0 AS r, CAST(arg_max(depth, v) AS BIGINT) AS peak, CAST(arg_min(depth, v) AS BIGINT) AS trough, round(avg(v) FILTER (WHERE depth <= 1994), 6) AS early, round(avg(v) FILTER (WHERE depth > 1994), 6) AS late FROM m GROUP BY g")
def depth_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.year("l_shipdate").alias("depth")).agg(F.avg("l_extendedprice").cast("double").alias("v"))
    return rounded(layers.shape(means, ["g"], "depth", "v", 1994))


@query("WITH y AS (SELECT l_returnflag AS g, year(l_shipdate) AS depth, avg(l_quantity) - 25.5 AS d FROM lineitem GROUP BY ALL) SELECT depth, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS up, count(*) AS n, max(CASE WHEN d > 0 THEN 1 ELSE 0 END) <> min(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS flips FROM y GROUP BY depth")
def sign_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.year("l_shipdate").alias("depth")).agg((F.avg("l_quantity") - 25.5).alias("d"))
    up = (F.col("d") > 0).cast("int")
    return rounded(means.groupBy("depth").agg(F.sum(up).alias("up"), F.count(F.lit(1)).alias("n"), (F.max(up) != F.min(up)).alias("flips")))


@query("WITH m AS (SELECT l_returnflag AS g, year(l_shipdate) AS depth, CAST(avg(l_quantity) AS DOUBLE) - 25.5 AS d FROM lineitem GROUP BY ALL), p AS (SELECT g, depth AS low, d AS a, lead(depth) OVER w AS high, lead(d) OVER w AS b FROM m WINDOW w AS (PARTITION BY g ORDER BY depth)), c AS (SELECT g, low, high, low + a / (a - b) * (high - low) AS crossing, row_number() OVER (PARTITION BY g ORDER BY low) AS k FROM p WHERE (a > 0 AND b < 0) OR (a < 0 AND b > 0)) SELECT g, low, high, round(crossing, 6) + 0.0 AS crossing FROM c WHERE k = 1")
def sign_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.year("l_shipdate").alias("depth")).agg((F.avg("l_quantity").cast("double") - 25.5).alias("d"))
    return rounded(layers.sign_crossings(means, ["g"], "depth", "d"))


@query(B.sql("vectors", then="u AS (SELECT uid, position, vec, sqrt(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM vectors), s AS (SELECT a.uid, a.position AS i, b.position AS j, list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (a.n * b.n + 1e-12) AS s FROM u a JOIN u b ON a.uid = b.uid), c AS (SELECT uid, i, j, s - avg(s) OVER (PARTITION BY uid, i) * avg(s) OVER (PARTITION BY uid, j) / (avg(s) OVER (PARTITION BY uid) + 1e-8) AS score FROM s) SELECT uid, i, j, round(score, 5) + 0.0 AS score FROM c WHERE i < j"))
def apc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(contacts.apc_scores(B.vectors(spark, sf_dir).select("uid", "position", "vec")), 5)


@query("SELECT round(sqrt(max(len(embedding))) / avg(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))), 6) AS scale FROM embeddings WHERE vec_id % 10 <> 0")
def norm_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the training split, the nine of ten vectors that aren't held out."""
    return rounded(vectors.norm_scale(B.table(spark, sf_dir, "embeddings"), "embedding", F.col("vec_id") % 10 != 0))


@query("SELECT year(l_shipdate) AS layer, round(avg(l_discount - 0.05), 6) + 0.0 AS mean, round(stddev_pop(l_discount), 6) AS sd, round(median(CAST(l_quantity AS DOUBLE)), 6) AS middle, round(avg(CAST(l_quantity > 25 AS INT)), 6) AS above, count(DISTINCT l_suppkey) AS enriched FROM lineitem GROUP BY 1")
def layer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.table(spark, sf_dir, "lineitem").withColumn("layer", F.year("l_shipdate"))
    middle = stats.percentiles(own, ["layer"], "l_quantity", [0.5]).select("layer", F.col("value").alias("middle"))
    sums = own.groupBy("layer").agg(F.avg(F.col("l_discount") - 0.05).alias("mean"), F.stddev_pop("l_discount").alias("sd"), F.avg((F.col("l_quantity") > 25).cast("int")).alias("above"), F.count_distinct("l_suppkey").alias("enriched"))
    return rounded(sums.join(middle, "layer").select("layer", "mean", "sd", "middle", "above", "enriched"))


@query("WITH c AS (SELECT l_returnflag AS g, l_linenumber AS seed, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL) SELECT g, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, count(*) AS seeds FROM c GROUP BY g")
def seed_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("seed")).agg(F.avg("l_extendedprice").cast("double").alias("v"))
    return rounded(cells.groupBy("g").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count(F.lit(1)).alias("seeds")), 4)


@query("WITH c AS (SELECT l_returnflag AS g, l_suppkey AS cell, avg(l_quantity) > 25.5 AS passed FROM lineitem GROUP BY ALL) SELECT g, CAST(sum(CAST(passed AS INT)) AS BIGINT) AS passed, count(*) AS cells FROM c GROUP BY g")
def sweep_pass_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), "l_suppkey").agg((F.avg("l_quantity") > 25.5).alias("passed"))
    return rounded(cells.groupBy("g").agg(F.sum(F.col("passed").cast("int")).alias("passed"), F.count(F.lit(1)).alias("cells")))


@query("SELECT 'customer' AS kind, c_nationkey AS cell, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def union_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (B.table(spark, sf_dir, t).groupBy(F.col(f"{t[0]}_nationkey").alias("cell")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("kind"), "cell", "n") for t in ("customer", "supplier"))
    return rounded(a.unionByName(b))


@query("SELECT c_custkey AS missing FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def missing_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("missing"))
    return rounded(customers.join(B.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("missing")), "missing", "left_anti"))


@query("SELECT c_nationkey AS layer FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def matched_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (B.table(spark, sf_dir, t).select(F.col(f"{t[0]}_nationkey").alias("layer")) for t in ("customer", "supplier"))
    return rounded(a.intersect(b))


_GATE = "m AS (SELECT l_returnflag AS g, year(l_shipdate) AS depth, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), n AS (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM m WINDOW w AS (PARTITION BY g ORDER BY depth))"


@query(f"WITH {_GATE} SELECT g, depth, round(v, 6) AS v, abs(v - before) <= 0.1 AND abs(v - after) <= 0.1 AS smooth FROM n WHERE before IS NOT NULL AND after IS NOT NULL")
def neighbor_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.year("l_shipdate").alias("depth")).agg(F.avg("l_quantity").cast("double").alias("v"))
    return rounded(layers.near_neighbours(means, ["g"], "depth", "v", 0.1))
