"""Queries on what features mean: annotations, concepts, chosen sets, layers and contacts, each with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.functions import stats
from strandworks.functions.ordering import first_hashed
from strandworks.operators import annotations, concepts, contacts, features, graphs, layers, locality, resampling, vectors
from strandworks.plans import bindings as B
from strandworks.plans import scores as S
from strandworks.plans.registry import query, rounded


def student_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation: the density of Student's t integrated by Simpson's rule."""
    t, v = f"(abs({r}) * sqrt(({n} - 2) / (1 - {r} * {r})))", f"({n} - 2)"
    inside = f"list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(i * {t} / 2000, 2) / {v}, -({v} + 1) / 2)))"
    return f"greatest(0, 1 - 2 * {t} / 6000 * exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2)) / sqrt({v} * pi()) * {inside})"


def tail_sql(z: str) -> str:
    """P(Z > z), by the same approximation as the library's: fixed values as published."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    up = f"exp(-pow({z}, 2) / 2) * 0.3989422804014327 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    return f"CASE WHEN {z} >= 0 THEN {up} ELSE 1 - {up} END"


def bh_sql(rows: str, p: str, by: str, out: str) -> str:
    """CTE out: rows with q."""
    part = f"PARTITION BY {by} " if by else ""
    return (
        f"{out}_r AS (SELECT *, {p} * count(*) OVER ({'PARTITION BY ' + by if by else ''}) / row_number() OVER ({part}ORDER BY {p}, feature) AS raw FROM {rows}), "
        f"{out} AS (SELECT * EXCLUDE (raw), least(1.0, min(raw) OVER ({part}ORDER BY {p} DESC, feature DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM {out}_r)"
    )


_MARKS = "bu AS (SELECT a.uid, a.position, count(b.position) AS burial FROM coords a LEFT JOIN coords b ON a.uid = b.uid AND a.position <> b.position AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) <= 0.25 GROUP BY ALL), mk AS (SELECT v.uid, v.position, CAST(label IN (0, 1) AS DOUBLE) AS helix, CAST(label IN (2, 3) AS DOUBLE) AS strand, CAST(burial AS DOUBLE) AS burial FROM vectors v JOIN bu USING (uid, position))"
_NAMES = ["helix", "strand", "burial"]
_CORR = (
    f"{_MARKS}, lg AS (SELECT uid, position, annotation, y FROM mk UNPIVOT (y FOR annotation IN (helix, strand, burial))), rr AS (SELECT feature, annotation, count(*) AS n, greatest(-0.999999, least(0.999999, coalesce(corr(z, y), 0))) AS r FROM dense JOIN lg USING (uid, position) GROUP BY ALL), "
    f"pp AS (SELECT *, {student_sql('r', 'n')} AS p FROM rr), {bh_sql('pp', 'p', 'annotation', 'qq')}"
)
_CORR_BASE = ("dense", "vectors", "coords")


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = graphs.neighbour_counts(B.places(spark, sf_dir), graphs.contact_edges(B.coords(spark, sf_dir), 0.25, 1))
    own = B.vectors(spark, sf_dir).join(near, ["uid", "position"])
    return own.select("uid", "position", annotations.in_classes("label", (0, 1)).alias("helix"), annotations.in_classes("label", (2, 3)).alias("strand"), F.col("degree").cast("double").alias("burial"))


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.interpretability(B.acts(spark, sf_dir), _marks(spark, sf_dir), _NAMES, B.values(spark, sf_dir))


@query(B.sql(*_CORR_BASE, then=f"{_CORR} SELECT feature, annotation, n, round(r, 6) + 0.0 AS r, round(p, 6) + 0.0 AS p, round(q, 6) + 0.0 AS q FROM qq"))
def interp_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature against helix, strand and burial: r, p, and q of each annotation on its own."""
    return rounded(_tested(spark, sf_dir))


@query(B.sql(*_CORR_BASE, then=f"{_CORR}, f AS (SELECT feature, bool_or(q < 0.05) AS s FROM qq GROUP BY feature) SELECT count(*) AS features, CAST(sum(CAST(s AS INT)) AS BIGINT) AS significant, round(100 * sum(CAST(s AS INT)) / count(*), 6) AS pct FROM f"))
def interp_any_sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(annotations.share_significant(annotations.any_significant(_tested(spark, sf_dir))))


@query(B.sql(*_CORR_BASE, then=f"{_CORR}, mp AS (SELECT feature, min(p) AS p FROM pp GROUP BY feature), {bh_sql('mp', 'p', '', 'mq')} SELECT feature, round(p, 6) + 0.0 AS p, round(q, 6) + 0.0 AS q, q < 0.05 AS significant FROM mq"))
def interp_min_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(annotations.least_p(annotations.correlations(B.acts(spark, sf_dir), _marks(spark, sf_dir), _NAMES, B.values(spark, sf_dir))))


_RANKED = "rk AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY z) + (count(*) OVER (PARTITION BY feature, z) - 1) / 2 AS x, rank() OVER (PARTITION BY feature ORDER BY burial) + (count(*) OVER (PARTITION BY feature, burial) - 1) / 2 AS y FROM dense JOIN mk USING (uid, position))"


@query(
    B.sql(
        *_CORR_BASE,
        then=f"{_MARKS}, {_RANKED}, st AS (SELECT uid, position, annotation, y FROM mk UNPIVOT (y FOR annotation IN (helix, strand))), ok AS (SELECT annotation FROM st GROUP BY annotation HAVING sum(CAST(y > 0 AS INT)) >= 10), "
        f"rr AS (SELECT feature, 'burial' AS annotation, count(*) AS n, coalesce(corr(x, y), 0) AS r FROM rk GROUP BY feature UNION ALL SELECT feature, annotation, count(*), coalesce(corr(z, y), 0) FROM dense JOIN st USING (uid, position) WHERE annotation IN (SELECT annotation FROM ok) GROUP BY ALL), pp AS (SELECT *, {student_sql('r', 'n')} AS p FROM rr), {bh_sql('pp', 'p', 'annotation', 'qq')} SELECT feature, bool_or(q < 0.05) AS significant FROM qq GROUP BY feature",
    )
)
def extended_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burial by ranks and binary sites by Pearson's r; sites marked less than ten times are left out."""
    own = B.values(spark, sf_dir).drop("label").withColumn("z", F.greatest("z", F.lit(0.0)))
    return rounded(annotations.extended(own, _marks(spark, sf_dir), ["burial"], ["helix", "strand"]))


@query(B.sql(*_CORR_BASE, then=f"{_MARKS} SELECT uid, position, burial > (SELECT median(burial) FROM mk) AS exposed FROM mk"))
def burial_above_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(annotations.above_median(_marks(spark, sf_dir), "burial", "exposed").select("uid", "position", "exposed"))


@query("SELECT event_id, CASE WHEN value < 20 THEN 'buried' WHEN value > 60 THEN 'exposed' END AS kind, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END + 0.0 AS helix FROM events")
def label_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.table(spark, sf_dir, "events")
    return rounded(own.select("event_id", annotations.surface_kind("value", 20, 60).alias("kind"), annotations.in_classes("event_type", ("click", "view")).alias("helix")))


_RUNS = "e AS (SELECT uid, position, event_type AS concept FROM chains), i AS (SELECT *, position - row_number() OVER (PARTITION BY uid, concept ORDER BY position) AS k FROM e), c AS (SELECT concept, uid, position, 'run/' || uid || '/' || min(position) OVER (PARTITION BY uid, concept, k) AS domain FROM i)"


@query(B.sql("chains", then=f"{_RUNS} SELECT concept, count(*) AS places, count(DISTINCT domain) AS domains FROM c GROUP BY concept HAVING count(DISTINCT domain) >= 10"))
def segment_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of each concept and its unbroken stretches, for concepts with ten stretches or more."""
    marks = B.event_chains(spark, sf_dir).select(F.col("event_type").alias("concept"), "uid", "position")
    own = concepts.frequent(concepts.segment_concepts(marks), 10)
    return rounded(own.groupBy("concept").agg(F.count(F.lit(1)).alias("places"), F.count_distinct("domain").alias("domains")))


@query(B.sql("units", then="p AS (SELECT uid, string_split(path, '.') AS s FROM units), l AS (SELECT uid, array_to_string(s[1:k], '.') AS concept FROM p, (SELECT unnest([1, 2, 3]) AS k)) SELECT concept, count(*) AS places, count(DISTINCT uid) AS domains FROM l GROUP BY concept"))
def hierarchy_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of a hierarchy as concepts, a unit being a chain of one place."""
    own = B.customers(spark, sf_dir)
    found = concepts.hierarchy_concepts(own.select("uid", F.lit(0).alias("position")), own.select("uid", "path"), 3)
    return rounded(found.groupBy("concept").agg(F.count(F.lit(1)).alias("places"), F.count_distinct("domain").alias("domains")))


_STEPS = (0.0, 0.15, 0.5, 0.6, 0.8)


def _prf_sql(where: str, name: str) -> str:
    return (
        f"{name}o AS (SELECT a.*, threshold FROM ac a JOIN th ON z > threshold WHERE uid {where} (SELECT uid FROM vl)), {name}f AS (SELECT feature, threshold, count(*) AS fired FROM {name}o GROUP BY ALL), {name}d AS (SELECT label, count(DISTINCT uid) AS domains FROM dense WHERE uid {where} (SELECT uid FROM vl) GROUP BY label), "
        f"{name}h AS (SELECT label, feature, threshold, count(*) AS hit, count(DISTINCT uid) AS found FROM {name}o GROUP BY ALL), {name} AS (SELECT label, feature, threshold, hit / fired AS p, found / domains AS r, 2 * (hit / fired) * (found / domains) / (hit / fired + found / domains) AS f1 FROM {name}h JOIN {name}f USING (feature, threshold) JOIN {name}d USING (label))"
    )


_SELECT = (
    f"{S.VAL_SQL}, ac AS (SELECT feature, label, position, uid, z / max(z) OVER (PARTITION BY feature) AS z FROM dense), th AS (SELECT unnest({list(_STEPS)}::DOUBLE[]) AS threshold), {_prf_sql('IN', 'va')}, {_prf_sql('NOT IN', 'te')}, "
    "b1 AS (SELECT *, row_number() OVER (PARTITION BY label, feature ORDER BY round(f1, 12) DESC, threshold) AS k FROM va), b2 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(f1, 12) DESC, feature, threshold) AS j FROM b1 WHERE k = 1), "
    "tt AS (SELECT b.label, b.feature, b.threshold, b.f1 AS val_f1, b.p AS val_precision, b.r AS val_recall, coalesce(te.f1, 0) AS test_f1, coalesce(te.p, 0) AS test_precision, coalesce(te.r, 0) AS test_recall FROM b2 b LEFT JOIN te ON te.label = b.label AND te.feature = b.feature AND te.threshold = b.threshold WHERE j = 1 AND b.label IN (SELECT label FROM ted))"
)


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = B.vectors(spark, sf_dir).select(F.col("label").alias("concept"), "uid", "position", F.col("uid").alias("domain"))
    return concepts.select_and_test(concepts.scaled(B.acts(spark, sf_dir)), marks, S.validation(spark, sf_dir), _STEPS)


@query(B.sql("dense", "places", then=f"{_SELECT} SELECT CAST(label AS BIGINT) AS concept, feature, threshold, round(val_f1, 6) AS val_f1, round(val_precision, 6) AS val_precision, round(val_recall, 6) AS val_recall, round(test_f1, 6) + 0.0 AS test_f1, round(test_precision, 6) + 0.0 AS test_precision, round(test_recall, 6) + 0.0 AS test_recall FROM tt"))
def concept_select_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each concept's best feature and threshold on the validation chains, reported on the others."""
    return rounded(_selected(spark, sf_dir))


@query(B.sql("dense", "places", then=f"{_SELECT} SELECT count(*) AS rows, CAST(coalesce(sum(CAST(val_f1 > 0.2 AND test_f1 > 0.2 AS INT)), 0) AS BIGINT) AS aligned FROM tt"))
def concept_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(concepts.aligned(_selected(spark, sf_dir), 0.2))


_RATE = "ra AS (SELECT feature, avg(CAST(z > 0 AS DOUBLE)) AS rate FROM dense GROUP BY feature)"


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.firing(B.acts(spark, sf_dir), B.places(spark, sf_dir), B.values(spark, sf_dir))


@query(B.sql("dense", then=f"{_RATE} SELECT count(*) AS features, CAST(sum(CAST(rate = 0 AS INT)) AS BIGINT) AS dead, CAST(sum(CAST(rate > 0.5 AS INT)) AS BIGINT) AS dense, round(median(rate), 6) AS median, round(100 * sum(CAST(rate = 0 AS INT)) / count(*), 6) + 0.0 AS pct_dead, (SELECT round(sum(CAST(z > 0 AS INT)) / count(DISTINCT (uid, position)), 6) FROM dense) AS l0 FROM ra"))
def firing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = features.firing_summary(_rates(spark, sf_dir)).crossJoin(features.active_per_place(B.acts(spark, sf_dir), B.places(spark, sf_dir)))  # a row each
    return rounded(own)


_TOP = "tg AS (SELECT feature FROM ra ORDER BY rate DESC, feature LIMIT 8)"
_BINS = "ed AS (SELECT list_sort(quantile_cont(rate, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])) AS e FROM ra WHERE rate > 0), bn AS (SELECT feature, len(list_filter(e, lambda x: round(x, 12) <= round(rate, 12))) AS bin FROM ra, ed)"


@query(B.sql("dense", then=f"{_RATE}, {_TOP}, {_BINS}, wt AS (SELECT bin, count(*) AS want FROM bn WHERE feature IN (SELECT feature FROM tg) GROUP BY bin), pl AS (SELECT feature, bin, want, row_number() OVER (PARTITION BY bin ORDER BY md5(concat_ws(':', 21, feature)), feature) AS k FROM bn JOIN wt USING (bin) WHERE feature NOT IN (SELECT feature FROM tg)) SELECT feature, CAST(bin AS BIGINT) AS bin FROM pl WHERE k <= want"))
def rate_matched_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _rates(spark, sf_dir).select("feature", F.round("rate", 12).alias("rate"))
    return rounded(features.rate_matched(rates, features.top(rates, "rate", 8), 21))


_SETS = (
    f"{_RATE}, pr AS (SELECT feature, percent_rank() OVER (ORDER BY rate, feature) AS r FROM ra), t AS (SELECT feature FROM ra ORDER BY rate DESC, feature LIMIT 8), m AS (SELECT feature, row_number() OVER (ORDER BY md5(concat_ws(':', 23, feature)), feature) AS k FROM pr WHERE r > 0.25 AND r < 0.75), "
    "o AS (SELECT feature, row_number() OVER (ORDER BY md5(concat_ws(':', 24, feature)), feature) AS k FROM ra WHERE feature NOT IN (SELECT feature FROM t)) "
    "SELECT 'top' AS kind, feature FROM t UNION ALL SELECT 'bottom', feature FROM (SELECT feature FROM ra ORDER BY rate, feature LIMIT 8) UNION ALL SELECT 'middle', feature FROM m WHERE k <= 8 UNION ALL SELECT 'random', feature FROM o WHERE k <= 8"
)


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_sets(_rates(spark, sf_dir).select("feature", "rate"), "rate", 8, 23)


@query(B.sql("dense", then=_SETS))
def feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_sets(spark, sf_dir))


@query(B.sql("dense", then=f"{_RATE} SELECT feature, round(rate, 6) AS rate, row_number() OVER (ORDER BY rate DESC, feature) AS rank FROM ra"))
def feature_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.with_rank(_rates(spark, sf_dir).select("feature", "rate"), "rate"))


@query(B.sql("dense", then="r AS (SELECT feature, uid, position, z, row_number() OVER (PARTITION BY feature ORDER BY z DESC, uid, position) AS k FROM dense WHERE z > 0 AND uid % 2 = 0) SELECT feature, uid, position, round(z, 6) AS z FROM r WHERE k = 1"))
def top_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each feature is largest, among the chains that have a structure (here those with an even id)."""
    there = B.places(spark, sf_dir).where("uid % 2 = 0").select("uid").distinct()
    return rounded(features.top_chain(B.acts(spark, sf_dir), there))


@query(B.sql("dense", then=f"{_RATE}, {_TOP}, r AS (SELECT uid, feature, position, row_number() OVER (PARTITION BY uid, feature ORDER BY z DESC, position) AS k FROM dense WHERE z > 0 AND feature IN (SELECT feature FROM tg)) SELECT uid, feature, position FROM r WHERE k = 1"))
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.anchors(B.acts(spark, sf_dir), features.top(_rates(spark, sf_dir), "rate", 8)))


@query("WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS a FROM embeddings), k AS (SELECT vec_id, list_reverse_sort(embedding)[32]::DOUBLE AS t FROM embeddings), p AS (SELECT vec_id, dim, a, CASE WHEN a >= t AND a > 0 THEN a ELSE 0 END AS b FROM e JOIN k USING (vec_id)), d AS (SELECT dim, sum((a - b) * (a - b)) AS ssr, count(*) * var_pop(a) AS sst FROM p GROUP BY dim), r AS (SELECT vec_id, sqrt(sum(a * a)) AS na, sqrt(sum(b * b)) AS nb, sum(a * b) AS ab FROM p GROUP BY vec_id) SELECT count(*) AS n, (SELECT round(1 - sum(ssr) / sum(sst), 5) FROM d) AS explained, round(avg(nb / na), 5) AS norm_ratio, round(avg(ab / (na * nb)), 5) AS cosine FROM r")
def reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the 32 largest entries of a vector stand for all of it."""
    own = B.table(spark, sf_dir, "embeddings").select("embedding", vectors.keep_top("embedding", 32).alias("kept"))
    return rounded(features.reconstruction(own, "embedding", "kept"), 5)


@query("WITH s AS (SELECT o_orderstatus AS g, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1) SELECT o_orderkey AS k, o_orderstatus AS g, round((o_totalprice - m) / (s + 1e-6), 5) + 0.0 AS v FROM orders JOIN s ON g = o_orderstatus")
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("g"), F.col("o_totalprice").cast("double").alias("v"))
    return rounded(features.standardized(own, ["v"], F.col("k") % 10 != 0, ["g"]), 5)


@query("WITH e AS (SELECT event_type AS g, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1) SELECT g, count(*) AS n, round(min(value), 6) + 0.0 AS least, round(max(value), 6) + 0.0 AS most FROM events JOIN e ON g = event_type WHERE value BETWEEN lo AND hi GROUP BY g")
def without_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = features.without_tails(B.table(spark, sf_dir, "events").select(F.col("event_type").alias("g"), "value"), ["g"], "value")
    return rounded(own.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most")))


@query(B.sql("dense", then=f"{_RATE}, mx AS (SELECT feature, max(z) AS top FROM dense GROUP BY feature HAVING max(z) > 0.3) SELECT feature, round(rate, 6) AS rate, round(top, 6) AS top FROM ra LEFT JOIN mx USING (feature)"))
def feature_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores joined onto all features, null where a table has none."""
    high = B.acts(spark, sf_dir).groupBy("feature").agg(F.max("z").alias("top")).where("top > 0.3")
    return rounded(features.with_scores(_rates(spark, sf_dir).select("feature", "rate"), high))


_MEANS = "WITH m AS (SELECT l_returnflag AS g, year(l_shipdate) AS depth, CAST(avg(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY ALL)"


def _by_year(spark: SparkSession, sf_dir: str, value: Column) -> DataFrame:
    return B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.year("l_shipdate").alias("depth")).agg(value.cast("double").alias("v"))


@query(f"{_MEANS}, p AS (SELECT g, depth AS low, lead(depth) OVER w AS high, lead(v) OVER w - v AS change FROM m WINDOW w AS (PARTITION BY g ORDER BY depth)), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY abs(change) DESC, low) AS k FROM p WHERE change IS NOT NULL) SELECT g, low, high, round(change, 6) + 0.0 AS change FROM r WHERE k = 1")
def largest_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(layers.largest_change(_by_year(spark, sf_dir, F.avg("l_quantity")), ["g"], "depth", "v"))


_LAYERS = "m AS (SELECT DISTINCT 'a' AS model, l_linenumber - 1 AS layer FROM lineitem UNION ALL SELECT DISTINCT 'b', p_size - 1 FROM part), n AS (SELECT model, layer, layer / greatest(max(layer) OVER (PARTITION BY model), 1) AS depth FROM m)"


@query(f"WITH {_LAYERS}, r AS (SELECT a.layer AS layer_a, b.layer AS layer_b, a.depth AS depth_a, b.depth AS depth_b, row_number() OVER (PARTITION BY a.layer ORDER BY round(abs(a.depth - b.depth), 9), b.layer) AS k FROM n a JOIN n b ON a.model = 'a' AND b.model = 'b') SELECT CAST(layer_a AS BIGINT) AS layer_a, CAST(layer_b AS BIGINT) AS layer_b, round(depth_a, 6) AS depth_a, round(depth_b, 6) AS depth_b FROM r WHERE k = 1")
def matched_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers as the layers of one model with part sizes as those of another at the nearest relative depth."""
    a = B.table(spark, sf_dir, "lineitem").select(F.lit("a").alias("model"), (F.col("l_linenumber") - 1).alias("layer")).distinct()
    own = a.unionByName(B.table(spark, sf_dir, "part").select(F.lit("b").alias("model"), (F.col("p_size") - 1).alias("layer")).distinct())
    blocks = own.groupBy("model").agg((F.max("layer") + 1).alias("blocks"))  # a row for each model
    return rounded(layers.matched_depths(own.join(F.broadcast(blocks), "model"), "a", "b"))


_TREND = "WITH y AS (SELECT l_returnflag AS model, year(l_shipdate) AS layer, l_suppkey AS feature, CAST(avg(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY ALL), m AS (SELECT model, layer, avg(v) AS v FROM y GROUP BY ALL), mr AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY layer) AS a, rank() OVER (PARTITION BY model ORDER BY v) + (count(*) OVER (PARTITION BY model, v) - 1) / 2 AS b FROM m), fr AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY layer) + (count(*) OVER (PARTITION BY model, layer) - 1) / 2 AS a, rank() OVER (PARTITION BY model ORDER BY v) + (count(*) OVER (PARTITION BY model, v) - 1) / 2 AS b FROM y), x AS (SELECT model, count(*) AS n_layers, corr(a, b) AS macro_rho FROM mr GROUP BY model HAVING count(*) >= 3), f AS (SELECT model, count(*) AS n_pairs, corr(a, b) AS r FROM fr GROUP BY model)"


@query(f"{_TREND} SELECT model, n_layers, round(macro_rho, 6) + 0.0 AS macro_rho, n_pairs, round(r, 6) + 0.0 AS feature_rho, round({student_sql('r', 'n_pairs')}, 5) + 0.0 AS feature_p, {student_sql('r', 'n_pairs')} < 0.05 AND r > 0 AS significant FROM x JOIN f USING (model)")
def depth_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.year("l_shipdate").alias("layer"), F.col("l_suppkey").alias("feature")).agg(F.avg("l_quantity").cast("double").alias("v"))
    return rounded(layers.depth_trends(cells, "model", "layer", "v")).withColumn("feature_p", F.round("feature_p", 5) + 0.0)


@query("WITH r AS (SELECT o_orderstatus AS g, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2 AS o_totalprice, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderstatus, o_custkey) - 1) / 2 AS o_custkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) + (count(*) OVER (PARTITION BY o_orderstatus, o_orderkey) - 1) / 2 AS o_orderkey FROM orders) " + " UNION ALL ".join(f"SELECT g, '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) + 0.0 AS rho FROM r GROUP BY g" for a, b in [("o_totalprice", "o_custkey"), ("o_totalprice", "o_orderkey"), ("o_custkey", "o_orderkey")]))
def rank_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of every two metrics."""
    own = B.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("g"), "o_totalprice", "o_custkey", "o_orderkey")
    return rounded(stats.rank_correlations(own, ["o_totalprice", "o_custkey", "o_orderkey"], ["g"]))


_TEST = "l AS (SELECT l_linestatus AS g, l_returnflag = 'A' AS a, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem WHERE l_returnflag IN ('A', 'R')), r AS (SELECT g, a, v, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2 AS k FROM l), ti AS (SELECT g, sum(m * m * m - m) AS t FROM (SELECT g, CAST(count(*) AS DOUBLE) AS m FROM l GROUP BY g, v) GROUP BY g), u AS (SELECT g, count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE NOT a) AS n_b, median(v) FILTER (WHERE a) AS median_a, median(v) FILTER (WHERE NOT a) AS median_b, sum(k) FILTER (WHERE a) - count(*) FILTER (WHERE a) * (count(*) FILTER (WHERE a) + 1) / 2 AS u, (avg(v) FILTER (WHERE a) - avg(v) FILTER (WHERE NOT a)) / sqrt((var_pop(v) FILTER (WHERE a) + var_pop(v) FILTER (WHERE NOT a)) / 2 + 1e-10) AS d FROM r GROUP BY g), z AS (SELECT u.*, sqrt(CAST(n_a AS DOUBLE) * n_b / 12 * (n_a + n_b + 1 - t / ((n_a + n_b) * (n_a + n_b - 1.0)))) AS s, u - n_a * n_b / 2 AS c FROM u JOIN ti USING (g))"


@query(f"WITH {_TEST} SELECT g, n_a, n_b, round(median_a, 6) AS median_a, round(median_b, 6) AS median_b, round(u, 6) AS u, round({tail_sql('((c - 0.5) / s)')}, 6) + 0.0 AS p, round(d, 6) + 0.0 AS d FROM z")
def compare_greater(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_compared(spark, sf_dir, "greater"))


@query(f"WITH {_TEST} SELECT g, n_a, n_b, round(median_a, 6) AS median_a, round(median_b, 6) AS median_b, round(u, 6) AS u, round({tail_sql('(-(c + 0.5) / s)')}, 6) + 0.0 AS p, round(d, 6) + 0.0 AS d FROM z")
def compare_less(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_compared(spark, sf_dir, "less"))


@query(f"WITH {_TEST} SELECT g, n_a, n_b, round(median_a, 6) AS median_a, round(median_b, 6) AS median_b, round(u, 6) AS u, round(least(1.0, 2 * ({tail_sql('((abs(c) - 0.5) / s)')})), 6) + 0.0 AS p, round(d, 6) + 0.0 AS d FROM z")
def compare_two_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_compared(spark, sf_dir, "two_sided"))


def _compared(spark: SparkSession, sf_dir: str, direction: str) -> DataFrame:
    own = B.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    rows = own.select(F.col("l_linestatus").alias("g"), (F.col("l_returnflag") == "A").alias("a"), F.col("l_extendedprice").cast("double").alias("v"))
    return stats.compare(rows, "v", F.col("a"), ["g"], direction)


@query("WITH c AS (SELECT l_returnflag AS g, l_suppkey AS seed, CAST(avg(l_quantity) AS DOUBLE) AS q, CAST(avg(l_discount) AS DOUBLE) AS p FROM lineitem GROUP BY ALL) SELECT g, round(avg(q), 6) AS q_mean, round(stddev_samp(q), 6) AS q_std, count(q) AS q_count, round(avg(p), 6) AS p_mean, round(stddev_samp(p), 6) AS p_std, count(p) AS p_count FROM c GROUP BY g")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.summarize(_cells(spark, sf_dir), ["g"], ["q", "p"]))


@query("WITH c AS (SELECT l_returnflag AS g, l_suppkey AS seed, CAST(avg(l_quantity) AS DOUBLE) AS q, CAST(avg(l_discount) AS DOUBLE) AS p FROM lineitem GROUP BY ALL) SELECT g, round(avg(q), 6) AS q_mean, round(stddev_pop(q), 6) AS q_std, count(q) AS q_count FROM c GROUP BY g")
def seed_summary_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.summarize(_cells(spark, sf_dir), ["g"], ["q"], population=True))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.table(spark, sf_dir, "lineitem")
    return own.groupBy(F.col("l_returnflag").alias("g"), F.col("l_suppkey").alias("seed")).agg(F.avg("l_quantity").cast("double").alias("q"), F.avg("l_discount").cast("double").alias("p"))


@query("WITH c AS (SELECT l_returnflag AS g, l_suppkey AS seed, CAST(avg(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY ALL) SELECT g, printf('%.3f', avg(q)) || '±' || printf('%.3f', stddev_samp(q)) AS q FROM c GROUP BY g")
def paper_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stats.summarize(_cells(spark, sf_dir), ["g"], ["q"])
    return own.select("g", stats.mean_pm_std(F.col("q_mean"), F.col("q_std")).alias("q"))


@query("SELECT d.doc_id, round(coalesce((coalesce(l.quality, 0) + coalesce(l.toxic, 0) + length(d.lang)) / (1.0 + CAST(l.quality IS NOT NULL AS INT) + CAST(l.toxic IS NOT NULL AS INT)), 0), 6) AS mean FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality, toxic FROM labels) l ON l.doc_id = d.doc_id")
def family_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the metrics that a row has."""
    own = B.table(spark, sf_dir, "documents").select("doc_id", "lang").join(B.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").distinct(), "doc_id", "left")
    mean = stats.mean_of_present(F.col("quality").cast("double"), F.col("toxic").cast("double"), F.length("lang").cast("double"))
    return rounded(own.select("doc_id", F.coalesce(mean, F.lit(0.0)).alias("mean")))


@query("WITH c AS (SELECT l_returnflag AS g, l_linestatus AS s, avg(l_discount) - 0.05 AS d, stddev_samp(l_discount) AS sd, count(*) AS n FROM lineitem GROUP BY ALL), i AS (SELECT *, d - 1.96 * sd / sqrt(n) AS lo, d + 1.96 * sd / sqrt(n) AS hi FROM c) SELECT g, s, lo > 0 AND d > 0 AS significant, CASE WHEN lo > 0 THEN 'positive' WHEN hi < 0 THEN 'negative' ELSE 'inconclusive' END AS verdict FROM i")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_linestatus").alias("s")).agg((F.avg("l_discount").cast("double") - 0.05).alias("d"), (1.96 * F.stddev_samp("l_discount") / F.sqrt(F.count(F.lit(1)))).alias("e"))
    low, high = F.col("d") - F.col("e"), F.col("d") + F.col("e")
    return cells.select("g", "s", stats.significant(F.when(low > 0, 0.0).otherwise(1.0), F.col("d")).alias("significant"), stats.verdict(low, high).alias("verdict"))


def _apc_sql(vectors: str) -> str:
    return (
        f"un AS (SELECT kind, uid, position, vec, sqrt(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM {vectors}), sm AS (SELECT a.kind, a.uid, a.position AS i, b.position AS j, coalesce(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / nullif(a.n * b.n, 0), 0) AS s FROM un a JOIN un b ON a.kind = b.kind AND a.uid = b.uid), "
        "ap AS (SELECT kind, uid, i, j, s - avg(s) OVER (PARTITION BY kind, uid, i) * avg(s) OVER (PARTITION BY kind, uid, j) / (avg(s) OVER (PARTITION BY kind, uid) + 1e-8) AS score FROM sm), tc AS (SELECT DISTINCT uid, src AS i, dst AS j FROM contact WHERE src < dst), ln AS (SELECT uid, count(*) AS length FROM places WHERE uid IN (SELECT uid FROM tc) GROUP BY uid), "
        "pk AS (SELECT kind, ap.uid, greatest(1, CAST(floor(length * 0.2) AS BIGINT)) AS k, CASE WHEN tc.i IS NULL THEN 0.0 ELSE 1.0 END AS c, row_number() OVER (PARTITION BY kind, ap.uid ORDER BY round(score, 9) DESC, ap.i, ap.j) AS r FROM ap JOIN ln ON ln.uid = ap.uid LEFT JOIN tc ON tc.uid = ap.uid AND tc.i = ap.i AND tc.j = ap.j WHERE ap.j - ap.i >= 3)"
    )


@query(B.sql("vectors", "coords", "contact", "places", then=f"v AS (SELECT 'all' AS kind, uid, position, vec FROM vectors), {_apc_sql('v')} SELECT uid, max(k) AS k, round(avg(c), 6) AS precision FROM pk WHERE r <= k GROUP BY uid"))
def precision_topl(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.vectors(spark, sf_dir)
    found = graphs.contact_edges(B.coords(spark, sf_dir), 0.2, 3)
    return rounded(contacts.top_precision(contacts.apc_scores(own.select("uid", "position", "vec")), found, own.groupBy("uid").agg(F.count(F.lit(1)).alias("length")), gap=3))


@query(B.sql("vectors", "coords", "contact", "places", "dense", then=f"fs AS ({_SETS.replace(_RATE, '@', 1).replace('@', 'WITH ' + _RATE, 1)}), v AS (SELECT kind, uid, position, list_transform(fl, lambda f: vec[f + 1]) AS vec FROM vectors, (SELECT kind, list_sort(list(feature)) AS fl FROM fs GROUP BY kind)), {_apc_sql('v')} SELECT kind, uid, max(k) AS k, round(avg(c), 6) AS precision FROM pk WHERE r <= k GROUP BY kind, uid"))
def subset_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact precision from the top, bottom, middle and random features only."""
    own = B.vectors(spark, sf_dir)
    found = graphs.contact_edges(B.coords(spark, sf_dir), 0.2, 3)
    return rounded(contacts.subset_precision(own.select("uid", "position", "vec"), _sets(spark, sf_dir), found, own.groupBy("uid").agg(F.count(F.lit(1)).alias("length")), gap=3))


_DRAWN = "fs AS (SELECT 'random_' || s AS kind, feature FROM (SELECT s, feature, row_number() OVER (PARTITION BY s ORDER BY md5(concat_ws(':', 40 + s, feature)), feature) AS k FROM (SELECT DISTINCT feature FROM dense), (SELECT unnest(range(0, 4)) AS s)) WHERE k <= 8)"


@query(B.sql("vectors", "coords", "contact", "places", "dense", then=f"{_DRAWN}, v AS (SELECT kind, uid, position, list_transform(fl, lambda f: vec[f + 1]) AS vec FROM vectors, (SELECT kind, list_sort(list(feature)) AS fl FROM fs GROUP BY kind)), {_apc_sql('v')}, pr AS (SELECT kind, uid, avg(c) AS precision FROM pk WHERE r <= k GROUP BY kind, uid) SELECT 'random' AS kind, uid, round(avg(precision), 6) AS precision FROM pr GROUP BY uid"))
def subset_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact precision from four random choices of features, averaged for each chain."""
    own = B.vectors(spark, sf_dir)
    ids = B.values(spark, sf_dir).select("feature").distinct()
    sets = [first_hashed(ids, "feature", 8, 40 + i).select(F.lit(f"random_{i}").alias("kind"), "feature") for i in range(4)]
    drawn = sets[0].unionByName(sets[1]).unionByName(sets[2]).unionByName(sets[3])
    lengths = own.groupBy("uid").agg(F.count(F.lit(1)).alias("length"))
    found = contacts.subset_precision(own.select("uid", "position", "vec"), drawn, graphs.contact_edges(B.coords(spark, sf_dir), 0.2, 3), lengths, gap=3)
    return rounded(contacts.collapsed(found))


@query(B.sql("vectors", "coords", "contact", then="l AS (SELECT uid, count(*) AS length FROM vectors GROUP BY uid) SELECT uid, length FROM l WHERE length BETWEEN 10 AND 1000 AND uid IN (SELECT uid FROM contact WHERE dst - src >= 12) AND uid % 3 <> 0"))
def evaluable_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains that contact prediction can be judged on; every third one has no structure here."""
    own = B.vectors(spark, sf_dir).groupBy("uid").agg(F.count(F.lit(1)).alias("length")).withColumn("resolved", F.when(F.col("uid") % 3 != 0, F.col("length")))
    return rounded(contacts.evaluable(own, graphs.contact_edges(B.coords(spark, sf_dir), 0.2, 3), 10, 1000, 12))


@query("WITH n AS (SELECT vec_id, embedding AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) + 1e-12 AS n FROM embeddings), s AS (SELECT a.vec_id, b.vec_id AS match, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (CAST(p[1] AS DOUBLE) / a.n) * (p[2] / b.n))) AS s FROM n a JOIN n b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, match) AS k FROM s) SELECT vec_id, match, round(s, 6) + 0.0 AS cosine FROM r WHERE k = 1")
def cosine_topmatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rounded(vectors.best_match(own, own, "vec_id", "embedding", skip_same=True))


@query()
def logistic_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balanced logistic regression of a label on all features, trained on four of five chains."""
    own = B.vectors(spark, sf_dir).select("uid", (F.col("label") < 3).alias("y"), *[F.col("vec")[i].cast("double").alias(f"f{i}") for i in range(B.DIMS)])
    return rounded(features.probe(own, [f"f{i}" for i in range(B.DIMS)], "y", F.col("uid") % 5 != 0))


@query("WITH l AS (SELECT l_linestatus AS g, count(*) FILTER (WHERE l_returnflag = 'A' AND l_quantity > 25) AS a, count(*) FILTER (WHERE l_returnflag = 'A' AND l_quantity <= 25) AS b, count(*) FILTER (WHERE l_returnflag <> 'A' AND l_quantity > 25) AS c, count(*) FILTER (WHERE l_returnflag <> 'A' AND l_quantity <= 25) AS d FROM lineitem GROUP BY 1), k AS (SELECT *, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS x FROM l), p AS (SELECT g, a, x, lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1) - lgamma(c + d - a - c + x + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) AS lp FROM k), o AS (SELECT g, lp AS own FROM p WHERE x = a) SELECT g, round(least(1.0, sum(exp(lp)) FILTER (WHERE lp <= own + 1e-7)), 6) AS p FROM p JOIN o USING (g) GROUP BY g")
def fisher_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, q = F.col("l_returnflag") == "A", F.col("l_quantity") > 25
    cells = [F.count(F.when(x, 1)).alias(n) for n, x in zip("abcd", (a & q, a & ~q, ~a & q, ~a & ~q))]
    counts = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("g")).agg(*cells)
    return rounded(counts.select("g", stats.fisher_p(*map(F.col, "abcd")).alias("p")))


@query(f"WITH d AS (SELECT l_returnflag AS g, CAST(l_quantity AS DOUBLE) - 25 AS d FROM lineitem WHERE l_quantity <> 25), r AS (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2 AS k FROM d), t AS (SELECT g, sum(m * m * m - m) AS t FROM (SELECT g, CAST(count(*) AS DOUBLE) AS m FROM d GROUP BY g, abs(d)) GROUP BY g), w AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, least(sum(k) FILTER (WHERE d > 0), sum(k) FILTER (WHERE d < 0)) AS w FROM r GROUP BY g), z AS (SELECT g, n, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48) AS z FROM w JOIN t USING (g)) SELECT g, CAST(n AS BIGINT) AS n, round(least(1.0, 2 * ({tail_sql('(-z)')})), 6) + 0.0 AS p FROM z")
def wilcoxon_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_quantity").cast("double") - 25.0).alias("d"))
    return rounded(stats.wilcoxon(own, "d", ["g"]).select("g", "n", F.col("p_two_sided").alias("p")))


@query(B.sql("units", "domains", then="k AS (SELECT u.uid, array_to_string(string_split(path, '.')[1:2], '.') AS cluster FROM units u WHERE u.uid % 4 <> 0), a AS (SELECT uid, coalesce(cluster, '__singleton__' || uid) AS cluster FROM (SELECT uid FROM units) LEFT JOIN k USING (uid)) SELECT * FROM a"))
def cluster_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by the first two levels of the hierarchy; units without a path are alone."""
    own = B.customers(spark, sf_dir)
    return rounded(resampling.cluster_keys(own, "uid", own.where("uid % 4 <> 0").select("uid", "path"), 2))


@query(B.sql("dense", "vectors", then="ok AS (SELECT label, count(*) AS m FROM (SELECT DISTINCT uid, position, label FROM dense) GROUP BY label ORDER BY m DESC, label LIMIT 5), g AS (SELECT feature, avg(z) AS w FROM dense GROUP BY feature), i AS (SELECT label, feature, avg(z) AS m FROM dense WHERE label IN (SELECT label FROM ok WHERE m >= 5) GROUP BY ALL) SELECT CAST(label AS BIGINT) AS label, feature, round(m / (w + 1e-6), 6) AS enrichment FROM i JOIN g USING (feature) WHERE m / (w + 1e-6) > 1.1"))
def enriched_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features enriched in the five largest groups with five places or more; a place is a chain of its own here."""
    own = B.vectors(spark, sf_dir).select(F.col("vec_id").alias("uid"), F.lit(0).alias("position"), "label")
    acts = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), F.lit(0).alias("position"), F.posexplode("embedding").alias("feature", "z")).withColumn("z", F.col("z").cast("double")).where("z > 0")
    found = locality.enrichment(acts, own.select("uid", "position"), own.select("uid", F.col("label").alias("fold")), 5, 1.1, 5)
    return rounded(found.withColumnRenamed("fold", "label"))


_MASKS = "list_sum(list_transform(range(0, {n}), lambda i: CASE WHEN (k >> i) & 1 = 1 THEN i + 1 ELSE 0 END))"


@query(
    "WITH r AS (SELECT c_custkey // 10 AS g, c_mktsegment < 'G' AS a, row_number() OVER (PARTITION BY c_custkey // 10 ORDER BY c_acctbal) AS r FROM customer), "
    "t AS (SELECT c_custkey // 10 AS g FROM customer GROUP BY 1 HAVING count(DISTINCT c_acctbal) = count(*)), "
    "s AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE a) AS na, sum(r) FILTER (WHERE a) AS ra FROM r JOIN t USING (g) GROUP BY g HAVING na > 0 AND na < count(*)), "
    "e AS (SELECT g, n, na, ra - na * (na + 1) / 2 AS u, unnest(range(0, 1 << n)) AS k FROM s), "
    f"m AS (SELECT g, na, n - na AS nb, u, {_MASKS.format(n='n')} - na * (na + 1) / 2 AS v FROM e WHERE bit_count(k) = na) "
    "SELECT g, na AS n_a, nb AS n_b, CAST(u AS DOUBLE) AS u, round(avg(CAST(v >= u AS INT)), 6) AS p_greater, round(avg(CAST(v <= u AS INT)), 6) AS p_less, round(least(1.0, 2 * least(avg(CAST(v >= u AS INT)), avg(CAST(v <= u AS INT)))), 6) AS p_two_sided FROM m GROUP BY g, na, nb, u"
)
def exact_rank_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank tests of ten customers at a time, by all ways of dealing their ranks; groups with ties or one side only are left out."""
    own = B.table(spark, sf_dir, "customer").select(F.expr("c_custkey div 10").alias("g"), F.col("c_acctbal").alias("v"), (F.col("c_mktsegment") < "G").alias("a"))
    return rounded(stats.mann_whitney(own, "v", F.col("a"), ["g"]).where("exact").select("g", "n_a", "n_b", "u", "p_greater", "p_less", "p_two_sided"))


@query(
    "WITH d AS (SELECT c_custkey // 12 AS g, c_acctbal - 4000 AS d FROM customer), t AS (SELECT g FROM d GROUP BY g HAVING count(DISTINCT abs(d)) = count(*) AND count(*) FILTER (WHERE d = 0) = 0), "
    "r AS (SELECT g, d > 0 AS up, row_number() OVER (PARTITION BY g ORDER BY abs(d)) AS r FROM d JOIN t USING (g)), s AS (SELECT g, count(*) AS n, coalesce(sum(r) FILTER (WHERE up), 0) AS w FROM r GROUP BY g), "
    f"e AS (SELECT g, n, w, unnest(range(0, 1 << n)) AS k FROM s), m AS (SELECT g, n, w, {_MASKS.format(n='n')} AS v FROM e) "
    "SELECT g, n, CAST(w AS DOUBLE) AS w_plus, round(least(1.0, 2 * least(avg(CAST(v >= w AS INT)), avg(CAST(v <= w AS INT)))), 6) AS p FROM m GROUP BY g, n, w"
)
def exact_signed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed-rank tests of twelve customers at a time, by all choices of signs; groups with ties or zeros are left out."""
    own = B.table(spark, sf_dir, "customer").select(F.expr("c_custkey div 12").alias("g"), (F.col("c_acctbal").cast("double") - 4000.0).alias("d"))
    return rounded(stats.wilcoxon(own, "d", ["g"]).where("exact").select("g", "n", "w_plus", F.col("p_two_sided").alias("p")))


_TABLES = "l AS (SELECT unnest(['status ' || l_linestatus, 'flag ' || l_returnflag]) AS g, l_returnflag = 'A' AS x, l_quantity > 25 AS y FROM lineitem), t AS (SELECT g, CAST(count(*) FILTER (WHERE x AND y) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE x AND NOT y) AS DOUBLE) AS b, CAST(count(*) FILTER (WHERE NOT x AND y) AS DOUBLE) AS c, CAST(count(*) FILTER (WHERE NOT x AND NOT y) AS DOUBLE) AS d FROM l GROUP BY g), h AS (SELECT g, CASE WHEN (a + b) * (c + d) > 0 AND (a + c) * (b + d) > 0 THEN (a + b + c + d) * pow(greatest(0, abs(a * d - b * c) - (a + b + c + d) / 2), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) END AS h FROM t)"


@query(f"WITH {_TABLES} SELECT g, CASE WHEN h IS NULL THEN 'fisher' ELSE 'chi_square' END AS test, round(h, 6) AS statistic, CASE WHEN h IS NULL THEN 1.0 ELSE round(least(1.0, 2 * ({tail_sql('sqrt(h)')})), 6) + 0.0 END AS p FROM h")
def association_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of two yes-or-no columns; where one column says the same in all rows, Fisher's test takes over (its p is 1 then)."""
    kinds = F.array(F.concat(F.lit("status "), "l_linestatus"), F.concat(F.lit("flag "), "l_returnflag"))
    own = B.table(spark, sf_dir, "lineitem").select(F.explode(kinds).alias("g"), (F.col("l_returnflag") == "A").alias("x"), (F.col("l_quantity") > 25).alias("y"))
    x, y = F.col("x"), F.col("y")
    cells = [F.count(F.when(k, 1)).cast("double").alias(n) for n, k in zip("abcd", (x & y, x & ~y, ~x & y, ~x & ~y))]
    return rounded(own.groupBy("g").agg(*cells).select("g", stats.association(*map(F.col, "abcd")).alias("t")).select("g", "t.test", "t.statistic", "t.p"))


@query(B.sql("domains", then="l AS (SELECT fold, unnest(string_split(sequence, '')) AS c FROM domains WHERE sequence <> '') SELECT fold, CASE WHEN c IN ('H', 'G', 'I') THEN 'helix' WHEN c IN ('E', 'B') THEN 'strand' WHEN c IN ('T', 'S') THEN 'turn' WHEN c = 'C' THEN 'coil' END AS structure, count(*) AS n FROM l WHERE c <> '' GROUP BY ALL"))
def structure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters as classes of structure, by group; those of no group are null."""
    letters = B.domains(spark, sf_dir).where("sequence <> ''").select("fold", F.explode(F.split("sequence", "")).alias("c")).where("c <> ''")
    return rounded(letters.groupBy("fold", annotations.structure_group(F.col("c")).alias("structure")).agg(F.count(F.lit(1)).alias("n")))
