"""Queries on preparing data and on tables about models, each with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandworks.functions import stats
from strandworks.functions.ordering import first_hashed
from strandworks.operators import features, graphs, interventions, layers, locality, resampling, sequences
from strandworks.plans import bindings as B
from strandworks.plans import findings, scores
from strandworks.plans.registry import query, rounded


@query(B.sql("domains", then="l AS (SELECT DISTINCT doc_id AS uid FROM labels), r AS (SELECT CASE WHEN d.uid NOT IN (SELECT uid FROM l) THEN 'coverage' WHEN lang NOT IN ('en', 'de', 'fr') THEN 'fold' WHEN length(sequence) < 50 THEN 'structure' ELSE 'ok' END AS reason FROM domains d) SELECT reason, count(*) AS n FROM r GROUP BY reason"))
def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a row is left out: the first check that fails."""
    marked = B.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("uid"), F.lit(1).alias("m")).distinct()
    own = B.domains(spark, sf_dir).join(marked, "uid", "left")
    checks = [("coverage", F.col("m").isNull()), ("fold", ~F.col("lang").isin("en", "de", "fr")), ("structure", F.length("sequence") < 50)]
    return rounded(own.groupBy(sequences.first_failing(checks).alias("reason")).agg(F.count(F.lit(1)).alias("n")))


@query(B.sql("domains", then="t AS (SELECT uid, substr(upper(sequence), 1, 510) AS s FROM domains), h AS (SELECT DISTINCT substr(upper(sequence), 1, 510) AS s FROM domains WHERE uid % 10 = 0) SELECT uid, length(s) AS n, md5(s) AS digest FROM t WHERE length(s) >= 30 AND regexp_full_match(s, '[A-Z]+') AND s NOT IN (SELECT s FROM h)"))
def corpus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncated, long enough, of the alphabet, and not a text that is held out."""
    own = B.domains(spark, sf_dir).select("uid", sequences.truncated(F.col("sequence"), 510).alias("s"))
    held = own.where("uid % 10 = 0").select("s").distinct()
    kept = own.where((F.length("s") >= 30) & F.col("s").rlike("^[A-Z]+$")).join(held, "s", "left_anti")
    return rounded(kept.select("uid", F.length("s").alias("n"), F.md5(F.col("s").cast("binary")).alias("digest")))


@query(B.sql("domains", then="SELECT uid, md5(translate(sequence, 'UZOB', 'XXXX')) AS plain, CAST(list_sum(list_transform(string_split(sequence, ''), lambda c: CASE WHEN c = '' THEN 0 WHEN instr('ACDEFGHIKLMNPQRSTVWY', c) > 0 THEN instr('ACDEFGHIKLMNPQRSTVWY', c) + 4 ELSE 4 END)) AS BIGINT) AS ids FROM domains WHERE sequence <> ''"))
def letter_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare letters as X, as a digest, and the sum of the ids of all letters."""
    own = B.domains(spark, sf_dir).where("sequence <> ''").select("uid", "sequence")
    ids = sequences.letters_to_ids(F.col("sequence"), "ACDEFGHIKLMNPQRSTVWY")
    return rounded(own.select("uid", F.md5(sequences.rare_letters_as_x(F.col("sequence")).cast("binary")).alias("plain"), F.aggregate(ids, F.lit(0), lambda a, x: a + x).alias("ids")))


@query(B.sql("domains", then="c AS (SELECT fold, sum(length(sequence)) AS tokens FROM domains GROUP BY fold) SELECT fold, CAST(tokens AS BIGINT) AS tokens, CASE WHEN tokens < 5000 THEN 40 WHEN tokens < 50000 THEN 20 WHEN tokens < 500000 THEN 10 ELSE 5 END AS epochs FROM c"))
def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.domains(spark, sf_dir).groupBy("fold").agg(F.sum(F.length("sequence")).alias("tokens"))
    return rounded(own.select("fold", "tokens", sequences.epochs_for(F.col("tokens"), [(5000, 40), (50000, 20), (500000, 10)], 5).alias("epochs")))


@query(B.sql("domains", then="SELECT fold, uid, length(sequence) AS n, CAST(coalesce(sum(length(sequence)) OVER (PARTITION BY fold ORDER BY uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin FROM domains"))
def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sequence begins when those of a fold follow each other."""
    before = F.sum("n").over(Window.partitionBy("fold").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1))
    own = B.domains(spark, sf_dir).select("fold", "uid", F.length("sequence").alias("n"))
    return rounded(own.withColumn("begin", F.coalesce(before, F.lit(0))))


@query(B.sql("places", then=f"{scores.VAL_SQL}, tr AS (SELECT DISTINCT uid FROM places EXCEPT SELECT uid FROM vl) SELECT (SELECT count(*) FROM vl) AS val, (SELECT count(*) FROM tr) AS train, (SELECT count(*) FROM (SELECT uid FROM tr INTERSECT SELECT uid FROM vl)) AS both_"))
def split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training chains are all but the validation ones, and none is in both."""
    val = scores.validation(spark, sf_dir)
    train = B.places(spark, sf_dir).select("uid").subtract(val)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return rounded(n(val, "val").crossJoin(n(train, "train")).crossJoin(n(train.intersect(val), "both_")))  # a row each


@query(B.sql("domains", then="s AS (SELECT fold, count(*) AS n FROM domains GROUP BY fold), x AS (SELECT *, n * 100 / sum(n) OVER () AS e FROM s), f AS (SELECT *, floor(e) AS k, row_number() OVER (ORDER BY round(e - floor(e), 12) DESC, fold DESC) AS r FROM x), q AS (SELECT fold, k + CASE WHEN r <= 100 - sum(k) OVER () THEN 1 ELSE 0 END AS quota FROM f), o AS (SELECT uid, fold, row_number() OVER (PARTITION BY fold ORDER BY md5(concat_ws(':', 31, uid)), uid) AS r FROM domains) SELECT uid, o.fold FROM o JOIN q ON o.fold = q.fold WHERE r <= quota"))
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resampling.stratified(B.domains(spark, sf_dir).select("uid", "fold"), "uid", "fold", 100, 31))


@query(B.sql("vectors", then="r AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5(concat_ws(':', 33, vec_id)), vec_id) AS k FROM vectors) SELECT vec_id, CAST(label AS BIGINT) AS label FROM r WHERE k <= 150"))
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample without replacement of joined rows: sampling is what this query is for."""
    own = B.vectors(spark, sf_dir).select("vec_id", "label")
    return rounded(first_hashed(own, "vec_id", 150, 33))


@query("WITH l AS (SELECT DISTINCT doc_id, quality FROM labels) SELECT d.doc_id, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id")
def annotations_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.table(spark, sf_dir, "labels").select("doc_id", "quality").distinct()
    return rounded(B.table(spark, sf_dir, "documents").select("doc_id").join(own, "doc_id", "left").fillna(0, ["quality"]))


_SWEEP = "WITH c AS (SELECT l_returnflag AS model, year(l_shipdate) AS layer, l_linenumber AS cutoff, l_suppkey AS f, CAST(avg(l_quantity) AS DOUBLE) AS d FROM lineitem GROUP BY ALL)"


@query(f"{_SWEEP} SELECT model, layer, cutoff, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(stddev_samp(d), 6) AS std, count(*) AS count FROM c GROUP BY ALL")
def sweep_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["model", "layer", "cutoff"]
    cells = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.year("l_shipdate").alias("layer"), F.col("l_linenumber").alias("cutoff"), F.col("l_suppkey").alias("f")).agg(F.avg("l_quantity").cast("double").alias("d"))
    middle = stats.percentiles(cells, by, "d", [0.5]).select(*by, F.col("value").alias("median"))
    sums = cells.groupBy(*by).agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("std"), F.count(F.lit(1)).alias("count"))
    return rounded(sums.join(middle, by).select(*by, "mean", "median", "std", "count"))


@query(B.sql(*findings.S._BASE, "vectors", then=f"{findings._SELECT}, {scores.scores_sql(2)}, {scores.DELTA_SQL} SELECT CAST(label AS BIGINT) AS concept, tt.feature, round(test_f1, 6) + 0.0 AS test_f1, round(observed - shuffled, 6) + 0.0 AS delta FROM tt JOIN dl ON dl.feature = tt.feature AND dl.kind = 'struct'"))
def concept_locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The locality of the features that mark concepts best."""
    best = findings._selected(spark, sf_dir).select("concept", "feature", "test_f1")
    own = locality.deltas(scores.scored(spark, sf_dir, scores.both_graphs(spark, sf_dir), 2)).where("kind = 'struct'").select("feature", "delta")
    return rounded(best.join(own, "feature").select("concept", "feature", "test_f1", "delta"))


@query("WITH p AS (SELECT o_orderpriority AS g, sum(CASE WHEN o_orderdate < DATE '1995-01-01' THEN 1.0 ELSE 0 END) / count(*) AS train, sum(CASE WHEN o_orderdate >= DATE '1995-01-01' THEN 1.0 ELSE 0 END) / count(*) AS held FROM orders GROUP BY 1) SELECT g, train - held > 0.1 AS flagged FROM p")
def gap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.avg((F.col("o_orderdate") < F.lit("1995-01-01").cast("date")).cast("double"))
    own = B.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g")).agg(early.alias("train"), (1 - early).alias("held"))
    return rounded(own.select("g", features.gap_flag(F.col("train"), F.col("held")).alias("flagged")))


_PICKED = (
    "k0 AS (SELECT min(event_type) AS k FROM events), a AS (SELECT uid, position::DOUBLE AS p, row_number() OVER (PARTITION BY uid ORDER BY position) AS i FROM chains, k0 WHERE event_type = k), "
    "c AS (SELECT uid, list(position::DOUBLE ORDER BY position) AS free FROM chains, k0 WHERE event_type <> k GROUP BY uid), "
    "s AS (SELECT uid, 0::BIGINT AS i, free, NULL::DOUBLE AS anchor, NULL::DOUBLE AS control FROM c UNION ALL SELECT uid, i, list_filter(free, lambda x: x <> pick), p, pick FROM "
    "(SELECT s.uid, a.i, free, a.p, list_sort(list_transform(free, lambda x: {'g': abs(x - a.p), 'v': x}))[1].v AS pick FROM s JOIN a ON a.uid = s.uid AND a.i = s.i + 1 WHERE len(free) > 0)) "
)


@query(B.sql("chains", then=f"{_PICKED} SELECT uid, anchor, control, abs(anchor - control) AS gap FROM s WHERE i > 0").replace("WITH ", "WITH RECURSIVE ", 1))
def greedy_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of events of the first kind by name, each with the nearest free place of any other kind in its chain."""
    own = B.event_chains(spark, sf_dir).select("uid", F.col("position").cast("double").alias("position"), "event_type")
    kind = B.table(spark, sf_dir, "events").agg(F.min("event_type").alias("k"))  # one row
    marked = own.join(F.broadcast(kind)).select("uid", "position", (F.col("event_type") == F.col("k")).alias("first"))
    return rounded(sequences.greedy_controls(marked.where("first"), marked.where("NOT first"), "uid", "position"))


@query(B.sql("chains", then="t AS (SELECT uid, list(value ORDER BY position) AS v FROM chains GROUP BY uid) SELECT uid, CAST(len(v) AS BIGINT) AS n, round(list_sum(v[2:]) - 100, 4) + 0.0 AS total FROM t"))
def next_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a causal model over each chain's values, summed up; chains are bounded, so their arrays are."""
    own = B.event_chains(spark, sf_dir).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("s")).select("uid", F.col("s.value").alias("v"))
    labels = own.select("uid", "v", interventions.next_labels("v", -100).alias("y"))
    return rounded(labels.select("uid", F.size("y").alias("n"), F.aggregate("y", F.lit(0.0), lambda a, x: a + x).alias("total")), 4)


@query()
def masked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.domains(spark, sf_dir).select("uid", sequences.letters_to_ids(F.col("sequence"), "ACDEFGHIKLMNPQRSTVWY").alias("t"))
    out = interventions.masked_labels(own, "uid", "t", 3, 25, 5)
    return rounded(out.select("uid", F.size("inputs").alias("n"), F.size(F.filter("labels", lambda x: x >= 0)).alias("chosen"), F.size(F.filter("inputs", lambda x: x == 3)).alias("masked")))


@query("WITH e AS (SELECT l_returnflag AS kind, l_linenumber AS scale, CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS DOUBLE) END AS c, CAST(l_discount AS DOUBLE) * 100 AS o FROM lineitem) SELECT kind, CAST(scale AS BIGINT) AS scale, count(*) AS n, round(avg(c), 6) AS contact, round(avg(o), 6) AS other, round(avg(c - o), 6) + 0.0 AS specificity FROM e WHERE c IS NOT NULL GROUP BY ALL")
def specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _events(spark, sf_dir)
    return rounded(interventions.specificity(own, ["kind", "scale"], "c", "o"))


@query("WITH e AS (SELECT l_returnflag AS kind, CAST(l_linenumber AS DOUBLE) AS scale, CAST(l_quantity AS DOUBLE) AS c FROM lineitem WHERE l_linestatus = 'F') SELECT kind, round(regr_slope(c, scale), 6) + 0.0 AS slope FROM e GROUP BY kind")
def dose_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interventions.dose_slopes(_events(spark, sf_dir).where("c IS NOT NULL"), ["kind"], "scale", "c"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.table(spark, sf_dir, "lineitem")
    return own.select(F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("scale"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("double")).alias("c"), (F.col("l_discount").cast("double") * 100).alias("o"))


@query("WITH l AS (SELECT l_returnflag AS g, CAST(l_discount AS DOUBLE) AS clean, CAST(l_discount + l_tax AS DOUBLE) AS spliced, CAST(l_discount AS DOUBLE) + CAST(l_quantity AS DOUBLE) / 100 AS ablated FROM lineitem) SELECT g, count(*) AS n, round(avg(spliced - clean), 6) + 0.0 AS delta, round(avg(CASE WHEN ablated - clean > 0.1 THEN 1 - (spliced - clean) / (ablated - clean) END), 6) + 0.0 AS recovered FROM l GROUP BY g")
def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.table(spark, sf_dir, "lineitem")
    clean = F.col("l_discount").cast("double")
    rows = own.select(F.col("l_returnflag").alias("g"), clean.alias("clean"), (F.col("l_discount") + F.col("l_tax")).cast("double").alias("spliced"), (clean + F.col("l_quantity").cast("double") / 100).alias("ablated"))
    return rounded(interventions.faithfulness(rows, ["g"], "clean", "spliced", "ablated"))


@query("WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x) AS p FROM embeddings), q AS (SELECT vec_id, list_transform(p, lambda x: x / list_sum(p)) AS p FROM p) SELECT vec_id, round(list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x * 64) ELSE 0 END)), 5) + 0.0 AS kl FROM q")
def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of a vector's squared entries from even shares."""
    squares = F.transform("embedding", lambda x: x.cast("double") * x)
    own = B.table(spark, sf_dir, "embeddings").select("vec_id", squares.alias("s")).select("vec_id", F.transform("s", lambda x: x / F.aggregate("s", F.lit(0.0), lambda a, y: a + y)).alias("p"), F.array_repeat(F.lit(1 / 64), 64).alias("q"))
    return rounded(own.select("vec_id", interventions.divergence("p", "q").alias("kl")), 5)


@query("WITH e AS (SELECT p_partkey AS k, abs(p_retailprice - 1400) AS e, CAST(p_size AS DOUBLE) AS s FROM part), n AS (SELECT greatest(1, CAST(floor(count(*) * 0.05) AS BIGINT)) AS k FROM e), r AS (SELECT rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2 AS x, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS y FROM e), t AS (SELECT e, row_number() OVER (ORDER BY s DESC, k) AS i, row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws(':', 42, k)), 1, 8))::BIGINT, k) AS j FROM e) SELECT (SELECT count(*) FROM e) AS n, (SELECT round(corr(x, y), 6) + 0.0 FROM r) AS rho, round(avg(t.e) FILTER (WHERE i <= n.k), 5) AS top, round(avg(t.e) FILTER (WHERE j <= n.k), 5) AS chance, round(avg(t.e) FILTER (WHERE i <= n.k) / avg(t.e) FILTER (WHERE j <= n.k), 6) AS ratio FROM t, n")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice").cast("double") - 1400).alias("e"), F.col("p_size").cast("double").alias("s"))
    out = interventions.attribution(own, "k", "e", "s")
    return rounded(out).withColumn("top", F.round("top", 5)).withColumn("chance", F.round("chance", 5))


@query(B.sql("dense", "places", then="tp AS (SELECT uid, position // 4 AS token, feature, avg(z) AS z FROM dense GROUP BY ALL), sn AS (SELECT p.uid, p.position // 4 AS token, p.position, 1.0 / count(*) OVER (PARTITION BY p.uid, p.position // 4) AS w FROM places p) SELECT sn.uid, position, feature, round(sum(z * w), 6) + 0.0 AS z FROM tp JOIN sn ON tp.uid = sn.uid AND tp.token = sn.token GROUP BY ALL"))
def token_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of tokens brought to their places, each with a weight of one over the token's length."""
    own = B.values(spark, sf_dir).withColumn("z", F.greatest("z", F.lit(0.0))).groupBy("uid", F.expr("position div 4").alias("token"), "feature").agg(F.avg("z").alias("z"))
    spans = B.places(spark, sf_dir).withColumn("token", F.expr("position div 4")).withColumn("w", 1 / F.count(F.lit(1)).over(Window.partitionBy("uid", "token")))
    return rounded(graphs.project_tokens(own, spans, "z"))


@query(
    "WITH t AS (SELECT c_mktsegment AS model, c_nationkey AS layer, 1 + c_custkey % 97 AS length, c_custkey % 10 = 0 AS is_val, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS turn, 64 + 8 * c_nationkey AS e FROM customer) "
    "SELECT 'RANDOM-INIT ' || model AS model, layer, any_value(e) AS embed_dim, any_value(e) * CASE WHEN layer % 3 = 0 THEN 8 ELSE (10 * any_value(e) + 3) // any_value(e) END AS sae_hidden_dim, CASE WHEN layer % 2 = 0 THEN 256 ELSE 96 END AS k_sparse, 64 AS k_aux, 1000000 AS dead_threshold, "
    "count(*) AS num_proteins, CAST(sum(length) AS BIGINT) AS total_residues, count(*) FILTER (WHERE is_val) AS num_val, CAST(greatest(4, 4000000 // greatest(coalesce(sum(length) FILTER (WHERE NOT is_val), sum(length)), 1)) AS BIGINT) AS epochs, 'randomized_weights' AS control, 7 AS weight_seed FROM t WHERE turn <= 20 GROUP BY model, layer"
)
def control_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of random-weight controls: market segments as models, nations as layers, customers as chains."""
    c = B.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("model"), F.col("c_nationkey").alias("layer"), F.col("c_custkey").alias("uid"))
    size = 64 + 8 * F.col("layer")
    meta = c.select("model", "layer").distinct().select("model", "layer", size.alias("embed_dim"), F.when(F.col("layer") % 3 != 0, 10 * size + 3).alias("sae_hidden_dim"), F.when(F.col("layer") % 2 != 0, 96).alias("k_sparse"), F.lit(None).cast("int").alias("k_aux"), F.lit(None).cast("int").alias("dead_threshold"))
    chains = c.select("model", "layer", "uid", F.col("uid").alias("ordinal"), (1 + F.col("uid") % 97).alias("length"), (F.col("uid") % 10 == 0).alias("is_val"))
    return rounded(layers.control_metadata(meta, chains, 7, 20))
