"""Locality queries: both graphs, permutations, sweeps of thresholds and graphs, nulls, and controls, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.functions.lineage import cut
from strandworks.functions.ordering import within_group_permutation
from strandworks.operators import chainwise, graphs, locality, resampling
from strandworks.plans import bindings as B
from strandworks.plans.registry import query, rounded

CUTOFFS, WINDOWS, GAPS, FRACS = (0.1, 0.15, 0.2), (1, 2, 3), (3, 5, 7), (0.05, 0.1, 0.2)


def perm_sql(perms: int, seed: int = 42) -> str:
    """CTE perm (perm, uid, position, source), 0 being the identity."""
    return (
        f"pr AS (SELECT perm, uid, position, row_number() OVER (PARTITION BY perm, uid ORDER BY position) AS a, row_number() OVER (PARTITION BY perm, uid ORDER BY md5(concat_ws(':', {seed}, perm, uid, position)), position) AS b FROM places, (SELECT unnest(range(1, {perms + 1})) AS perm)), "
        "perm AS (SELECT x.perm, x.uid, x.position, y.position AS source FROM pr x JOIN pr y ON x.perm = y.perm AND x.uid = y.uid AND x.a = y.b UNION ALL SELECT 0, uid, position, position FROM places)"
    )


BOTH_SQL = "edge AS (SELECT 'seq' AS kind, uid, src, uid AS other, dst FROM band UNION ALL SELECT 'struct', uid, src, uid, dst FROM contact)"


def fraction_sql(fracs: tuple[float, ...], dense: str = "dense") -> str:
    return f"st AS (SELECT feature, stddev_pop(z) AS s, unnest({list(fracs)}::DOUBLE[]) AS frac, unnest(quantile_cont(z, {[round(1 - f, 12) for f in fracs]})) AS t FROM {dense} GROUP BY feature)"


def scores_sql(perms: int, edges: str = BOTH_SQL, stats: str = fraction_sql((0.1,)), dense: str = "dense") -> str:
    """CTEs up to sc (perm, kind, feature, frac, n_active, d)."""
    return (
        f"{perm_sql(perms)}, pz AS (SELECT perm, p.uid, p.position, feature, z FROM perm p JOIN {dense} d ON d.uid = p.uid AND d.position = p.source), {edges}, {stats}, "
        "sm AS (SELECT perm, kind, e.uid, e.src AS position, feature, avg(z) AS m FROM edge e JOIN pz ON pz.uid = e.other AND pz.position = e.dst GROUP BY ALL), "
        "sc AS (SELECT pz.perm, k.kind, pz.feature, frac, count(*) FILTER (WHERE z > t) AS n_active, CASE WHEN count(*) FILTER (WHERE z > t) < 5 THEN 0 ELSE (avg(coalesce(m, 0)) FILTER (WHERE z > t) - avg(coalesce(m, 0))) / (max(s) + 1e-6) END AS d "
        "FROM pz CROSS JOIN (SELECT DISTINCT kind FROM edge) k JOIN st ON st.feature = pz.feature LEFT JOIN sm ON sm.perm = pz.perm AND sm.kind = k.kind AND sm.uid = pz.uid AND sm.position = pz.position AND sm.feature = pz.feature GROUP BY ALL)"
    )


DELTA_SQL = "dl AS (SELECT kind, feature, frac, max(d) FILTER (WHERE perm = 0) AS observed, avg(d) FILTER (WHERE perm > 0) AS shuffled FROM sc GROUP BY ALL)"
_BASE = ("dense", "places", "band", "coords", "contact")


def both_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = graphs.band_edges(B.places(spark, sf_dir), 2).select(F.lit("seq").alias("kind"), "uid", "src", "dst")
    return near.unionByName(graphs.contact_edges(B.coords(spark, sf_dir), max(CUTOFFS), 3).select(F.lit("struct").alias("kind"), "uid", "src", "dst"))


def scored(spark: SparkSession, sf_dir: str, edges: DataFrame, perms: int, stats: DataFrame | None = None, kinds: tuple[str, ...] = ("seq", "struct")) -> DataFrame:
    """Scores at every permutation of edges inside chains, of the given kinds."""
    acts, places = B.acts(spark, sf_dir), B.places(spark, sf_dir)
    return chainwise.chain_scores(acts, places, edges, cut(locality.feature_stats(acts, places, [0.1]) if stats is None else stats), perms, kinds)


@query(B.sql(*_BASE, then=f"{scores_sql(3)} SELECT CAST(perm AS BIGINT) AS perm, kind, feature, n_active, round(d, 6) + 0.0 AS d FROM sc"))
def locality_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir, both_graphs(spark, sf_dir), 3).drop("frac"))


@query(B.sql(*_BASE, then=f"{scores_sql(3)}, {DELTA_SQL} SELECT kind, feature, round(observed, 6) + 0.0 AS observed, round(shuffled, 6) + 0.0 AS shuffled, round(observed - shuffled, 6) + 0.0 AS delta FROM dl"))
def locality_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(locality.deltas(scored(spark, sf_dir, both_graphs(spark, sf_dir), 3)).drop("frac"))


_CELLS = ", ".join(f"round(max({c}) FILTER (WHERE kind = '{k}'), 6) + 0.0 AS {k}_{n}" for k in ("struct", "seq") for n, c in (("observed", "observed"), ("shuffled", "shuffled"), ("delta", "observed - shuffled")))


@query(B.sql(*_BASE, then=f"{scores_sql(5)}, {DELTA_SQL} SELECT feature, {_CELLS} FROM dl GROUP BY feature"))
def locality_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(locality.score_table(scored(spark, sf_dir, both_graphs(spark, sf_dir), 5)))


@query(B.sql(*_BASE, then=f"{scores_sql(2)}, {DELTA_SQL} SELECT kind, count(*) AS n, round(avg(observed - shuffled), 6) + 0.0 AS mean_delta FROM dl GROUP BY kind"))
def locality_mean_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = locality.deltas(scored(spark, sf_dir, both_graphs(spark, sf_dir), 2))
    return rounded(own.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean_delta")))


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = locality.feature_stats(B.acts(spark, sf_dir), B.places(spark, sf_dir), list(FRACS))
    return locality.deltas(scored(spark, sf_dir, both_graphs(spark, sf_dir), 2, stats))


_MULTI = f"{scores_sql(2, stats=fraction_sql(FRACS))}, {DELTA_SQL}"


@query(B.sql(*_BASE, then=f"{_MULTI} SELECT kind, feature, frac, round(observed - shuffled, 6) + 0.0 AS delta FROM dl"))
def locality_multi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_multi(spark, sf_dir).select("kind", "feature", "frac", "delta"))


@query(
    B.sql(
        *_BASE,
        then=f"{_MULTI}, s AS (SELECT a.frac AS low, b.frac AS high, a.feature, a.observed - a.shuffled AS x, b.observed - b.shuffled AS y FROM dl a JOIN dl b ON a.kind = 'seq' AND b.kind = 'seq' AND a.feature = b.feature AND (a.frac, b.frac) IN ((0.05, 0.1), (0.1, 0.2))), "
        "r AS (SELECT low, high, rank() OVER (PARTITION BY low ORDER BY x) + (count(*) OVER (PARTITION BY low, x) - 1) / 2 AS a, rank() OVER (PARTITION BY low ORDER BY y) + (count(*) OVER (PARTITION BY low, y) - 1) / 2 AS b FROM s) SELECT low, high, count(*) AS n, round(corr(a, b), 4) + 0.0 AS rho FROM r GROUP BY low, high",
    )
)
def topk_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do features keep their order when the active share changes?"""
    own = _multi(spark, sf_dir).where("kind = 'seq'")
    return rounded(locality.setting_stability(own, "frac", "feature", "delta"), 4)


@query(B.sql(*_BASE, then=f"{_MULTI} SELECT kind, frac, CAST(sum(CAST(observed - shuffled > 0.05 AS INT)) AS BIGINT) AS above, count(*) AS n FROM dl GROUP BY kind, frac"))
def topk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_multi(spark, sf_dir).groupBy("kind", "frac").agg(F.sum((F.col("delta") > 0.05).cast("int")).alias("above"), F.count(F.lit(1)).alias("n")))


_METRIC = "edge AS (SELECT 'gap' || g.gap AS kind, uid, src, uid AS other, dst FROM contact JOIN (SELECT unnest([3, 5, 7]) AS gap) g ON sep >= g.gap)"


@query(B.sql(*_BASE, then=f"{scores_sql(2, _METRIC, fraction_sql(FRACS))}, {DELTA_SQL} SELECT kind, frac, feature, round(observed - shuffled, 6) + 0.0 AS delta FROM dl"))
def metric_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least separations by active shares; contacts are found once."""
    found = graphs.contact_edges(B.coords(spark, sf_dir), max(CUTOFFS), min(GAPS))
    many = found.withColumn("gap", F.explode(F.array(*map(F.lit, GAPS)))).where("sep >= gap").select(F.concat(F.lit("gap"), "gap").alias("kind"), "uid", "src", "dst")
    stats = locality.feature_stats(B.acts(spark, sf_dir), B.places(spark, sf_dir), list(FRACS))
    return rounded(locality.deltas(scored(spark, sf_dir, many, 2, stats, tuple(f"gap{g}" for g in GAPS))).select("kind", "frac", "feature", "delta"))


_CUTOFF = f"edge AS (SELECT 'cut' || CAST(c.cut AS VARCHAR) AS kind, uid, src, uid AS other, dst FROM contact JOIN (SELECT unnest({[int(100 * c) for c in CUTOFFS]}) AS cut) c ON dist <= c.cut / 100)"


@query(B.sql(*_BASE, then=f"{scores_sql(2, _CUTOFF)}, {DELTA_SQL} SELECT kind, feature, round(observed - shuffled, 6) + 0.0 AS delta FROM dl"))
def cutoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact cutoffs; contacts are found once, at the widest."""
    found = graphs.contact_edges(B.coords(spark, sf_dir), max(CUTOFFS), 3)
    many = found.withColumn("cut", F.explode(F.array(*[F.lit(int(100 * c)) for c in CUTOFFS]))).where("dist <= cut / 100").select(F.concat(F.lit("cut"), "cut").alias("kind"), "uid", "src", "dst")
    return rounded(locality.deltas(scored(spark, sf_dir, many, 2, kinds=tuple(f"cut{int(100 * c)}" for c in CUTOFFS))).select("kind", "feature", "delta"))


_WINDOW = "wd AS (SELECT a.uid, a.position AS src, b.position AS dst, width FROM places a JOIN places b ON a.uid = b.uid AND a.position <> b.position JOIN (SELECT unnest([1, 2, 3]) AS width) w ON abs(a.position - b.position) <= width), edge AS (SELECT 'raw' || width AS kind, uid, src, uid AS other, dst FROM wd UNION ALL SELECT 'between' || width, uid, src, uid, dst FROM wd WHERE src // 3 <> dst // 3)"


@query(B.sql(*_BASE, then=f"{scores_sql(2, _WINDOW)}, {DELTA_SQL} SELECT kind, feature, round(observed - shuffled, 6) + 0.0 AS delta FROM dl"))
def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows along the chain, with all neighbours and with those of other tokens only."""
    many = graphs.band_edges(B.places(spark, sf_dir), max(WINDOWS)).withColumn("width", F.explode(F.array(*map(F.lit, WINDOWS)))).where("sep <= width")
    tokens = B.places(spark, sf_dir).withColumn("token", F.expr("position div 3"))
    raw = many.select(F.concat(F.lit("raw"), "width").alias("kind"), "uid", "src", "dst")
    between = graphs.between_tokens(many, tokens).select(F.concat(F.lit("between"), "width").alias("kind"), "uid", "src", "dst")
    return rounded(locality.deltas(scored(spark, sf_dir, raw.unionByName(between), 2, kinds=tuple(f"{k}{w}" for k in ("raw", "between") for w in WINDOWS))).select("kind", "feature", "delta"))


_FIXED = "sx AS (SELECT median(z) AS s0 FROM dense WHERE z > 0), st AS (SELECT feature, stddev_pop(z) AS s, unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS frac, unnest([0.5, 1.0, 2.0]::DOUBLE[]) * max(s0) AS t FROM dense, sx GROUP BY feature)"


@query(B.sql(*_BASE, then=f"{scores_sql(2, stats=_FIXED)}, {DELTA_SQL} SELECT kind, frac AS factor, feature, round(observed - shuffled, 6) + 0.0 AS delta FROM dl"))
def threshold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds at 0.5, 1 and 2 times the median of the activations above 0."""
    stats = locality.fixed_stats(B.acts(spark, sf_dir), B.places(spark, sf_dir), [0.5, 1.0, 2.0])
    return rounded(locality.deltas(scored(spark, sf_dir, both_graphs(spark, sf_dir), 2, stats)).select("kind", F.col("frac").alias("factor"), "feature", "delta"))


_EFFECT = "(avg(v) FILTER (WHERE feature < 32) - avg(v) FILTER (WHERE feature >= 32)) / sqrt((var_samp(v) FILTER (WHERE feature < 32) + var_samp(v) FILTER (WHERE feature >= 32)) / 2 + 1e-12)"


@query(
    B.sql(
        *_BASE,
        then=f"{scores_sql(2, stats=_FIXED)}, {DELTA_SQL}, q AS (SELECT feature, quantile_cont(z, 0.9) AS t, stddev_pop(z) AS s FROM dense GROUP BY feature), qs AS (SELECT pz.perm, k.kind, pz.feature, CASE WHEN count(*) FILTER (WHERE z > t) < 5 THEN 0 ELSE (avg(coalesce(m, 0)) FILTER (WHERE z > t) - avg(coalesce(m, 0))) / (max(s) + 1e-6) END AS d FROM pz CROSS JOIN (SELECT DISTINCT kind FROM edge) k JOIN q ON q.feature = pz.feature "
        "LEFT JOIN sm ON sm.perm = pz.perm AND sm.kind = k.kind AND sm.uid = pz.uid AND sm.position = pz.position AND sm.feature = pz.feature GROUP BY ALL), "
        "u AS (SELECT kind, 'f' || frac AS n, feature, observed - shuffled AS v FROM dl UNION ALL SELECT kind, 'q', feature, max(d) FILTER (WHERE perm = 0) - avg(d) FILTER (WHERE perm > 0) FROM qs GROUP BY kind, feature), "
        f"e AS (SELECT kind, n, {_EFFECT} AS d FROM u GROUP BY kind, n), p AS (SELECT kind, max(d) FILTER (WHERE n = 'q') AS q, max(d) FILTER (WHERE n = 'f0.5') AS a, max(d) FILTER (WHERE n = 'f1.0') AS b, max(d) FILTER (WHERE n = 'f2.0') AS c FROM e GROUP BY kind) "
        "SELECT kind, round(q, 5) + 0.0 AS d_quantile, round(a, 5) + 0.0 AS d_half, round(b, 5) + 0.0 AS d_one, round(c, 5) + 0.0 AS d_two, round(100 * greatest(abs(a - q), abs(b - q), abs(c - q)) / greatest(abs(q), 0.01), 2) AS max_dev_pct FROM p",
    )
)
def threshold_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect sizes between two groups of features at fixed thresholds against the one at the percentile."""
    acts, places, edges = B.acts(spark, sf_dir), B.places(spark, sf_dir), both_graphs(spark, sf_dir)
    fixed = locality.deltas(scored(spark, sf_dir, edges, 2, locality.fixed_stats(acts, places, [0.5, 1.0, 2.0]))).withColumn("n", F.concat(F.lit("f"), F.col("frac").cast("string")))
    base = locality.deltas(scored(spark, sf_dir, edges, 2)).withColumn("n", F.lit("q"))
    effects = resampling.group_effects(fixed.unionByName(base), "delta", F.col("feature") < 32, ["kind", "n"])
    wide = effects.groupBy("kind").agg(*[F.max(F.when(F.col("n") == n, F.col("d"))).alias(c) for n, c in (("q", "d_quantile"), ("f0.5", "d_half"), ("f1.0", "d_one"), ("f2.0", "d_two"))])
    out = locality.deviation(wide, ["kind"], "d_quantile", ["d_half", "d_one", "d_two"])
    return rounded(out.withColumn("max_dev_pct", F.round("max_dev_pct", 2)), 5)


VAL_SQL = "vl AS (SELECT uid FROM (SELECT uid, row_number() OVER (ORDER BY md5(concat_ws(':', 42, uid)), uid) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT uid FROM places)) WHERE k <= greatest(1, floor(n * 0.4 + 0.5)))"


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = B.places(spark, sf_dir).select("uid").distinct()
    return resampling.validation_split(chains, "uid", 0.4, 42).where("is_val").select("uid")


@query(B.sql(*_BASE, then=f"{VAL_SQL}, dv AS (SELECT * FROM dense WHERE uid IN (SELECT uid FROM vl)), {scores_sql(2, stats=fraction_sql((0.1,), 'dv'), dense='dv')}, {DELTA_SQL} SELECT kind, feature, round(observed - shuffled, 6) + 0.0 AS delta FROM dl"))
def validation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the validation chains alone: deviations and thresholds are theirs too."""
    val = validation(spark, sf_dir)
    acts, places, edges = (f(spark, sf_dir).join(val, "uid", "left_semi") for f in (B.acts, B.places, both_graphs))
    own = chainwise.chain_scores(acts, places, edges, cut(locality.feature_stats(acts, places, [0.1])), 2, ("seq", "struct"))
    return rounded(locality.deltas(own).select("kind", "feature", "delta"))


_NULLS = (
    "dg AS (SELECT uid, src, count(*) AS degree FROM contact GROUP BY ALL), dn AS (SELECT d.uid, d.src, p.position AS dst, degree, row_number() OVER (PARTITION BY d.uid, d.src ORDER BY md5(concat_ws(':', 7, d.uid, d.src, p.position)), p.position) AS k FROM dg d JOIN places p ON d.uid = p.uid AND p.position <> d.src), "
    "gn AS (SELECT uid, position, row_number() OVER (ORDER BY md5(concat_ws(':', 9, concat_ws(':', uid, position))), concat_ws(':', uid, position)) - 1 AS i, count(*) OVER () AS n FROM places), "
    "edge AS (SELECT 'contact' AS kind, uid, src, uid AS other, dst FROM contact UNION ALL SELECT 'degree', uid, src, uid, dst FROM dn WHERE k <= degree UNION ALL SELECT 'global', c.uid, c.src, g.uid, g.position FROM contact c JOIN gn g ON g.i = ('0x' || substr(md5(concat_ws(':', 10, c.uid, c.src, c.dst)), 1, 8))::BIGINT % g.n)"
)


@query(B.sql(*_BASE, then=f"{scores_sql(2, _NULLS)}, {DELTA_SQL}, v AS (SELECT kind, observed - shuffled AS v FROM dl) SELECT kind, count(*) AS n, round(avg(v), 5) + 0.0 AS mean, round(median(v), 5) + 0.0 AS median, round(avg(CAST(v > 0 AS INT)), 5) AS frac_pos, round(quantile_cont(v, 0.95), 5) + 0.0 AS p95, round(avg(v) / (SELECT avg(v) FROM v WHERE kind = 'contact'), 3) + 0.0 AS ratio FROM v GROUP BY kind"))
def null_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contact graph's scores beside those of a degree-matched and of a global random graph."""
    places = B.places(spark, sf_dir)
    contact = graphs.contact_edges(B.coords(spark, sf_dir), max(CUTOFFS), 3).select("uid", "src", "dst")
    inside = contact.withColumn("kind", F.lit("contact")).unionByName(graphs.degree_matched_null(places, contact, 7).withColumn("kind", F.lit("degree")))
    across = graphs.weighted(graphs.global_null(places, contact, 9).withColumn("kind", F.lit("global")), ["kind"])
    acts, stats = B.acts(spark, sf_dir), cut(locality.feature_stats(B.acts(spark, sf_dir), places, [0.1]))
    moved = locality.permuted_acts(acts, within_group_permutation(places, ["uid"], "position", 2))
    # neighbours in other chains are joined row by row, those of the chain are summed up in one pass over it
    both = scored(spark, sf_dir, inside, 2, stats, ("contact", "degree")).unionByName(locality.locality(moved, places, across, stats))
    own_deltas = cut(locality.deltas(both))  # a row for each feature and graph, read several times
    out = locality.null_summary(own_deltas, "kind", "delta", "contact")
    return rounded(out.withColumn("ratio", F.round("ratio", 3)), 5)


_TOKENS = "t AS (SELECT uid, src, dst, src // 3 <> dst // 3 AS apart FROM band), edge AS (SELECT 'raw' AS kind, uid, src, uid AS other, dst FROM t UNION ALL SELECT 'between', uid, src, uid, dst FROM t WHERE apart)"


@query(B.sql(*_BASE, then=f"{scores_sql(2, _TOKENS)}, {DELTA_SQL}, m AS (SELECT kind, avg(observed - shuffled) AS m FROM dl GROUP BY kind), e AS (SELECT kind, count(*) AS edges FROM edge GROUP BY kind), w AS (SELECT max(m) FILTER (WHERE kind = 'raw') AS raw, max(m) FILTER (WHERE kind = 'between') AS corrected FROM m), x AS (SELECT max(edges) FILTER (WHERE kind = 'raw') AS edges, max(edges) FILTER (WHERE kind = 'between') AS between_edges FROM e) SELECT edges, between_edges, round(100 * (edges - between_edges) / edges, 5) AS excluded_pct, round(raw, 5) + 0.0 AS raw_delta, round(corrected, 5) + 0.0 AS corrected_delta, round(100 * (raw - corrected) / nullif(raw, 0), 2) + 0.0 AS reduction_pct FROM w, x"))
def token_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the sequence score when neighbours inside one token don't count."""
    band = graphs.band_edges(B.places(spark, sf_dir), 2)
    between = graphs.between_tokens(band, B.places(spark, sf_dir).withColumn("token", F.expr("position div 3")))
    edges = band.select(F.lit("raw").alias("kind"), "uid", "src", "dst").unionByName(between.select(F.lit("between").alias("kind"), "uid", "src", "dst"))
    raw = lambda c, v, f: f(F.when(F.col("kind") == v, F.col(c)))
    means = locality.deltas(scored(spark, sf_dir, edges, 2, kinds=("raw", "between"))).agg(raw("delta", "raw", F.avg).alias("raw_delta"), raw("delta", "between", F.avg).alias("corrected_delta"))
    counts = edges.agg(raw("uid", "raw", F.count).alias("edges"), raw("uid", "between", F.count).alias("between_edges"))
    out = counts.crossJoin(means)  # a row each
    out = out.withColumn("excluded_pct", 100 * (F.col("edges") - F.col("between_edges")) / F.col("edges")).withColumn("reduction_pct", 100 * (F.col("raw_delta") - F.col("corrected_delta")) / F.nullif("raw_delta", F.lit(0.0)))
    return rounded(out.withColumn("reduction_pct", F.round("reduction_pct", 2)), 5)


@query(B.sql("dense", "places", "band", then="st AS (SELECT feature, stddev_pop(v) AS s, quantile_cont(v, 0.9) AS t FROM dense GROUP BY feature), sm AS (SELECT b.uid, b.src AS position, feature, avg(v) AS m FROM band b JOIN dense d ON d.uid = b.uid AND d.position = b.dst GROUP BY ALL) SELECT d.feature, round((avg(coalesce(m, 0)) FILTER (WHERE v > t) - avg(coalesce(m, 0))) / (max(s) + 1e-6), 6) + 0.0 AS d FROM dense d JOIN st ON st.feature = d.feature LEFT JOIN sm ON sm.uid = d.uid AND sm.position = d.position AND sm.feature = d.feature GROUP BY d.feature"))
def dense_locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(locality.dense_scores(B.values(spark, sf_dir).drop("label"), graphs.band_edges(B.places(spark, sf_dir), 2), 0.1))


_CONTROLS = (
    "tr AS (SELECT DISTINCT uid, src, dst, dst - src AS sep FROM contact WHERE src < dst), cn AS (SELECT s.uid, s.sep, a.position AS c_src, a.position + s.sep AS c_dst FROM (SELECT DISTINCT uid, sep FROM tr) s JOIN places a ON a.uid = s.uid JOIN places b ON b.uid = s.uid AND b.position = a.position + s.sep WHERE NOT EXISTS (SELECT 1 FROM tr x WHERE x.uid = s.uid AND x.src = a.position AND x.dst = a.position + s.sep)), "
    "nb AS (SELECT *, row_number() OVER (PARTITION BY uid, sep ORDER BY c_src) - 1 AS i, count(*) OVER (PARTITION BY uid, sep) AS m FROM cn), mc AS (SELECT tr.uid, src, dst, c_src, c_dst FROM tr LEFT JOIN nb ON nb.uid = tr.uid AND nb.sep = tr.sep AND nb.i = ('0x' || substr(md5(concat_ws(':', 3, tr.uid, src, dst)), 1, 8))::BIGINT % nb.m)"
)


@query(B.sql("coords", "places", "contact", then=f"{_CONTROLS} SELECT * FROM mc"))
def separation_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.matched_controls(B.places(spark, sf_dir), graphs.contact_edges(B.coords(spark, sf_dir), max(CUTOFFS), 3), 3))


@query(
    B.sql(
        "coords", "places", "contact", "vectors",
        then=f"{_CONTROLS}, pr AS (SELECT uid, src, dst, 1 AS true_ FROM mc UNION ALL SELECT uid, c_src, c_dst, 0 FROM mc WHERE c_src IS NOT NULL), nv AS (SELECT uid, position, vec, sqrt(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE) * x))) + 1e-12 AS n FROM vectors), "
        "s AS (SELECT pr.uid, true_, list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (a.n * b.n) AS s FROM pr JOIN nv a ON a.uid = pr.uid AND a.position = src JOIN nv b ON b.uid = pr.uid AND b.position = dst), c AS (SELECT uid, avg(s) FILTER (WHERE true_ = 1) AS contact, avg(s) FILTER (WHERE true_ = 0) AS control FROM s GROUP BY uid) "
        "SELECT uid, round(contact, 6) + 0.0 AS contact, round(control, 6) + 0.0 AS control, round(contact - control, 6) + 0.0 AS locality FROM c WHERE contact IS NOT NULL AND control IS NOT NULL",
    )
)
def chain_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of vectors in contact less that of pairs of the same separation out of contact, for each chain."""
    return rounded(locality.chain_cosine(B.vectors(spark, sf_dir).select("uid", "position", "vec"), graphs.contact_edges(B.coords(spark, sf_dir), max(CUTOFFS), 3), 3))


@query(B.sql("coords", "places", then="SELECT a.uid, a.position, count(b.position) AS neighbours FROM coords a LEFT JOIN coords b ON a.uid = b.uid AND a.position <> b.position AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) <= 0.25 GROUP BY ALL"))
def neighbour_burial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of the chain within a radius, the next ones along it included."""
    return rounded(graphs.neighbour_counts(B.places(spark, sf_dir), graphs.contact_edges(B.coords(spark, sf_dir), 0.25, 1)).withColumnRenamed("degree", "neighbours"))


@query(B.sql("coords", then="SELECT a.uid, a.position AS src, b.position AS dst FROM coords a JOIN coords b ON a.uid = b.uid AND abs(a.position - b.position) >= 3 AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) BETWEEN 1e-300 AND 0.2"))
def true_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts by the rule that places at distance 0 are none."""
    return rounded(graphs.contact_edges(B.coords(spark, sf_dir), 0.2, 3, zero=False).select("uid", "src", "dst"))
