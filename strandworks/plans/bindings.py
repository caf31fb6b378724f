"""The driver's tables as chains, places, activations and groups. CTES says the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHAIN, DIMS = 20, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, position, vec, label, vec_id): chains of CHAIN vectors."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr(f"vec_id div {CHAIN}").alias("uid"), (F.col("vec_id") % CHAIN).cast("int").alias("position"), F.col("embedding").alias("vec"), "label", "vec_id")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("uid", "position")


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, position, feature, z, label), z as it is."""
    long = vectors(spark, sf_dir).select("uid", "position", "label", F.posexplode("vec").alias("feature", "z"))
    return long.withColumn("z", F.col("z").cast("double"))


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, position, feature, z): z > 0 only."""
    return values(spark, sf_dir).where("z > 0").drop("label")


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("uid", "position", *[F.col("vec")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


def event_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, position, event_type, value): a user's events in order."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("uid"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("position"), "event_type", "value", "event_id")


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, fold, sequence, file_ordinal, lang): documents as letters only."""
    d = table(spark, sf_dir, "documents")
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]+", ""))  # what is left has no other letters to be raised
    return d.select(F.col("doc_id").alias("uid"), F.col("source").alias("fold"), letters.alias("sequence"), F.col("doc_id").alias("file_ordinal"), "lang")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, path, cluster, value): customers in a hierarchy region.nation.segment.customer, with what they ordered."""
    c, n, r, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    spent = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("value"))
    named = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).join(spent, "c_custkey")
    path = F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"), "c_mktsegment", F.col("c_custkey").cast("string"))
    return named.select(F.col("c_custkey").alias("uid"), path.alias("path"), F.col("n_name").alias("cluster"), "value")


CTES = {
    "vectors": f"vectors AS (SELECT vec_id // {CHAIN} AS uid, vec_id % {CHAIN} AS position, embedding AS vec, label, vec_id FROM embeddings)",
    "places": f"places AS (SELECT vec_id // {CHAIN} AS uid, vec_id % {CHAIN} AS position FROM embeddings)",
    "dense": f"dense AS (SELECT vec_id // {CHAIN} AS uid, vec_id % {CHAIN} AS position, label, f - 1 AS feature, CAST(embedding[f] AS DOUBLE) AS v, greatest(CAST(embedding[f] AS DOUBLE), 0) AS z FROM embeddings, (SELECT unnest(range(1, {DIMS + 1})) AS f))",
    "coords": f"coords AS (SELECT vec_id // {CHAIN} AS uid, vec_id % {CHAIN} AS position, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)",
    "chains": "chains AS (SELECT user_id AS uid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position, event_type, value, event_id FROM events)",
    "domains": "domains AS (SELECT doc_id AS uid, source AS fold, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z]', '', 'g') AS sequence, doc_id AS file_ordinal, lang FROM documents)",
    "units": "units AS (SELECT c_custkey AS uid, concat_ws('.', n_regionkey, n_nationkey, c_mktsegment, c_custkey) AS path, n_name AS cluster, value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN (SELECT o_custkey, avg(o_totalprice) AS value FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)",
    "contact": "contact AS (SELECT a.uid, a.position AS src, b.position AS dst, abs(a.position - b.position) AS sep, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS dist FROM coords a JOIN coords b ON a.uid = b.uid AND a.position <> b.position WHERE abs(a.position - b.position) >= 3 AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) <= 0.2)",
    "band": "band AS (SELECT a.uid, a.position AS src, b.position AS dst FROM places a JOIN places b ON a.uid = b.uid AND abs(a.position - b.position) BETWEEN 1 AND 2)",
}


def sql(*names: str, then: str) -> str:
    """The named CTEs and a query over them; further CTEs may lead `then`."""
    return "WITH " + ", ".join(CTES[n] for n in names) + (", " + then if not then.lstrip().upper().startswith("SELECT") else " " + then)
