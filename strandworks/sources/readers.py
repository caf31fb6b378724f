"""Readers and writers of the pipeline's file forms. All go through Spark's own sources, so any store it reads will do."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandworks.functions.lineage import cut
from strandworks.functions.stats import percentiles

RESIDUES = "uid string, position int, ss_8class string, sasa double, neighbor_count int"
#: Three-letter codes of amino acids and their letters, the rare and the ambiguous ones last (fixed values).
LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
    "SEC": "U", "PYL": "O", "ASX": "B", "GLX": "Z", "UNK": "X",
}


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(uid, sccs, fold, sequence, file_ordinal) of `>uid sccs ...` records; fold: the first two dotted parts, `unknown` without.

    Records are split by the text source, so a large file is read by many tasks; the ordinal follows the file's order. A
    header is looked for up to its line's end only, and sequences are made apart from it: where no column of theirs is asked
    for, as in `read_headers`, no sequence is made.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("file_ordinal", F.monotonically_increasing_id())
    head = F.split(F.regexp_extract("value", r"^>?([^\r\n]*)", 1), r"\s+")
    sequence = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", ""))
    sccs = F.try_element_at(head, F.lit(2))
    out = raw.select(F.element_at(head, 1).alias("uid"), sccs.alias("sccs"), F.coalesce(F.array_join(F.slice(F.split(sccs, r"\."), 1, 2), "."), F.lit("unknown")).alias("fold"), sequence.alias("sequence"), "file_ordinal")
    return out.where("uid <> ''")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(uid, sccs, fold) of the records of read_fasta, without their sequences: maps from ids to folds and clusters."""
    return read_fasta(spark, path).select("uid", "sccs", "fold")


def shuffled_rows(rows: DataFrame, n: int, seed: int, buffer: int = 10_000) -> DataFrame:
    """n rows in no order of the table's, or all where there are fewer, from a bounded look at each partition.

    Every partition fills a buffer of so many rows, hands on half of it in a pseudorandom order, and fills it again until it
    has handed on its share; then it stops reading. If that gives fewer than n rows, as some partitions are short, shares
    are doubled. The same files, dealt alike, and the same seed give the same rows. What is read follows n and the buffers,
    not the table; the choice is as good as its buffers are large, unlike that of ordering.first_hashed, which ranks all.
    """
    count = rows.rdd.getNumPartitions()

    def dealt(share: int) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            draw = np.random.default_rng([seed, TaskContext.get().partitionId()])
            held: list[pa.RecordBatch] = []
            left, more = share, True
            while left and (more or held):
                while more and sum(b.num_rows for b in held) < buffer:
                    batch = next(it, None)
                    more = batch is not None
                    held += [batch] if batch is not None and batch.num_rows else []
                if not held:
                    return
                whole = pa.concat_batches(held)
                order = draw.permutation(whole.num_rows)
                some = min(left, whole.num_rows if not more else max(1, whole.num_rows // 2))
                yield whole.take(pa.array(order[:some]))
                left -= some
                rest = order[some:]
                held = [whole.take(pa.array(rest))] if len(rest) else []

        return rows.mapInArrow(run, rows.schema)

    share = -(-n // max(1, count))
    while True:
        found = cut(dealt(share).limit(n))
        m = found.count()
        if m >= n or m < share:  # enough, or no partition had as many as its share
            return found
        share *= 2


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """(file, chain, first, ordinal, letter, x, y, z) of the alpha carbons of every chain of the first model in fixed-width
    structure files. first: the line of a chain's first one; ordinals count from 0 in each chain; letters of unknown codes are X.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_extract("value", r"(?s)\A(.*?)(?:\nENDMDL|\z)", 1).alias("text"))
    rows = lines.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("line", "v")).where(F.substring("v", 1, 6).isin("ATOM  ") & (F.trim(F.substring("v", 13, 4)) == "CA") & F.substring("v", 17, 1).isin(" ", "A"))
    names = F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])
    number = lambda a: F.trim(F.substring("v", a, 8)).try_cast("double")
    cols = rows.select("file", "line", F.substring("v", 22, 1).alias("chain"), F.coalesce(F.try_element_at(names, F.upper(F.substring("v", 18, 3))), F.lit("X")).alias("letter"), number(31).alias("x"), number(39).alias("y"), number(47).alias("z"))
    of_chain = Window.partitionBy("file", "chain")
    numbered = cols.withColumn("ordinal", F.row_number().over(of_chain.orderBy("line")) - 1).withColumn("first", F.min("line").over(of_chain))
    return numbered.select("file", "chain", "first", "ordinal", "letter", "x", "y", "z")


def read_structures(spark: SparkSession, path: str, least: int = 5) -> DataFrame:
    """(file, chain, ordinal, letter, x, y, z): of each file only the first chain with `least` alpha carbons or more."""
    chains = read_chains(spark, path)
    long = chains.groupBy("file", "chain").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")).where(F.col("n") >= least)
    chosen = long.groupBy("file").agg(F.min_by("chain", "first").alias("chain"))
    return chains.drop("first").join(chosen, ["file", "chain"], "left_semi")


def read_sequences(spark: SparkSession, path: str, uids: list[str] | None = None) -> DataFrame:
    """(uid, sequence) from JSON files, each in any of four layouts: a map, a list of objects, a list of pairs, or a list of
    strings that goes with `uids`. Rows without either value are left out, but a list of strings of another length than
    uids is an error."""
    raw = spark.read.text(path, wholetext=True).withColumn("v", F.ltrim("value"))
    inside = F.substring(F.ltrim(F.regexp_replace("v", r"^\[", "")), 1, 1)
    kind = F.when(F.substring("v", 1, 1) == "{", "map").when(inside == "{", "objects").when(inside == "[", "pairs").otherwise("strings")
    raw = raw.withColumn("kind", kind)
    pair = lambda u, s: F.struct(u.cast("string").alias("uid"), s.cast("string").alias("sequence"))
    of_map = F.transform(F.map_entries(F.from_json("v", "map<string,string>")), lambda e: pair(e["key"], e["value"]))
    objects = F.from_json("v", "array<struct<uid:string,id:string,name:string,sequence:string,seq:string>>")
    first = lambda *cols: F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])
    of_objects = F.transform(objects, lambda r: pair(first(r["uid"], r["id"], r["name"]), first(r["sequence"], r["seq"])))
    of_pairs = F.transform(F.from_json("v", "array<array<string>>"), lambda r: pair(r[0], r[1]))
    names = F.array(*[F.lit(u) for u in uids or []]).cast("array<string>")
    strings = F.from_json("v", "array<string>")
    checked = F.when(F.size(strings) != F.size(names), F.raise_error(F.lit("as many uids are needed as there are sequences")).cast("array<string>")).otherwise(strings)
    of_strings = F.transform(F.arrays_zip(names.alias("u"), checked.alias("s")), lambda r: pair(r["u"], r["s"]))
    rows = F.when(F.col("kind") == "map", of_map).when(F.col("kind") == "objects", of_objects).when(F.col("kind") == "pairs", of_pairs).otherwise(of_strings)
    return raw.select(F.explode(rows).alias("r")).select("r.uid", "r.sequence").where("uid IS NOT NULL AND sequence IS NOT NULL")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(uid, sequence) of a data set's JSON file, by uid. Sorted by ranges, not by one task."""
    return read_sequences(spark, path).orderBy("uid")


def read_annotations(spark: SparkSession, path: str, wanted: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Rows of a (compressed) CSV of annotations whose key is wanted: the first `most` keys of those, if given.

    Comment lines begin with #. wanted: a table with the column key.
    """
    keys = wanted.select(key).distinct()
    keys = keys.orderBy(key).limit(most) if most else keys
    return spark.read.csv(path, header=True, comment="#").join(keys, key, "left_semi")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(accession, type, begin, end, description) of JSON files with a list `features` for each accession; null where one lacks a value."""
    kind = "struct<accession:string,features:array<struct<type:string,begin:string,end:string,description:string>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("r"))
    own = raw.select("r.accession", F.explode("r.features").alias("f"))
    return own.select("accession", "f.type", F.col("f.begin").try_cast("int").alias("begin"), F.col("f.end").try_cast("int").alias("end"), "f.description")


def check_counts(acts: DataFrame, lengths: DataFrame) -> DataFrame:
    """(uid, length, rows) of the chains whose activation rows are not as many as their length; none if all is well.

    acts: a row for each place (uid, position, ...); lengths: (uid, length).
    """
    own = acts.groupBy("uid").agg(F.count(F.lit(1)).alias("rows"))
    return lengths.select("uid", "length").join(own, "uid", "full").where(~F.col("length").eqNullSafe(F.col("rows"))).select("uid", "length", "rows")


def read_layer(spark: SparkSession, path: str, lengths: DataFrame) -> DataFrame:
    """A layer's activations; an error if some chain has not as many rows as its length. The check is a job of its own."""
    acts = spark.read.parquet(path)
    bad = check_counts(acts, lengths).first()
    if bad is not None:
        raise ValueError(f"chain {bad.uid} has {bad.rows} rows and length {bad.length}")
    return acts


def read_results(spark: SparkSession, folder: str, label: str, names: tuple[str, ...] = ("struct_seq_metrics", "feature_interpretability", "fold_enrichment")) -> dict[str, DataFrame]:
    """The result tables of a layer's folder by name, each with the column `label`."""
    return {n: spark.read.csv(f"{folder}/{n}.csv", header=True, inferSchema=True).withColumn("label", F.lit(label)) for n in names}


def complete_layers(spark: SparkSession, root: str, required: tuple[str, ...]) -> DataFrame:
    """(model, layers): layers under root/model/layer_N that have every required file. Only names are read, not contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    model, layer = parse_cell("path")
    named = files.select(model.alias("model"), layer.alias("layer"), F.element_at(F.split("path", "/"), -1).alias("file")).where("layer IS NOT NULL").where(F.col("file").isin(*required))
    whole = named.groupBy("model", "layer").agg(F.count_distinct("file").alias("n")).where(F.col("n") == len(required))
    return layers(whole)


def read_residues(spark: SparkSession, path: str) -> DataFrame:
    """The residue table from CSV: `position_pdb` is `position`, positions from 1 become positions from 0, '-' is null."""
    raw = spark.read.csv(path, header=True)
    raw = raw.withColumnRenamed("position_pdb", "position") if "position_pdb" in raw.columns else raw
    fields = [f.strip().split() for f in RESIDUES.split(",")]
    typed = raw.select(*[F.col(n).cast(t).alias(n) if n in raw.columns else F.lit(None).cast(t).alias(n) for n, t in fields])
    low = typed.agg(F.min("position").alias("_low"))
    shifted = typed.join(F.broadcast(low)).withColumn("position", F.col("position") - F.when(F.col("_low") == 1, 1).otherwise(0)).drop("_low")
    return shifted.withColumn("ss_8class", F.nullif("ss_8class", F.lit("-")))


def layers(results: DataFrame) -> DataFrame:
    """(model, layers): the layers that results partitioned by model and layer hold."""
    return results.groupBy("model").agg(F.sort_array(F.collect_set("layer")).alias("layers"))


def parse_cell(path: str) -> tuple:
    """Columns model and layer from paths like .../model/layer_12/..."""
    return F.regexp_extract(path, r"([^/]+)/layer_\d+", 1), F.regexp_extract(path, r"layer_(\d+)", 1).cast("int")


def write_cells(results: DataFrame, path: str) -> None:
    """Result tables by model and layer. A cell that is written again is replaced, also one that a run that broke off has left
    behind in parts; cells that results don't have stay. Files are staged and moved when all tasks have ended."""
    results.write.partitionBy("model", "layer").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def missing_cells(cells: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Those of the cells (model, layer) that no file under path has yet: what a run has still to do."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return cells
    done = spark.read.parquet(path).select(F.col("model").cast("string").alias("model"), F.col("layer").cast("long").alias("layer")).distinct()
    kinds = [F.col(c).cast(cells.schema[c].dataType).alias(c) for c in ("model", "layer")]
    return cells.join(done.select(*kinds), ["model", "layer"], "left_anti")


def write_dataset(entries: DataFrame, residues: DataFrame, path: str) -> None:
    """A data set's sequences as JSON lines, its residue table as CSV, and a one-row summary, under new folders of path."""
    n = F.length("sequence")
    middle = percentiles(entries.select(n.alias("n")), [], "n", [0.5]).select(F.col("value").alias("median_length"))
    summary = entries.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fold").alias("folds"), F.sum(n).alias("total"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(n).alias("mean_length")).crossJoin(middle)  # a row each
    entries.select("uid", "fold", "sequence").write.mode("errorifexists").json(f"{path}/sequences")
    residues.write.mode("errorifexists").option("header", True).csv(f"{path}/residues")
    summary.write.mode("errorifexists").json(f"{path}/summary")


def snapshot(table: DataFrame, path: str) -> bool:
    """Write a table under path once: if it is there whole, it stays. Whether it was written."""
    spark = table.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        return False
    table.write.mode("overwrite").parquet(path)  # what a run that broke off has left is no snapshot
    return True
