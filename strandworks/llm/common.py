"""Helpers that several of the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space in every contract of this package.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Narrow rows that make a partition of a gathered frame, and rows up to which one is broadcast.
GATHERED, FEW = 200_000, 500_000


def parts(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session is set to; buckets follow it, so their size is the cluster's choice."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _shared_folder(df: DataFrame) -> str:
    """The folder for checkpoints that the session names. Only in local mode (tests, a notebook), and only where none is
    named, a temporary one is set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    _shared_folder(df)
    return df.checkpoint()


def gathered(df: DataFrame) -> tuple[DataFrame, int]:
    """df of narrow rows, cut, in as few partitions as its rows need, and how many they are.

    A frame in one partition is joined and grouped without a shuffle, so many small steps leave no files in every partition.
    """
    out = cut(df)
    n = out.count()
    return out.coalesce(max(1, -(-n // GATHERED))), n


def among(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of df whose column `on`, a long, is in a column of ids, long ones all; few ids are broadcast, so that only those rows travel."""
    one = ids.select(F.explode(F.array(*ids.columns)).alias(on)).distinct()
    own, n = gathered(one)
    return df.join(F.broadcast(own) if n <= FEW else own, on, "left_semi")


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a compressed table in the shared folder: for rows with whole texts, read column by column."""
    path = f"{_shared_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bound what goes to Python at once: rows hold whole texts, some of them very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str) -> Column:
    """The bytes of a text column; null is empty."""
    return F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))


def binary_values(col: pa.Array) -> list[bytes]:
    """Values of a binary or string column as bytes; null is empty."""
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    return [x if x is not None else b"" for x in col.to_pylist()]


def batches(schema: pa.Schema, columns: dict[str, list | np.ndarray], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Columns as record batches of a bounded number of rows."""
    n = len(next(iter(columns.values())))
    for i in range(0, n, rows):
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name][i : i + rows], f.type) for f in schema], schema=schema)
