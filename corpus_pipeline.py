"""Training text from `documents`: toxic ones out, copies out, near copies out, sources mixed, pieces encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.llm.common import cut, table
from strandworks.llm.exact_dedup import drop_exact_copies
from strandworks.llm.mixing import mixed_documents
from strandworks.llm.near_copies import drop_near_copies
from strandworks.llm.pieces import encoded
from strandworks.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op7's model, learnt from the labelled ones, doesn't predict toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of equal texts."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each component of texts with a Jaccard similarity of 0.8 or more on five-word shingles."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each document and pass over its source, its text the words taken."""
    return mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each row's text: the best segmentation, its score, the runner-up, and whether it reads back."""
    return encoded(docs, keep=["doc_id", "lang", "source"])


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: The mix's draws and permutations are hashes that SQL doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is cut from its lineage in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
