"""Exact deduplication with counting quotient filters.

Each partition folds the 64-bit fingerprints of its normalised texts into counting quotient filters, one for each
range of quotients. Filters of a range merge losslessly: quotient and remainder together are the fingerprint, so
merging is a merge of sorted remainders that adds counts. Only fingerprints counted more than once go on to byte
verification, which groups the whole normalised texts; all other rows never leave their partition with their text.

Cases: a null text is an empty one; all-white-space texts are one space and no equal of the empty text; of rows that
repeat a doc_id with an equal text, one counts as kept; a null doc_id never beats another one, and of a group in which
all are null, one row is kept; an empty table gives no rows; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, parts

#: Fingerprints that a partition holds before it hands its filters on.
FILTER_CAPACITY = 4_000_000

_FILTER = pa.schema([("block", pa.int32()), ("filter", pa.binary())])
_COUNTED = pa.schema([("fp", pa.int64()), ("n", pa.int64())])


def normalised(text: str | Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE, " ")


class QuotientFilter:
    """Counting quotient filter over 64-bit fingerprints, packed in slot order.

    A fingerprint's top `q` bits are its quotient, the rest its remainder. `occupied` has a bit for each quotient from
    `first` on, `runend` one for each slot that ends a quotient's run, `counter` one for each slot that holds the count
    of the remainder before it (a count of one takes no slot). Remainders ascend within a run.
    """

    def __init__(self, q: int, first: int, occupied: np.ndarray, runend: np.ndarray, counter: np.ndarray, slots: np.ndarray):
        self.q, self.first, self.occupied, self.runend, self.counter, self.slots = q, first, occupied, runend, counter, slots

    @classmethod
    def build(cls, fps: np.ndarray, counts: np.ndarray, q: int) -> QuotientFilter:
        """fps: ascending and distinct, uint64."""
        r = np.uint64(64 - q)
        quotient = (fps >> r).astype(np.int64)
        first = int(quotient[0]) if len(fps) else 0
        occupied = np.zeros(int(quotient[-1]) - first + 1 if len(fps) else 0, bool)
        occupied[quotient - first] = True
        wide = counts > 1
        at = np.arange(len(fps)) + np.concatenate([[0], np.cumsum(wide)[:-1]]).astype(np.int64) if len(fps) else np.zeros(0, np.int64)
        slots = np.zeros(len(fps) + int(wide.sum()), np.uint64)
        counter, runend = np.zeros(len(slots), bool), np.zeros(len(slots), bool)
        slots[at] = fps & np.uint64((1 << int(r)) - 1)
        slots[at[wide] + 1] = counts[wide].astype(np.uint64)
        counter[at[wide] + 1] = True
        last = np.concatenate([quotient[1:] != quotient[:-1], [True]]) if len(fps) else np.zeros(0, bool)
        runend[(at + wide)[last]] = True
        return cls(q, first, occupied, runend, counter, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints, ascending, and their counts."""
        heads = np.flatnonzero(~self.counter)
        run = np.cumsum(self.runend) - self.runend  # which run each slot is in
        quotient = (np.flatnonzero(self.occupied) + self.first).astype(np.uint64)[run[heads]]
        counts = np.ones(len(heads), np.int64)
        has = np.flatnonzero(np.append(self.counter, False)[heads + 1])
        counts[has] = self.slots[heads[has] + 1].astype(np.int64)
        return quotient << np.uint64(64 - self.q) | self.slots[heads], counts

    def dumps(self) -> bytes:
        head = np.array([self.q, self.first, len(self.occupied), len(self.slots)], np.int64).tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.runend, self.counter)) + self.slots.tobytes()

    @classmethod
    def loads(cls, data: bytes) -> QuotientFilter:
        q, first, wide, n = (int(x) for x in np.frombuffer(data, np.int64, 4))
        at, bits = 32, []
        for k in (wide, n, n):
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, (k + 7) // 8, at), count=k).astype(bool))
            at += (k + 7) // 8
        return cls(q, first, *bits, np.frombuffer(data, np.uint64, n, at))

    @staticmethod
    def merged(filters: list[QuotientFilter]) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints of some filters, ascending, counts of equal ones added."""
        pairs = [f.items() for f in filters]
        fps, counts = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        order = np.argsort(fps, kind="stable")  # sorted stretches: this merges them
        fps, counts = fps[order], counts[order]
        start = np.flatnonzero(np.concatenate([[True], fps[1:] != fps[:-1]])) if len(fps) else np.zeros(0, np.int64)
        return fps[start], np.add.reduceat(counts, start) if len(fps) else counts


def _filters(blocks: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            fps, counts = np.unique(np.concatenate(held), return_counts=True)
            q = max(6, int(np.ceil(np.log2(len(fps) / 0.9 + 1))))
            block = ((fps >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
            cuts = [(int(block[a]), QuotientFilter.build(fps[a:b], counts[a:b], q).dumps()) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cuts], pa.int32()), pa.array([c[1] for c in cuts], pa.binary())], schema=_FILTER)

        held, n = [], 0
        for batch in it:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                n += batch.num_rows
            if n >= FILTER_CAPACITY:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    return run


def _repeated(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints that the merged filters of a block count more than once."""
    held = [QuotientFilter.loads(x) for batch in it for x in batch.column("filter").to_pylist()]
    if held:
        fps, counts = QuotientFilter.merged(held)
        fps, counts = fps[counts > 1].view(np.int64), counts[counts > 1]
        for i in range(0, len(fps), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(fps[i : i + 65536]), pa.array(counts[i : i + 65536])], schema=_COUNTED)


def repeated_fingerprints(fps: DataFrame) -> DataFrame:
    """(fp, n) of the 64-bit values in the one column of `fps` that occur more than once."""
    n = parts(fps.sparkSession)
    built = fps.mapInArrow(_filters(n), "block int, filter binary")
    return built.repartition(n, "block").mapInArrow(_repeated, "fp long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256."""
    norm = normalised(text_col)
    base = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"))
    digests = cut(base.select("_id", F.xxhash64("_norm").alias("fp"), F.sha2("_norm", 256).alias("text_sha256")))
    suspects = repeated_fingerprints(digests.select("fp"))
    verified = (
        base.withColumn("fp", F.xxhash64("_norm"))
        .join(suspects.select("fp"), "fp", "left_semi")
        .groupBy("_norm")  # whole texts are compared; equal ones meet in the partial sums before they are dealt
        .agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.sha2("_norm", 256).alias("text_sha256"), "keep_id", "group_size")
        .where("group_size > 1")
    )
    once = F.row_number().over(Window.partitionBy("_id", "text_sha256").orderBy("fp")) == 1
    out = digests.withColumn("_once", once).join(verified, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_id").eqNullSafe(keep) & F.col("_once")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups doesn't keep; all its columns."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("_k"), F.col("text_sha256").alias("_s"))
    first = F.row_number().over(Window.partitionBy("_id", "_sha").orderBy("_sha"))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.sha2(normalised(text_col), 256).alias("_sha"))
    picked = keyed.join(kept, F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_sha") == F.col("_s")), "left_semi")
    return picked.withColumn("_n", first).where("_n = 1").select("_row.*")
