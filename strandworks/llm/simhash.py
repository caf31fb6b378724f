"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit for each bit that is set in more than half of a text's shingle hashes. For radius r, every bit
position gets a non-zero vector of r + 1 bits; the 2^(r+1) - 1 non-zero vectors v give the masks, mask v holding the
positions whose vector has an odd product with v. The vectors of r positions span at most r dimensions, so some v is
orthogonal to all of them, and two fingerprints that differ in at most r bits are equal under that v's mask: no pair is
missed. Distinct fingerprints meet in the buckets of each mask; a bucket hands on a forest of its links, never all pairs.

Cases: null and white-space texts have fingerprint zero and link like others; texts of fewer words than a shingle have
one shingle, all of it; a null doc_id is never a component's id unless all of the component's are null; rows that
repeat an id each get their row; an empty table gives no rows; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, cut, parts, small_batches
from .components import components

#: Buckets of up to this many fingerprints are compared shift by shift; larger ones look up each near fingerprint.
SHIFT_LIMIT = 2048

_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of a text over shingles of `words` words, repeats included; bit set if set in over half of them."""
    norm = b" ".join(text.lower().split())
    if not norm:
        return 0
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32).tolist()
    xxh = xxhash.xxh64_intdigest
    if len(gaps) < words:
        hashes = [xxh(norm, 42)]
    else:
        hashes = [xxh(norm[a:b], 42) for a, b in zip([0, *[x + 1 for x in gaps]], [*gaps[words - 1 :], len(norm)])]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        block = np.array(hashes[i : i + 8192], np.uint64)
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.array([fingerprint(t, words) for t in binary_values(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps)], names=["_id", "fp"])

    return run


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The masks of a covering family for `radius`, as signed 64-bit values."""
    vectors = [1 + i * 5 % (2 ** (radius + 1) - 1) for i in range(bits)]
    masks = [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node of each node's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
        a, b = a[root[a] != root[b]], b[root[a] != root[b]]
    return root


def _bucket_links(key: np.ndarray, fp: np.ndarray, free: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links between fingerprints of the same bucket. Sorted by key, then fp; free: bits outside the mask."""
    n = len(fp)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, n))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    left = np.repeat(np.where(size <= SHIFT_LIMIT, start + size, 0), size)  # end of the bucket, for those compared by shifts
    at, shift = np.flatnonzero(left > np.arange(n) + 1), 1
    held = 0
    while len(at):
        hit = at[np.bitwise_count(fp[at] ^ fp[at + shift]) <= radius]
        if len(hit):
            found.append((hit, hit + shift))
            held += len(hit)
        if held > 2_000_000:  # only what ties components is kept
            root = _roots(n, *(np.concatenate(x) for x in zip(*found)))
            on = np.flatnonzero(root != np.arange(n))
            found, held = [(on, root[on])], len(on)
        shift += 1
        at = at[left[at] > at + shift]
    for s, m in zip(start[size > SHIFT_LIMIT], size[size > SHIFT_LIMIT]):
        own = fp[s : s + m]
        bits = [np.uint64(1 << b) for b in range(64) if int(free[s]) >> b & 1]
        flips = [x for x in bits] + ([x | y for i, x in enumerate(bits) for y in bits[:i]] if radius > 1 else [])
        order = np.argsort(own, kind="stable")
        own = own[order]
        root = np.arange(m)
        for f in flips:
            where = np.minimum(np.searchsorted(own, own ^ f), m - 1)
            a = np.flatnonzero((own[where] == own ^ f) & (where > np.arange(m)))
            if len(a):
                both = _roots(m, np.concatenate([a, np.arange(m)]), np.concatenate([where[a], root]))
                root = both
        on = np.flatnonzero(root != np.arange(m))
        found.append((s + order[on], s + order[root[on]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    root = _roots(n, *(np.concatenate(x) for x in zip(*found)))
    on = np.flatnonzero(root != np.arange(n))
    return on, root[on]


def _links(masks: list[int], radius: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("t").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False)) for b in it if b.num_rows]
        if not held:
            return
        t, fp = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]).view(np.uint64)
        mask = np.array(masks, np.int64).view(np.uint64)
        for k in range(len(masks)):
            own = fp[t == k]
            if len(own) > 1:
                key = own & mask[k]
                order = np.lexsort((own, key))
                a, b = _bucket_links(key[order], own[order], np.broadcast_to(~mask[k], len(own)), radius)
                a, b = own[order][a].view(np.int64), own[order][b].view(np.int64)
                for i in range(0, len(a), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 65536]), pa.array(b[i : i + 65536])], schema=_LINKS)

    return run


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links that tie together the components of distinct fingerprints `fp` under at most `radius` differing bits."""
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    masks = covering_masks(radius)
    n = parts(fps.sparkSession)
    dealt = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("b"))
    return dealt.select("fp", "b.t", "b.key").repartition(n, "t", "key").select("t", "fp").mapInArrow(_links(masks, radius), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id (the least id that links reach)."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.encode(F.col(text_col), "UTF-8").alias("_text"))
    each = cut(source.mapInArrow(_fingerprints(words), "_id long, fp long"))
    distinct = cut(each.groupBy("fp").agg(F.min("_id").alias("least")))
    roots = components(fingerprint_links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return each.join(named, "fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
