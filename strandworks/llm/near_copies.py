"""Near copies: components of texts whose sets of word shingles have a Jaccard similarity of at least SHARE.

First come SimHash fingerprints of the sets: sets whose fingerprints are equal or tied by two differing bits or fewer (the
covering search of simhash) are candidates. They find the closest copies, not all that similar. The rest of the links is
found by prefix filtering, so that together they are exact. Under any one order of all shingles, two sets that similar share one of their
first n - ceil(SHARE n) + 1 shingles. The order here is rare first, as seen in a bounded sample: the sample decides only
how many candidates there are, never which links are found. Sets are posted by number alone; bitmaps join only those that
meet another. Sets that meet under a shingle are candidates if sizes and
parity bitmaps allow the similarity (two bitmaps differ in no more bits than their sets in members), first small bitmaps,
then for each pair wide ones; candidates are verified on the shingles' bytes. A group is linked first by its members' next neighbours in row order; then all
candidates across the components so far are verified. Members of a run that no candidates tie can't link, so each tree of
candidates is a list of its own, one for however many shingles its members met under. Pairs inside one component need no
look, so few texts travel.

Cases: null and white-space texts have one empty shingle and link; texts of fewer words than a shingle have one shingle,
all of it; a null id is never preferred to another; one row of each component stays, also where rows repeat an id; an
empty table gives no rows; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, among, binary_values, cut, gathered, parts, small_batches, utf8, written
from .components import components
from .minhash import Bitmaps, forest, in_company, lists, own_tokens, several_roots, tied_across
from .simhash import fingerprint_links

#: Least Jaccard similarity of near copies, as a fraction, so that it is compared in whole numbers.
SHARE = (4, 5)
#: Texts whose shingles are counted for the order, and counted shingles that it knows.
SAMPLE, COMMON = 10_000, 100_000
#: In a run of sets with a shingle in common, each meets so many next ones at first.
NEXT = 7
#: Pairs of a run that are looked through for members without a candidate.
WORK = 400_000_000

#: Columns of a set's bitmap: bit i is the parity of its hashes that end in i.
BITS = ("b0", "b1", "b2", "b3")
#: Bits of the bitmaps that pairs are held to before their texts travel.
WIDE = 2048
#: Hashes that a task keeps of texts that it has verified.
CACHE = 4_000_000

_SETS = pa.schema([("_row", pa.int64()), ("_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("fp", pa.int64()), *[(b, pa.int64()) for b in BITS], ("wide", pa.binary()), ("prefix", pa.binary())])
_POSTINGS = pa.schema([(c, pa.int64()) for c in ("token", "node")])
_MET = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("later", pa.bool_())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingles(text: bytes, words: int) -> list[bytes]:
    """Runs of `words` words of the text in lower case, repeats included; all of a shorter text."""
    norm = b" ".join(text.lower().split())
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32).tolist()
    if len(gaps) < words:
        return [norm]
    return [norm[a:b] for a, b in zip([0, *[x + 1 for x in gaps]], [*gaps[words - 1 :], len(norm)])]


def _hashes(text: bytes, words: int) -> np.ndarray:
    return np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(text, words)], np.uint64))


def _fingerprint(own: np.ndarray) -> int:
    """SimHash of a set: bits that over half of its hashes have."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(own), 8192):
        counts += np.unpackbits(own[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(own), bitorder="little").view(np.uint64)[0])


def _least(n: np.ndarray | int) -> np.ndarray | int:
    """Members that a set of n shares at least with one that similar."""
    return (SHARE[0] * n + SHARE[1] - 1) // SHARE[1]


def _can_be(n: np.ndarray, m: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of n and m members that differ in at least `apart` members can be that similar."""
    # shared <= (n + m - apart) / 2 and united = n + m - shared
    return (SHARE[1] * np.minimum(n, m) >= SHARE[0] * np.maximum(n, m)) & (SHARE[1] * (n + m - apart) >= SHARE[0] * (n + m + apart))


def _tokens(words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for text in binary_values(batch.column(0)):
                own = _hashes(text, words).view(np.int64)
                for i in range(0, len(own), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(own[i : i + 65536])], names=["token"])

    return run


def _common(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, ascending, that several texts of a sample have, and in how many."""
    every = max(1, rows.count() // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("_row"), F.lit(every)) == 0).select("_text")
    counts = sample.mapInArrow(_tokens(words), "token long").groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 2")
    found = counts.orderBy(F.desc("c"), "token").limit(COMMON).collect()
    token, weight = np.array([r.token for r in found], np.int64).view(np.uint64), np.array([r.c for r in found], np.int64)
    order = np.argsort(token)
    return token[order], weight[order]


def _sets(words: int, common: np.ndarray, weight: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            digest, size, prefix, bitmap, wide, fp = [], [], [], [], [], []
            for text in binary_values(batch.column(2)):
                own = _hashes(text, words)
                rank = np.zeros(len(own), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    rank = np.where(common[at] == own, weight[at], 0)
                first = np.argsort(rank, kind="stable")[: len(own) - _least(len(own)) + 1]
                digest.append(xxhash.xxh3_128_digest(own.tobytes()))
                size.append(len(own))
                fp.append(_fingerprint(own))
                prefix.append(own[first].tobytes())
                bitmap.append(np.packbits((np.bincount((own & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(bool)).view(np.int64))
                wide.append(np.packbits((np.bincount((own % np.uint64(WIDE)).astype(np.int64), minlength=WIDE) & 1).astype(bool)).tobytes())
            bits = np.array(bitmap, np.int64).reshape(-1, 4)
            columns = [batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), *[pa.array(bits[:, i]) for i in range(4)], pa.array(wide, pa.binary()), pa.array(prefix, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=_SETS)

    return run


def _postings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        own = [np.frombuffer(p, np.int64) for p in batch.column("prefix").to_pylist()]
        if own:
            times = [len(p) for p in own]
            token = np.concatenate(own)
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), times)
            for i in range(0, len(token), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 65536]) for c in (token, node)], schema=_POSTINGS)


def _whole_runs(it: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[np.ndarray]:
    """Sorted batches as arrays (columns, rows) that split no run of equal first values."""
    held, n = [], 0
    for batch in it:
        if batch.num_rows:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            n += batch.num_rows
        if n >= rows:
            block = np.concatenate(held, axis=1)
            end = int(np.searchsorted(block[0], block[0, -1]))
            if end:
                yield block[:, :end]
            held, n = [block[:, end:]], 0
    if held:
        yield np.concatenate(held, axis=1)


def _apart(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Bits in which bitmaps differ."""
    return sum(np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64) for a, b in zip(one, other))


def _partnered(n: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    """Places of the members of a run that can be similar to another one; all of a run of over WORK pairs."""
    size = len(n)
    if size * size > WORK:
        return np.arange(size)
    out = np.zeros(size, bool)
    step = max(1, 250_000 // size)
    for i in range(0, size, step):
        here = slice(i, min(i + step, size))
        good = _can_be(n[here, None], n[None, :], _apart([b[here, None] for b in bits], [b[None, :] for b in bits]))
        good[np.arange(here.stop - i), np.arange(i, here.stop)] = False
        out |= good.any(axis=0)
    return np.flatnonzero(out)


def _trees(n: np.ndarray, bits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the members of a run that _partnered has, and for each the first place that candidates tie it to; a run of
    over WORK pairs is one tree."""
    here = _partnered(n, bits)
    tree = np.zeros(len(here), np.int64)
    if len(n) ** 2 > WORK:
        return here, tree
    left = np.arange(len(here))
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        tree[root] = here[root]
        while len(front) and len(left):
            good = np.zeros(len(left), bool)
            step = max(1, 250_000 // len(left))
            x = here[left][None, :]
            for i in range(0, len(front), step):
                y = here[front[i : i + step]][:, None]
                good |= _can_be(n[y], n[x], _apart([b[y] for b in bits], [b[x] for b in bits])).any(axis=0)
            front, left = left[good], left[~good]
            tree[front] = here[root]
    return here, tree


def _meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b) among near neighbours of each run, and of runs that hold more pairs again the members that have
    candidates, each tree of them under a token made of its members."""
    for token, node, n, *bits in _whole_runs(it):
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(start, len(token)))
        end = np.repeat(start + size, size)
        for shift in range(1, NEXT + 1):
            i = np.flatnonzero(end > np.arange(len(token)) + shift)
            j = i + shift
            hit = _can_be(n[i], n[j], _apart([b[i] for b in bits], [b[j] for b in bits]))
            a, b = node[i[hit]], node[j[hit]]
            for k in range(0, len(a), 65536):
                own = [pa.array(x[k : k + 65536]) for x in (np.minimum(a, b), np.maximum(a, b))]
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(own[0]), pa.int64())] * 2, *own, pa.array(np.full(len(own[0]), shift > 1))], schema=_MET)
        more, own_lists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in zip(start.tolist(), (start + size).tolist()):
            if y - x > NEXT + 1:
                here, tree = _trees(n[x:y], [b[x:y] for b in bits])
                if len(here):
                    more.append(x + here)
                    own_lists.append(own_tokens(node[x + here], tree))
        more, own_lists = np.concatenate(more), np.concatenate(own_lists)
        for k in range(0, len(more), 65536):
            at = more[k : k + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(own_lists[k : k + 65536]), pa.array(node[at]), *[pa.nulls(len(at), pa.int64())] * 2, pa.nulls(len(at), pa.bool_())], schema=_MET)


def _across(all_pairs: bool):
    """(token, a, b): pairs that tie components of each run together. Small bitmaps sift first, wide ones what they leave.
    Columns: token, node, n, root, bar, the small bitmap and the wide one; bar: -1, or a node found not to be similar."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, edges, wide in lists(it):
            for s, e in zip(edges[:-1], edges[1:]):
                here = s + np.flatnonzero(block[4, s:e] < 0)
                if not len(here):  # its members are in one component by now
                    continue
                barred = set(zip(*block[:, s:e][:, block[4, s:e] >= 0][[1, 4]].tolist()))
                _, node, n, root, _, *bits = block[:, here]
                maps = Bitmaps([wide[i] for i in here])

                def similar(i: int, met: np.ndarray, n: np.ndarray = n, bits: list[np.ndarray] = bits, maps: Bitmaps = maps) -> np.ndarray:
                    good = _can_be(n[i], n[met], _apart([b[i] for b in bits], [b[met] for b in bits]))
                    good[good] = _can_be(n[i], n[met[good]], maps.apart(i, met[good]))
                    return good

                pairs = np.array(list(forest(node, root, barred, similar, all_pairs)), np.int64).reshape(-1, 2)
                for k in range(0, len(pairs), 16384):
                    x, y = node[pairs[k : k + 16384, 0]], node[pairs[k : k + 16384, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), block[0, s])), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["token", "a", "b"])

    return run


def _similar(words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        total = 0

        def hashes(row: int, text: bytes) -> np.ndarray:
            nonlocal total
            if row not in held:
                if total > CACHE:
                    held.clear()
                    total = 0
                held[row] = _hashes(text, words)
                total += len(held[row])
            return held[row]

        def similar(one: np.ndarray | set, other: np.ndarray | set, shared: int) -> bool:
            return SHARE[1] * shared >= SHARE[0] * (len(one) + len(other) - shared)

        for batch in it:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            good = []
            for i, (left, right) in enumerate(zip(binary_values(batch.column("left")), binary_values(batch.column("right")))):
                one, other = hashes(a[i], left), hashes(b[i], right)
                if similar(one, other, len(np.intersect1d(one, other, assume_unique=True))):
                    one, other = set(shingles(left, words)), set(shingles(right, words))
                    if similar(one, other, len(one & other)):
                        good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], schema=_PAIRS)

    return run


def _close(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those of the pairs whose sizes and wide bitmaps allow the similarity."""
    for batch in it:
        if batch.num_rows:
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, WIDE // 64) for c in ("wa", "wb"))
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            good = pa.array(_can_be(n, m, np.bitwise_count(one ^ other).sum(axis=1, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], schema=_PAIRS)


def _candidates(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that are left by sizes and wide bitmaps."""
    both, _ = gathered(pairs.distinct())
    some = among(sets, both.select("a", "b"), "node")
    for end in ("a", "b"):
        both = both.join(some.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("wide").alias(f"w{end}")), end)
    return both.mapInArrow(_close, "a long, b long")


def _fingerprinted(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that their fingerprints tie: of equal ones, and of the links between fingerprints."""
    least, n = gathered(sets.groupBy("fp").agg(F.min("node").alias("least")))
    least = F.broadcast(least) if n <= FEW else least
    same = sets.select("node", "fp").join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    links = gathered(fingerprint_links(least.select("fp")).distinct())[0]
    for end in ("a", "b"):
        links = links.join(least.select(F.col("fp").alias(end), F.col("least").alias(f"_{end}")), end)
    return same.unionByName(links.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))


def _few(ids: DataFrame) -> DataFrame:
    """Marked for broadcast if few; ids is cut."""
    return F.broadcast(ids) if ids.count() <= FEW else ids


def _verified(pairs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar."""
    pairs, _ = gathered(pairs.distinct())
    texts = among(rows.select("_row", "_text"), pairs.select("a", "b"), "_row")
    both = pairs.join(texts.select(F.col("_row").alias("b"), F.col("_text").alias("right")), "b")
    both = both.join(texts.select(F.col("_row").alias("a"), F.col("_text").alias("left")), "a")
    return gathered(both.mapInArrow(_similar(words), "a long, b long"))[0]


def _apart_so_far(pairs: DataFrame, so_far: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose ends aren't in one component yet."""
    so_far, n = gathered(so_far)
    so_far = F.broadcast(so_far) if n <= FEW else so_far
    for end in ("a", "b"):
        pairs = pairs.join(so_far.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    return pairs.where("_a <> _b").select("a", "b")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """docs with one row of each component, the one with the least id; all its columns."""
    small_batches(docs.sparkSession)
    n = parts(docs.sparkSession)
    whole = written(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.monotonically_increasing_id().alias("_row")))
    rows = whole.select("_row", F.col(f"_doc.{id_col}").cast("long").alias("_id"), utf8(f"_doc.{text_col}").alias("_text"))
    common, weight = _common(rows, words)
    each = rows.mapInArrow(_sets(words, common, weight), "_row long, _id long, digest binary, n long, fp long, b0 long, b1 long, b2 long, b3 long, wide binary, prefix binary")
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("best")
    same = each.groupBy("digest").agg(best, *[F.first(c).alias(c) for c in ("n", "fp", *BITS, "wide", "prefix")])
    sets = cut(same.select(F.col("best._row").alias("node"), F.col("best._id").alias("_id"), "n", "fp", *BITS, "wide", "prefix"))
    postings = sets.select("node", "prefix").mapInArrow(_postings, "token long, node long").repartition(n, "token").sortWithinPartitions("token").mapInArrow(in_company, "token long, node long")
    told = postings.join(sets.select("node", "n", *BITS), "node").select("token", "node", "n", *BITS)
    met = cut(told.repartition(n, "token").sortWithinPartitions("token", "node").mapInArrow(_meet, "token long, node long, a long, b long, later boolean"))
    links = _verified(_candidates(_fingerprinted(sets), sets), rows, words)
    first = _apart_so_far(met.where("NOT later").select("a", "b").distinct(), components(links))
    links = links.unionByName(_verified(_candidates(first, sets), rows, words))
    so_far = components(links)
    posted = gathered(met.where("token IS NOT NULL").select("token", "node").distinct())[0]

    def meet(posted: DataFrame, so_far: DataFrame, barred: DataFrame | None, all_pairs: bool) -> DataFrame:
        none = F.lit(-1).cast("long").alias("bar")
        several = gathered(several_roots(posted, so_far))[0]
        each = several.join(among(sets, several.select("node"), "node"), "node").select("token", "node", "n", "root", none, *BITS, "wide")
        if barred is not None:
            zero = F.lit(0).cast("long")
            each = each.unionByName(barred.select("token", F.col("a").alias("node"), zero.alias("n"), zero.alias("root"), F.col("b").alias("bar"), *[zero.alias(c) for c in BITS], F.lit(b"").alias("wide")))
        return each.repartition(n, "token").sortWithinPartitions("token", "node").mapInArrow(_across(all_pairs), "token long, a long, b long")

    later = _apart_so_far(met.where("later").select("a", "b").distinct(), so_far)
    links = links.unionByName(_verified(_candidates(later, sets), rows, words))
    roots = components(tied_across(posted, links, meet, lambda pairs: _verified(_candidates(pairs, sets), rows, words)))
    named = sets.select("node", "_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "node")).alias("first")
    kept = named.groupBy("root").agg(first).select(F.col("first.node").alias("_row"))
    gone = cut(rows.select("_row").join(kept, "_row", "left_anti"))
    return whole.join(_few(gone), "_row", "left_anti").select("_doc.*")
