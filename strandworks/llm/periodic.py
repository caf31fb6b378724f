"""Periodic runs of words: maximal stretches whose words repeat at least twice, found in tiles and stitched.

For period q, place i is set if words i and i + q are the same; a stretch [lo, hi) of set places is the run of words
[lo, hi + q). It counts if hi - lo >= max(q, LEAST - q) and no smaller period has the same run.

Periods are taken by octaves [b, 2b). A stretch that counts holds a boundary, a multiple of b, and on one side of each of
its boundaries b / 2 set places at least. The tile of a boundary is the b words before it and the 3b words from it on.
Fingerprints of b / 2 words, by doubling, tell which periods of the octave can hold there; for those, the Z-function of the
boundary (how far its words equal those q later, backwards and forwards) is read off the words themselves, up to b each
way. What reaches further comes again as a fragment of the next boundary. Fragments are dealt by document and period, and
touching ones are stitched. Periods under 2 LEAST (rounded to a power of two) are short enough for a look at all places.

Tiles of the documents of a batch lie end to end in one array, as words of different documents never equal; documents of
more than LONG bytes become rows of tiles that are dealt over tasks. A period that a smaller one implies at a boundary is
passed over, so texts of one word cost no more than others.

Cases: null, empty and white-space texts have no words and no runs; repeated rows each get their row; a null id is an id
like others (and never seeded); an empty table gives no rows; further columns are left alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_values, parts, small_batches, utf8, written

#: Words of the shortest run.
LEAST = 12
#: Periods below this are looked for at all places.
SHORT = 16
#: Bytes of a text whose tiles are dealt over tasks, and words of such a tile.
LONG, TILE = 1 << 19, 1 << 16
#: Words that are compared at a time, and words of the texts that are solved together.
COMPARED, TOGETHER = 1 << 20, 1 << 19

_FRAGMENT = pa.struct([("period", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
_RUN = pa.struct([("start", pa.int64()), ("period", pa.int64()), ("length", pa.int64())])
_SOLVED = pa.schema([("_row", pa.int64()), ("_id", pa.int64()), ("n_words", pa.int64()), ("dealt", pa.bool_()), ("plain_sha256", pa.string()), ("_text", pa.binary()), ("fragments", pa.list_(_FRAGMENT))])
_TILES = pa.schema([("_row", pa.int64()), ("octave", pa.int64()), ("at", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("ids", pa.binary())])
_FRAGMENTS = pa.schema([("_row", pa.int64()), ("period", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def seeded(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a periodic end, for a tenth of the ids, as op13's contract has it."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[: n - a]


def _words(doc_id: int | None, text: bytes, seeds: bool) -> list[bytes]:
    words = text.split()
    return seeded(doc_id, words) if seeds else words


def _numbered(words: list[bytes], first: int = 0) -> np.ndarray:
    """Equal numbers for equal words, from `first` on."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, first + len(seen)) for w in words), np.int64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
    return step[::2], step[1::2]


def stitched(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals with touching ones united."""
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], np.maximum.accumulate(hi[order]) if len(hi) else hi
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]])) if len(lo) else np.zeros(0, np.int64)
    return lo[first], hi[np.append(first[1:], len(hi)) - 1] if len(lo) else hi


def _extent(ids: np.ndarray, b: np.ndarray, q: np.ndarray, size: int, step: int) -> np.ndarray:
    """How many words from b on (step 1), or before it (step -1), equal those q later, up to `size`."""
    out = np.zeros(len(b), np.int64)
    on, done = np.arange(len(b)), 0
    while len(on) and done < size:  # looks twice as far each time, at those that go on
        more = min(max(8, done), size - done)
        for i in range(0, len(on), max(1, COMPARED // more)):
            own = on[i : i + max(1, COMPARED // more)]
            at = b[own][:, None] + (np.arange(done, done + more) if step > 0 else -1 - np.arange(done, done + more))[None, :]
            other = at + q[own][:, None]
            inside = (at >= 0) & (other < len(ids))
            same = inside & (ids[np.where(inside, at, 0)] == ids[np.where(inside, other, 0)])
            out[own] += np.where(same.all(axis=1), more, same.argmin(axis=1))
        done += more
        on = on[out[on] == done]
    return out


def fragments(ids: np.ndarray, lo: int, hi: int, octaves: list[int], known: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, lo, hi) of the stretches round the boundaries in [lo, hi), as far as tiles reach, for octaves of the given
    least periods; 1 stands for all periods below SHORT, whose stretches are cut at lo and hi. Stretches that end inside a
    tile and are too short are left out. ids: the words' numbers, from b before lo to 3b past hi where there are any. known:
    further octaves, and all are then looked through all over the ids, for what they imply about longer periods."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    root, root_end = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64)  # a period known round a word, and its end
    low, high = (lo, hi) if known is None else (0, len(ids))

    def keep(period: int, start: np.ndarray, end: np.ndarray) -> None:
        found.append((np.full(len(start), period), start, end))

    def note(period: int, start: np.ndarray, end: np.ndarray) -> None:
        for s, e in zip(start.tolist(), end.tolist()):
            if e - s >= period:
                own = slice(s, e + period)
                free = root[own] == 0
                root[own][free] = period
                root_end[own][free] = e + period

    for q in range(1, SHORT) if 1 in octaves or 1 in (known or []) else ():
        x = ids[low : min(high + q, len(ids))]
        if len(x) > q:
            start, end = _stretches(x[:-q] == x[q:])
            good = end - start >= max(q, LEAST - q)
            note(q, start[good] + low, end[good] + low)
            if 1 in octaves:
                start, end = np.maximum(start + low, lo), np.minimum(end + low, hi)
                good = (start < end) & ((end - start >= max(q, LEAST - q)) | (start == lo) | (end == hi))
                keep(q, start[good], end[good])
    prints, half = _mixed(ids.astype(np.uint64) + np.uint64(1)), 1  # prints[i]: of `half` words from i on
    for b in sorted({x for x in [*octaves, *(known or [])] if x > 1}):
        while half < b // 2:
            prints = _mixed(prints[:-half] * np.uint64(0xD6E8FEB86659FD93) + prints[half:]) if len(prints) > half else prints[:0]
            half *= 2
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        bounds = np.arange(-(-low // b) * b, high, b)
        for shift in (0, half):  # words after the boundary, words before it
            own = bounds[(bounds >= shift) & (bounds - shift + b < len(prints))]
            for i in range(0, len(own), max(1, COMPARED // b)):
                some = own[i : i + max(1, COMPARED // b)] - shift
                block = prints[some[0] + b : some[-1] + 2 * b]
                whole = len(block) // b
                k, j = np.nonzero(block[: whole * b].reshape(whole, b) == prints[some[:whole], None])
                hits.append((some[k] + shift, j + b))
                if whole < len(some):  # the last boundary, whose octave ends with the words
                    j = np.flatnonzero(block[whole * b :] == prints[some[whole]])
                    hits.append((np.full(len(j), some[whole] + shift), j + b))
        if not hits:
            continue
        at, q = (np.concatenate(x) for x in zip(*hits))
        implied = root[at].astype(np.int64)
        new = (implied == 0) | (q % np.maximum(implied, 1) != 0) | (at + q >= root_end[at])
        q, at = np.unique(np.stack([q[new], at[new]]), axis=1)
        left, right = _extent(ids, at, q, b, -1), _extent(ids, at, q, b, 1)
        good = (left + right >= q) | (left == b) | (right == b)
        q, at, start, end = q[good], at[good], (at - left)[good], (at + right)[good]
        inside = (at >= lo) & (at < hi)
        edges = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1], [True]])) if len(q) else np.zeros(1, np.int64)
        for s, e in zip(edges[:-1], edges[1:]):
            note(int(q[s]), *stitched(start[s:e], end[s:e]))
            if b in octaves and inside[s:e].any():
                keep(int(q[s]), *stitched(start[s:e][inside[s:e]], end[s:e][inside[s:e]]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def _octaves(n: int) -> list[int]:
    """Least periods of the octaves that n words have room for."""
    out = [1]
    b = SHORT
    while 2 * b <= n:
        out.append(b)
        b *= 2
    return out


def _solve(seeds: bool, long: int):
    """A row for each document: its fragments and, if it has any, its text; longer ones only have their text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int | None, bytes, list[bytes]]] = []
        words = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal words
            size = np.array([len(w) if len(t) <= long else 0 for _, _, t, w in held], np.int64)
            start = np.concatenate([[0], np.cumsum(size)])
            ids, first = np.zeros(int(start[-1]), np.int64), 0
            for k, (_, _, _, w) in enumerate(held):
                if size[k]:
                    ids[start[k] : start[k + 1]] = _numbered(w, first)
                    first += len(w)
            q, lo, hi = fragments(ids, 0, len(ids), _octaves(int(size.max(initial=0))))
            good = hi - lo >= np.maximum(q, LEAST - q)  # whole documents are here, so what is stitched is whole
            q, lo, hi = q[good], lo[good], hi[good]
            doc = np.searchsorted(start, lo, side="right") - 1
            order = np.argsort(doc, kind="stable")
            offsets = np.searchsorted(doc[order], np.arange(len(held) + 1))
            struct = pa.StructArray.from_arrays([pa.array(q[order]), pa.array((lo - start[doc])[order]), pa.array((hi - start[doc])[order])], fields=list(_FRAGMENT))
            dealt = [len(t) > long for _, _, t, _ in held]
            some = [d or offsets[k + 1] > offsets[k] for k, d in enumerate(dealt)]
            columns = [
                pa.array([r for r, *_ in held], pa.int64()), pa.array([i for _, i, *_ in held], pa.int64()), pa.array([len(w) for *_, w in held], pa.int64()), pa.array(dealt, pa.bool_()),
                pa.array([None if s else hashlib.sha256(b" ".join(w)).hexdigest() for s, (*_, w) in zip(some, held)], pa.string()), pa.array([t if s else None for s, (_, _, t, _) in zip(some, held)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_SOLVED)
            held.clear()
            words = 0

        for batch in it:
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_values(batch.column(2))):
                held.append((row, doc_id, text, _words(doc_id, text, seeds)))
                words += len(held[-1][3])
                if words > TOGETHER:
                    yield from out()
        if held:
            yield from out()

    return run


def _tiles(seeds: bool, tile: int):
    """Tiles of long documents: the small octaves share tiles of `tile` words, larger ones have one for each boundary."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_values(batch.column(2))):
                ids = _numbered(_words(doc_id, text, seeds)).astype(np.int32)
                for octave in [1, *[b for b in _octaves(len(ids)) if 4 * b > tile]]:
                    step = tile if octave == 1 else octave
                    reach = max(tile // 4, SHORT) if octave == 1 else octave
                    for lo in range(0, len(ids), step):
                        at, hi = max(0, lo - reach), min(lo + step if octave == 1 else lo + 1, len(ids))
                        own = ids[at : hi + 3 * reach]
                        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (row, octave, at, lo, hi)] + [pa.array([own.tobytes()], pa.binary())], schema=_TILES)

    return run


def _solve_tiles(tile: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row, octave, at, lo, hi, ids in zip(*[c.to_pylist() for c in batch.columns]):
                own = np.frombuffer(ids, np.int32).astype(np.int64)
                some = [octave] if octave > 1 else [b for b in _octaves(len(own)) if 4 * b <= tile or b == 1]
                q, start, end = fragments(own, lo - at, hi - at, some, [b for b in _octaves(len(own)) if b < octave])
                for i in range(0, len(q), 65536):
                    n = len(q[i : i + 65536])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row)), pa.array(q[i : i + n]), pa.array(start[i : i + n] + at), pa.array(end[i : i + n] + at)], schema=_FRAGMENTS)

    return run


def _collapse(seeds: bool):
    """Each document's runs, and the words that no run drops: all of a run but its first period is dropped.

    A boundary that a smaller period implies is passed over, so a multiple of it can be left with a part of its stretch;
    such a part goes on beyond its ends in the words and is no run."""
    schema = pa.schema([("_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            left, out = [], []
            for doc_id, text, runs in zip(batch.column("_id").to_pylist(), binary_values(batch.column("_text")), batch.column("runs").to_pylist()):
                words = _words(doc_id, text, seeds)
                change, whole = np.zeros(len(words) + 1, np.int64), []
                for r in runs:
                    start, period, end = r["start"], r["period"], r["start"] + r["length"]
                    if (start == 0 or words[start - 1] != words[start - 1 + period]) and (end == len(words) or words[end] != words[end - period]):
                        whole.append(r)
                        change[start + period] += 1
                        change[end] -= 1
                left.append(whole)
                out.append(b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]))
            columns = [batch.column("_id"), batch.column("n_words"), pa.array(left, pa.list_(_RUN)), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: bool = False, long: int | None = None, tile: int | None = None) -> DataFrame:
    """One row per row of docs: _id, n_words, runs (start, period, length; by start, then period), plain_sha256 (of all
    words joined by one space) where there are no runs, and collapsed (the words that are left) where there are some.
    seeds: whether texts are made periodic first, as op13's contract has it."""
    small_batches(docs.sparkSession)
    n, tile = parts(docs.sparkSession), tile or TILE
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), docs[id_col].cast("long").alias("_id"), utf8(text_col).alias("_text"))
    solved = written(rows.mapInArrow(_solve(seeds, long or LONG), "_row long, _id long, n_words long, dealt boolean, plain_sha256 string, _text binary, fragments array<struct<period: long, lo: long, hi: long>>"))
    here = solved.select("_row", F.explode("fragments").alias("f")).select("_row", "f.*")
    tiles = solved.where("dealt").select("_row", "_id", "_text").mapInArrow(_tiles(seeds, tile), "_row long, octave long, at long, lo long, hi long, ids binary")
    dealt = tiles.repartition(n, "_row", "octave", "lo").mapInArrow(_solve_tiles(tile), "_row long, period long, lo long, hi long")
    by_start = Window.partitionBy("_row", "period").orderBy("lo", "hi")
    pieces = here.unionByName(dealt).repartition(n, "_row", "period")
    pieces = pieces.withColumn("so_far", F.max("hi").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
    pieces = pieces.withColumn("island", F.sum((F.col("so_far").isNull() | (F.col("lo") > F.col("so_far"))).cast("long")).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    whole = pieces.groupBy("_row", "period", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(f"hi - lo >= greatest(period, {LEAST} - period)")
    runs = whole.groupBy("_row", F.col("lo").alias("start"), (F.col("hi") - F.col("lo") + F.col("period")).alias("length")).agg(F.min("period").alias("period"))
    listed = runs.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    none = F.array().cast("array<struct<start: long, period: long, length: long>>")
    plain = solved.where("_text IS NULL").select("_id", "n_words", none.alias("runs"), "plain_sha256", F.lit(None).cast("string").alias("collapsed"))
    some = solved.where("_text IS NOT NULL").join(listed, "_row", "left").select("_id", "n_words", "_text", F.coalesce("runs", none).alias("runs"))
    kept = some.mapInArrow(_collapse(seeds), "_id long, n_words long, runs array<struct<start: long, period: long, length: long>>, collapsed string")
    return plain.unionByName(kept.select("_id", "n_words", "runs", F.lit(None).cast("string").alias("plain_sha256"), "collapsed"))


def run_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: bool = True) -> DataFrame:
    """What op13 returns: of each document the longest run, and hashes of all runs and of the words that are left."""
    found = periodic_runs(docs, id_col, text_col, seeds)
    best = found.withColumn("_best", F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))"))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return best.select(
        F.col("_id").alias(id_col), F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.coalesce(F.sha2("collapsed", 256), "plain_sha256").alias("collapsed_sha256"),
    )
