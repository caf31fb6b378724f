"""Removing repeated passages: prefix-free parsing and suffix arrays, dealt over the cluster.

A rolling hash of TRIGGER bytes chooses, for every window of MATCH bytes, the leftmost least hash inside it: the
window's trigger. Windows in a row with one trigger make a phrase; phrases overlap by MATCH - 1 bytes, so every window
lies in exactly one phrase, and equal windows lie at the same place before equal triggers wherever they occur. The
corpus is thereby parsed into phrases, of which the repeated ones make a dictionary.

1. Each task parses its texts in stretches and deals out each stretch's distinct triggers, once each with their count.
   A trigger that occurs once in the corpus has phrases with no repeated window; the stretches are told which of their
   triggers occur more often, and send the places of those to their texts.
2. The texts are parsed again, and phrases at those places go to the bucket of their trigger. A bucket's dictionary
   has each distinct phrase with its first place in the parse; at all later places every window is a repeat.
3. Phrases that share a trigger but differ are told apart by the suffix array of the bucket's dictionary, to the depth
   of MATCH bytes: ranks of 8, 16, 32, 64, then MATCH bytes. Combined with the order of the parse it puts the
   corpus's windows in order; of equal ones all but the first place repeat.

As phrases overlap by a whole window less one byte, no suffix that matters reaches beyond its phrase, so what the
parse has to add is the order of places, and its own suffix array to this depth is that of single phrases.

A task collapses what repeats inside it before anything is dealt, so a passage that is everywhere comes once from each
task. A trigger with more than HOT places, before which many different passages may stand, has its phrases cut into
single windows, each dealt by its own bytes.

This departs from suffix arrays of the whole dictionary and parse: no order of the whole corpus is built, and windows are
ranked to MATCH bytes inside a bucket. What is removed is the same, as equal windows always meet in one bucket.

Cases: a null or empty text gives zero lengths and the hash of no bytes; texts shorter than MATCH lose nothing; rows
that repeat a doc_id don't count as earlier than each other at the same start; where their texts differ each has its own
spans, and where they are equal what is found in one holds for the others; rows with a null doc_id lose nothing and take
nothing from others; an empty table gives no rows; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, parts, small_batches, utf8

MATCH = 100
TRIGGER = 32
#: Places of one trigger in the corpus from which its phrases are cut into single windows.
HOT = 4096
#: Bytes parsed at once; text and phrases that a task holds before it hands on what it has collapsed.
BLOCK, TASK_TEXT, TASK_PHRASES = 1 << 18, 1 << 23, 1 << 25
#: Bytes of phrases whose windows are ranked at once.
TASK_RANKED = 1 << 20
_LONGEST = 1 << 23

_BUCKET = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
_STRETCH = pa.schema([("bucket", pa.int32()), ("stretch", pa.int64()), ("data", pa.binary())])
_MARKS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("marks", pa.binary())])


def _byte_values() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(27)


_VALUES = _byte_values()


def trigger_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling hash of the TRIGGER bytes from each position on; TRIGGER is a power of two."""
    h, base, width = _VALUES[data], 0x100000001B3, 1
    while width < TRIGGER:
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base % (1 << 64), 2 * width
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def parse(data: bytes, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of texts that stand one after another in data: first and last window start, trigger's place and hash."""
    n = len(data)
    if n < MATCH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if n > 2 * _LONGEST:  # one very long text: slices whose windows follow on
        found = []
        for i in range(0, n - MATCH + 1, _LONGEST):
            part = data[i : i + _LONGEST + MATCH - 1]
            lo, hi, at, h = parse(part, [len(part)])
            found.append((lo + i, hi + i, at + i, h))
        return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]
    h = trigger_hashes(np.frombuffer(data, np.uint8))
    key = h & np.uint64(~0xFFFFFF & (1 << 64) - 1) | np.arange(len(h), dtype=np.uint64)
    at = (_sliding_min(key, MATCH - TRIGGER + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    valid = np.ones(len(at), bool)
    end = 0
    for x in lengths[:-1]:
        end += x
        valid[max(end - x, end - MATCH + 1) : end] = False
    valid[max(end, n - MATCH + 1) :] = False
    starts = np.flatnonzero(valid)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    trigger = at[starts]
    new = np.flatnonzero((trigger[1:] != trigger[:-1]) | (np.diff(starts) > 1)) + 1
    first, last = np.concatenate([[0], new]), np.append(new, len(starts)) - 1
    trigger = trigger[first]
    return starts[first], starts[last], trigger, h[trigger]


def _blocks(ids: list[int], texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """Doc ids, starts in data (with its end), and data for texts that hold a window, about BLOCK bytes at once."""
    own: list[tuple[int, bytes]] = []
    size = 0
    for i, t in [*zip(ids, texts), (None, b"")]:
        if own and (i is None or size + len(t) > BLOCK):
            yield np.array([o[0] for o in own], np.int64), np.cumsum([0, *[len(o[1]) for o in own]]), b"".join(o[1] for o in own)
            own, size = [], 0
        if len(t) >= MATCH:
            own.append((i, t))
            size += len(t)


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(data: bytes, kinds: list) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)


def _by_doc(doc: np.ndarray, part: np.ndarray, values: np.ndarray, n: int) -> pa.RecordBatch:
    """Values of rows, one or more columns of uint32, packed by bucket of docs. A row's part is a hash of its text."""
    bucket = doc % n
    order = np.argsort(bucket, kind="stable")
    edges = _runs(bucket[order])
    own = [order[a:b] for a, b in zip(edges[:-1], edges[1:])]
    return _rows([int(bucket[o[0]]) for o in own], [_pack(doc[o], part[o].astype(np.int32), values[o].ravel()) for o in own])


def _merged(width: int):
    """What _by_doc packs, as a row for each doc and part."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _grouped(it):
            pieces = [_unpack(x, [np.int64, np.int32, np.uint32]) for x in held]
            doc, part, values = (np.concatenate(x) for x in zip(*pieces))
            values = values.reshape(-1, width)
            order = np.lexsort((part, doc))
            doc, part, values = doc[order], part[order], values[order]
            edges = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]), [True]])) if len(doc) else np.zeros(1, np.int64)
            for i in range(0, len(edges) - 1, 16384):
                e = edges[i : i + 16385]
                offsets = ((e - e[0]) * 4 * width).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(e) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values[e[0] : e[-1]]).tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(doc[e[:-1]]), pa.array(part[e[:-1]]), column], schema=_MARKS)

    return run


def _of_docs(packed: DataFrame, width: int, n: int) -> DataFrame:
    """(doc_id, part, marks) from rows of (bucket, data)."""
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_merged(width), "doc_id long, part int, marks binary")


def _rows(buckets: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(data, pa.binary())], schema=_BUCKET)


def _stretch_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _STRETCH.types)], schema=_STRETCH)


#: Packed: a bucket's triggers of a stretch; a stretch's places, those at which a trigger comes again, and where it was first.
_TRIGGERS = [np.uint64, np.uint32, np.uint32]
_PLACES = [np.int64, np.int32, np.uint32, np.uint8, np.uint32, np.uint32]


def _even(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets of triggers. A trigger is the least hash of its window, so its leading bits are nearly always zero."""
    return ((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _deal_triggers(n: int):
    """Texts to the distinct triggers of stretches, (hash, first place, count) by bucket of the hash, and each stretch's places.

    A place is a number in the order of the stretch's text. Triggers of one text lie less than MATCH bytes apart, so
    offsets are kept as steps of a byte.
    """

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, part, count, step, h = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        edges = _runs(h[order])
        first, times = order[edges[:-1]], np.diff(edges)
        again = np.ones(len(h), bool)
        again[first] = False
        again = np.flatnonzero(again)
        of = np.empty(len(h), np.int64)
        of[order] = np.repeat(first, times)
        data = _pack(doc, part, count, step, again.astype(np.uint32), of[again].astype(np.uint32))
        # from the content alone, so that a task run again names its stretches alike
        stretch = int(np.uint64(xxhash.xxh64_intdigest(data, xxhash.xxh64_intdigest(h.tobytes()))).view(np.int64))
        own = h[first]
        bucket = _even(own, n)
        order = np.argsort(bucket, kind="stable")
        cuts = _runs(bucket[order])
        rows = [(stretch % n, stretch, b"P" + data)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            o = order[a:b]
            rows.append((int(bucket[o[0]]), 0, b"T" + np.int64(stretch).tobytes() + _pack(own[o], first[o].astype(np.uint32), times[o].astype(np.uint32))))
        return _stretch_rows(rows)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in it:
            doc, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for rows, starts, data in _blocks(list(range(batch.num_rows)), binary_values(batch.column(2))):
                lo, _, at, h = parse(data, np.diff(starts).tolist())
                text = np.searchsorted(starts, lo, "right") - 1
                new = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                step = np.diff(at, prepend=0)
                step[new] = at[new] - starts[text[new]]
                held.append((doc[rows[text[new]]], part[rows[text[new]]], np.diff(np.append(new, len(text))).astype(np.uint32), step.astype(np.uint8), h))
                size += len(data)
                if size > TASK_TEXT:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _answer(most: int):
    """Which triggers occur more than once in the corpus, told to the stretches that have them; places pass through.

    A stretch's answer is a first place, and half of uint32's range more if the trigger has over `most` places.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list[bytes]) -> Iterator[pa.RecordBatch]:
            pieces = [_unpack(x[9:], _TRIGGERS) for x in held]
            h = np.concatenate([p[0] for p in pieces])
            order = np.argsort(h, kind="stable")
            edges = _runs(h[order])
            sums = np.add.reduceat(np.concatenate([p[2] for p in pieces]).astype(np.int64)[order], edges[:-1])
            total = np.empty(len(h), np.int64)
            total[order] = np.repeat(sums, np.diff(edges))
            at, rows = 0, []
            for x, (own, first, _) in zip(held, pieces):
                sum_ = total[at : at + len(own)]
                at += len(own)
                more = sum_ > 1
                if more.any():
                    stretch = int(np.frombuffer(x, np.int64, 1, 1)[0])
                    rows.append((stretch, b"R" + (first[more] | (sum_[more] > most).astype(np.uint32) << np.uint32(31)).tobytes()))
            for i in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + 4096]], pa.int64()), pa.array([r[1] for r in rows[i : i + 4096]], pa.binary())], names=["stretch", "data"])

        for rows in _by_bucket(it):
            held = []
            for stretch, data in rows:
                if data[:1] == b"P":
                    yield pa.RecordBatch.from_arrays([pa.array([stretch], pa.int64()), pa.array([data], pa.binary())], names=["stretch", "data"])
                else:
                    held.append(data)
            if held:
                yield from told(held)

    return run


def _by_bucket(it: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[int, bytes]]]:
    """Rows of (stretch, data) for each bucket of sorted batches, read as they are asked for."""
    rows = ((b, s, d) for batch in it for b, s, d in zip(*[c.to_pylist() for c in batch.columns]))
    for _, own in groupby(rows, itemgetter(0)):
        yield ((s, d) for _, s, d in own)


def _repeated_places(n: int):
    """Places of the triggers that occur more than once: 2 * place, plus 1 if there are many. Rows come sorted by stretch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((s, d) for batch in it for s, d in zip(*[c.to_pylist() for c in batch.columns]))
        for _, own in groupby(rows, itemgetter(0)):
            places, told = None, []
            for _, data in own:
                if data[:1] == b"P":
                    places = data  # a stretch that comes twice has the same places
                else:
                    told.append(np.frombuffer(data, np.uint32, -1, 1))
            if not told:
                continue
            if places is None:
                raise RuntimeError("a stretch of texts was read in another order when it was read again")
            doc, part, count, step, again, of = _unpack(places[1:], _PLACES)
            answer = np.concatenate(told)
            kind = np.zeros(len(step), np.uint8)  # 1: repeated, 2: and of many places
            kind[answer & np.uint32(0x7FFFFFFF)] = 1 + (answer >> np.uint32(31))
            kind[again] = kind[of]
            end = np.cumsum(count.astype(np.int64))
            upto = np.cumsum(step.astype(np.int64))
            row = np.repeat(np.arange(len(doc)), count)
            first = end - count
            at = upto - (upto[first] - step[first])[row]
            on = np.flatnonzero(kind)
            yield _by_doc(doc[row[on]], part[row[on]], (at[on] * 2 + (kind[on] == 2)).astype(np.uint32), n)

    return run


def _grouped(it: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The data of each bucket; rows come sorted by bucket."""
    now, held = None, []
    for batch in it:
        for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if b != now and held:
                yield held
                held = []
            now = b
            held.append(data)
    if held:
        yield held


_PHRASES = [np.uint64, np.int64, np.int32, np.uint32, np.uint8, np.uint8]
_FLAGS = [np.int64, np.int32, np.uint32, np.uint32]


class _Dictionary:
    """Distinct phrases, the first place of each, and the places at which phrases are known to repeat."""

    def __init__(self) -> None:
        self.first: dict[bytes, tuple[int, int, int]] = {}  # doc, start, part
        self.trigger: dict[bytes, int] = {}
        self.flags: list[tuple[int, int, int, int]] = []  # doc, part, first and last start
        self.size = 0

    def add(self, phrase: bytes, place: tuple[int, int, int], trigger: int) -> None:
        old = self.first.get(phrase)
        if old is None:
            self.first[phrase], self.trigger[phrase] = place, trigger
            self.size += len(phrase) + 400
        elif old[:2] != place[:2]:
            low, high = (old, place) if old < place else (place, old)
            self.first[phrase] = low
            self.flags.append((high[0], high[2], high[1], high[1] + len(phrase) - MATCH))
            self.size += 170


def _deal_phrases(n: int):
    """Texts with marked places to packed phrases by their trigger's bucket, and known repeats by doc."""

    def flush(held: _Dictionary) -> pa.RecordBatch:
        by: dict[int, list[bytes]] = {}
        for phrase, trigger in held.trigger.items():
            by.setdefault(trigger % n, []).append(phrase)
        buckets, data = [], []
        for b, phrases in by.items():
            places = [held.first[p] for p in phrases]
            buckets.append(b)
            data.append(b"P" + _pack(np.array([held.trigger[p] for p in phrases], np.uint64), np.array([x[0] for x in places], np.int64), np.array([x[2] for x in places], np.int32), np.array([x[1] for x in places], np.uint32), np.array([len(p) for p in phrases], np.uint8), np.frombuffer(b"".join(phrases), np.uint8)))
        if held.flags:
            doc, part, lo, hi = (np.array(x, np.int64) for x in zip(*held.flags))
            bucket = doc % n
            for b in np.unique(bucket).tolist():
                own = bucket == b
                buckets.append(b)
                data.append(b"F" + _pack(doc[own], part[own].astype(np.int32), lo[own].astype(np.uint32), hi[own].astype(np.uint32)))
        return _rows(buckets, data)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Dictionary()
        for batch in it:
            batch = batch.filter(pc.is_valid(batch.column(3)))
            ids, parts_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_values(batch.column(2))
            marks = [np.frombuffer(m, np.uint32) for m in batch.column(3).to_pylist()]
            for rows, starts, data in _blocks(list(range(len(ids))), texts):
                lo, hi, at, h = parse(data, np.diff(starts).tolist())
                text = np.searchsorted(starts, lo, "right") - 1
                hot = np.concatenate([(marks[r] & 1).astype(bool) for r in rows.tolist()])
                place = np.concatenate([(marks[r] >> 1).astype(np.int64) + s for r, s in zip(rows.tolist(), starts.tolist())])
                order = np.argsort(place, kind="stable")
                place, hot = place[order], hot[order]
                where = np.minimum(np.searchsorted(place, at), len(place) - 1)
                on = np.flatnonzero(place[where] == at)
                for k, t, is_hot in zip(on.tolist(), text[on].tolist(), hot[where[on]].tolist()):
                    doc, part, base, a, b = ids[int(rows[t])], parts_[int(rows[t])], int(starts[t]), int(lo[k]), int(hi[k])
                    if is_hot:
                        for s in range(a, b + 1):
                            w = data[s : s + MATCH]
                            held.add(w, (doc, s - base, part), xxhash.xxh64_intdigest(w))
                    else:
                        held.add(data[a : b + MATCH], (doc, a - base, part), int(h[k]))
                if held.size > TASK_PHRASES:
                    yield flush(held)
                    held = _Dictionary()
        if held.first:
            yield flush(held)

    return run


def window_ranks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranks among the suffixes of data, to the depth of MATCH bytes, of those that begin at starts."""
    x = np.concatenate([data, np.zeros(MATCH + 64, np.uint8)]).astype(np.uint64)
    width = 1
    while width < 8:
        x = x[:-width] << np.uint64(8 * width) | x[width:]
        width *= 2
    rank = np.unique(x, return_inverse=True)[1].astype(np.uint64)
    while width < 64:
        rank = np.unique(rank[:-width] << np.uint64(32) | rank[width:], return_inverse=True)[1].astype(np.uint64)
        width *= 2
    return np.unique(rank[starts] << np.uint64(32) | rank[starts + MATCH - 64], return_inverse=True)[1]


def _batched(held: _Dictionary, phrases: list[bytes]) -> Iterator[list[bytes]]:
    """Phrases, sorted by trigger, about TASK_RANKED bytes at once; those of one trigger, at most HOT, stay together."""
    own: list[bytes] = []
    size = 0
    for p in phrases:
        if size > TASK_RANKED and held.trigger[p] != held.trigger[own[-1]]:
            yield own
            own, size = [], 0
        own.append(p)
        size += len(p)
    if own:
        yield own


def _ranked(held: _Dictionary, shared: list[bytes]) -> np.ndarray:
    """Windows of the phrases that repeat, (doc, part, start, start), by the suffix array of the phrases."""
    data = np.frombuffer(b"".join(shared), np.uint8)
    sizes = np.array([len(p) for p in shared])
    windows = sizes - MATCH + 1
    of = np.repeat(np.arange(len(shared)), windows)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    rank = window_ranks(data, (np.cumsum(sizes) - sizes)[of] + inside)
    places = np.array([held.first[p] for p in shared], np.int64)
    doc, start, part = places[of, 0], places[of, 1] + inside, places[of, 2]
    order = np.lexsort((start, doc, rank))  # the suffix array, places of equal windows in the parse's order
    rank, doc, start, part = rank[order], doc[order], start[order], part[order]
    first = _runs(rank)[:-1]
    again = np.ones(len(rank), bool)
    again[first] = False
    lead = np.repeat(first, np.diff(np.append(first, len(rank))))
    again &= (doc != doc[lead]) | (start != start[lead])  # a row that repeats a doc_id is not earlier
    return np.stack([doc[again], part[again], start[again], start[again]], 1)


def _repeats(n: int):
    """(first, last) of the runs of window starts that repeat, by doc."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(it):
            held = _Dictionary()
            flags = []
            for row in rows:
                if row[:1] == b"F":
                    flags.append(np.stack([x.astype(np.int64) for x in _unpack(row[1:], _FLAGS)], 1))
                    continue
                trigger, doc, part, lo, length, data = _unpack(row[1:], _PHRASES)
                text, at = data.tobytes(), 0
                for t, d, p, s, k in zip(trigger.tolist(), doc.tolist(), part.tolist(), lo.tolist(), length.tolist()):
                    held.add(text[at : at + k], (d, s, p), t)
                    at += k
            if held.flags:
                flags.append(np.array(held.flags, np.int64))
            per: dict[int, int] = {}
            for t in held.trigger.values():
                per[t] = per.get(t, 0) + 1
            shared = sorted((p for p, t in held.trigger.items() if per[t] > 1), key=held.trigger.__getitem__)
            flags += [_ranked(held, own) for own in _batched(held, shared)]
            if flags:
                found = np.concatenate(flags)
                found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
                new = np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(1) | (found[1:, 2] > found[:-1, 3] + 1)])  # joins most; the rest meet later
                head = np.flatnonzero(new)
                last = np.maximum.reduceat(found[:, 3], head) if len(head) else head
                yield _by_doc(found[head, 0], found[head, 1], np.stack([found[head, 2], last], 1).astype(np.uint32), n)

    return run


def spans_of(runs_of: bytes | None, size: int) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes, (begin, end), from packed runs of window starts."""
    if not runs_of:
        return []
    runs = np.frombuffer(runs_of, np.uint32).reshape(-1, 2).astype(np.int64)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    out: list[list[int]] = []
    for lo, hi in runs.tolist():
        end = min(hi + MATCH, size)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([lo, end])
    return [(a, b) for a, b in out]


def _remainders(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        texts, begin, end, rest = binary_values(batch.column(2)), [], [], []
        for t, runs_of in zip(texts, batch.column(3).to_pylist()):
            spans = spans_of(runs_of, len(t))
            begin.append([a for a, _ in spans])
            end.append([b for _, b in spans])
            rest.append(b"".join(t[a:b] for a, b in zip([0, *end[-1]], [*begin[-1], len(t)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(begin, pa.list_(pa.int64())), pa.array(end, pa.list_(pa.int64())), pa.array(rest, pa.binary())], names=["doc_id", "n_bytes", "begins", "ends", "kept"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text_col).alias("part"), utf8(text_col).alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, part, marks): packed runs of the window starts in each doc that also start earlier; runs may touch."""
    small_batches(docs.sparkSession)
    n = parts(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    dealt = texts.where("doc_id IS NOT NULL").mapInArrow(_deal_triggers(n), "bucket int, stretch long, data binary")
    answers = dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer(hot), "stretch long, data binary")
    places = answers.repartition(n, "stretch").sortWithinPartitions("stretch").mapInArrow(_repeated_places(n), "bucket int, data binary")
    # left, like the join in without_repeats, so that both read one exchange of the texts
    phrases = texts.join(_of_docs(places, 1, n), ["doc_id", "part"], "left").mapInArrow(_deal_phrases(n), "bucket int, data binary")
    return _of_docs(phrases.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeats(n), "bucket int, data binary"), 2, n)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, begins and ends of the removed runs of bytes, kept (the bytes left)."""
    joined = _texts(docs, id_col, text_col).join(repeated_spans(docs, id_col, text_col, hot), ["doc_id", "part"], "left")
    return joined.mapInArrow(_remainders, "doc_id long, n_bytes long, begins array<long>, ends array<long>, kept binary")


def removal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    out = without_repeats(docs, id_col, text_col, hot)
    return out.select(
        F.col("doc_id").alias(id_col),
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("begins").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
