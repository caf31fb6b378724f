"""MinHash near-duplicates by an inverted join over signature coordinates.

A text's set is its distinct shingles of `words` words. Its signature has COORDINATES minima, one for each of as many
hash functions, and two sets agree in each coordinate with the probability of their Jaccard similarity. Pairs that agree in
MATCHES coordinates or more are held against each other; at a similarity of 0.85 all but one pair in 10^8 do.

* Prefix: two signatures that agree in MATCHES of all coordinates agree in one of the first COORDINATES - MATCHES + 1, so
  only those coordinate-value pairs are posted, by number alone. Most lists have one member, who meets nobody; what is
  compared joins the members of the others.
* Counting: whoever meets in a list is compared by digests of whole signatures, 4 bits a coordinate, which never count too
  few agreements, and by parity bitmaps of the sets, which never differ in more bits than the sets do in members.
* Skipping: each list first gives trees of its candidates, those pairs first that agree most; each tree's members are a list of
  their own from then on, one for however many coordinates they met under. A list whose tree is tied by then needs no more. In others, pairs are passed over whose ends are tied already, so that a list gives
  fewer pairs than it has components; it is gone through again where such a pair turns out not to be similar. A list that
  would take more than WORK comparisons is passed over whole: its members are posted again under that list and each later
  coordinate. Of the coordinates in which a pair agrees, the r-th is among the first COORDINATES - MATCHES + r, so no pair
  is lost.

Candidates are sifted by bitmaps as wide as their sets ask for, then confirmed on the full sets: first each set's best
partner, then others that lie in different components. Equal sets are one node from the start, so copies are never paired.

Cases: null and white-space texts have an empty set and link with nothing; texts of fewer words than a shingle have one, all
of it; a null id is never a component's id unless all of the component's are null; rows that repeat an id each get their
row; an empty table gives no rows; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, among, batches, binary_values, cut, gathered, parts, small_batches, utf8, written
from .components import components

#: Least Jaccard similarity of a link, as a fraction, so that it is compared in whole numbers.
SHARE = (85, 100)
COORDINATES, MATCHES = 64, 36
#: Neighbours in a list that are compared at first.
NEXT = 2
#: Comparisons in a list that one task makes, and how often longer lists are dealt anew.
WORK, DEPTH = 200_000_000, 4
#: Turns after which a list's pairs all come out.
TURNS = 2
#: Shingles in sets that a task keeps while it confirms.
CACHE = 400_000

#: 64 coordinates with 4 bits each, and 256 bits of parity.
_DIGEST = [f"d{i}" for i in range(COORDINATES // 16)]
_PARITY = [f"b{i}" for i in range(4)]
_LONGS = ("n", *_DIGEST, *_PARITY)
_COMPARED_DDL = ", ".join(f"{c} long" for c in ("token", "last", "node", "root", "bar", *_LONGS)) + ", wide binary"
_NIBBLE = np.uint64(0x1111111111111111)

_SETS = pa.schema([("_row", pa.int64()), ("_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("signature", pa.binary()), ("wide", pa.binary())])
_PLACES = pa.schema([(c, pa.int64()) for c in ("token", "node")])
_TOLD = pa.schema([(c, pa.int64()) for c in ("node", *_LONGS)])
_POSTINGS = pa.schema([(c, pa.int64()) for c in ("token", "last", "node", *_LONGS)])
_MET = pa.schema([(c, pa.int64()) for c in ("token", "last", "node", "a", "b", "agree")])
_MET_DDL = "token long, last long, node long, a long, b long, agree long"


def shingle_set(text: bytes, words: int = 3) -> set[bytes]:
    """Distinct runs of `words` words of the text with A-Z in lower case; all of a shorter text; none of an empty one."""
    own = text.lower().split()
    if len(own) < words:
        return {b" ".join(own)} if own else set()
    return {b" ".join(s) for s in zip(*[own[i:] for i in range(words)])}


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    own = np.array([xxhash.xxh64_intdigest(str(i).encode(), 7) for i in range(2 * COORDINATES)], np.uint64)
    return own[:COORDINATES] | np.uint64(1), own[COORDINATES:]


_TIMES, _PLUS = _multipliers()


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of a set's 64-bit hashes under each hash function, 32 bits each."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        least = np.minimum(least, (((hashes[i : i + 1024, None] ^ _PLUS[None, :]) * _TIMES[None, :]) >> np.uint64(32)).min(axis=0))
    return least.astype(np.uint32)


def _bits(n: int) -> int:
    """Bits of the wide bitmap of a set of n: 4 n to 8 n, at least 256."""
    return max(256, 1 << (4 * n).bit_length())


def _parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits((np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little")


def _can_be(n: np.ndarray, m: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of n and m members that differ in at least `apart` members can be that similar."""
    # shared <= (n + m - apart) / 2, and united = n + m - shared
    return (SHARE[1] * np.minimum(n, m) >= SHARE[0] * np.maximum(n, m)) & (SHARE[1] * (n + m - apart) >= SHARE[0] * (n + m + apart))


def _sets(words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            size, key, minima, wide = [], [], [], []
            for text in binary_values(batch.column(2)):
                own = shingle_set(text, words)
                hashes = np.sort(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in own), np.uint64, len(own)))
                size.append(len(own))
                key.append(xxhash.xxh3_128_digest(hashes.tobytes()) if own else None)
                minima.append(signature(hashes).tobytes() if own else None)
                wide.append(_parity(hashes, _bits(len(own))).tobytes() if own else None)
            columns = [batch.column(0), batch.column(1), pa.array(size, pa.int64()), *[pa.array(c, pa.binary()) for c in (key, minima, wide)]]
            yield pa.RecordBatch.from_arrays(columns, schema=_SETS)

    return run


def _folded(wide: bytes, bits: int) -> np.ndarray:
    """A bitmap of a power of two of bits, folded to fewer."""
    own = np.frombuffer(wide, np.uint8)
    return np.bitwise_xor.reduce(own.reshape(-1, bits // 8), axis=0)


def _token(before: np.ndarray | int, coordinate: np.ndarray | int, value: np.ndarray) -> np.ndarray:
    """A list's number from that of the list before it (0: none), a coordinate and its value."""
    x = np.uint64(0x9E3779B97F4A7C15) * (value.astype(np.uint64) | np.asarray(coordinate, np.uint64) << np.uint64(32)) ^ np.asarray(before).astype(np.int64).view(np.uint64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(27)).view(np.int64)


def _first_postings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set under the values of the first COORDINATES - MATCHES + 1 coordinates. A token ends in its coordinate."""
    prefix = COORDINATES - MATCHES + 1
    for batch in it:
        for i in range(0, batch.num_rows, 1024):
            own = batch.slice(i, 1024)
            minima = np.frombuffer(b"".join(own.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            coordinate = np.tile(np.arange(prefix), len(minima))
            token = _token(np.zeros(coordinate.shape, np.int64), coordinate, minima[:, :prefix].ravel()) & ~(COORDINATES - 1) | coordinate
            node = np.repeat(own.column("node").to_numpy(zero_copy_only=False), prefix)
            yield from batches(_PLACES, {"token": token, "node": node}, 16384)


def in_company(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, node), sorted by token, of lists with several members."""
    for block, edges, _ in lists(it):
        size = np.diff(edges)
        token, node = block[:, np.repeat(size > 1, size)]
        yield from batches(_PLACES, {"token": token, "node": node}, 16384)


def _digests(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Digests of a batch's signatures and parities of its bitmaps."""
    minima = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
    nibbles = (minima & 15).astype(np.uint64).reshape(len(minima), -1, 16)
    digest = np.bitwise_or.reduce(nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)
    return [*digest.T, *np.stack([_folded(w, 256).view(np.int64) for w in batch.column("wide").to_pylist()]).T]


def _told(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What of each set is compared in lists."""
    for batch in it:
        if batch.num_rows:
            first = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (*first, *_digests(batch))], schema=_TOLD)


def _deeper(depth: int):
    """Sets of lists that were passed over, under that list and each later coordinate where the next agreement can be."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(0, batch.num_rows, 1024):
                own = batch.slice(i, 1024)
                minima = np.frombuffer(b"".join(own.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
                token, last, node = (own.column(c).to_numpy(zero_copy_only=False) for c in ("token", "last", "node"))
                k, j = np.nonzero(np.arange(COORDINATES - MATCHES + depth)[None, :] > last[:, None])
                yield from batches(pa.schema(list(_POSTINGS)[:3]), {"token": _token(token[k], j, minima[k, j]), "last": j, "node": node[k]}, 16384)

    return run


def lists(it: Iterator[pa.RecordBatch], rows: int = 100_000, size: int = 1 << 25) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Batches sorted by token as arrays (columns, rows) that split no list, where lists begin, with the end, and the column
    `wide` where there is one."""
    held: list[np.ndarray] = []
    wide: list[bytes] = []
    n = total = 0

    def edges(block: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], block[0, 1:] != block[0, :-1], [True]]))

    for batch in it:
        if batch.num_rows:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c, f in zip(batch.columns, batch.schema) if f.name != "wide"]))
            if "wide" in batch.schema.names:
                wide += batch.column("wide").to_pylist()
                total += batch.column("wide").nbytes
            n += batch.num_rows
        if n >= rows or total >= size:
            block = np.concatenate(held, axis=1)
            end = int(np.searchsorted(block[0], block[0, -1]))
            if end:
                yield block[:, :end], edges(block[:, :end]), wide[:end]
            held, wide, n, total = [block[:, end:]], wide[end:], 0, 0
    if held:
        block = np.concatenate(held, axis=1)
        if block.shape[1]:
            yield block, edges(block), wide


class Bitmaps:
    """Parity bitmaps of a list's members, each of a power of two of bits."""

    def __init__(self, wide: list[bytes]) -> None:
        self.size = np.array([len(w) // 8 for w in wide], np.int64)
        self.at = np.zeros(len(wide), np.int64)
        self.own: dict[int, np.ndarray] = {}
        for n in np.unique(self.size).tolist():
            some = np.flatnonzero(self.size == n)
            self.at[some] = np.arange(len(some))
            self.own[n] = np.frombuffer(b"".join([wide[i] for i in some]), np.uint64).reshape(-1, n)

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        """In how many bits member i differs from others, wider ones folded to the narrower."""
        out = np.zeros(len(others), np.int64)
        own = self.own[int(self.size[i])][self.at[i]]
        for n, rows in self.own.items():
            some = np.flatnonzero(self.size[others] == n)
            if len(some):
                least = min(n, len(own))
                folded = np.bitwise_xor.reduce(rows[self.at[others[some]]].reshape(len(some), -1, least), axis=1)
                out[some] = np.bitwise_count(folded ^ np.bitwise_xor.reduce(own.reshape(-1, least), axis=0)).sum(axis=1, dtype=np.int64)
        return out


def _can_link(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many coordinates signatures may agree, where that is MATCHES or more and sizes, digests and parities allow the
    similarity; elsewhere 0."""
    out = np.zeros(max(one.shape[1], other.shape[1]), np.int64)
    at = np.flatnonzero(SHARE[1] * np.minimum(one[0], other[0]) >= SHARE[0] * np.maximum(one[0], other[0]))
    one, other = one[:, at], other if other.shape[1] < len(out) else other[:, at]
    differ = (one[1:] ^ other[1:]).view(np.uint64)
    nibbles, parity = differ[: len(_DIGEST)], differ[len(_DIGEST) :]
    nibbles = nibbles | nibbles >> np.uint64(2)
    nibbles = (nibbles | nibbles >> np.uint64(1)) & _NIBBLE
    agree = COORDINATES - np.bitwise_count(nibbles).sum(axis=0, dtype=np.int64)
    close = (agree >= MATCHES) & _can_be(one[0], other[0], np.bitwise_count(parity).sum(axis=0, dtype=np.int64))
    out[at] = np.where(close, agree, 0)
    return out


def _pairs_out(a: np.ndarray, b: np.ndarray, agree: np.ndarray, token: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(a), 16384):
        x, y = a[k : k + 16384], b[k : k + 16384]
        first = pa.nulls(len(x), pa.int64()) if token is None else pa.array(token[k : k + 16384])
        yield pa.RecordBatch.from_arrays([first, *[pa.nulls(len(x), pa.int64())] * 2, pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(agree[k : k + 16384])], schema=_MET)


def _lists_out(token: np.ndarray, last: np.ndarray, node: np.ndarray, agree: int | None = None) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(token), 16384):
        own = [pa.array(x[k : k + 16384]) for x in (token, last, node)]
        yield pa.RecordBatch.from_arrays([*own, *[pa.nulls(len(own[0]), pa.int64())] * 2, pa.array([agree] * len(own[0]), pa.int64())], schema=_MET)


def partnered(own: np.ndarray) -> np.ndarray:
    """Whether each member of a list (a column of sizes, digests and parities) can link with another one, as _can_link has it."""
    size = own.shape[1]
    n, digest, parity = own[0], own[1 : 1 + len(_DIGEST)].view(np.uint64), own[1 + len(_DIGEST) :].view(np.uint64)
    out = np.zeros(size, bool)
    step = max(1, 250_000 // size)
    for i in range(0, size, step):
        here = slice(i, min(i + step, size))
        apart = np.zeros((here.stop - i, size), np.uint8)
        for d in digest:
            x = d[here, None] ^ d[None, :]
            x |= x >> np.uint64(2)
            apart += np.bitwise_count((x | x >> np.uint64(1)) & _NIBBLE)
        k, j = np.nonzero(apart <= COORDINATES - MATCHES)
        k, j = k[k + i != j] + i, j[k + i != j]
        for first in range(0, len(k), 1_000_000):
            x, y = k[first : first + 1_000_000], j[first : first + 1_000_000]
            good = _can_be(n[x], n[y], np.bitwise_count(parity[:, x] ^ parity[:, y]).sum(axis=0, dtype=np.int64))
            out[x[good]] = True
            out[y[good]] = True
    return out


def tree(own: np.ndarray) -> list[tuple[int, int, int]]:
    """Pairs (places of members, coordinates that agree) that tie together what all pairs of a list do that can link, those
    first that agree most; in a list of over 512 members, all that meet the tied ones are tied at once."""
    size = own.shape[1]
    left, best, to, now, out = np.ones(size, bool), np.zeros(size, np.int64), np.zeros(size, np.int64), 0, []
    while True:
        left[now], best[now] = False, 0
        rest = np.flatnonzero(left)
        if not len(rest):
            return out
        agree = _can_link(own[:, rest], own[:, [now]])
        more = agree > best[rest]
        best[rest[more]], to[rest[more]] = agree[more], now
        if size > 512 and best[rest].all():
            return out + list(zip(to[rest].tolist(), rest.tolist(), best[rest].tolist()))
        now = int(rest[best[rest].argmax()])
        if best[now]:
            out.append((int(to[now]), now, int(best[now])))


def own_tokens(node: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """For each member a token of its tree's members: trees of equal members have equal ones, wherever they met."""
    out = np.zeros(len(node), np.int64)
    order = np.lexsort((node, tree))
    for some in np.split(order, np.flatnonzero(np.diff(tree[order])) + 1):
        out[some] = np.uint64(xxhash.xxh64_intdigest(node[some].tobytes(), 42)).astype(np.int64)
    return out


def _meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of each list: all pairs of a short one; of others a tree of pairs, and again the members that have candidates;
    of those with too many members for that the next neighbours, and all members with agree -1. Members that no candidates tie
    can't link, so each tree and its members are a list of their own from here on, with a token made of its members."""
    for block, edges, _ in lists(it):
        size = np.diff(edges)
        end = np.repeat(np.where((size <= NEXT + 1) | (size**2 > WORK), edges[1:], 0), size)
        for shift in range(1, NEXT + 1):
            i = np.flatnonzero(end > np.arange(len(end)) + shift)
            agree = _can_link(block[3:, i], block[3:, i + shift])
            i, agree = i[agree > 0], agree[agree > 0]
            yield from _pairs_out(block[2, i], block[2, i + shift], agree)
        more, own_lists, pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)]
        for s, e in zip(edges[:-1][size > NEXT + 1].tolist(), edges[1:][size > NEXT + 1].tolist()):
            if (e - s) ** 2 > WORK:
                yield from _lists_out(*block[:3, s:e], -1)
                continue
            here = s + np.flatnonzero(partnered(np.ascontiguousarray(block[3:, s:e])))
            if len(here):
                own = tree(block[3:, here])
                first = np.arange(len(here))
                for i, j, _ in own:  # i is in the tree before j
                    first[j] = first[i]
                more.append(here)
                own_lists.append(own_tokens(block[2, here], first))
                own = np.array(own, np.int64)
                own[:, :2] = here[own[:, :2]]
                pairs.append(own)
        i, j, agree = np.concatenate(pairs).T
        members, token = np.concatenate(more), np.zeros(block.shape[1], np.int64)
        token[members] = np.concatenate(own_lists)
        yield from _pairs_out(block[2, i], block[2, j], agree, token[i])
        yield from _lists_out(token[members], *block[1:3, members])


def forest(node: np.ndarray, root: np.ndarray, barred: set[tuple[int, int]], similar: Callable[[int, np.ndarray], np.ndarray], all_pairs: bool) -> Iterator[tuple[int, int]]:
    """Pairs (places of members) that tie together the components of a list as all its similar pairs do, barred ones left out.

    similar(i, places): which of the places may be similar to i. A pair whose ends are tied already is passed over, so a
    list gives fewer pairs than it has components; with all_pairs, every pair of different components comes out.
    """
    order = np.argsort(node, kind="stable")
    _, tied = np.unique(root[order], return_inverse=True)
    largest = np.bincount(tied).argmax()
    for i in np.flatnonzero(tied != largest).tolist():
        # members of the largest component don't look; of others, the later one looks back
        met = np.flatnonzero((tied != tied[i]) & ((tied == largest) | (np.arange(len(tied)) < i)))
        met = met[similar(int(order[i]), order[met])] if len(met) else met
        if barred and len(met):
            met = met[[(min(p), max(p)) not in barred for p in zip(node[order[met]].tolist(), [int(node[order[i]])] * len(met))]]
        while len(met):
            j = int(met[0])
            yield int(order[i]), int(order[j])
            met = met[1:]
            if not all_pairs:
                low, high = sorted((int(tied[i]), int(tied[j])), key=lambda t: t != largest)
                tied[tied == high] = low
                met = met[tied[met] != tied[i]]


def _across(deal: bool, all_pairs: bool):
    """Pairs that tie components of each list together; lists that take too much work again, if they may be dealt.
    Columns: token, last, node, root, bar, and what is compared, the wide bitmaps included; bar: -1, or a node that `node` was
    found not to be similar to."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, edges, wide in lists(it):
            for s, e in zip(edges[:-1], edges[1:]):
                here = s + np.flatnonzero(block[4, s:e] < 0)
                if not len(here):  # its members are in one component by now
                    continue
                barred = set(zip(*block[:, s:e][:, block[4, s:e] >= 0][[2, 4]].tolist()))
                token, last, node, root, _, *own = block[:, here]
                own, maps = np.array(own), Bitmaps([wide[i] for i in here])
                rest = len(node) - np.unique(root, return_counts=True)[1].max(initial=0)
                if deal and rest * len(node) > WORK:
                    yield from _lists_out(token, last, node)
                    continue

                def similar(i: int, met: np.ndarray, own: np.ndarray = own, maps: Bitmaps = maps) -> np.ndarray:
                    good = _can_link(own[:, met], own[:, [i]]) > 0
                    good[good] = _can_be(own[0, met[good]], own[0, i], maps.apart(i, met[good]))
                    return good

                pairs = np.array(list(forest(node, root, barred, similar, all_pairs)), np.int64).reshape(-1, 2)
                yield from _pairs_out(node[pairs[:, 0]], node[pairs[:, 1]], np.zeros(len(pairs), np.int64), np.full(len(pairs), block[0, s]))

    return run


def _sifted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, agree): those of the pairs that agree in MATCHES coordinates and whose wide bitmaps allow the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("agree", pa.int64())])
    for batch in it:
        if not batch.num_rows:
            continue
        one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, COORDINATES) for c in ("sa", "sb"))
        agree = (one == other).sum(axis=1)
        apart = []
        for x, y in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist()):
            bits = 8 * min(len(x), len(y))
            apart.append(int(np.bitwise_count(_folded(x, bits) ^ _folded(y, bits)).sum(dtype=np.int64)))
        n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
        good = pa.array((agree >= MATCHES) & _can_be(n, m, np.array(apart, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good), pa.array(agree).filter(good)], schema=schema)


def _candidates(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    both, _ = gathered(pairs.distinct())
    some = among(nodes, both.select("a", "b"), "node")
    for end in ("a", "b"):
        both = both.join(some.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("signature").alias(f"s{end}"), F.col("wide").alias(f"w{end}")), end)
    return both.mapInArrow(_sifted, "a long, b long, agree long")


def _confirm(words: int):
    """Those of the pairs whose full sets are similar."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set[bytes]] = {}
        total = 0

        def members(node: int, text: bytes) -> set[bytes]:
            nonlocal total
            if node not in held:
                if total > CACHE:
                    held.clear()
                    total = 0
                held[node] = shingle_set(text, words)
                total += len(held[node])
            return held[node]

        for batch in it:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            good = []
            for i, (left, right) in enumerate(zip(binary_values(batch.column("left")), binary_values(batch.column("right")))):
                one, other = members(a[i], left), members(b[i], right)
                shared = len(one & other)
                if SHARE[1] * shared >= SHARE[0] * (len(one) + len(other) - shared):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], schema=schema)

    return run


def _confirmed(pairs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """Those of the pairs, cut, whose texts are similar. Only the texts of their ends travel."""
    texts = among(rows.select("_row", "_text"), pairs.select("a", "b"), "_row")
    both = pairs.select("a", "b").join(texts.select(F.col("_row").alias("b"), F.col("_text").alias("right")), "b")
    both = both.join(texts.select(F.col("_row").alias("a"), F.col("_text").alias("left")), "a")
    return gathered(both.mapInArrow(_confirm(words), "a long, b long"))[0]


def _apart_so_far(pairs: DataFrame, so_far: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose ends aren't in one component yet."""
    so_far, n = gathered(so_far)
    so_far = F.broadcast(so_far) if n <= FEW else so_far
    for end in ("a", "b"):
        pairs = pairs.join(so_far.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    return pairs.where("_a <> _b").select("a", "b")


def several_roots(posted: DataFrame, so_far: DataFrame) -> DataFrame:
    """Members (token, node, ...) of the lists that lie in several components, with their root."""
    so_far, n = gathered(so_far)
    so_far = F.broadcast(so_far) if n <= FEW else so_far

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(so_far, "node", "left").select(*rows.columns, F.coalesce("root", "node").alias("root"))

    several = rooted(posted).groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    return rooted(among(posted, several, "token"))


def tied_across(posted: DataFrame, links: DataFrame, meet: Callable[[DataFrame, DataFrame, DataFrame | None, bool], DataFrame], confirm: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """links and those that tie together what similar members of the lists do, beyond what the links tie.

    posted: (token, node, ...). meet(posted, so_far, barred, all_pairs) gives (token, a, b): pairs that tie components of
    each list; confirm(pairs) those of the pairs (a, b) that are similar. A list whose pairs are all similar is done. Lists
    with others are gone through again with what is tied by then, those pairs barred: (token, a, b). After TURNS turns
    their pairs all come out, so that no list stays open.
    """
    barred: DataFrame | None = None
    for turn in range(TURNS):
        so_far = components(links)
        pairs, n = gathered(meet(posted, so_far, barred, turn == TURNS - 1))
        if not n:
            break
        good = confirm(pairs.select("a", "b").distinct())
        links = links.unionByName(good)
        wrong, n = gathered(pairs.join(good, ["a", "b"], "left_anti"))
        if turn == TURNS - 1 or not n:
            break
        barred = wrong if barred is None else barred.unionByName(wrong)
        posted = among(posted, wrong.select("token"), "token")
    return links


def _links(nodes: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """Links between nodes that tie together what all links do."""
    n = parts(nodes.sparkSession)
    postings = nodes.select("node", "signature").mapInArrow(_first_postings, "token long, node long").repartition(n, "token").sortWithinPartitions("token").mapInArrow(in_company, "token long, node long")
    told = postings.join(nodes.mapInArrow(_told, ", ".join(f"{c} long" for c in _TOLD.names)), "node")
    # another order in each list, so that a set has other neighbours in each
    sorted_ = told.repartition(n, "token").sortWithinPartitions("token", F.xxhash64("token", "node"))
    met = cut(sorted_.select("token", F.col("token").bitwiseAND(COORDINATES - 1).alias("last"), "node", *_LONGS).mapInArrow(_meet, _MET_DDL))
    near = gathered(met.where("a IS NOT NULL").groupBy("a", "b").agg(F.max("agree").alias("agree")))[0]
    ends = [near.select(F.col(x).alias("node"), F.struct("agree", F.xxhash64("a", "b").alias("turn"), F.col(y).alias("other")).alias("best")) for x, y in (("a", "b"), ("b", "a"))]
    best = ends[0].unionByName(ends[1]).groupBy("node").agg(F.max("best").alias("best")).select(F.least("node", "best.other").alias("a"), F.greatest("node", "best.other").alias("b"))

    def confirm(pairs: DataFrame) -> DataFrame:
        return _confirmed(gathered(_candidates(pairs, nodes).select("a", "b"))[0], rows, words)

    links = confirm(best.distinct())
    links = links.unionByName(confirm(_apart_so_far(near.select("a", "b"), components(links))))
    # a list whose tree is tied by now needs no more
    apart = gathered(_apart_so_far(near.select("a", "b"), components(links)))[0]
    open_ = met.where("a IS NOT NULL AND token IS NOT NULL").join(F.broadcast(apart) if apart.count() <= FEW else apart, ["a", "b"], "left_semi").select("token")
    posted = among(met.where("node IS NOT NULL").select("token", "last", "node"), open_.unionByName(met.where("agree = -1").select("token")), "token")
    posted = gathered(posted.groupBy("token", "node").agg(F.min("last").alias("last")))[0]
    for depth in range(1, DEPTH + 1):
        passed: list[DataFrame] = []

        def meet(posted: DataFrame, so_far: DataFrame, barred: DataFrame | None, all_pairs: bool, depth: int = depth, passed: list[DataFrame] = passed) -> DataFrame:
            several = gathered(several_roots(posted, so_far))[0]
            rows = several.withColumn("bar", F.lit(-1).cast("long")).join(among(nodes, several.select("node"), "node"), "node").mapInArrow(_compared, _COMPARED_DDL)
            if barred is not None:
                rows = rows.unionByName(barred.select("token", F.lit(0).cast("long").alias("last"), F.col("a").alias("node"), F.lit(0).cast("long").alias("root"), F.col("b").alias("bar"), *[F.lit(0).cast("long").alias(c) for c in _LONGS], F.lit(b"").alias("wide")))
            seen = cut(rows.repartition(n, "token").sortWithinPartitions("token", "node").mapInArrow(_across(depth < DEPTH and not passed, all_pairs), _MET_DDL))
            if not passed:
                passed.append(seen.where("node IS NOT NULL").select("token", "last", "node"))
            return seen.where("a IS NOT NULL").select("token", "a", "b")

        links = tied_across(posted, links, meet, confirm)
        if depth == DEPTH or not passed or passed[0].isEmpty():
            break
        again = gathered(passed[0])[0]
        posted = again.join(among(nodes.select("node", "signature"), again.select("node"), "node"), "node").mapInArrow(_deeper(depth + 1), "token long, last long, node long")
    return links


def _compared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, last, node, root, bar) with digests and parities made of signature and bitmap."""
    names = ("token", "last", "node", "root", "bar", *_LONGS)
    schema = pa.schema([*[(c, pa.int64()) for c in names], ("wide", pa.binary())])
    for batch in it:
        if batch.num_rows:
            first = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "last", "node", "root", "bar", "n")]
            yield from batches(schema, dict(zip(schema.names, (*first, *_digests(batch), batch.column("wide").to_pylist()))), 2048)


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the least id that links reach), kept."""
    small_batches(docs.sparkSession)
    rows = written(docs.select(F.monotonically_increasing_id().alias("_row"), docs[id_col].cast("long").alias("_id"), utf8(text_col).alias("_text")))
    each = cut(rows.mapInArrow(_sets(words), "_row long, _id long, n long, key binary, signature binary, wide binary"))
    nodes = each.where("n > 0").groupBy("key").agg(F.min("_row").alias("node"), F.min("_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "signature", "wide")])
    nodes = cut(nodes)
    roots = components(_links(nodes.select("node", "n", "signature", "wide"), rows, words))
    rooted = nodes.select("key", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("key", "component_id")
    out = each.select("_id", "n", "key").join(named, "key", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
