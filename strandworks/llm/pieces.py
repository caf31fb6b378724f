"""N-best segmentation of texts into pieces of a SentencePiece vocabulary, and back.

A text begins with an added space and has U+2581 for spaces. No piece has a space after another character, so a text
falls into units, each a run of spaces with what follows up to the next; the piece lattice of a text is the chain of
its units' lattices. In a unit, a forward Viterbi pass gives the best score of every prefix. Those scores are exact
heuristics for a search from the unit's end back to its start: an A-star search that, by prefix score plus the score of
the path behind it, pops complete segmentations best first, so the first N popped are the N best. Only the N - 1 units
whose second choice costs least can differ among a text's N best: those are searched and combined, the others keep their
best. What a second choice costs is known from the forward scores and those of a pass from the end: it goes through
some edge that is not on the best path. Both passes run over all new units of a batch at once.

A segmentation's score is the sum of its pieces' log-probabilities. A vocabulary that has them is taken as it is. One
that has the ranks of merges in their place (scores 0, -1, -2, ...) says only which pieces are more frequent; nothing is
trained here, so Zipf's law turns rank r into the log-probability of 1 / (r + 1) over the sum of all. A character that no
piece covers scores below every piece and becomes its bytes' pieces.

Of equal scores the one whose last piece is longest comes first, then the last but one, and so on. A place in a unit that
the search has left towards the start n times can add nothing to the n best and is not left again, so that long runs of
one character take time in proportion to their length.

Cases: a null or empty text has no pieces and score 0; line ends and the like become bytes; U+2581 in a text is read
back as a space, all else as it was; rows that repeat an id each get their row; an empty table gives no rows; further
columns are left alone, but for those with the name of a result column, which the result replaces.
"""

from __future__ import annotations

import gc
import heapq
import math
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import add, itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import small_batches

#: Segmentations of each text; the units searched beyond their best are one fewer.
NBEST = 8
SPACE = "▁"
#: Units whose segmentations a task remembers before it begins anew: so many with two each, fewer with more.
REMEMBERED = 250_000
#: Longer units are worked on one by one.
LONG = 256
#: Characters of units whose lattices are worked on at once.
TOGETHER = 1 << 18
_MODELS: dict[tuple[str, int], Segmenter] = {}


class Vocabulary(NamedTuple):
    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]  # id of each byte's piece
    pieces: list[str]
    unknown: float

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Pieces, ids and scores of a SentencePiece model file; segmentation is our own."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        return cls.of(pieces, by_rank({i: sp.get_score(i) for i in plain}), {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)})

    @classmethod
    def of(cls, pieces: list[str], scores: dict[int, float], bytes_: dict[int, int]) -> Vocabulary:
        known = [s for s in scores.values() if s > -1e8]
        low = min(known, default=0.0)
        own = {pieces[i]: max(s, low - 1) for i, s in scores.items()}  # runs of spaces carry a mark instead of a score
        return cls({pieces[i]: i for i in scores}, own, [bytes_[b] for b in range(256)], pieces, low - 10)


def by_rank(scores: dict[int, float]) -> dict[int, float]:
    """Log-probabilities by Zipf's law if the scores are ranks of merges (whole, none twice); else the scores."""
    known = [s for s in scores.values() if s > -1e8]
    if len(known) < 2 or len(set(known)) < len(known) or any(s > 0 or s != int(s) for s in known):
        return scores
    whole = math.log(sum(1 / (1 - s) for s in known))
    return {i: -math.log(1 - s) - whole if s > -1e8 else s for i, s in scores.items()}


class Solved(NamedTuple):
    """Best segmentations of units one after another: their ids, how many each has, scores, and how much each one's second
    falls behind (infinite without one)."""

    ids: np.ndarray
    counts: np.ndarray
    scores: np.ndarray
    behind: np.ndarray

    @classmethod
    def joined(cls, parts: list[Solved]) -> Solved:
        return cls(*(np.concatenate(x) for x in zip(*parts))) if parts else cls(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))


class Encoded(NamedTuple):
    """Best segmentations of texts one after another, where each begins (and the end), scores, and for each text the next
    n - 1 by score and by where they differ from the best."""

    ids: np.ndarray
    starts: np.ndarray
    scores: np.ndarray
    others: list[list[tuple[float, list[Change]]]]


class Change(NamedTuple):
    """Ids that stand for the best segmentation's ids from `begin` to `end`."""

    begin: int
    end: int
    ids: tuple[int, ...]


_FIRST = itemgetter(0)


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, count of them, one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - begin, count)


class Trie:
    """A vocabulary's pieces as a table of steps, for the lattices of many units at once.

    A step is (node, character) to node, held in an open-addressed table. A node that ends a piece has its id and score.
    """

    def __init__(self, vocabulary: Vocabulary):
        steps: dict[tuple[int, int], int] = {}
        ends: dict[int, str] = {}
        for p in vocabulary.ids:
            node = 0
            for c in p:
                node = steps.setdefault((node, ord(c)), len(steps) + 1)
            if p:
                ends[node] = p
        self.v, self.n_pieces = vocabulary, len(vocabulary.pieces)
        self.piece, self.score = np.full(len(steps) + 1, -1, np.int64), np.zeros(len(steps) + 1)
        for node, p in ends.items():
            self.piece[node], self.score[node] = vocabulary.ids[p], vocabulary.scores[p]
        self.longest = max(map(len, vocabulary.ids), default=1)
        self.bits = max(4, (4 * len(steps)).bit_length())
        self.keys, self.nodes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        keys = np.array([n << 21 | c for n, c in steps], np.int64)
        nodes, left = np.array(list(steps.values()), np.int64), np.arange(len(steps))
        at = self._slot(keys)
        while len(left):
            free = self.keys[at[left]] < 0
            self.keys[at[left[free]]] = keys[left[free]]  # of several that want a slot the last gets it
            won = self.keys[at[left]] == keys[left]
            self.nodes[at[left[won]]] = nodes[left[won]]
            left = left[~won]
            at[left] = at[left] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next nodes, -1 where there is none."""
        keys = node << 21 | char
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.nodes[at], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & (1 << self.bits) - 1
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.nodes[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def edges(self, chars: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """Begin, length, score and id of every piece in the units. left: characters from a place to its unit's end.

        A character without a piece of its own has an edge with the unknown score and an id beyond the pieces'.
        """
        place, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        begin, length, score, piece = [], [], [], []
        for n in range(1, self.longest + 1):
            node = self.step(node, chars[place + n - 1])
            on = self.piece[node] >= 0
            on &= node >= 0
            begin.append(place[on])
            length.append(np.full(len(begin[-1]), n))
            score.append(self.score[node[on]])
            piece.append(self.piece[node[on]])
            if n == 1:
                alone = place[~on]
                begin.append(alone)
                length.append(np.ones(len(alone), np.int64))
                score.append(np.full(len(alone), self.v.unknown))
                piece.append(self.n_pieces + chars[alone])
            more = np.flatnonzero((node >= 0) & (left[place] > n))
            place, node = place[more], node[more]
            if not len(place):
                break
        return tuple(np.concatenate(x) for x in (begin, length, score, piece))

    def solve(self, units: list[str]) -> Solved:
        """Viterbi from both ends of all units' lattices, place by place."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(sizes)
        unit = np.repeat(np.arange(len(units)), sizes)
        inside = np.arange(len(chars)) - (ends - sizes)[unit]
        begin, length, score, piece = self.edges(chars, ends[unit] - np.arange(len(chars)))
        of = unit[begin]
        # a unit has a slot for each place and one for its end
        src = begin + of
        dst = src + length
        forward, backward, came = np.zeros(len(chars) + len(units)), np.zeros(len(chars) + len(units)), np.zeros(len(chars) + len(units), np.int64)

        def passes(level: np.ndarray, slot: np.ndarray, longest_first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Edges of each level with the starts of those that share a slot, level by level."""
            order = np.argsort((level << 40) | (slot << 8) | longest_first, kind="stable")
            cuts = np.flatnonzero(np.diff(level[order])) + 1
            for e in np.split(order, cuts):
                yield e, np.flatnonzero(np.concatenate([[True], slot[e][1:] != slot[e][:-1]]))

        none = np.minimum(255, self.longest - length) if self.longest < 256 else 255 - np.minimum(255, length)
        for e, first in passes(inside[begin] + length, dst, none):
            reach = forward[src[e]] + score[e]
            best = np.maximum.reduceat(reach, first)
            at = dst[e[first]]
            forward[at] = best
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(e))))
            top = np.flatnonzero(reach == best[group])
            came[at] = e[top[np.concatenate([[True], group[top][1:] != group[top][:-1]])]]
        for e, first in passes(sizes[of] - inside[begin], src, none):
            backward[src[e[first]]] = np.maximum.reduceat(score[e] + backward[dst[e]], first)
        start, end = ends - sizes + np.arange(len(units)), ends + np.arange(len(units))
        now, live, steps = end.copy(), np.arange(len(units)), []
        on_path = np.zeros(len(src), bool)
        while len(live):
            e = came[now[live]]
            on_path[e] = True
            steps.append((live, piece[e]))
            now[live] = src[e]
            live = live[now[live] > start[live]]
        who, ids = np.concatenate([x[0] for x in steps]), np.concatenate([x[1] for x in steps])
        order = np.argsort(who[::-1], kind="stable")  # steps were taken from the end
        flat, counts = ids[::-1][order], np.bincount(who, minlength=len(units))
        second = np.full(len(units), -np.inf)
        off = np.flatnonzero(~on_path)
        np.maximum.at(second, of[off], forward[src[off]] + score[off] + backward[dst[off]])
        best = forward[end]
        odd = np.flatnonzero(flat >= self.n_pieces)
        if len(odd):  # characters as their bytes' pieces
            chars_of = {c: np.array([self.v.bytes_[b] for b in chr(c - self.n_pieces).encode("utf-8", "surrogatepass")]) for c in np.unique(flat[odd]).tolist()}
            sizes_of = np.ones(len(flat), np.int64)
            sizes_of[odd] = [len(chars_of[c]) for c in flat[odd].tolist()]
            begins = np.cumsum(sizes_of) - sizes_of
            wide = np.repeat(flat, sizes_of)
            for at, c in zip(begins[odd].tolist(), flat[odd].tolist()):
                wide[at : at + len(chars_of[c])] = chars_of[c]
            counts = np.add.reduceat(sizes_of, np.cumsum(counts) - counts)
            flat = wide
        return Solved(flat.astype(np.int32), counts, best, np.maximum(best - second, 0.0))


class Segmenter:
    def __init__(self, vocabulary: Vocabulary, n: int = NBEST):
        self.v, self.n = vocabulary, n
        # pieces by their characters: a node is (children, score), the last None where no piece ends
        self.root: dict[str, list] = {}
        for p in vocabulary.ids:
            children, node = self.root, None
            for c in p:
                node = children.setdefault(c, [{}, None])
                children = node[0]
            if node:
                node[1] = vocabulary.scores[p]
        self.longest = max(map(len, vocabulary.ids), default=1)
        self.trie = Trie(vocabulary)
        self.pairs = {p[k : k + 2] for p in vocabulary.ids for k in range(len(p) - 1)}
        inside = {c for p in vocabulary.ids if len(p) > 1 for c in p}
        # what stands alone in every piece, and marks that follow no letter in one: units end before them
        lone = "".join(re.escape(c) for c in "\n\r\t\v\f" if c not in inside)
        after = {y for x, y in self.pairs if x.isalpha()}
        tail = "".join(re.escape(c) for c in ".,;:!?" if c not in after)
        # a unit goes on over a mark unless a letter stands before it
        more = f"(?:[^{SPACE}{tail}{lone}]+|(?<![^\\W\\d_])[{tail}])*" if tail else f"[^{SPACE}{lone}]*"
        forms = [f"{SPACE}+{more}", *([f"[{tail}]{more}"] if tail else []), f"[^{SPACE}{lone}]{more}", *([f"[{lone}]"] if lone else [])]
        self.unit_form = re.compile("|".join(forms))
        if any(SPACE in p.lstrip(SPACE) for p in vocabulary.ids):
            raise ValueError("a piece holds a space after another character")
        self.known: dict[str, int] = {}  # numbers of units in what is solved
        self.solved = Solved.joined([])
        self.begins = np.zeros(0, np.int64)
        self.rest: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        # a byte's piece is its character below 128, else a lone surrogate that stands for the byte
        self.names = list(vocabulary.pieces)
        for value, i in enumerate(vocabulary.bytes_):
            self.names[i] = chr(value) if value < 128 else chr(0xDC00 + value)
        each = [n.replace(SPACE, " ").encode("utf-8", "surrogateescape") for n in self.names]
        self.name_sizes = np.fromiter(map(len, each), np.int64, len(each))
        self.name_begins, self.name_bytes = np.cumsum(self.name_sizes) - self.name_sizes, np.frombuffer(b"".join(each), np.uint8)

    def search(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a stretch, with scores, best first."""
        if n < 1:
            return []
        unknown, size, root, scores, longest = self.v.unknown, len(unit), self.root, self.v.scores, self.longest
        best = [0.0] + [-math.inf] * size
        for i in range(size):
            here, children = best[i], root
            for j in range(i, size):
                node = children.get(unit[j])
                if node is None:
                    break
                children, score = node
                if score is not None and here + score > best[j + 1]:
                    best[j + 1] = here + score
            if unit[i] not in scores and here + unknown > best[i + 1]:
                best[i + 1] = here + unknown
        found: list[tuple[float, tuple[int, ...]]] = []
        # (-(prefix score + score behind), place, order of being put in, which of its edges, score behind, path behind as
        # linked pairs): an edge of a place is put in when the one before it, which reaches further, is taken out
        put, push, pop = 0, heapq.heappush, heapq.heappop
        into: dict[int, list[tuple[float, int, float]]] = {}  # edges of a place: prefix score through it, -begin, score
        left: dict[int, int] = {}
        heap: list[tuple] = [(-best[size], size, 0, 0, 0.0, None)]
        while heap:
            f, at, _, k, behind, path = pop(heap)
            if not at:
                found.append((-f, self._ids(unit, path)))
                if len(found) == n:
                    break
                continue
            if k == 0:
                left[at] = left.get(at, 0) + 1
                if left[at] > n:
                    continue
            edges = into.get(at)
            if edges is None:
                edges = [(best[i] + s, -i, s) for i in range(at - 1, max(-1, at - longest - 1), -1) if (s := scores.get(unit[i:at])) is not None]
                if unit[at - 1] not in scores:
                    edges.append((best[at - 1] + unknown, 1 - at, unknown))
                edges.sort(reverse=True)
                into[at] = edges
            _, i, score = edges[k]
            if k + 1 < len(edges):
                put += 1
                push(heap, (-(edges[k + 1][0] + behind), at, put, k + 1, behind, path))
            put += 1
            push(heap, (f, -i, put, 0, behind + score, (-i, path)))
        return found

    def _ids(self, unit: str, path: tuple | None) -> tuple[int, ...]:
        """Ids of the pieces between places, linked from the start of the unit."""
        ids: list[int] = []
        get, size = self.v.ids.get, len(unit)
        while path:
            begin, path = path
            part = unit[begin : path[0] if path else size]
            piece = get(part)
            if piece is not None:
                ids.append(piece)
            else:
                ids += [self.v.bytes_[b] for b in part.encode("utf-8", "surrogatepass")]
        return tuple(ids)

    def _combined(self, units: list[str], scores: np.ndarray, behind: np.ndarray) -> list[tuple[float, tuple[tuple[int, tuple[int, ...]], ...]]]:
        """The n least costly sets of changes to a chain of units, ((unit, ids), ...) each."""
        few = [int(behind.argmin())] if self.n == 2 else np.argsort(behind, kind="stable")[: self.n - 1].tolist()
        ways: list[tuple[float, tuple[tuple[int, tuple[int, ...]], ...]]] = [(0.0, ())]
        for k in few:
            if behind[k] < math.inf:
                choices = [(0.0, None), *[(float(scores[k]) - s, ids) for s, ids in self.others(units[k])]]
                ways = heapq.nsmallest(self.n, ((c + d, w if ids is None else (*w, (k, ids))) for c, w in ways for d, ids in choices), key=_FIRST)
        return ways

    def others(self, unit: str) -> list[tuple[float, tuple[int, ...]]]:
        """The second to nth best of a unit."""
        found = self.rest.get(unit)
        if found is None:
            found = self.nbest_of(unit)[1:]
            if len(unit) <= LONG:
                if len(self.rest) * self.n >= 2 * REMEMBERED:
                    self.rest.clear()
                self.rest[unit] = found
        return found

    def nbest_of(self, unit: str) -> list[tuple[float, tuple[int, ...]]]:
        """The n best of a unit. Characters that never meet inside a piece part its lattice: each part is searched alone."""
        pairs = self.pairs
        cuts = [i for i, p in enumerate(map(add, unit, unit[1:]), 1) if p not in pairs]
        if not cuts:
            return self.search(unit, self.n)
        parts = [unit[i:j] for i, j in zip([0, *cuts], [*cuts, len(unit)])]
        known: dict[str, list] = {}
        for p in parts:
            if p not in known:
                known[p] = self.search(p, self.n)
        own = [known[p] for p in parts]
        score = sum(o[0][0] for o in own)
        costs = [o[0][0] - o[1][0] if len(o) > 1 else math.inf for o in own]
        ways: list[tuple[float, dict]] = [(0.0, {})]
        for k in heapq.nsmallest(self.n - 1, range(len(own)), key=costs.__getitem__) if self.n > 1 else []:
            if costs[k] < math.inf:
                ways = heapq.nsmallest(self.n, ((c + own[k][0][0] - s, w if not i else w | {k: i}) for c, w in ways for i, (s, _) in enumerate(own[k])), key=_FIRST)
        return [(score - c, tuple(chain.from_iterable(o[w.get(k, 0)][1] for k, o in enumerate(own)))) for c, w in ways]

    def learn(self, units: Iterable[str]) -> None:
        """Find the best segmentations of units that aren't remembered."""
        wanted = set(units)
        if len(self.solved.counts) > REMEMBERED:
            self.known, self.solved = {}, Solved.joined([])
        missing = sorted(wanted.difference(self.known))
        parts, held, size = [self.solved], [], 0
        for u in missing:
            if len(u) <= LONG:
                held.append(u)
                size += len(u)
            if size > TOGETHER:
                parts.append(self.trie.solve(held))
                held, size = [], 0
        if held:
            parts.append(self.trie.solve(held))
        long = [u for u in missing if len(u) > LONG]
        for u in long:
            found = self.nbest_of(u)
            parts.append(Solved(np.array(found[0][1], np.int32), np.array([len(found[0][1])]), np.array([found[0][0]]), np.array([found[0][0] - found[1][0] if len(found) > 1 else math.inf])))
        if missing:
            at = len(self.solved.counts)
            self.known.update(zip([*[u for u in missing if len(u) <= LONG], *long], range(at, at + len(missing))))
            self.solved = Solved.joined(parts)
            self.begins = np.cumsum(self.solved.counts) - self.solved.counts

    def units(self, text: str) -> list[str]:
        return self.unit_form.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_all(self, texts: list[str]) -> Encoded:
        units = [self.units(t) for t in texts]
        every = list(chain.from_iterable(units))
        self.learn(every)
        code = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        counts = self.solved.counts[code]
        ids = self.solved.ids[_ranges(self.begins[code], counts)]
        n_units = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(n_units)
        upto = np.concatenate([[0], np.cumsum(counts)])
        starts = upto[np.concatenate([[0], ends])]
        scores, behind = self.solved.scores[code], self.solved.behind[code]
        totals, others = np.zeros(len(texts)), []
        for i, (a, b) in enumerate(zip((ends - n_units).tolist(), ends.tolist())):
            own: list[tuple[float, list[Change]]] = []
            if b > a:
                totals[i] = total = float(scores[a:b].sum())
                for cost, changed in self._combined(units[i], scores[a:b], behind[a:b])[1:]:
                    at = [int(upto[a + k] - starts[i]) for k, _ in sorted(changed)]
                    own.append((total - cost, [Change(x, x + int(counts[a + k]), new) for x, (k, new) in zip(at, sorted(changed))]))
            others.append(own)
        for u in [u for u in set(every) if len(u) > LONG]:
            del self.known[u]
        return Encoded(ids, starts, totals, others)

    def encode(self, text: str) -> tuple[list[int], float, list[tuple[float, list[Change]]]]:
        """Ids and score of the best segmentation, and of the next n - 1 the score and where they differ from it."""
        out = self.encode_all([text])
        return out.ids.tolist(), float(out.scores[0]), out.others[0]

    def read_back(self, out: Encoded, texts: list[str]) -> list[bool]:
        """Whether the ids of each text decode to it (with spaces for U+2581)."""
        data = self.name_bytes[_ranges(self.name_begins[out.ids], self.name_sizes[out.ids])].tobytes()
        want = [b" " + t.replace(SPACE, " ").encode() if t else b"" for t in texts]
        if data == b"".join(want):
            return [True] * len(texts)
        upto = np.concatenate([[0], np.cumsum(self.name_sizes[out.ids])])[out.starts].tolist()
        return [data[a:b] == w for a, b, w in zip(upto, upto[1:], want)]

    def nbest(self, text: str) -> list[tuple[float, list[int]]]:
        """The n best segmentations, (score, ids), best first."""
        ids, score, others = self.encode(text)
        out = [(score, ids)]
        for s, changes in others:
            new = list(ids)
            for c in reversed(changes):
                new[c.begin : c.end] = c.ids
            out.append((s, new))
        return out

    def decode(self, ids: list[int]) -> str:
        text = "".join(map(self.names.__getitem__, ids))
        if not text.isascii():
            try:
                text.encode()
            except UnicodeEncodeError:
                text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text.replace(SPACE, " ")[1:]


def default_model() -> str:
    """Path of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def segmenter(path: str, n: int = NBEST) -> Segmenter:
    """One for each task process, with what it remembers."""
    if (path, n) not in _MODELS:
        _MODELS[path, n] = Segmenter(Vocabulary.load(path), n)
    return _MODELS[path, n]


_CHANGES = "array<struct<begin:int,end:int,ids:array<int>>>"
_OUT = f"ids array<int>, score double, others array<struct<score:double,changes:{_CHANGES}>>, decoded boolean"


def _encoded(path: str, n: int, names: list[str]):
    change = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("ids", pa.list_(pa.int32()))])
    kind = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(change))]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(path, n)
        collects = gc.isenabled()
        gc.disable()  # what is remembered is many small tuples and no cycles
        try:
            for batch in it:
                texts = batch.column(0).to_pylist()
                out = own.encode_all(texts)
                cols = [
                    pa.ListArray.from_arrays(pa.array(out.starts, pa.int32()), pa.array(out.ids, pa.int32())),
                    pa.array(out.scores, pa.float64()),
                    pa.array([[{"score": s, "changes": [c._asdict() for c in changes]} for s, changes in o] for o in out.others], kind),
                    pa.array(own.read_back(out, texts)),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], names=names)
        finally:
            if collects:  # the worker goes on to other tasks
                gc.enable()

    return run


def encoded(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, path: str | None = None, n: int = NBEST) -> DataFrame:
    """The columns `keep` of docs (all but the text, if not given) with the best segmentation's ids and score, the
    other n - 1 by score and by where they differ from it, and whether the ids decode to the text. path: of the model file on every executor."""
    small_batches(docs.sparkSession, 500, "4m")
    own = ["ids", "score", "others", "decoded"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own and c != text_col]
    schema = StructType([*[docs.schema[c] for c in keep], *StructType.fromDDL(_OUT)])
    names = [*keep, *own]
    return docs.select(F.coalesce(text_col, F.lit("")).alias("_text"), *[docs[c] for c in keep]).mapInArrow(_encoded(path or default_model(), n, names), schema)


def _decoded(path: str, names: list[str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(path)
        for batch in it:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([own.decode(i or []) for i in batch.column(0).to_pylist()], pa.string())], names=names)

    return run


def decoded(rows: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """rows with a column `text` in place of the ids."""
    keep = [c for c in rows.columns if c != ids_col]
    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep], "text string"])
    return rows.select(F.col(ids_col), *keep).mapInArrow(_decoded(path or default_model(), [*keep, "text"]), schema)


def piece_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, others: bool = False) -> DataFrame:
    """One row per row of docs: id, pieces of the best segmentation, its score, how far the second falls behind, the
    best's ids as a hash, and whether they decode to the text; with others, how many segmentations were found and how far
    the last of them falls behind."""
    out = encoded(docs, text_col, [id_col], path)
    behind = lambda k: F.round(F.col("score") - F.try_element_at("others", F.lit(k))["score"], 3)
    more = [(F.size("others") + 1).cast("long").alias("n_best"), behind(-1).alias("last_margin")] if others else []
    return out.select(
        id_col,
        F.size("ids").cast("long").alias("n_pieces"),
        F.round("score", 3).alias("score"),
        behind(1).alias("margin"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        "decoded",
        *more,
    )
