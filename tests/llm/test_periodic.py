"""op13 against a look at all periods and places."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from strandworks.llm import periodic

DOCS = "doc_id long, text string, runs string, period long, _row string"


def _seeded(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def _runs(words):
    """(start, period, length) by definition: every period, every maximal stretch, its least period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= max(q, 12 - q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, q, n) for (s, n), q in found.items())


def _digest(doc_id, text, seeds=True):
    words = (text or "").split()
    words = _seeded(doc_id, words) if seeds else words
    runs = _runs(words)
    dropped = {i for s, q, n in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    longest = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc_id, len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def _text(r):
    """Words with periodic stretches of many periods, also inside each other and side by side."""
    out = []
    for _ in range(r.randrange(1, 6)):
        kind = r.random()
        if kind < 0.3:
            out += [f"w{r.randrange(400)}" for _ in range(r.randrange(80))]
        elif kind < 0.5:
            out += [r.choice("ab") for _ in range(r.randrange(60))]
        else:
            unit = [f"u{r.randrange(r.choice([2, 500]))}" for _ in range(r.choice([1, 2, 3, 5, 6, 11, 12, 15, 16, 17, 30, 31, 32, 40, 64, 65, 90]))]
            if r.random() < 0.3:
                unit = unit * 2 + unit[:1] + ["x"]
            out += (unit * 9)[: int(len(unit) * r.uniform(1, 8))]
    return "\t".join(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(13)
    texts = [None, "", " \n ", "one", "w " * 12, "w " * 11, "W w " * 8, "Über ﬁne " * 7, "a b c " * 700, "z " * 3000, ("p " * 40 + "q ") * 30]
    texts += [_text(r) for _ in range(150)]
    out = [(i, t, "clash", 7, "x") for i, t in enumerate(texts)]
    return out + [(None, "n u l l " * 9, None, None, None), (None, None, None, None, None), (8, "a b c " * 700, "again", 1, "x"), (8, "another " * 20, "again", 1, "x")]


def _sorted(found):
    return sorted((tuple(x) for x in found), key=repr)


def test_run_digest(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert _sorted(periodic.run_digest(docs).collect()) == _sorted(_digest(i, t) for i, t, *_ in rows)
    assert periodic.run_digest(docs.limit(0)).collect() == []


@pytest.mark.parametrize("long, tile", [(100, 64), (1000, 128)])
def test_tiles_of_long_documents(spark, rows, long, tile):
    docs = spark.createDataFrame(rows, DOCS).repartition(2)
    got = periodic.periodic_runs(docs, long=long, tile=tile)
    want = [(i, [tuple(x) for x in _runs((t or "").split())]) for i, t, *_ in rows]
    assert _sorted((x._id, [tuple(y) for y in x.runs]) for x in got.collect()) == _sorted(want)


def test_comparisons_in_small_helpings(rows, monkeypatch):
    monkeypatch.setattr(periodic, "COMPARED", 64)
    for _, text, *_ in rows[:40]:
        words = (text or "").encode().split()
        q, lo, hi = periodic.fragments(periodic._numbered(words), 0, len(words), periodic._octaves(len(words)))
        found = {}
        for period, start, end in sorted(zip(q.tolist(), lo.tolist(), hi.tolist())):
            maximal = (start == 0 or words[start - 1] != words[start - 1 + period]) and (end + period == len(words) or words[end] != words[end + period])
            if end - start >= max(period, 12 - period) and maximal:  # parts of what a smaller period implies may be there too
                found.setdefault((start, end - start + period), period)
        assert sorted((s, p, n) for (s, n), p in found.items()) == _runs(words)


def test_documents_solved_together(spark, rows, monkeypatch):
    monkeypatch.setattr(periodic, "TOGETHER", 100)
    docs = spark.createDataFrame(rows[:60], DOCS).repartition(2)
    assert _sorted(periodic.run_digest(docs, seeds=False).collect()) == _sorted(_digest(i, t, False) for i, t, *_ in rows[:60])


def test_a_million_words(spark):
    r = random.Random(4)
    unit = " ".join(f"w{r.randrange(10**5)}" for _ in range(90_000))
    docs = spark.createDataFrame([(1, "w " * 1_000_000), (2, f"first {unit} {unit} {unit} last"), (3, "a b c " * 300_000)], "doc_id long, text string")
    got = {x._id: [tuple(y) for y in x.runs] for x in periodic.periodic_runs(docs).collect()}
    assert got == {1: [(0, 1, 1_000_000)], 2: [(1, 90_000, 270_000)], 3: [(0, 3, 900_000)]}


def test_stitched():
    lo, hi = periodic.stitched(np.array([5, 0, 2, 9, 20]), np.array([9, 3, 4, 12, 21]))
    assert lo.tolist() == [0, 5, 20] and hi.tolist() == [4, 12, 21]
