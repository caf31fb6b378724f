"""op11 against a dense brute force, and the skyband against all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strandworks.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, term string, rank int, n long"
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _brute(rows, top=200):
    own, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = [w.decode() for w in TERM.findall((text or "").encode().lower())]
        own[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        mine = [g for g in groups if g[0] == lang]

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p, q = share(own[lang, source]), share(sum((own[g] for g in mine), Counter()))
        parts = {"pair": [], "term": [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if own[lang, source][t] and p[t] > q[t]]}
        for g in mine:
            if g[1] != source:
                other = share(own[g])
                parts["pair"].append((sum((p[t] - other[t]) ** 2 // other[t] for t in kept), g[1]))
        for part, found in parts.items():
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def _rows(r, n, words=60):
    out = []
    for i in range(n):
        source = r.choice(["a", "a", "a", "b", "c", None])
        own = [r.choice(["Wort", "ÄRGER", "ärger", "x-y", "don't", "naïve", "日本", "_", "7up"]) if r.random() < 0.2 else f"{'vwxyz'[r.randrange(5)]}{'ABCDEF'[int(r.random() ** 3 * 6)]}{'gh'[r.randrange(2)] * r.randrange(3)}" for _ in range(r.randrange(words))]
        out.append((i, " ".join(own), r.choice(["en", "de", None, "EN"]), source, "clash", 1, 2))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    odd = [(1, None, "en", "empty", None, None, None), (1, "", "xx", "only", "", 0, 0), (None, "a b a b", "xx", "two", "", 0, 0), (5, "Long " * 400_000, "en", "b", "", 0, 0), (6, "q" * 1_200_000, "de", "a", "", 0, 0)]
    return _rows(r, 300) + odd + [odd[2]] * 3


def test_divergences(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert sorted(tuple(r) for r in divergence.divergences(docs).collect()) == _brute(rows)
    assert sorted(tuple(r) for r in divergence.divergences(docs, top=7).collect()) == _brute(rows, 7)
    monkeypatch.setattr(divergence, "FAN", 2)  # more rounds of merging
    assert sorted(tuple(r) for r in divergence.divergences(docs, top=5).collect()) == _brute(rows, 5)


def test_counts_in_small_helpings(rows, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "PIECE", 64)
    own = [r for r in rows if r[1] and len(r[1]) < 2000]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[k] or "" for x in own[i : i + 9]]) for k in (2, 3, 1)], names=["lang", "source", "text"]) for i in range(0, len(own), 9)]
    n, docs = Counter(), Counter()
    for batch in divergence._count(iter(batches)):
        for lang, source, term, c, d in zip(*[c.to_pylist() for c in batch.columns]):
            n[lang, source, term] += c
            docs[lang, source, term] += d
    want_n, want_docs = Counter(), Counter()
    for _, text, lang, source, *_ in own:
        words = [(lang or "", source or "", w.decode()) for w in TERM.findall(text.encode().lower())]
        want_n.update(words)
        want_docs.update(set(words))
    assert n == want_n and docs == want_docs


def test_divergences_of_nothing(spark):
    assert divergence.divergences(spark.createDataFrame([], DOCS)).collect() == []
    one = spark.createDataFrame([(1, "a a", "en", "x", "", 0, 0), (2, None, "en", "y", "", 0, 0)], DOCS)
    assert sorted(tuple(r) for r in divergence.divergences(one).collect()) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


@pytest.mark.parametrize("seed", range(6))
def test_skyband(seed, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 16)
    r = random.Random(seed)
    n = 300
    a, b = np.array([r.randrange(1 + 5 * seed + 2) for _ in range(n)]), np.array([r.randrange(1 + 4 * seed + 2) for _ in range(n)])
    term = pa.array([f"{r.randrange(10**6)}-{i}" for i in range(n)])
    words = [t.encode() for t in term.to_pylist()]
    for k in (1, 3, 20):
        want = {i for i in range(n) if sum(j != i and a[j] >= a[i] and b[j] <= b[i] and words[j] < words[i] for j in range(n)) < k}
        assert set(divergence.skyband(a, b, term, k).tolist()) == want
    assert divergence.skyband(np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string()), 3).tolist() == []
