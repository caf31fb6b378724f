import hashlib
import random

import numpy as np
import pytest

from strandworks.llm import suffix_dedup as S


def brute(docs):
    """docs: distinct ids in order. What the contract says, window by window."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        gone = np.zeros(len(text), bool)
        for s in range(len(text) - S.MATCH + 1):
            w = text[s : s + S.MATCH]
            if w in seen:
                gone[s : s + S.MATCH] = True
            seen.add(w)
        left = bytes(np.frombuffer(text, np.uint8)[~gone])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1)
        out[i] = (len(text), int(gone.sum()), len(edge), hashlib.sha256(left).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, docs = text(60), []
    for k in range(120):
        t = text(r.randint(0, 150))
        if k % 3 == 0:
            cut = r.randint(0, len(t))
            t = t[:cut] + passage[r.randint(0, 40) :] + t[cut:]
        if k % 10 == 1:
            t = ("tick tock ") * r.randint(8, 60)
        if k % 7 == 2 and docs:
            t = r.choice(docs)
            if r.random() < 0.5:
                p = r.randint(0, len(t))
                t = t[:p] + "ZZ" + t[p:]
        docs.append(t)
    docs[5], docs[6], docs[7] = "", "x" * 99, "x" * 100
    docs[8], docs[9] = "x" * 350, "ab" * 200
    return docs


@pytest.mark.parametrize("seed, hot", [(1, 4096), (2, 20)])
def test_against_every_window(spark, seed, hot):
    texts = corpus(seed)
    random.Random(seed).shuffle(texts)
    want = brute([(i, t.encode()) for i, t in enumerate(texts)])
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, marks string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.removal_digest(docs, hot=hot).collect()}
    assert got == want


def test_nulls_repeated_rows_and_empty_tables(spark):
    t = " ".join(f"word{i}" for i in range(60))
    rows = [(3, t), (3, t), (7, t), (None, t), (8, None), (9, "")]
    got = sorted(((r.doc_id or -1), r.n_bytes, r.n_removed, r.n_spans) for r in S.removal_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(t)
    assert got == [(-1, n, 0, 0), (3, n, 0, 0), (3, n, 0, 0), (7, n, n, 1), (8, 0, 0, 0), (9, 0, 0, 0)]
    assert S.removal_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_parse_covers_each_window_once(monkeypatch):
    r = random.Random(5)
    texts = [bytes(r.choices(b"abc ", k=r.randint(0, 900))) for _ in range(40)]
    data, sizes = b"".join(texts), [len(t) for t in texts]
    lo, hi, at, _ = S.parse(data, sizes)
    starts, want, base = [], [], 0
    for a, b in zip(lo, hi):
        starts += range(a, b + 1)
    for t in texts:
        want += range(base, base + max(0, len(t) - S.MATCH + 1))
        base += len(t)
    assert starts == want
    assert all(b <= p and p + S.TRIGGER <= a + S.MATCH for a, b, p in zip(lo, hi, at))
    one = bytes(r.choices(b"abc ", k=5000))
    whole = S.parse(one, [5000])
    monkeypatch.setattr(S, "_LONGEST", 700)
    sliced = S.parse(one, [5000])
    assert sum(whole[1] - whole[0] + 1) == sum(sliced[1] - sliced[0] + 1) and set(sliced[2]) == set(whole[2])


def test_ranks_are_those_of_the_suffixes():
    r = random.Random(6)
    data = bytes(r.choices(b"ab", k=150)) * 3
    starts = np.arange(len(data) - S.MATCH + 1)
    rank = S.window_ranks(np.frombuffer(data, np.uint8), starts)
    windows = [data[s : s + S.MATCH] for s in starts]
    order = {w: i for i, w in enumerate(sorted(set(windows)))}
    assert rank.tolist() == [order[w] for w in windows]


def test_one_id_on_different_texts(spark):
    t, short = "".join(f"word{i} " for i in range(30)), "thirty bytes of something else"
    rows = [(1, t), (3, "zzzz" + t), (3, short), (3, "yy" + t)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in S.removal_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(t)
    assert got == sorted([(1, n, 0, 0), (3, n + 4, n, 1), (3, 30, 0, 0), (3, n + 2, n, 1)])


def test_buckets_are_even_on_plain_text():
    r = random.Random(9)
    text = bytes(r.choices(b"abcdefgh ", k=300_000))
    h = np.unique(S.parse(text, [len(text)])[3])
    sizes = np.bincount(S._even(h, 50), minlength=50)
    assert len(h) > 5000 and sizes.max() < 1.5 * sizes.mean() and sizes.min() > 0.5 * sizes.mean()
