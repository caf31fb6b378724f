"""op12 against all pairs, with lists of all lengths dealt anew, and its signatures against Jaccard similarities."""

import random

import numpy as np
import pytest
import xxhash

from strandworks.llm import minhash

DOCS = "doc_id long, text string, n long, signature string, kept boolean"


def _sets(rows):
    out = []
    for _, text, *_ in rows:
        words = (text or "").lower().split()
        out.append({tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else {tuple(words)} if words else set())
    return out


def _brute(rows):
    sets, root = _sets(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for r, row in zip(root, rows):
        least.setdefault(r, []).append(row[0])
    out = []
    for r, row, own in zip(root, rows, sets):
        component = min((i for i in least[r] if i is not None), default=None)
        out.append((row[0], len(own), component, row[0] == component))
    return sorted(out, key=repr)


def _edited(r, words, edits):
    words = list(words)
    for k in r.sample(range(len(words)), edits):
        words[k] = f"new{r.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    texts = [None, "", " \n", "one", "ONE", "one two", "one two three", "One two\tthree", "w " * 3000, "w " * 200]
    for _ in range(25):  # small groups on both sides of the limit
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([12, 60, 200]))]
        texts += [" ".join(base), *[_edited(r, base, r.randint(1, max(1, len(base) // 30))) for _ in range(3)]]
    base = [f"v{i}" for i in range(120)]
    texts += [_edited(r, base, r.randint(1, 6)) for _ in range(150)]  # one large group, not all of it within reach
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"q{r.randrange(10**6)}" for _ in range(40)) for _ in range(150)]  # a passage of many
    texts += ["same words as ever " * k for k in range(2, 12)]
    out = [(i, t, 1, "clash", None) for i, t in enumerate(texts)]
    return out + [(None, texts[12], None, None, None), (None, "alone and null", None, None, None), (40, texts[20], 1, "", False), (40, None, 1, "", False), (3, texts[60], 1, "", True)] + [(1000 + i, texts[30].upper(), 1, "", True) for i in range(40)]


def _got(docs):
    return sorted((tuple(x) for x in minhash.jaccard_groups(docs).collect()), key=repr)


def test_jaccard_groups(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    assert _got(docs) == _brute(rows)
    assert _got(docs.limit(0)) == []


def test_lists_dealt_anew(spark, rows, monkeypatch):
    monkeypatch.setattr(minhash, "WORK", 30)
    monkeypatch.setattr(minhash, "NEXT", 1)
    monkeypatch.setattr(minhash, "CACHE", 50)
    dealt = []
    deeper = minhash._deeper
    monkeypatch.setattr(minhash, "_deeper", lambda depth: dealt.append(depth) or deeper(depth))
    small = rows[:10] + rows[60:300:3] + rows[-45:-30]
    assert _got(spark.createDataFrame(small, DOCS).repartition(4)) == _brute(small)
    assert dealt[:2] == [2, 3]


def test_prefix_holds_the_next_agreement():
    r = random.Random(2)
    for _ in range(300):
        agree = sorted(r.sample(range(minhash.COORDINATES), minhash.MATCHES))
        for depth in range(1, minhash.DEPTH + 1):
            assert agree[depth - 1] < minhash.COORDINATES - minhash.MATCHES + depth


def test_signatures_agree_as_sets_are_similar():
    r = random.Random(3)
    for share in (0.3, 0.6, 0.85):
        agree = []
        for _ in range(60):
            n = 400
            both = [r.getrandbits(64) for _ in range(round(n * share))]
            one, other = ([*both, *[r.getrandbits(64) for _ in range((n - len(both)) // 2)]] for _ in range(2))
            agree.append(np.mean(minhash.signature(np.array(one, np.uint64)) == minhash.signature(np.array(other, np.uint64))))
        assert abs(np.mean(agree) - share) < 0.03


def test_filters_never_drop_a_link(rows):
    """Sizes, folded parities and wide bitmaps of sets that are similar let them through."""
    sets = [s for s in _sets(rows) if s]
    hashes = [np.sort(np.array([xxhash.xxh64_intdigest(" ".join(x), 42) for x in s], np.uint64)) for s in sets]
    wide = [minhash._parity(h, minhash._bits(len(h))).tobytes() for h in hashes]
    for i in range(0, len(sets), 3):
        for j in range(i):
            bits = 8 * min(len(wide[i]), len(wide[j]))
            apart = int(np.bitwise_count(minhash._folded(wide[i], bits) ^ minhash._folded(wide[j], bits)).sum())
            assert apart <= len(sets[i] ^ sets[j])
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                assert minhash._can_be(len(sets[i]), len(sets[j]), apart)


@pytest.mark.parametrize("seed", range(8))
def test_forest_ties_what_all_pairs_tie(seed):
    """Turn by turn, wrong pairs barred, a list's components are those of all its true pairs."""
    r = random.Random(seed)
    n = 40
    node = np.array(r.sample(range(1000), n))
    maybe = {(i, j) for i in range(n) for j in range(i) if r.random() < 0.12}
    true = {p for p in maybe if r.random() < 0.6}
    start = [r.randrange(12) if r.random() < 0.6 else 100 + i for i in range(n)]

    def components(pairs):
        root = list(start)
        for i, j in pairs:
            root = [root[j] if x == root[i] else x for x in root]
        return {frozenset(i for i in range(n) if root[i] == k) for k in root}

    def similar(i, met):
        return np.array([(max(i, int(k)), min(i, int(k))) in maybe for k in met], bool)

    found, barred, turns = set(), set(), 0
    while True:
        groups = {i: k for k, own in enumerate(sorted(components(found), key=sorted)) for i in own}
        pairs = {(max(p), min(p)) for p in minhash.forest(node, np.array([groups[i] for i in range(n)]), barred, similar, False)}
        assert len(pairs) < len(set(groups.values()))
        found |= pairs & true
        barred |= {tuple(sorted((int(node[i]), int(node[j])))) for i, j in pairs - true}
        turns += 1
        if pairs <= true:
            break
    assert components(found) == components(true) and turns > 1
    everything = set(minhash.forest(node, np.array(start), set(), similar, True))
    assert {(max(p), min(p)) for p in everything} == {p for p in maybe if start[p[0]] != start[p[1]]}


def test_members_with_candidates():
    r = np.random.default_rng(4)
    own = r.integers(-(2**63), 2**63 - 1, (1 + len(minhash._DIGEST) + 4, 60))
    own[0] = r.integers(90, 110, 60)
    own[:, 40:55] = own[:, 3:18]  # the same sets again
    own[1:5, 55:] = own[1:5, :5]  # digests agree, parities don't
    want = np.array([any(i != j and minhash._can_link(own[:, [i]], own[:, [j]])[0] > 0 for j in range(60)) for i in range(60)])
    assert minhash.partnered(own).tolist() == want.tolist() and 30 <= want.sum() < 60
