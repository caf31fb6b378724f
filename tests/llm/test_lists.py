"""Lists of op12 whose members their trees tie are not gone through again."""

import random

import numpy as np
import pyarrow as pa

from strandworks.llm import minhash


def test_tied_lists_are_not_posted_again(spark, monkeypatch):
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(40)]
    seen = []

    def counted(posted, so_far, f=minhash.several_roots):
        seen.append(posted.count())
        return f(posted, so_far)

    monkeypatch.setattr(minhash, "several_roots", counted)
    got = minhash.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.component_id for x in got} == {0} and sum(seen) == 0, seen


def test_tree_ties_what_all_candidates_tie():
    r = np.random.default_rng(3)
    for size in (2, 5, 40, 600):
        kinds = r.integers(0, 2**62, (6, len(minhash._LONGS) - 1))
        own = np.vstack([np.full(size, 200), kinds[r.integers(0, 6, size)].T])
        own[1:] ^= 1 << r.integers(0, 60, (len(own) - 1, size))
        root = list(range(size))
        for i, j, agree in minhash.tree(own):
            assert agree == minhash._can_link(own[:, [i]], own[:, [j]])[0] > 0 and root[i] != root[j]
            root = [root[i] if x == root[j] else x for x in root]
        assert all(root[i] == root[j] for i in range(size) for j in np.flatnonzero(minhash._can_link(own, own[:, [i]])))


def test_trees_of_a_list_are_lists_of_their_own():
    """One wrong pair opens its own tree again, not all members of the list."""
    r = np.random.default_rng(4)
    kinds = r.integers(0, 2**62, (5, len(minhash._LONGS) - 1))
    family = np.repeat(np.arange(5), 4)
    columns = [np.full(20, 77), np.zeros(20, np.int64), np.arange(20) + (3 << 33), np.full(20, 200), *kinds[family].T]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=minhash._POSTINGS)
    rows = [x for b in minhash._meet(iter([batch])) for x in b.to_pylist()]
    token = {x["node"]: x["token"] for x in rows if x["node"] is not None}
    assert len(token) == 20 and len(set(token.values())) == 5
    pairs = [x for x in rows if x["a"] is not None]
    assert len(pairs) == 15 and all(x["token"] == token[x["a"]] == token[x["b"]] for x in pairs)
