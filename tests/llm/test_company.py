"""Lists of one member go no further, and trees of equal members are one list, wherever they met."""

import numpy as np
import pyarrow as pa

from strandworks.llm import minhash, near_copies


def _lists(rows, column):
    """Members of each token, and how many rows there are."""
    own = {}
    for x in rows:
        if x[column] is not None:
            own.setdefault(x["token"], set()).add(x["node"])
    return sorted(map(sorted, own.values())), sum(x[column] is not None for x in rows)


def test_lists_of_one_member_are_dropped():
    token, node = np.array([1, 2, 2, 3, 5, 5, 5]), np.arange(7) + 10
    batch = pa.RecordBatch.from_arrays([pa.array(token), pa.array(node)], names=["token", "node"])
    rows = [x for b in minhash.in_company(iter([batch])) for x in b.to_pylist()]
    assert [x["node"] for x in rows] == [11, 12, 14, 15, 16] and [x["token"] for x in rows] == [2, 2, 5, 5, 5]


def test_equal_trees_of_op12_are_one_list():
    kinds = np.random.default_rng(4).integers(0, 2**62, (2, len(minhash._LONGS) - 1))
    family = np.repeat(np.arange(2), 4)
    columns = [[t, np.full(8, t), np.arange(8) + 10, np.full(8, 200), *kinds[family].T] for t in (1, 2, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(8, c[0]) if i == 0 else c[i] for c in columns])) for i in range(len(columns[0]))], schema=minhash._POSTINGS)
    rows = [x for b in minhash._meet(iter([batch])) for x in b.to_pylist()]
    assert _lists(rows, "node") == ([[10, 11, 12, 13], [14, 15, 16, 17]], 24)
    tokens = {x["token"] for x in rows if x["a"] is not None}
    assert tokens == {x["token"] for x in rows if x["node"] is not None} and len(tokens) == 2


def test_trees_of_near_dedup_are_lists_of_their_own():
    """Sets of 300 members: 128 bits of parity tell no two apart, 256 do; one set belongs to no family."""
    r = np.random.default_rng(4)
    families = r.integers(-(2**63), 2**63 - 1, (3, 4))
    family = np.array([0] * 5 + [1] * 5 + [2])
    bits = families[family] ^ (1 << r.integers(0, 60, (11, 4)))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (np.repeat([1, 2], 11), np.tile(np.arange(11) + 10, 2), np.full(22, 300), *np.tile(bits, (2, 1)).T)], names=["token", "node", "n", *near_copies.BITS])
    rows = [x for b in near_copies._meet(iter([batch])) for x in b.to_pylist()]
    assert _lists([x for x in rows if x["a"] is None], "node") == ([list(range(10, 15)), list(range(15, 20))], 20)
    assert all((x["a"] < 15) == (x["b"] < 15) and x["b"] < 20 for x in rows if x["a"] is not None)
