"""The pipeline's near-dedup stage against all pairs."""

import random

import pytest

import corpus_pipeline
from strandworks.llm import near_copies

DOCS = "doc_id long, text string, source string"


def _sets(rows):
    out = []
    for _, text, _ in rows:
        words = (text or "").lower().split()
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return out


def _kept(rows):
    """Ids of the rows that stay: the least of each component of all pairs."""
    sets, root = _sets(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    groups = {}
    for r, row in zip(root, rows):
        groups.setdefault(r, []).append(row[0])
    return sorted(str(min((i for i in ids if i is not None), default=None)) for ids in groups.values())


def _edited(r, words, edits):
    words = list(words)
    for k in r.sample(range(len(words)), edits):
        words[k] = f"new{r.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    texts = [None, "", " \n", "one two", "ONE  two", "one two three four five", "w " * 3000]
    for _ in range(25):  # small groups on both sides of the limit
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([12, 60, 200]))]
        texts += [" ".join(base), *[_edited(r, base, r.randint(1, max(1, len(base) // 30))) for _ in range(3)]]
    base = [f"v{i}" for i in range(120)]
    texts += [_edited(r, base, r.randint(1, 6)) for _ in range(120)]  # one large group
    line = " ".join(f"common{i}" for i in range(20))
    texts += [line + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(r.choice([3, 8, 40]))) for _ in range(60)]
    ids = r.sample(range(10**6), len(texts))
    ids[5] = None
    return [(i, t, "s") for i, t in zip(ids, texts)]


def test_stage_against_all_pairs(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("source", "_row").repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(str(x.doc_id) for x in got.collect()) == _kept(rows)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_order_decides_no_link(spark, rows, monkeypatch):
    monkeypatch.setattr(near_copies, "COMMON", 0)
    monkeypatch.setattr(near_copies, "NEXT", 1)
    monkeypatch.setattr(near_copies, "FEW", 0)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert sorted(str(x.doc_id) for x in near_copies.drop_near_copies(docs).collect()) == _kept(rows)


def test_one_row_of_each_component_where_ids_repeat(spark):
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(7, text, "a"), (7, text + " end", "b"), (7, "another", "c"), (None, text, "d")], DOCS)
    got = near_copies.drop_near_copies(docs).collect()
    assert sorted(x.doc_id for x in got) == [7, 7] and {x.text for x in got} & {text, text + " end"} and "another" in {x.text for x in got}
