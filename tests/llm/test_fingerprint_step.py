"""The fingerprint step of near dedup: what it ties, and that all links are found where nothing is broadcast."""

import random

import corpus_pipeline
from strandworks.llm import common, near_copies


def test_fingerprints_tie_close_copies_and_nothing_is_lost(spark, monkeypatch):
    r = random.Random(9)
    base = [[f"w{r.randrange(10**6)}" for _ in range(400)] for _ in range(4)]
    texts = [" ".join([*b[:k], *(["new"] if k else []), *b[k + 1 :]]) for b in base for k in range(0, 400, 40)] + [f"other {i} text of a few words" for i in range(9)]
    hashes = [near_copies._hashes(t.encode(), 5) for t in texts]
    fps = [near_copies._fingerprint(h) for h in hashes]
    bits = [[sum(int(x) >> b & 1 for x in h) * 2 > len(h) for b in range(64)] for h in hashes]
    assert fps == [sum(on << b for b, on in enumerate(own)) for own in bits]
    sets = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")

    def roots(pairs):
        root = list(range(len(texts)))
        for a, b in pairs:
            root = [root[a] if x == root[b] else x for x in root]
        return {tuple(i for i, x in enumerate(root) if x == y) for y in root}

    close = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert close and roots(close) == roots([(x.a, x.b) for x in near_copies._fingerprinted(sets).collect()])
    monkeypatch.setattr(common, "FEW", 0)
    monkeypatch.setattr(near_copies, "FEW", 0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {0, 10, 20, 30, *range(40, 49)}
