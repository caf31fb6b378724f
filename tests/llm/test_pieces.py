"""N-best segmentation against every segmentation, long runs, and the public vocabulary."""

import hashlib
import random
import time

import numpy as np
import pytest

from strandworks.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(pieces.default_model())


def _every(v, t):
    """(score, ids) of every segmentation of t into pieces, unknown characters as their bytes."""
    if not t:
        return [(0.0, ())]
    heads = [(v.scores[t[:k]], (v.ids[t[:k]],), k) for k in range(1, len(t) + 1) if t[:k] in v.scores]
    if t[0] not in v.scores:
        heads.append((v.unknown, tuple(v.bytes_[b] for b in t[0].encode()), 1))
    return [(s + rest, i + ids) for s, i, k in heads for rest, ids in _every(v, t[k:])]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_nbest_of_real_words(vocabulary, n):
    own = pieces.Segmenter(vocabulary, n)
    for t in ("the qu", "thhaaor", "Würde d", "ñga 漢.", "aaaaaaa", "x,y"):
        every = sorted((s for s, _ in _every(vocabulary, pieces.SPACE + t.replace(" ", pieces.SPACE))), reverse=True)[:n]
        got = own.nbest(t)
        assert np.allclose([s for s, _ in got], every)
        assert len({tuple(i) for _, i in got}) == len(got) and all(own.decode(i) == t for _, i in got)


def test_ties_and_memory_decide_nothing(vocabulary, monkeypatch):
    r = random.Random(1)
    words = ["".join(r.choices("abth eé,", k=r.randint(1, 40))) for _ in range(300)]
    want = [pieces.Segmenter(vocabulary, 2).nbest(w) for w in words]
    for remembered, long, together in ((3, 256, 10), (3, 2, 1 << 18), (1000, 8, 1)):
        monkeypatch.setattr(pieces, "REMEMBERED", remembered)
        monkeypatch.setattr(pieces, "LONG", long)
        monkeypatch.setattr(pieces, "TOGETHER", together)
        own = pieces.Segmenter(vocabulary, 2)
        got = [own.nbest(w) for w in words]
        assert [x[0][1] for x in got] == [x[0][1] for x in want]  # equal second choices may differ
        assert all(np.allclose([s for s, _ in x], [s for s, _ in y]) for x, y in zip(got, want))
        out = own.encode_all(words)
        assert [out.ids[a:b].tolist() for a, b in zip(out.starts, out.starts[1:])] == [x[0][1] for x in want]
        assert all(own.read_back(out, words)) and own.read_back(out, ["no", *words[1:]]) == [False] + [True] * (len(words) - 1)


def test_ranks_become_log_probabilities(vocabulary):
    assert abs(sum(np.exp(s) for p, s in vocabulary.scores.items() if set(p) != {pieces.SPACE} or len(p) == 1) - 1) < 1e-3
    assert pieces.by_rank({0: -1.5, 1: -2.0}) == {0: -1.5, 1: -2.0}
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    own = pieces.Segmenter(vocabulary, 2)
    text = "The committee will consider the proposal in detail before the end of the year, and publish its findings."
    assert len(own.encode(text)[0]) <= 1.1 * len(model.encode(text))


@pytest.mark.parametrize("unit", ["a", "QWxhZGRpbjpvcGVuIHNlc2FtZQ", "漢字仮名交じり文", "- "])
def test_very_long_units(vocabulary, unit):
    text = unit * ((1_000_000 if unit == "a" else 200_000) // len(unit.encode()))
    began = time.process_time()
    own = pieces.Segmenter(vocabulary, 2)
    ids, score, others = own.encode(text)
    assert own.decode(ids) == text and len(others) <= 1
    assert time.process_time() - began < 60


def test_digest_and_clashing_columns(spark):
    rows = [(1, "one two", 5.0, "x"), (1, "one two", 5.0, "x"), (2, None, None, None), (3, "", 0.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, ids string")
    own = pieces.segmenter(pieces.default_model())
    best = own.nbest("one two")
    sha = hashlib.sha256(",".join(map(str, best[0][1])).encode()).hexdigest()
    want = (len(best[0][1]), round(best[0][0], 3), round(best[0][0] - best[1][0], 3), sha, True)
    got = sorted(tuple(r) for r in pieces.piece_digest(docs).collect())
    none = (0, 0.0, None, hashlib.sha256(b"").hexdigest(), True)
    for r, w in zip(got, [want, want, none, none]):
        assert r[1] == w[0] and abs(r[2] - w[1]) < 2e-3 and (r[3] is None) == (w[2] is None) and r[4:] == w[3:]
    out = pieces.encoded(docs)
    assert out.columns == ["doc_id", "ids", "score", "others", "decoded"]
    assert sorted(r.text for r in pieces.decoded(out.select("doc_id", "ids")).collect()) == ["", "", "one two", "one two"]
    assert pieces.encoded(docs.limit(0)).count() == 0
