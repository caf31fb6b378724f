"""The query's segmentations beyond the second, against every segmentation."""

from strandworks.llm import pieces, queries


def _every(v, t):
    """Scores of every segmentation of t into pieces."""
    if not t:
        return [0.0]
    heads = [(v.scores[t[:k]], k) for k in range(1, len(t) + 1) if t[:k] in v.scores]
    return [s + rest for s, k in heads for rest in _every(v, t[k:])]


def test_query_searches_several_units(spark, tmp_path):
    rows = [(1, "the qu on a"), (2, None), (3, " ".join(["the committee will consider the proposal"] * 5))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op4_sentencepiece(spark, str(tmp_path)).collect()}
    vocabulary = pieces.Vocabulary.load(pieces.default_model())
    best = sorted(_every(vocabulary, "▁the▁qu▁on▁a"), reverse=True)
    assert got[1].n_best == pieces.NBEST >= 8 and abs(got[1].last_margin - (best[0] - best[pieces.NBEST - 1])) < 2e-3
    assert abs(got[1].margin - (best[0] - best[1])) < 2e-3
    assert got[2].n_best == 1 and got[2].last_margin is None and got[3].n_best == pieces.NBEST
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    others = {r.doc_id: r.others for r in pieces.encoded(docs).collect()}
    assert len({c.begin for o in others[3] for c in o.changes}) >= 3
