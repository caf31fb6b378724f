"""The corpus pipeline: its stages on odd rows, and what they keep of a small corpus."""

import random

import pytest

import corpus_pipeline
from strandworks.llm import common

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipe")
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    good, bad = [word() for _ in range(400)], [word() + "xx" for _ in range(30)]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        text = " ".join(r.choice(bad) if toxic and r.random() < 0.4 else r.choice(good) for _ in range(80))
        rows.append((i, text, "en", r.choice("ab"), len(text)))
        labels.append((i, 1 if toxic else 0))
    base = rows[1][1]
    rows += [(300, base, "en", "a", 1), (301, base + "  end", "en", "b", 1), (302, None, None, None, None), (303, "", "en", "a", 0), (304, " \n", "en", "a", 2), (304, " \n", "en", "a", 2), (None, "a text without an id", None, "c", 9)]
    spark.createDataFrame([(*x, 0.5, "x") for x in rows], COLUMNS).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run(spark, folder):
    docs = common.table(spark, folder, "documents")
    kept = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.cut(stage(spark, kept, folder))
        assert kept.columns == docs.columns, name
        counts.append(kept.count())
    assert 230 <= counts[1] <= 260  # sixty toxic ones of 307 rows
    by_id = {r.doc_id for r in common.cut(corpus_pipeline.exact_dedup(spark, docs, folder)).collect()}
    assert 300 not in by_id and {1, 302, 304, None} <= by_id
    near = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, folder).collect()}
    assert not near & {300, 301} and 1 in near
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and all(r.decoded for r in out) and len(out[0].ids) > 0


def test_stages_on_an_empty_table(spark, folder):
    docs = common.table(spark, folder, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
