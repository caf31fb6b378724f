"""Labels of words against all labellings, and cases of repeated and long texts."""

import itertools

import numpy as np
import pytest

from strandworks.llm import language


def _best(scores, penalty):
    """Total of a best labelling by trying all of them."""
    n, langs = scores.shape
    return max(sum(scores[i, k] for i, k in enumerate(own)) - penalty * sum(a != b for a, b in zip(own, own[1:])) for own in itertools.product(range(langs), repeat=n))


@pytest.mark.parametrize("seed", range(6))
def test_labels_against_all_labellings(seed):
    r = np.random.default_rng(seed)
    sizes = np.array([0, 5, 1, 7, 0, 3, 7])
    scores = (r.normal(size=(int(sizes.sum()), 3)) * 4).astype(np.float32)
    for penalty in (0.0, 2.0, 50.0):
        labels = language.label_words(scores, sizes, penalty)
        at = 0
        for n in sizes.tolist():
            own, marks = scores[at : at + n], labels[at : at + n]
            at += n
            if n:
                total = sum(float(own[i, k]) for i, k in enumerate(marks)) - penalty * int((marks[1:] != marks[:-1]).sum())
                assert total == pytest.approx(_best(own, penalty), abs=1e-4)


def test_repeated_and_long_texts(spark):
    text = {"en": "the cat sat on the mat and looked at the door ", "de": "der Hund lief durch den Wald und bellte laut "}
    rows = [(i, text[k] * (1 + i % 3), k) for i in range(60) for k in [("en", "de")[i % 2]]]
    rows += [(100, text["de"] * 30_000, None), (101, text["en"], None), (101, text["en"], None), (102, None, "en"), (103, "123 456", None), (103, "", "de")]
    got = language.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    own = sorted((x.doc_id, x.lang_pred) for x in got if x.doc_id >= 100)
    assert own == [(100, "de"), (101, "en"), (101, "en"), (102, "und"), (103, "und"), (103, "und")] and len(got) == len(rows)
    assert len({x.score for x in got if x.doc_id == 101}) == 1
