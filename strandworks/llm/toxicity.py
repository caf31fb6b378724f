"""Toxic passages by maximum-scoring segments.

Training, on at most SAMPLE labelled texts (those with the least hashes of their ids; equal texts count once): how many
toxic and clean texts hold each word gives its log-odds under an informative Dirichlet prior, which is PRIOR of all
counts, shared out by frequency to both kinds. They are drawn towards zero by Z of their posterior standard deviations,
so that chance says nothing. Words whose log-odds that leaves at zero, and words that training never saw, take those of
their longest beginning that has some; a beginning's counts are those of the words that have none of their own. What
has none even so scores what that is worth, a little below zero. The model grows with the words of the sample, not with
the corpus.

Scoring, of every whole text: the linear-time search for all maximal scoring segments over the words' log-odds. As the
scores are log-likelihood ratios with a negative mean on clean text, segment scores follow an extreme-value law: a
segment of score x has K * words * exp(-LAMBDA * x) equals by chance, LAMBDA solving sum(p * exp(LAMBDA * s)) = 1 and
K counted on the clean texts of the sample. A text's evidence is that of its best segment and the sum over its
significant ones; a logistic curve through the sample's labels makes it a score from 0 to 1. For LAMBDA, K and the curve
a text of the sample is scored by the others alone: its words' shares leave it out.

Cases: a null text is an empty one, which gets the score of a text without evidence; a null id is not held out and has
no label; rows that repeat an id each get their row, and repeated labels of one document are all learnt from; without
labels of both kinds every score is 0.5 or the rate of the one kind kept inside 0.01 to 0.99; an empty table gives no
rows; further columns are left alone, but for those with the name of a result column, which `scored` replaces and
drop_toxic keeps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import binary_values, parts, small_batches

SAMPLE = 20000
PRIOR, Z = 0.1, 2.5
#: Lengths in bytes of word beginnings.
BEGINNINGS = (4, 5, 6)
#: A segment is significant if chance makes fewer than this many of its score in a text.
SIGNIFICANT = 0.05
THRESHOLD = 0.7
_REMEMBERED = 200_000

_FOLD = bytes((i + 32 if 65 <= i <= 90 else i) if i > 127 or chr(i).isalnum() else 32 for i in range(256))


class Segment(NamedTuple):
    begin: int
    end: int
    score: float


class Model(NamedTuple):
    features: dict[bytes, float]
    other: float
    lam: float
    k: float
    curve: tuple[float, ...]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def segments(places: list[int], scores: list[float], other: float) -> list[Segment]:
    """All maximal scoring segments of a sequence that scores `other` < 0 but at the given places (Ruzzo and Tompa).

    Linear in the places: a candidate links to the nearest one before it whose sum before it is lower, so that those
    between are never looked at again.
    """
    out: list[tuple[int, int, float, float, int]] = []  # begin, end, sum before it, sum up to its end, link
    total, done = 0.0, 0
    for at, s in zip(places, scores):
        low = total + (at - done) * other
        total, done = low + s, at + 1
        if s <= 0:
            continue
        begin, j = at, len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= low:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                out.append((begin, at + 1, low, total, j))
                break
            begin, _, low, _, link = out[j]
            del out[j:]
            j = link
    return [Segment(b, e, high - low) for b, e, low, high, _ in out]


class Scorer:
    """Scores of words, remembered for up to _REMEMBERED of them."""

    def __init__(self, features: dict[bytes, float]):
        self.features, self.known = features, {}

    def _score(self, word: bytes) -> float:
        get = self.features.get
        s = get(word)
        if s is None:
            for n in sorted(BEGINNINGS, reverse=True):
                if len(word) > n and (s := get(word[:n] + b"*")) is not None:
                    break
        if len(self.known) >= _REMEMBERED:
            self.known.clear()
        self.known[word] = s = s or 0.0
        return s

    def hits(self, text: bytes) -> tuple[int, list[int], list[float]]:
        """Number of words, and places and scores of the model's."""
        words = words_of(text)
        found = list(map(self.known.get, words))
        if None in found:
            found = [self._score(w) if s is None else s for w, s in zip(words, found)]
        places = np.flatnonzero(np.array(found)).tolist() if found else []
        return len(words), places, [found[i] for i in places]


def evidence(n: int, found: list[Segment], lam: float, k: float) -> tuple[float, float]:
    """-ln of how many segments as good as the best chance makes in n words, and that summed over significant ones."""
    each = [lam * s.score - math.log(max(k * n, 1e-12)) for s in found]
    return max([0.0, *each]), sum(e for e in each if e > -math.log(SIGNIFICANT))


def _raise(curve: tuple[float, ...], best: float, total: float) -> float:
    x = curve[0] + curve[1] * math.log1p(best) + curve[2] * math.log1p(total)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, toxic texts, clean texts: each word once for each text."""
    for batch in it:
        counts: dict[bytes, list[int]] = {}
        for t, toxic in zip(binary_values(batch.column(0)), batch.column(1).to_pylist()):
            for w in set(words_of(t)):
                counts.setdefault(w, [0, 0])[0 if toxic == 1 else 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), *[pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1)]], names=["word", "toxic", "clean"])


def log_odds(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    """Log-odds of a word under the prior, drawn towards zero by Z standard deviations."""
    prior, whole = (toxic + clean) * PRIOR, (all_toxic + all_clean) * PRIOR
    t, c = toxic + prior, clean + prior
    if not t:
        return 0.0
    odds = math.log(t / (all_toxic + whole - t)) - math.log(c / (all_clean + whole - c))
    return math.copysign(max(0.0, abs(odds) - Z * math.sqrt(1 / t + 1 / c)), odds)


def _entries(all_toxic: float, all_clean: float):
    """word, toxic, clean, sorted by their shortest beginning, to the words and beginnings that have log-odds: those, and
    those without one of their toxic or one of their clean texts."""

    def entry(part: bytes, t: int, c: int) -> tuple[bytes, float, float, float]:
        own = log_odds(t, c, all_toxic, all_clean)
        return part, own, log_odds(t - 1, c, all_toxic - 1, all_clean) if t else own, log_odds(t, c - 1, all_toxic, all_clean - 1) if c else own

    def kept(words: list[tuple[bytes, int, int]]) -> list[tuple[bytes, float, float, float]]:
        out = []
        for n in (None, *sorted(BEGINNINGS, reverse=True)):
            counts: dict[bytes, list[int]] = {}
            for w, t, c in words:
                part = w if n is None else w[:n] + b"*" if len(w) > n else b""
                own = counts.setdefault(part, [0, 0])
                own[0] += t
                own[1] += c
            counts.pop(b"", None)
            found = {part for part, (t, c) in counts.items() if log_odds(t, c, all_toxic, all_clean)}
            out += [entry(part, *counts[part]) for part in sorted(found)]
            words = [x for x in words if (x[0] if n is None else x[0][:n] + b"*") not in found]
        return out

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in it for r in zip(*[c.to_pylist() for c in batch.columns]))
        for _, own in groupby(rows, lambda r: r[0][: BEGINNINGS[0]]):
            found = kept(list(own))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.binary(), *[pa.float64()] * 3))], names=["part", "odds", "less_toxic", "less_clean"])

    return run


def _hits(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # without the text itself: by the log-odds of clean texts less one, or toxic ones less one
        scorers = [Scorer({k: v[i] for k, v in shared.value.items()}) for i in (2, 1)]
        for batch in it:
            own = [scorers[toxic].hits(t) for t, toxic in zip(binary_values(batch.column(0)), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in own], pa.int64()), pa.array([o[1] for o in own], pa.list_(pa.int64())), pa.array([o[2] for o in own], pa.list_(pa.float64())), batch.column(1)], names=["n", "places", "scores", "toxic"])

    return run


def _solve(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum(p * exp(x * s)) = 1."""
    low, high = 1e-3, 1.0
    while (p * np.exp(np.minimum(high * s, 600))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 600))).sum() < 1 else (low, mid)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a slightly damped logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, damp = np.zeros(x.shape[1]), np.diag([1e-6] + [1e-4] * (x.shape[1] - 1)) * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + damp, x.T @ (y - p) - damp @ w)
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled documents; usable: a condition on the labels' ids."""
    spark = docs.sparkSession
    small_batches(spark)
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (usable if usable is not None else F.lit(True)))
    picked = own.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    # broadcast: SAMPLE rows at most
    sample = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(picked), "_id").select("text", "toxic", F.xxhash64("text").alias("h")).dropDuplicates(["h", "toxic"]).select(F.encode("text", "UTF-8").alias("text"), "toxic").persist()
    sizes = dict(sample.groupBy("toxic").count().collect())
    clean_n, toxic_n = sizes.get(0, 0), sizes.get(1, 0)
    if not clean_n or not toxic_n:
        rate = 0.5 if not clean_n + toxic_n else min(0.99, max(0.01, toxic_n / (clean_n + toxic_n)))
        sample.unpersist()
        return Model({}, -0.01, 1.0, 1.0, (math.log(rate / (1 - rate)), 0.0, 0.0))
    words = sample.mapInArrow(_counted, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).persist()
    totals = words.agg(F.sum("toxic"), F.sum("clean")).first()
    first = F.substring("word", 1, BEGINNINGS[0])
    entries = words.repartition(parts(spark), first).sortWithinPartitions(first, "word").mapInArrow(_entries(float(totals[0] or 0), float(totals[1] or 0)), "part binary, odds double, less_toxic double, less_clean double")
    table = {bytes(r.part): (r.odds, r.less_toxic, r.less_clean) for r in entries.collect()}  # words of SAMPLE texts that say something
    model = {k: v[0] for k, v in table.items()}
    rows = sample.mapInArrow(_hits(spark.sparkContext.broadcast(table)), "n long, places array<long>, scores array<double>, toxic int").collect()  # numbers of SAMPLE texts
    words.unpersist()
    sample.unpersist()
    n = {k: sum(r.n for r in rows if r.toxic == k) for k in (0, 1)}
    hit = {k: sum(len(r.places) for r in rows if r.toxic == k) for k in (0, 1)}
    rate = {k: (hit[k] + 0.5) / (n[k] + 1) for k in (0, 1)}
    other = min(-1e-3, math.log((1 - rate[1]) / (1 - rate[0])))
    clean_scores = np.array([s for r in rows if r.toxic == 0 for s in r.scores] or [1.0])
    if (clean_scores > 0).sum() == 0:
        clean_scores = np.append(clean_scores, 1.0)
    p = np.append(np.full(len(clean_scores), rate[0] / len(clean_scores)), 1 - rate[0])
    lam = _solve(p, np.append(clean_scores, other))
    found = [(r.n, segments(r.places, r.scores, other), r.toxic) for r in rows]
    by_chance = sorted(s.score for _, segs, toxic in found for s in segs if not toxic)
    middle = by_chance[len(by_chance) // 2] if by_chance else 1.0
    k = (sum(s >= middle for s in by_chance) + 0.5) / (n[0] + 1) * math.exp(min(lam * middle, 600))
    x = np.array([[math.log1p(e) for e in evidence(m, segs, lam, k)] for m, segs, _ in found])
    return Model(model, other, lam, k, _logistic(x, np.array([t for _, _, t in found], float)))


_SCORED = "score double, passages array<struct<begin:int,end:int,score:double,expected:double>>"


def _judged(shared, names: list[str]):
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        scorer = Scorer(model.features)
        for batch in it:
            scores, passages = [], []
            for t in binary_values(batch.column(0)):
                n, places, values = scorer.hits(t)
                found = segments(places, values, model.other)
                scores.append(_raise(model.curve, *evidence(n, found, model.lam, model.k)))
                chance = [(s, model.k * n * math.exp(-min(600.0, model.lam * s.score))) for s in found]
                passages.append([{"begin": s.begin, "end": s.end, "score": s.score, "expected": e} for s, e in chance if e < SIGNIFICANT])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64()), pa.array(passages, kind)], names=names)

    return run


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all but the text, if not given), score, and the significant passages by word numbers."""
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text_col, "score", "passages")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of SAMPLE texts that say something
    schema = StructType([*[docs.schema[c] for c in keep], *StructType.fromDDL(_SCORED)])
    cols = [F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("_bytes"), *[docs[c] for c in keep]]
    return docs.select(*cols).mapInArrow(_judged(shared, [*keep, "score", "passages"]), schema)


def _remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted. Rows held out are not learnt from."""
    model = train(docs, labels, _remainder(id_col) != 1, id_col, text_col)
    return scored(docs, model, text_col, [id_col]).select(
        id_col, F.coalesce(_remainder(id_col) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are predicted toxic; all its columns."""
    model = train(docs, labels, _remainder(id_col) != 1, id_col, text_col)
    whole = docs.select(F.col(text_col).alias("_text"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    return scored(whole, model, "_text").where(F.col("score") < THRESHOLD).select("_row.*")
