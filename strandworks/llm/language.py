"""Language of texts and of spans in mixed texts: scripts, word scores, and a Viterbi pass with a switching penalty.

Training, on at most SAMPLE labelled texts (those with the least hashes of their ids; equal texts count once): counts
of the three-byte grams inside words (with the spaces around them), hashed to GRAMS cells, give every language the
log-probability of a cell against its share in all languages; and each language has the scripts that hold at least
SCRIPT_SHARE of its words. Labels and sizes are learnt as they are: nothing is known beforehand about a language.

Prediction, of every whole text: a word's scripts narrow its candidates to the languages with one of them (all, where
none has); a candidate's score is the sum over the word's grams; Viterbi finds the best labelling of all words when
each change of language costs PENALTY. The text's language is the one with the most bytes in its spans, and its score
their share.

Cases: a null text, or one without a letter, is `und` with score 0; of languages with equal bytes the first in code
point order is taken; texts in a script that was never learnt get the best of all languages; without labelled texts
all are `und` with score 0; rows that repeat an id each get their row, a null id is not held out; an empty table gives
no rows; further columns are left alone, but for those with the
name of a result column, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import binary_values, small_batches

SAMPLE = 20000
GRAMS = 1 << 16
PENALTY = 12.0
SMOOTHING = 0.5
SCRIPT_SHARE = 0.01
#: Bytes of text and cells of word scores that a task works on at once.
GROUP_BYTES, GROUP_CELLS = 16 << 20, 32 << 20
BLOCK = 1 << 20

_FOLD = bytes((i + 32 if 65 <= i <= 90 else i) if i > 127 or chr(i).isalpha() else 32 for i in range(256))
#: First bytes of the UTF-8 forms of scripts, from, to: Latin, Greek, Cyrillic, Armenian and Hebrew, Arabic, Indic and
#: South-East Asian, other three-byte blocks, kana, Han, Hangul, beyond. Fixed values of Unicode.
_RANGES = [(0x61, 0x7A), (0xC3, 0xCA), (0xCD, 0xCF), (0xD0, 0xD4), (0xD5, 0xD7), (0xD8, 0xDF), (0xE0, 0xE0), (0xE1, 0xE2), (0xE3, 0xE3), (0xE4, 0xE9), (0xEA, 0xED), (0xF0, 0xF4)]
_SCRIPT = np.zeros(256, np.uint16)
for _i, (_a, _b) in enumerate(_RANGES):
    _SCRIPT[_a : _b + 1] = 1 << max(0, _i - 1)  # the first two are Latin


class Model(NamedTuple):
    languages: list[str]
    scores: np.ndarray  # GRAMS x languages
    scripts: list[int]  # bits for each language


def words_in(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the words in folded bytes."""
    letter = np.concatenate([[False], data != 32, [False]])
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    return edge[::2], edge[1::2]


def grams(data: np.ndarray) -> np.ndarray:
    """Cell of the three bytes round each byte."""
    x = np.concatenate([[32], data, [32]]).astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    return (h ^ h >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(16)


def word_scores(data: np.ndarray, begin: np.ndarray, end: np.ndarray, model: Model) -> np.ndarray:
    """Score of each language for each word, those out of the question far below."""
    ends = np.stack([begin, end], 1).ravel()
    cells = grams(data)
    pad = np.append(cells, 0).astype(np.int64)
    script = np.bitwise_or.reduceat(np.append(_SCRIPT[data], np.uint16(0)), ends)[::2]
    masks, which = np.unique(script, return_inverse=True)
    far = np.zeros((len(masks), len(model.languages)), np.float32)
    for i, m in enumerate(masks.tolist()):
        fits = np.array([bool(m & s) for s in model.scripts])
        if fits.any():
            far[i, ~fits] = -1e4
    out = far[which]
    for k in range(len(model.languages)):
        out[:, k] += np.add.reduceat(model.scores[:, k][pad], ends)[::2]
    return out


def label_words(scores: np.ndarray, sizes: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best labelling of sequences that stand one after another, of sizes words each; all go forward at once."""
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    langs = scores.shape[1]
    came = np.zeros(scores.shape, np.int16)
    total = scores[start[size > 0]].astype(np.float64)
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(longest), "left")  # how many have a word number t
    final = np.zeros(len(size), np.int64)
    own = np.arange(langs, dtype=np.int16)
    for t in range(1, longest):
        n = alive[t]
        if n < len(total):
            final[n : len(total)] = total[n:].argmax(1)
            total = total[:n]
        best = total.argmax(1)
        switch = total[np.arange(n), best][:, None] - penalty
        moves = switch > total
        at = start[:n] + t
        came[at] = np.where(moves, best[:, None], own)
        total = np.where(moves, switch, total) + scores[at]
    if len(total):
        final[: len(total)] = total.argmax(1)
    labels = np.zeros(len(scores), np.int16)
    now = final.copy()
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        at = start[:n] + t
        labels[at] = now[:n]
        now[:n] = came[at, now[:n]] if t else now[:n]
    return labels


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t)
        if size >= BLOCK:
            yield own
            own, size = [], 0
    if own:
        yield own


def _scored_words(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores of all words, words of each text, and each word's begin and end in its text."""
    scores, counts, begins, ends = [], [], [], []
    for own in _blocks(texts):
        data = np.frombuffer(b" ".join(own).translate(_FOLD) + b" ", np.uint8)
        begin, end = words_in(data)
        base = np.cumsum([0, *[len(t) + 1 for t in own]])
        text = np.searchsorted(base, begin, "right") - 1
        if len(begin):
            scores.append(word_scores(data, begin, end, model))
        counts.append(np.bincount(text, minlength=len(own)))
        begins.append(begin - base[text])
        ends.append(end - base[text])
    join = lambda x, empty: np.concatenate(x) if x else empty
    return join(scores, np.zeros((0, len(model.languages)), np.float32)), join(counts, np.zeros(0, np.int64)), join(begins, np.zeros(0, np.int64)), join(ends, np.zeros(0, np.int64))


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, counts of gram cells, words with each script bit, words: packed by language."""
    held: dict[str, list] = {}
    for batch in it:
        for t, lang in zip(binary_values(batch.column(0)), batch.column(1).to_pylist()):
            data = np.frombuffer(t.translate(_FOLD), np.uint8)
            begin, end = words_in(data)
            if not len(begin):
                continue
            own = held.setdefault(lang, [np.zeros(GRAMS, np.int64), np.zeros(16, np.int64), 0])
            own[0] += np.bincount(grams(data)[data != 32].astype(np.int64), minlength=GRAMS)
            script = np.bitwise_or.reduceat(np.append(_SCRIPT[data], np.uint16(0)), np.stack([begin, end], 1).ravel())[::2]
            own[1] += [int((script >> np.uint16(i) & np.uint16(1)).sum()) for i in range(16)]
            own[2] += len(begin)
    for lang, (counts, scripts, n) in held.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 17)), pa.array(np.concatenate([at, np.arange(GRAMS, GRAMS + 17)])), pa.array(np.concatenate([counts[at], scripts, [n]]))], names=["lang", "cell", "n"])


def train(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the documents that have a language; usable: a condition on them. It is GRAMS numbers a language."""
    small_batches(docs.sparkSession)
    own = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (usable if usable is not None else F.lit(True)))
    # ids first, so that no text is put in order; broadcast: SAMPLE ids at most
    picked = own.select(F.col(id_col).alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).distinct()
    sample = own.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang")).join(F.broadcast(picked), "_id").select("t", "lang", F.xxhash64("t").alias("h"))
    texts = sample.dropDuplicates(["h", "lang"]).select(F.encode("t", "UTF-8").alias("t"), "lang")
    rows = texts.mapInArrow(_counted, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique().tolist())
    counts = np.zeros((GRAMS + 17, len(languages)))
    for k, lang in enumerate(languages):
        own_rows = rows[rows["lang"] == lang]
        counts[own_rows["cell"].to_numpy(), k] = own_rows["n"].to_numpy()
    cells = counts[:GRAMS]
    p = (cells + SMOOTHING) / (cells.sum(0) + SMOOTHING * GRAMS) if languages else cells
    scores = np.log(p / p.mean(1, keepdims=True)).astype(np.float32) if languages else cells.astype(np.float32)
    scripts = [sum(1 << i for i in range(16) if counts[GRAMS + i, k] >= SCRIPT_SHARE * counts[GRAMS + 16, k] > 0) for k in range(len(languages))]
    return Model(languages, scores, scripts)


_OUT = "lang_pred string, score double, spans array<struct<begin:int,end:int,lang:string>>"


def _identified(shared, names: list[str]):
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def group(batches: list[pa.RecordBatch], texts: list[bytes], model: Model) -> Iterator[pa.RecordBatch]:
        scores, counts, begin, end = _scored_words(texts, model)
        labels = label_words(scores, counts) if len(model.languages) else np.zeros(0, np.int16)
        preds, shares, spans, at = [], [], [], 0
        for n in counts.tolist():
            own, b, e = labels[at : at + n], begin[at : at + n], end[at : at + n]
            at += n
            if not n or not model.languages:
                preds.append(None)
                shares.append(0.0)
                spans.append([])
                continue
            weight = np.bincount(own, e - b, len(model.languages))
            k = int(weight.argmax())
            preds.append(model.languages[k])
            shares.append(float(weight[k] / weight.sum()))
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            last = np.append(first[1:], n) - 1
            spans.append([{"begin": int(b[i]), "end": int(e[j]), "lang": model.languages[own[i]]} for i, j in zip(first, last)])
        at = 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(preds[at : at + n], pa.string()), pa.array(shares[at : at + n], pa.float64()), pa.array(spans[at : at + n], kind)], names=names)
            at += n

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        most = min(GROUP_BYTES, GROUP_CELLS // max(1, len(model.languages)))
        batches, texts, size = [], [], 0
        for batch in it:
            own = binary_values(batch.column(0))
            batches.append(batch)
            texts += own
            size += sum(map(len, own))
            if size >= most:
                yield from group(batches, texts, model)
                batches, texts, size = [], [], 0
        if batches:
            yield from group(batches, texts, model)

    return run


def identified(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all but the text, if not given), lang_pred, score, and spans in bytes of the text."""
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text_col, "lang_pred", "score", "spans")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["_letters", *keep, "lang_pred", "score", "spans"]
    schema = StructType([StructField("_letters", BooleanType()), *[docs.schema[c] for c in keep], *StructType.fromDDL(_OUT)])
    text = F.coalesce(text_col, F.lit(""))
    out = docs.select(F.encode(text, "UTF-8").alias("_bytes"), text.rlike(r"\p{L}").alias("_letters"), *[docs[c] for c in keep]).mapInArrow(_identified(shared, names), schema)
    known = F.col("_letters") & F.col("lang_pred").isNotNull()
    return out.select(*keep, F.when(known, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(known, F.col("score")).otherwise(0.0).alias("score"), "spans")


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score. Rows held out are not learnt from."""
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    model = train(docs, rest != 2, id_col, text_col, lang_col)
    return identified(docs, model, text_col, [id_col]).select(id_col, F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
