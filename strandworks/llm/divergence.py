"""How sources of a language differ in their words: exact divergences of sources, and the terms that mark each source.

A term is a run of letters A-Z (lower-cased) and of bytes from 0x80 on. A language keeps the terms that at least MIN_DOCS
of its documents have, V in number. A group (lang, source), and a language, gives a kept term that it has c times
p = 1 + floor(10^9 (c + 1) / (N + V)), N being its occurrences of kept terms. p against q diverges by
f = floor((p - q)^2 / q).

* Pairs of sources sum f over all kept terms, also those that both lack. Terms that only one side has depend on their
  count there and on the other side's p of an absent term, so counts are summed up by value; only terms that both have
  are looked at one by one. Nothing dense is made.
* Terms of a group are ranked by f against the whole language. f rises with the group's count and falls with the
  language's, and ties go to the earlier term in UTF-8, so a term that k others dominate in all three is not among the
  first k. Each partition keeps its k-skyband, the terms that fewer than k others there dominate; skybands are merged
  in rounds, FAN at a time, and only what is left is ranked by f.

Cases: null lang, source and text are empty strings; a group without terms is there, with all counts zero; a language
that keeps no term gives its pairs 0 and no terms; repeated rows and ids count as documents of their own; an empty table
gives no rows; further columns are left alone. Counts are exact up to 9 * 10^15.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_values, cut, parts, small_batches, utf8

#: Documents of a language that have a term it keeps.
MIN_DOCS = 3
#: Ranks of terms that are returned for each group.
TOP = 200
#: Skybands that one task merges.
FAN = 16
#: Distinct terms that a task holds before it hands them on, and bytes of a text that are split at a time.
HELD, PIECE = 600_000, 1 << 20
#: Rows of a group that wait until its skyband is found anew, and rows held against the skyband at a time.
WAIT, BLOCK = 8192, 512

_SPLIT = bytes((b | 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SEEN = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_BAND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("lang_n", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The text's terms in order, some at a time."""
    text = text.translate(_SPLIT)
    at = 0
    while at < len(text):
        end = len(text)
        if at + PIECE < end:
            end = text.find(b" ", at + PIECE)
            end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs), summed over the documents that a task has seen since it last handed rows on."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            if n:
                term = pa.array(list(n), pa.binary()).cast(pa.string())
                columns = {"term": term, "n": list(n.values()), "docs": [docs[t] for t in n]}
                for i in range(0, len(term), 8192):
                    size = len(term[i : i + 8192])
                    own = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), *[pa.array(columns[c][i : i + 8192], _SEEN.field(c).type) if c != "term" else term[i : i + 8192] for c in columns]]
                    yield pa.RecordBatch.from_arrays(own, schema=_SEEN)
        held.clear()

    for batch in it:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_values(batch.column(2))):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for piece in terms(text):
                n.update(piece)
                own.update(piece)
            docs.update(own)
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from out()
    yield from out()


def skyband(n: np.ndarray, lang_n: np.ndarray, term: pa.Array, k: int) -> np.ndarray:
    """Places of the rows that fewer than k others dominate: n no less, lang_n no more, term earlier. Terms are distinct."""
    rank = np.empty(len(term), np.int64)
    rank[pc.sort_indices(term.cast(pa.binary())).to_numpy()] = np.arange(len(term))
    order = np.lexsort((rank, lang_n, -n))  # whatever dominates a row comes before it
    if not len(order):
        return order
    # of rows with the same counts, each dominates all later ones
    first = np.flatnonzero(np.concatenate([[True], (n[order][1:] != n[order][:-1]) | (lang_n[order][1:] != lang_n[order][:-1])]))
    order = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < k]
    held, low, early = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, len(order), BLOCK):
        own = order[i : i + BLOCK]
        a, r = lang_n[own], rank[own]
        above = ((low[None, :] <= a[:, None]) & (early[None, :] < r[:, None])).sum(axis=1)
        # in the block all count, and before it the skyband: k dominators of a row are always in the skyband if it has k
        beside = np.tril((a[None, :] <= a[:, None]) & (r[None, :] < r[:, None]), -1).sum(axis=1)
        good = own[above + beside < k]
        held.append(good)
        low, early = np.concatenate([low, lang_n[good]]), np.concatenate([early, rank[good]])
    return np.concatenate(held)


def _gathered(it: Iterator[pa.RecordBatch], rows: int = 65536) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches."""
    held, n = [], 0
    for batch in it:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _bands(k: int):
    """The skyband of each group among the rows of a task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[list[pa.RecordBatch], int, int]] = {}  # rows, how many, and how many of those are a skyband

        def pruned(own: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.concat_batches(own)
            return whole.take(pa.array(skyband(whole.column("n").to_numpy(), whole.column("lang_n").to_numpy(), whole.column("term"), k)))

        for batch in _gathered(it):
            lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
            code = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1], [True]]))
            rows = batch.select(["term", "n", "lang_n"]).take(pa.array(order))
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                at = divmod(int(code[order[s]]), len(source.dictionary))
                key = (lang.dictionary[at[0]].as_py(), source.dictionary[at[1]].as_py())
                own, size, band = held.get(key, ([], 0, 0))
                own.append(rows.slice(s, e - s))
                size += e - s
                if size >= WAIT + 2 * band:
                    own = [pruned(own)]
                    size = band = own[0].num_rows
                held[key] = (own, size, band)
        for (lang, source), (own, _, _) in held.items():
            rows = pruned(own)
            for i in range(0, rows.num_rows, 8192):
                some = rows.slice(i, 8192)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * some.num_rows, pa.string()), pa.array([source] * some.num_rows, pa.string()), *some.columns], schema=_BAND)

    return run


def _share(n: str | int, total: str, terms: str) -> Column:
    """p of a term that occurs n times, in whole numbers: three decimals at a time, so that nothing overflows."""
    whole, one = f"greatest({total} + {terms}, 1L)", f"1000L * ({n} + 1L)"
    two = f"1000L * (({one}) % {whole})"
    three = f"1000L * (({two}) % {whole})"
    return F.expr(f"1L + 1000000L * (({one}) div {whole}) + 1000L * (({two}) div {whole}) + ({three}) div {whole}")


def _apart(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def kept_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, term, lang_n, groups): each language's kept terms, and an array of (source, n) of the sources that have them."""
    own = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("")), F.coalesce(docs[source_col].cast("string"), F.lit("")), utf8(text_col))
    seen = own.mapInArrow(_count, _ddl(_SEEN)).repartition(parts(docs.sparkSession), "lang", "term")
    # one exchange serves both: rows of a term are together, whatever their source
    each = seen.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = each.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("groups"))
    return terms.where(F.col("docs") >= MIN_DOCS).select("lang", "term", "lang_n", "groups")


def group_totals(kept: DataFrame, docs: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, total, own, terms, lang_total): for each group its N and number of kept terms, V, and the language's N."""
    groups = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("lang"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source")).distinct()
    by_group = kept.select("lang", F.explode("groups").alias("g")).groupBy("lang", F.col("g.source").alias("source")).agg(F.sum("g.n").alias("total"), F.count(F.lit(1)).alias("own"))
    by_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    return groups.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["total", "own", "terms", "lang_total"])


def source_pairs(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each source from each other source of its language."""
    base = totals.select("lang", "source", "own", "terms", "total", _share(0, "total", "terms").alias("zero"))
    other = base.select("lang", F.col("source").alias("item"), F.col("own").alias("_own"), F.col("zero").alias("_zero"))
    pairs = base.join(other, "lang").where("source <> item")
    absent = pairs.selectExpr("lang", "source", "item", f"(terms - own - _own) * {_apart('zero', '_zero')} AS value")
    each = kept.select("lang", "term", F.explode("groups").alias("g")).select("lang", "term", "g.*").join(base, ["lang", "source"])
    each = each.select("lang", "term", "source", "zero", _share("n", "total", "terms").alias("p"))
    # terms of one side, whether the other has them or not, by value of p
    valued = each.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times")).join(other, "lang").where("source <> item")
    forth = valued.selectExpr("lang", "source", "item", f"times * {_apart('p', '_zero')} AS value")
    back = valued.selectExpr("lang", "item AS source", "source AS item", f"times * {_apart('_zero', 'p')} AS value")
    # and what that got wrong for terms of both
    together = each.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("g")).where("size(g) > 1")
    met = together.select("lang", "g", F.explode("g").alias("a")).select("lang", "a", F.explode("g").alias("b")).where("a.source <> b.source")
    right = f"{_apart('a.p', 'b.p')} - {_apart('a.p', 'b.zero')} - {_apart('a.zero', 'b.p')} + {_apart('a.zero', 'b.zero')}"
    both = met.selectExpr("lang", "a.source AS source", "b.source AS item", f"{right} AS value").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return absent.unionByName(forth).unionByName(back).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def marking_terms(kept: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms of each group that diverge most upwards from its language."""
    n = parts(kept.sparkSession)
    band = kept.select("lang", "term", "lang_n", F.explode("groups").alias("g")).select("lang", "g.source", "term", "g.n", "lang_n").mapInArrow(_bands(top), _ddl(_BAND))
    merged = n
    while merged > 1:
        merged = -(-merged // FAN)
        band = band.repartition(n, "lang", "source", F.pmod(F.xxhash64("term"), F.lit(merged))).mapInArrow(_bands(top), _ddl(_BAND))
    valued = band.join(totals, ["lang", "source"]).select("lang", "source", "term", _share("n", "total", "terms").alias("p"), _share("lang_n", "lang_total", "terms").alias("q")).where("p > q")
    valued = valued.selectExpr("lang", "source", "term AS item", f"{_apart('p', 'q')} AS value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def divergences(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` for pairs of sources, part `term` for each group's first terms."""
    small_batches(docs.sparkSession)
    kept = cut(kept_terms(docs, lang_col, source_col, text_col))
    totals = cut(group_totals(kept, docs, lang_col, source_col))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_pairs(kept, totals).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    marks = marking_terms(kept, totals, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(marks).select("lang", "source", "part", "item", "value", "rank")
