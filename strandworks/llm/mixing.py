"""Mixing sources to target weights, in DataFrame operations only.

1. Targets: sources share a budget by weight; none gets more than REPEATS times what it has, and what is above goes to
   the others by weight.
2. Packing: a source's documents make one stream of words, cut into blocks of BLOCK words (the last may be shorter).
   A stream's order is by a hash of the document, then by its id, and its offsets are sums over ranges of that hash, one
   for about RANGE_WORDS words of the corpus, so that no source is put in order by one task.
3. Draws: every output shard of SHARD_BLOCKS blocks draws how many it takes from each source, a multinomial draw with
   the targets as weights. So that each source's blocks come to its target, what a source gets above it is cut from its
   last shards, and a last shard makes up for sources that are short: the draws, given the sum of each source, decide
   which shards have how many blocks of it.
4. Slots: a source's slots are numbered over the shards. Number k belongs to pass k div B over its B blocks, and the
   pass's own pseudorandom permutation of the block numbers (a swap-or-not shuffle, which needs no table and no sort)
   gives the block.
5. Slots and packed blocks are joined by source and block number. In a shard, blocks are in the order of a hash of
   their slots.

Cases: a null text has no words, and documents without words take part with size 0 and are not taken; a null source
is a source, the last one; rows that repeat a doc_id are documents of their own; an empty table gives no rows; further columns are left alone. Equal seeds give equal mixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, WORD, cut, parts

BLOCK = 32
SHARD_BLOCKS = 1 << 13
RANGE_WORDS = 1 << 19
ROUNDS = 12
REPEATS = 2
#: Weights of the sources in code point order, repeating, and the budget as a share of all words.
WEIGHTS, BUDGET = (3, 1, 2), 1.5


def _with_few(df: DataFrame, few: DataFrame, on: str | list[str], rows: int) -> DataFrame:
    """df joined to a frame of so many rows. The side that is broadcast is named: of rows before an explode Spark knows the size, not
    of those that come out, and would send them all through the driver."""
    return df.join(F.broadcast(few) if rows <= FEW else few.hint("merge"), on)


def _sources(sized: DataFrame, budget: float, repeats: float) -> DataFrame:
    """source, has_source, source_size, blocks, target, slots. One row for each source, so the windows are over few rows."""
    totals = sized.groupBy("source", "has_source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("has_source").desc(), "source")
    ranked = totals.withColumn("k", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("k") % len(WEIGHTS) + 1).cast("int"))
    rated = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(repeats))
    whole, fill = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) * float(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # in order of cap / weight, those before the first that its level doesn't fill are full
    levelled = rated.withColumn("level", level).withColumn("open", F.col("cap") > F.col("weight") * F.col("level") * (1 + 1e-12))
    final = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "k", "level"))).over(whole)["level"]
    target = F.least("cap", F.coalesce(F.col("weight") * final, F.col("cap")))
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    slots = F.when(blocks == 0, F.lit(0)).otherwise(F.round(F.col("target") * blocks / F.col("source_size"))).cast("long")
    return levelled.withColumn("target", target).select("source", "has_source", "k", "source_size", "target", blocks.alias("blocks"), F.least(slots, blocks * int(repeats)).alias("slots"))


def _packed(sized: DataFrame, words: int) -> DataFrame:
    """Pieces of documents in blocks: k, block, row, doc, begin (in the block), first (word of the document), words.

    words: of all documents.
    """
    ranged = sized.where("size > 0").withColumn("range", F.pmod(F.xxhash64("doc", "row", F.lit("range")), F.lit(words // RANGE_WORDS + 1)))
    ends = ranged.groupBy("k", "range").agg(F.sum("size").alias("words"))
    base = ends.select("k", "range", (F.sum("words").over(Window.partitionBy("k").orderBy("range")) - F.col("words")).alias("base"))
    inside = Window.partitionBy("k", "range").orderBy("doc", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("size").over(inside)).join(base, ["k", "range"]).withColumn("begin", F.col("base") + F.col("upto") - F.col("size"))
    last = F.floor((F.col("begin") + F.col("size") - 1) / BLOCK)
    pieces = placed.select("k", "doc", "row", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / BLOCK), last)).alias("block"))
    lo = F.greatest(F.col("begin"), F.col("block") * BLOCK)
    hi = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * BLOCK)
    return pieces.select("k", "block", "doc", "row", (lo - F.col("block") * BLOCK).alias("begin"), (lo - F.col("begin")).alias("first"), (hi - lo).alias("words"))


def _draws(sources: DataFrame, total: int, bins: int, seed: int, rows: int) -> DataFrame:
    """k, shard, base (of its slot numbers), n: how many blocks of each source every shard takes. bins: for the look-up of draws; rows: of sources."""
    ends = F.sum("slots").over(Window.orderBy("k"))
    spans = sources.where("slots > 0").select("k", ((ends - F.col("slots")) / total).alias("lo"), (ends / total).alias("hi"))
    spans = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") * bins), F.least(F.floor(F.col("hi") * bins), F.lit(bins - 1)))))
    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    shards = -(-total // SHARD_BLOCKS)
    slots = sources.sparkSession.range(total).select(F.floor(F.col("id") / SHARD_BLOCKS).cast("int").alias("shard"), u.alias("u")).withColumn("bin", F.floor(F.col("u") * bins))
    drawn = _with_few(slots, spans, "bin", bins + rows).where("u >= lo AND u < hi").groupBy("k", "shard").agg(F.count(F.lit(1)).alias("drawn"))
    upto = F.sum("drawn").over(Window.partitionBy("k").orderBy("shard"))
    counted = _with_few(drawn, sources.select("k", "slots"), "k", rows).withColumn("base", upto - F.col("drawn"))
    kept = counted.withColumn("n", F.greatest(F.lit(0), F.least("drawn", F.col("slots") - F.col("base"))))
    got = kept.groupBy("k").agg(F.sum("n").alias("got"))
    short = sources.join(got, "k", "left").withColumn("base", F.coalesce("got", F.lit(0))).select("k", F.lit(shards).alias("shard"), "base", (F.col("slots") - F.col("base")).alias("n"))
    return kept.select("k", "shard", "base", "n").unionByName(short).where("n > 0")


def centres(size: Column, key: Column, seed: int) -> Column:
    """Secret centres of the rounds of a permutation of 0 .. size - 1 that key chooses."""
    return F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda i: F.pmod(F.xxhash64(key, F.lit(seed), i), size))


def permuted(x: Column, size: Column, rounds: Column) -> Column:
    """The image of x, below size, under the permutation that the centres `rounds` make.

    Swap-or-not: each round pairs every number with its mirror image round the round's centre and swaps some pairs.
    """

    def one_round(now: Column, centre: Column) -> Column:
        mirror = F.pmod(centre - now, size)
        return F.when(F.xxhash64(centre, F.greatest(now, mirror)) % 2 == 0, mirror).otherwise(now)

    return F.aggregate(rounds, x, one_round)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    cols = docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("_s"), size.alias("size"), F.xxhash64(text_col).alias("row"))
    copy = F.row_number().over(Window.partitionBy("doc", "row").orderBy("_s"))
    return cols.select("doc", F.struct("row", copy.alias("copy")).alias("row"), "size", F.coalesce("_s", F.lit("")).alias("source"), F.col("_s").isNotNull().alias("has_source"))


class Mix:
    """The parts of a mix: `sized` and `sources`, and `slots` (k, shard, number, pass, block), joined to pieces as `taken`."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7):
        sized = _sized(docs, id_col, text_col, source_col)
        self.sources = cut(_sources(sized, BUDGET, REPEATS))
        self.sized = cut(sized.join(self.sources.select("source", "has_source", "k", "source_size", "target"), ["source", "has_source"]))
        total, words, sources = self.sources.agg(F.sum("slots"), F.sum("source_size"), F.count(F.lit(1))).first()
        draws = _draws(self.sources, total, 16 * sources, seed, sources) if total else None
        if draws is None:
            draws = self.sources.where("false").select("k", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("n"))
        step = 4096
        runs = draws.where("n > 0").select("k", "shard", F.explode(F.sequence("base", F.greatest("base", F.col("base") + F.col("n") - 1), F.lit(step).cast("long"))).alias("from"), (F.col("base") + F.col("n")).alias("end"))
        # few rows that become very many: dealt out before they do
        dealt = runs.repartition(parts(docs.sparkSession), "k", "from")
        numbers = dealt.select("k", "shard", F.explode(F.sequence("from", F.greatest("from", F.least(F.col("from") + step, "end") - 1))).alias("number"))
        passes = self.sources.where("blocks > 0").select("k", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(REPEATS)).cast("long"))).alias("pass"))
        rounds = passes.select("k", "blocks", "pass", centres(F.col("blocks"), F.struct("k", "pass"), seed).alias("rounds"))
        slots = _with_few(numbers, self.sources.select("k", "blocks"), "k", sources).withColumn("pass", F.floor(F.col("number") / F.col("blocks"))).withColumn("at", F.col("number") % F.col("blocks")).drop("blocks")
        slots = _with_few(slots, rounds, ["k", "pass"], (int(REPEATS) + 1) * sources)
        self.slots = slots.select("k", "shard", "number", "pass", permuted(F.col("at"), F.col("blocks"), F.col("rounds")).alias("block"))
        self.taken = self.slots.join(_packed(self.sized, words or 0), ["k", "block"])


def mix_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken (words of the document in the mix, repeats counted),
    first_shard (the first output shard that holds words of the document, null without one)."""
    mix = Mix(docs, id_col, text_col, source_col, seed)
    taken = mix.taken.groupBy("doc", "row").agg(F.sum("words").alias("taken"), F.min("shard").alias("first_shard"))
    out = mix.sized.join(taken.withColumnsRenamed({"doc": "_d", "row": "_r"}), F.col("doc").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r")), "left")
    return out.select(F.col("doc").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_shard")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """_doc (all columns) with _i, _h and _c, which name a row as Mix does."""
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.col(id_col).alias("_i"), F.col(source_col).alias("_s"), F.xxhash64(text_col).alias("_h"))
    return keyed.withColumn("_c", F.row_number().over(Window.partitionBy("_i", "_h").orderBy("_s")))


def _spanned(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Rows of docs as _doc with the columns of spans, which has doc and row besides."""
    renamed = spans.withColumn("_d", F.col("doc")).withColumn("_r", F.col("row")["row"]).withColumn("_rc", F.col("row")["copy"]).drop("doc", "row")
    return _keyed(docs, id_col, text_col, source_col).join(renamed, F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_r")) & (F.col("_c") == F.col("_rc")))


def _words(text_col: str) -> Column:
    """The words, wrapped for transform: as a lambda's variable they are found once for a row, not again for every span."""
    return F.array(F.regexp_extract_all(f"_doc.{text_col}", F.lit(WORD), F.lit(0)))


def _slice(words: Column, span: Column) -> Column:
    return F.slice(words, (span["first"] + 1).cast("int"), span["words"].cast("int"))


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """The mix as it is written out: shard, position (in the shard), source, pass, block, text (its words, joined by spaces)."""
    mix = Mix(docs, id_col, text_col, source_col, seed)
    spans = mix.taken.groupBy("doc", "row").agg(F.collect_list(F.struct("shard", "k", "number", "pass", "block", "begin", "first", "words")).alias("_spans"))
    fragment = lambda w: F.transform("_spans", lambda s: F.struct("_s", s["shard"].alias("shard"), s["k"].alias("k"), s["number"].alias("number"), s["pass"].alias("pass"), s["block"].alias("block"), s["begin"].alias("begin"), F.concat_ws(" ", _slice(w, s)).alias("words")))
    found = _spanned(docs, spans, id_col, text_col, source_col).select(F.explode(F.transform(_words(text_col), fragment)[0]).alias("f")).select("f.*")
    blocks = found.groupBy("shard", "k", "number", "pass", "block").agg(F.first("_s").alias("source"), F.array_sort(F.collect_list(F.struct("begin", "words"))).alias("_w"))
    order = Window.partitionBy("shard").orderBy(F.xxhash64("k", "number", F.lit(seed)), "k", "number")  # SHARD_BLOCKS rows, but for the last shard
    return blocks.select("shard", (F.row_number().over(order) - 1).alias("position"), "source", "pass", "block", F.concat_ws(" ", F.col("_w.words")).alias("text"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """The mix as documents: a row for each document and pass that takes words of it, its text those words in order.

    All columns of docs are kept; words that follow each other in the document are joined by one space.
    """
    mix = Mix(docs, id_col, text_col, source_col, seed)
    spans = mix.taken.groupBy("doc", "row", "pass").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("_spans")).withColumnRenamed("pass", "_pass")
    text = F.transform(_words(text_col), lambda w: F.concat_ws(" ", F.flatten(F.transform("_spans", lambda s: _slice(w, s)))))[0]
    return _spanned(docs, spans, id_col, text_col, source_col).select(*[text.alias(c) if c == text_col else F.col(f"_doc.{c}").alias(c) for c in docs.columns])
