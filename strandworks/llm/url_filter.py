"""URL filters by a cascade of Bloom filters.

Level 1 encodes the listed keys; level 2 those other keys of the corpus that level 1 takes for listed; level 3 the
listed keys that level 2 takes for unlisted; and so on until a level errs on no key. Over the complete universe of
keys that it was built from, a cascade is therefore exact: a key is listed if the first level that lacks it is an even
one. Keys are dealt into shards by hash; a shard's cascade is built in one task from the hashes of its keys, and is a
few bits for each listed key. Cascades are broadcast in turns of at most BROADCAST_BYTES, each turn testing the keys
of its shards, so a larger list takes more turns over the urls, not more memory. No rows are joined.

Rules come before the list: a rule fits its host and all subdomains where the url's path starts with the rule's; the
longest fitting rule (host and path together) decides.

Cases: a null url, or one without "://", has an empty host and path, fits no rule, and is looked up like other keys; a
url without a path has an empty one; repeated urls each get their row; an empty table gives no rows; further columns
are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_values, parts, small_batches

#: (host, path, verdict)
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
BITS_PER_KEY, HASHES = 8, 5
BROADCAST_BYTES = 128 << 20
#: Levels after which keys are stored as they are; only keys with equal 128-bit hashes could get there.
MOST_LEVELS = 64

_SHARD = pa.schema([("shard", pa.int32()), ("cascade", pa.binary())])


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.lit(1 << 30))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Struct of rule and verdict of the longest rule that fits; null without one."""
    out: Column | None = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None)


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each key."""
    data = b"".join(xxhash.xxh3_128_digest(k) for k in keys)
    return np.frombuffer(data, ">u8").astype(np.uint64).reshape(-1, 2)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes[:, 0] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


class Bloom:
    def __init__(self, bits: np.ndarray, level: int):
        self.bits, self.level = bits, level

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        a, b = hashes[:, 0] * np.uint64(2 * self.level + 1), hashes[:, 1] | np.uint64(1)
        k = np.arange(HASHES, dtype=np.uint64)[:, None]
        return (a + k * b + (a ^ b >> np.uint64(7)) * k * k) % np.uint64(8 * len(self.bits))

    @classmethod
    def build(cls, hashes: np.ndarray, level: int) -> Bloom:
        own = cls(np.zeros(max(1, -(-len(hashes) * BITS_PER_KEY // 8)), np.uint8), level)
        at = own._places(hashes).ravel()
        np.bitwise_or.at(own.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return own

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self._places(hashes):
            found &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


class Cascade:
    """levels, and should any keys be left after the last one, the hashes of the listed ones among them."""

    def __init__(self, levels: list[Bloom], rest: np.ndarray):
        self.levels, self.rest = levels, rest

    @classmethod
    def build(cls, listed: np.ndarray, others: np.ndarray) -> Cascade:
        levels: list[Bloom] = []
        inside, outside = listed, others
        while len(inside) and len(levels) < MOST_LEVELS:
            levels.append(Bloom.build(inside, len(levels)))
            inside, outside = outside[levels[-1].has(outside)], inside
        return cls(levels, (inside if len(levels) % 2 == 0 else outside) if len(inside) else np.zeros((0, 2), np.uint64))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        verdict, open_ = np.zeros(len(hashes), bool), np.arange(len(hashes))
        for i, level in enumerate(self.levels):
            on = level.has(hashes[open_])
            verdict[open_[~on]] = i % 2 == 1
            open_ = open_[on]
        if len(self.rest):
            kept = {tuple(x) for x in self.rest.tolist()}
            verdict[open_] = [tuple(x) in kept for x in hashes[open_].tolist()]
        else:  # past the last level: it erred on no key, so these are what it encodes
            verdict[open_] = len(self.levels) % 2 == 1
        return verdict

    def dumps(self) -> bytes:
        sizes = np.array([len(self.levels), len(self.rest), *[len(x.bits) for x in self.levels]], np.int64)
        return sizes.tobytes() + b"".join(x.bits.tobytes() for x in self.levels) + self.rest.tobytes()

    @classmethod
    def loads(cls, data: bytes) -> Cascade:
        n, rest = (int(x) for x in np.frombuffer(data, np.int64, 2))
        sizes, at, levels = np.frombuffer(data, np.int64, n, 16).tolist(), 16 + 8 * n, []
        for i, k in enumerate(sizes):
            levels.append(Bloom(np.frombuffer(data, np.uint8, k, at), i))
            at += k
        return cls(levels, np.frombuffer(data, np.uint64, 2 * rest, at).reshape(-1, 2))


def _hashed(shards: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            h = key_hashes(binary_values(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(h, shards)), pa.array(h[:, 0].copy().view(np.int64)), pa.array(h[:, 1].copy().view(np.int64)), batch.column(1)], names=["shard", "a", "b", "listed"])

    return run


def _cascades(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A cascade for each shard; rows come sorted by shard."""

    def built() -> pa.RecordBatch:
        h = np.stack([np.concatenate(held[k]).view(np.uint64) for k in (0, 1)], 1)
        listed = np.concatenate(held[2])
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([Cascade.build(h[listed], h[~listed]).dumps()], pa.binary())], schema=_SHARD)

    now, held = None, ([], [], [])
    for batch in it:
        shard = batch.column("shard").to_numpy(zero_copy_only=False)
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "listed")]
        edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else [0]
        for x, y in zip(edges[:-1], edges[1:]):
            if shard[x] != now and now is not None:
                yield built()
                held = ([], [], [])
            now = int(shard[x])
            for k in range(3):
                held[k].append(columns[k][x:y])
    if now is not None:
        yield built()


def build_cascades(universe: DataFrame, shards: int) -> DataFrame:
    """(shard, cascade) from the distinct keys of the corpus: (key, listed)."""
    hashed = universe.select("key", "listed").mapInArrow(_hashed(shards), "shard int, a long, b long, listed boolean")
    return hashed.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_cascades, "shard int, cascade binary")


def _tested(shared, shards: int, turn: tuple[int, int], names: list[str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascades: dict[int, Cascade] = {}
        for batch in it:
            h = key_hashes(binary_values(batch.column(0)))
            shard = shard_of(h, shards)
            verdict = np.zeros(len(h), bool)
            for s in np.unique(shard[(shard >= turn[0]) & (shard < turn[1])]).tolist():
                if s not in cascades:
                    data = shared.value.get(s)
                    cascades[s] = Cascade.loads(data) if data else Cascade([], np.zeros((0, 2), np.uint64))
                verdict[shard == s] = cascades[s].has(h[shard == s])
            own = pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(verdict)], names=names)
            yield own if turn == (0, shards) else own.filter(pa.array((shard >= turn[0]) & (shard < turn[1])))

    return run


def listed(rows: DataFrame, key: Column, universe: DataFrame, shards: int | None = None) -> DataFrame:
    """rows with a column `listed`: whether the key is a listed one of the universe, which holds every key of the rows."""
    spark = rows.sparkSession
    small_batches(spark, 10000)
    shards = shards or parts(spark)
    cascades = build_cascades(universe, shards).persist()
    sizes = dict(cascades.select("shard", F.length("cascade")).collect())  # two numbers a shard
    turns, size = [0], 0
    for s in range(shards):
        if size and size + sizes.get(s, 0) > BROADCAST_BYTES:
            turns.append(s)
            size = 0
        size += sizes.get(s, 0)
    names = [*rows.columns, "listed"]
    keyed = rows.select(key.alias("_key"), *[rows[c] for c in rows.columns])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "listed boolean"])
    out: DataFrame | None = None
    for turn in zip(turns, [*turns[1:], shards]):
        shared = spark.sparkContext.broadcast(dict(cascades.where(f"shard >= {turn[0]} AND shard < {turn[1]}").collect()))  # at most BROADCAST_BYTES
        part = keyed.mapInArrow(_tested(shared, shards, turn, names), schema)
        out = part if out is None else out.unionByName(part)
    cascades.unpersist()
    return out


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict.

    Where no rule fits, urls whose (host, path) the corpus has seen with a campaign tag (a parameter utm_...) are
    blocked: those are the listed keys, and the universe is every (host, path) of the corpus.
    """
    host, path = host_and_path(url_col)
    rows = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"), F.coalesce(F.col(url_col).rlike(r"[?&]utm_"), F.lit(False)).alias("_tagged"))
    key = F.concat_ws(" ", "host", "path")
    universe = rows.groupBy(key.alias("key")).agg(F.max("_tagged").alias("listed"))
    tested = listed(rows.drop("_tagged"), key, universe)
    rule = rule_of(F.col("host"), F.col("path"))
    return tested.withColumn("_rule", rule).select(
        id_col, "host", "path", F.col("_rule")["rule"].alias("rule"), F.coalesce(F.col("_rule")["verdict"], F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict")
    )
