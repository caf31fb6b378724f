"""The mix against a plain recomputation of its sizes, targets, draws and blocks."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandworks.llm import mixing

DOCS = "doc_id long, text string, source string, k string, _s long"


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    out = [(None, "null id here", None, "x", 1), (1, None, "a", "x", 1), (2, "", "b", None, 2), (3, " \n ", "a", "x", 1), (7, "one two", "a", "x", 1), (7, "one two", "a", "x", 1), (7, "one two", "b", "x", 1), (9, "w " * 30000, "hot", "x", 1), (8, "Über zwölf \u00a0x", "b", "", 0)]
    for i in range(10, 150):
        out.append((i, " ".join(f"d{i}w{j}" for j in range(r.choice([1, 5, 40, 300]))), r.choice(["a", "b", "hot", "hot", "z", None]), "x", i))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def _targets(rows):
    sizes = defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += len(_words(t))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return sizes, target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
        if not open_:
            return sizes, target


def test_digest(docs, rows):
    sizes, targets = _targets(rows)
    got = mixing.mix_digest(docs).collect()
    by_id = defaultdict(list)
    for i, t, s, *_ in rows:
        by_id[i].append((len(_words(t)), sizes[s], round(targets[s], 6)))
    assert len(got) == len(rows)
    own = defaultdict(list)
    taken = defaultdict(int)
    for x in got:
        own[x.doc_id].append((x.size, x.source_size, round(x.target, 6)))
        assert 0 <= x.taken <= 2 * x.size and (x.first_shard is None) == (x.taken == 0)
        taken[x.source_size, round(x.target, 6)] += x.taken
    assert {i: sorted(v) for i, v in own.items()} == {i: sorted(v) for i, v in by_id.items()}
    for (size, target), n in taken.items():
        assert abs(n - target) <= 2 * mixing.BLOCK
    assert sorted(map(str, mixing.mix_digest(docs).collect())) == sorted(map(str, got))
    assert mixing.mix_digest(docs.limit(0)).count() == 0


def test_blocks_are_what_the_draws_say(docs, rows, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 64)
    monkeypatch.setattr(mixing, "RANGE_WORDS", 1000)
    sizes, _ = _targets(rows)
    blocks = mixing.mixed_blocks(docs).collect()
    shards = defaultdict(list)
    counts = Counter()
    for b in blocks:
        shards[b.shard].append(b.position)
        counts[b.source, b.shard] += 1
        n = len(b.text.split(" "))
        assert n == mixing.BLOCK or n == sizes[b.source] % mixing.BLOCK
    assert all(sorted(p) == list(range(len(p))) for p in shards.values()) and len(shards) > 3
    assert all(len(p) <= 64 for s, p in shards.items() if s < max(shards))
    # each pass over a source takes no block twice, and blocks of full passes hold the source's words once
    assert all(n == 1 for n in Counter((b.source, b["pass"], b.block) for b in blocks).values())
    words = Counter(w for _, t, s, *_ in rows if s == "z" for w in _words(t))
    first = [b for b in blocks if b.source == "z" and b["pass"] == 0]
    if len(first) == -(-sizes["z"] // mixing.BLOCK):
        assert Counter(w for b in first for w in b.text.split(" ")) == words
    digest = {(x.doc_id, x.size, x.source_size): x.taken for x in mixing.mix_digest(docs).collect()}
    assert sum(len(b.text.split(" ")) for b in blocks) == sum(x.taken for x in mixing.mix_digest(docs).collect()) and digest
    other = Counter()
    for b in mixing.mixed_blocks(docs, seed=8).collect():
        other[b.source, b.shard] += 1
    total = lambda c: {s: sum(n for (t, _), n in c.items() if t == s) for s, _ in c}
    assert other != counts and total(other) == total(counts)  # the draws differ, the targets do not


def test_draws_follow_the_targets(docs, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 256)
    mix = mixing.Mix(docs)
    slots = {r.k: r.slots for r in mix.sources.collect()}
    counts = {(r.k, r.shard): r["count"] for r in mix.slots.groupBy("k", "shard").count().collect()}
    total, shards = sum(slots.values()), {s for _, s in counts}
    whole = [s for s in shards if 0 < s < max(shards) - 2]
    for s in whole:
        for k, n in slots.items():
            want = 256 * n / total
            assert abs(counts.get((k, s), 0) - want) <= 6 * max(1.0, want) ** 0.5


def test_mixed_documents(docs, rows):
    texts = mixing.mixed_documents(docs)
    assert texts.columns == docs.columns
    whole = defaultdict(list)
    for i, t, *_ in rows:
        whole[i].append(_words(t))
    words = defaultdict(int)
    for r in texts.collect():
        own = r.text.split(" ")
        assert any(not Counter(own) - Counter(w) for w in whole[r.doc_id])
        words[r.doc_id] += len(own)
    want = defaultdict(int)
    for r in mixing.mix_digest(docs).collect():
        want[r.doc_id] += r.taken
    assert words == {k: v for k, v in want.items() if v}
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_permutation_is_one(spark):
    n = 97
    rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), mixing.centres(F.lit(n), F.lit(3), 7)).alias("y")).collect()
    assert sorted(r.y for r in rows) == list(range(n)) and [r.y for r in rows] != list(range(n))


def _broadcast_rows(plan):
    """Rows of each broadcast in an executed plan."""
    name, below = plan.nodeName(), plan.children()
    own = [plan.metrics().apply("numOutputRows").value()] if "BroadcastExchange" in name else []
    nodes = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in name else [below.apply(i) for i in range(below.size())]
    return own + [n for p in nodes for n in _broadcast_rows(p)]


def test_slots_are_never_broadcast(spark, docs):
    """With more partitions than sources, Spark broadcast the other side: every slot, as it knew the size of the runs alone."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.autoBroadcastJoinThreshold": "4k"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        mix = mixing.Mix(docs)
        slots = mix.slots.count()
        out = mix.slots.groupBy("k").agg(F.count("block"), F.max("block"))
        out.collect()
        sent = _broadcast_rows(out._jdf.queryExecution().executedPlan())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sent and slots > 1000 and max(sent) < 200
