"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on small tables with odd rows."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from strandworks.llm import exact_dedup, language, ogg, simhash, toxicity, url_filter, warc

DOCS = "doc_id long, text string, source string, fp string"
BASE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, BASE, "a", "x"), (2, BASE.replace(" ", "\t "), "a", "x"), (3, BASE.replace("word59", "other"), "b", None), (4, None, None, "x"), (5, "", "b", "x"), (6, " \n ", "a", "x"),
    (7, "one two", "a", "x"), (7, "one two", "a", "x"), (8, "Über ﬁne ▁ zwölf", "b", "x"), (9, "w " * 30000, "a", "x"), (None, "null id here", None, "x"), (10, "ONE TWO", "c", "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_groups(docs, empty):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[norm(t)].append(i)
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(ROWS)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in got:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    assert exact_dedup.drop_exact_copies(docs).count() == len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_quotient_filters_merge_losslessly():
    r = random.Random(3)
    values = [np.array(sorted(r.choices(range(0, 2**64, 2**54 + 7), k=400)), np.uint64) for _ in range(3)]
    filters = []
    for v in values:
        fps, counts = np.unique(v, return_counts=True)
        own = exact_dedup.QuotientFilter.loads(exact_dedup.QuotientFilter.build(fps, counts, 9).dumps())
        assert [x.tolist() for x in own.items()] == [fps.tolist(), counts.tolist()]
        filters.append(own)
    fps, counts = exact_dedup.QuotientFilter.merged(filters)
    want = np.unique(np.concatenate(values), return_counts=True)
    assert fps.tolist() == want[0].tolist() and counts.tolist() == want[1].tolist()


def _fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps, ids):
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                low = min(root[i], root[j])
                if (fps[i] ^ fps[j]).bit_count() <= 2 and root[i] != root[j]:
                    root[i] = root[j] = low
                    changed = True
    return [min((ids[k] for k in range(len(fps)) if root[k] == r and ids[k] is not None), default=None) for r in root]


def test_near_groups(docs, empty):
    fps = [_fingerprint(r[1]) for r in ROWS]
    want = sorted(zip([str(r[0]) for r in ROWS], [f"{f:016x}" for f in fps], map(str, _components(fps, [r[0] for r in ROWS]))))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_groups(docs).collect()) == want
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("limit", [2048, 3])
def test_bucket_links_lose_no_component(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "SHIFT_LIMIT", limit)
    r = random.Random(8)
    fps = []
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(10):
            fps.append(x)
            x ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64)
    masks = simhash.covering_masks(2)
    assert all(any((1 << a | 1 << b) & (m & 2**64 - 1) == 0 for m in masks) for a in range(64) for b in range(64))
    ids = list(range(len(fps)))
    want = _components(fps, ids)
    found = []
    for m in np.array(masks, np.int64).view(np.uint64):
        own = signed.view(np.uint64)
        key = own & m
        order = np.lexsort((own, key))
        a, b = simhash._bucket_links(key[order], own[order], np.broadcast_to(~m, len(own)), 2)
        found += zip(order[a].tolist(), order[b].tolist())
    root = simhash._roots(len(fps), *(np.array(x) for x in zip(*found)))
    assert root.tolist() == want


def test_urls(spark):
    urls = ["http://A.org/x?utm_a=1", "http://a.org/x", "https://www.example.org/es/q", "x", None, "http://b.com/de/", "http://b.net/p?utm_s=2", "http://b.net/p#f", "http://b.net", "http://example.org/en/12"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages).collect()}
    assert got[0] == got[1] == ("a.org", "/x", "org/", "allow") and got[2][2:] == ("example.org/es/", "block")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6] == got[7] == ("b.net", "/p", None, "block") and got[8] == ("b.net", "", None, "allow") and got[9][2:] == ("example.org/en/1", "block")
    assert url_filter.judged(pages.limit(0)).count() == 0
    h = url_filter.key_hashes([str(i).encode() for i in range(5000)])
    own = url_filter.Cascade.loads(url_filter.Cascade.build(h[:700], h[700:]).dumps())
    assert own.has(h).tolist() == [i < 700 for i in range(5000)]


def test_ogg_round_trip_and_damage(docs):
    for r in ogg.media_digest(docs).where("doc_id IS NOT NULL AND doc_id <> 7").collect():
        data = next((t or "").encode() for i, t, *_ in ROWS if i == r.doc_id)
        padded = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    media = bytearray(ogg.encode(bytes(range(256)) * 1000, 7))
    assert ogg.read_sound(bytes(media))["payload"] == bytes(range(256)) * 1000
    media[len(media) // 2] ^= 1
    hurt = ogg.read_sound(bytes(media))
    assert hurt["skipped"] > 0 and 0 < len(hurt["payload"]) < 256000


def test_warc_round_trip_and_salvage(spark):
    rows = [(1, "http://a", "same", 0), (5, "http://b", "same", 0), (3, None, None, 0), (4, "u", "", 0), (9, "u", "x" * 9, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _id int")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(pages).collect()}
    assert got[1] == (4, warc.digest(b"same"), "revisit", 5) and got[5][2:] == ("response", None)
    assert got[3] == (0, warc.digest(b""), "revisit", 4) and got[4][2] == got[9][2] == "response"
    assert warc.archived(pages.limit(0)).count() == 0
    for packed in (warc.compress, bytes):
        records = [packed(warc.page_record(i, f"u{i}", b"p" * 50 * i, None, False)) for i in range(1, 6)]
        data = bytearray(b"".join(records))
        at = len(records[0]) + len(records[1]) // 2
        data[at] ^= 0xFF
        found, gaps = warc.salvage(bytes(data))
        assert [r.fields["warc-target-uri"] for r in found] == ["u1", "u3", "u4", "u5"]
        assert [(g.offset, g.size) for g in gaps] == [(len(records[0]), len(records[1]))]


def test_warc_fields_files_and_damage_inside_a_member(spark, tmp_path):
    rows = [(1, "u1", "a"), (1, "u1", "a"), (2, "u2", "a"), (None, None, None)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    warc.save_archives(archives, str(tmp_path))
    back = warc.read_archives(warc.load_archives(spark, str(tmp_path)))
    assert sorted(str(r) for r in back.drop("archive", "offset").collect()) == sorted(str(r) for r in warc.read_archives(archives).drop("archive", "offset").collect())
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [("1", "revisit", 2), ("1", "revisit", 2), ("2", "response", None), ("None", "response", None)]
    plain = b"WARC/1.0\r\nwarc-type: revisit\r\nWARC-RECORD-ID:<urn:page:7>\r\ncontent-length: 0\r\n\r\n\r\n\r\n"
    found, gaps = warc.salvage(plain)
    assert not gaps and warc._page("a", found[0])["page_id"] == 7 and warc._page("a", found[0])["payload_digest"] is None
    good = warc.page_record(5, "u", b"pay", None, False)
    found, gaps = warc.salvage(warc.compress(good.replace(b"pay", b"PAY", 1) + good) + warc.compress(good))
    assert [(r.offset > 0) for r in found] == [False, True] and len(gaps) == 1 and gaps[0].size == 0
    found, gaps = warc.salvage(b"junk" + good + b"\x1f\x8b\x08 no member" + warc.compress(good) + b"tail")
    assert len(found) == 2 and [g.size for g in gaps] == [4, 13, 4]


def _maximal(s):
    """All maximal scoring segments by their definition: the best one, then those of what is left on both sides."""
    best, at = 0.0, None
    for a in range(len(s)):
        total = 0.0
        for b in range(a, len(s)):
            total += s[b]
            if total > best + 1e-12:
                best, at = total, (a, b + 1)
    if at is None:
        return []
    a, b = at
    return [*_maximal(s[:a]), (a, b, best), *[(x + b, y + b, v) for x, y, v in _maximal(s[b:])]]


def test_segments_against_the_definition():
    r = random.Random(4)
    for _ in range(200):
        s = [r.choice([-1.0, -1.0, -2.7183, 1.4142, 2.2361]) * r.uniform(0.9, 1.1) if r.random() < 0.7 else -1.0 for _ in range(r.randint(0, 40))]
        places = [i for i, x in enumerate(s) if x != -1.0]
        found = toxicity.segments(places, [s[i] for i in places], -1.0)
        want = _maximal(s)
        assert [(x.begin, x.end) for x in found] == [(a, b) for a, b, _ in want]
        assert np.allclose([x.score for x in found], [v for *_, v in want])


def test_segments_take_linear_time():
    r = random.Random(5)

    def took(n):
        scores = [r.choice([1.0, -1.1]) * r.random() for _ in range(n)]
        began = time.process_time()
        toxicity.segments(list(range(n)), scores, -0.1)
        toxicity.segments(list(range(n)), [1.0, *[-1.0, 0.9] * (n // 2)][:n], -0.1)
        return time.process_time() - began

    assert took(200_000) < 20 * max(took(20_000), 0.005)


def test_log_odds_of_all_words():
    words = [(b"awful", 30, 1), *[(b"awful%d" % i, 3, 0) for i in range(9)], (b"good", 0, 40), (b"the", 20, 20), (b"once", 1, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array([w[i] for w in sorted(words)], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64()))], names=["word", "toxic", "clean"])
    rows = [r for b in toxicity._entries(90.0, 61.0)(iter([batch])) for r in b.to_pylist()]
    got = {r["part"]: r["odds"] for r in rows}
    t, c, whole = 33.1, 4.1, 15.1
    want = np.log(t / (90 + whole - t)) - np.log(c / (61 + whole - c)) - toxicity.Z * np.sqrt(1 / t + 1 / c)
    assert abs(got[b"awful"] - want) < 1e-9 and got[b"good"] < 0 and b"the" not in got and b"once" not in got
    assert b"awful1" not in got and got[b"awful*"] > 0  # rare words are known by their beginning, without the frequent one's counts
    assert all(r["less_toxic"] <= r["odds"] <= r["less_clean"] for r in rows if r["part"] != b"good")
    scorer = toxicity.Scorer(got)
    assert scorer.hits(b"awfulest good zzz")[2] == [got[b"awful*"], got[b"good"]]


def test_stages_keep_columns_with_clashing_names(spark):
    rows = [(1, "fine words", 0.5, "p"), (1, "fine words", 0.5, "p"), (None, None, None, None), (2, "", 1.0, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, passages string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    assert toxicity.scored(docs, toxicity.train(docs, labels)).columns == ["doc_id", "score", "passages"]
    exact = exact_dedup.drop_exact_copies(docs.withColumnRenamed("score", "kept").withColumnRenamed("passages", "_sha"))
    assert exact.columns == ["doc_id", "text", "kept", "_sha"] and exact.count() == 2
    tagged = docs.withColumnRenamed("passages", "lang")
    assert language.identified(tagged, language.train(tagged)).columns == ["doc_id", "lang", "lang_pred", "score", "spans"]


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels.select("doc_id", "toxic").distinct(), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.9
    rows = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.9


def test_odd_rows_of_the_classifiers(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1), (None, 0), (7, None)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == len(ROWS) and toxicity.toxicity(empty, labels).count() == 0
    tagged = docs.selectExpr("*", "if(doc_id = 8, 'de', 'en') AS lang")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.languages(tagged).collect()}
    assert got[4] == got[5] == got[6] == ("und", 0.0)
    assert language.languages(tagged.limit(0)).count() == 0
