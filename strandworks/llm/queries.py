"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .divergence import divergences
from .exact_dedup import exact_groups
from .language import languages
from .minhash import jaccard_groups
from .mixing import mix_digest
from .ogg import media_digest
from .periodic import run_digest
from .pieces import piece_digest
from .simhash import near_groups
from .suffix_dedup import removal_digest
from .toxicity import toxicity
from .url_filter import judged
from .warc import archived


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(table(spark, sf_dir, "documents"), others=True)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_mixing, op3_exact_dedup, op4_sentencepiece, op5_url_filter, op6_ogg_media, op7_toxicity, op8_warc, op9_language_id, op10_simhash_near_dedup, op11_source_divergence, op12_minhash_near_dedup, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those queries that SQL can express."""
    return {
        "op3_exact_dedup": r"""
            WITH norm AS (
                SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
            ), grp AS (
                SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY t
            )
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm.t) AS text_sha256
            FROM norm JOIN grp ON norm.t = grp.t
        """,
        "op5_url_filter": r"""
            WITH rest AS (
                SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
            ), cut AS (
                SELECT page_id, url, regexp_extract(coalesce(r, ''), '^[^/?#]*') AS h, regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest
            ), low AS (
                SELECT page_id, url, path, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM cut
            ), tagged AS (
                SELECT host, path, max(coalesce(regexp_matches(url, '[?&]utm_'), false)) AS listed FROM low GROUP BY host, path
            ), ruled AS (
                SELECT page_id, host, path, CASE
                    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
                    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
                    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
                    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
                    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM low
            )
            SELECT page_id, ruled.host, ruled.path, rule, CASE
                WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict
            FROM ruled JOIN tagged ON ruled.host = tagged.host AND ruled.path = tagged.path
        """,
        "op8_warc": r"""
            WITH sized AS (
                SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
            ), bits AS (
                SELECT page_id, t, payload_bytes, list_aggregate(list_transform(range(40), lambda i: lpad(bin(('0x' || substr(h, i + 1, 1))::INT), 4, '0')), 'string_agg', '') AS b FROM sized
            ), first AS (
                SELECT t, max(page_id) AS keep FROM sized GROUP BY t
            )
            SELECT page_id, payload_bytes,
                list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: CASE WHEN substr(b, 5 * i + j + 1, 1) = '1' THEN 1 << (4 - j) ELSE 0 END))::INT, 1)), 'string_agg', '') AS payload_digest,
                CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
                CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
            FROM bits JOIN first ON bits.t = first.t
        """,
        "op11_source_divergence": r"""
            WITH docs AS (
                SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
            ), words AS (
                SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS item FROM docs
            ), kept AS (
                SELECT lang, item, count(*) AS n FROM words GROUP BY lang, item HAVING count(DISTINCT r) >= 3
            ), langs AS (
                SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
            ), counts AS (
                SELECT lang, source, item, count(*) AS n FROM words JOIN kept USING (lang, item) GROUP BY lang, source, item
            ), groups AS (
                SELECT lang, source, coalesce(total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM docs)
                LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source) USING (lang, source)
            ), dense AS (
                SELECT lang, source, item, coalesce(counts.n, 0) AS n,
                    1 + (1000000000::HUGEINT * (coalesce(counts.n, 0) + 1)) // (groups.total + v) AS p,
                    1 + (1000000000::HUGEINT * (kept.n + 1)) // (langs.total + v) AS q
                FROM groups JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN counts USING (lang, source, item)
            ), pairs AS (
                SELECT lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
                FROM dense a JOIN dense b USING (lang, item) WHERE a.source <> b.source GROUP BY lang, a.source, b.source
            ), both_parts AS (
                SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
                FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
                UNION ALL
                SELECT lang, source, 'term', item, (((p - q) * (p - q)) // q)::BIGINT FROM dense WHERE n > 0 AND p > q
            )
            SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank
            FROM both_parts QUALIFY part = 'pair' OR rank <= 200
        """,
        "op12_minhash_near_dedup": r"""
            WITH RECURSIVE docs AS (
                SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
            ), sets AS (
                SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM docs
            ), members AS (
                SELECT r, len(s) AS n, unnest(s) AS m FROM sets
            ), links AS (
                SELECT a.r AS x, b.r AS y FROM members a JOIN members b ON a.m = b.m AND a.r <> b.r
                GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
            ), reached AS (
                SELECT r, r AS z FROM sets
                UNION
                SELECT x, z FROM reached JOIN links ON links.y = reached.r
            ), named AS (
                SELECT reached.r, min(doc_id) AS component_id FROM reached JOIN sets ON sets.r = reached.z GROUP BY reached.r
            )
            SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN named USING (r)
        """,
        "op13_periodic_runs": r"""
            WITH docs AS (
                SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                    xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda h, c:
                        list_reduce([xor(h, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS h FROM documents
            ), sizes AS (
                SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS seeded, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS d FROM docs
            ), texts AS (
                SELECT r, doc_id, n, CASE WHEN seeded THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // d) ELSE i END]) ELSE w END AS w FROM sizes
            ), places AS (
                SELECT r, unnest(range(n)) AS i, unnest(w) AS word, w FROM texts
            ), grams AS (
                SELECT r, i, array_to_string(w[i + 1:i + 6], ' ') AS g FROM places WHERE i + 6 <= len(w)
            ), equal AS (
                SELECT r, b.i - a.i AS q, a.i AS i FROM grams a JOIN grams b USING (r, g) WHERE a.i < b.i
            ), islands AS (
                SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM equal
            ), stretches AS (
                SELECT r, q, min(i) AS lo, max(i) + 6 AS hi FROM islands GROUP BY r, q, k
            ), runs AS (
                SELECT r, lo AS start, hi - lo + q AS length, min(q) AS period FROM stretches WHERE hi - lo >= greatest(q, 12 - q) GROUP BY r, lo, hi - lo + q
            ), listed AS (
                SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
                    arg_min(struct_pack(s := start, l := length, p := period), (-length, start, period)) AS best FROM runs GROUP BY r
            ), dropped AS (
                SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
            ), collapsed AS (
                SELECT r, string_agg(word, ' ' ORDER BY i) AS c FROM places ANTI JOIN dropped USING (r, i) GROUP BY r
            )
            SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
                sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
            FROM texts LEFT JOIN listed USING (r) LEFT JOIN collapsed USING (r)
        """,
    }
