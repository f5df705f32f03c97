"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark.llm import (
    decontaminate,
    licenses,
    merkle,
    mixing,
    pii,
    quality,
    quoting,
    repeats,
    sharding,
    simhash,
    urlrules,
    warc,
    whitening,
)
from hourmark.runtime import new_path

# Fixed values of the contract.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(_table(spark, sf_dir, "pages"), rules)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.judge(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations hold no quotations, so every message is first made to quote the turns before it."""
    replies = new_path(spark, "replies")  # read several times, so not made several times
    quoting.quoting_replies(_table(spark, sf_dir, "conversations")).write.option("compression", "zstd").parquet(replies)
    return quoting.format_conversations(spark.read.parquet(replies))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.judge(_table(spark, sf_dir, "documents"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.CONTRACT, F.round("score", 9).alias("score"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.judge(_table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.layout(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.judge(_table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.judge(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_repeats,
        op3_decontamination,
        op4_chat_formatting,
        op5_pii,
        op6_license_scans,
        op7_warc,
        op8_quality_rules,
        op9_mixing,
        op10_simhash,
        op11_sharding,
        op12_whitening,
        op13_merkle_manifest,
    )
}

SQL: dict[str, str] = {
    "op1_url_filters": r"""
        WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
            ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        split AS (SELECT row_number() OVER () AS n, page_id,
            translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        fitting AS (SELECT n, r.host || r.path AS rule, r.verdict,
            row_number() OVER (PARTITION BY n ORDER BY length(r.host) DESC, length(r.path) DESC) AS place
            FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM split LEFT JOIN (SELECT * FROM fitting WHERE place = 1) USING (n)""",
    "op3_decontamination": r"""
        WITH worded AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        items AS (SELECT item_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
        grams AS (SELECT DISTINCT item_id, least(10, len(words)) AS m, words[i : i + least(10, len(words)) - 1] AS gram
            FROM items, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS t(i) WHERE len(words) > 0),
        windows AS (SELECT n, i, m, words[i : i + m - 1] AS gram
            FROM worded, (SELECT DISTINCT m FROM grams) AS sizes, unnest(range(1, len(words) - m + 2)) AS t(i)),
        hits AS (SELECT n, i, w.m, item_id FROM windows w JOIN grams g ON w.gram = g.gram AND w.m = g.m),
        covered AS (SELECT n, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, m)) AS t(k) GROUP BY n),
        named AS (SELECT n, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT n, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY n)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM worded LEFT JOIN covered USING (n) LEFT JOIN named USING (n)""",
    "op7_warc": r"""
        WITH hashed AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS h FROM pages),
        held AS (SELECT payload, max(page_id) AS holder FROM hashed GROUP BY payload)
        SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
            array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + (((('0x' || substr(h, 1 + 10 * (k // 8), 10))::BIGINT) >> (35 - 5 * (k % 8))) & 31)::INT, 1)
                FOR k IN range(32)], '') AS payload_digest,
            CASE WHEN holder IS NULL OR page_id IS NOT DISTINCT FROM holder THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to
        FROM hashed JOIN held USING (payload)""",
    "op11_sharding": r"""
        WITH RECURSIVE one_byte AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce([i::BIGINT] || range(8),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
        sized AS (SELECT row_number() OVER () AS n, doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
            xor(4294967295, list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                lambda b: ('0x' || b)::BIGINT), lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32
            FROM documents, one_byte),
        jumps(n, shard, next, k) AS (SELECT n, -1::BIGINT, 0::BIGINT, coalesce(doc_id, 0)::HUGEINT & 18446744073709551615::HUGEINT FROM sized
            UNION ALL SELECT n, next, floor((next + 1)::DOUBLE * (2147483648::DOUBLE / ((m >> 33) + 1)::DOUBLE))::BIGINT, m
            FROM (SELECT n, next, (k * 2862933555777941757::HUGEINT + 1) & 18446744073709551615::HUGEINT AS m FROM jumps WHERE next < 25)),
        settled AS (SELECT n, max(shard) FILTER (WHERE shard < 24) AS shard, max(shard) AS grown_shard FROM jumps GROUP BY n)
        SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
            row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard
        FROM sized JOIN settled USING (n)""",
    "op13_merkle_manifest": r"""
        WITH RECURSIVE one_byte AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce([i::BIGINT] || range(8),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
        given AS (SELECT *, unnest([0, 1]) AS more FROM documents),
        digests AS (SELECT doc_id, lang, more, sha256(list_aggregate(list_transform([doc_id::VARCHAR, source, lang, (n_chars + more)::VARCHAR, text],
            lambda v: coalesce(octet_length(encode(v)) || ':' || v, '-')), 'string_agg', '')) AS leaf, text, source, n_chars FROM given),
        leaves AS (SELECT g.doc_id, g.lang, g.leaf, CASE WHEN xor(4294967295, list_reduce([4294967295] || list_transform(
                regexp_extract_all(hex(encode(g.doc_id::VARCHAR)), '..'), lambda b: ('0x' || b)::BIGINT),
                lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8))) % 7 = 0 THEN t.leaf ELSE g.leaf END AS found,
            dense_rank() OVER (ORDER BY g.lang NULLS FIRST) - 1 AS tree,
            row_number() OVER (PARTITION BY g.lang ORDER BY g.doc_id NULLS FIRST, g.leaf) - 1 AS place
            FROM (FROM digests WHERE more = 0) g JOIN (FROM digests WHERE more = 1) t
                ON g.doc_id IS NOT DISTINCT FROM t.doc_id AND g.lang IS NOT DISTINCT FROM t.lang AND g.source IS NOT DISTINCT FROM t.source
                AND g.n_chars IS NOT DISTINCT FROM t.n_chars AND g.text IS NOT DISTINCT FROM t.text, one_byte),
        low(level, tree, place, node, n) AS (SELECT 0, tree, place, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
            UNION ALL SELECT level + 1, tree, place // 2, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY level, tree, place // 2),
        subroots AS (SELECT tree, node AS subroot FROM low WHERE n = 1),
        high(level, place, node, n) AS (SELECT 0, tree, subroot, count(*) OVER () FROM subroots
            UNION ALL SELECT level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY level, place // 2),
        nodes AS (SELECT level, tree, place, node FROM low WHERE n > 1 UNION ALL
            SELECT level + 1000, NULL, place, node FROM high WHERE n > 1),
        walk(doc_id, tree, first, leaf, level, place, path, folded, stage) AS (
            SELECT doc_id, tree, place, leaf, 0, place, '', found, 0 FROM leaves
            UNION ALL SELECT w.doc_id, w.tree, w.first, w.leaf,
                CASE WHEN own.node IS NULL THEN 1000 ELSE w.level + 1 END, CASE WHEN own.node IS NULL THEN w.tree ELSE w.place // 2 END,
                path || coalesce(beside.node, ''),
                CASE WHEN own.node IS NULL THEN folded ELSE sha256(CASE WHEN w.place % 2 = 1 THEN coalesce(beside.node, '') || folded ELSE folded || coalesce(beside.node, '') END) END,
                CASE WHEN own.node IS NULL THEN stage + 1 ELSE stage END
            FROM walk w LEFT JOIN nodes own ON own.level = w.level AND own.place = w.place AND (own.tree = w.tree OR w.stage = 1)
                LEFT JOIN nodes beside ON beside.level = w.level AND beside.place = xor(w.place, 1) AND (beside.tree = w.tree OR w.stage = 1)
            WHERE w.stage < 2)
        SELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, folded AS folded_root, folded = root AS verified
        FROM walk JOIN subroots USING (tree), (SELECT node AS root FROM high WHERE n = 1) WHERE stage = 2""",
}
