"""The queries op1 to op10 and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, chunks, mixing, packing, quality, secret_scan, sharding, simhash, substring, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL["op2_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
twice AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM s WHERE k IN (SELECT k FROM twice)),
kept AS (SELECT x.rid, string_agg(x.word, ' ' ORDER BY x.p) AS kept, count(*) AS n
         FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x
         ANTI JOIN gone USING (rid, p) GROUP BY x.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""


@query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL["op1_source_mix"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix|' || coalesce(doc_id::VARCHAR, '-')) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
             sum(source_size) OVER () * 1.5::DOUBLE AS budget, (source_size * 2)::DOUBLE AS lim FROM s),
l AS (SELECT *, (budget - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_level FROM w),
t AS (SELECT source, source_size, budget, CASE WHEN open_level >= lim / weight THEN lim
             ELSE weight * max(CASE WHEN open_level < lim / weight THEN open_level END) OVER () END AS target FROM l),
r AS (SELECT d.*, t.source_size, t.target, t.budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS words
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, size, place, budget, (k * source_size + words)::DOUBLE / target AS time FROM r, range(2) g(k) WHERE size > 0 AND target > 0),
x AS (SELECT doc_id, size, place, sum(size) OVER (ORDER BY time, place, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto, budget FROM c),
n AS (SELECT doc_id, size, place, count(*) AS copies FROM x WHERE upto <= budget GROUP BY ALL)
SELECT r.doc_id, r.size, r.source_size, r.target, (r.size * coalesce(n.copies, 0))::BIGINT AS taken
FROM r LEFT JOIN n ON r.doc_id IS NOT DISTINCT FROM n.doc_id AND r.size = n.size AND r.place = n.place
"""


@query
def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ledger = secret_scan.scan(documents(spark, sf_dir))
    findings, _ = secret_scan.scan(documents(spark, sf_dir), ledger)  # the next run: all blobs are in the ledger
    return secret_scan.digest(findings)


@query
def op5_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.compared(documents(spark, sf_dir))


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), special=True)


@query
def op6_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL["op6_bloom_cascade"] = r"""
WITH a AS (SELECT page_id, strpos(coalesce(url, ''), '://') AS pos, url FROM pages),
b AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM a),
c AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path FROM b),
r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
                            ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
      FROM c LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '(^|\.)(spam-farm\.example\.org|cheap-pills\.example\.com)$')
       THEN 'block' ELSE 'allow' END) AS verdict FROM f
"""


@query
def op9_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir)).select("doc_id", "score", (F.col("score") < quality.REJECT).alias("keep"))


@query
def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(documents(spark, sf_dir))
