"""The corpus operators as queries on the given tables, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwise.llm import (
    centroids, decontamination, edit_fingerprints, html_extraction, line_dedup, mixing, packing, pu_quality, sharding, simhash, token_counts,
    toxicity, vector_codes,
)
from tripwise.llm.common import read

SHARDS = 40


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with two edits: a stretch a third of the way in gives way to the text's beginning, and a clause is
    inserted in the middle of what results."""
    n, text = F.char_length("text"), F.col("text")
    edits = F.array(
        F.struct(F.floor(n / 3).cast("bigint").alias("start"), F.floor(n / 20).cast("bigint").alias("length"),
                 F.substring(text, 1, 60).alias("replacement")),
        F.struct(F.floor(n / 2).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("length"),
                 F.lit(", as amended in 2024,").alias("replacement")))
    return token_counts.recount(token_counts.token_trees(read(spark, folder, "documents"), edits))


def op2_edit_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return edit_fingerprints.fingerprint_edits(read(spark, folder, "documents"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_table(read(spark, folder, "documents"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.repeated_spans(read(spark, folder, "documents"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_table(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.extract_pages(read(spark, folder, "pages"))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_table(read(spark, folder, "documents"), SHARDS)


def op9_pu_quality(spark: SparkSession, folder: str) -> DataFrame:
    return pu_quality.quality_table(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(read(spark, folder, "embeddings"))


def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(read(spark, folder, "embeddings"))


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_token_counts, op2_edit_fingerprints, op3_mixing, op4_decontamination, op5_line_dedup, op6_toxicity, op7_html_extraction, op8_sharding, op9_pu_quality, op10_simhash,
        op11_vector_codes, op12_centroids, op13_packing)
}

MIXING_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS stratum,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5('mix-1:' || doc_id || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents),
sources AS (
  SELECT source, stratum, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM rows GROUP BY source, stratum),
weighted AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][place % 3 + 1] AS weight, 3 * source_size AS most FROM sources),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(most) OVER (
      ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
targets AS (
  SELECT stratum, source_size, CASE WHEN level * weight >= most THEN most::DOUBLE
    ELSE weight * max(CASE WHEN level * weight < most THEN level END) OVER () END AS target FROM levels),
blocks AS (
  SELECT stratum, key % 1024 AS block, sum(size)::BIGINT AS size,
    ('0x' || substr(md5('mix-1-blocks:' || stratum || ':' || key % 1024), 1, 15))::BIGINT AS turn
  FROM rows GROUP BY ALL),
filled AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes,
    (sum(size) OVER (PARTITION BY stratum ORDER BY turn, block ROWS UNBOUNDED PRECEDING))::BIGINT AS stop
  FROM blocks JOIN targets USING (stratum)),
planned AS (SELECT *, target - passes * source_size AS rest FROM filled),
last_rows AS (
  SELECT r.stratum, r.key, p.rest - (p.stop - p.size) AS room,
    sum(r.size) OVER (PARTITION BY r.stratum ORDER BY r.key RANGE UNBOUNDED PRECEDING) AS upto
  FROM rows r JOIN planned p ON r.stratum = p.stratum AND r.key % 1024 = p.block
  WHERE p.stop - p.size < p.rest AND p.stop > p.rest),
cuts AS (SELECT stratum, max(key) AS cut FROM last_rows WHERE upto <= room GROUP BY stratum)
SELECT r.doc_id, r.size::BIGINT AS size, p.source_size, p.target,
  (r.size * (p.passes + CASE WHEN p.stop <= p.rest OR (p.stop - p.size < p.rest AND r.key <= coalesce(c.cut, -1)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rows r JOIN planned p ON r.stratum = p.stratum AND r.key % 1024 = p.block LEFT JOIN cuts c ON c.stratum = r.stratum
"""

# The byte-wise CRC-32 of the text is spelled out, as there is no such function in the oracle's SQL.
SHARDING_SQL = r"""
WITH byte_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
rows AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
      lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32,
    ('0x' || substr(md5('shard-1:' || doc_id || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents, byte_table),
ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY key, doc_id, text_crc32) - 1)
    / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS fraction, count(*) OVER () AS total FROM rows),
placed AS (SELECT *, row_number() OVER (ORDER BY fraction, source NULLS LAST, key, doc_id, text_crc32) - 1 AS place FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (place * 40 // total)::INTEGER AS shard,
  (place - ((place * 40 // total) * total + 39) // 40)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""

# Lloyd's rounds are spelled out one after another; `%` and `//` truncate, so the floor of a quotient takes the remainder off first.
FLOORED = "((s.total - ((s.total % s.n) + s.n) % s.n) // s.n)::BIGINT"

CODES_START = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, vector) AS place, vec_id, label, vector FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS vector FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parts AS MATERIALIZED (
  SELECT place, i // (n // 8) AS p, i % (n // 8) AS j, x
  FROM (SELECT place, len(vector) AS n, unnest(range(len(vector))) AS i, unnest(vector) AS x FROM kept)),
book0 AS MATERIALIZED (SELECT p, place - 1 AS e, j, x FROM parts WHERE place <= 16)"""

CODES_ROUND = """,
near{r} AS MATERIALIZED (
  SELECT place, p, min(d * 16 + e) % 16 AS e, min(d * 16 + e) // 16 AS d FROM (
    SELECT a.place, a.p, b.e, sum((a.x - b.x) * (a.x - b.x))::BIGINT AS d FROM parts a JOIN book{r} b ON a.p = b.p AND a.j = b.j GROUP BY ALL)
  GROUP BY place, p)"""

CODES_UPDATE = """,
book{next} AS MATERIALIZED (
  SELECT b.p, b.e, b.j, coalesce({floored}, b.x) AS x FROM book{r} b LEFT JOIN (
    SELECT a.p, n.e, a.j, sum(a.x)::BIGINT AS total, count(*) AS n FROM parts a JOIN near{r} n ON a.place = n.place AND a.p = n.p GROUP BY ALL) s
  ON b.p = s.p AND b.e = s.e AND b.j = s.j)"""

CODES_END = """,
coded AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', n.e), '' ORDER BY n.p) AS code, sum(n.d)::BIGINT AS error
  FROM kept k JOIN near6 n ON k.place = n.place GROUP BY k.place, k.vec_id, k.label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) FROM book6) AS codebooks_sha256
FROM coded"""

CENTROIDS_START = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), vector) AS place, vec_id, vector FROM (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vector FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
components AS MATERIALIZED (SELECT place, unnest(range(64)) AS j, unnest(vector) AS x FROM kept),
book0 AS MATERIALIZED (SELECT place - 1 AS e, j, x FROM components WHERE place <= 40)"""

CENTROIDS_ROUND = """,
near{r} AS MATERIALIZED (
  SELECT place, min(d * 64 + e) % 64 AS e, min(d * 64 + e) // 64 AS d FROM (
    SELECT a.place, b.e, sum((a.x - b.x) * (a.x - b.x))::BIGINT AS d FROM components a JOIN book{r} b ON a.j = b.j GROUP BY ALL)
  GROUP BY place)"""

CENTROIDS_UPDATE = """,
book{next} AS MATERIALIZED (
  SELECT b.e, b.j, coalesce({floored}, b.x) AS x FROM book{r} b LEFT JOIN (
    SELECT n.e, a.j, sum(a.x)::BIGINT AS total, count(*) AS n FROM components a JOIN near{r} n ON a.place = n.place GROUP BY ALL) s
  ON b.e = s.e AND b.j = s.j)"""

CENTROIDS_END = """,
digests AS (SELECT e, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM book5 GROUP BY e)
SELECT k.vec_id, n.e::INTEGER AS cluster, n.d AS distance, (sum(n.d) OVER (PARTITION BY n.e))::BIGINT AS cluster_inertia,
  (sum(n.d) OVER ())::BIGINT AS inertia, g.centroid_sha256
FROM kept k JOIN near5 n ON k.place = n.place JOIN digests g ON n.e = g.e"""


def _rounds(start: str, step: str, update: str, end: str, rounds: int) -> str:
    sql = start
    for r in range(rounds):
        sql += step.format(r=r) + update.format(r=r, next=r + 1, floored=FLOORED)
    return sql + step.format(r=rounds) + end


ORACLES: dict[str, str] = {
    "op3_mixing": MIXING_SQL, "op8_sharding": SHARDING_SQL,
    "op11_vector_codes": _rounds(CODES_START, CODES_ROUND, CODES_UPDATE, CODES_END, 6),
    "op12_centroids": _rounds(CENTROIDS_START, CENTROIDS_ROUND, CENTROIDS_UPDATE, CENTROIDS_END, 5),
}
