"""The registered queries of the operators, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontam, jaccard, lines, matroska, pii, quality, sharding, spelling, suffix, token_counts, vector_codes, warc
from corvane.llm.common import cut, read_table, utf8


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(matroska.mux(read_table(spark, sf_dir, "documents")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(read_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = utf8(F.col("text"))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return sharding.shuffle_rows(rows, 16).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    return lines.dedup(docs).select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "n_dropped", F.sha2(utf8(F.col("text")), 256).alias("kept_sha256"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(read_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, b"a key that production takes from its secrets")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    archives = cut(warc.write(pages))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read_table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_matroska, op2_suffix_dedup, op3_sharding, op4_line_dedup, op5_jaccard, op6_decontamination, op7_pii, op8_bpe, op9_warc, op10_quality, op11_token_counts, op12_vector_codes, op13_spelling)}

ORACLE_SQL = {
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
             f AS (SELECT digest, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY digest)
        SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
               CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
        FROM p LEFT JOIN f ON f.digest = p.digest AND strlen(p.html) >= 100""",
    "op12_vector_codes": """
        WITH kept AS (SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
                      FROM embeddings WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
             flat AS (SELECT vec_id, (k - 1) // (len(v) // 16) AS part, (k - 1) % (len(v) // 16) AS pos, v[k] AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS k FROM kept)),
             seed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64),
             book0 AS (SELECT f.part, s.entry, f.pos, f.x FROM seed s JOIN flat f ON f.vec_id = s.vec_id),
             near1 AS (SELECT vec_id, part, min(d * 64 + entry) % 64 AS entry
                      FROM (SELECT f.vec_id, f.part, b.entry, sum((f.x - b.x) * (f.x - b.x)) AS d FROM flat f JOIN book0 b ON b.part = f.part AND b.pos = f.pos GROUP BY f.vec_id, f.part, b.entry)
                      GROUP BY vec_id, part),
             mean1 AS (SELECT n.part, n.entry, f.pos, CAST(floor(sum(f.x) / count(*)) AS BIGINT) AS x FROM near1 n JOIN flat f ON f.vec_id = n.vec_id AND f.part = n.part GROUP BY n.part, n.entry, f.pos),
             book1 AS (SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM book0 b LEFT JOIN mean1 m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos),
             near2 AS (SELECT vec_id, part, min(d * 64 + entry) % 64 AS entry
                      FROM (SELECT f.vec_id, f.part, b.entry, sum((f.x - b.x) * (f.x - b.x)) AS d FROM flat f JOIN book1 b ON b.part = f.part AND b.pos = f.pos GROUP BY f.vec_id, f.part, b.entry)
                      GROUP BY vec_id, part),
             mean2 AS (SELECT n.part, n.entry, f.pos, CAST(floor(sum(f.x) / count(*)) AS BIGINT) AS x FROM near2 n JOIN flat f ON f.vec_id = n.vec_id AND f.part = n.part GROUP BY n.part, n.entry, f.pos),
             book2 AS (SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM book1 b LEFT JOIN mean2 m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos),
             last AS (SELECT vec_id, part, min(d * 64 + entry) AS best
                      FROM (SELECT f.vec_id, f.part, b.entry, sum((f.x - b.x) * (f.x - b.x)) AS d FROM flat f JOIN book2 b ON b.part = f.part AND b.pos = f.pos GROUP BY f.vec_id, f.part, b.entry)
                      GROUP BY vec_id, part),
             coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(best % 64 AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM last GROUP BY vec_id),
             digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book2)
        SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, digest.codebooks_sha256
        FROM coded c JOIN kept k ON k.vec_id = c.vec_id CROSS JOIN digest""",
}
