"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelforge.llm import decontamination, exact_dedup, language_id, line_dedup, mixing, near_dedup, pii, quality, spelling, substring_dedup, token_counts, warc, whitening

#: The vocabulary that op4 counts with.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary_path())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that repeat across documents, or inside one."""
    return substring_dedup.repeated_spans(_table(spark, sf_dir, "documents"), least=substring_dedup.FOUND_BY, words=substring_dedup.PASSAGE)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many are in deleted runs, and the text left."""
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    text = F.col("row.text")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.coalesce(F.size(line_dedup.lines_of(text)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("runs", F.lit(0), lambda n, r: n + r["lines"]), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_mix_sources, op2_language_id, op3_warc, op4_token_counts, op5_quality,
            op6_decontamination, op7_substring_dedup, op8_line_dedup, op9_near_dedup, op10_exact_dedup,
            op11_whitening, op12_spelling_variants, op13_personal_data,
        )
    }


_OP3 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, n, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest
  FROM p
), f AS (SELECT payload_digest, n, min(page_id) AS first_id FROM d GROUP BY 1, 2)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM d JOIN f USING (payload_digest, n)
"""

_OP6 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
  FROM items, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT k FROM grams),
occ AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM words, sizes, unnest(range(1, len(w) - k + 2)) AS u(i) WHERE len(w) >= k
), hits AS (
  SELECT doc_id, i, occ.k, item_id FROM occ JOIN grams ON occ.gram = grams.gram AND occ.k = grams.k
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, k FROM hits), unnest(range(0, k)) AS u(j) GROUP BY 1
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_OP8 = r"""
WITH rows AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS r FROM documents
), lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS n FROM rows WHERE length(trim(line, ' ')) > 0
), pairs AS (
  SELECT doc_id, n, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS pair FROM lines
), firsts AS (SELECT pair, min((doc_id, n)) AS f FROM pairs WHERE pair IS NOT NULL GROUP BY 1),
later AS (SELECT doc_id, n FROM pairs JOIN firsts USING (pair) WHERE f < (doc_id, n)),
gone AS (SELECT doc_id, n FROM later UNION SELECT doc_id, n + 1 FROM later),
marked AS (
  SELECT rows.doc_id, rows.r, rows.line, lines.n, gone.n IS NOT NULL AS cut
  FROM rows LEFT JOIN lines USING (doc_id, r) LEFT JOIN gone ON rows.doc_id = gone.doc_id AND lines.n = gone.n
), around AS (
  SELECT *, last_value(CASE WHEN n IS NOT NULL THEN cut END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY r) AS before,
    first_value(CASE WHEN n IS NOT NULL THEN cut END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
  FROM marked
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (cut) AS n_removed,
    string_agg(line, chr(10) ORDER BY r) FILTER (NOT (CASE WHEN n IS NOT NULL THEN cut ELSE coalesce(before AND after, FALSE) END)) AS kept
  FROM around GROUP BY 1
)
SELECT documents.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

_OP10 = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": _OP3, "op6_decontamination": _OP6, "op8_line_dedup": _OP8, "op10_exact_dedup": _OP10}
