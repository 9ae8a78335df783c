"""The operators as registered queries over whole tables, with the SQL that each must agree with where there is some."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from .decontamination import find_contamination
from .fill_in_middle import fill_in_middle, restored
from .fingerprints import fingerprint_edits
from .html_extraction import extract_text
from .importance_resampling import resample
from .line_dedup import dedup_lines
from .ngram_jaccard import ngram_jaccard_join
from .packing import pack
from .pii import find_pii
from .quality import score_quality
from .sharding import shard
from .toxicity import score_toxicity
from .url_reputation import filter_urls

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"), shards=8)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_pii": op4_pii,
    "op5_decontamination": op5_decontamination,
    "op6_html_extraction": op6_html_extraction,
    "op7_url_filters": op7_url_filters,
    "op8_sharding": op8_sharding,
    "op9_packing": op9_packing,
    "op10_fingerprints": op10_fingerprints,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_line_dedup": op12_line_dedup,
    "op13_importance_resampling": op13_importance_resampling,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op11_fill_in_middle": """
        WITH drawn AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
                   sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d
            FROM documents
        ), cut AS (
            SELECT doc_id, text, units, len(units) AS n,
                   CAST('0x' || d[1:8] AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || d[9:16] AS BIGINT) % (len(units) + 1) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                             OR CAST('0x' || d[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
                        WHEN CAST('0x' || d[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn
        ), parts AS (
            SELECT doc_id, text, n, form, array_to_string(units[1:least(a, b)], '') AS p, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m,
                   array_to_string(units[greatest(a, b) + 1:], '') AS s
            FROM cut
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts""",
    "op12_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), common AS (
            SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ), marked AS (
            SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM keyed k LEFT JOIN common c USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    # The CRC-32 goes bit by bit over each distinct feature.
    "op13_importance_resampling": """
        WITH worded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
        ), target AS (
            SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
        ), runs AS (
            SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM worded
        ), target_runs AS (
            SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM target
        ), counted AS (
            SELECT doc_id, f, count(*) AS n FROM runs GROUP BY ALL
        ), target_counted AS (
            SELECT f, count(*) AS n FROM target_runs GROUP BY ALL
        ), features AS (
            SELECT f, bin(f) AS b FROM (SELECT f FROM counted UNION SELECT f FROM target_counted)
        ), hashed AS (
            SELECT f, xor(list_reduce(list_transform(range(len(b)), lambda k: CAST(b[k - k % 8 + 8 - k % 8] AS BIGINT)),
                lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1)), 4294967295), 4294967295) % 10000 AS bucket
            FROM features
        ), s AS (
            SELECT bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY bucket
        ), t AS (
            SELECT bucket, sum(n) AS n FROM target_counted JOIN hashed USING (f) GROUP BY bucket
        ), totals AS (
            SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all
        ), gains AS (
            SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((s.n + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
            FROM s LEFT JOIN t USING (bucket), totals
        ), weights AS (
            SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY doc_id
        ), scored AS (
            SELECT doc_id, len(w) >= 20 AS enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM worded LEFT JOIN weights USING (doc_id)
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS place, sum(enough::INT) OVER () AS n FROM scored
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= 5 * n // 100 THEN place END AS rank FROM ranked""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
