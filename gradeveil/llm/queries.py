"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeveil.llm import chat, decontamination, importance, language_model, line_dedup, near_dedup, packing, quality_rules, substring_dedup, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(_table(spark, sf_dir, "documents"))


def op3_quality_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.find_leaks(docs, _table(spark, sf_dir, "benchmark")).drop("text")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80).drop("text_hash")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_files.read_token_files(token_files.write_token_files(docs))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep_text=False)
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles recovered from the text alone; the labels only fit the model's distributions."""
    turns = _table(spark, sf_dir, "conversations")
    return chat.format_chats(turns, speaker=None, model=chat.fit(turns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_lm_scores": op2_lm_scores,
    "op3_quality_sample": op3_quality_sample,
    "op4_decontamination": op4_decontamination,
    "op5_near_dedup": op5_near_dedup,
    "op6_token_files": op6_token_files,
    "op7_quality_rules": op7_quality_rules,
    "op8_line_dedup": op8_line_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_chat_format": op10_chat_format,
}

ORACLE_SQL: dict[str, str] = {
    "op5_near_dedup": r"""
        WITH RECURSIVE texts AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS s
            FROM texts),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        reached AS (
            SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.m)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(m) AS component_id, doc_id = min(m) AS kept
        FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
    "op7_quality_rules": r"""
        WITH docs AS (
            SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        grams AS (
            SELECT doc_id, unnest(range(1, len(ws) - 1)) AS pos, ws FROM docs),
        windows AS (
            SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, ws[pos] || ' ' || ws[pos + 1] || ' ' || ws[pos + 2]) AS n FROM grams),
        repeats AS (
            SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM windows WHERE n > 1) GROUP BY doc_id),
        counts AS (
            SELECT d.doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                   length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                   (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
            FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM docs) d
            LEFT JOIN repeats r USING (doc_id)),
        failed AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
        hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM failed GROUP BY source),
        total AS (
            SELECT sum(n) AS n, count(*) AS k, sum(f) / sum(n) AS mean, sum(n * (f / n) * (f / n)) / sum(n) AS sq FROM hosts),
        spread AS (SELECT *, greatest(sq - mean * mean - mean * (1 - mean) * k / n, 0.0) AS v FROM total),
        prior AS (
            SELECT mean, CASE WHEN v > 0 THEN least(greatest(mean * (1 - mean) / v - 1, 1.0), n / k) ELSE n / k END AS strength FROM spread),
        verdicts AS (SELECT source, (f + mean * strength) / (n + strength) > 0.9 AS rejected FROM hosts, prior)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
        FROM failed JOIN verdicts ON failed.source IS NOT DISTINCT FROM verdicts.source""",
    "op8_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, l.line, l.pos
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
                 LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) l),
        keyed AS (
            SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        shared AS (
            SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (s.key IS NOT NULL AND doc_id <> s.last) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (s.key IS NULL OR doc_id = s.last), '')) AS kept_sha256
        FROM keyed LEFT JOIN shared s USING (key) GROUP BY doc_id""",
    "op9_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos, len(ws) AS n
            FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
        windows AS (
            SELECT doc_id, pos, n, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g
            FROM words),
        firsts AS (SELECT g, min(doc_id) AS first FROM windows WHERE pos + 12 <= n GROUP BY g),
        hits AS (
            SELECT w.doc_id, w.pos FROM windows w JOIN firsts USING (g) WHERE w.pos + 12 <= w.n AND first < w.doc_id),
        marked AS (
            SELECT w.doc_id, w.pos, w.w, max(h.pos) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
            FROM words w LEFT JOIN hits h ON h.doc_id = w.doc_id AND h.pos = w.pos)
        SELECT d.doc_id, count(m.pos) AS n_words, count(*) FILTER (m.gone) AS n_removed,
               sha256(coalesce(string_agg(m.w, ' ' ORDER BY m.pos) FILTER (NOT m.gone), '')) AS kept_sha256
        FROM documents d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id""",
}
