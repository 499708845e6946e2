"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegate.llm import _common as C


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.token_orc import token_orc_digest

    return token_orc_digest(_read(spark, sf_dir, "documents"), C.scratch(spark, "orc"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.license_scan import scan

    return scan(_read(spark, sf_dir, "documents"))


def op3_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.quality_ledger import apply_policy, ledger

    found = apply_policy(ledger(_read(spark, sf_dir, "documents")), "v2")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.token_scan import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), C.scratch(spark, "flat"), public_tokenizers.path("word_bpe_49k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.toxicity import score

    return score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.langid import identify

    return identify(_read(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.jaccard_join import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), k=3, threshold=(9, 10))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.secret_scan import digest, scan

    return digest(scan(_read(spark, sf_dir, "documents")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.decontaminate import matches

    return matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_orc, op2_license_scan, op3_quality_ledger, op4_token_counts, op5_toxicity, op6_language_id, op7_jaccard_join, op8_secret_scan, op9_decontamination, op10_best_fit_packing)}


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the operators that SQL can express; the others are tested by brute force."""
    op3 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT rid, doc_id, t, {_WORDS.format("t")} AS w, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
places AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM m),
repeated AS (SELECT rid, i FROM places QUALIFY count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
f AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
  len([x FOR x IN w IF regexp_matches(x, '\p{{L}}')]) AS n_letter_words, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_capitals, len(regexp_extract_all(t, '\p{{Nd}}')) AS n_digits
  FROM m LEFT JOIN covered USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 2 * word_chars < 5 * n_words OR word_chars > 15 * n_words
    OR 10 * n_letter_words < 6 * n_words OR 2 * n_capitals > word_chars OR 10 * n_digits > 4 * word_chars) AS kept
FROM f"""
    op7 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT rid, sh FROM (
  SELECT rid, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS sh FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)
  UNION ALL SELECT rid, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
shared AS (SELECT a.rid AS x, b.rid AS y, count(*) AS i FROM s AS a JOIN s AS b USING (sh) WHERE a.rid <> b.rid GROUP BY a.rid, b.rid),
links AS (SELECT x, y FROM shared JOIN n AS p ON p.rid = x JOIN n AS q ON q.rid = y WHERE 100 * i >= 90 * (p.n + q.n - i)),
reach (x, y) AS (SELECT rid, rid FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
least AS (SELECT x, min(doc_id) AS component_id FROM reach JOIN d ON d.rid = y GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN least ON x = rid LEFT JOIN n USING (rid)"""
    return {"op3_quality_ledger": op3, "op7_jaccard_join": op7}
