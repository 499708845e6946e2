"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations read the stored bits.

DataFrame and SQL functions only. Everything of a document is computed in its own row; nothing is shuffled but the
few counts of an ablation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm import _common as C

_SPACE = r"\x20\x09-\x0D"
#: Rules in order of their bits: name and failure condition on the measurements.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "2 * word_chars < 5 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("few_letter_words", "10 * n_letter_words < 6 * n_words"),
    ("capitals", "2 * n_capitals > word_chars"),
    ("digits", "10 * n_digits > 4 * word_chars"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Policies by version: the rules whose failure drops a document.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["repeated_lines"],
    "v2": (1 << len(RULES)) - 1,
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_capitals", "n_digits"]


def _long(x: Column) -> Column:
    return x.cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES of every whole text.

    A null text counts as empty: all measurements 0. Windows of three words are compared by a 64-bit hash of their
    words, within a document only. Rows keep their doc_id, null or repeated; other columns are ignored.
    """
    rows = C.documents(docs, "doc_id", "text").select(
        "doc_id", "text", F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)").alias("w"),
        F.expr(r"filter(split(text, '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("lines"))
    rows = rows.select(
        "doc_id",
        _long(F.size("w")).alias("n_words"),
        _long(F.length(F.array_join("w", ""))).alias("word_chars"),
        _long(F.expr(r"regexp_count(text, '[#*$%&|<>]')")).alias("n_symbols"),
        _long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _long(F.size("lines")).alias("n_lines"),
        _long(F.expr(r"regexp_count(text, '(?<![^\\x20\\x09-\\x0D])[^\\p{L}\\x20\\x09-\\x0D]*\\p{L}')")).alias("n_letter_words"),
        _long(F.expr(r"regexp_count(text, '\\p{Lu}')")).alias("n_capitals"),
        _long(F.expr(r"regexp_count(text, '\\p{Nd}')")).alias("n_digits"),
        F.expr("CASE WHEN size(w) > 2 THEN transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))) ELSE array() END").alias("windows"))
    # only documents with some window twice sort theirs, as (hash, place); neighbours with equal hashes are repeats
    rows = rows.withColumn("sorted", F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN sort_array(transform(windows, (h, i) -> struct(h, i))) END"))
    rows = rows.withColumn("at", F.expr("sort_array(transform(filter(sorted, (x, j) -> x.h = get(sorted, j - 1).h OR x.h = get(sorted, j + 1).h), x -> x.i))"))
    # each place covers three words, less what the next place covers too
    covered = F.expr("coalesce(aggregate(transform(at, (i, j) -> least(3, coalesce(get(at, j + 1) - i, 3))), 0L, (a, x) -> a + x), 0L)")
    return rows.withColumn("n_repeat_words", covered).select("doc_id", *MEASURES)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES and failed_bits: bit i is set where RULES[i] fails. An empty text fails few_words alone."""
    bits = " + ".join(f"CASE WHEN {rule} THEN {BIT[name]}L ELSE 0L END" for name, rule in RULES)
    return measure(docs).withColumn("failed_bits", F.expr(bits))


def apply_policy(found: DataFrame, version: str = "v2") -> DataFrame:
    """The ledger with base_failed, and kept: no rule of the policy failed. Texts are not read again."""
    return found.withColumn("base_failed", F.col("failed_bits").bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablations(found: DataFrame, version: str = "v2") -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone (kept without it), and with others.

    The ledger is reduced to a count for each combination of failures, before anything is shuffled.
    """
    mask = POLICIES[version]
    combos = found.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name, _ in RULES if BIT[name] & mask])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    return combos.select("bits", "n", rules).groupBy("r.rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("n_alone"),
        F.coalesce(F.bit_or(F.when(hit, F.col("bits"))), F.lit(0)).alias("with_bits"),
    )
