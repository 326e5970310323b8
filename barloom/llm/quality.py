"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once for each document and stores the failure
bits beside the measurements. A policy is a version and the rules it enforces;
``verdict`` applies one to a ledger, ``ablations`` counts what each rule alone
decides, both from the stored bits: no text is read again.

Defined results: a null or empty text has no words and fails ``few_words``;
rows with a null doc_id keep their row; repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.native import let, window_hashes, words

WINDOW = 8


def _repeated(hashes: Column) -> Column:
    """Words covered by windows whose hash comes twice or more."""

    def covered(h: Column) -> Column:
        tagged = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = let(
            tagged,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        s,
                        lambda x, j: (x["h"] == F.get(s, j + 1)["h"]).eqNullSafe(True)
                        | ((j > 0) & (x["h"] == F.get(s, F.greatest(j - 1, F.lit(0)))["h"])),
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


#: Failure bit of each rule and its condition on the measurements.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 20"),
    "repeated_windows": (1, "100 * n_repeat_words > 30 * n_words"),
    "symbols": (2, "10 * n_symbols > 3 * n_words"),
    "repeated_lines": (3, "2 * n_dup_lines > n_lines"),
    "long_words": (4, "word_chars > 14 * n_words"),
    "short_words": (5, "2 * word_chars < 5 * n_words"),
    "capitals": (6, "2 * n_capitals > word_chars"),
}
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r][0] for r in self.rules)


BASE_POLICY = Policy("base", BASE)
POLICY = Policy("2024-1", tuple(RULES))


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id (or ``keep``) and the measurements of each text."""
    columns = keep or ("doc_id",)
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(*columns, text.alias("_text"), words(text).alias("_words"))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\r\x0b\x0c", "    "))) > 0)
    counted = split.select(
        *columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("_lines"),
        _repeated(window_hashes(F.col("_words"), WINDOW)).alias("n_repeat_words"),
    )
    return counted.select(
        *columns,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.col("_lines.n") - F.col("_lines.d")).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        "n_capitals",
        F.col("_lines.n").cast("long").alias("n_lines"),
    )


def ledger(docs: DataFrame, *keep: str) -> DataFrame:
    """Measurements and ``fail_bits``: bit ``RULES[r][0]`` is set if rule r fails."""
    bits = F.lit(0).cast("long")
    for bit, condition in RULES.values():
        bits = bits + F.when(F.expr(condition), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))
    return measured(docs, *keep).withColumn("fail_bits", bits)


def verdict(rows: DataFrame, policy: Policy = POLICY, column: str = "kept") -> DataFrame:
    return rows.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablations(rows: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """For each rule of the policy: documents failing it, failing it alone (kept without it), and all.

    The ledger shrinks to one row for each pattern of bits before anything else.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).cast("long").alias("bit")) for r in policy.rules))
    held = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    return (
        patterns.select("n", held.alias("held"), F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("held").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failing"),
            F.sum(F.when(F.col("held") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_kept_without"),
            F.sum("n").alias("n_documents"),
        )
        .withColumn("policy", F.lit(policy.version))
    )


def keep_good(docs: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """The documents that the policy keeps, with their own columns."""
    names = docs.columns
    text = [f"`{c}`" for c in names]
    boxed = docs.select(F.struct(*text).alias("_row"), F.col("text"))
    kept = verdict(ledger(boxed, "_row"), policy).filter("kept")
    return kept.select(*(F.col("_row").getField(c).alias(c) for c in names))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = verdict(verdict(ledger(docs), BASE_POLICY, "_base"), POLICY)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base")).alias("base_failed"), "kept", "fail_bits"
    )


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS BIGINT) AS n_capitals,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 3 * n_words
            OR 2 * n_dup_lines > n_lines OR word_chars > 14 * n_words OR 2 * word_chars < 5 * n_words
            OR 2 * n_capitals > word_chars) AS kept,
       CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT + 8 * (2 * n_dup_lines > n_lines)::INT
            + 16 * (word_chars > 14 * n_words)::INT + 32 * (2 * word_chars < 5 * n_words)::INT + 64 * (2 * n_capitals > word_chars)::INT AS BIGINT) AS fail_bits
FROM m
"""
