"""Quality rules as a short-circuit cascade in DataFrame functions only.

Each rule is a condition that rejects a text. On a sample every rule's cost (seconds a row) and selectivity (share of
rows it rejects) are measured; rules run in the order of rejections per cost, and a row that one rule rejects is not
looked at by the later ones (CASE WHEN evaluates its branches lazily). The order changes the cost only: a text is
kept when no rule rejects it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rows of the sample on which rules are measured.
SAMPLE_ROWS = 2000


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, first ones included.

    Windows' hashes are sorted with their places only if some hash repeats; equal neighbours mark places.
    """

    def places(hashes):
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return common.let(by_hash, marked)

    def marked(rows):
        n = F.size(rows)

        def repeated(row, k):
            before = (k > 0) & (rows[F.greatest(k - 1, F.lit(0))]["h"] == row["h"])
            after = (k < n - 1) & (rows[F.least(k + 1, n - 1)]["h"] == row["h"])
            return before | after

        hits = F.transform(F.filter(rows, repeated), lambda r: r["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array(i, i + 1, i + 2)))))

    def count(w):
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return common.let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(places(h)))

    return F.when(F.size(words) < 3, 0).otherwise(common.let(words, count))


def measured(docs: DataFrame) -> DataFrame:
    """docs with the base measures of every whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def measures(w):
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(common.WORD))
        return common.let(
            lines,
            lambda rows: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
                F.size(rows).cast("long").alias("n_lines"),
                repeat_words(w).cast("long").alias("n_repeat_words"),
            ),
        )

    (mine,) = common.free_names(docs.columns, "m")
    return docs.withColumn(mine, common.let(common.words_of(F.col("text")), measures)).select("*", f"{mine}.*").drop(mine)


@dataclass(frozen=True)
class Rule:
    """A name and the condition under which a text is rejected."""

    name: str
    rejects: Column


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> list[Rule]:
    """The rules after the base ones, over the columns of measured()."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 20 * F.col("n_words")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 14 * F.col("n_words"))),
        Rule("dup_lines", 100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
        Rule("shouting", 2 * F.regexp_count(text, F.lit(r"\p{Lu}")) > F.regexp_count(text, F.lit(r"\p{L}"))),
        Rule("exclaiming", 4 * F.regexp_count(text, F.lit(r"[!?]{2,}")) > F.col("n_words")),
        Rule("no_letters", 2 * F.regexp_count(text, F.lit(r"\p{L}")) < F.char_length(text)),
    ]


def ordered(docs: DataFrame, cascade: list[Rule], sample_rows: int = SAMPLE_ROWS, seed: int = 0) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, seconds a row) by rejections per cost, measured on a random sample of about sample_rows rows."""
    total = docs.count()
    if not total:
        return [(rule, 0.0, 0.0) for rule in cascade]
    sample = docs.sample(min(1.0, sample_rows / total), seed)
    sample = common.materialize(measured(sample.select("text")), "sample")
    rows, found = sample.count(), []

    def seconds(condition) -> tuple[int, float]:
        """Rows that fulfil a condition, and the least time of three jobs, so that start-up and warm-up don't count."""
        best = None
        for _ in range(3):
            began = time.perf_counter()
            hits = sample.agg(F.count_if(condition)).first()[0]
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        return hits, best

    _, empty = seconds(F.col("n_words") < 0)  # a job that looks at no text
    for rule in cascade:
        hits, took = seconds(rule.rejects)
        found.append((rule, hits / max(rows, 1), max(took - empty, 1e-6) / max(rows, 1)))
    return sorted(found, key=lambda x: -x[1] / x[2])


def apply_rules(docs: DataFrame, cascade: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the measures, base_failed and kept. Which rule rejects first depends on the measured order, so it is not returned.

    Null and blank texts have no words and fail the base rule. Repeated rows are judged alike; an empty table gives
    no rows. Columns of docs that bear the name of a measure are replaced.
    """
    order = [rule for rule, _, _ in ordered(docs, cascade if cascade is not None else rules(), sample_rows)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed", "kept"]
    rows = measured(docs.drop(*names)).withColumn("base_failed", base_failed())
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule in order:
        verdict = verdict.when(rule.rejects, F.lit(rule.name))
    return rows.withColumn("kept", verdict.isNull())


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_OP1 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1)
  GROUP BY doc_id
), m AS (
  SELECT d.doc_id, d.text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         len(regexp_extract_all(text, '\p{Lu}')) AS upper_n, len(regexp_extract_all(text, '\p{L}')) AS letters_n,
         len(regexp_extract_all(text, '[!?]{2,}')) AS shouts FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR 2 * upper_n > letters_n OR 4 * shouts > n_words
            OR 2 * letters_n < length(text)) AS kept
FROM b
"""
