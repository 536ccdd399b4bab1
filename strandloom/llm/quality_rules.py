"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is a row of :data:`RULES`: a numerator, a denominator, and the
least and greatest quotient that passes. :func:`verdict` turns the table into
a single boolean column made of built-in functions only, so the whole operator
is one scan with one projection: no shuffle, no join and no user function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import SPACES, let, no_null, space_words, table

# Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in that is with a for it as on by this was be are from have "
    "de la le les et des en que un une du qui dans pour est au "
    "der die und das von zu mit ein eine den nicht ist auf sich "
    "el los las y del se por con para al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; a zero denominator passes."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: The default table. Columns named here are those of :func:`measures`.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.3),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.02, None),
    Rule("digits_per_character", "n_digits", "word_chars", None, 0.3),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
)

SYMBOLS = "#*$%&|<>"
BULLETS = "-*•"
ELLIPSES = ("...", "…")


def _repeat_words(words: Column) -> Column:
    """Words that stand in a 3-word window found at least twice.

    Windows are sorted with their positions; equal neighbours are repeats. The
    sort runs only where the number of distinct windows shows a repeat.
    """

    def grams(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )

    def covered(g: Column) -> Column:
        placed = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = F.filter(
                s,
                lambda e, k: F.coalesce(F.get(s, k - 1)["g"] == e["g"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["g"] == e["g"], F.lit(False)),
            )
            return F.transform(again, lambda e: e["i"])

        def spread(p: Column) -> Column:
            return F.size(
                F.array_union(F.array_union(p, F.transform(p, lambda i: i + 1)), F.transform(p, lambda i: i + 2))
            )

        return let(let(placed, starts), spread)

    def count(w: Column) -> Column:
        return let(
            grams(w),
            lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0)),
        )

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, count))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append the measured columns to ``docs``.

    A null or empty text has no words, no lines with a word and zeros
    throughout. Columns of ``docs`` keep their names; the measures are appended
    as a struct ``m``, so that no name can clash.
    """
    body = no_null(text)
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    words = space_words(body)

    def bullet(line: Column) -> Column:
        return F.substring(F.ltrim(line, F.lit(SPACES)), 1, 1).isin(list(BULLETS))

    def ellipsis(line: Column) -> Column:
        end = F.rtrim(line, F.lit(SPACES))
        return F.endswith(end, F.lit(ELLIPSES[0])) | F.endswith(end, F.lit(ELLIPSES[1]))

    parts = F.struct(
        F.char_length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.char_length(body) - F.char_length(F.translate(body, "0123456789", ""))).cast("long").alias("n_digits"),
        let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n"),
                F.size(F.array_distinct(x)).cast("long").alias("d"),
                F.size(F.filter(x, bullet)).cast("long").alias("b"),
                F.size(F.filter(x, ellipsis)).cast("long").alias("e"),
            ),
        ).alias("l"),
        let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n"),
                _repeat_words(w).cast("long").alias("r"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(sorted(set(STOP_WORDS))))).cast("long").alias("s"),
            ),
        ).alias("w"),
    )
    return docs.withColumn("m", parts)


def verdict(rules=RULES, at=F.col) -> Column:
    """Compile the threshold table into one boolean column.

    ``at`` turns the name of a measure into a column.
    """
    result = F.lit(True)
    for rule in rules:
        above, below = at(rule.numerator), at(rule.denominator)
        passes = F.lit(True)
        if rule.low is not None:
            passes = passes & (above >= F.lit(rule.low) * below)
        if rule.high is not None:
            passes = passes & (above <= F.lit(rule.high) * below)
        result = result & ((below == 0) | passes)
    return result


def judge(docs: DataFrame, rules=RULES, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document with its measures and the verdict.

    ``base_failed``: fewer than 50 words, or more than half of the words in
    repeated 3-word windows. ``kept``: false if ``base_failed``, else whether
    every rule passes. Repeated rows and null ids come out once for each input
    row; other columns of ``docs`` are ignored.
    """
    named = {
        "n_words": F.col("m.w.n"),
        "word_chars": F.col("m.word_chars"),
        "n_symbols": F.col("m.n_symbols"),
        "n_dup_lines": F.col("m.l.n") - F.col("m.l.d"),
        "n_repeat_words": F.col("m.w.r"),
        "n_lines": F.col("m.l.n"),
        "n_stop_words": F.col("m.w.s"),
        "n_digits": F.col("m.n_digits"),
        "n_bullet_lines": F.col("m.l.b"),
        "n_ellipsis_lines": F.col("m.l.e"),
    }
    measured = measures(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))).select(
        "doc_id", *(c.alias(k) for k, c in named.items())
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the default rules on every document."""
    return judge(table(spark, sf_dir, "documents"))


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

ORACLE_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, doc_id, text,
         list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM t),
g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
c AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         coalesce(c.n_repeat_words, 0) AS n_repeat_words,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(list_filter(ws, lambda x: lower(x) IN ({_STOP_SQL}))) AS BIGINT) AS n_stop_words,
         CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS BIGINT) AS n_digits,
         CAST(len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{{2022}}]'))) AS BIGINT) AS n_bullet_lines,
         CAST(len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_ellipsis_lines
  FROM w LEFT JOIN c USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND (n_words = 0 OR (word_chars >= CAST(2.0 AS DOUBLE) * n_words AND word_chars <= CAST(20.0 AS DOUBLE) * n_words
            AND n_symbols <= CAST(0.3 AS DOUBLE) * n_words AND n_stop_words >= CAST(0.02 AS DOUBLE) * n_words
            AND n_digits <= CAST(0.3 AS DOUBLE) * word_chars))
       AND (n_lines = 0 OR (n_dup_lines <= CAST(0.5 AS DOUBLE) * n_lines AND n_bullet_lines <= CAST(0.9 AS DOUBLE) * n_lines
            AND n_ellipsis_lines <= CAST(0.3 AS DOUBLE) * n_lines)) AS kept
FROM m
"""
