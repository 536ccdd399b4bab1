"""Secret scan with corpus-wide ownership frequency.

Spans come from one projection per document, built from regular-expression
functions only: the pieces between the matches (``split``) and the matches
(``regexp_extract_all``) give each match's place as a running sum of lengths.

Every candidate value is then counted over the whole corpus by the distinct
owners and repositories that hold it. A value held by many owners, or by many
repositories of a few owners, is a copied example; any other looks live. Base
spans always stay and are only classified; loose candidates (long runs that mix
letters and digits and touch no base span) are added as ``live`` spans if they
look live.

Only the SHA-256 of a value takes part in the counting and nothing secret is
returned. Spans are written once. Frequencies are combined on the map side before
the shuffle, so a value that a third of the corpus repeats costs one row for each
task there; such values get their verdict from a table of the hot ones, all
others by a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import let, materialise, no_null, small, table

# The span kinds in their listed order. The shortest whole match
# of "access" and "hex" is part of the pattern; that of "assign" holds for the
# value and is applied after matching, since a failing match still uses up text.
KINDS = ("assign", "access", "hex", "live")
PATTERNS = {
    "assign": r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "live": r"[A-Za-z0-9+/_-]{20,}",
}
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN = 6

#: A value held by more distinct owners or repositories than this is a copied example.
MAX_OWNERS = 3
MAX_REPOSITORIES = 20
#: A value of more spans than this is hot; a table of up to so many hot values is broadcast.
HOT_SPANS = 10_000
BROADCAST_VALUES = 200_000

KEY = ["k_id", "k_owner", "k_hash"]


def _matches(kind: str, text: Column) -> Column:
    """Array of (kind, n, gap, len, value) for the matches in a text."""
    pattern = F.lit(PATTERNS[kind])
    value = F.regexp_extract_all(text, pattern, F.lit(2 if kind == "assign" else 0))
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)

    def rows(parts: Column) -> Column:
        return F.transform(
            parts["whole"],
            lambda m, i: F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                i.alias("n"),
                F.char_length(F.get(parts["gaps"], i)).cast("long").alias("gap"),
                F.char_length(m).cast("long").alias("len"),
                F.get(parts["value"], i).alias("value"),
            ),
        )

    return let(F.struct(whole.alias("whole"), gaps.alias("gaps"), value.alias("value")), rows)


def _candidates(docs: DataFrame) -> DataFrame:
    """One row per match, before any is dropped; identical rows count once."""
    text = F.col("text")
    low = F.lower(text)
    none = F.array().cast("array<struct<kind:int,n:int,gap:bigint,len:bigint,value:string>>")
    mentions = low.contains(ASSIGN_WORDS[0])
    for word in ASSIGN_WORDS[1:]:
        mentions = mentions | low.contains(word)
    may = {
        "assign": mentions,
        "access": text.contains("AKIA"),
        "hex": text.rlike(PATTERNS["hex"]),
        "live": text.rlike(PATTERNS["live"]),
    }
    found = F.concat(*(F.when(may[k], _matches(k, text)).otherwise(none) for k in KINDS))
    return (
        docs.select(*KEY, F.explode(found).alias("s"))
        .select(*KEY, "s.*")
        .dropDuplicates([*KEY, "kind", "n"])
    )


def _placed(candidates: DataFrame) -> DataFrame:
    """Matches with start, end and value hash; failing ones are gone."""
    until = Window.partitionBy(*KEY, "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(until)
    fits = (
        F.when(F.col("kind") == KINDS.index("assign"), F.char_length("value") >= LEAST_ASSIGN)
        .when(F.col("kind") == KINDS.index("live"), F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))
        .otherwise(F.lit(True))
    )
    return (
        candidates.withColumn("end", end)
        .withColumn("start", F.col("end") - F.col("len"))
        .where(fits)
        .select(*KEY, "kind", "start", "end", F.sha2("value", 256).alias("value"))
    )


def ownership(spans: DataFrame) -> DataFrame:
    """Number of spans, distinct owners and repositories of every candidate value."""
    return spans.groupBy("value").agg(
        F.count("*").alias("spans"), F.count_distinct("k_owner").alias("owners"), F.count_distinct("k_id").alias("repositories")
    )


def _classified(spans: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """Spans with the flag ``example`` in place of their value."""
    example = (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)
    known = materialise(ownership(spans).select("value", "spans", example.alias("example")), "values")
    hot, rest = known.where(F.col("spans") > HOT_SPANS).select("value", "example"), known.where(F.col("spans") <= HOT_SPANS).select("value", "example")
    if hot.isEmpty():
        return spans.join(rest, "value").drop("value")
    hot = small(hot, BROADCAST_VALUES)
    cool = spans.join(hot.select("value"), "value", "left_anti").join(rest, "value")
    return spans.join(hot, "value").unionByName(cool).drop("value")


def scan(
    docs: DataFrame,
    text: str = "text",
    repository: str = "doc_id",
    owner: str = "source",
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row per input row with its spans.

    Null texts are empty and have no span; a null owner or repository is a
    value of its own. Rows equal in repository, owner and text get the same
    result, each in a row of its own. Returns ``doc_id`` (the repository
    column), ``n_assign``, ``n_access``, ``n_hex``, ``n_live``, ``n_example``
    (base spans whose value is a copied example), ``base_sha256`` and ``spans``.
    """
    body = no_null(text)
    slim = docs.select(
        F.col(repository).alias("k_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(owner).cast("string")), F.lit("n")).alias("k_owner"),
        F.xxhash64(body).alias("k_hash"),
        body.alias("text"),
    )
    known = _classified(materialise(_placed(_candidates(slim)), "spans"), max_owners, max_repositories)

    base = F.col("kind") < KINDS.index("live")
    order = Window.partitionBy(*KEY).orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(before, F.col("start")) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    stays = base | (F.col("clear") & ~F.col("example"))
    said = F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1), "start", "end")

    def joined(rows: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(rows), lambda x: x["said"]), ",")

    def number(kind: str) -> Column:
        return F.count(F.when(F.col("kind") == KINDS.index(kind), 1))

    one = F.struct("start", "kind", "said")
    per_doc = (
        known.withColumn("clear", clear)
        .where(stays)
        .withColumn("said", said)
        .groupBy(*KEY)
        .agg(
            *(number(k).alias(f"n_{k}") for k in KINDS),
            F.count(F.when(base & F.col("example"), 1)).alias("n_example"),
            joined(F.collect_list(F.when(base, one))).alias("base"),
            joined(F.collect_list(one)).alias("spans"),
        )
    )
    rows, hits = slim.drop("text").alias("a"), per_doc.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in KEY]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(hits, same, "left").select(
        F.col("a.k_id").alias("doc_id"),
        *(zero(f"n_{k}") for k in KINDS),
        zero("n_example"),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return scan(table(spark, sf_dir, "documents"))


def _sql_kind(kind: str, group: int) -> str:
    pattern = PATTERNS[kind].replace("'", "''")
    return f"""
  SELECT rid, doc_id, owner, {KINDS.index(kind)} AS kind, n,
         length(gaps[n]) AS gap, length(whole[n]) AS len, vals[n] AS value
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS n FROM (
    SELECT rid, doc_id, owner, string_split_regex(text, '{pattern}') AS gaps,
           regexp_extract_all(text, '{pattern}', 0) AS whole, regexp_extract_all(text, '{pattern}', {group}) AS vals
    FROM t WHERE regexp_matches(text, '{pattern}')))"""


ORACLE_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, 'n') AS owner, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_sql_kind(k, 2 if k == "assign" else 0) for k in KINDS)}),
p AS (
  SELECT *, sum(gap + len) OVER (PARTITION BY rid, kind ORDER BY n) AS e FROM m),
s AS (
  SELECT rid, doc_id, owner, kind, CAST(e - len AS BIGINT) AS s, CAST(e AS BIGINT) AS e, value FROM p
  WHERE CASE kind WHEN 0 THEN length(value) >= 6
        WHEN 3 THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') ELSE true END),
o AS (
  SELECT value, count(DISTINCT owner) > {MAX_OWNERS} OR count(DISTINCT doc_id) > {MAX_REPOSITORIES} AS example FROM s GROUP BY value),
k AS (
  SELECT s.*, example,
         kind < 3 OR (NOT example AND NOT EXISTS (
           SELECT 1 FROM s b WHERE b.rid = s.rid AND b.kind < 3 AND b.s < s.e AND b.e > s.s)) AS stays,
         ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || s || ':' || e AS said
  FROM s JOIN o USING (value)),
d AS (
  SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h,
         count(*) FILTER (kind = 3) AS l, count(*) FILTER (kind < 3 AND example) AS x,
         string_agg(said, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(said, ',' ORDER BY s, kind) AS spans
  FROM k WHERE stays GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       coalesce(l, 0) AS n_live, coalesce(x, 0) AS n_example,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN d USING (rid)
"""
