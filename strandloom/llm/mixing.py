"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order (a digest of the
row) that starts again when it ends, :data:`MAX_REPEATS` rounds at most. A
document's virtual finish time is the number of its source's words up to and
including it, divided by the source's target. A document that would start at
time 1 or later isn't served: its source has its target by then. The others are
served in order of finish time until the total budget is used up.

Both running sums, within a source and over the global order, are two-level:
rows are dealt to ranges of the sort key, only the totals of the ranges are
added up one after the other, and each range is summed by itself. So a source
with a third of all rows is spread over as many tasks as any other rows. The
number of ranges follows the number of rows (:func:`ranges_for`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import count_space_words, materialise, no_null, table

#: A source's words are used this often at most.
MAX_REPEATS = 3
#: Weights dealt to the sources in code-point order, over and over.
WEIGHTS = (1, 2, 3)
#: Seeds the shuffled order.
SEED = "mix-1"
#: Rows meant for each range of a sort key.
RANGE_ROWS = 4096


def ranges_for(rows: int) -> int:
    """Number of ranges: a power of two, so that range limits are exact doubles."""
    return 1 << max(4, (rows // RANGE_ROWS).bit_length())


def digest(text: str = "text") -> Column:
    """Hex digest of (doc_id, source, text); it shuffles and identifies rows."""
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.md5(F.concat_ws("/", F.lit(SEED), either("doc_id"), either("source"), F.md5(no_null(text))))


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, source, size, h); the only step that reads the texts."""
    return docs.select("doc_id", "source", count_space_words(no_null(text)).alias("size"), digest(text).alias("h"))


def targets(sized: DataFrame, weights=WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target), one row per source.

    Water filling: with the sources ordered by limit per weight, the level of a
    source is what is left after all earlier limits, over the weights still
    open. The first source whose level fits under its limit sets the level of
    the whole mix; earlier ones get their limit. The windows hold one row per
    source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    used = F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - used) / open_weight
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight.cast("long"))
        .withColumn("limit", F.col("source_size") * most)
        .withColumn("level", level)
        .withColumn("water", F.first(fits, ignorenulls=True).over(everything))
        .select(
            "source",
            "source_size",
            F.least(F.col("water") * F.col("weight"), F.col("limit").cast("double")).alias("target"),
        )
    )


def _queued(sized: DataFrame, goal: DataFrame, ranges: int) -> DataFrame:
    """Adds the source's sums and ``upto``, the words of the source up to and
    including the document in the first round."""
    part = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * ranges / F.lit(2.0**32)).cast("int")
    placed = sized.withColumn("r", part)
    past = Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("source", "r")
        .agg(F.sum("size").alias("in_range"))
        .select("source", "r", F.coalesce(F.sum("in_range").over(past), F.lit(0)).alias("offset"))
        .alias("o")
        .join(F.broadcast(goal).alias("g") if goal.count() <= 10_000 else goal.alias("g"), F.expr("o.source <=> g.source"))
        .select("o.*", "g.source_size", "g.target")
    )
    inner = Window.partitionBy("source", "r").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("part", F.sum("size").over(inner))
        .alias("d")
        .join(offsets.alias("o"), F.expr("d.source <=> o.source AND d.r = o.r"))
        .selectExpr("d.doc_id", "d.size", "d.h", "o.source_size", "o.target", "o.offset + d.part AS upto")
    )


def _finish(round_: Column) -> Column:
    return (round_ * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")


def _starts(round_: Column) -> Column:
    return (F.col("target") > 0) & (round_ * F.col("source_size") + F.col("upto") - F.col("size") < F.col("target"))


def _cut(queued: DataFrame, budget: int, ranges: int, most: int) -> tuple[float, str]:
    """The last (finish time, digest) within the budget; two driver-side rows."""
    served = (
        queued.where(F.col("size") > 0)
        .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        .where(_starts(F.col("round")))
        .select(_finish(F.col("round")).alias("finish"), "h", "size")
        .withColumn("bin", F.floor(F.least(F.col("finish"), F.lit(2.0)) * ranges))
    )
    run = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = served.groupBy("bin").agg(F.sum("size").alias("in_bin")).withColumn("upto", F.sum("in_bin").over(run))
    over = bins.where(F.col("upto") > budget).orderBy("bin").first()
    if over is None:
        return float("inf"), ""
    order = Window.orderBy("finish", "h").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        served.where(F.col("bin") == over["bin"])
        .withColumn("sum", F.sum("size").over(order))
        .where(F.col("sum") <= budget - (over["upto"] - over["in_bin"]))
        .agg(F.max(F.struct("finish", "h")).alias("x"))
        .first()["x"]
    )
    return (last["finish"], last["h"]) if last else (over["bin"] / ranges, "")


def plan(docs: DataFrame, text: str = "text", weights=WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """One row per input row: doc_id, h, size, source_size, target, copies.

    A null or text without words has size 0 and is never taken; a null source
    is a source of its own, last in order. Equal rows differ in their place in
    the queue only. Needs columns ``doc_id`` and ``source``; others are
    ignored. The result is the same in every run.
    """
    sized = materialise(sizes(docs, text), "sizes")
    rows, budget = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = ranges_for(rows)
    queued = materialise(_queued(sized, targets(sized, weights, most), ranges), "queued")
    finish, h = _cut(queued, budget, ranges, most)
    copies = F.lit(0)
    for k in range(most):
        at = _finish(F.lit(k))
        taken = _starts(F.lit(k)) & ((at < F.lit(finish)) | ((at == F.lit(finish)) & (F.col("h") <= F.lit(h))))
        copies = copies + F.when((F.col("size") > 0) & taken, 1).otherwise(0)
    return queued.select("doc_id", "h", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as the mix takes it."""
    planned = plan(docs, text)
    same = Window.partitionBy("h").orderBy(F.lit(0))
    counts = planned.where("copies > 0").select("h", "copies").withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy(F.desc("copies"))))
    # The input row travels as one struct, so that no name can clash.
    numbered = docs.select(digest(text).alias("h"), F.struct("*").alias("row")).withColumn("n", F.row_number().over(same))
    taken = numbered.join(counts, ["h", "n"]).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    planned = plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def sql_mix(docs: str) -> str:
    """Common table expressions of the same plan; ``docs`` names a relation. The
    last one, ``mixed``, has the planned rows with their copies."""
    return rf"""
sized AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         md5('{SEED}/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || coalesce(source, 'null') || '/' || md5(coalesce(text, ''))) AS h
  FROM {docs}),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sized GROUP BY source),
lev AS (
  SELECT *, 3 * source_size AS lim,
         CAST((SELECT sum(source_size) FROM src) - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level,
         row_number() OVER o AS rn
  FROM src WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST)),
goal AS (
  SELECT source, source_size,
         least((SELECT level FROM lev WHERE level * weight <= lim ORDER BY rn LIMIT 1) * weight, CAST(lim AS DOUBLE)) AS target FROM lev),
queued AS (
  SELECT s.doc_id, s.size, s.h, g.source_size, g.target,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto,
         row_number() OVER () AS rid
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
served AS (
  SELECT rid, h, size, CAST(k * source_size + upto AS DOUBLE) / target AS finish
  FROM queued, (SELECT unnest([0, 1, 2]) AS k) WHERE size > 0 AND target > 0 AND k * source_size + upto - size < target),
picked AS (
  SELECT rid, count(*) AS copies
  FROM (SELECT rid, sum(size) OVER (ORDER BY finish, h ROWS UNBOUNDED PRECEDING) AS run FROM served)
  WHERE run <= (SELECT sum(size) FROM sized) GROUP BY rid),
mixed AS (SELECT q.*, coalesce(p.copies, 0) AS copies FROM queued q LEFT JOIN picked p USING (rid))"""


ORACLE_SQL = f"""
WITH {sql_mix("documents")}
SELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed
"""
