"""Cross-site boilerplate lines by distinct-site spread.

A line (trimmed of ASCII white space, with at least one word) is boilerplate if
it stands in documents of at least :data:`MIN_SITES` different sites.

1. Texts are cut into lines once; places, sites and hashes of the lines are written.
2. Smallest and largest site of each line, combined on the map side: a line of
   one site can't be boilerplate and goes no further.
3. HyperLogLog sketches of the sites of each remaining line, built on the map side
   straight from the lines and merged by aggregation.
4. Lines whose estimate is within :data:`BAND` of the threshold get an exact
   distinct count; the sketch decides the others.
5. Places of boilerplate lines are gathered by document and cut out of the texts.

A line that a third of all documents have costs one row per task in steps 2 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import SPACES, let, materialise, no_null, small, table

MIN_SITES = 6
#: Sketches have 2**LG_K registers: a relative error of about 1.04 / 2**(LG_K / 2).
LG_K = 10
#: Relative distance from the threshold within which lines are counted exactly.
BAND = 0.25
#: Line tables of up to so many rows (16 bytes each) are broadcast.
BROADCAST_LINES = 300_000
#: Tables of up to so many documents that lose lines are broadcast.
BROADCAST_DOCUMENTS = 200_000

KEY = ["k_id", "k_hash"]
LINE = ["h", "g"]


def _keyed(docs: DataFrame, text: str, site: str) -> DataFrame:
    body = no_null(text)
    return docs.select(
        F.col("doc_id").alias("k_id"),
        F.xxhash64(body).alias("k_hash"),
        F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("n"))).alias("site"),
        body.alias("text"),
    )


def _lines(rows: DataFrame) -> DataFrame:
    """(key, site, pos, h, g): every line with a word, by two hashes."""
    parts = F.transform(
        F.split("text", "\n", -1), lambda x, i: let(F.btrim(x, F.lit(SPACES)), lambda t: F.struct(i.alias("pos"), F.xxhash64(t).alias("h"), F.hash(t).alias("g"), (t != "").alias("word")))
    )
    return rows.select(*KEY, "site", F.explode(parts).alias("x")).where("x.word").select(*KEY, "site", "x.pos", "x.h", "x.g")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, g) of those ``lines`` (h, g, site) that at least ``min_sites`` sites have."""
    spread = lines.groupBy(*LINE).agg(F.min("site").alias("a"), F.max("site").alias("b"))
    shared = materialise(spread.where("a <> b").select(*LINE), "shared-lines")
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K)))
    sketched = lines.join(small(shared, BROADCAST_LINES), LINE).groupBy(*LINE).agg(estimate.alias("sites"))
    sketched = materialise(sketched, "line-spread")
    sure = sketched.where(F.col("sites") > min_sites * (1 + BAND)).select(*LINE)
    near = sketched.where(F.col("sites").between(min_sites * (1 - BAND), min_sites * (1 + BAND))).select(*LINE)
    exact = lines.join(small(near, BROADCAST_LINES), LINE).groupBy(*LINE).agg(F.count_distinct("site").alias("sites"))
    return sure.unionAll(exact.where(F.col("sites") >= min_sites).select(*LINE))


def strip(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_text of every row.

    Null and empty texts have no lines; a null site is a site of its own. Lines
    without a word stay. Repeated rows come out repeated; other columns are
    ignored.
    """
    rows = _keyed(docs, text, site)
    lines = materialise(_lines(rows), "lines")
    bad = materialise(boilerplate(lines.select(*LINE, "site"), min_sites), "boilerplate")
    gone = lines.join(small(bad, BROADCAST_LINES), LINE).groupBy(*KEY).agg(F.collect_set("pos").alias("gone"))
    gone = small(materialise(gone, "places"), BROADCAST_DOCUMENTS)
    a, b = rows.alias("a"), gone.alias("b")
    joined = a.join(b, F.expr("a.k_id <=> b.k_id AND a.k_hash = b.k_hash"), "left")
    parts = F.split("a.text", "\n", -1)
    none = F.array().cast("array<int>")

    def kept(x):
        places = F.array_except(F.transform(x, lambda _, i: i), F.coalesce(F.col("b.gone"), none))
        words = F.size(F.filter(x, lambda t: F.btrim(t, F.lit(SPACES)) != ""))
        return F.struct(words.cast("long").alias("n"), F.array_join(F.transform(places, lambda i: F.get(x, i)), "\n").alias("t"))

    return joined.select(
        F.col("a.k_id").alias("doc_id"), let(parts, kept).alias("x"), F.coalesce(F.size("b.gone"), F.lit(0)).cast("long").alias("n_removed")
    ).select("doc_id", F.col("x.n").alias("n_lines"), "n_removed", F.col("x.t").alias("kept_text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate lines removed from every document."""
    stripped = strip(table(spark, sf_dir, "documents"))
    return stripped.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, 'n') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT rid, site, i, regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
  FROM (SELECT rid, site, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
b AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
k AS (
  SELECT rid, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (bad) AS n_removed
  FROM (SELECT l.rid, l.i, l.line, b.line IS NOT NULL AS bad FROM l LEFT JOIN b USING (line)) GROUP BY rid),
t AS (
  SELECT l.rid, string_agg(d.ls[l.i], chr(10) ORDER BY l.i) AS kept FROM l JOIN d USING (rid)
  WHERE l.line NOT IN (SELECT line FROM b) GROUP BY l.rid)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN k USING (rid) LEFT JOIN t USING (rid)
"""
