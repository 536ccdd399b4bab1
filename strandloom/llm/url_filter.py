"""URL filters: rules first, then trust and distrust over the host graph.

The rules compile into one CASE expression, longest rule first. Hosts that no
rule decides are judged by two personalised PageRanks over host edges: trust
flows along the edges from the hosts of allowed pages, distrust flows against
them from the hosts of blocked pages. Both run as one table of typed edges and
scores: a join and an aggregation for each round, until no round changes a score
or reaches a host any more. A host is blocked if its distrust exceeds its trust;
both are shares, compared relative to each other, so the number of pages decides
nothing.

Edges are absolute links between different hosts, and, in both directions, the
steps between a host and its parent domain down to two labels. They are combined
on the map side, so a host with a third of all pages costs one row a task.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import let, materialise, no_null, small, table


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    UrlRule("com", "/en/", "block"),
    UrlRule("example.com", "/en/7", "allow"),
    UrlRule("net", "/de/", "allow"),
    UrlRule("example.net", "/de/8", "block"),
    UrlRule("org", "/es/", "block"),
)

DAMPING = 0.85
#: Both walks go on until no score changes by more than this share of it in a round.
TOLERANCE = 5e-4
#: Rounds between two tests of that.
ROUNDS = 15
#: A host is blocked if its distrust exceeds its trust by more than this share.
MARGIN = 0.01
#: A host's edges are dealt to one more salt for each so many of them.
HUB = 100_000
#: A verdict table of up to so many hosts is broadcast; a larger one is joined by shuffle.
BROADCAST_HOSTS = 200_000
LINK = r"(?i:href)\s*=\s*[\"']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\"'<>\s]+)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> Column:
    """Struct (host, path); both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))

    def parts(r: Column) -> Column:
        host = F.regexp_extract(r, r"^[^/?#]*", 0)
        after = F.substring(r, F.char_length(host) + 1, F.char_length(r))
        return F.struct(lower_ascii(host).alias("host"), F.regexp_extract(after, r"^[^?#]*", 0).alias("path"))

    return let(F.coalesce(rest, F.lit("")), parts)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (name, verdict) of the longest fitting rule, or null."""
    result = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        result = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(result)
    return result


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): number of links, or 1 for each step to or from a parent."""
    links = (
        pages.where(F.col("host") != "")
        .select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("dst"))
        .select("src", lower_ascii(F.col("dst")).alias("dst"))
        .where("src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("w"))
    )
    known = pages.select("host").where("host <> ''").distinct().unionAll(links.select("dst").distinct()).distinct()
    labels = known.select(F.split("host", r"\.", -1).alias("x")).where(F.size("x") > 2)
    placed = labels.select("x", F.explode(F.sequence(F.lit(1), F.size("x") - 2)).alias("i"))
    rest = lambda i: F.array_join(F.slice("x", i, F.size("x")), ".")
    steps = placed.select(rest(F.col("i")).alias("child"), rest(F.col("i") + 1).alias("parent")).distinct()
    both = steps.selectExpr("child AS src", "parent AS dst").unionAll(steps.selectExpr("parent AS src", "child AS dst"))
    return links.unionAll(both.withColumn("w", F.lit(1.0))).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _salted(score: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Scores with a salt: 0, or for a hub one row for each of its salts."""
    if hubs is None:
        return score.withColumn("salt", F.lit(0).cast("long"))
    both = score.alias("s").join(small(hubs, BROADCAST_HOSTS).alias("h"), F.expr("s.kind = h.kind AND s.host = h.src"), "left")
    return both.selectExpr("s.kind", "s.host", "s.score", "explode(sequence(0L, coalesce(h.salts, 1L) - 1L)) AS salt")


def host_scores(pages: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) once both walks have settled.

    Rounds go on until one reaches no new host and changes no score by more than
    ``tolerance`` of it. ``pages`` has host, html and verdict (null where no rule
    fits).
    """
    edges = materialise(host_edges(pages), "host-edges")
    typed = edges.selectExpr("'trust' AS kind", "src", "dst", "w").unionAll(
        edges.selectExpr("'distrust' AS kind", "dst AS src", "src AS dst", "w")
    )
    out = materialise(typed.groupBy("kind", "src").agg(F.sum("w").alias("all_w"), (1 + F.floor(F.count("*") / HUB)).alias("salts")), "host-degrees")
    hubs = out.where("salts > 1").select("kind", "src", "salts")
    hubs = None if hubs.isEmpty() else hubs
    shares = typed.join(out, ["kind", "src"]).selectExpr("kind", "src", "dst", f"w / all_w * {DAMPING!r} AS share", "pmod(xxhash64(dst), salts) AS salt")
    shares = materialise(shares, "host-shares")
    seeds = (
        pages.where("host <> '' AND verdict IS NOT NULL")
        .groupBy(F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host")
        .agg(F.count("*").cast("double").alias("n"))
    )
    total = seeds.groupBy("kind").agg(F.sum("n").alias("all_n"))
    seeds = materialise(seeds.join(total, "kind").selectExpr("kind", "host", "n / all_n AS score"), "host-seeds")
    start = seeds.selectExpr("kind", "host", f"score * {1 - DAMPING!r} AS score")

    def step(score: DataFrame) -> DataFrame:
        moved = _salted(score, hubs).alias("s").join(shares.alias("e"), F.expr("s.kind = e.kind AND s.host = e.src AND s.salt = e.salt"))
        moved = moved.selectExpr("e.kind", "e.dst AS host", "s.score * e.share AS score")
        return start.unionAll(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))

    score, settled = seeds, False
    while not settled:
        for _ in range(ROUNDS):
            score = step(score)
        old = materialise(score, "host-scores")
        score = materialise(step(old), "host-scores")
        change = score.alias("n").join(old.alias("o"), F.expr("n.kind = o.kind AND n.host = o.host"), "left")
        settled = change.where(F.col("o.score").isNull() | (F.abs(F.col("n.score") - F.col("o.score")) > tolerance * F.col("n.score"))).isEmpty()
    side = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)
    return score.groupBy("host").agg(side("trust"), side("distrust"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    Pages whose host is empty or that neither walk reaches have no distrust and
    are allowed unless a rule blocks them. Null html has no links. Repeated rows
    come out repeated.
    """
    parsed = pages.select("page_id", host_and_path(F.col("url")).alias("u"), no_null("html").alias("html"))
    parsed = parsed.select("page_id", "u.host", "u.path", "html")
    ruled = parsed.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    scores = host_scores(ruled.select("host", "html", F.col("r.verdict").alias("verdict")))
    bad = scores.where(F.col("distrust") > F.col("trust") * (1 + MARGIN)).select("host", F.lit(True).alias("bad"))
    bad = small(materialise(bad, "host-verdicts"), BROADCAST_HOSTS)
    return ruled.join(bad, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("r.name").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the rules, else of the host graph, on every page."""
    return judge(table(spark, sf_dir, "pages"))


def _sql_rules(value) -> str:
    cases = [
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value(r)}'"
        for r in sorted(RULES, key=lambda r: -len(r.name))
    ]
    return "CASE " + " ".join(cases) + " END"


#: Rounds of the walks in SQL; what is left after them is far below the margin.
_SQL_ROUNDS = 150

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
_SQL_LINK = LINK.replace("'", "''")

ORACLE_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS html,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT rid, page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM raw),
p AS (SELECT *, {_sql_rules(lambda r: r.name)} AS rule, {_sql_rules(lambda r: r.verdict)} AS said FROM u),
l0 AS (
  SELECT rid, host AS src, unnest(list_distinct(regexp_extract_all(html, '{_SQL_LINK}', 1))) AS dst FROM p WHERE host <> ''),
links AS (
  SELECT src, translate(dst, '{_UPPER}', '{_LOWER}') AS dst, count(*) AS w FROM l0
  WHERE src <> translate(dst, '{_UPPER}', '{_LOWER}') GROUP BY ALL),
known AS (SELECT host FROM p WHERE host <> '' UNION SELECT dst FROM links),
lab AS (SELECT string_split(host, '.') AS x FROM known),
steps AS (
  SELECT DISTINCT array_to_string(x[i:], '.') AS child, array_to_string(x[i + 1:], '.') AS parent
  FROM (SELECT x, unnest(range(1, len(x) - 1)) AS i FROM lab)),
edges AS (
  SELECT src, dst, CAST(sum(w) AS DOUBLE) AS w FROM (
    SELECT src, dst, w FROM links UNION ALL SELECT child, parent, 1 FROM steps UNION ALL SELECT parent, child, 1 FROM steps)
  GROUP BY ALL),
typed AS (SELECT 'trust' AS kind, src, dst, w FROM edges UNION ALL SELECT 'distrust', dst, src, w FROM edges),
shares AS (SELECT kind, src, dst, w / sum(w) OVER (PARTITION BY kind, src) AS share FROM typed),
n AS (
  SELECT CASE said WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM p
  WHERE host <> '' AND said IS NOT NULL GROUP BY ALL),
seeds AS (SELECT kind, host, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY kind) AS score FROM n),
moves AS (  -- a host '*' that keeps its score and feeds the seeds in every round
  SELECT kind, src, dst, share * {DAMPING!r} AS share FROM shares
  UNION ALL SELECT kind, '*', host, score * {1 - DAMPING!r} FROM seeds
  UNION ALL SELECT DISTINCT kind, '*', '*', 1.0 FROM seeds),
begin AS (SELECT 0 AS k, kind, host, score FROM seeds UNION ALL SELECT DISTINCT 0, kind, '*', 1.0 FROM seeds),
walk AS (
  SELECT k, kind, host, CAST(score AS DOUBLE) AS score FROM begin
  UNION ALL
  SELECT w.k + 1, w.kind, e.dst, sum(w.score * e.share) FROM walk w JOIN moves e ON w.kind = e.kind AND w.host = e.src
  WHERE w.k < {_SQL_ROUNDS} GROUP BY ALL),
bad AS (
  SELECT host FROM walk WHERE k = {_SQL_ROUNDS} AND host <> '*' GROUP BY host
  HAVING coalesce(sum(score) FILTER (kind = 'distrust'), 0) > coalesce(sum(score) FILTER (kind = 'trust'), 0) * {1 + MARGIN!r})
SELECT page_id, host, path, rule,
       coalesce(said, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM p
"""
