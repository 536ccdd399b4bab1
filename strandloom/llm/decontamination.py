"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is a set of windows (10 consecutive words, or the whole item
if it has fewer); a window is the sequence of its word shingles. Containment of
a whole window needs every shingle of it, so a prefix of one shingle is enough:

1. One pass over the texts keeps the places of shingles that the benchmark has.
2. Shingles are ordered by rarity, their frequency over all documents; the
   prefix of each window is its rarest shingle. A window with a shingle that no
   document has can't occur and goes.
3. Positional and length bounds: only runs of consecutive places that are long
   enough for a window stay, and a prefix at a place fixes where its window
   must start and end.
4. Candidates are verified shingle by shingle on the strings themselves.

The benchmark side is broadcast only below :data:`BROADCAST_ROWS`; beyond that
the same joins run as shuffled joins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import let, materialise, no_null, small, table

WINDOW = 10
SHINGLE = 3
#: Places of a document are handled in pieces of so many, overlapping by a window.
PIECE = 256
#: Largest benchmark-side table, in rows of some 100 bytes, that is broadcast.
BROADCAST_ROWS = 500_000
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["k_id", "k_hash"]


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; the built-in is used where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words_of(text: Column) -> Column:
    """The ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` words, A-Z lower-cased."""
    return F.filter(F.split(lower_ascii(text), BREAKS), lambda w: w != "")


def _shingles(words: Column, q: int) -> Column:
    """All runs of ``q`` words, in order; empty with fewer words."""

    def runs(w: Column) -> Column:
        return F.when(
            F.size(w) >= q,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - q), lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(q)))
            ),
        ).otherwise(F.array().cast("array<string>"))

    return let(words, runs)


def windows_of(items: DataFrame) -> DataFrame:
    """(item, q, length, shingles) of every distinct window of the benchmark."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(no_null("text")).alias("w"))
    words = words.where(F.size("w") > 0)
    windows = words.select(
        "item",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1))), lambda i: F.slice("w", i, WINDOW)
            )
        ).alias("w"),
    ).withColumn("q", F.least(F.size("w"), F.lit(SHINGLE)))
    shingles = F.when(F.col("q") == SHINGLE, _shingles(F.col("w"), SHINGLE)).otherwise(F.array(F.array_join("w", " ")))
    return windows.select("item", "q", F.size("w").alias("length"), shingles.alias("shingles")).distinct()


def _places(docs: DataFrame, vocabulary: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, q, pos, shingle) where a document has a shingle of the benchmark."""
    known = small(vocabulary, BROADCAST_ROWS)
    parts = [
        docs.select(*KEY, F.posexplode(_shingles(F.col("words"), q)).alias("pos", "shingle"))
        .withColumn("q", F.lit(q))
        .join(known.where(F.col("q") == q).select("shingle"), "shingle")
        for q in lengths
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select(*KEY, "q", "pos", "shingle")


def _prefixed(windows: DataFrame, places: DataFrame) -> DataFrame:
    """Windows that can occur, with their rarest shingle and its offset."""
    rarity = places.groupBy("q", "shingle").agg(F.count("*").alias("n"))
    return (
        windows.select("*", F.posexplode("shingles").alias("offset", "shingle"))
        .join(rarity, ["q", "shingle"])
        .groupBy("window", "q", "length", "shingles")
        .agg(F.count("*").alias("known"), F.min(F.struct("n", "shingle", "offset")).alias("rarest"))
        .where(F.col("known") == F.size("shingles"))
        .select("window", "q", "length", "shingles", F.col("rarest.shingle").alias("prefix"), F.col("rarest.offset").alias("offset"))
    )


def occurrences(docs: DataFrame, items: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(k_id, k_hash, window, start, length) where windows occur, and (window, item).

    Rows equal in id and text share a key and are reported once. A window that
    many items share is one window; its items stay in the second table.
    """
    owned = materialise(windows_of(items), "item-windows")
    windows = owned.select("q", "length", "shingles").distinct().withColumn("window", F.monotonically_increasing_id())
    windows = materialise(windows, "windows")
    owners = owned.join(windows, ["q", "length", "shingles"]).select("window", "item")
    lengths = sorted(r["q"] for r in windows.select("q").distinct().collect())  # at most SHINGLE of them
    spark = docs.sparkSession
    if not lengths:
        none = spark.createDataFrame([], docs.select("doc_id").schema)
        return none.selectExpr("doc_id AS k_id", "CAST(0 AS BIGINT) AS k_hash", "CAST(0 AS BIGINT) AS window", "0 AS start", "0 AS length"), owners
    least = {r["q"]: r["m"] for r in windows.groupBy("q").agg(F.min(F.size("shingles")).alias("m")).collect()}
    body = no_null(text)
    slim = docs.select(F.col("doc_id").alias("k_id"), F.xxhash64(body).alias("k_hash"), words_of(body).alias("words"))
    vocabulary = windows.select("q", F.explode("shingles").alias("shingle")).distinct()
    places = materialise(_places(slim, vocabulary, lengths), "places")
    prefixed = materialise(_prefixed(windows, places), "prefixed")

    in_order = Window.partitionBy(*KEY, "q").orderBy("pos")
    run = Window.partitionBy(*KEY, "q", "run")
    need = F.element_at(F.create_map(*(F.lit(x) for k in least for x in (k, least[k]))), F.col("q"))
    long_runs = (
        places.dropDuplicates([*KEY, "q", "pos"])
        .withColumn("run", F.col("pos") - F.row_number().over(in_order))
        .withColumn("n", F.count("*").over(run))
        .where(F.col("n") >= need)
    )
    reach = F.array_distinct(F.array(F.floor(F.col("pos") / PIECE), F.floor(F.greatest(F.col("pos") - WINDOW, F.lit(0)) / PIECE)))
    pieces = (
        long_runs.withColumn("piece", F.explode(reach))
        .groupBy(*KEY, "q", "piece")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "shingle"))).alias("at"))
    )
    found = (
        pieces.withColumn("x", F.explode("at"))
        .join(small(prefixed, BROADCAST_ROWS).alias("p"), (F.col("x.shingle") == F.col("p.prefix")) & (pieces["q"] == F.col("p.q")))
        .withColumn("start", F.col("x.pos") - F.col("p.offset"))
        .where(F.floor(F.col("start") / PIECE) == F.col("piece"))
    )
    inside = F.filter("at", lambda e: (e["pos"] >= F.col("start")) & (e["pos"] < F.col("start") + F.size("p.shingles")))
    same = F.transform(inside, lambda e: e["shingle"]) == F.col("p.shingles")
    return found.where(same).select(*KEY, "p.window", "start", "p.length").distinct(), owners


def flagged(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """One row per contaminated (id, text): key, n_hit, items."""
    hits, owners = occurrences(docs, items, text)
    hits = materialise(hits, "hits")
    order = Window.partitionBy(*KEY).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.col("past"), F.col("start"))))
    words = hits.withColumn("past", F.max(end).over(order)).withColumn("fresh", fresh).groupBy(*KEY).agg(F.sum("fresh").cast("long").alias("n_hit"))
    held = hits.select(*KEY, "window").distinct().join(small(materialise(owners, "owners"), BROADCAST_ROWS), "window")
    held = held.groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("items")).alias("i")
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"i.{c}")) for c in KEY]
    return words.alias("w").join(held, same).select("w.*", "i.items")


def judge(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """One row per input row with its hit words and the items it contains.

    Null and empty texts have no words and are clean; an item without words has
    no window. A null item id reads as an empty string. Repeated rows come out
    repeated; other columns are ignored.
    """
    body = no_null(text)
    rows = docs.select(F.col("doc_id").alias("k_id"), F.xxhash64(body).alias("k_hash"), F.size(words_of(body)).cast("long").alias("n_words"))
    hits = flagged(docs, items, text)
    a, b = rows.alias("a"), hits.alias("b")
    joined = a.join(b, F.expr("a.k_id <=> b.k_id AND a.k_hash = b.k_hash"), "left")
    ids = F.coalesce(F.col("b.items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("b.n_hit"), F.lit(0)).cast("long")
    return joined.select(
        F.col("a.k_id").alias("doc_id"),
        "a.n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window."""
    hits = materialise(occurrences(docs, items, text)[0].select(*KEY).distinct(), "contaminated").alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.k_id")) & (F.xxhash64(no_null(F.col(f"a.`{text}`"))) == F.col("b.k_hash"))
    return docs.alias("a").join(small(hits, BROADCAST_ROWS), same, "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_words(relation: str, id_column: str) -> str:
    return (
        f"SELECT row_number() OVER () AS rid, {id_column}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), "
        rf"'{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM {relation}"
    )


def sql_hits(docs: str) -> str:
    """Common table expressions; the last, ``judged``, has one row per row of ``docs``."""
    return rf"""
d AS ({_sql_words(docs, "doc_id")}),
b AS ({_sql_words("benchmark", "coalesce(CAST(item_id AS VARCHAR), '') AS item")}),
bw AS (
  SELECT DISTINCT item, w FROM (
    SELECT item, ws[i:i + 9] AS w FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0))),
ln AS (SELECT DISTINCT len(w) AS n FROM bw),
dw AS (
  SELECT rid, n, i, ws[i:i + n - 1] AS w
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ln WHERE len(ws) >= n)),
hit AS (SELECT rid, item, n, i FROM dw JOIN bw ON dw.w = bw.w),
per AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid),
judged AS (
  SELECT d.rid, d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
         sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN per USING (rid) LEFT JOIN its USING (rid))"""


ORACLE_SQL = f"WITH {sql_hits('documents')} SELECT * EXCLUDE (rid) FROM judged"
