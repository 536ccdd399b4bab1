"""Registered queries of annotation events, containment, path functions and scoring, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import evaluate, simulate, splicing, traversal
from strandloom.plans import tables
from strandloom.plans.checkpoints import folder, written
from strandloom.plans.oracle import PLANTED, SEQS, _encode, _rc
from strandloom.plans.queries import EVENT_K, _events
from strandloom.plans.tables import items, sequences, table
from strandloom.sources import annotation
from strandloom.sources import sequences as Q

#: Flank length of the planted annotation events, and bases between their genes.
FLANK = 21
GENE = 200
#: Digests of a made chromosome, 32 bases each.
DIGESTS = 200


def _chromosomes(spark, sf_dir) -> DataFrame:
    """(chr, seq): a random chromosome for each region."""
    key = F.col("r_regionkey").cast("string")
    seq = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(DIGESTS - 1)), lambda i: F.md5(F.concat_ws("/", key, i.cast("string")))), "")
    return table(spark, sf_dir, "region").select(F.concat(F.lit("chr"), key).alias("chr"), F.translate(seq, "0123456789abcdef", "ACGT" * 4).alias("seq"))


def _annotated(spark, sf_dir) -> str:
    """Folder with a GTF of exons, one of events, and a genome: a gene for each nation.

    By nation key: every fifth event is right, has a short flank, a site that no
    exon has, a site pair of two exons, or lies on the minus strand; of the last
    ten, five have flanks that differ and five none.
    """
    path = folder(spark, "annotated")
    n = F.col("n_nationkey")
    o, kind = n * GENE, F.when(n < 15, n % 5).when(n < 20, 5).otherwise(6)
    left = F.when(kind == 1, o + 31).otherwise(o + 1)
    exon = lambda a, b: F.struct((a).cast("long").alias("s"), (b).cast("long").alias("e"))
    first, middle, last = exon(left, o + 40), exon(o + 61, o + 90), exon(o + 121, o + 160)
    one = F.array(first, middle, last)
    two = F.when(kind == 5, F.array(exon(o + 1, o + 38), middle, last)).otherwise(F.array(first, last))
    rows = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("chr"), F.col("n_regionkey").cast("string")).alias("chr"), n.alias("n"), o.alias("o"), kind.alias("kind"),
        F.explode(F.array(F.struct(F.lit("a").alias("v"), one.alias("exons")), F.struct(F.lit("b").alias("v"), two.alias("exons")))).alias("t"),
    )
    name = F.format_string('gene_id "G%d"; transcript_id "T%d%s"; gene_name "N%d";', "n", "n", F.col("t.v"), "n")
    lines = rows.select("chr", name.alias("attrs"), F.explode("t.exons").alias("e"))
    lines.select(F.concat_ws("\t", "chr", F.lit("made"), F.lit("exon"), F.col("e.s").cast("string"), F.col("e.e").cast("string"), F.lit("."), F.lit("+"), F.lit("."), "attrs")).write.text(f"{path}/exons")

    site = lambda at, mark: F.concat((F.col("o") + at).cast("string"), F.lit(mark))
    pick = lambda *pairs: F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in pairs[:-1]), pairs[-1])
    flanks = F.concat_ws(",", pick((2, site(41, "^")), (4, site(121, "^")), (5, site(61, "-")), (6, site(1, "-")), site(40, "^")), pick((4, site(40, "-")), site(121, "-")))
    exon_chain = F.concat(site(61, "-"), site(90, "^"))
    chain_1 = pick((3, F.concat(site(61, "-"), site(160, "^"))), (4, F.concat(site(90, "-"), site(61, "^"))), (5, site(90, "^")), exon_chain)
    chain_2 = pick((5, site(90, "^")), F.lit(""))
    event = F.format_string('transcript_id "T%da,T%db"; gene_id "E%d"; flanks "%s"; splice_chain "%s,%s";', "n", "n", "n", flanks, chain_1, chain_2)
    events = rows.where("t.v = 'a'").select(F.concat_ws("\t", "chr", F.lit("made"), F.lit("as_event"), F.lit("1"), F.lit("2"), F.lit("."), F.when(F.col("kind") == 4, "-").otherwise("+"), F.lit("."), event))
    events.write.text(f"{path}/events")
    for r in table(spark, sf_dir, "region").select("r_regionkey").collect():  # one file for each chromosome
        name = f"chr{r['r_regionkey']}"
        Q.write_fasta(_chromosomes(spark, sf_dir).where(F.col("chr") == name), f"{path}/genome/{name}.fa", F.col("chr"))
    return path


def _converted(spark, sf_dir) -> DataFrame:
    path = _annotated(spark, sf_dir)
    events = annotation.read_events(spark, f"{path}/events").withColumn("event_id", F.substring("gene_id", 2, 9).cast("int"))
    return splicing.event_bubbles(events, annotation.read_exons(spark, f"{path}/exons"), Q.read_genome(spark, f"{path}/genome"), FLANK)


def event_bubbles(spark, sf_dir):
    """Annotation events as pairs of sequences, or the reason why not."""
    return _converted(spark, sf_dir)


def event_rejections(spark, sf_dir):
    return splicing.rejection_counts(_converted(spark, sf_dir))


def event_fasta(spark, sf_dir):
    """Events written as records of a bubble file, read back."""
    path = folder(spark, "event-fasta")
    splicing.write_events(_converted(spark, sf_dir), path)
    got = Q.read_bubble_fasta(spark, path)
    return got.select("a_header", F.md5("a").alias("a"), "b_header", F.md5("b").alias("b"))


def exon_sites(spark, sf_dir):
    """Exons that begin or end at given places, with the exons next to them."""
    start = F.col("l_partkey") * 10
    exons = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("transcript_id"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end")).distinct()
    near = splicing.neighbours(exons.groupBy("transcript_id", "start").agg(F.max("end").alias("end")))
    ends = exons.where("start % 3 = 0").select("transcript_id", F.col("start").alias("coord"), F.lit("start").alias("kind"))
    ends = ends.unionByName(exons.where("end % 3 = 0").select("transcript_id", F.col("end").alias("coord"), F.lit("end").alias("kind"))).distinct()
    hit = splicing.exon_at(near, ends)
    return hit.join(near.select("transcript_id", "start", F.col("previous.start").alias("previous"), F.col("next.end").alias("next")), ["transcript_id", "start"])


def trimmed_exons(spark, sf_dir):
    """The bases of each exon next to an event, on its left and on its right, where it is long enough."""
    start, end = F.col("l_partkey"), F.col("l_partkey") + F.col("l_quantity").cast("long")
    both = [splicing.trimmed_flanks(start, end, FLANK, left).alias(c) for left, c in ((True, "l"), (False, "r"))]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *both)
    return rows.select("l_orderkey", "l_linenumber", F.col("l.start").alias("left_start"), F.col("l.end").alias("left_end"), F.col("r.start").alias("right_start"), F.col("r.end").alias("right_end"))


def contained_items(spark, sf_dir):
    """Documents that hold a benchmark item as a whole, on either strand."""
    needles = items(spark, sf_dir).select(F.col("unitig_id").alias("id"), F.when(F.col("unitig_id") % 2 == 0, F.col("seq")).otherwise(S.reverse_complement(F.col("seq"))).alias("seq"))
    return evaluate.holders(needles, sequences(spark, sf_dir).select(F.col("read_index").alias("id"), "seq"))


def same_gene_paths(spark, sf_dir):
    """Benchmark items with every 25th base changed (an even id) or every 12th one, searched among the items of their group."""
    rows = items(spark, sf_dir).select(F.col("unitig_id").alias("id"), (F.col("unitig_id") % 5).alias("gene"), "seq")
    step = F.when(F.col("id") % 2 == 0, 25).otherwise(12)
    letters = F.transform(F.sequence(F.lit(1), F.char_length("seq")), lambda i: F.when(i % step == 0, F.translate(F.substring("seq", i, 1), "ACGT", "CGTA")).otherwise(F.substring("seq", i, 1)))
    return evaluate.same_gene(rows.withColumn("seq", F.array_join(letters, "")), rows)


def expressed_sources(spark, sf_dir):
    """Distinct beginnings of read names made of source and id."""
    reads = table(spark, sf_dir, "documents").select(F.concat_ws("_", F.coalesce("source", F.lit("none")), F.col("doc_id").cast("string")).alias("header"))
    return evaluate.expressed_transcripts(reads)


def shallow_split(spark, sf_dir):
    """Documents and bases of the shallow sample of each source, and of the rest."""
    rows = sequences(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_index"), F.coalesce("source", F.lit("none")).alias("source")), "read_index")
    parts = simulate.shallow_and_rest(rows, "source", "read_index", least=150)
    counted = [p.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.char_length("seq")).alias("bases")).withColumn("part", F.lit(n)) for n, p in zip(("shallow", "rest"), parts, strict=True)]
    return counted[0].unionByName(counted[1])


def _three(spark, sf_dir) -> DataFrame:
    """(id, a, b, c): every benchmark item and its two successors."""
    rows = items(spark, sf_dir)
    after = lambda n, c: rows.select((F.col("unitig_id") - n).alias("unitig_id"), F.col("seq").alias(c))
    return rows.withColumnRenamed("seq", "a").join(after(1, "b"), "unitig_id").join(after(2, "c"), "unitig_id").withColumnRenamed("unitig_id", "id")


def path_sequences(spark, sf_dir):
    """Sequences, names and overlap of paths over three vertices and back to the first."""
    nodes = F.array("a", "b", "c", "a")
    vertex = lambda n: F.struct((F.col("id") + n).alias("unitig_id"), F.lit("FR"[n % 2]).alias("strand"))
    path = F.array(vertex(0), vertex(1), vertex(2), vertex(0))
    rows = _three(spark, sf_dir)
    return rows.select(
        "id", F.md5(S.path_sequence(nodes, 15)).alias("plain"), F.md5(S.path_sequence(nodes, 15, True)).alias("context"),
        F.md5(S.linked_sequence(nodes, F.array(F.lit("AC"), F.lit(""), F.lit("G")), 15)).alias("linked"), S.path_sequence(F.array("a"), 15).alias("alone"),
        S.node_names(path).alias("path"), S.node_names(S.first_occurrences(path)).alias("once"), S.vertex_disjoint(F.slice(path, 1, 2), F.slice(path, 3, 2)).alias("disjoint"),
        S.fill_header("Bubble_id=[id];Length=[length]", id=F.col("id"), length=F.char_length("a")).alias("header"),
        S.too_similar(F.col("a"), F.col("b"), F.lit(0.55)).alias("similar"), S.contained_either_strand(F.col("a"), S.reverse_complement(F.substring("a", 5, 30))).alias("inside"),
    )


def _grid(spark, sf_dir) -> DataFrame:
    """(src, dst, w): nations in a ring of weights, with a chord for every fifth."""
    n = F.col("n_nationkey").cast("long")
    rows = table(spark, sf_dir, "nation")
    ring = rows.select(n.alias("src"), ((n + 1) % 25).alias("dst"), (n % 3 + 1).alias("w"))
    return ring.unionByName(rows.where("n_nationkey % 5 = 0").select(n.alias("src"), ((n + 7) % 25).alias("dst"), F.lit(4).cast("long").alias("w")))


def between_nodes(spark, sf_dir):
    """Nodes that lie on a way from a group's start to its end, both parts within a bound."""
    starts = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("group"), (F.col("r_regionkey") * 4).cast("long").alias("node"))
    ends = starts.select("group", ((F.col("node") + 9) % 25).alias("node"))
    return traversal.between(starts, ends, written(_grid(spark, sf_dir), "grid"), 14)


def nearest_targets(spark, sf_dir):
    """Distance from each start to the nearest of its targets, if within the bound."""
    starts = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("group"), (F.col("r_regionkey") * 4).cast("long").alias("node"))
    targets = starts.select("group", F.explode(F.array((F.col("node") + 6) % 25, (F.col("node") + 11) % 25)).alias("node"))
    return traversal.nearest(starts, targets, written(_grid(spark, sf_dir), "grid"), 14)


def scored_events(spark, sf_dir):
    """Truth, found, recall and precision of the planted events."""
    transcripts, reads = tables.planted(spark, sf_dir)
    k = EVENT_K
    flank = lambda whole: F.concat(F.substring(whole, tables.EXON - k + 1, k), F.substring(whole, tables.EXON + 1, F.char_length(whole) - 2 * tables.EXON), F.substring(whole, F.char_length(whole) - tables.EXON + 1, k))
    rows = tables.isoforms(spark, sf_dir).where("kind <> 2")
    name = lambda c: F.concat(F.lit(c), F.col("item_id").cast("string"))
    truth = rows.select(F.col("item_id").alias("id"), flank(F.col("known")).alias("a"), flank(F.col("novel")).alias("b"), name("t").alias("a_transcript"), name("n").alias("b_transcript"))
    heard = rows.select(F.explode(F.array(name("t"), name("n"))).alias("t")).select(F.concat("t", F.lit("_1")).alias("header"))
    truth = written(evaluate.truth_filter(truth, transcripts.select(F.col("read_index").alias("id"), "seq"), evaluate.expressed_transcripts(heard)), "truth")
    found = _events(spark, sf_dir)["bubbles"].select(F.col("read_index").alias("id"), F.col("orig_seq").alias("a"), F.col("alt_seq").alias("b"))
    found = written(evaluate.distinct_bubbles(found), "found")
    matched = written(evaluate.matches(truth, found, k), "matched")
    every = tables.isoforms(spark, sf_dir).select(F.explode(F.array(F.struct((F.col("item_id") * 2).alias("id"), F.col("item_id").alias("gene"), F.col("known").alias("seq")), F.struct((F.col("item_id") * 2 + 1).alias("id"), F.col("item_id").alias("gene"), F.col("novel").alias("seq")))).alias("x")).select("x.*")
    classed = evaluate.classified(found.select("id", F.col("id").alias("gene"), F.col("b").alias("novel")), matched, every, every.where("id % 2 = 0").select("id"), k)
    return evaluate.precision_recall(truth, classed, matched)


QUERIES = {
    f.__name__: f
    for f in (
        event_bubbles, event_rejections, event_fasta, exon_sites, trimmed_exons, contained_items, same_gene_paths, expressed_sources, shallow_split, path_sequences,
        between_nodes, nearest_targets, scored_events,
    )
}

_WHOLE = f"whole AS (SELECT * FROM (SELECT item_id AS id, {_encode('text')} AS seq FROM benchmark) WHERE seq <> '')"
_EVENTS = f"""
chrom AS (
  SELECT r_regionkey AS r, translate(string_agg(md5(r_regionkey || '/' || i), '' ORDER BY i), '0123456789abcdef', '{'ACGT' * 4}') AS g
  FROM region, (SELECT unnest(range(0, {DIGESTS})) AS i) GROUP BY r_regionkey),
ev AS (
  SELECT n_nationkey AS n, n_nationkey * {GENE} AS o, CASE WHEN n_nationkey < 15 THEN n_nationkey % 5 WHEN n_nationkey < 20 THEN 5 ELSE 6 END AS kind, g FROM nation JOIN chrom ON r = n_regionkey),
bub AS (
  SELECT CAST(n AS INTEGER) AS event_id, 'T' || n || 'a' AS transcript_1, 'T' || n || 'b' AS transcript_2, 'N' || n AS gene_1, 'N' || n AS gene_2,
         CASE WHEN kind IN (0, 4) THEN substr(g, o + 20, 21) || substr(g, o + 61, 30) || substr(g, o + 121, 21) END AS seq_1,
         CASE WHEN kind IN (0, 4) THEN substr(g, o + 20, 21) || substr(g, o + 121, 21) END AS seq_2,
         ['short_flank', 'no_site', 'no_exon', NULL, 'flank_mismatch', 'no_flank'][kind] AS reason FROM ev)"""
_EXONS = """
e AS (SELECT l_orderkey AS transcript_id, l_partkey * 10 AS start, l_partkey * 10 + CAST(l_quantity AS BIGINT) AS stop FROM lineitem),
x AS (SELECT transcript_id, start, max(stop) AS stop FROM e GROUP BY ALL),
nb AS (SELECT *, lag(start) OVER o AS previous, lead(stop) OVER o AS next FROM x WINDOW o AS (PARTITION BY transcript_id ORDER BY start)),
st AS (SELECT DISTINCT transcript_id, start AS coord, 'start' AS kind FROM e WHERE start % 3 = 0 UNION SELECT transcript_id, stop, 'end' FROM e WHERE stop % 3 = 0)"""
_GRID = """
grid AS (
  SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey + 1) % 25 AS BIGINT) AS dst, CAST(n_nationkey % 3 + 1 AS BIGINT) AS w FROM nation
  UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25, 4 FROM nation WHERE n_nationkey % 5 = 0),
starts AS (SELECT r_regionkey AS "group", CAST(r_regionkey * 4 AS BIGINT) AS node FROM region),
ahead AS (SELECT "group", node, CAST(0 AS BIGINT) AS dist FROM starts UNION SELECT "group", dst, dist + w FROM ahead JOIN grid ON node = src WHERE dist + w <= 14)"""

ORACLE = {
    "event_bubbles": f"WITH {_EVENTS} SELECT * FROM bub",
    "event_rejections": f"WITH {_EVENTS} SELECT coalesce(reason, 'successful') AS reason, count(*) AS events FROM bub GROUP BY 1",
    "event_fasta": f"""WITH {_EVENTS}, b AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM bub WHERE reason IS NULL)
        SELECT 'Bubble_' || i || '_Gene_' || gene_1 || '_TranscriptId_' || transcript_1 || '_Splicing_1' AS a_header, md5(seq_1) AS a,
               'Bubble_' || i || '_Gene_' || gene_2 || '_TranscriptId_' || transcript_2 || '_Splicing_2' AS b_header, md5(seq_2) AS b FROM b""",
    "exon_sites": f"""WITH {_EXONS} SELECT transcript_id, start, coord, kind, stop AS "end", previous, next FROM nb JOIN st USING (transcript_id) WHERE CASE kind WHEN 'start' THEN start ELSE stop END = coord""",
    "trimmed_exons": f"""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN e - s + 1 >= {FLANK} THEN e - {FLANK} + 1 END AS left_start, CASE WHEN e - s + 1 >= {FLANK} THEN e END AS left_end,
               CASE WHEN e - s + 1 >= {FLANK} THEN s END AS right_start, CASE WHEN e - s + 1 >= {FLANK} THEN s + {FLANK} - 1 END AS right_end FROM e""",
    "contained_items": f"WITH {SEQS}, {_WHOLE} SELECT id, read_index AS holder FROM whole JOIN seqs ON contains(seqs.seq, whole.seq) OR contains(seqs.seq, {_rc('whole.seq')})",
    "same_gene_paths": f"""WITH {_WHOLE}, mut AS (
          SELECT id, id % 5 AS gene, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN i % (CASE WHEN id % 2 = 0 THEN 25 ELSE 12 END) = 0
                 THEN translate(substr(seq, CAST(i AS BIGINT), 1), 'ACGT', 'CGTA') ELSE substr(seq, CAST(i AS BIGINT), 1) END), '') AS seq FROM whole),
        two AS (SELECT id, gene, seq, length(seq) AS n FROM mut UNION ALL SELECT id, gene, {_rc("seq")}, length(seq) FROM mut),
        cell AS (SELECT id, n, s, h, hid, i, unnest(range(1, length(h) + 1)) AS j FROM (
          SELECT two.id, n, two.seq AS s, whole.seq AS h, whole.id AS hid, unnest(range(1, n + 1)) AS i FROM two JOIN whole ON gene = whole.id % 5)),
        score AS (SELECT id, n, s, hid, i - j AS diagonal, count(*) FILTER (substr(s, i, 1) = substr(h, j, 1)) AS m FROM cell GROUP BY ALL)
        SELECT DISTINCT id FROM score WHERE m >= 0.95 * n""",
    "expressed_sources": "SELECT DISTINCT split_part(coalesce(source, 'none') || '_' || doc_id, '_', 1) AS transcript_id FROM documents",
    "shallow_split": f"""WITH s AS (SELECT doc_id, coalesce(source, 'none') AS source, length({_encode("text")}) AS n FROM documents),
        u AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY source) * 0.1)) AS picked FROM s WHERE n >= 150),
        p AS (SELECT s.*, CASE WHEN coalesce(picked, false) THEN 'shallow' ELSE 'rest' END AS part FROM s LEFT JOIN u USING (doc_id))
        SELECT source, count(*) AS documents, CAST(sum(n) AS BIGINT) AS bases, part FROM p GROUP BY source, part""",
    "path_sequences": f"""WITH {_WHOLE}, t AS (SELECT x.id, x.seq AS a, y.seq AS b, z.seq AS c FROM whole x JOIN whole y ON y.id = x.id + 1 JOIN whole z ON z.id = x.id + 2)
        SELECT id, md5(right(a, 15) || substr(b, 15) || substr(c, 15) || substr(a, 15, 1)) AS plain, md5(a || substr(b, 15) || substr(c, 15) || substr(a, 15)) AS context,
               md5(right(a, 15) || 'AC' || substr(b, 15) || substr(c, 15) || 'G' || substr(a, 15, 1)) AS linked, CAST(NULL AS VARCHAR) AS alone,
               id || '_F ' || (id + 1) || '_R ' || (id + 2) || '_F ' || id || '_F' AS path, id || '_F ' || (id + 1) || '_R ' || (id + 2) || '_F' AS once, false AS disjoint,
               'Bubble_id=' || id || ';Length=' || length(a) AS header, least(levenshtein(a, b), levenshtein({_rc("a")}, b)) / greatest(length(a), length(b)) < 0.55 AS similar, true AS inside FROM t""",
    "between_nodes": f"""WITH RECURSIVE {_GRID}, behind AS (
          SELECT "group", (node + 9) % 25 AS node, CAST(0 AS BIGINT) AS dist FROM starts UNION SELECT "group", src, dist + w FROM behind JOIN grid ON node = dst WHERE dist + w <= 14)
        SELECT "group", node FROM ahead INTERSECT SELECT "group", node FROM behind""",
    "nearest_targets": f"""WITH RECURSIVE {_GRID} SELECT "group", min(dist) AS dist FROM ahead JOIN starts s USING ("group")
        WHERE ahead.node IN ((s.node + 6) % 25, (s.node + 11) % 25) GROUP BY "group" """,
    "scored_events": f"""WITH {PLANTED}, n AS (SELECT count(*) FILTER (kind <> 2) AS truth, count(*) FILTER (kind < 2) AS found FROM plant)
        SELECT truth, found, found / truth AS recall, 1.0::DOUBLE AS precision FROM n""",
}
