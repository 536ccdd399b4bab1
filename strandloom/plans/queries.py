"""Registered queries over the driver tables, whole tables and whole texts.

Documents are read as sequences (:mod:`strandloom.plans.tables`); pieces of
benchmark items play the unitigs in the mapping queries, which makes their
results independent of traversal order and so comparable with SQL. Events planted
for the benchmark items go through the whole chain with the graph's own unitigs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.functions import superkmers as M
from strandloom.functions.alignment import semi_global_distance, ungapped_local_score
from strandloom.operators import bubbles, evaluate, junctions, kmers, mapping, simulate, splicing, traversal, unitigs
from strandloom.plans import tables
from strandloom.plans.checkpoints import finished, folder_of, saved, settled, written
from strandloom.plans.tables import contigs, items, sequences, table
from strandloom.sources import annotation

K = 21
#: Length of k-mers in the mapping queries.
MAP_K = 15
LEAST = 2
CUTOFF = 0.34


def _reads(spark, sf_dir, transcript: bool) -> DataFrame:
    return sequences(spark, sf_dir).where(F.col("transcript") if transcript else ~F.col("transcript"))


def kmer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solid canonical k-mers of the short reads."""
    return kmers.count_kmers(_reads(spark, sf_dir, False), K, LEAST)


def kmer_histogram(spark, sf_dir):
    return kmers.histogram(kmers.count_kmers(sequences(spark, sf_dir), K, pack=True))


def _packed(spark, sf_dir, transcript: bool) -> DataFrame:
    return kmers.count_kmers(_reads(spark, sf_dir, transcript), K, 1 if transcript else LEAST, pack=True)


def sequence_scalars(spark, sf_dir):
    """Digests of complement and reverse complement, base check, and over all k-mers of a
    text the sums of canonical codes, packed codes and packed minimizers (null without any)."""
    seq = F.col("seq")
    rows = sequences(spark, sf_dir).select("read_index", F.md5(S.complement(seq)).alias("complement"), F.md5(S.reverse_complement(seq)).alias("rc"), S.is_acgt(seq).alias("acgt"), "seq")
    return M.code_sums(rows, K, 7, "read_index", "complement", "rc", "acgt")


def _solid(spark, sf_dir) -> DataFrame:
    """Short-read k-mers from LEAST on and all transcript k-mers, counted once each."""
    both = _packed(spark, sf_dir, False).unionByName(_packed(spark, sf_dir, True))
    return both.groupBy("kmer").agg(F.max("n").alias("n"))


def graph_degrees(spark, sf_dir):
    """Nodes of the merged graph by their numbers of edges in and out."""
    return junctions.degree_counts(settled("solid", lambda: _solid(spark, sf_dir)), K)


def _weak(spark, sf_dir) -> DataFrame:
    return junctions.weak_edges(settled("solid", lambda: _packed(spark, sf_dir, False)), K, CUTOFF)


def weak_edges(spark, sf_dir):
    """Edges of the short-read graph with a low share among their siblings."""
    return kmers.spelled(_weak(spark, sf_dir), K, "u", "v")


def _removal(spark, sf_dir) -> DataFrame:
    transcript = settled("solid", lambda: _packed(spark, sf_dir, True))
    forks = settled("forks", lambda: junctions.forks(transcript, K))
    return kmers.rescue_at(settled("weak", lambda: _weak(spark, sf_dir)), transcript, forks, K)


def rescued_removal(spark, sf_dir):
    """Weak edges that no branching transcript node has."""
    return kmers.spelled(_removal(spark, sf_dir), K, "u", "v")


def _unitigs(spark, sf_dir) -> DataFrame:
    texts = sequences(spark, sf_dir).withColumnRenamed("read_index", "place")

    def removal() -> DataFrame:
        marks = settled("weak", lambda: junctions.weak_and_forks(texts, K, LEAST, CUTOFF))
        return kmers.rescue_marked(marks, K)

    def whole() -> DataFrame:
        removed = settled("removed", removal)
        return unitigs.numbered(unitigs.unitigs_of_fragments(lambda: junctions.merged_fragments(texts, K, LEAST, removed), K))

    return settled("unitigs", whole)


def unitig_table(spark, sf_dir):
    """Unitigs of the merged, cleaned graph, numbered, with coverage."""
    return _unitigs(spark, sf_dir)


def unitig_edges(spark, sf_dir):
    """Overlaps of the ends of benchmark sequences, with labels."""
    return unitigs.unitig_edges(contigs(spark, sf_dir).where(F.char_length("seq") >= 8), 7)


def _index(spark, sf_dir) -> DataFrame:
    return written(unitigs.index(contigs(spark, sf_dir), MAP_K), "index")


def _mapping(spark, sf_dir) -> DataFrame:
    return mapping.map_reads(sequences(spark, sf_dir), _index(spark, sf_dir), MAP_K)


def kmer_index(spark, sf_dir):
    return unitigs.index(contigs(spark, sf_dir), MAP_K)


def read_hits(spark, sf_dir):
    """Number of hits and distinct unitigs of each read and orientation."""
    return _mapping(spark, sf_dir).groupBy("read_index", "orientation").agg(F.count("*").alias("hits"), F.count_distinct("unitig_id").alias("unitigs"))


def _coloured(spark, sf_dir, hits) -> DataFrame:
    roles = sequences(spark, sf_dir).select("read_index", "transcript")
    marked = hits.join(roles, "read_index")
    blue, red = (mapping.unitig_counts(marked.where(c)) for c in ("transcript", "NOT transcript"))
    return mapping.coloured(contigs(spark, sf_dir), blue, red, MAP_K)


def coloured_unitigs(spark, sf_dir):
    """Counts by transcripts and short reads, and which unitigs to trust."""
    return _coloured(spark, sf_dir, written(_mapping(spark, sf_dir), "hits"))


def unitig_transcripts(spark, sf_dir):
    hits = _mapping(spark, sf_dir).join(_reads(spark, sf_dir, True).select("read_index"), "read_index", "left_semi")
    return mapping.unitig_transcripts(hits)


def transcript_quantification(spark, sf_dir):
    """Mean short-read count over each transcript's vertices."""
    hits = written(_mapping(spark, sf_dir), "hits")
    own = hits.join(_reads(spark, sf_dir, True).select("read_index"), "read_index", "left_semi")
    return mapping.quantified(own, _coloured(spark, sf_dir, hits)).withColumn("sr_mean", F.round("sr_mean", 6))


def mapping_runs(spark, sf_dir):
    return mapping.runs(_mapping(spark, sf_dir))


def _pairs(spark, sf_dir) -> DataFrame:
    hits = written(_mapping(spark, sf_dir), "hits")
    return written(mapping.linked_pairs(mapping.runs(hits), _coloured(spark, sf_dir, hits), MAP_K), "pairs")


def linking_edges(spark, sf_dir):
    """Links between trustable unitigs with their commonest label, as length and digest."""
    edges = mapping.linking_edges(_pairs(spark, sf_dir), sequences(spark, sf_dir), MAP_K)
    return edges.withColumn("label_length", F.char_length("label").cast("long")).withColumn("label", F.md5("label"))


def linking_hints(spark, sf_dir):
    return mapping.hints(_pairs(spark, sf_dir))


def mate_hints(spark, sf_dir):
    """Hints across mates; neighbouring documents (2i, 2i + 1) are the mates."""
    hits = written(_mapping(spark, sf_dir), "hits")
    ids = sequences(spark, sf_dir).select("read_index")
    mates = ids.where("read_index % 2 = 0").selectExpr("read_index AS left", "read_index + 1 AS right")
    return mapping.mate_hints(hits, _coloured(spark, sf_dir, hits), mates)


def _neighbours(spark, sf_dir) -> DataFrame:
    """(a_id, b_id, a, b): each benchmark sequence and the next one."""
    c = items(spark, sf_dir)
    nxt = c.select((F.col("unitig_id") - 1).alias("a_id"), F.col("unitig_id").alias("b_id"), F.col("seq").alias("b"))
    return c.select(F.col("unitig_id").alias("a_id"), F.col("seq").alias("a")).join(nxt, "a_id")


def event_classes(spark, sf_dir):
    """Edit distance, similarity and class of neighbouring sequences."""
    distance = S.edit_distance(F.col("a"), F.col("b"))
    rows = _neighbours(spark, sf_dir).withColumn("ed", distance)
    return rows.select("a_id", "b_id", "ed", S.event_type(F.col("ed"), F.col("b"), 31, 0.5).alias("type"), (F.col("ed") / F.greatest(F.char_length("a"), F.char_length("b")) < 0.6).alias("similar"))


def semi_global(spark, sf_dir):
    """Semi-global distance and ungapped score of neighbouring sequences."""
    return _neighbours(spark, sf_dir).select("a_id", "b_id", semi_global_distance("a", "b").alias("distance"), ungapped_local_score("a", "b").alias("score"))


def best_anchors(spark, sf_dir):
    """Where the first bases of the next sequence fit best."""
    rows = _neighbours(spark, sf_dir).where(F.char_length("b") >= 12).withColumn("anchor", F.substring("b", 1, 12))
    return S.best_anchors(rows, "a", "anchor", "a_id", "b_id")


#: Length of k-mers whose first k - 1 bases are anchors.
ANCHOR_K = 13


def anchored_distances(spark, sf_dir):
    """Distance of each benchmark sequence to what its ends anchor to in the one before."""
    return _neighbours(spark, sf_dir).select("a_id", "b_id", S.anchored_distance(F.col("a"), F.col("b"), ANCHOR_K).alias("distance"))


def simulated_reads(spark, sf_dir):
    return simulate.simulate_reads(sequences(spark, sf_dir))


def shallow_sample(spark, sf_dir):
    """A tenth of each source's documents, one at least."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return simulate.sample_per_group(docs, "source", "doc_id")


def splice_chains(spark, sf_dir):
    """Chains parsed from one line per order, forward and on the minus strand."""
    item = F.concat(F.col("l_partkey").cast("string"), F.when(F.col("l_returnflag") == "A", "-").when(F.col("l_returnflag") == "N", "^").otherwise(""))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("s")))), lambda x: x["s"]), ",").alias("chain"))
    chain = splicing.splice_chain(F.col("chain"))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["coord"].cast("string"), s["kind"])), ",")
    return lines.select("l_orderkey", said(chain).alias("sites"), said(splicing.reversed_chain(chain)).alias("minus"))


def spliced_exons(spark, sf_dir):
    """The last 50, the first 60 and 33 middle bases of every sequence, put together in order."""
    n = F.char_length("seq")
    middle = F.floor(n / 2).cast("int")
    exons = F.array(*(F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")) for a, b in ((F.greatest(n - 49, F.lit(1)), n), (F.lit(1), F.least(n, F.lit(60))), (middle + 1, middle + 33))))
    return sequences(spark, sf_dir).select("read_index", splicing.spliced(exons, F.col("seq")).alias("spliced"))


def overlapping_intervals(spark, sf_dir):
    """Pairs of overlapping intervals, one interval for each document."""
    start = F.col("doc_id") * 100
    spans = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), start.alias("start"), (start + F.col("n_chars") % 400).alias("end"))
    return splicing.overlapping(spans, 500)


def event_runs(spark, sf_dir):
    """Runs of equal event types of each user, in the order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("fresh", F.when(F.lag("event_type").over(order) == F.col("event_type"), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("fresh").over(order))
    return rows.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"))


def shared_kmers(spark, sf_dir):
    """Documents and benchmark items with at least ten common k-mers."""
    left = sequences(spark, sf_dir).select(F.col("read_index").alias("id"), "seq")
    return evaluate.shared_kmer_pairs(left, items(spark, sf_dir).select(F.col("unitig_id").alias("id"), "seq"), K, 10)


def distinct_pairs(spark, sf_dir):
    """Number of neighbouring sequence pairs up to order and strand."""
    rows = _neighbours(spark, sf_dir)
    turned = rows.select(S.reverse_complement(F.col("b")).alias("a"), S.reverse_complement(F.col("a")).alias("b"))
    every = rows.select("a", "b").unionByName(turned)
    return evaluate.distinct_bubbles(every).agg(F.count("*").alias("pairs"))


def match_triage(spark, sf_dir):
    """Documents by what they share with the benchmark: whole item, ten k-mers, any k-mer, none."""
    docs = sequences(spark, sf_dir).select(F.col("read_index").alias("id"), "seq")
    pairs = written(evaluate.shared_kmer_pairs(docs, items(spark, sf_dir).select(F.col("unitig_id").alias("id"), "seq"), K, 1), "pairs")
    item = items(spark, sf_dir).select(F.col("unitig_id").alias("y"), F.col("seq").alias("item"))
    whole = pairs.join(item, "y").join(docs, F.col("x") == F.col("id")).where(F.col("seq").contains(F.col("item"))).select("id").distinct()
    flags = docs.select("id")
    for name, ids in (("matched", whole), ("same_gene", pairs.where("shared >= 10").select(F.col("x").alias("id")).distinct()), ("chimeric", pairs.select(F.col("x").alias("id")).distinct())):
        flags = flags.join(ids.withColumn(name, F.lit(True)), "id", "left").fillna(False, [name])
    return evaluate.triage(flags).groupBy("class").agg(F.count("*").alias("documents"))


def reachable_unitigs(spark, sf_dir):
    """Unitigs within 400 k-mers of each transcript's own, over the linking graph."""
    hits = written(_mapping(spark, sf_dir), "hits")
    colours = written(_coloured(spark, sf_dir, hits), "colours")
    pairs = written(mapping.linked_pairs(mapping.runs(hits), colours, MAP_K), "pairs")
    vertex = mapping.vertices(colours, MAP_K)
    name = lambda u, s: F.concat_ws("_", F.col(u).cast("string"), F.col(s))
    edges = mapping.linking_edges(pairs, sequences(spark, sf_dir), MAP_K).join(vertex.select(F.col("unitig_id").alias("dst"), F.col("strand").alias("dst_strand"), "weight"), ["dst", "dst_strand"])
    graph = edges.select(name("src", "src_strand").alias("src"), name("dst", "dst_strand").alias("dst"), F.greatest("weight", F.lit(1)).cast("long").alias("w"))
    own = hits.join(_reads(spark, sf_dir, True).select("read_index"), "read_index", "left_semi").where("orientation = 'FW'")
    return traversal.reachable_of_sets(own.select(F.col("read_index").alias("group"), name("unitig_id", "strand").alias("node")), written(graph, "graph"), 400)


#: Length of k-mers, and share of differences, in the search for planted events.
EVENT_K = 31
EVENT_SHARE = 0.1


def search_events(transcripts: DataFrame, reads: DataFrame, k: int, limits: bubbles.Limits) -> dict[str, DataFrame]:
    """The whole chain from sequences to bubbles, with the tables between."""
    solid_sr, solid_tr = (written(kmers.count_kmers(t, k, least, pack=True), "solid") for t, least in ((reads, LEAST), (transcripts, 1)))
    removed = kmers.rescue(kmers.weak_edges(kmers.edges(solid_sr, k), 0.02, k), kmers.edges(solid_tr, k))
    merged = solid_sr.unionByName(solid_tr).groupBy("kmer").agg(F.max("n").alias("n"))
    graph = written(kmers.without_edges(kmers.edges(merged, k), removed), "edges")
    nodes = written(unitigs.numbered(unitigs.compact(merged, graph, k)), "unitigs")
    index = written(unitigs.index(nodes, k), "index")
    blue, red = (written(mapping.map_reads(t, index, k), "hits") for t in (transcripts, reads))
    colours = written(mapping.coloured(nodes, mapping.unitig_counts(blue), mapping.unitig_counts(red), k), "colours")
    pairs = written(mapping.linked_pairs(mapping.runs(red), colours, k), "pairs")
    links = written(mapping.linking_edges(pairs, reads, k), "links")
    vertex = mapping.without_blue_only(mapping.vertices(colours, k))
    found = bubbles.find_bubbles(blue, transcripts.select("read_index", "seq"), vertex, links, mapping.hints(pairs), limits)
    return {"graph": graph, "nodes": nodes, "index": index, "blue": blue, "red": red, "colours": colours, "links": links, "vertex": vertex, "bubbles": written(found, "bubbles")}


def _events(spark, sf_dir) -> dict[str, DataFrame]:
    """The tables of the chain, which several queries of one application look at.

    They are saved once under a path that stands for the input as it is; its last table marks the end.
    """
    base = folder_of(spark, "events", table(spark, sf_dir, "benchmark"))
    names = ("graph", "nodes", "blue", "vertex", "bubbles")
    if not finished(spark, f"{base}/{names[-1]}"):
        transcripts, reads = tables.planted(spark, sf_dir)
        got = search_events(transcripts, reads, EVENT_K, bubbles.Limits(k=EVENT_K, min_edit_distance=EVENT_SHARE))
        for name in names:
            saved(got[name], f"{base}/{name}", resume=True)
    return {name: spark.read.parquet(f"{base}/{name}") for name in names}


def novel_bubbles(spark, sf_dir):
    """Events planted for every benchmark item, found from reads and transcripts by the whole chain."""
    return _events(spark, sf_dir)["bubbles"].select("read_index", "label", "source", "target", "orig_seq", "alt_seq", "n_nodes", "n_branches", "edit_distance", "event_type")


def bubble_records(spark, sf_dir):
    """Records of the bubble files, by kind and class."""
    transcripts, _ = tables.planted(spark, sf_dir)
    return annotation.bubble_records(_events(spark, sf_dir)["bubbles"], transcripts).where("kind <> 'bubbles.detailed'").select("kind", "event_type", "read_index", "place", F.regexp_replace("header", "Bubble_id=\\d+;", "").alias("header"), "seq")


def transcript_paths(spark, sf_dir):
    """Transcripts spelled by their hits, short-read coverage and vertices without short reads."""
    got = _events(spark, sf_dir)
    transcripts, _ = tables.planted(spark, sf_dir)
    same = mapping.reassembled(got["blue"], got["nodes"], transcripts.select("read_index", "seq"), EVENT_K)
    vertices = got["blue"].where("orientation = 'FW'").select("read_index", "unitig_id", "strand").distinct().join(got["vertex"].select("unitig_id", "strand", "sr_count", "weight"), ["unitig_id", "strand"])
    paths = vertices.groupBy("read_index").agg(F.collect_list(F.struct("unitig_id", "strand", "sr_count", "weight")).alias("nodes"))
    counted = mapping.quantified_paths(paths).select("read_index", "sr_mean", F.size("nodes").alias("nodes"), F.aggregate("nodes", F.lit(0).cast("long"), lambda a, n: a + n["weight"]).alias("kmers"))
    return same.join(counted, "read_index")


def link_counters(spark, sf_dir):
    """The ten counters of mapping and linking."""
    hits = written(_mapping(spark, sf_dir), "hits")
    return mapping.counters(sequences(spark, sf_dir), hits, mapping.runs(hits), _coloured(spark, sf_dir, hits), MAP_K)


def surviving_edges(spark, sf_dir):
    """Overlaps of unitig ends that are edges of the cleaned graph of the planted reads."""
    got = _events(spark, sf_dir)
    kept = unitigs.surviving(unitigs.unitig_edges(got["nodes"], EVENT_K), got["nodes"], got["graph"], EVENT_K)
    ends = got["nodes"].select("unitig_id", "seq")
    one, two = (ends.select(F.col("unitig_id").alias(c), F.md5("seq").alias(f"{c}_seq")) for c in ("src", "dst"))
    return kept.join(one, "src").join(two, "dst").select("src_seq", "dst_seq", "label")


QUERIES = {
    f.__name__: f
    for f in (
        kmer_count, kmer_histogram, sequence_scalars, graph_degrees, weak_edges, rescued_removal, unitig_table, unitig_edges, kmer_index, read_hits,
        coloured_unitigs, unitig_transcripts, transcript_quantification, mapping_runs, linking_edges, linking_hints, mate_hints, event_classes, semi_global,
        best_anchors, anchored_distances, simulated_reads, shallow_sample, splice_chains, spliced_exons, overlapping_intervals, event_runs, shared_kmers, distinct_pairs,
        match_triage, reachable_unitigs, novel_bubbles, bubble_records, transcript_paths, link_counters, surviving_edges,
    )
}
