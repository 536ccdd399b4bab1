"""Compaction of the de Bruijn graph into unitigs, inside minimizer buckets and then across them.

Every node points at its predecessor if the edge between them doesn't branch on
either side. Such links are dealt by the minimizer of the bases that both nodes
share, so stretches of a chain lie together, and each stretch is contracted where
it lies: its nodes point at its first one. Any cut of a bucket is right, so a
large one is taken in blocks. Only the first nodes of stretches, a fraction of all, are glued by joins
that double their pointers: a chain of n stretches takes log2(n) rounds. Nodes are
2-bit longs up to k = 31. Cycles have no first node: they are found as what never
reaches one, cut at their smallest canonical k-mer, and compacted the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.packed import LONGEST, pack, spell, tail
from strandloom.functions.sequence import canonical, explode_kmers, reverse_complement
from strandloom.functions.superkmers import minimizer_length, minimizer_of
from strandloom.operators import glue, junctions
from strandloom.operators.kmers import edges, is_packed, oriented, turned, without_edges
from strandloom.plans.checkpoints import settled, written


#: Links that are contracted at once.
BLOCK = 1 << 18


def contract(node: np.ndarray, prev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first node that is reached, distance) of each node over the given links; a node of a closed cycle only takes its own."""
    order = np.argsort(node, kind="stable")
    ranked = node[order]
    place = np.minimum(np.searchsorted(ranked, prev), len(node) - 1)
    jump = np.where(ranked[place] == prev, order[place], -1)
    at, d = prev.copy(), np.ones(len(node), np.int64)
    for _ in range(len(node).bit_length() + 1):
        live = np.flatnonzero(jump >= 0)
        if not len(live):
            break
        over = jump[live]
        at[live], d[live], jump[live] = at[over], d[live] + d[over], jump[over]
    closed = jump >= 0
    at[closed], d[closed] = prev[closed], 1
    return at, d


def _dealt(k: int):
    """Adds the minimizer of the bases that a node shares with its predecessor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = minimizer_length(k)
        for batch in batches:
            shared = batch.column(0).to_numpy() >> 2
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(minimizer_of(shared, k - 1, m))], ["node", "prev", "minimizer"])

    return run


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, total = [], 0

    def out() -> pa.RecordBatch:
        rows = pa.Table.from_batches(kept)
        node = rows["node"].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(node), *map(pa.array, contract(node, rows["prev"].to_numpy()))], ["node", "at", "d"])

    for batch in batches:
        kept.append(batch)
        total += batch.num_rows
        if total >= BLOCK:
            yield out()
            kept, total = [], 0
    if total:
        yield out()


def _stretches(links: DataFrame, k: int) -> DataFrame:
    """(node, at, d) of the nodes that aren't starts: their pointers after the contraction inside buckets."""
    open_links = links.where("node <> prev")
    if not is_packed(links, "node"):
        return open_links.select("node", F.col("prev").alias("at"), F.lit(1).cast("long").alias("d"))
    dealt = open_links.select("node", "prev").mapInArrow(_dealt(k), "node long, prev long, minimizer long").hint("rebalance", "minimizer")
    return dealt.sortWithinPartitions("minimizer").mapInArrow(_contracted, "node long, at long, d long")


def chains(links: DataFrame, k: int, local: bool = True) -> tuple[DataFrame, DataFrame]:
    """(node, root, d) of nodes that reach a chain's start, and (node) of the rest.

    ``links`` has (node, prev), prev equal to node for a start. After the
    contraction (``local``; else nodes are no k-mers), only nodes that others point at take part in the rounds. Each round hops
    over those that are still open: one whose pointer meets a settled node is
    settled itself and goes to a table of its own, which no later round moves. A
    chain has nodes at every distance from its start, so each round settles some
    of them as long as any are open; what no round settles lies on cycles.
    """
    start = written(links.where("node = prev").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("d")), "chains")
    steps = _stretches(links, k) if local else links.where("node <> prev").select("node", F.col("prev").alias("at"), F.lit(1).cast("long").alias("d"))
    inner = written(steps, "stretches")
    settled = [start]
    pending = written(inner.join(inner.select(F.col("at").alias("node")).distinct(), "node", "left_semi"), "open")
    left = pending.count()
    while left:
        hop = pending.select(F.col("node").alias("h"), F.col("at").alias("h_at"), F.col("d").alias("h_d"), F.lit(False).alias("end"))
        hop = hop.unionByName(_union(settled).select(F.col("node").alias("h"), F.col("root").alias("h_at"), F.col("d").alias("h_d"), F.lit(True).alias("end")))
        moved = written(pending.join(hop, F.col("at") == F.col("h")).select("node", F.col("h_at").alias("at"), (F.col("d") + F.col("h_d")).alias("d"), "end"), "open")
        settled.append(moved.where("end").select("node", F.col("at").alias("root"), "d"))
        pending = moved.where("NOT end").drop("end")
        now = pending.count()
        if now == left:
            break
        left = now
    glued = written(_union(settled).select(F.col("node").alias("at"), "root", F.col("d").alias("before")), "glued")
    found = inner.join(glued, "at").select("node", "root", (F.col("d") + F.col("before")).alias("d"))
    return start.unionByName(found), inner.join(glued.select("at"), "at", "left_anti").select("node")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _opened(links: DataFrame, cyclic: DataFrame, k: int) -> DataFrame:
    """The links of the cycles, each opened at its smallest canonical k-mer.

    That k-mer is the first node of the strand that holds it, and its reverse
    complement the last node of the other strand, so both give one unitig.
    """
    ring = written(links.join(cyclic, "node"), "ring")
    state = ring.select("node", F.col("prev").alias("at"), F.col("node").alias("name"), F.least(F.col("node"), turned(ring, "node", k)).alias("low"))
    while True:
        hop = state.select(F.col("node").alias("h"), F.col("at").alias("h_at"), F.col("name").alias("h_name"), F.col("low").alias("h_low"))
        moved = state.join(hop, F.col("at") == F.col("h"))
        changed = (F.col("h_name") < F.col("name")) | (F.col("h_low") < F.col("low"))
        state = written(moved.select("node", F.col("h_at").alias("at"), F.least("name", "h_name").alias("name"), F.least("low", "h_low").alias("low"), changed.alias("changed")), "ring")
        if state.where("changed").isEmpty():
            break
    held = state.groupBy("name").agg(F.max(F.col("node") == F.col("low")).alias("held"))
    joined = ring.join(state.select("node", "name", "low"), "node").join(held, "name")
    first = F.when(F.col("held"), F.col("node") == F.col("low")).otherwise(F.col("prev") == turned(joined, "low", k))
    return joined.select("node", F.when(first, F.col("node")).otherwise(F.col("prev")).alias("prev"))


def unitigs_of(kmers: DataFrame, k: int, removed: DataFrame | None = None) -> DataFrame:
    """(seq, coverage): as :func:`compact`, on the graph of all edges between k-mers but the removed ones (on both strands).

    Stretches come from the buckets of the junctions (:mod:`strandloom.operators.junctions`); only
    those that go on in another bucket are glued, at the k-mer that they share (:mod:`strandloom.operators.glue`).
    """
    if not junctions.fits(kmers, k):
        graph = edges(kmers, k)
        return compact(kmers, graph if removed is None else without_edges(graph, removed), k)
    return glue.glued(written(junctions.fragments(kmers, k, removed), "fragments"), k, "place" in kmers.columns)


def unitigs_of_texts(seqs: DataFrame, k: int, least: int) -> DataFrame:
    """As :func:`unitigs_of`, for the k-mers found at least ``least`` times in (seq, transcript, place); odd k from 15 to 31."""
    return unitigs_of_fragments(lambda: junctions.text_fragments(seqs, k, least), k)


def unitigs_of_fragments(make: Callable[[], DataFrame], k: int) -> DataFrame:
    """(seq, coverage) from what makes placed fragments."""
    return glue.glued(settled("fragments", make), k, True)


def compact(kmers: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """(seq, coverage): canonical unitigs and the mean count of their k-mers.

    A path stops at a node that branches on either side; a hairpin or loop is
    never followed.
    """
    packed = is_packed(kmers)
    code = pack if k <= LONGEST and not packed else (lambda c: c)
    # Edges that share their inner bases are at most 16: all edges out of u and all into v are among them.
    shared = tail(F.col("u"), k) if is_packed(graph, "u") else F.expr("substring(u, 2)")
    keyed = graph.select("u", "v", shared.alias("shared")).repartition("shared")
    number = lambda c: F.count("*").over(Window.partitionBy("shared", c))
    simple = keyed.withColumns({"n_out": number("u"), "n_in": number("v")}).where("n_out = 1 AND n_in = 1").select("u", "v")
    simple = simple.where(F.col("u") != F.col("v")).where(F.col("v") != turned(graph, "u", k))
    nodes = written(
        oriented(kmers, k)
        .join(simple.select(F.col("v").alias("kmer"), F.col("u").alias("before")), "kmer", "left")
        .select(code(F.col("kmer")).alias("node"), code(F.coalesce("before", "kmer")).alias("prev"), "kmer", "n"),
        "nodes",
    )
    links = nodes.select("node", "prev")
    chained, cyclic = chains(links, k)
    if not cyclic.isEmpty():
        chained = chained.unionByName(chains(_opened(links, cyclic, k), k)[0])
    if packed:
        whole, base = spell(F.col("kmer"), k), F.substring(F.lit("ACGT"), F.col("kmer").bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1))
    else:
        whole, base = F.col("kmer"), F.right("kmer", F.lit(1))
    part = F.struct("d", F.when(F.col("d") == 0, whole).otherwise(base).alias("s"))
    built = (
        chained.join(nodes.select("node", "kmer", "n"), "node")
        .groupBy("root")
        .agg(F.array_sort(F.collect_list(part)).alias("parts"), F.avg("n").alias("coverage"))
    )
    seq = canonical(F.array_join(F.transform("parts", lambda p: p["s"]), ""))
    return built.select(seq.alias("seq"), "coverage").groupBy("seq").agg(F.max("coverage").alias("coverage"))


def numbered(unitigs: DataFrame) -> DataFrame:
    """(unitig_id, seq, len, coverage): ids from 0 in the order of the sequences.

    Ranges of the sequences are numbered by themselves and shifted by the sizes
    of the ranges before them.
    """
    ranged = written(unitigs.repartitionByRange("seq").withColumn("part", F.spark_partition_id()), "unitigs")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("part").orderBy("seq")) - 1
    joined = ranged.withColumn("i", place).join(sizes.select("part", before.alias("before")), "part")
    return joined.select((F.col("before") + F.col("i")).alias("unitig_id"), "seq", F.char_length("seq").alias("len"), "coverage")


def index(unitigs: DataFrame, k: int) -> DataFrame:
    """(kmer, unitig_id, strand, pos): every k-mer on both strands.

    Positions on strand R count in the reverse complement. Where a k-mer has
    several places the smallest one stays.
    """
    strands = unitigs.select(
        "unitig_id", F.explode(F.array(F.struct(F.lit("F").alias("strand"), F.col("seq").alias("seq")), F.struct(F.lit("R").alias("strand"), reverse_complement(F.col("seq")).alias("seq")))).alias("s")
    ).select("unitig_id", "s.strand", "s.seq")
    kmers = explode_kmers(strands, k, "unitig_id", "strand").where(F.col("kmer").rlike("^[ACGT]+$"))
    best = kmers.groupBy("kmer").agg(F.min(F.struct("unitig_id", "strand", "pos")).alias("x"))
    return best.select("kmer", "x.unitig_id", "x.strand", "x.pos")


def unitig_edges(unitigs: DataFrame, k: int) -> DataFrame:
    """(src, dst, label): unitigs whose ends overlap by k - 1 bases.

    Labels: FF and RR join unlike ends on one strand, FR and RF like ends on
    opposite strands. A unitig is never joined with itself.
    """
    def end(side: str):
        piece = F.left("seq", F.lit(k - 1)) if side == "LEFT" else F.right("seq", F.lit(k - 1))
        return F.struct(F.lit(side).alias("side"), piece.alias("s"))

    ends = unitigs.select("unitig_id", F.explode(F.array(end("LEFT"), end("RIGHT"))).alias("e"))
    ends = ends.select("unitig_id", "e.side", canonical(F.col("e.s")).alias("key"), (F.col("e.s") == canonical(F.col("e.s"))).alias("plain"))
    a, b = ends.alias("a"), ends.alias("b")
    like = F.col("a.plain") == F.col("b.plain")
    label = (
        F.when((F.col("a.side") == "LEFT") & (F.col("b.side") == "LEFT") & ~like, "RF")
        .when((F.col("a.side") == "LEFT") & (F.col("b.side") == "RIGHT") & like, "RR")
        .when((F.col("a.side") == "RIGHT") & (F.col("b.side") == "LEFT") & like, "FF")
        .when((F.col("a.side") == "RIGHT") & (F.col("b.side") == "RIGHT") & ~like, "FR")
    )
    met = a.join(b, F.col("a.key") == F.col("b.key")).where(F.col("a.unitig_id") != F.col("b.unitig_id"))
    return met.select(F.col("a.unitig_id").alias("src"), F.col("b.unitig_id").alias("dst"), label.alias("label")).where("label IS NOT NULL").distinct()


def surviving(overlaps: DataFrame, unitigs: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """The overlaps whose edge the graph still has.

    The edge goes from the last k-mer of the source to the first one of the end, on
    the strands that the label names (F or R for each).
    """
    strand = lambda at: F.when(F.substring("label", at, 1) == "F", F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    ends = unitigs.select("unitig_id", "seq")
    rows = overlaps.join(ends, F.col("src") == F.col("unitig_id")).select("src", "dst", "label", F.right(strand(1), F.lit(k)).alias("u"))
    rows = rows.join(ends, F.col("dst") == F.col("unitig_id")).select("src", "dst", "label", "u", F.left(strand(2), F.lit(k)).alias("v"))
    if is_packed(graph, "u"):
        rows = rows.withColumns({"u": pack(F.col("u")), "v": pack(F.col("v"))})
    return rows.join(graph.select("u", "v"), ["u", "v"], "left_semi").select("src", "dst", "label")
