"""Mapping of reads onto unitigs, colouring and linking.

Only hits are kept. A run of one unitig ends where the next hit is of another
unitig or not at the next position, so missing k-mers needn't be rows at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import packed as P
from strandloom.functions.sequence import explode_kmers, reverse_complement

#: An index of up to so many k-mers is broadcast; a larger one is joined by shuffle.
BROADCAST_KMERS = 500_000


def map_reads(reads: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(read_index, orientation, i, unitig_id, strand, pos) of every k-mer that the index has.

    Each read is mapped forward (FW) and reverse-complemented (RC); one shorter
    than k has no rows. Up to 31 bases, both orientations come from one lookup of
    the packed canonical k-mer.
    """
    if k > P.LONGEST:
        return _map_strings(reads, index, k)
    code, place = P.pack(F.col("kmer")), F.struct("unitig_id", "strand", "pos")
    both = index.select(code.alias("code"), place.alias("x")).withColumn("kmer", F.least("code", P.reverse_complement(F.col("code"), k)))
    is_same = F.col("code") == F.col("kmer")
    known = both.groupBy("kmer").agg(F.min(F.when(is_same, F.col("x"))).alias("same"), F.min(F.when(~is_same, F.col("x"))).alias("other"))
    known = F.broadcast(known) if index.count() <= BROADCAST_KMERS else known
    met = P.placed(reads, k).join(known, "kmer").withColumn("other", F.coalesce("other", "same"))
    hit = lambda o, i, x: F.struct(F.lit(o).alias("orientation"), i.cast("int").alias("i"), x.alias("x"))
    fw, rc = F.when(F.col("turned"), F.col("other")).otherwise(F.col("same")), F.when(F.col("turned"), F.col("same")).otherwise(F.col("other"))
    hits = met.select("read_index", F.explode(F.array(hit("FW", F.col("i"), fw), hit("RC", F.col("last") - F.col("i"), rc))).alias("h"))
    return hits.select("read_index", "h.orientation", "h.i", "h.x.unitig_id", "h.x.strand", "h.x.pos").where("unitig_id IS NOT NULL")


def _map_strings(reads: DataFrame, index: DataFrame, k: int) -> DataFrame:
    both = F.array(F.struct(F.lit("FW").alias("o"), F.col("seq").alias("seq")), F.struct(F.lit("RC").alias("o"), reverse_complement(F.col("seq")).alias("seq")))
    turned = reads.select("read_index", F.explode(both).alias("x")).select("read_index", F.col("x.o").alias("orientation"), "x.seq")
    kmers = explode_kmers(turned, k, "read_index", "orientation").withColumnRenamed("pos", "i")
    known = F.broadcast(index) if index.count() <= BROADCAST_KMERS else index
    return kmers.join(known, "kmer").select("read_index", "orientation", "i", "unitig_id", "strand", "pos")


def unitig_counts(mapping: DataFrame) -> DataFrame:
    """(unitig_id, n): reads that touch each unitig, each orientation for itself."""
    touched = mapping.select("unitig_id", "read_index", "orientation").distinct()
    return touched.groupBy("unitig_id").agg(F.count("*").alias("n"))


def trustable(length: Column, blue: Column, least_blue: int, least_red: int) -> Column:
    """Long enough for a unitig that transcripts touch, or for any."""
    return ((blue > 0) & (length >= least_blue)) | (length >= least_red)


def coloured(unitigs: DataFrame, blue: DataFrame, red: DataFrame, k: int, extra_blue: int = 5, extra_red: int = 15) -> DataFrame:
    """(unitig_id, trustable, tr_count, sr_count, seq)."""
    counts = unitigs.join(blue.withColumnRenamed("n", "tr"), "unitig_id", "left").join(red.withColumnRenamed("n", "sr"), "unitig_id", "left")
    tr, sr = F.coalesce("tr", F.lit(0)), F.coalesce("sr", F.lit(0))
    good = trustable(F.char_length("seq"), tr, k + extra_blue, k + extra_red)
    return counts.select("unitig_id", good.alias("trustable"), tr.alias("tr_count"), sr.alias("sr_count"), "seq")


def unitig_transcripts(mapping: DataFrame) -> DataFrame:
    """(unitig_id, read_index) without repetition."""
    return mapping.select("unitig_id", "read_index").distinct()


def quantified(mapping: DataFrame, colours: DataFrame) -> DataFrame:
    """(read_index, sr_mean): mean short-read count over a transcript's distinct vertices."""
    vertices = mapping.select("read_index", "unitig_id", "strand").distinct()
    return vertices.join(colours.select("unitig_id", "sr_count"), "unitig_id").groupBy("read_index").agg(F.avg("sr_count").alias("sr_mean"))


def runs(mapping: DataFrame) -> DataFrame:
    """One row per run: (read_index, orientation, run, unitig_id, first_i, last_i,
    first_strand, first_pos, last_strand, last_pos)."""
    order = Window.partitionBy("read_index", "orientation").orderBy("i")
    fresh = (F.lag("unitig_id").over(order) == F.col("unitig_id")) & (F.lag("i").over(order) == F.col("i") - 1)
    flagged = mapping.withColumn("fresh", F.when(F.coalesce(fresh, F.lit(False)), 0).otherwise(1))
    ran = flagged.withColumn("run", F.sum("fresh").over(order))
    place = F.struct("i", "strand", "pos")
    grouped = ran.groupBy("read_index", "orientation", "run", "unitig_id").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    return grouped.select(
        "read_index", "orientation", "run", "unitig_id", F.col("a.i").alias("first_i"), F.col("b.i").alias("last_i"),
        F.col("a.strand").alias("first_strand"), F.col("a.pos").alias("first_pos"), F.col("b.strand").alias("last_strand"), F.col("b.pos").alias("last_pos"),
    )


def linked_pairs(ran: DataFrame, colours: DataFrame, k: int) -> DataFrame:
    """All (start, end) pairs of trustable runs of one read that bear a link.

    A start is left at its last k-mer, an end is entered at its first; between
    different unitigs only. ``rank`` is 1 for the nearest end of a start.
    """
    known = colours.where("trustable").select("unitig_id", F.char_length("seq").alias("len"))
    good = ran.join(known, "unitig_id")
    a = good.where(F.col("last_pos") == F.col("len") - k).alias("a")
    b = good.where("first_pos = 0").alias("b")
    same = (F.col("a.read_index") == F.col("b.read_index")) & (F.col("a.orientation") == F.col("b.orientation"))
    pairs = a.join(b, same & (F.col("a.run") < F.col("b.run")) & (F.col("a.unitig_id") != F.col("b.unitig_id")))
    nearest = Window.partitionBy("a.read_index", "a.orientation", "a.run").orderBy("b.run")
    return pairs.select(
        "a.read_index", "a.orientation", F.col("a.unitig_id").alias("src"), F.col("a.last_strand").alias("src_strand"), F.col("a.last_i").alias("i"),
        F.col("b.unitig_id").alias("dst"), F.col("b.first_strand").alias("dst_strand"), F.col("b.first_i").alias("j"), F.row_number().over(nearest).alias("rank"),
    )


def counters(reads: DataFrame, hits: DataFrame, ran: DataFrame, colours: DataFrame, k: int) -> DataFrame:
    """(metric, value): what became of k-mers, links and hints.

    A run at the end of a read starts nothing. A start that isn't left at its last
    k-mer counts once; any other counts every later trustable run: one of the
    same unitig, one not entered at its first k-mer (before or after the start's
    first valid end), or a hint, the first of which is the link too.
    """
    lengths = reads.select("read_index", (F.char_length("seq") - k).alias("at_end"))
    kmers = reads.agg(F.coalesce(F.sum(2 * F.greatest(F.char_length("seq") - k + 1, F.lit(0))), F.lit(0)).alias("kmers"))
    good = colours.where("trustable").select("unitig_id", F.char_length("seq").alias("len"))
    flagged = hits.join(colours.select("unitig_id", "trustable"), "unitig_id")
    seen = flagged.agg(F.count("*").alias("mapped"), F.count(F.when(F.col("trustable"), 1)).alias("good"))
    trusted = ran.join(good, "unitig_id")
    starts = trusted.join(lengths, "read_index").where("last_i < at_end").withColumn("whole", F.col("last_pos") == F.col("len") - k)
    a, b = starts.where("whole").alias("a"), trusted.alias("b")
    pairs = a.join(b, F.expr("a.read_index = b.read_index AND a.orientation = b.orientation AND a.run < b.run"))
    fits = F.col("different") & F.col("entered")
    pairs = pairs.select("a.read_index", "a.orientation", F.col("a.run").alias("run"), F.col("b.run").alias("end"), F.expr("a.unitig_id <> b.unitig_id AS different"), F.expr("b.first_pos = 0 AS entered"))
    earlier = Window.partitionBy("read_index", "orientation", "run").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    pairs = pairs.withColumn("linked", F.coalesce(F.max(fits).over(earlier), F.lit(False)))
    n = lambda c: F.count(F.when(c, 1))
    out = pairs.agg(
        n(~F.col("different")).alias("not_linked_equal_unitig"), n(F.col("different") & ~F.col("entered") & ~F.col("linked")).alias("not_linked_end_not_entered"),
        n(F.col("different") & ~F.col("entered") & F.col("linked")).alias("not_hinted_end_not_entered"), n(fits & ~F.col("linked")).alias("linked"), n(fits).alias("hinted"),
    )
    cut = starts.agg(n(~F.col("whole")).alias("not_linked_start_not_left"))
    one = kmers.join(seen).join(out).join(cut)  # four tables of one row
    values = {
        "kmers_mapped": F.col("mapped"), "kmers_not_mapped": F.col("kmers") - F.col("mapped"), "kmers_on_trustable": F.col("good"),
        "kmers_on_others": F.col("mapped") - F.col("good"), **{c: F.col(c) for c in (*cut.columns, *out.columns)},
    }
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))).alias("metric", "value"))


def linking_edges(pairs: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """(src, src_strand, dst, dst_strand, label, n): links with their commonest label.

    The label is the bases between both unitigs; ties go to the smaller label.
    """
    turned = F.when(F.col("orientation") == "FW", F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    label = F.substring(turned, F.col("i") + k + 1, F.greatest(F.col("j") - F.col("i") - 1, F.lit(0)))
    ends = ["src", "src_strand", "dst", "dst_strand"]
    counted = pairs.where("rank = 1").join(reads.select("read_index", "seq"), "read_index").groupBy(*ends, label.alias("label")).agg(F.count("*").alias("n"))
    best = Window.partitionBy(*ends).orderBy(F.desc("n"), "label")
    return counted.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def hints(pairs: DataFrame) -> DataFrame:
    """Distinct (src, src_strand, dst, dst_strand) of all linked pairs of a read."""
    return pairs.select("src", "src_strand", "dst", "dst_strand").distinct()


def mate_hints(mapping: DataFrame, colours: DataFrame, mates: DataFrame) -> DataFrame:
    """Distinct hints from every trustable vertex of a left read to every one of
    its right mate read on the other strand, and mirrored.

    ``mates``: (left, right) read indices.
    """
    good = colours.where("trustable").select("unitig_id")
    vertices = mapping.join(good, "unitig_id", "left_semi").select("read_index", "orientation", "unitig_id", "strand").distinct()
    a, b = vertices.alias("a"), vertices.alias("b")
    turned = mates.selectExpr("left AS x", "right AS y").unionAll(mates.selectExpr("right AS x", "left AS y")).alias("m")
    met = a.where("orientation = 'FW'").join(turned, F.col("a.read_index") == F.col("m.x")).join(b.where("orientation = 'RC'"), F.col("m.y") == F.col("b.read_index"))
    return met.selectExpr("a.unitig_id AS src", "a.strand AS src_strand", "b.unitig_id AS dst", "b.strand AS dst_strand").distinct()


def vertices(colours: DataFrame, k: int) -> DataFrame:
    """Two oriented vertices for each coloured unitig, weighted by its k-mers."""
    both = F.explode(F.array(F.struct(F.lit("F").alias("strand"), F.col("seq").alias("seq")), F.struct(F.lit("R").alias("strand"), reverse_complement(F.col("seq")).alias("seq"))))
    return colours.select("unitig_id", "trustable", "tr_count", "sr_count", both.alias("x")).select(
        "unitig_id", "x.strand", "trustable", "tr_count", "sr_count", "x.seq", (F.char_length("x.seq") - k + 1).alias("weight")
    )


def without_blue_only(vertex: DataFrame) -> DataFrame:
    """Vertices but for those that transcripts touch and no short read does."""
    return vertex.where("NOT (tr_count > 0 AND sr_count = 0)")


def reassembled(mapping: DataFrame, unitigs: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """(read_index, same): whether a read's forward hits spell the read.

    Each hit gives the base at its place, and the first one a whole k-mer; a read
    with a k-mer missing isn't spelled.
    """
    turned = F.when(F.col("strand") == "F", F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    hits = mapping.where("orientation = 'FW'").join(unitigs.select("unitig_id", "seq"), "unitig_id")
    kmer = F.substring(turned, F.col("pos") + 1, F.lit(k))
    parts = hits.select("read_index", F.struct("i", F.when(F.col("i") == 0, kmer).otherwise(F.right(kmer, F.lit(1))).alias("s")).alias("x"))
    spelled = parts.groupBy("read_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "").alias("spelled"))
    return reads.join(spelled, "read_index", "left").select("read_index", F.coalesce(F.col("spelled") == F.col("seq"), F.lit(False)).alias("same"))


def quantified_paths(paths: DataFrame) -> DataFrame:
    """Paths (nodes: array of struct with sr_count) by falling mean short-read count."""
    total = F.aggregate("nodes", F.lit(0.0), lambda a, n: a + n["sr_count"])
    return paths.withColumn("sr_mean", total / F.size("nodes")).orderBy(F.desc("sr_mean"))


def edge_list(links: DataFrame, vertex: DataFrame) -> DataFrame:
    """(src, dst, weight): named vertices and the weight of the end, for graph viewers."""
    end = vertex.select(F.col("unitig_id").alias("dst"), F.col("strand").alias("dst_strand"), "weight")
    name = lambda u, s: F.concat_ws("_", F.col(u).cast("string"), F.col(s))
    return links.join(end, ["dst", "dst_strand"]).select(name("src", "src_strand").alias("src"), name("dst", "dst_strand").alias("dst"), "weight")
