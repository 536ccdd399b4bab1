"""The whole run, from sequence files to bubbles, as a command.

    python -m strandloom.plans.enhance -t transcripts.fa -sesr reads.txt -prefix out

Steps write their tables below the prefix; a skip option takes a step's table
from an earlier run instead of computing it.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.operators import bubbles, kmers, mapping, unitigs
from strandloom.plans.checkpoints import saved
from strandloom.sources import annotation, sequences


@dataclass
class Options:
    """Defaults are those of the command line."""

    transcripts: str
    single_reads: str | None = None
    paired_reads: str | None = None
    prefix: str = "graph"
    k: int = 31
    min_abundance: int = 2
    rel_cutoff: float = 0.02
    min_blue: int = 5
    min_red: int = 15
    max_length_intron: int = 11100
    max_length_as: int = 2000
    complexity_ir: int = 1
    complexity_as: int = 10
    min_edit_distance: float = 0.2
    skip_sr: bool = False
    skip_tr: bool = False
    skip_merged: bool = False
    skip_mapping: bool = False

    def check(self) -> None:
        if not 1 < self.k < 64:
            raise ValueError("k must lie between 2 and 63")
        if not (self.single_reads or self.paired_reads):
            raise ValueError("short reads are missing: -sesr or -pesr")


def _reads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, place, header, seq) of FASTA and FASTQ files."""
    fastq = [p for p in paths if any(x in p.lower() for x in (".fq", ".fastq"))]
    fasta = [p for p in paths if p not in fastq]
    parts = []
    if fasta:
        parts.append(sequences.read_fasta(spark, *fasta).select("file", F.monotonically_increasing_id().alias("place"), "header", "seq"))
    if fastq:
        parts.append(sequences.read_fastq(spark, *fastq).select("file", F.col("read_index").alias("place"), "header", "seq"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _numbered(reads: DataFrame) -> DataFrame:
    """Adds read_index: unique, and stable once the table is saved."""
    return reads.withColumn("read_index", F.monotonically_increasing_id())


def run(spark: SparkSession, options: Options) -> DataFrame:
    """All steps; returns the bubbles and leaves the tables below the prefix."""
    options.check()
    k, out = options.k, options.prefix
    step = lambda df, name, skip=False: saved(df, f"{out}/{name}", skip)

    single = sequences.listed_files(spark, options.single_reads) if options.single_reads else []
    paired = sequences.listed_files(spark, options.paired_reads) if options.paired_reads else []
    reads = step(_numbered(_reads(spark, single + paired)), "reads", options.skip_sr)
    transcripts = step(_numbered(_reads(spark, [options.transcripts])), "transcripts", options.skip_tr)

    solid_sr = step(kmers.count_kmers(reads, k, options.min_abundance, pack=True), "sr_kmers", options.skip_sr)
    solid_tr = step(kmers.count_kmers(transcripts, k, pack=True), "tr_kmers", options.skip_tr)
    weak = kmers.weak_edges(kmers.edges(solid_sr, k), options.rel_cutoff, k)
    removed = step(kmers.rescue(weak, kmers.edges(solid_tr, k)), "removed_edges", options.skip_merged)
    merged = solid_sr.unionByName(solid_tr).groupBy("kmer").agg(F.max("n").alias("n"))
    graph = step(kmers.without_edges(kmers.edges(merged, k), removed), "edges", options.skip_merged)
    nodes = step(unitigs.numbered(unitigs.compact(merged, graph, k)), "unitigs", options.skip_merged)
    annotation.write_tsv(nodes.select("unitig_id", "seq"), f"{out}/nodes.tsv")
    annotation.write_tsv(unitigs.unitig_edges(nodes, k), f"{out}/edges.tsv")

    index = step(unitigs.index(nodes, k), "index", options.skip_merged)
    blue = step(mapping.map_reads(transcripts, index, k), "tr_mapping", options.skip_mapping)
    red = step(mapping.map_reads(reads, index, k), "sr_mapping", options.skip_mapping)
    colours = mapping.coloured(nodes, mapping.unitig_counts(blue), mapping.unitig_counts(red), k, options.min_blue, options.min_red)
    colours = step(colours, "coloured", options.skip_mapping)
    pairs = step(mapping.linked_pairs(mapping.runs(red), colours, k), "pairs", options.skip_mapping)
    links = step(mapping.linking_edges(pairs, reads, k), "links", options.skip_mapping)
    hint = mapping.hints(pairs)
    if paired:
        side = F.array_position(F.array(*(F.lit(p.rsplit("/", 1)[-1]) for p in paired)), F.element_at(F.split("file", "/"), -1)).cast("int") - 1
        mates = reads.withColumn("side", side).where("side >= 0")
        both = Window.partitionBy(F.floor(F.col("side") / 2), "place").orderBy("side")
        mates = mates.withColumn("right", F.lead("read_index").over(both)).where("right IS NOT NULL").selectExpr("read_index AS left", "right")
        hint = hint.unionByName(mapping.mate_hints(red, colours, mates)).distinct()
    hint = step(hint, "hints", options.skip_mapping)

    limits = bubbles.Limits(k, options.max_length_as, options.max_length_intron, options.complexity_as, options.complexity_ir, options.min_edit_distance)
    vertex = mapping.without_blue_only(mapping.vertices(colours, k))
    found = step(bubbles.find_bubbles(blue, transcripts.select("read_index", "seq"), vertex, links, hint, limits), "bubbles")
    annotation.write_bubbles(found, transcripts, f"{out}/alternative_paths")
    counted = mapping.counters(reads, red, mapping.runs(red), colours, k).unionByName(bubbles.stats(found))
    annotation.write_stats(counted, f"{out}/final_stats")
    return found


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="enhance", description="Alternative paths of transcripts, from short reads.")
    p.add_argument("-t", dest="transcripts", required=True)
    for flag, name, kind in (
        ("-sesr", "single_reads", str), ("-pesr", "paired_reads", str), ("-prefix", "prefix", str), ("-k", "k", int), ("-min_abundance", "min_abundance", int),
        ("-rel_cutoff", "rel_cutoff", float), ("-minSizeBlueUnitigs", "min_blue", int), ("-minSizeRedUnitigs", "min_red", int),
        ("-max_length_intron", "max_length_intron", int), ("-max_length_as", "max_length_as", int), ("-splicing_complexity_IR", "complexity_ir", int),
        ("-splicing_complexity_AS", "complexity_as", int), ("-min_edit_distance", "min_edit_distance", float),
    ):
        p.add_argument(flag, dest=name, type=kind, default=getattr(Options, name))
    for flag, name in (("-skipSR", "skip_sr"), ("-skipTR", "skip_tr"), ("-skipMerged", "skip_merged"), ("-skip2", "skip_mapping")):
        p.add_argument(flag, dest=name, action="store_true")
    p.add_argument("-skip1", action="store_true", help="same as -skipSR -skipTR -skipMerged")
    return p


def main(argv: list[str] | None = None) -> None:
    given = vars(parser().parse_args(argv))
    if given.pop("skip1"):
        given |= {"skip_sr": True, "skip_tr": True, "skip_merged": True}
    run(SparkSession.builder.getOrCreate(), Options(**given))


if __name__ == "__main__":
    main()
