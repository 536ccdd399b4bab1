"""Annotation files (GTF) and tab-separated graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequence import fill_header

GTF = "chr string, source string, feature string, start int, end int, score string, strand string, frame string, attrs string"


def attribute(name: str) -> Column:
    """Value of an attribute such as ``gene_id "X";``, or null."""
    value = F.regexp_extract("attrs", rf'(?:^|; *){name} "?([^";]*)"?', 1)
    return F.when(value != "", value)


def read_gtf(spark: SparkSession, *paths: str, feature: str | None = None) -> DataFrame:
    """Rows of GTF files without comments; of one feature, if named."""
    rows = spark.read.schema(GTF).options(sep="\t", comment="#", quote="").csv(list(paths))
    return rows.where(F.col("feature") == feature) if feature else rows


def read_exons(spark: SparkSession, *paths: str) -> DataFrame:
    """(transcript_id, gene_name, chr, strand, exons): exons sorted by start."""
    rows = read_gtf(spark, *paths, feature="exon").select("chr", "strand", "start", "end", attribute("transcript_id").alias("transcript_id"), attribute("gene_name").alias("gene_name"))
    return rows.groupBy("transcript_id", "gene_name", "chr", "strand").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"))


def read_transcripts(spark: SparkSession, *paths: str) -> DataFrame:
    """(gene_id, transcript_id) of the transcript rows."""
    return read_gtf(spark, *paths, feature="transcript").select(attribute("gene_id").alias("gene_id"), attribute("transcript_id").alias("transcript_id"))


def read_events(spark: SparkSession, *paths: str) -> DataFrame:
    """Splice events: transcripts of both variants, flanks and both splice chains."""
    rows = read_gtf(spark, *paths, feature="as_event")
    names = F.split(attribute("transcript_id"), ",")
    chains = F.split(attribute("splice_chain"), ",")
    return rows.select(
        "chr", "strand", attribute("gene_id").alias("gene_id"), F.get(names, F.lit(0)).alias("transcripts_1"), F.get(names, F.lit(1)).alias("transcripts_2"),
        attribute("flanks").alias("flanks"), F.get(chains, F.lit(0)).alias("chain_1"), F.get(chains, F.lit(1)).alias("chain_2"),
    )


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id): the first column of a list with a header line."""
    return spark.read.schema("gene_id string").options(sep="\t", header=True).csv(path)


def gene_transcripts(transcripts: DataFrame) -> DataFrame:
    """(gene_id, transcripts): sorted transcripts of each gene."""
    return transcripts.groupBy("gene_id").agg(F.array_sort(F.collect_set("transcript_id")).alias("transcripts"))


def on_chromosomes(rows: DataFrame, *names: str) -> DataFrame:
    """Rows of the named chromosomes."""
    return rows.where(F.col("chr").isin(*names))


def genes_in_list(rows: DataFrame, genes: DataFrame) -> DataFrame:
    """GTF rows whose gene_id is in a list (gene_id)."""
    return rows.withColumn("x_gene", attribute("gene_id")).join(genes.select(F.col("gene_id").alias("x_gene")), "x_gene", "left_semi").drop("x_gene")


def split_by_gene(rows: DataFrame, path: str) -> None:
    """One folder of rows for each gene."""
    rows.withColumn("gene_id", attribute("gene_id")).write.mode("overwrite").partitionBy("gene_id").parquet(path)


NODES = "unitig_id long, seq string"
EDGES = "src long, dst long, label string"
COLOURED = "unitig_id long, trustable boolean, tr_count long, sr_count long, seq string"


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t")


# The templates of the headers.
PLAIN = "Bubble_id=[id];Length=[length];[label]_sequence"
DETAILED = "Bubble_id=[id];Transcript=[transcript];Length=[length];Branches=[branches];[label]_sequence;Edit_distance=[edit_distance];Read_index=[read_index];Path=[path]"


def bubble_records(bubbles: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(kind, event_type, read_index, place, header, seq): FASTA records of bubbles.

    ``blat``: each class of a transcript's bubbles begins with the transcript
    (read_index, header, seq), then come the alternative paths; ``bubbles.detailed``:
    both paths of every bubble; ``blat.clustered``: as blat, without paths that are
    similar to one before.
    """
    rows = bubbles.join(transcripts.select("read_index", F.col("header").alias("t_header"), F.col("seq").alias("t_seq")), "read_index")
    bubble = F.col("bubble_id") - 1  # bubbles of a transcript are numbered from 0

    def record(kind, place, header, seq):
        return F.struct(F.lit(kind).alias("kind"), place.cast("long").alias("place"), header.alias("header"), seq.alias("seq"))

    def header(template, label, seq, transcript, branches, path):
        return fill_header(
            template, id=bubble, transcript=transcript, length=F.char_length(seq), branches=branches, label=label, edit_distance=F.col("edit_distance"),
            read_index=F.col("read_index"), path=path,
        )

    novel = F.concat(F.lit("Novel_"), F.when(F.col("label") == "IR", "intron").otherwise(F.col("label")))
    alt, orig = F.col("alt_seq"), F.col("orig_seq")
    plain = header(PLAIN, novel, alt, F.lit("Novel"), F.col("n_branches"), F.col("path"))
    known = header(DETAILED, F.lit("Original_LR"), orig, F.col("t_header"), F.lit("N/A"), F.col("orig_path"))
    other = header(DETAILED, novel, alt, F.lit("Novel"), F.col("n_branches"), F.col("path"))
    records = F.array(
        record("blat", bubble + 1, plain, alt), F.when(F.col("representative"), record("blat.clustered", bubble + 1, plain, alt)),
        record("bubbles.detailed", 2 * bubble + 1, known, orig), record("bubbles.detailed", 2 * bubble + 2, other, alt),
    )
    every = rows.select("event_type", "read_index", F.explode(F.filter(records, lambda r: r.isNotNull())).alias("r")).select("r.kind", "event_type", "read_index", "r.place", "r.header", "r.seq")
    first = rows.select("event_type", "read_index", "t_header", "t_seq").distinct()
    first = first.select(F.explode(F.array(F.lit("blat"), F.lit("blat.clustered"))).alias("kind"), "event_type", "read_index", F.lit(0).cast("long").alias("place"), F.col("t_header").alias("header"), F.col("t_seq").alias("seq"))
    return every.unionByName(first)


def write_bubbles(bubbles: DataFrame, transcripts: DataFrame, path: str) -> None:
    """The records as FASTA lines, in a folder for each kind and class."""
    rows = bubble_records(bubbles, transcripts).repartitionByRange("kind", "event_type", "read_index").sortWithinPartitions("kind", "event_type", "read_index", "place")
    rows.select("kind", "event_type", F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value")).write.mode("overwrite").partitionBy("kind", "event_type").text(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """``name = value`` lines."""
    stats.select(F.format_string("%s = %d", "metric", "value")).write.mode("overwrite").text(path)
