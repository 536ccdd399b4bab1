"""Sequence files as DataFrames: FASTA by Spark's own text reader, FASTQ by a data source of byte ranges."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.plans.checkpoints import written
from strandloom.sources import fastq


def read_fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, header, seq): one row per record; wrapped sequences are joined and
    upper-cased. Records are split by the reader, so one file feeds many tasks."""
    raw = spark.read.option("lineSep", "\n>").text(list(paths)).where("trim(value) <> ''")
    lines = F.split(F.regexp_replace("value", "^>", ""), "\r?\n", 2)
    seq = F.upper(F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s", ""))
    return raw.select(F.input_file_name().alias("file"), F.trim(F.get(lines, F.lit(0))).alias("header"), seq.alias("seq"))


def _fastq_ranges(spark: SparkSession, paths: tuple[str, ...], split: int) -> DataFrame:
    """(file, start, place, header, seq, qual) of every record.

    Files that pyarrow can open are read by :mod:`strandloom.sources.fastq` in ranges.
    For a store that only Spark can read, lines are numbered by the sizes of the
    blocks before them and met by record.
    """
    try:
        for p in paths:
            fs.FileSystem.from_uri(p)
    except pa.ArrowInvalid:
        lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("line"), F.monotonically_increasing_id().alias("at"))
        sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        numbered = lines.join(sizes.select("file", "block", (before - F.col("first")).alias("shift")), ["file", "block"]).withColumn("i", F.col("at") + F.col("shift"))
        of = lambda k: F.max(F.when(F.col("i") % 4 == k, F.col("line")))
        rows = numbered.groupBy("file", F.floor(F.col("i") / 4).alias("place")).agg(of(0).alias("h"), of(1).alias("s"), of(3).alias("qual")).where("qual IS NOT NULL")
        return rows.select("file", F.lit(0).cast("long").alias("start"), "place", F.expr("substring(h, 2)").alias("header"), F.upper("s").alias("seq"), "qual")
    spark.dataSource.register(fastq.FastqSource)
    return spark.read.format("fastq").option("paths", "\n".join(paths)).option("split", split).load()


def read_fastq(spark: SparkSession, *paths: str, split: int = fastq.SPLIT, across_files: bool = False) -> DataFrame:
    """(file, read_index, header, seq, qual): records of four lines.

    ``read_index`` counts within a file, or with ``across_files`` through all files in
    the order of their names. Ranges number their records by themselves; the sizes
    of the ranges before them, one row for each range, shift those numbers. The rows are
    written once, so a file is read once.
    """
    rows = written(_fastq_ranges(spark, paths, split), "fastq")
    sizes = rows.groupBy("file", "start").agg(F.count("*").alias("n"))
    order = Window.orderBy("file", "start") if across_files else Window.partitionBy("file").orderBy("start")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(sizes.select("file", "start", before.alias("before")), ["file", "start"])
    return placed.select("file", (F.col("before") + F.col("place")).alias("read_index"), "header", "seq", "qual")


def read_pairs(spark: SparkSession, left: str, right: str, split: int = fastq.SPLIT) -> DataFrame:
    """(read_index, left, right): records of two FASTQ files, or of two folders of parts, by their place."""
    part = F.struct("header", "seq")
    a = read_fastq(spark, left, split=split, across_files=True).select("read_index", part.alias("left"))
    return a.join(read_fastq(spark, right, split=split, across_files=True).select("read_index", part.alias("right")), "read_index")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a file that aren't empty."""
    return spark.read.text(path).where("value <> ''")


def listed_files(spark: SparkSession, path: str) -> list[str]:
    """Paths named in a list file; an error names the first that doesn't exist."""
    names = [r["value"].strip() for r in read_lines(spark, path).collect()]  # a file list, written by hand
    conf = spark._jsc.hadoopConfiguration()
    for name in names:
        there = spark._jvm.org.apache.hadoop.fs.Path(name)
        if not there.getFileSystem(conf).exists(there):
            raise FileNotFoundError(name)
    return names


def read_cdna(spark: SparkSession, *paths: str) -> DataFrame:
    """As :func:`read_fasta`, with transcript and gene from the description."""
    word = F.split("header", " ")
    return read_fasta(spark, *paths).withColumns({"transcript_id": F.get(word, F.lit(0)), "gene": F.get(F.split(F.get(word, F.lit(3)), ":"), F.lit(1))})


def read_genome(spark: SparkSession, folder: str) -> DataFrame:
    """(chr, seq) of a folder of ``<chr>.fa`` files."""
    name = F.regexp_extract("file", r"([^/]+)\.fa(\.gz)?(/[^/]*)?$", 1)  # a file, or a folder of parts
    return read_fasta(spark, f"{folder}/*.fa*").select(name.alias("chr"), "seq")


def read_bubble_fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """(id, a_header, a, b_header, b): records 2i and 2i + 1 of a file form bubble i.

    Records keep their order within a file; the places of its parts are added up
    from their sizes, so a file is still read by many tasks. Ids run on over files.
    """
    rows = read_fasta(spark, *paths).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    sizes = rows.groupBy("part", "file").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    order = Window.partitionBy("file").orderBy("first")
    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    files = sizes.groupBy("file").agg(F.ceil(F.sum("n") / 2).alias("pairs"))
    shift = F.coalesce(F.sum("pairs").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.join(files.select("file", shift.alias("shift")), "file").select("part", "file", "first", "before", "shift")
    within = F.row_number().over(Window.partitionBy("file", "part").orderBy("at")) - 1
    placed = rows.withColumn("within", within).join(starts, ["part", "file"]).withColumn("place", F.col("before") + F.col("within"))
    placed = placed.withColumns({"id": F.col("shift") + F.floor(F.col("place") / 2), "side": F.col("place") % 2})
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return placed.groupBy("id").agg(pick(0, "header").alias("a_header"), pick(0, "seq").alias("a"), pick(1, "header").alias("b_header"), pick(1, "seq").alias("b"))


def write_fasta(df: DataFrame, path: str, header: Column, seq: str = "seq") -> None:
    """One header line and one sequence line per row."""
    df.select(F.concat(F.lit(">"), header, F.lit("\n"), F.col(seq))).write.mode("overwrite").text(path)


def write_unitigs(unitigs: DataFrame, path: str) -> None:
    """Unitigs as FASTA with headers ``<id>__len__<length> ``; their coverages and
    their number go to tables of their own."""
    write_fasta(unitigs, f"{path}/unitigs", F.format_string("%d__len__%d ", "unitig_id", "len"))
    unitigs.select("unitig_id", "coverage").write.mode("overwrite").parquet(f"{path}/coverage")
    unitigs.agg(F.count("*").alias("unitigs")).write.mode("overwrite").parquet(f"{path}/count")


def read_unitig_count(spark: SparkSession, path: str) -> int:
    """The number that :func:`write_unitigs` left."""
    return spark.read.parquet(f"{path}/count").first()["unitigs"]


def records_with(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Records whose transcript_id is in a list (transcript_id)."""
    return rows.join(ids.select("transcript_id").distinct(), "transcript_id", "left_semi")


def fasta_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sequences of one side only, counted, ignoring order and headers."""
    one = a.select(F.upper("seq").alias("seq")).exceptAll(b.select(F.upper("seq").alias("seq"))).withColumn("side", F.lit("a"))
    return one.unionByName(b.select(F.upper("seq").alias("seq")).exceptAll(a.select(F.upper("seq").alias("seq"))).withColumn("side", F.lit("b")))


def paired_header(header: Column, place: Column) -> Column:
    """``Bubble_<a>_...`` with the number of the pair, two records each, in place of the rest."""
    parts = F.split(header, "_")
    return F.concat_ws("_", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.floor(place / 2).cast("string"))


def bubbles_with(bubbles: DataFrame, *patterns: str) -> DataFrame:
    """Bubbles whose headers hold every pattern, in either record."""
    kept = F.lit(True)
    for p in patterns:
        kept = kept & (F.col("a_header").contains(p) | F.col("b_header").contains(p))
    return bubbles.where(kept)
