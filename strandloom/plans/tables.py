"""Driver tables read as sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequence import encode_text

#: Documents of this source play the transcriptome, all others the short reads.
TRANSCRIPTS = "src0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_index, transcript, seq) of every document, whole texts."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("read_index"),
        (F.coalesce(F.col("source"), F.lit("")) == TRANSCRIPTS).alias("transcript"),
        encode_text(F.col("text")).alias("seq"),
    )


#: Bases of each piece of a benchmark item, and how many it shares with the next one.
CONTIG = 40
OVERLAP = 14


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unitig_id, seq): whole benchmark items."""
    whole = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("unitig_id"), encode_text(F.col("text")).alias("seq"))
    return whole.where("seq <> ''")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unitig_id, seq): benchmark items in overlapping pieces, which play the
    unitigs in the mapping queries; a passage copied into a document links its
    pieces, and every k-mer of :data:`OVERLAP` + 1 bases lies in one of them."""
    step = CONTIG - OVERLAP
    last = F.greatest(F.lit(0), F.ceil((F.char_length("seq") - OVERLAP) / step) - 1).cast("int")
    pieces = items(spark, sf_dir).select("unitig_id", "seq", F.explode(F.sequence(F.lit(0), last)).alias("p"))
    return pieces.select((F.col("unitig_id") * 1_000_000 + F.col("p")).alias("unitig_id"), F.substring(F.col("seq"), F.col("p") * step + 1, F.lit(CONTIG)).alias("seq"))


def _exon(name: str, first: str, last: str):
    """Random bases of a benchmark item, from digests: 98 between two given ones."""
    digests = [F.md5(F.concat_ws("/", F.col("item_id").cast("string"), F.lit(f"{name}{i}"), F.coalesce("text", F.lit("")))) for i in range(3)]
    bases = F.translate(F.concat(*digests), "0123456789abcdef", "ACGT" * 4)
    return F.concat(F.lit(first), bases, F.lit(last))


#: Bases of an exon of the planted events.
EXON = 98


def isoforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, kind, known, novel): the isoforms behind :func:`planted`."""
    a, b, c = _exon("a", "A", "G"), _exon("b", "A", "T"), _exon("c", "C", "A")
    rows = table(spark, sf_dir, "benchmark").where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), a.alias("a"), b.alias("b"), c.alias("c"))
    kind = F.pmod("item_id", F.lit(4))
    full, short = F.concat("a", "b", "c"), F.concat("a", "c")
    changed = F.concat("a", F.substring("b", 1, 50), F.translate(F.substring("b", 51, 1), "ACGT", "CGTA"), F.substring("b", 52, 1000), "c")
    known = F.when(kind == 1, short).otherwise(full)
    novel = F.when(kind == 1, full).when(kind == 2, changed).otherwise(short)
    return rows.select("item_id", kind.alias("kind"), known.alias("known"), novel.alias("novel"))


def planted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Transcripts (read_index, header, seq) and short reads (read_index, seq) with a known event for each benchmark item.

    By item_id modulo 4: 0 an exon that reads skip, 1 an exon that reads gain, 2
    one base that differs in reads (no event), 3 a skipped exon that only a single
    read shows (no event). Reads of odd items come from the other strand.
    """
    rows = isoforms(spark, sf_dir)
    transcripts = rows.select(F.col("item_id").alias("read_index"), F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("header"), F.col("known").alias("seq"))
    copies = F.array_repeat("known", 3), F.array_repeat("novel", F.when(F.col("kind") == 3, 1).otherwise(3))
    reads = rows.select("item_id", F.posexplode(F.concat(*copies)).alias("n", "seq"))
    seq = F.when(F.col("item_id") % 2 != 0, F.reverse(F.translate("seq", "ACGT", "TGCA"))).otherwise(F.col("seq"))
    return transcripts, reads.select((F.col("item_id") * 10 + F.col("n")).alias("read_index"), seq.alias("seq"))
