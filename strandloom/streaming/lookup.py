"""Incremental mapping of arriving reads against a fixed k-mer index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import canonical, explode_kmers
from strandloom.operators.mapping import map_reads


def stream_hits(reads: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Hits of a stream of (read_index, seq): a stateless stream-static join."""
    return map_reads(reads, index, k)


def stream_unitig_counts(reads: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Running hit counts of each unitig, for the update or complete mode.

    The state is one row per unitig.
    """
    return map_reads(reads, index, k).groupBy("unitig_id").agg(F.count("*").alias("hits"))


def stream_kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """Running counts of canonical k-mers."""
    return explode_kmers(reads, k).groupBy(canonical(F.col("kmer")).alias("kmer")).agg(F.count("*").alias("n"))


def stream_windowed_counts(reads: DataFrame, index: DataFrame, k: int, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Hits of each unitig in tumbling windows of the reads' ``ts``; older state goes at the watermark."""
    kmers = explode_kmers(reads.withWatermark("ts", late), k, "ts")
    hits = kmers.join(index.select("kmer", "unitig_id"), "kmer")
    return hits.groupBy(F.window("ts", width), "unitig_id").agg(F.count("*").alias("hits"))
