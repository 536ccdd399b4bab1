"""Read simulation and sampling, deterministic by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import reverse_complement


def simulate_reads(transcripts: DataFrame, length: int = 101, step: int = 30) -> DataFrame:
    """(read_index, start, seq): windows of each transcript, half of them turned.

    A window starts every ``step`` bases while it ends before the last base.
    """
    last = F.char_length("seq") - length - 1
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step)))
    cut = transcripts.select("read_index", "seq", F.explode(starts).alias("start"))
    piece = F.substring(F.col("seq"), F.col("start") + 1, F.lit(length))
    turned = F.substring(F.md5(F.concat_ws("/", "read_index", "start")), 1, 1) >= "8"
    return cut.select("read_index", "start", F.when(turned, reverse_complement(piece)).otherwise(piece).alias("seq"))


def sample_per_group(rows: DataFrame, group: str, key: str, share: float = 0.1) -> DataFrame:
    """The rows of each group with the smallest digests: a share, one at least.

    A group is counted by the first three digits of the digests, which tells in which
    of them the share ends; rows are ranked within such a part only, so
    no task sorts a whole group.
    """
    digest = F.md5(F.col(key).cast("string"))
    keyed = rows.withColumns({"x_digest": digest, "x_part": F.left(digest, F.lit(3))})
    parts = keyed.groupBy(F.col(group).alias("x_group"), F.coalesce("x_part", F.lit("")).alias("x_of")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("x_group")
    before = F.coalesce(F.sum("n").over(own.orderBy("x_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.greatest(F.lit(1), F.floor(F.sum("n").over(own) * share))
    needed = parts.select("x_group", "x_of", (take - before).alias("x_need")).where("x_need > 0")
    met = keyed.join(needed, F.col(group).eqNullSafe(F.col("x_group")) & (F.coalesce("x_part", F.lit("")) == F.col("x_of")))
    place = F.row_number().over(Window.partitionBy("x_group", "x_of").orderBy("x_digest", key))
    return met.withColumn("x_place", place).where("x_place <= x_need").select(*rows.columns)


def shallow_and_rest(transcripts: DataFrame, group: str, key: str, share: float = 0.1, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """A shallow transcriptome of long enough rows, and what is left out of it."""
    usable = transcripts.where(F.char_length("seq") >= least)
    shallow = sample_per_group(usable, group, key, share)
    return shallow, transcripts.join(shallow.select(key), key, "left_anti")
