"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java character class body and as literal characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    local master (tests) gets a temporary folder of its own; any other master
    is an error, since a machine-local folder would lose data there.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = java.get() if java.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset on a cluster")
        base = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Lets a query delete its shuffle files when it ends, not when the driver collects its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that survive a lost executor. With ``tidy`` the shuffle
    files behind the table are deleted as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strandloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY)
    if tidy:
        spark.conf.set(_TIDY, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)  # planned anew, under this setting
    finally:
        spark.conf.set(_TIDY, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._strandloom_path = path
    return back


def release(df: DataFrame) -> None:
    """Delete the files behind a table that :func:`materialise` wrote."""
    spark = df.sparkSession
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._strandloom_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint, if the table has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where the
    body uses it many times or inside a nested lambda."""
    return F.transform(F.array(value), body)[0]


def no_null(text: str | Column = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def space_words(text: Column) -> Column:
    """Array of the ``[^\\x20\\x09-\\x0D]+`` words of a text that isn't null."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def count_space_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words, without building a filtered array."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_CLASS + "+"))).cast("long")


def sql_crc32(codes: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of a list of byte values."""
    entries = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        entries.append(str(value))
    step = f"lambda c, b: xor(c >> 8, CAST([{', '.join(entries)}] AS BIGINT[])[1 + (xor(c, b) & 255)])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST({codes} AS BIGINT[])), {step}), 4294967295)"
