"""Tables written to the folder that the cluster shares, to cut long lineages."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def base_folder(spark: SparkSession) -> str:
    """The folder below which all tables are written: ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    A local session without either gets a temporary folder; on a cluster one of
    them is required.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = java.get() if java.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset on a cluster")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/strandloom-tables"


def folder(spark: SparkSession, name: str) -> str:
    """A new path below :func:`base_folder`."""
    return f"{base_folder(spark)}/{name}-{uuid.uuid4().hex}"


def folder_of(spark: SparkSession, name: str, *inputs: DataFrame) -> str:
    """A path that stands for these input files as they are now, in this application.

    Another size or time of a file gives another path.
    """
    conf, seen = spark._jsc.hadoopConfiguration(), [spark.sparkContext.applicationId]
    for file in sorted(f for df in inputs for f in df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(conf).getFileStatus(path)
        seen += [file, str(status.getLen()), str(status.getModificationTime())]
    return f"{base_folder(spark)}/{name}-{hashlib.md5(chr(10).join(seen).encode()).hexdigest()}"


#: Tables written inside each call of :func:`settled` that is still running.
_OPEN: list[list[DataFrame]] = []


def settled(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Write what ``make`` returns, and delete the tables that it wrote on the way."""
    _OPEN.append([])
    try:
        made = written(make(), name)
    finally:
        inside = _OPEN.pop()
    dropped(*(t for t in inside if t is not made))
    if _OPEN:
        _OPEN[-1].append(made)
    return made


def kept(make: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """Tables that ``make`` wrote, without those that it wrote on the way."""
    _OPEN.append([])
    try:
        made = make()
    finally:
        inside = _OPEN.pop()
    dropped(*(t for t in inside if not any(t is m for m in made)))
    if _OPEN:
        _OPEN[-1].extend(made)
    return made


#: Lets a query delete its shuffle files when it ends, not when the driver collects its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The files survive a lost executor; the shuffle files behind them go as soon as they are written.
    """
    path, conf = folder(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_TIDY)
    conf.set(_TIDY, "true")
    try:
        df.select("*").write.parquet(path)  # planned anew, under this setting
    finally:
        conf.set(_TIDY, before)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._strandloom_path = path
    if _OPEN:
        _OPEN[-1].append(back)
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete the files behind tables that :func:`written` made and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._strandloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to the end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def saved(df: DataFrame, path: str, resume: bool = False) -> DataFrame:
    """Save a step's table, or with ``resume`` reuse the one a finished run left."""
    spark = df.sparkSession
    if not (resume and finished(spark, path)):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
