"""Helpers that the training-data operators share: the shared work folder, written cuts, ranks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as the contracts define them (fixed values).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, one of this program's, on a local master only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="medloom-"))
        where = _own[0]
    return where.rstrip("/")


#: The folder of this program where the setting is unset; paths of ``folder`` that are still there.
_own: list[str] = []
_going: dict[str, tuple] = {}


def folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, whose files go at the latest when the program ends."""
    path = f"{shared_dir(spark)}/medloom/{tag}-{uuid.uuid4().hex}"
    if not _going:
        atexit.register(_gone)
    _going[path] = _place(spark, path)
    return path


def _place(spark: SparkSession, path: str) -> tuple:
    """A path as Hadoop knows it, and the settings to reach it."""
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()


def _gone() -> None:
    for hadoop, settings in _going.values():
        try:
            hadoop.getFileSystem(settings).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the JVM is gone already: the files stay
            return


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path of ``folder``."""
    _going.pop(path, None)
    hadoop, settings = _place(spark, path)
    hadoop.getFileSystem(settings).delete(hadoop, True)


#: Files of written steps, by the step.
_paths: dict[int, tuple] = {}


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    The files go when they are discarded, or when the program ends.
    """
    spark = df.sparkSession
    path = folder(spark, tag)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the step's shuffle files go when it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


def discard(*steps: DataFrame) -> None:
    """Deletes the files of written steps that nothing needs any more: what came of them is written itself."""
    for df in steps:
        removed(df.sparkSession, _paths.pop(id(df))[1])


@contextmanager
def stage():
    """Deletes at its end the files of all steps written within it, but for the steps given to what it yields."""
    before = set(_paths)
    held: list[DataFrame] = []
    yield held.append
    for key in [k for k in _paths if k not in before and all(_paths[k][0] is not h for h in held)]:
        discard(_paths[key][0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: str | Column) -> Column:
    """Number of words of a text; null counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def named(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The distinct keys of ``rows`` with ``name``, an integer that no other key has.

    Equal keys meet in one partition, which sorts and numbers its own; nothing is sampled or gathered. Sorting
    distinct keys makes the numbering the same when a task runs again.
    """
    return rows.select(*keys).distinct().sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id())
