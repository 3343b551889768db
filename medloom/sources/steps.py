"""Intermediate results in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, on a local master only, a temporary folder of this program."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="medloom-"))
        where = _own[0]
    return where.rstrip("/")


#: The folder of this program where the setting is unset; paths that go when it ends.
_own: list[str] = []
_going: list[tuple] = []


def goes(spark: SparkSession, path: str) -> None:
    """The files of a path go when the program ends."""
    if not _going:
        atexit.register(_gone)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _going.append((hadoop, spark.sparkContext._jsc.hadoopConfiguration()))


def _gone() -> None:
    for hadoop, settings in _going:
        try:
            hadoop.getFileSystem(settings).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the JVM is gone already: the files stay
            return


def temporary(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, whose files go when the program ends."""
    path = f"{work_dir(spark)}/steps/{tag}-{uuid.uuid4().hex}"
    goes(spark, path)
    return path


def stepped(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; the files go when the program ends."""
    spark = df.sparkSession
    path = temporary(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
