"""Sinks of views and tables: reporting tables with their metadata, CSV, Parquet, NDJSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .steps import stepped


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """row_num from 0 in the given order, without one task for all rows: ranges are sorted, their counts added up.

    The sorted ranges are written once: computed again for their counts, they would be cut and coalesced in another way.
    """
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row"))
    cut = stepped(cut, "numbered")
    per = cut.groupBy("_part").agg(F.count("*").alias("n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("_part", "_first", before.alias("_before"))
    return cut.join(F.broadcast(per), "_part").select(*rows.columns, (F.col("_row") - F.col("_first") + F.col("_before")).alias("row_num"))


def refresh(rows: DataFrame, path: str, view: str, version: str, order: list[str]) -> dict:
    """Replaces the reporting table of a view and version under ``path``; the metadata row is returned and written.

    New rows go to a folder of their own, and the metadata names it once they are all there: a reader finds the old table or the
    new one, never a part of either.
    """
    spark, folder = rows.sparkSession, f"rows/view={view}/version={version}/{uuid.uuid4().hex}"
    numbered(rows, order).write.parquet(f"{path}/{folder}")
    n = spark.read.parquet(f"{path}/{folder}").count()
    meta = {"view": view, "version": version, "columns": ",".join(rows.columns), "row_count": n, "folder": folder}
    spark.createDataFrame([meta]).withColumn("refreshed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/meta")
    return meta


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """The last refresh of each view and version."""
    rows = spark.read.parquet(f"{path}/meta")
    return rows.groupBy("view", "version").agg(F.max_by(F.struct("columns", "row_count", "folder", "refreshed_at"), F.struct("refreshed_at", "folder")).alias("last")).select("view", "version", "last.*")


def read_report(spark: SparkSession, path: str, view: str, version: str) -> DataFrame:
    last = read_meta(spark, path).where((F.col("view") == view) & (F.col("version") == version)).first()
    if last is None:
        raise ValueError(f"{view} {version} was never refreshed")
    return spark.read.parquet(f"{path}/{last['folder']}").orderBy("row_num")


def csv_cells(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON; other columns as they are."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema])


def write_csv(df: DataFrame, path: str) -> None:
    csv_cells(df).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_ndjson(spark: SparkSession, path: str, schema: str | T.StructType, since: str | None = None, types: list[str] | None = None) -> DataFrame:
    """Exported resources, one JSON object a line; ``since`` and ``types`` filter as a bulk export does."""
    df = spark.read.schema(schema).json(path)
    if types:
        df = df.where(F.col("resourceType").isin(*types))
    if since:
        df = df.where(F.col("meta.lastUpdated") >= since)
    return df


def merged(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert by key: the changes, and the current rows that they don't replace."""
    return changes.unionByName(current.join(changes.select(*keys), keys, "left_anti"))


def appended(rows: DataFrame, path: str) -> None:
    """Adds rows to an append-only table (audit, analytics, conflicts, deliveries)."""
    rows.write.mode("append").parquet(path)
