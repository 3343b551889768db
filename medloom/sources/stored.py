"""Tables that are kept: an index of search values by id, postings of full text by term, each brought up to date part by part.

Both lie in parts by a hash (of the id, or of the term), which are folders of a partitioned table. A batch of changes reads and writes the parts
that it touches, by dynamic partition overwrite: Spark stages a part's new files and puts them in place when all are there. The others
keep their files. Postings take a batch as rows of its own, beside those of the batches before, so that a batch costs what it holds and not what is stored.

The index is bucketed by id within its parts, in as many buckets as parts and by the same hash, so that a part is one bucket: searches that group or
join by id read it without an exchange. A part never goes empty: it holds a row without field, or without term, so that overwriting replaces it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .steps import stepped

PARTS = 64


def part_of(key: str | Column, parts: int) -> Column:
    """The hash part of a key: as Spark's buckets are numbered."""
    return F.pmod(F.hash(key), F.lit(parts))


class StoredTable:
    """A partitioned table under ``path`` (in a folder that all nodes share), known to this session under a name of its own."""

    def __init__(self, spark: SparkSession, path: str, fields: str, key: str, by: list[str], parts: int, bucketed: bool):
        self.spark, self.path, self.key, self.by, self.parts = spark, path.rstrip("/"), key, by, parts
        self.schema = T._parse_datatype_string(fields)
        self.columns = self.schema.names
        self.name = f"stored_{uuid.uuid4().hex}"
        spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema if f.name not in by)
        folders = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema if f.name in by)
        clustered = f"CLUSTERED BY (`{key}`) INTO {parts} BUCKETS" if bucketed else ""
        spark.sql(f"CREATE TABLE {self.name} ({spec}{', ' + folders if folders else ''}, part INT) USING parquet PARTITIONED BY ({', '.join([*by, 'part'])}) {clustered} LOCATION '{self.path}'")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
        spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def _laid(self, rows: DataFrame) -> DataFrame:
        """Rows with their part, and a row without values for each part in ``rows`` and in ``touched``."""
        others = [c for c in self.columns if c not in self.by]
        return rows.withColumn("part", part_of(self.key, self.parts)).select(*others, *self.by, "part")

    def _put(self, rows: DataFrame, touched: DataFrame) -> None:
        """Replaces the parts in ``touched`` (the folders' columns) by ``rows`` of them."""
        empty = touched.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in self.by], *self.by, "part")
        # parts together, but one that is very large (a term in all texts) in several files
        out = rows.unionByName(empty).hint("rebalance", *self.by, "part").sortWithinPartitions(*self.by, "part", self.key)
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            out.write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)

    def rebuild(self, rows: DataFrame) -> None:
        """Replaces all: the parts of ``rows``, and those that were there before."""
        self._put(self._laid(rows), self.spark.table(self.name).select(*self.by, "part").distinct())  # new parts need no row of theirs: they have some

    def replace(self, gone: DataFrame, rows: DataFrame, on: list[str], touched: DataFrame | None = None) -> None:
        """Takes out the rows whose columns ``on`` are in ``gone`` and puts ``rows`` in; only parts of the two (and of ``touched``) are read and written."""
        rows, gone = stepped(self._laid(rows), "laid"), stepped(gone.distinct(), "gone")
        parts = rows.select(*self.by, "part")
        for more in (gone,) if touched is None else (gone, touched):
            if self.key in more.columns:
                parts = parts.unionByName(more.withColumn("part", part_of(self.key, self.parts)).select(*self.by, "part"))
        parts = stepped(parts.distinct(), "parts")
        stay = self.spark.table(self.name).where(F.col(self.key).isNotNull()).join(parts, [*self.by, "part"], "left_semi").join(gone.select(*on), on, "left_anti")
        # what is read and what is replaced are the same files: the new ones are staged, and put in place when all tasks have ended
        self._put(stay.select(*rows.columns).unionByName(rows), parts)

    def read(self) -> DataFrame:
        return self.spark.table(self.name).where(F.col(self.key).isNotNull()).select(*self.columns)

    def drop(self) -> None:
        """Forgets the name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


class StoredIndex(StoredTable):
    """Index values (resource_type, id, kind, field, value, at, until) of searches; ``at`` and ``until`` are the bounds of dates as instants."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        super().__init__(spark, path, "id string, kind string, field string, value string, at timestamp_ntz, until timestamp_ntz, resource_type string", "id", ["resource_type"], parts, True)

    def apply(self, index_rows: DataFrame, changed: DataFrame) -> None:
        """Brings the index up to date after a batch: ``changed`` (resource_type, id) are the resources written or deleted, ``index_rows`` what those hold now."""
        self.replace(changed, index_rows, ["resource_type", "id"])

    def reindex(self, resource_type: str, field: str, rows: DataFrame) -> None:
        """Replaces the values of one parameter of one type."""
        held = self.read().where((F.col("resource_type") == resource_type) & (F.col("field") == field))
        gone = self.spark.createDataFrame([(resource_type, field)], "resource_type string, field string")
        self.replace(gone, rows, ["resource_type", "field"], touched=held.select("resource_type", "id").distinct())

    def purge(self, live: DataFrame) -> None:
        """Takes out the rows of resources that are not in ``live`` (resource_type, id)."""
        orphans = stepped(self.read().select("resource_type", "id").distinct().join(live.select("resource_type", "id"), ["resource_type", "id"], "left_anti"), "orphans")
        self.replace(orphans, self.read().limit(0), ["resource_type", "id"])


class StoredPostings(StoredTable):
    """Postings of full text (resource_type, term, id, tf, words: how often the term is in the resource, and its words).

    Each batch is a folder above its parts. A row without term says that its id is gone from its part as far as batches before its own go, so
    a search meets what is gone where it reads. After MOST batches they are made one.
    """

    MOST = 16

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        super().__init__(spark, path, "term string, id string, tf bigint, words bigint, resource_type string, batch int", "term", ["resource_type", "batch"], parts, False)
        self.fields = [c for c in self.columns if c != "batch"]

    def _batches(self) -> list[int]:
        """The batches that have rows, from the folders' names."""
        names = self.spark.sql(f"SHOW PARTITIONS {self.name}").select(F.regexp_extract("partition", "(?:^|/)batch=([0-9]+)", 1).cast("int").alias("n"))
        return sorted(r.n for r in names.distinct().collect())

    def _live(self, rows: DataFrame) -> DataFrame:
        """Of some parts, whole or by their terms, the rows that no later batch took out."""
        held = rows.where("term is not null")
        if self._batches()[1:]:
            gone = rows.where("term is null and id is not null").groupBy("resource_type", "part", "id").agg(F.max("batch").alias("_until"))
            held = held.join(gone, ["resource_type", "part", "id"], "left").where("_until is null or batch >= _until")
        return held.select(*self.fields)

    def rebuild(self, rows: DataFrame) -> None:
        super().rebuild(rows.withColumn("batch", F.lit(0)))

    def read(self) -> DataFrame:
        return self._live(self.spark.table(self.name))

    def of(self, resource_type: str, terms: list[str]) -> DataFrame:
        """The postings of some terms: a scan of their parts only, since the parts are constants of the plan."""
        wanted = [part_of(F.lit(t), self.parts) for t in terms]
        rows = self.spark.table(self.name).where((F.col("resource_type") == resource_type) & F.col("part").isin(*wanted))
        return self._live(rows.where(F.col("term").isNull() | F.col("term").isin(*terms)))

    def apply(self, before: DataFrame, after: DataFrame) -> None:
        """Brings the postings up to date: ``before`` and ``after`` are the postings of the changed resources as they were and as they are."""
        batches = self._batches()
        if len(batches) >= self.MOST:
            self.rebuild(stepped(self.read(), "merged"))
        number = F.lit(max(batches, default=0) + 1)
        gone = before.select("resource_type", "id", part_of(F.col("term"), self.parts).alias("part")).distinct()
        rows = self._laid(after.withColumn("batch", number)).unionByName(gone.withColumn("batch", number), allowMissingColumns=True)
        self._put(rows, rows.select(*self.by, "part").limit(0))


class BlobStore(StoredTable):
    """Contents by their hash (sha256, data, n_bytes), each once whatever the number of blobs that have it."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        super().__init__(spark, path, "sha256 string, data binary, n_bytes bigint", "sha256", [], parts, False)

    def put(self, blobs: DataFrame) -> DataFrame:
        """Adds the contents (column ``data``) that are not there yet, and returns ``blobs`` with sha256 in place of data. Null contents are not stored.

        New files are added, no file is rewritten. Which contents are new is written first, so the same contents put again add nothing.
        """
        named = blobs.withColumn("sha256", F.sha2("data", 256))
        have = self.spark.table(self.name).select("sha256").where("sha256 is not null")
        new = named.where("sha256 is not null").select("sha256", "data").join(have, "sha256", "left_anti").dropDuplicates(["sha256"])
        new = stepped(new.select("sha256", "data", F.octet_length("data").cast("long").alias("n_bytes")), "contents")
        self._laid(new).write.mode("append").insertInto(self.name)
        return named.drop("data")

    def get(self, names: DataFrame) -> DataFrame:
        """names (sha256) with data and n_bytes; null where there is no such content."""
        return names.join(self.read(), "sha256", "left")

    def keep(self, used: DataFrame) -> None:
        """Takes out the contents that are not in ``used`` (sha256)."""
        gone = stepped(self.read().select("sha256").join(used.select("sha256"), "sha256", "left_anti"), "gone")
        self.replace(gone, self.read().limit(0), ["sha256"])
