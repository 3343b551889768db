"""Resources as JSON: canonical form, hash, references, metadata, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(json: str | Column) -> Column:
    """Sorted keys, no white space; null if it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def fingerprint(json: str | Column) -> Column:
    return F.sha2(canonical(json), 256)


def envelope(df: DataFrame, json: str = "json") -> DataFrame:
    """resource_type, id, version_id, last_updated, json (canonical), hash of JSON resources."""
    get = lambda p: F.get_json_object(json, p)
    return df.select(
        get("$.resourceType").alias("resource_type"), get("$.id").alias("id"), get("$.meta.versionId").alias("version_id"),
        F.try_to_timestamp(get("$.meta.lastUpdated")).alias("last_updated"), canonical(json).alias("json"), fingerprint(json).alias("hash"),
    )


def references(df: DataFrame, json: str = "json", key: str = "id") -> DataFrame:
    """key, reference, resource_type, target of every nested ``reference`` string of a JSON resource."""
    found = F.regexp_extract_all(canonical(json), F.lit(r'"reference":"((?:[^"\\]|\\.)*)"'), F.lit(1))
    each = df.select(key, F.explode(F.array_distinct(found)).alias("reference"))
    local = F.col("reference").rlike(r"^[A-Z][A-Za-z]+/[^/]+$")
    return each.select(key, "reference", F.when(local, F.substring_index("reference", "/", 1)).alias("resource_type"), F.when(local, F.substring_index("reference", "/", -1)).alias("target"))


def with_meta(df: DataFrame, version: Column, updated: Column) -> DataFrame:
    """The typed resource with meta.versionId and meta.lastUpdated set."""
    return df.withColumn("meta", F.struct(version.alias("versionId"), updated.alias("lastUpdated")))


def etag(version: str | Column) -> Column:
    return F.format_string('W/"%s"', version)
