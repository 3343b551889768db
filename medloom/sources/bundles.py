"""Bundles as a source and a sink: files of JSON bundles to one row a resource, and back in bundles of a bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .resources import canonical
from .sinks import numbered

SIZE = 500


def read_bundles(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """file, position, method, url, resource_type, id, json (canonical), error of each entry of the bundles under ``path``.

    ``lines``: a bundle a line, so that large files are split; otherwise a bundle a file. What is no bundle is one row with ``error`` (no JSON, no
    bundle, no resource: an entry without one, unless it is a delete), and nothing raises.
    """
    text = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), F.col("value")).where(F.trim("value") != "")
    v = F.try_parse_json("value")
    entry = F.try_variant_get(v, "$.entry", "array<variant>")
    kind = F.try_variant_get(v, "$.resourceType", "string")
    error = F.when(v.isNull(), "no JSON").when(F.coalesce(kind, F.lit("")) != "Bundle", "no bundle")
    rows = text.select("file", error.alias("error"), F.when(error.isNull(), F.coalesce(entry, F.array().cast("array<variant>"))).alias("entry"))
    good = rows.where("error is null").select("file", F.posexplode("entry").alias("position", "e"))
    get = lambda p: F.try_variant_get("e", p, "string")
    json = F.to_json(F.try_variant_get("e", "$.resource", "variant"))
    good = good.select("file", "position", get("$.request.method").alias("method"), get("$.request.url").alias("url"), get("$.resource.resourceType").alias("resource_type"), get("$.resource.id").alias("id"), canonical(json).alias("json"))
    good = good.withColumn("error", F.when(F.col("json").isNull() & ~F.coalesce(F.upper("method") == "DELETE", F.lit(False)), "no resource"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    bad = rows.where("error is not null").select("file", F.lit(0).alias("position"), *map(none, ("method", "url", "resource_type", "id", "json")), "error")
    return good.unionByName(bad)


def write_bundles(rows: DataFrame, path: str, kind: str = "collection", size: int = SIZE) -> None:
    """Resources (resource_type, id, json) as bundles of ``size`` entries, a bundle a line, in order of type and id.

    A job that fails leaves nothing that a reader finds: Spark's committer puts files in place when all tasks are through. Rows without JSON are left out.
    """
    if kind not in ("collection", "transaction", "batch"):
        raise ValueError(f"no bundle of kind {kind}")
    placed = numbered(rows.where("json is not null").select("resource_type", "id", "json"), ["resource_type", "id"])
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    request = F.concat(F.lit('"request":{"method":"PUT","url":'), quoted(F.concat_ws("/", "resource_type", "id")), F.lit("},")) if kind != "collection" else F.lit("")
    entry = F.concat(F.lit("{"), request, F.lit('"resource":'), F.col("json"), F.lit("}"))
    each = placed.select(F.floor(F.col("row_num") / size).alias("bundle"), F.struct("row_num", entry.alias("entry")).alias("e"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["entry"]), ",")  # of ``size`` at most
    out = each.groupBy("bundle").agg(whole.alias("entries"))
    out.select(F.concat(F.lit('{"resourceType":"Bundle","type":"' + kind + '","entry":['), F.col("entries"), F.lit("]}")).alias("value")).write.mode("overwrite").text(path)
