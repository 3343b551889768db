"""Binary content: chunks, assembly, content addressing, encryption, retention, sync plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 64 * 1024


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def chunked(blobs: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """blob_id, chunk, data: cut into parts of ``size`` bytes; an empty blob has one empty part."""
    parts = F.expr(f"transform(sequence(0, greatest(cast(ceil(octet_length(data) / {size}D) as int), 1) - 1), i -> substring(data, i * {size} + 1, {size}))")
    return blobs.select("blob_id", F.posexplode(parts).alias("chunk", "data"))


def assembled(chunks: DataFrame) -> DataFrame:
    """blob_id, data, sha256, n_bytes, chunks: parts joined in order; a blob fits in a row as its reader needs it whole."""
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("chunk", "data"))), F.lit(b""), lambda t, c: F.concat(t, c["data"]))
    out = chunks.groupBy("blob_id").agg(whole.alias("data"), F.count("*").alias("chunks"))
    return out.select("blob_id", "data", F.sha2("data", 256).alias("sha256"), F.octet_length("data").cast("long").alias("n_bytes"), "chunks")


def progress(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("blob_id").agg(F.count("*").alias("chunks"), F.sum(F.octet_length("data")).alias("n_bytes"))


def manifests(blobs: DataFrame) -> DataFrame:
    """sha256, n_bytes, first_id, links: equal contents are stored once."""
    return blobs.groupBy("sha256").agg(F.max("n_bytes").alias("n_bytes"), F.min("blob_id").alias("first_id"), F.count("*").alias("links"))


def encrypted(data: str | Column, key: str | Column) -> Column:
    """AES-GCM with a random nonce; the key has 16, 24 or 32 bytes."""
    return F.aes_encrypt(data, key, F.lit("GCM"))


def decrypted(data: str | Column, key: str | Column) -> Column:
    return F.aes_decrypt(data, key, F.lit("GCM"))


def to_send(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Contents that the other side lacks."""
    return ours.join(theirs.select("sha256"), "sha256", "left_anti")


def expired(rows: DataFrame, now: Column) -> DataFrame:
    return rows.where(F.col("retain_until") <= now)


def inline_payload(json: str | Column) -> Column:
    """Whether a resource carries its content itself."""
    return F.get_json_object(json, "$.content[0].attachment.data").isNotNull() | F.get_json_object(json, "$.data").isNotNull()


def blob_references(docs: DataFrame, key: str = "id", json: str = "json") -> DataFrame:
    """key, blob: the binaries that resources refer to."""
    found = F.regexp_extract_all(F.to_json(F.try_parse_json(json)), F.lit(r'"(?:url|reference)":"Binary/([^"]+)"'), F.lit(1))
    return docs.select(key, F.explode(F.array_distinct(found)).alias("blob"))


def embedded(docs: DataFrame, blobs: DataFrame, key: str = "id", json: str = "json") -> DataFrame:
    """docs with the content of the binary that ``content[0].attachment.url`` names put inline, as base64, in place of the url; others as they are."""
    url = F.get_json_object(json, "$.content[0].attachment.url")
    rows = docs.withColumn("_blob", F.when(url.startswith("Binary/"), F.substring_index(url, "/", -1)))
    rows = rows.join(blobs.select(F.col("blob_id").cast("string").alias("_blob"), F.base64("data").alias("_data")), "_blob", "left")
    part = F.concat(F.lit('"url":"Binary/'), F.col("_blob"), F.lit('"'))
    text = F.to_json(F.try_parse_json(json))
    return rows.withColumn(json, F.when(F.col("_data").isNotNull(), F.replace(text, part, F.concat(F.lit('"data":"'), F.col("_data"), F.lit('"')))).otherwise(text)).drop("_blob", "_data")
