"""Bundles, definitions of parameters, contents by hash, codes bound to value sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators import subscriptions, validate
from ..sources import bundles, definitions
from ..sources.steps import temporary
from ..sources.stored import BlobStore
from ..sources.tables import concepts, table
from .care_queries import CONCEPTS
from .catalog import resources
from .registry import SQL, query


@query("SELECT 'Patient' AS resource_type, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_custkey % 10 = 0 AS again FROM customer UNION ALL SELECT 'Organization', CAST(s_suppkey AS VARCHAR), s_name, s_suppkey % 10 = 0 FROM supplier")
def bundles_roundtrip(spark, sf_dir):
    """Two types as transaction bundles of 40 and back; names with quotes stay as they are."""
    one = lambda t, kind, k, n: table(spark, sf_dir, t).select(F.lit(kind).alias("resource_type"), F.col(k).cast("string").alias("id"), F.to_json(F.struct(F.lit(kind).alias("resourceType"), F.col(k).cast("string").alias("id"), F.concat(F.col(n), F.when(F.col(k) % 10 == 0, ' "q"').otherwise("")).alias("name"))).alias("json"))
    path = temporary(spark, "bundles")
    bundles.write_bundles(one("customer", "Patient", "c_custkey", "c_name").unionByName(one("supplier", "Organization", "s_suppkey", "s_name")), path, "transaction", 40)
    back = bundles.read_bundles(spark, path).where("error is null and method = 'PUT' and url = concat(resource_type, '/', id)")
    name = F.get_json_object("json", "$.name")
    return back.select("resource_type", "id", F.regexp_replace(name, ' "q"$', "").alias("name"), name.endswith(' "q"').alias("again"))


#: Definitions of some parameters, as a specification's bundle has them.
DEFINITIONS = [
    ("_id", ["Location", "Organization"], "token", "Location.id | Organization.id", None), ("name", ["Location", "Organization"], "string", "Location.name | Organization.name", None), ("partof", ["Location"], "reference", "Location.partOf", ["Location"]),
    ("location", ["Organization"], "reference", "Organization.location", ["Location"]), ("lost", ["Location"], "token", "Location.noSuchField", None),
]


def _defined(spark, sf_dir):
    """The definitions as resources in a bundle, read back from it."""
    path = temporary(spark, "definitions")
    rows = spark.createDataFrame([("SearchParameter", *d) for d in DEFINITIONS], definitions.SCHEMA)
    bundles.write_bundles(rows.select(F.col("resourceType").alias("resource_type"), F.concat_ws("-", F.array_join("base", "-"), "code").alias("id"), F.to_json(F.struct("*")).alias("json")), path)
    read = bundles.read_bundles(spark, path).where("resource_type = 'SearchParameter'")
    return definitions.compiled(read.select(F.from_json("json", definitions.SCHEMA).alias("d")).select("d.*"), lambda k: resources(spark, sf_dir, k), strict=False)


@query(SQL["index_rows"])
def index_by_definitions(spark, sf_dir):
    """The index of locations by parameters that are compiled from their definitions."""
    return S.index(resources(spark, sf_dir, "Location"), _defined(spark, sf_dir)["Location"])


@query("""SELECT sha256(text) AS sha256, strlen(text) AS n_bytes, count(*) AS blobs, true AS same FROM documents WHERE doc_id % 5 <> 0 GROUP BY text""")
def blob_store(spark, sf_dir):
    """Documents put in two overlapping batches; then every fifth goes, with the contents that no other has."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    store = BlobStore(spark, temporary(spark, "blobs"), 8)
    store.put(docs.where("doc_id % 3 <> 0"))
    links = store.put(docs.where("doc_id % 3 <> 1")).unionByName(docs.where("doc_id % 3 = 1").select("doc_id", F.sha2("data", 256).alias("sha256"))).where("doc_id % 5 <> 0")
    store.keep(links)
    per = links.groupBy("sha256").agg(F.count("*").alias("blobs"))
    return store.read().join(per, "sha256", "left").select("sha256", "n_bytes", "blobs", (F.sha2("data", 256) == F.col("sha256")).alias("same"))


@query(f"""WITH {CONCEPTS}, a AS (SELECT l_orderkey * 10 + l_linenumber AS key, l_linenumber % 3 AS s, CASE WHEN l_partkey % 7 = 0 THEN 'x' ELSE '' END || l_partkey AS code FROM lineitem)
    SELECT key, CASE s WHEN 0 THEN 'error' ELSE 'warning' END AS severity, 'code-not-in-value-set' AS code, 'code urn:part|' || code AS detail, count(*) AS n FROM a WHERE s < 2 AND code NOT IN (SELECT code FROM c WHERE level = 3) GROUP BY ALL""")
def validate_bindings(spark, sf_dir):
    """Codes of line items against the parts: every seventh is not one of them; bindings are required, extensible or preferred."""
    k = F.col("l_linenumber") % 3
    codes = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.lit("code").alias("path"), F.when(k == 0, "required").when(k == 1, "extensible").otherwise("preferred").alias("strength"), F.lit("parts").alias("value_set"),
        F.lit("urn:part").alias("system"), F.concat(F.when(F.col("l_partkey") % 7 == 0, "x").otherwise(""), F.col("l_partkey").cast("string")).alias("code"),
    )
    known = concepts(spark, sf_dir).where("level = 3").select(F.lit("parts").alias("value_set"), "system", "code")
    return validate.bound(codes, known).groupBy("key", "severity", "code", "detail").agg(F.count("*").alias("n"))


@query("SELECT 's' || c_custkey AS subscription_id FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment = 'BUILDING' AND c_custkey % 2 = 1")
def subscription_registry(spark, sf_dir):
    k = F.col("c_custkey")
    registry = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), k.cast("string")).alias("subscription_id"), F.when(k % 3 == 0, "active").otherwise("off").alias("status"), F.col("c_mktsegment").alias("resource_type"), F.when(k % 2 == 1, "webhook").otherwise("mail").alias("channel"))
    return subscriptions.listed(registry, status="active", resource_type="BUILDING", channel="webhook").select("subscription_id")
