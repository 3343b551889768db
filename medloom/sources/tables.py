"""The supplied Parquet tables as typed clinical resources: one DataFrame a resource type, nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENCOUNTER_STATUS = {"O": "in-progress", "F": "finished", "P": "planned"}
ACTIONS = {"signup": "create", "error": "delete"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(c: str) -> Column:
    return F.col(c).cast("string")


def _ref(kind: str, c: str) -> Column:
    return F.struct(F.concat(F.lit(kind + "/"), F.col(c).cast("string")).alias("reference"))


def _mapped(c: str, values: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return out


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer: every third has no phone, every fifth of the others has two."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    phone = lambda n: F.struct(F.lit("phone").alias("system"), F.concat(F.lit(f"555-{n}-"), key.cast("string")).alias("value"))
    phones = F.when(key % 3 == 0, F.lit(None)).when(key % 5 == 0, F.array(phone(1), phone(2))).otherwise(F.array(phone(1)))
    name = F.struct(F.col("c_name").alias("text"), F.substring_index("c_name", "#", 1).alias("family"), F.array(F.substring_index("c_name", "#", -1)).alias("given"))
    return c.select(
        F.lit("Patient").alias("resourceType"),
        _id("c_custkey").alias("id"),
        F.array(F.struct(F.lit("urn:cust").alias("system"), _id("c_custkey").alias("value"))).alias("identifier"),
        F.array(name).alias("name"),
        phones.alias("telecom"),
        F.when(key % 2 == 0, "female").otherwise("male").alias("gender"),
        (F.col("c_acctbal") >= 0).alias("active"),
        F.date_add(F.lit("1950-01-01").cast("date"), (key % 20000).cast("int")).cast("string").alias("birthDate"),
        F.array(_ref("Location", "c_nationkey")).alias("generalPractitioner"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.lit("Encounter").alias("resourceType"),
        _id("o_orderkey").alias("id"),
        _mapped("o_orderstatus", ENCOUNTER_STATUS, "unknown").alias("status"),
        _ref("Patient", "o_custkey").alias("subject"),
        F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start")).alias("period"),
        F.struct(F.array(F.struct(F.lit("urn:priority").alias("system"), F.col("o_orderpriority").alias("code"))).alias("coding"), F.substring_index("o_orderpriority", "-", -1).alias("text")).alias("priority"),
        F.col("o_totalprice").alias("totalPrice"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem, whose own keys are not unique: the id joins all four."""
    li = table(spark, sf_dir, "lineitem")
    quantity = F.struct(F.col("l_quantity").alias("value"), F.lit("unit").alias("unit"), F.lit("urn:units").alias("system"), F.lit("u").alias("code"))
    return li.select(
        F.lit("Observation").alias("resourceType"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_returnflag").alias("status"),
        _ref("Encounter", "l_orderkey").alias("encounter"),
        F.array(_ref("Organization", "l_suppkey")).alias("performer"),
        F.struct(F.array(F.struct(F.lit("urn:part").alias("system"), _id("l_partkey").alias("code"))).alias("coding"), F.concat(F.lit("part "), _id("l_partkey")).alias("text")).alias("code"),
        F.struct(F.array(F.struct(F.lit("urn:category").alias("system"), F.col("l_linestatus").alias("code"))).alias("coding")).alias("category"),
        quantity.alias("valueQuantity"),
        F.when(F.col("l_tax") == 0, "untaxed").alias("valueString"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("effectiveDateTime"),
    )


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.lit("Organization").alias("resourceType"), _id("s_suppkey").alias("id"), F.col("s_name").alias("name"), _ref("Location", "s_nationkey").alias("location"), F.col("s_acctbal").alias("balance"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation, each part of a region; regions have ids of their own."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nations = n.select(F.lit("Location").alias("resourceType"), _id("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.struct(F.concat(F.lit("Location/r"), _id("n_regionkey")).alias("reference")).alias("partOf"))
    regions = r.select(F.lit("Location").alias("resourceType"), F.concat(F.lit("r"), _id("r_regionkey")).alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("struct<reference:string>").alias("partOf"))
    return nations.unionByName(regions)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an append-only change log of Patients: one version for each event, deletes without content."""
    e = table(spark, sf_dir, "events")
    action = _mapped("event_type", ACTIONS, "update")
    return e.select(
        F.col("event_id").alias("sequence"),
        F.lit("Patient").alias("resource_type"),
        _id("user_id").alias("id"),
        F.concat(F.lit("v"), _id("event_id")).alias("version_id"),
        action.alias("action"),
        F.col("ts").alias("timestamp"),
        F.when(action != "delete", F.col("props")).alias("json"),
        F.col("event_type"),
        F.col("value"),
    )


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a code system of three levels: type, brand within a type, part."""
    p = table(spark, sf_dir, "part")
    row = lambda code, display, parent, level: [code.alias("code"), display.alias("display"), parent.alias("parent_code"), F.lit(level).alias("level")]
    kind, brand = F.col("p_type"), F.concat_ws("/", "p_type", "p_brand")
    top = p.select(*row(kind, kind, F.lit(None).cast("string"), 1)).distinct()
    mid = p.select(*row(brand, F.col("p_brand"), kind, 2)).distinct()
    low = p.select(*row(_id("p_partkey"), F.col("p_name"), brand, 3))
    return top.unionByName(mid).unionByName(low).select(F.lit("urn:part").alias("system"), "*")
