"""Views, their sinks, and paths over resources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import views as V
from ..sources import sinks
from ..functions.paths import Path
from ..sources.steps import temporary
from .catalog import resources
from .registry import query
from .search_queries import STATUS

PHONE = "CASE WHEN c_custkey % 3 <> 0 THEN '555-1-' || c_custkey END"


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS id, substr(c_name, 10) AS given, 'Customer' AS family, CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender, {PHONE} AS phone FROM customer")
def view_patient_summary(spark, sf_dir):
    return V.compiled(V.BUILT_IN.resolve("patient_summary_view", permissions={"read-patient-summary"}), resources(spark, sf_dir, "Patient"))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, {STATUS} AS status, substr(o_orderpriority, 3) AS description, 'Patient/' || o_custkey AS \"patientRef\" FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '2000-01-01'")
def view_encounter_filtered(spark, sf_dir):
    return V.compiled(V.ENCOUNTERS_FROM_2000, resources(spark, sf_dir, "Encounter"))


@query("SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_returnflag AS status, 'part ' || l_partkey AS \"codeText\", l_quantity AS value, 'unit' AS unit FROM lineitem WHERE l_returnflag = 'A'")
def view_observation_quantity(spark, sf_dir):
    return V.compiled(V.OBSERVATION_QUANTITY, resources(spark, sf_dir, "Observation"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN '555-1-' || c_custkey || ',555-2-' || c_custkey ELSE '555-1-' || c_custkey END AS phones FROM customer")
def view_array_column(spark, sf_dir):
    view = V.View("phones", "Patient", {"id": "id", "phones": "telecom.value"})
    return V.compiled(view, resources(spark, sf_dir, "Patient")).select("id", F.array_join("phones", ",").alias("phones"))


_PHONES = "SELECT CAST(c_custkey AS VARCHAR) AS id, '555-1-' || c_custkey AS phone FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), '555-2-' || c_custkey FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 = 0"


@query(_PHONES)
def view_foreach_unnest(spark, sf_dir):
    view = V.View("phones", "Patient", {"id": "id", "phone": "item.value"}, for_each="telecom")
    return V.compiled(view, resources(spark, sf_dir, "Patient"))


@query(_PHONES + " UNION ALL SELECT CAST(c_custkey AS VARCHAR), NULL FROM customer WHERE c_custkey % 3 = 0")
def view_foreach_or_null(spark, sf_dir):
    view = V.View("phones", "Patient", {"id": "id", "phone": "item.value"}, for_each="telecom", or_null=True)
    return V.compiled(view, resources(spark, sf_dir, "Patient"))


@query("SELECT 'Patient' AS kind, CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer UNION ALL SELECT 'Organization', CAST(s_suppkey AS VARCHAR), s_name FROM supplier")
def view_union_all(spark, sf_dir):
    a = V.View("a", "Patient", {"kind": "resourceType", "id": "id", "name": "name.text.first()"})
    b = V.View("b", "Organization", {"kind": "resourceType", "id": "id", "name": "name"})
    return V.union([(a, resources(spark, sf_dir, "Patient")), (b, resources(spark, sf_dir, "Organization"))])


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS balance FROM customer ORDER BY c_acctbal DESC, CAST(c_custkey AS VARCHAR) LIMIT 25 OFFSET 10")
def view_paged(spark, sf_dir):
    view = V.View("balances", "Patient", {"id": "id", "balance": "balance"})
    rows = V.compiled(view, resources(spark, sf_dir, "Patient"))
    return V.paged(rows, ["-balance", "id"], 25, 10)


@query("SELECT count(*) AS scanned, count(*) FILTER (c_custkey % 2 = 0 AND c_acctbal >= 0) AS filtered FROM customer")
def view_counters(spark, sf_dir):
    view = V.View("active", "Patient", {"id": "id"}, where=["active", lambda p: p["gender"] == "female"])
    return V.counters(view, resources(spark, sf_dir, "Patient"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey % 3 <> 0 AS has_phone, CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS phones,
    CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 = 0 THEN '555-2-' || c_custkey END AS second, CASE WHEN c_custkey % 3 = 0 THEN 'Customer' WHEN c_custkey % 5 = 0 THEN 'Customer,555-1-' || c_custkey || ',555-2-' || c_custkey ELSE 'Customer,555-1-' || c_custkey END AS labels FROM customer""")
def fhirpath_functions(spark, sf_dir):
    view = V.View(
        "functions", "Patient",
        {
            "id": "id", "has_phone": "telecom.exists()", "phones": "telecom.count()", "second": lambda p: p["telecom"].where(lambda t: t["value"].col.startswith("555-2"))["value"].first(),
            "labels": lambda p: F.array_join(p["name"]["family"].union(p["telecom"]["value"]).col, ","),
        },
    )
    return V.compiled(view, resources(spark, sf_dir, "Patient"))


@query("SELECT l_tax = 0 AS untaxed, count(*) AS n, count(*) FILTER (l_tax = 0) AS strings FROM lineitem GROUP BY 1")
def fhirpath_choice(spark, sf_dir):
    o = resources(spark, sf_dir, "Observation")
    text = Path.of(o)["value"].ofType("string")
    return o.groupBy(text.exists().col.alias("untaxed")).agg(F.count("*").alias("n"), F.count(text.col).alias("strings"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CAST(row_number() OVER (ORDER BY CAST(s_suppkey AS VARCHAR)) - 1 AS BIGINT) AS row_num FROM supplier")
def reporting_refresh(spark, sf_dir):
    view = V.View("suppliers", "Organization", {"id": "id", "name": "name"})
    path = temporary(spark, "report")
    sinks.refresh(V.compiled(view, resources(spark, sf_dir, "Organization")), path, "suppliers", "1.0.0", ["id"])
    return sinks.read_report(spark, path, "suppliers", "1.0.0").select("id", "name", "row_num")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_acctbal AS VARCHAR) AS balance, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN '[\"555-1-' || c_custkey || '\",\"555-2-' || c_custkey || '\"]' ELSE '[\"555-1-' || c_custkey || '\"]' END AS phones FROM customer")
def csv_roundtrip(spark, sf_dir):
    view = V.View("phones", "Patient", {"id": "id", "balance": "balance", "phones": "telecom.value"})
    path = temporary(spark, "csv")
    sinks.write_csv(V.compiled(view, resources(spark, sf_dir, "Patient")), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, 'Location/r' || n_regionkey AS part_of FROM nation")
def ndjson_roundtrip(spark, sf_dir):
    path = temporary(spark, "ndjson")
    places = resources(spark, sf_dir, "Location")
    sinks.write_ndjson(places, path)
    return sinks.read_ndjson(spark, path, places.schema, types=["Location"]).where("partOf is not null").select("id", "name", F.col("partOf.reference").alias("part_of"))


@query("SELECT c_mktsegment AS segment, CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS balance FROM customer GROUP BY CUBE (1, 2)")
def agg_cube_on_view(spark, sf_dir):
    p = V.compiled(V.View("segments", "Patient", {"segment": "segment", "gender": "gender", "balance": "balance"}), resources(spark, sf_dir, "Patient"))
    return p.cube("segment", "gender").agg(F.count("*").alias("n"), F.sum(F.col("balance").cast("decimal(18,2)")).cast("double").alias("balance"))
