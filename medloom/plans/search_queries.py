"""Searches over the resources made of the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import search as S
from ..sources.resources import with_meta
from ..sources.tables import table
from .catalog import PARAMS, resources
from .registry import query


def rows(spark: SparkSession, sf_dir: str, kind: str, *names: str) -> DataFrame:
    """The index of a type, of the named parameters only: other parameters' columns are not even read."""
    return S.index(resources(spark, sf_dir, kind), [p for p in PARAMS[kind] if not names or p.name in names])


def search(spark: SparkSession, sf_dir: str, kind: str, text: str) -> S.Found:
    """The whole answer to a search: its page, total, resources, included resources and links."""
    return S.run(text, kind, PARAMS, lambda k: resources(spark, sf_dir, k))


def found(spark: SparkSession, sf_dir: str, kind: str, text: str) -> DataFrame:
    """Ids of the resources that meet the terms of a search, by the index of their values; other parts of a search are an error here."""
    s = S.search(text)
    if s.sort or s.include or s.revinclude or s.text or s.elements or s.offset or s.count != S.DEFAULT_COUNT:
        raise S.SearchError("only terms here; use search")
    return S.ids(rows(spark, sf_dir, kind, *{t.param for t in s.terms}), PARAMS[kind], s.terms)


def _search(name: str, kind: str, text: str, sql: str, direct: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if direct:
            return S.direct(resources(spark, sf_dir, kind), PARAMS[kind], S.search(text).terms).select("id")
        return found(spark, sf_dir, kind, text)

    query(sql, name)(run)


STATUS = "CASE o_orderstatus WHEN 'O' THEN 'in-progress' WHEN 'F' THEN 'finished' WHEN 'P' THEN 'planned' ELSE 'unknown' END"
BIRTH = "(DATE '1950-01-01' + CAST(c_custkey % 20000 AS INTEGER))"
PATIENT = "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE "
ENCOUNTER = "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE "

_search("search_token_eq", "Encounter", "status=finished", ENCOUNTER + "o_orderstatus = 'F'")
_search("search_token_or", "Encounter", "status=finished,planned", ENCOUNTER + "o_orderstatus IN ('F', 'P')")
_search("search_token_and", "Patient", "gender=female&active=true", PATIENT + "c_custkey % 2 = 0 AND c_acctbal >= 0")
_search("search_token_not", "Encounter", "status:not=finished", ENCOUNTER + "o_orderstatus <> 'F'")
_search("search_token_system_pipe", "Patient", "identifier=urn:cust|17,urn:cust|18,urn:other|19", PATIENT + "c_custkey IN (17, 18)")
_search("search_token_text", "Encounter", "priority:text=urgent", ENCOUNTER + "lower(o_orderpriority) LIKE '%urgent%'")
_search("search_string_eq", "Patient", "name=Customer 000000007", PATIENT + "c_custkey = 7")
_search("search_string_exact", "Patient", "name:exact=Customer%23000000012", PATIENT + "c_name = 'Customer#000000012'")
_search("search_string_contains", "Patient", "name:contains=OMER%2300000001", PATIENT + "lower(c_name) LIKE '%omer#00000001%'")
_search("search_phone", "Patient", "phone=555-2-20,555-1-21,555-1-22", PATIENT + "c_custkey IN (20, 22)")
_search("search_repeated_and", "Patient", "name:contains=9&name:contains=77", PATIENT + "contains(c_name, '9') AND contains(c_name, '77')")
_search("search_composite", "Encounter", "status-priority=finished$1-URGENT", ENCOUNTER + "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
_search("search_reference", "Encounter", "subject=Patient/5,7", ENCOUNTER + "o_custkey IN (5, 7)")
_search("search_reference_type", "Encounter", "subject:type=Patient&status=planned", ENCOUNTER + "o_orderstatus = 'P'")
_search("search_reference_identifier", "Encounter", "subject:identifier=11", ENCOUNTER + "o_custkey = 11")
_search("search_date_month", "Encounter", "date=1997-05", ENCOUNTER + "o_orderdate >= TIMESTAMP '1997-05-01' AND o_orderdate < TIMESTAMP '1997-06-01'")
_search("search_date_range", "Patient", "birthdate=ge1951&birthdate=lt1952-03-02", PATIENT + f"{BIRTH} >= DATE '1951-01-01' AND {BIRTH} < DATE '1952-03-02'")
_search("search_direct_token_and", "Patient", "gender=female&active=true", PATIENT + "c_custkey % 2 = 0 AND c_acctbal >= 0", direct=True)
_search("search_direct_not_contains", "Patient", "gender:not=female&name:contains=33", PATIENT + "c_custkey % 2 = 1 AND contains(c_name, '33')", direct=True)

_DAY = "TIMESTAMP '1998-03-05'"
_NEXT = "TIMESTAMP '1998-03-06'"
_DATES = {
    "eq": f"o_orderdate >= {_DAY} AND o_orderdate < {_NEXT}", "ne": f"NOT (o_orderdate >= {_DAY} AND o_orderdate < {_NEXT})", "gt": f"o_orderdate >= {_NEXT}", "ge": f"o_orderdate >= {_DAY}",
    "lt": f"o_orderdate < {_DAY}", "le": f"o_orderdate < {_NEXT}", "sa": f"o_orderdate >= {_NEXT}", "eb": f"o_orderdate < {_DAY}", "ap": f"o_orderdate >= {_DAY} AND o_orderdate < {_NEXT}",
}
for _op, _test in _DATES.items():
    _search(f"search_date_prefix_{_op}", "Encounter", f"date={_op}1998-03-05", ENCOUNTER + _test)
_NUMBERS = {"eq": "c_acctbal = 2547.4", "ne": "c_acctbal <> 2547.4", "gt": "c_acctbal > 2547.4", "ge": "c_acctbal >= 2547.4", "lt": "c_acctbal < 2547.4", "le": "c_acctbal <= 2547.4", "ap": "abs(c_acctbal - 2547.4) <= 254.74"}
for _op, _test in _NUMBERS.items():
    _search(f"search_number_prefix_{_op}", "Patient", f"balance={_op}2547.4", PATIENT + _test)


@query(ENCOUNTER + "o_custkey IN (SELECT c_custkey FROM customer WHERE contains(c_name, '0042'))")
def search_chain_1hop(spark, sf_dir):
    patients = found(spark, sf_dir, "Patient", "name:contains=0042")
    return S.chained(rows(spark, sf_dir, "Encounter", "subject"), "subject", patients, "Patient")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
def search_chain_two_joins(spark, sf_dir):
    """Chains of two steps, one after the other."""
    place = rows(spark, sf_dir, "Location")
    region = S.ids(place, PARAMS["Location"], S.search("name=ASIA").terms)
    nations = S.chained(place, "partof", region, "Location")
    return S.chained(rows(spark, sf_dir, "Organization", "location"), "location", nations, "Location")


@query("""WITH p AS (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 50)
    SELECT 'Encounter' AS resource_type, CAST(o_orderkey AS VARCHAR) AS id, 'match' AS mode, 'Encounter/' || o_orderkey AS full_url FROM p
    UNION ALL SELECT DISTINCT 'Patient', CAST(o_custkey AS VARCHAR), 'include', 'Patient/' || o_custkey FROM p""")
def search_include(spark, sf_dir):
    page = S.page(S.ordered(found(spark, sf_dir, "Encounter", "status=planned"), rows(spark, sf_dir, "Encounter", "status"), ["_id"]), S.search("_count=50"))
    matched = page.select(F.lit("Encounter").alias("resourceType"), "id")
    more = S.included(page, rows(spark, sf_dir, "Encounter", "subject"), "subject", resources(spark, sf_dir, "Patient").select("resourceType", "id"))
    return S.bundle(matched, more)


@query("""WITH p AS (SELECT c_custkey FROM customer WHERE contains(c_name, '0007'))
    SELECT 'Patient' AS resource_type, CAST(c_custkey AS VARCHAR) AS id, 'match' AS mode, 'Patient/' || c_custkey AS full_url FROM p
    UNION ALL SELECT 'Encounter', CAST(o_orderkey AS VARCHAR), 'include', 'Encounter/' || o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM p)""")
def search_revinclude(spark, sf_dir):
    page = found(spark, sf_dir, "Patient", "name:contains=0007")
    more = S.revincluded(page, rows(spark, sf_dir, "Encounter", "subject"), "subject", "Patient", resources(spark, sf_dir, "Encounter").select("resourceType", "id"))
    return S.bundle(page.select(F.lit("Patient").alias("resourceType"), "id"), more)


@query(f"""SELECT id, CAST(row_number() OVER (ORDER BY priority, day DESC, id) AS BIGINT) AS position FROM (
    SELECT CAST(o_orderkey AS VARCHAR) AS id, least(o_orderpriority, 'urn:priority|' || o_orderpriority, substr(o_orderpriority, 3)) AS priority, o_orderdate AS day
    FROM orders WHERE o_orderstatus = 'P') ORDER BY position LIMIT 100""")
def search_sort_multi(spark, sf_dir):
    s = S.search("status=planned&_sort=priority,-date&_count=100")
    index = rows(spark, sf_dir, "Encounter", "status", "priority", "date")
    top = S.page(S.ordered(S.ids(index, PARAMS["Encounter"], s.terms), index, s.sort), s)
    return top.select("id", F.row_number().over(Window.orderBy("sort0", F.desc("sort1"), "id")).cast("long").alias("position"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 2 = 0 ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 15 OFFSET 30")
def search_page(spark, sf_dir):
    s = S.search("gender=female&_count=15&_offset=30")
    index = rows(spark, sf_dir, "Patient", "gender")
    return S.page(S.ordered(S.ids(index, PARAMS["Patient"], s.terms), index, ["_id"]), s)


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus IN ('F', 'O')")
def search_total(spark, sf_dir):
    return found(spark, sf_dir, "Encounter", "status=finished,in-progress&_summary=count").agg(F.count("*").alias("total"))


_STOPS = ", ".join(f"'{w}'" for w in S.STOP_WORDS)


@query(f"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND w NOT IN ({_STOPS})) AS w FROM documents)
    SELECT id, round(len(list_filter(w, lambda x: x IN ('tion', 'ndly'))) / len(w), 6) AS rank FROM t WHERE list_contains(w, 'tion') AND list_contains(w, 'ndly')""")
def search_fulltext_rank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return S.full_text(docs, "text", "tion ndly")


def _projection(name: str, text: str, sql: str) -> None:
    def run(spark, sf_dir):
        out = S.projected(resources(spark, sf_dir, "Encounter"), S.search(text))
        plain = {"subject": F.col("subject.reference"), "period": F.col("period.start"), "priority": F.col("priority.text")}
        return out.select(*[plain.get(c, F.col(c)).alias(c) for c in out.columns])

    query(sql, name)(run)


_E = f"SELECT 'Encounter' AS \"resourceType\", CAST(o_orderkey AS VARCHAR) AS id"
_projection("search_summary_true", "_summary=true", f"{_E}, {STATUS} AS status, 'Patient/' || o_custkey AS subject FROM orders")
_projection("search_summary_text", "_summary=text", f"{_E} FROM orders")
_projection("search_summary_data", "_summary=data", f"{_E}, {STATUS} AS status, 'Patient/' || o_custkey AS subject, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS period, substr(o_orderpriority, 3) AS priority, o_totalprice AS \"totalPrice\" FROM orders")
_projection("search_elements", "_elements=status,period", f"{_E}, {STATUS} AS status, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS period FROM orders")


@query("""SELECT resource_type, id, kind, field, value FROM (
    SELECT 'Location' AS resource_type, CAST(n_nationkey AS VARCHAR) AS id, unnest([
        {'kind': 'token', 'field': '_id', 'value': CAST(n_nationkey AS VARCHAR)}, {'kind': 'string', 'field': 'name', 'value': n_name},
        {'kind': 'reference', 'field': 'partof', 'value': 'Location/r' || n_regionkey}, {'kind': 'reference', 'field': 'partof', 'value': 'r' || n_regionkey}, {'kind': 'reference', 'field': 'partof', 'value': 'Location|r' || n_regionkey}], recursive := true) FROM nation
    UNION ALL SELECT 'Location', 'r' || r_regionkey, unnest([{'kind': 'token', 'field': '_id', 'value': 'r' || r_regionkey}, {'kind': 'string', 'field': 'name', 'value': r_name}], recursive := true) FROM region)""")
def index_rows(spark, sf_dir):
    return rows(spark, sf_dir, "Location")


@query("""SELECT 'token' AS kind, '_id' AS field, count(*) AS n, count(DISTINCT c_custkey) AS ids FROM customer
    UNION ALL SELECT 'string', 'name', count(*) * 4, count(*) FROM customer
    UNION ALL SELECT 'string', 'phone', sum(CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END), count(*) FILTER (c_custkey % 3 <> 0) FROM customer
    UNION ALL SELECT 'token', 'identifier', count(*) * 2, count(*) FROM customer UNION ALL SELECT 'token', 'gender', count(*), count(*) FROM customer
    UNION ALL SELECT 'token', 'active', count(*), count(*) FROM customer UNION ALL SELECT 'date', 'birthdate', count(*), count(*) FROM customer
    UNION ALL SELECT 'reference', 'general-practitioner', count(*) * 3, count(*) FROM customer UNION ALL SELECT 'number', 'balance', count(*), count(*) FROM customer""")
def index_distinct_ids(spark, sf_dir):
    """Rows are dealt by id before they are counted: counts by id of a whole file's part would save nothing and fill its task's memory."""
    each = rows(spark, sf_dir, "Patient").repartition("id").groupBy("kind", "field", "id").agg(F.count("*").alias("n"))
    return each.groupBy("kind", "field").agg(F.sum("n").alias("n"), F.count("id").alias("ids"))


@query("SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 10 = 3")
def index_orphans(spark, sf_dir):
    live = resources(spark, sf_dir, "Encounter").where("cast(id as bigint) % 10 <> 3")
    return S.orphans(rows(spark, sf_dir, "Encounter", "status"), live).select("id").distinct()


@query("""SELECT 'Patient' AS resource_type, CAST(c_custkey AS VARCHAR) AS id, concat_ws(' ', CASE WHEN c_custkey % 3 <> 0 THEN '555-1-' || c_custkey END, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 = 0 THEN '555-2-' || c_custkey END) AS text FROM customer WHERE c_custkey % 3 <> 0""")
def index_text_documents(spark, sf_dir):
    return S.text_documents(rows(spark, sf_dir, "Patient", "phone"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS value, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), count(*) FROM orders GROUP BY 1")
def index_date_variants(spark, sf_dir):
    from ..functions.normalize import date_variants
    from ..functions.paths import Path

    e = resources(spark, sf_dir, "Encounter")
    return e.select(F.explode(date_variants(Path.of(e)["period"]["start"])).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT 'Encounter' AS resource_type, '_id,date,priority,status,status-priority,subject,total' AS params UNION ALL SELECT 'Location', '_id,name,partof' UNION ALL SELECT 'Observation', 'code,date,encounter,status,value-quantity' UNION ALL SELECT 'Organization', '_id,location,name' UNION ALL SELECT 'Patient', '_id,active,balance,birthdate,gender,general-practitioner,identifier,name,phone'")
def capability_statement(spark, sf_dir):
    known = spark.createDataFrame([(t, p.name) for t, ps in PARAMS.items() for p in ps], "resource_type string, param string")
    return known.groupBy("resource_type").agg(F.array_join(F.sort_array(F.collect_list("param")), ",").alias("params"))


# quantities: every second line item is written in milligrams, the others in grams


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, even = table(spark, sf_dir, "lineitem"), F.col("l_linenumber") % 2 == 0
    unit = F.when(even, "mg").otherwise("g")
    value = F.struct((F.col("l_quantity") * F.when(even, 1000).otherwise(1)).alias("value"), unit.alias("unit"), F.lit("http://unitsofmeasure.org").alias("system"), unit.alias("code"))
    return li.select(F.lit("Observation").alias("resourceType"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), value.alias("valueQuantity"))


def _quantity(name: str, value: str, test: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..functions import normalize as N

        params = [S.Param("value-quantity", "quantity", lambda p: N.quantities(p["value"].ofType("Quantity")))]
        return S.direct(_measured(spark, sf_dir), params, S.search(f"value-quantity={value}").terms).select("id")

    query(f"SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id FROM lineitem WHERE {test}", name)(run)


_UCUM = "|http://unitsofmeasure.org|"
for _op, _test in {"eq": "l_quantity = 17", "ne": "l_quantity <> 17", "gt": "l_quantity > 17", "ge": "l_quantity >= 17", "lt": "l_quantity < 17", "le": "l_quantity <= 17", "sa": "l_quantity > 17", "eb": "l_quantity < 17", "ap": "l_quantity BETWEEN 15.3 AND 18.7"}.items():
    _quantity(f"search_quantity_{_op}", f"{_op}17{_UCUM}g", _test)
_quantity("search_quantity_in_mg", f"ge16000{_UCUM}mg,4.2e4{_UCUM}mg", "l_quantity >= 16 OR l_quantity BETWEEN 41.5 AND 42.5")
_quantity("search_quantity_no_unit", "17", "l_quantity * CASE WHEN l_linenumber % 2 = 0 THEN 1000 ELSE 1 END = 17")
_quantity("search_quantity_unit_only", "17000||mg", "l_quantity = 17")


# whole searches: page, included resources and total in one table


def _listed(out: S.Found) -> DataFrame:
    page = out.page.select(F.lit(out.kind).alias("resource_type"), "id", F.lit("match").alias("mode"), F.col("position").cast("long").alias("position"))
    more = out.included.select(F.col("resourceType").alias("resource_type"), "id", F.lit("include").alias("mode"), F.lit(None).cast("long").alias("position"))
    return page.unionByName(more).crossJoin(F.broadcast(out.total))  # the total is one row


@query("""WITH m AS (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey IN (SELECT c_custkey FROM customer WHERE contains(c_name, '7'))),
         p AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS n FROM m QUALIFY n BETWEEN 11 AND 40)
    SELECT 'Encounter' AS resource_type, CAST(o_orderkey AS VARCHAR) AS id, 'match' AS mode, CAST(n AS BIGINT) AS position, (SELECT count(*) FROM m) AS total FROM p
    UNION ALL SELECT DISTINCT 'Patient', CAST(o_custkey AS VARCHAR), 'include', NULL::BIGINT, (SELECT count(*) FROM m) FROM p""")
def search_full_chain_sort_page_include(spark, sf_dir):
    return _listed(search(spark, sf_dir, "Encounter", "status=finished,in-progress&subject:Patient.name:contains=7&_sort=-date&_count=30&_offset=10&_include=Encounter:subject"))


@query(f"""WITH t AS (SELECT p_partkey AS id, unnest(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND w NOT IN ({_STOPS}))) AS w FROM part),
         r AS (SELECT CAST(id AS VARCHAR) AS id, round(count(*) FILTER (w = (SELECT string_split(lower(min(p_name)), ' ')[1] FROM part)) / count(*), 6) AS rank FROM t GROUP BY 1)
    SELECT id, rank, CAST(row_number() OVER (ORDER BY rank DESC, id) AS BIGINT) AS position, (SELECT count(*) FROM r WHERE rank > 0) AS total FROM r WHERE rank > 0 ORDER BY position LIMIT 20""")
def search_full_text_by_rank(spark, sf_dir):
    """Parts by a word of their names, best first, the default page of 20 (a count of 0 asks for it too)."""
    from ..functions import normalize as N

    part = table(spark, sf_dir, "part")
    word = part.agg(F.min("p_name")).first()[0].lower().split(" ")[0]
    product = part.select(F.lit("Product").alias("resourceType"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    out = S.run(f"_text={word}&_count=0", "Product", {"Product": [S.Param("name", "string", lambda p: N.strings(p["name"]))]}, lambda k: product)
    return out.page.withColumn("position", F.col("position").cast("long")).crossJoin(F.broadcast(out.total))


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE {STATUS} = 'finished' AND o_custkey IN (SELECT c_custkey FROM customer WHERE contains(c_name, '7'))""")
def search_all_pages_of_a_chain(spark, sf_dir):
    """All pages of a search with a chain, as one plan."""
    built = S.Builder().where("status", "finished").where("subject:Patient.name", "7", "contains").sort("-date").count(5)
    return S.all_pages(built.query, "Encounter", PARAMS, lambda k: resources(spark, sf_dir, k)).select("id")


@query("""WITH p AS (SELECT c_custkey FROM customer WHERE contains(c_name, '00') AND c_acctbal > 100 ORDER BY CAST(c_custkey AS VARCHAR) DESC LIMIT 25)
    SELECT 'Patient' AS resource_type, CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender FROM p
    UNION ALL SELECT 'Encounter', CAST(o_orderkey AS VARCHAR), NULL FROM orders WHERE o_custkey IN (SELECT c_custkey FROM p)""")
def search_full_elements_revinclude(spark, sf_dir):
    out = search(spark, sf_dir, "Patient", "name:contains=00&balance=gt100&_sort=-_id&_count=25&_elements=gender&_revinclude=Encounter:subject:Patient")
    return out.resources.select(F.col("resourceType").alias("resource_type"), "id", "gender").unionByName(out.included.select(F.col("resourceType").alias("resource_type"), "id", F.lit(None).cast("string").alias("gender")))


@query("""WITH e AS (SELECT o_orderkey, o_orderdate + INTERVAL 90 MINUTE AS u FROM orders), m AS (SELECT * FROM e WHERE u >= TIMESTAMP '1995-03-01' AND u < TIMESTAMP '1995-05-01')
    SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(row_number() OVER (ORDER BY u DESC, CAST(o_orderkey AS VARCHAR)) AS BIGINT) AS position, (SELECT count(*) FROM m) AS total FROM m ORDER BY position LIMIT 50""")
def search_full_last_updated(spark, sf_dir):
    """A range and an order of _lastUpdated, written with an offset from UTC, in meta."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.date_format(F.col("o_orderdate") + F.expr("INTERVAL '210' MINUTE"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'").alias("u"))
    encounters = with_meta(orders.withColumn("resourceType", F.lit("Encounter")), F.lit("1"), F.col("u")).drop("u")
    out = S.run("_lastUpdated=ge1995-03&_lastUpdated=lt1995-05-01&_sort=-_lastUpdated&_count=50", "Encounter", {"Encounter": []}, lambda k: encounters)
    return out.page.withColumn("position", F.col("position").cast("long")).crossJoin(F.broadcast(out.total))
