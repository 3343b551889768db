"""Writes and what they add, fields of JSON, forms as bundles, value sets that need a rebuild, replay, nodes, scopes, allow lists."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.paths import Path, today
from ..operators import blobs, fields, forms, history, policy, subscriptions, sync
from ..operators import search as S
from ..operators import terminology as T
from ..operators import views as V
from ..sources import resources as R
from ..sources import sinks
from ..sources.resources import with_meta
from ..sources.steps import temporary
from ..sources.tables import event_log, table
from ..streaming import events as stream_events
from ..streaming import state as stream_state
from .catalog import PARAMS, resources
from .registry import query
from .work import rows, work_dir

# writes: even customers exist already, with one version


def _prepared(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    log = c.where(k % 2 == 0).select(k.alias("sequence"), F.lit("Patient").alias("resource_type"), k.cast("string").alias("id"), F.lit("create").alias("action"), F.lit("1").alias("version_id"))
    action = F.when(k % 8 == 0, "create").when(k % 4 == 0, "update").when(k % 4 == 1, "create").when(k % 4 == 2, "delete").otherwise("update")
    json = F.when(k % 11 == 0, "{broken").when(k % 13 == 0, '{"resourceType":"Patient"}').otherwise(F.to_json(F.struct(F.lit("Patient").alias("resourceType"), F.col("c_name").alias("name"))))
    changes = c.select(k.alias("change_id"), F.lit("Patient").alias("resource_type"), F.when(~((k % 4 == 1) & (k % 3 == 0)), k.cast("string")).alias("id"), action.alias("action"), json.alias("json"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("at"))
    return history.prepared(log, changes, {"Patient": ["name"]})


_WRITES = """w AS (SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 8 = 0 THEN 'create' WHEN c_custkey % 4 = 0 THEN 'update' WHEN c_custkey % 4 = 1 THEN 'create' WHEN c_custkey % 4 = 2 THEN 'delete' ELSE 'update' END AS action FROM customer),
    s AS (SELECT *, CASE WHEN action <> 'delete' AND k % 11 = 0 THEN 422 WHEN action <> 'delete' AND k % 13 = 0 THEN 422 WHEN k % 8 = 0 THEN 409 WHEN k % 4 = 3 THEN 404 WHEN k % 4 = 1 THEN 201 WHEN k % 4 = 0 THEN 200 ELSE 204 END AS status,
        CASE WHEN k % 4 = 1 AND k % 3 = 0 THEN 'new-' || k ELSE CAST(k AS VARCHAR) END AS id FROM w)"""


@query(f"""WITH {_WRITES} SELECT k AS change_id, id, action, status, CASE status WHEN 201 THEN '1' WHEN 200 THEN '2' WHEN 204 THEN '2' END AS version_id, CASE WHEN status IN (200, 204) THEN '1' END AS prev_version,
    CASE WHEN status IN (200, 201) THEN '{{"id":"' || id || '","meta":{{"lastUpdated":"2024-01-02T03:04:05Z","versionId":"' || CASE status WHEN 201 THEN '1' ELSE '2' END || '"}},"name":"' || c_name || '","resourceType":"Patient"}}' END AS json,
    CASE WHEN status = 422 AND k % 11 = 0 THEN 'invalid-json' WHEN status = 422 THEN 'required' END AS errors FROM s""")
def write_prepared(spark, sf_dir):
    return _prepared(spark, sf_dir).select("change_id", "id", "action", "status", "version_id", "prev_version", "json", "errors")


@query("""SELECT c_custkey * 10 + i AS change_id, CAST(c_custkey AS VARCHAR) AS id, i,
        CASE i WHEN 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 409 ELSE 201 END WHEN 1 THEN CASE WHEN c_custkey % 5 = 0 THEN 422 ELSE 200 END WHEN 2 THEN 204 WHEN 3 THEN 404 ELSE 201 END AS status,
        CASE WHEN i = 3 OR (i = 0 AND c_custkey % 2 = 0) OR (i = 1 AND c_custkey % 5 = 0) THEN NULL ELSE CAST(CASE i WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END - CASE WHEN i > 1 AND c_custkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS version_id,
        CASE WHEN i = 0 OR i = 3 OR (i = 1 AND c_custkey % 5 = 0) THEN NULL ELSE CAST(CASE i WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END - CASE WHEN i > 1 AND c_custkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS prev_version
    FROM customer, (SELECT unnest(range(5)) AS i)""")
def write_many_of_one_key(spark, sf_dir):
    """Create, update, delete, update, create of each patient in one batch; even ones are there already, every fifth update is not valid."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    log = c.where(k % 2 == 0).select(k.alias("sequence"), F.lit("Patient").alias("resource_type"), k.cast("string").alias("id"), F.lit("create").alias("action"), F.lit("1").alias("version_id"))
    each = c.select(k, F.posexplode(F.array(*map(F.lit, ("create", "update", "delete", "update", "create")))).alias("i", "action"))
    json = F.when((F.col("i") == 1) & (k % 5 == 0), "{broken").otherwise('{"resourceType":"Patient","name":"n"}')
    changes = each.select((k * 10 + F.col("i")).alias("change_id"), F.lit("Patient").alias("resource_type"), k.cast("string").alias("id"), "action", json.alias("json"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("at"))
    return history.prepared(log, changes, {"Patient": ["name"]}).select("change_id", "id", (F.col("change_id") % 10).alias("i"), "status", "version_id", "prev_version")


@query(f"""WITH {_WRITES}, f AS (SELECT * FROM s WHERE status < 300)
    SELECT 'events' AS part, id, CAST(1000 + row_number() OVER (ORDER BY k) - 1 AS VARCHAR) AS value FROM f UNION ALL SELECT 'index', id, c_name FROM f WHERE status < 204
    UNION ALL SELECT 'tombstones', id, '2' FROM f WHERE status = 204 UNION ALL SELECT 'history', id, action FROM f UNION ALL SELECT 'resources', id, CASE status WHEN 201 THEN '1' ELSE '2' END FROM f WHERE status < 204""")
def write_added(spark, sf_dir):
    """The rows that a batch of writes adds to each table."""
    out = history.written(_prepared(spark, sf_dir), {"Patient": [("name", "$.name"), ("gender", "$.gender")]}, 1000)
    value = {"events": F.col("sequence").cast("string"), "index": F.col("value"), "tombstones": F.col("version_id"), "history": F.col("action"), "resources": F.col("version_id")}
    parts = [out[n].select(F.lit(n).alias("part"), "id", v.alias("value")) for n, v in value.items()]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_


@query("SELECT CAST(k AS VARCHAR) AS id, c_name IS NOT NULL AS found, c_name AS name FROM (SELECT unnest([1, 7, 99999999, 12]) AS k) LEFT JOIN customer ON c_custkey = k")
def read_by_key(spark, sf_dir):
    """Reads by type and id, and whether there is such a resource."""
    stored = table(spark, sf_dir, "customer").select(F.lit("Patient").alias("resource_type"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    keys = rows(spark, [("Patient", k) for k in ("1", "7", "99999999", "12")], "resource_type string, id string")
    return history.read(stored, keys).select("id", "found", "name")


@query(f"WITH l AS (SELECT event_id AS sequence, CAST(user_id AS VARCHAR) AS id, 'v' || event_id AS version_id, CASE WHEN event_type <> 'error' THEN props END AS json FROM events) SELECT sequence, lag(version_id) OVER w AS base_version, last_value(json IGNORE NULLS) OVER (PARTITION BY id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base_json FROM l WINDOW w AS (PARTITION BY id ORDER BY sequence)")
def history_enriched(spark, sf_dir):
    return history.enriched(event_log(spark, sf_dir)).select("sequence", "base_version", "base_json")


# fields of JSON


def _small(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.to_json(F.struct(F.lit("Patient").alias("resourceType"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.struct(F.lit("a").alias("city")).alias("address"), F.col("c_mktsegment").alias("segment"))).alias("json"))


@query("""SELECT c_custkey AS id, '{"id":"' || c_custkey || '","name":"' || c_name || '","resourceType":"Patient"}' AS json FROM customer""")
def fields_allowed(spark, sf_dir):
    return _small(spark, sf_dir).select("id", fields.allowed("json", ["name"]).alias("json"))


@query("""SELECT c_custkey AS id, '{"address":{"city":"' || CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE 'a' END || '","geo":{"lat":1}},"id":"' || c_custkey || '","name":{"text":"n"},"resourceType":"Patient","segment":"' || c_mktsegment || '"}' AS json FROM customer""")
def fields_set(spark, sf_dir):
    """Dotted paths: into an object that is there, one that is not, and over a value that is no object."""
    values = {"address.city": F.when(F.col("id") % 2 == 0, '"b"'), "address.geo.lat": F.lit("1"), "name.text": F.lit('"n"')}
    return _small(spark, sf_dir).select("id", fields.with_fields("json", values).alias("json"))


@query("""SELECT c_custkey AS id, '{"active":true,"address":{"city":"a"},"id":"' || c_custkey || '","name":"x","resourceType":"Patient","segment":"' || c_mktsegment || '"}' AS json FROM customer""")
def fields_merged(spark, sf_dir):
    return _small(spark, sf_dir).select("id", fields.merged_update("json", F.lit('{"id":"no","name":"x","active":true}')).alias("json"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 'search' AS kind, 'Patient/' || c_custkey AS reference, 'name,gender' AS fields FROM customer WHERE contains(c_name, '77')")
def citations(spark, sf_dir):
    found = S.run("name:contains=77&_count=100", "Patient", PARAMS, lambda k: resources(spark, sf_dir, k)).resources
    all_ = S.all_pages(S.Builder().where("name", "77", "contains").query, "Patient", PARAMS, lambda k: resources(spark, sf_dir, k)).select(*found.columns)
    cited = fields.cited(all_, "search", F.concat_ws("/", "resourceType", "id"), ["name", "gender"])
    return cited.select("id", "citation.kind", "citation.reference", F.array_join("citation.fields", ",").alias("fields"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 2 = 0 AND c_name IN ('Customer#000000002', 'Customer#000000004', 'a,b')")
def search_built(spark, sf_dir):
    """A search built step by step; a comma within a value is escaped."""
    built = S.Builder().any("name", "Customer#000000002", "Customer#000000004", "a,b", modifier="exact").where("gender", "female").sort("-_id").count(50)
    return S.run(built.query, "Patient", PARAMS, lambda k: resources(spark, sf_dir, k)).page.select("id")


@query("""SELECT event_id AS request_id, event_type IN ('click', 'view') AND (user_id % 3 <> 1 OR event_type = 'click') AS ok,
    CASE WHEN event_type NOT IN ('click', 'view') THEN CASE user_id % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'birthDate,name' ELSE '' END WHEN user_id % 3 = 1 AND event_type = 'view' THEN 'birthDate' ELSE '' END AS refused FROM events""")
def tool_allow_lists(spark, sf_dir):
    """Each event asks for fields as a tool named by its type; two tools have lists."""
    names = lambda *n: F.array(*map(F.lit, n)).cast("array<string>")
    e, u = table(spark, sf_dir, "events"), F.col("user_id")
    lists = e.where("event_type in ('click', 'view')").select(F.col("event_type").alias("tool")).distinct().select("tool", F.lit("read").alias("operation"), F.when(F.col("tool") == "click", names("name", "birthDate")).otherwise(names("name")).alias("fields"))
    asks = e.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("tool"), F.lit("read").alias("operation"), F.when(u % 3 == 0, names("name")).when(u % 3 == 1, names("name", "birthDate")).otherwise(names()).alias("fields"))
    return fields.checked(asks, lists).select("request_id", "ok", "refused")


# forms


def _given(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    pairs = F.array(*[F.struct(F.lit(k).alias("link_id"), v.cast("string").alias("answer")) for k, v in (("status", F.col("o_orderstatus")), ("city", F.when(F.col("o_orderkey") % 2 == 0, 'a"b')), ("who", F.col("o_custkey")))])
    return o.select(F.col("o_orderkey").alias("response_id"), F.explode(pairs).alias("p")).select("response_id", "p.*")


@query("""SELECT o_orderkey AS response_id, '{"entry":[{"request":{"method":"POST","url":"Encounter"},"resource":{"class":{"code":"' || o_orderstatus || '"},"resourceType":"Encounter"}},{"request":{"method":"POST","url":"Patient"},"resource":{'
    || CASE WHEN o_orderkey % 2 = 0 THEN '"address":{"city":"a\\"b"},' ELSE '' END || '"identifier":"' || o_custkey || '","resourceType":"Patient"}}],"resourceType":"Bundle","type":"transaction"}' AS bundle FROM orders WHERE o_orderkey % 3 = 0""")
def sdc_bundle(spark, sf_dir):
    mapping = rows(spark, [("status", "Encounter", "class.code"), ("city", "Patient", "address.city"), ("who", "Patient", "identifier")], "link_id string, resource_type string, path string")
    return forms.assembled(_given(spark, sf_dir), mapping)


@query("SELECT o_orderkey AS response_id, 'status' AS link_id, 'value-set' AS issue FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'who', 'read-only' FROM orders WHERE o_orderkey % 3 = 0")
def sdc_validate_bound(spark, sf_dir):
    items = rows(spark, [("status", "choice", True, False, False, "urn:vs"), ("city", "string", False, False, False, None), ("who", "integer", False, False, True, None)], "link_id string, type string, required boolean, repeats boolean, read_only boolean, value_set string")
    return forms.checked(_given(spark, sf_dir), items, None, rows(spark, [("urn:vs", "F"), ("urn:vs", "O")], "url string, code string"))


@query("SELECT p_partkey AS id, CAST(p_size * 2 + 1 AS BIGINT) AS a, CAST(p_size * 2 + 2 AS BIGINT) AS b, CAST(p_size * 2 + 3 AS BIGINT) AS c, true AS settled FROM part")
def sdc_calculated(spark, sf_dir):
    """Items that are calculated from others, in the wrong order: c from b, b from a."""
    start = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size"), *[F.lit(None).cast("long").alias(n) for n in "cba"])
    return forms.calculated(start, {"c": F.col("b") + 1, "b": F.col("a") + 1, "a": F.col("size") * 2 + 1}).select("id", "a", "b", "c", "settled")


# value sets and concepts


@query("""WITH v AS (SELECT DISTINCT p_brand AS url, '1' AS version, '{"include":[{"code":"' || p_brand || '","system":"urn:part"}]}' AS compose FROM part)
    SELECT url, version, sha256(compose) AS fingerprint FROM v WHERE url <> (SELECT min(p_brand) FROM part)""")
def valueset_outdated(spark, sf_dir):
    """Value sets that need a rebuild: all but the one that was built of just this compose."""
    part = table(spark, sf_dir, "part")
    first = part.agg(F.min("p_brand").alias("url")).select("url", F.lit("1").alias("version"), F.concat(F.lit('{"include":[{"code":"'), "url", F.lit('","system":"urn:part"}]}')).alias("compose"))
    made = part.select(F.col("p_brand").alias("url"), F.lit("1").alias("version"), F.concat(F.lit('{ "include": [ {"system": "urn:part", "code": "'), "p_brand", F.lit('"} ] }')).alias("compose")).distinct()
    return T.outdated(T.compiled(made), T.compiled(first.unionByName(rows(spark, [("other", "1", "{}")], "url string, version string, compose string"))))


@query("""SELECT CASE WHEN p_partkey % 4 = 0 THEN 'urn:old' ELSE 'urn:part' END AS system, CAST(p_partkey AS VARCHAR) AS code, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN p_name WHEN p_partkey % 4 = 2 THEN 'second ' || p_name END AS found_display FROM part""")
def terminology_chain(spark, sf_dir):
    """Displays of all parts from the first of two providers that knows a code: the first knows every fourth, the second two of four; concepts of a retired system are not found."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    system = F.when(k % 4 == 0, "urn:old").otherwise("urn:part").alias("system")
    all_ = p.select(system, k.cast("string").alias("code"), F.col("p_name").alias("display"), k.alias("k"))
    first = all_.where("k % 4 = 1").select("system", "code", "display")
    second = all_.where("k % 4 in (1, 2)").select("system", "code", F.concat(F.lit("second "), "display").alias("display"))
    codes = all_.select("system", "code")
    known = T.first_found(codes.where("system <> 'urn:old'"), first, second)
    retired = T.lookup(codes.where("system = 'urn:old'"), all_.select("system", "code", "display"), all_.where("system = 'urn:old'").select("system").distinct())
    return known.unionByName(retired.select("system", "code", "found_display"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS code, CASE WHEN p_type LIKE 'PROMO%' THEN 'new ' || p_name ELSE p_name END AS display FROM part WHERE NOT (p_type LIKE 'PROMO%' AND p_partkey % 2 = 0)")
def terminology_replaced(spark, sf_dir):
    """Concepts of the types that a new edition has come from it alone, without those that it lost."""
    part = table(spark, sf_dir, "part").select(F.col("p_type").alias("scope"), F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("display"), F.col("p_partkey").alias("k"))
    promo = part.where("scope like 'PROMO%'")
    new = promo.where("k % 2 = 1").select("scope", "code", F.concat(F.lit("new "), "display").alias("display"))
    gone = promo.select("scope").distinct().join(new.select("scope").distinct(), "scope", "left_anti")  # a scope that lost all has no row to name it
    old = part.select("scope", "code", "display").join(gone, "scope", "left_anti")
    return T.replaced(old, new, "scope").select("code", "display")


# replay, nodes, access


@query("""WITH l AS (SELECT event_id AS sequence, user_id % 4 AS node, lag('v' || event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS base_version FROM events)
    SELECT sequence, node, base_version, (row_number() OVER (PARTITION BY node ORDER BY sequence) - 1) // 50 AS batch FROM l WHERE sequence BETWEEN 100 AND 700""")
def sync_replay(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("node", F.col("id").cast("long") % 4)
    return sync.replayed(log, 100, 700, 50).select("sequence", "node", "base_version", "batch")


@query("""SELECT n_nationkey AS node, CASE WHEN last_seen IS NULL THEN 'new' WHEN last_seen < (SELECT max(ts) FROM events) - INTERVAL 2 HOURS THEN 'stale' ELSE 'active' END AS state
    FROM nation LEFT JOIN (SELECT user_id AS node, max(ts) AS last_seen FROM events GROUP BY 1) ON node = n_nationkey""")
def node_states(spark, sf_dir):
    seen = table(spark, sf_dir, "events")
    now = seen.agg(F.max("ts")).first()[0]
    registry = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    return sync.nodes(registry, seen.select(F.col("user_id").cast("long").alias("node"), F.col("ts").alias("at")), F.lit(now), "2 hours").select("node", "state")


@query("""WITH s AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'patient' WHEN 1 THEN 'user' WHEN 2 THEN 'system' ELSE 'openid' END AS context, CASE WHEN event_id % 2 = 0 THEN '*' ELSE 'Observation' END AS resource,
        CASE event_type WHEN 'click' THEN 'rs' WHEN 'view' THEN 'read' WHEN 'purchase' THEN '*' WHEN 'signup' THEN 'write' ELSE 'sr' END AS verb FROM events)
    SELECT event_id, CASE WHEN context <> 'openid' AND verb <> 'sr' THEN context END AS context, CASE WHEN context <> 'openid' AND verb <> 'sr' THEN resource END AS resource,
        CASE WHEN context <> 'openid' THEN CASE verb WHEN 'rs' THEN 'r,s' WHEN 'read' THEN 'r,s' WHEN '*' THEN 'c,r,u,d,s' WHEN 'write' THEN 'c,u,d' END END AS actions FROM s""")
def scopes_parsed(spark, sf_dir):
    """A scope for each event; some name no context or mix up the verbs."""
    u, kind = F.col("user_id"), F.col("event_type")
    context = F.when(u % 4 == 0, "patient").when(u % 4 == 1, "user").when(u % 4 == 2, "system").otherwise("openid")
    verb = F.when(kind == "click", "rs").when(kind == "view", "read").when(kind == "purchase", "*").when(kind == "signup", "write").otherwise("sr")
    given = table(spark, sf_dir, "events").select("event_id", F.concat(context, F.lit("/"), F.when(F.col("event_id") % 2 == 0, "*").otherwise("Observation"), F.lit("."), verb).alias("scope"))
    return policy.parsed_scopes(given).select("event_id", "context", "resource", F.array_join("actions", ",").alias("actions"))


@query("""WITH v AS (SELECT p_partkey AS k, p_size % 2 AS a1, p_partkey % 3 AS a2, p_partkey % 5 AS a3, p_partkey % 7 AS pre, p_size % 3 AS b1, p_partkey % 2 AS b2, p_partkey % 4 AS b3 FROM part)
    SELECT k, [a1, a2, a3] < [b1, b2, b3] OR [a1, a2, a3] = [b1, b2, b3] AND pre > 0 AS less, a1 = b1 AND (a1 > 0 OR a2 = b2) AND NOT ([a1, a2, a3] < [b1, b2, b3] OR [a1, a2, a3] = [b1, b2, b3] AND pre > 0) AS fits FROM v""")
def semver_precedence(spark, sf_dir):
    """Two versions of each part, the first of them as a rule a pre-release."""
    k, size, text = F.col("p_partkey"), F.col("p_size"), lambda c: c.cast("string")
    pre = F.when(k % 7 > 0, F.concat(F.lit("-rc."), text(k % 7))).otherwise("")
    pairs = table(spark, sf_dir, "part").select(k.alias("k"), F.concat(F.concat_ws(".", text(size % 2), text(k % 3), text(k % 5)), pre).alias("a"), F.concat_ws(".", text(size % 3), text(k % 2), text(k % 4)).alias("b"))
    return pairs.select("k", (policy.ordered_semver("a") < policy.ordered_semver("b")).alias("less"), policy.compatible(F.col("a"), F.col("b")).alias("fits"))


@query("""WITH b AS (SELECT DISTINCT user_id, event_type AS role FROM events WHERE event_type IN ('click', 'view'))
    SELECT n_nationkey AS principal, coalesce((SELECT string_agg(role, ',' ORDER BY role) FROM b WHERE user_id = n_nationkey), '') AS roles,
    CASE WHEN EXISTS (SELECT 1 FROM b WHERE user_id = n_nationkey AND role = 'click') THEN 'list,read' ELSE '' END AS permissions, CASE WHEN n_nationkey % 2 = 0 THEN 'd' || n_nationkey ELSE '' END AS devices FROM nation""")
def access_snapshot(spark, sf_dir):
    who = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("principal"))
    bound = table(spark, sf_dir, "events").where("event_type IN ('click', 'view')").select(F.col("user_id").cast("long").alias("principal"), F.col("event_type").alias("role"))
    roles = rows(spark, [("click", ["read", "list"])], "role string, permissions array<string>")
    devices = who.where("principal % 2 = 0").select("principal", F.concat(F.lit("d"), F.col("principal").cast("string")).alias("device"))
    return policy.snapshot(who, bound, roles, devices).select("principal", *[F.array_join(c, ",").alias(c) for c in ("roles", "permissions", "devices")])


# binary content, files, paths


@query("""SELECT s_suppkey AS id, '{"content":[{"attachment":{' || CASE WHEN s_suppkey % 2 = 0 THEN '"data":"' || base64(encode(s_name)) || '"' ELSE '"url":"Binary/' || s_suppkey || '"' END || '}}]}' AS json, s_suppkey % 2 = 0 AS inline FROM supplier""")
def blob_embedded(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    docs = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit('{"content":[{"attachment":{"url":"Binary/'), F.col("s_suppkey").cast("string"), F.lit('"}}]}')).alias("json"))
    stored = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("blob_id"), F.encode("s_name", "UTF-8").alias("data"))
    return blobs.embedded(docs, stored).select("id", "json", blobs.inline_payload("json").alias("inline"))


@query("SELECT c_custkey % 3 AS part, count(*) AS n, sum(c_custkey) AS keys FROM customer GROUP BY 1")
def parquet_partitioned(spark, sf_dir):
    path = temporary(spark, "parquet")
    sinks.write_parquet(table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 3).alias("part")), path, ["part"])
    return spark.read.parquet(path).groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("SELECT 'suppliers' AS view, '2.0.0' AS version, count(*) AS row_count, 'id,name' AS columns FROM supplier WHERE s_suppkey % 2 = 0")
def reporting_meta(spark, sf_dir):
    """Two refreshes of a table: the metadata names the rows of the last one."""
    path = temporary(spark, "report")
    out = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    for part in (out, out.where("id % 2 = 0")):
        sinks.refresh(part, path, "suppliers", "2.0.0", ["id"])
    return sinks.read_meta(spark, path).select("view", "version", "row_count", "columns")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 5 = 0 THEN '555-1-' || c_custkey || ',555-2-' || c_custkey ELSE '555-1-' || c_custkey END ELSE '' END AS numbers, true AS phones,
    true AS named, substr(CAST(DATE '1950-01-01' + CAST(c_custkey % 20000 AS INTEGER) AS VARCHAR), 1, 4) AS year, true AS past FROM customer""")
def fhirpath_more(spark, sf_dir):
    """select, all, matches, substring, today, and the limit of items."""
    df = resources(spark, sf_dir, "Patient")
    p = Path.of(df)
    return df.select(
        "id", F.array_join(p["telecom"].select(lambda t: t["value"]).limited().array(), ",").alias("numbers"), p["telecom"].all(lambda t: t["system"] == "phone").col.alias("phones"),
        p["name"]["text"].matches("^Customer#[0-9]+$").col.alias("named"), p["birthDate"].substring(0, 4).col.alias("year"), (p["birthDate"] < today()).alias("past"),
    )


@query("""SELECT 'e' || s_suppkey || '-' || i AS event_id, CAST(i AS BIGINT) AS sequence, CASE i WHEN 1 THEN 'accepted' WHEN 2 THEN 'accepted' WHEN 3 THEN 'conflicted' WHEN 5 THEN 'rejected' WHEN 6 THEN 'accepted' WHEN 7 THEN 'rejected' END AS ack, NULL::INTEGER AS retry_after_s
    FROM supplier, (SELECT unnest([1, 2, 3, 5, 6, 7]) AS i) UNION ALL SELECT 'e' || s_suppkey || '-2', 4, 'already_processed', NULL FROM supplier UNION ALL SELECT 'n' || s_suppkey, 1, 'needs_retry', 30 FROM supplier""")
def stream_push_acks(spark, sf_dir):
    """Each supplier is created, updated, updated on a stale version, has an event sent twice, is created again, deleted, and updated after that; and one event has no id."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    step = [(1, "1", "create", None, "a"), (2, "2", "update", "a", "b"), (3, "3", "update", "a", "x"), (4, "2", "update", "a", "b"), (5, "5", "create", None, "y"), (6, "6", "delete", "b", "c"), (7, "7", "update", "c", "d")]
    each = F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("sequence"), F.lit(e).alias("e"), F.lit(a).alias("action"), F.lit(b).cast("string").alias("base_version"), F.lit(v).alias("version_id")) for n, e, a, b, v in step]))
    pushed = s.select("id", each.alias("p")).select(F.concat(F.lit("e"), "id", F.lit("-"), "p.e").alias("event_id"), "p.sequence", "id", "p.action", "p.base_version", "p.version_id")
    lost = s.select(F.concat(F.lit("n"), "id").alias("event_id"), F.lit(1).cast("long").alias("sequence"), F.lit(None).cast("string").alias("id"), F.lit("update").alias("action"), F.lit(None).cast("string").alias("base_version"), F.lit("q").alias("version_id"))
    path = temporary(spark, "pushed")
    all_ = pushed.unionByName(lost)
    all_.write.parquet(path)
    acks = stream_state.pushes(stream_events.read(stream_state.with_store(spark), path, all_.schema))
    return stream_events.drained(acks, work_dir(spark), spark).select("event_id", "sequence", "ack", "retry_after_s")


@query("SELECT count(*) AS n, sum(event_id) AS total FROM events WHERE event_type IN ('click', 'view')")
def stream_resumed(spark, sf_dir):
    """A stream that is run twice under one name reads each file once: what came after the first run is all that the second one adds."""
    name, path = uuid.uuid4().hex, temporary(spark, "arrived")
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    for kind in ("click", "view"):
        e.where(F.col("event_type") == kind).write.mode("append").parquet(path)
        out = stream_events.drained(stream_events.read(spark, path, e.schema), work_dir(spark), spark, name=name)
    return out.agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


# cells, exports, audit, jobs, cursors, envelopes


@query("""SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, '{"value":' || l_quantity || ',"unit":"unit","system":"urn:units","code":"u"}' AS quantity FROM lineitem WHERE l_orderkey % 5 = 0""")
def view_quantity_cell(spark, sf_dir):
    """A Quantity as one cell of a flat table."""
    view = V.View("quantities", "Observation", {"id": "id", "quantity": lambda p: p["value"].ofType("Quantity")})
    return sinks.csv_cells(V.compiled(view, resources(spark, sf_dir, "Observation").where("cast(split_part(id, '-', 1) as bigint) % 5 = 0")))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def ndjson_since(spark, sf_dir):
    """An export since a time."""
    path = temporary(spark, "export")
    e = resources(spark, sf_dir, "Encounter")
    sinks.write_ndjson(with_meta(e, F.lit("1"), F.col("period.start")), path)
    return sinks.read_ndjson(spark, path, "resourceType string, id string, meta struct<versionId: string, lastUpdated: string>", "1997-01-01T00:00:00Z", ["Encounter"]).select("id")


@query("SELECT 'Patient' AS view, count(*) AS scanned, count(*) FILTER (c_custkey % 2 = 0) AS filtered, 2 AS runs FROM customer")
def audit_appended(spark, sf_dir):
    """Two runs of a view, each with a record in an append-only table."""
    path = temporary(spark, "audit")
    view = V.View("Patient", "Patient", {"id": "id"}, where=[lambda p: p["gender"] == "female"])
    for actor in ("a", "b"):
        sinks.appended(V.logged(view, resources(spark, sf_dir, "Patient"), actor, F.lit("2024-01-01").cast("timestamp")), path)
    of = lambda k: F.max(F.col("details")[k].cast("long")).alias(k)
    return spark.read.parquet(path).groupBy(F.col("details")["view"].alias("view")).agg(of("scanned"), of("filtered"), F.countDistinct("actor").cast("int").alias("runs"))


@query("SELECT 'j' || k AS job_id, CASE WHEN k % 2 = 0 THEN 'completed' ELSE 'pending' END AS status FROM (SELECT DISTINCT s_suppkey AS k FROM supplier)")
def job_enqueue_once(spark, sf_dir):
    """Jobs that come twice, half of which are done already."""
    s = table(spark, sf_dir, "supplier")
    job = lambda df, status: df.select(F.concat(F.lit("j"), F.col("s_suppkey").cast("string")).alias("job_id"), F.lit(status).alias("status"))
    return subscriptions.enqueued(job(s.where("s_suppkey % 2 = 0"), "completed"), job(s.unionByName(s), "pending"))


@query("SELECT n_nationkey AS node, CASE WHEN n_nationkey % 2 = 0 THEN 50 ELSE n_nationkey END AS cursor FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey, 7 FROM nation WHERE n_nationkey >= 20")
def cursor_stored(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    stored = n.where("node < 20").select("node", F.when(F.col("node") % 2 == 0, 50).otherwise(0).cast("long").alias("cursor"))
    new = n.select("node", F.when(F.col("node") < 20, F.col("node")).otherwise(7).alias("cursor"))
    return sync.advanced(stored, new)


@query("SELECT 'Patient' AS resource_type, CAST(c_custkey AS VARCHAR) AS id, '3' AS version_id, TIMESTAMP '2024-01-02 03:04:05' AS last_updated FROM customer")
def resource_envelope(spark, sf_dir):
    """Type, id, version and time of JSON resources."""
    p = with_meta(resources(spark, sf_dir, "Patient").select("resourceType", "id", "name"), F.lit("3"), F.lit("2024-01-02T03:04:05Z"))
    return R.envelope(p.select(F.to_json(F.struct("*")).alias("json"))).select("resource_type", "id", "version_id", F.col("last_updated").cast("timestamp_ntz").alias("last_updated"))


@query("SELECT s_suppkey AS blob_id, sha256(repeat(s_name, 40)) AS sha256, CAST(strlen(s_name) * 40 AS BIGINT) AS n_bytes FROM supplier")
def blob_read(spark, sf_dir):
    """Blobs that are stored as encrypted chunks, decrypted and put together."""
    key = F.lit("0123456789abcdef").cast("binary")
    stored = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("blob_id"), F.encode(F.repeat("s_name", 40), "UTF-8").alias("data"))
    chunks = blobs.chunked(stored, 100).withColumn("data", blobs.encrypted("data", key))
    return blobs.assembled(chunks.withColumn("data", blobs.decrypted("data", key))).select("blob_id", "sha256", "n_bytes")


@query("SELECT CAST(sum(strlen(s_name) + 1) AS BIGINT) AS n_bytes FROM supplier")
def blob_files(spark, sf_dir):
    """Files as binary content."""
    path = temporary(spark, "files")
    table(spark, sf_dir, "supplier").select("s_name").write.text(path)
    return blobs.read_blobs(spark, path).agg(F.sum(F.octet_length("content")).cast("long").alias("n_bytes"))


@query("WITH s AS (SELECT event_id AS sequence, value FROM events WHERE event_type = 'signup') SELECT 's1:' || sequence AS job_id FROM s WHERE value > 50")
def subscription_condition(spark, sf_dir):
    """Subscriptions with a condition over the event."""
    log = event_log(spark, sf_dir).withColumn("changed", F.array().cast("array<string>"))
    subs = rows(spark, [("s1", "active", "Patient", "create", None)], "subscription_id string, status string, resource_type string, event string, changed_fields array<string>")
    return subscriptions.matched(log, subs, F.col("value") > 50).select("job_id")


@query("SELECT * FROM (VALUES ('Location', '_id', 'token', ''), ('Location', 'name', 'string', ''), ('Location', 'partof', 'reference', 'Location'), ('Organization', '_id', 'token', ''), ('Organization', 'name', 'string', ''), ('Organization', 'location', 'reference', 'Location')) t(resource_type, param, kind, targets)")
def capability_params(spark, sf_dir):
    """Search parameters with their types and the types that references point to."""
    known = [(t, p.name, p.kind, ",".join(p.targets)) for t in ("Location", "Organization") for p in PARAMS[t]]
    return rows(spark, known, "resource_type string, param string, kind string, targets string")


# forms within forms, trees of JSON, quantities


_FORMS = """f AS (SELECT 'region-' || n_regionkey AS form, n_nationkey AS k, 'n' || n_nationkey AS link, n_nationkey % 3 AS common FROM nation)"""


def _forms(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    item = lambda form, position, link, sub: F.struct(form.alias("form"), position.cast("int").alias("position"), link.alias("link_id"), sub.cast("string").alias("sub_form"))
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    none, own = F.lit(None), name("nation-", k)
    each = n.select(F.explode(F.array(
        item(name("region-", F.col("n_regionkey")), k, name("n", k), own), item(own, F.lit(0), F.lit("name"), none),
        item(own, F.lit(1), F.lit("more"), name("common-", k % 3)), item(own, F.lit(2), F.lit("lost"), F.when(k % 5 == 0, "no such form")),
    )).alias("i")).select("i.*")
    common = n.select((k % 3).alias("c")).distinct().select(F.explode(F.array(item(name("common-", F.col("c")), F.lit(0), F.lit("a"), none), item(name("common-", F.col("c")), F.lit(1), F.lit("back"), F.when(F.col("c") == 2, "common-2")))).alias("i")).select("i.*")
    return each.unionByName(common), table(spark, sf_dir, "region").select(name("region-", F.col("r_regionkey")).alias("form"))


@query(f"""WITH {_FORMS} SELECT form, link || '/name' AS link_id, [k, 0] AS place FROM f UNION ALL SELECT form, link || '/lost', [k, 2] FROM f UNION ALL SELECT form, link || '/more/a', [k, 1, 0] FROM f
    UNION ALL SELECT form, link || '/more/back', [k, 1, 1] FROM f WHERE common <> 2""")
def sdc_assembled(spark, sf_dir):
    """A form for each region of its nations' forms, which have a common one within them; one of those names itself."""
    return forms.expanded(*_forms(spark, sf_dir))[0].select("form", "link_id", "place")


@query(f"WITH {_FORMS} SELECT form, link || '/lost' AS link_id, 'not-found' AS issue FROM f WHERE k % 5 = 0 UNION ALL SELECT form, link || '/more/back', 'cycle' FROM f WHERE common = 2")
def sdc_assembly_issues(spark, sf_dir):
    return forms.expanded(*_forms(spark, sf_dir))[1].select("form", "link_id", "issue")


@query("""SELECT o_custkey AS k, count(*) AS items, max(n) AS depth, sum(o_orderkey) AS total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1""")
def json_repeat(spark, sf_dir):
    """Each patient's orders as items within items, as deep as there are orders; repeat() finds them all."""
    from ..functions import trees

    keys = F.array_sort(F.collect_list("o_orderkey"))
    nested = F.aggregate(F.reverse(keys), F.lit(""), lambda t, x: F.concat(F.lit('{"key":'), x.cast("string"), F.when(t == "", "").otherwise(F.concat(F.lit(',"item":['), t, F.lit("]"))), F.lit("}")))
    docs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.concat(F.lit('{"item":['), nested, F.lit('],"other":{"item":[]}}')).alias("json"))
    each = docs.select("k", F.explode(trees.repeat("json", "item")).alias("x"))
    return each.groupBy("k").agg(F.count("*").alias("items"), F.max("x.level").alias("depth"), F.sum(F.get_json_object("x.value", "$.key").cast("bigint")).alias("total")).withColumn("depth", F.col("depth").cast("long"))
