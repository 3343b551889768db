"""Terminology, conflicts, validation, policy, forms and binary content over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blobs, conflict, forms, policy, validate
from ..operators import terminology as T
from ..sources.tables import concepts, table
from .catalog import resources
from .registry import query
from .work import rows

CONCEPTS = """c AS (SELECT DISTINCT p_type AS code, p_type AS display, NULL AS parent, 1 AS level FROM part
    UNION ALL SELECT DISTINCT p_type || '/' || p_brand, p_brand, p_type, 2 FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name, p_type || '/' || p_brand, 3 FROM part)"""


# terminology


@query(f"WITH {CONCEPTS} SELECT l_partkey AS part, display AS found_display, count(*) AS n FROM lineitem LEFT JOIN c ON code = CAST(l_partkey AS VARCHAR) GROUP BY ALL")
def terminology_lookup(spark, sf_dir):
    codes = table(spark, sf_dir, "lineitem").select(F.lit("urn:part").alias("system"), F.col("l_partkey").cast("string").alias("code"), F.col("l_partkey").alias("part"))
    return T.lookup(codes, concepts(spark, sf_dir)).groupBy("part", "found_display").agg(F.count("*").alias("n"))


@query(f"WITH {CONCEPTS} SELECT code, display FROM c WHERE parent = 'PROMO' OR code IN ('ECONOMY', '12')")
def terminology_expand(spark, sf_dir):
    all_ = concepts(spark, sf_dir)
    some = all_.where("parent_code = 'PROMO'").select("system", "code").unionByName(rows(spark, [("urn:part", "ECONOMY"), ("urn:part", "12"), ("urn:part", "no such")], "system string, code string"))
    return T.expanded(all_, some).select("code", "display")


@query(f"WITH {CONCEPTS} SELECT code FROM c WHERE level < 3 AND code <> 'SMALL' AND coalesce(parent, '') <> 'LARGE'")
def terminology_exclude(spark, sf_dir):
    upper = concepts(spark, sf_dir).where("level < 3")
    whole = rows(spark, [("urn:part", None)], "system string, code string")
    out = upper.where("parent_code = 'LARGE' or code = 'SMALL'").select("system", "code")
    return T.expanded(upper, whole, out).select("code")


@query(f"WITH {CONCEPTS}, v AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'x' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS code, CASE WHEN p_partkey % 3 = 0 THEN 'wrong' ELSE p_name END AS display FROM part) SELECT v.p_partkey AS part, c.code IS NOT NULL AS result, CASE WHEN c.code IS NULL THEN 'unknown code' WHEN v.display <> c.display THEN 'display should be ' || c.display END AS message FROM v LEFT JOIN c ON v.code = c.code")
def terminology_validate(spark, sf_dir):
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    codings = p.select(key.alias("part"), F.lit("urn:part").alias("system"), F.when(key % 5 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(key.cast("string")).alias("code"), F.when(key % 3 == 0, "wrong").otherwise(F.col("p_name")).alias("display"))
    return T.validated(codings, concepts(spark, sf_dir)).select("part", "result", "message")


@query(f"WITH {CONCEPTS} SELECT parent AS ancestor, code, 1 AS distance FROM c WHERE parent IS NOT NULL UNION ALL SELECT b.parent, c.code, 2 FROM c JOIN c b ON c.parent = b.code WHERE b.parent IS NOT NULL")
def terminology_closure(spark, sf_dir):
    return T.closure(concepts(spark, sf_dir))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS code FROM nation WHERE n_regionkey <= 3")
def terminology_nested_value_sets(spark, sf_dir):
    """Regions as value sets that include the next one; the third closes a cycle."""
    n = table(spark, sf_dir, "nation")
    codes = n.select(F.concat(F.lit("vs"), F.col("n_regionkey").cast("string")).alias("url"), F.lit("urn:nation").alias("system"), F.col("n_nationkey").cast("string").alias("code"), F.lit(None).cast("string").alias("includes"))
    links = rows(spark, [("vs0", "vs1"), ("vs1", "vs2"), ("vs2", "vs3"), ("vs3", "vs1")], "url string, includes string").select("url", F.lit(None).cast("string").alias("system"), F.lit(None).cast("string").alias("code"), "includes")
    return T.members(codes.unionByName(links), "vs0").select("code")


@query("SELECT p_type AS url, max(p_brand) AS version, arg_max(p_partkey, (p_brand, p_partkey)) AS part FROM part GROUP BY p_type")
def terminology_newest_version(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("url"), F.col("p_brand").alias("version")).agg(F.max("p_partkey").alias("part"))
    return T.newest(p, "url").select("url", "version", "part")


@query(f"WITH {CONCEPTS} SELECT code FROM c WHERE level = 2 ORDER BY code LIMIT 20 OFFSET 40")
def terminology_expansion_page(spark, sf_dir):
    return T.page(concepts(spark, sf_dir).where("level = 2"), 40, 20).select("code")


@query("SELECT DISTINCT p_type AS code, NULL AS parent_code FROM part UNION ALL SELECT DISTINCT p_type || '/' || p_brand, p_type FROM part")
def terminology_flatten(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    low = F.struct(F.concat_ws("/", "p_type", "p_brand").alias("code"), F.col("p_brand").alias("display"))
    tree = p.groupBy("p_type").agg(F.struct(F.col("p_type").alias("code"), F.col("p_type").alias("display"), F.collect_list(low).alias("concept")).alias("top"))
    systems = tree.select(F.lit("urn:part").alias("system"), F.lit("1").alias("version"), F.array("top").alias("concept"))
    return T.flattened(systems).select("code", "parent_code")


# conflicts: three versions of each patient


def _versions(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    text = lambda *parts: F.to_json(F.struct(*parts)).alias("json")
    balance = F.col("c_acctbal").cast("string").alias("balance")
    address = lambda city: F.struct(city.alias("city"), F.lit("x").alias("zip")).alias("address")
    note = lambda more: F.concat(F.array(F.lit("n0")), more).alias("note")
    none, one = F.array().cast("array<string>"), lambda x: F.array(F.lit(x))
    base = c.select(k.alias("id"), text(F.col("c_name").alias("name"), balance, address(F.lit("a")), note(none), F.lit("1").alias("flag")))
    local = c.select(k.alias("id"), text(
        F.when(k % 6 == 1, "renamed").otherwise(F.col("c_name")).alias("name"), balance, address(F.when(k % 6 == 2, "b").otherwise("a")), note(F.when(k % 6 == 3, one("local")).otherwise(none)),
        F.when(k % 6 != 5, "1").alias("flag"),
    ))
    remote = c.select(k.alias("id"), text(F.col("c_name").alias("name"), F.when(k % 6 == 2, "0").otherwise(F.col("c_acctbal").cast("string")).alias("balance"), address(F.when(k % 12 == 8, "c").otherwise("a")), note(F.when(k % 6 == 3, one("remote")).otherwise(none)), F.lit("1").alias("flag")))
    return base, local, remote


@query("""SELECT c_custkey AS id, 'name' AS path, 'scalar_replace' AS change FROM customer WHERE c_custkey % 6 = 1 UNION ALL SELECT c_custkey, 'address.city', 'scalar_replace' FROM customer WHERE c_custkey % 6 = 2
    UNION ALL SELECT c_custkey, 'note', 'array_append' FROM customer WHERE c_custkey % 6 = 3 UNION ALL SELECT c_custkey, 'flag', 'unsupported' FROM customer WHERE c_custkey % 6 = 5""")
def conflict_diff(spark, sf_dir):
    base, local, _ = _versions(spark, sf_dir)
    return conflict.changes(base, local).select("id", "path", "change")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 1 OR c_custkey % 6 = 5 THEN 'review' WHEN c_custkey % 12 = 8 THEN 'review' WHEN c_custkey % 6 = 3 THEN 'append_compatible' ELSE 'auto_merge' END AS decision,
    CASE WHEN c_custkey % 6 = 1 THEN 'identity' END AS risk, CASE WHEN c_custkey % 12 = 8 THEN 'address.city' WHEN c_custkey % 6 = 3 THEN 'note' ELSE '' END AS overlaps FROM customer WHERE c_custkey % 6 IN (1, 2, 3, 5)""")
def conflict_classify(spark, sf_dir):
    return conflict.classified(*_versions(spark, sf_dir))


@query("""SELECT c_custkey AS id, '{"address":{"city":"' || CASE WHEN c_custkey % 6 = 2 THEN 'b' ELSE 'a' END || '","zip":"x"},"balance":"' || CASE WHEN c_custkey % 6 = 2 THEN '0' ELSE CAST(c_acctbal AS VARCHAR) END || '",' || CASE WHEN c_custkey % 6 = 5 THEN '' ELSE '"flag":"1",' END
    || '"name":"' || CASE WHEN c_custkey % 6 = 1 THEN 'renamed' ELSE c_name END || '","note":' || CASE WHEN c_custkey % 6 = 3 THEN '["n0","remote","local"]' ELSE '["n0"]' END || '}' AS merged FROM customer""")
def conflict_auto_merge(spark, sf_dir):
    base, local, remote = (df.withColumnRenamed("json", n) for df, n in zip(_versions(spark, sf_dir), ("base", "local", "remote")))
    return base.join(local, "id").join(remote, "id").select("id", conflict.merged("base", "local", "remote").alias("merged"))


#: A pack of rules for the versions above: notes are appended to, addresses merge, names need a review.
_PACK = [("Patient", "note", "append_only"), ("Patient", "address", "auto_merge"), ("Patient", "balance", "auto_merge"), ("Patient", "name", "review_only")]


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 6 IN (1, 5) THEN 'stale_base_only' WHEN c_custkey % 6 = 3 THEN 'append_compatible' WHEN c_custkey % 12 = 8 THEN 'overlap' ELSE 'non_overlap' END AS classification,
    CASE c_custkey % 6 WHEN 1 THEN 'review' WHEN 5 THEN 'blocked' ELSE 'safe' END AS risk, c_custkey % 6 = 3 OR c_custkey % 12 = 2 AS can_merge,
    CASE WHEN c_custkey % 12 = 8 THEN 'address.city' WHEN c_custkey % 6 = 3 THEN 'note' ELSE '' END AS overlaps FROM customer WHERE c_custkey % 6 IN (1, 2, 3, 5)""")
def conflict_rules(spark, sf_dir):
    return conflict.ruled(*_versions(spark, sf_dir), "Patient", _PACK)


@query("""SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 1 THEN '[{"op":"replace","path":"/name","value":"renamed"}]' WHEN 2 THEN '[{"op":"replace","path":"/address/city","value":"b"}]'
    WHEN 3 THEN '[{"op":"add","path":"/note/-","value":"local"}]' END AS patch FROM customer WHERE c_custkey % 6 IN (1, 2, 3, 5)""")
def conflict_patch(spark, sf_dir):
    return conflict.patches(*_versions(spark, sf_dir))


@query("""SELECT c_custkey AS id, 'review' AS decision, CASE WHEN c_custkey % 4 = 1 THEN 'resolved' ELSE 'open' END AS status, CASE WHEN c_custkey % 4 = 1 THEN 'theirs' END AS resolution FROM customer WHERE c_custkey % 6 IN (1, 5) OR c_custkey % 12 = 8""")
def conflict_list(spark, sf_dir):
    """Conflicts under review with what was decided last: first ours, then theirs."""
    found = conflict.classified(*_versions(spark, sf_dir)).where("decision = 'review'").select("id", "decision")
    keys = table(spark, sf_dir, "customer").where("c_custkey % 4 = 1").select(F.col("c_custkey").alias("id"))
    decided = keys.select("id", F.lit(1).alias("at"), F.lit("ours").alias("resolution")).unionByName(keys.select("id", F.lit(2).alias("at"), F.lit("theirs").alias("resolution")))
    return conflict.listed(found, decided)


@query("SELECT 'conflict:' || c_custkey AS job_key FROM customer WHERE (c_custkey % 6 IN (1, 5) OR c_custkey % 12 = 8) AND c_custkey % 5 <> 0")
def conflict_jobs(spark, sf_dir):
    existing = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.concat(F.lit("conflict:"), F.col("c_custkey").cast("string")).alias("job_key"))
    return conflict.jobs(conflict.classified(*_versions(spark, sf_dir)), existing)


# validation


def _documents(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    kind = F.when(k % 7 == 0, "Patent").otherwise("Patient")
    id_ = F.when(k % 5 == 0, F.concat(F.lit("bad id "), k.cast("string"))).otherwise(k.cast("string"))
    text = F.to_json(F.struct(kind.alias("resourceType"), id_.alias("id"), F.when(k % 3 != 0, F.col("c_name")).alias("name"), F.struct(F.when(k % 11 == 0, "nowhere").otherwise("Location/1").alias("reference")).alias("place")))
    return c.select(k.alias("key"), F.when(k % 13 == 0, F.substring(text, 1, 20)).otherwise(text).alias("json"))


_ISSUES = """i AS (SELECT c_custkey AS key, 'error' AS severity, 'invalid-json' AS code, '' AS detail FROM customer WHERE c_custkey % 13 = 0
    UNION ALL SELECT c_custkey, 'error', 'unknown-type', 'Patent' FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 7 = 0
    UNION ALL SELECT c_custkey, 'error', 'invalid-id', 'bad id ' || c_custkey FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 5 = 0
    UNION ALL SELECT c_custkey, 'error', 'required', 'name' FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, 'warning', 'invalid-reference', 'nowhere' FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 11 = 0)"""
REQUIRED = {"Patient": ["name"], "Encounter": ["status"]}


@query(f"WITH {_ISSUES} SELECT * FROM i")
def validate_issues(spark, sf_dir):
    return validate.issues(_documents(spark, sf_dir), REQUIRED)


@query(f"WITH {_ISSUES}, n AS (SELECT key, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM i GROUP BY key) SELECT c_custkey AS key, coalesce(errors, 0) = 0 AS valid, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM customer LEFT JOIN n ON key = c_custkey")
def validate_rollup(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return validate.rolled_up(docs, validate.issues(docs, REQUIRED))


# policy


def _requests(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    role = F.when(F.col("user_id") % 4 == 0, "admin").when(F.col("user_id") % 4 == 1, "nurse").otherwise("guest")
    perms = F.when(role == "nurse", F.array(F.lit("read"), F.lit("write"))).otherwise(F.array(F.lit("read")))
    return e.select("event_id", role.alias("role"), F.col("event_type").alias("action"), perms.alias("permissions"))


RULES = [
    {"name": "no-errors", "effect": "deny", "match": {"action": "error"}},
    {"name": "admins", "effect": "allow", "match": {"role": "admin", "action": "*"}},
    {"name": "writers", "effect": "allow", "match": {"all_permissions": ["read", "write"], "action": ["purchase", "click"]}},
    {"name": "readers", "effect": "allow", "match": {"any_permissions": ["read", "audit"], "action": "view"}},
]
_ROLE = "CASE user_id % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'nurse' ELSE 'guest' END"


@query(f"""SELECT event_id, CASE WHEN event_type = 'error' THEN 'deny' WHEN {_ROLE} = 'admin' THEN 'allow' WHEN {_ROLE} = 'nurse' AND event_type IN ('purchase', 'click') THEN 'allow' WHEN event_type = 'view' THEN 'allow' ELSE 'deny' END AS effect,
    CASE WHEN event_type = 'error' THEN 'no-errors' WHEN {_ROLE} = 'admin' THEN 'admins' WHEN {_ROLE} = 'nurse' AND event_type IN ('purchase', 'click') THEN 'writers' WHEN event_type = 'view' THEN 'readers' END AS rule FROM events""")
def policy_first_match(spark, sf_dir):
    return policy.decided(_requests(spark, sf_dir), RULES).select("event_id", "effect", "rule")


@query("SELECT DISTINCT user_id AS principal, p AS permission FROM events, (VALUES ('click', 'read'), ('click', 'list'), ('purchase', 'read'), ('purchase', 'write'), ('error', 'audit')) v(t, p) WHERE event_type = t")
def permission_union(spark, sf_dir):
    bindings = table(spark, sf_dir, "events").select(F.col("user_id").alias("principal"), F.col("event_type").alias("role")).distinct()
    roles = rows(spark, [("click", ["read", "list"]), ("purchase", ["read", "write"]), ("error", ["audit"])], "role string, permissions array<string>")
    return policy.permissions(bindings, roles)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, 'r' || c_nationkey % 2 AS request FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 2 AND (c_nationkey = 0 OR o_custkey % 10 = 1)")
def tenant_filter(spark, sf_dir):
    """Tenants are nations; tenant 1's requests are bound to patients whose keys end in 1."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    data = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("tenant_id"), F.col("o_orderkey").cast("string").alias("id"), (F.col("o_custkey") % 10).alias("patient_id"))
    asks = rows(spark, [(0, "r0", None), (1, "r1", 1)], "tenant_id int, request string, patient_scope bigint")
    return policy.tenant(data, asks).select("id", "request")


@query("SELECT c_custkey AS principal, CASE WHEN c_custkey % 3 = 0 THEN '*' ELSE 'Patient' END AS resource FROM customer UNION ALL SELECT c_custkey, 'Encounter' FROM customer")
def scope_collapse(spark, sf_dir):
    """Three scopes of each customer: every third may read all, which covers reading patients but not writing encounters; equal scopes are one."""
    verbs = lambda *v: F.array(*map(F.lit, v))
    scope = lambda resource, actions: F.struct(F.lit("user").alias("context"), resource.alias("resource"), actions.alias("actions"))
    all_ = F.when(F.col("c_custkey") % 3 == 0, "*").otherwise("Patient")
    each = F.array(scope(all_, verbs("read")), scope(F.lit("Patient"), verbs("read")), scope(F.lit("Encounter"), verbs("write", "read")))
    scopes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("principal"), F.explode(each).alias("s")).select("principal", "s.*")
    return policy.collapsed(scopes).select("principal", "resource")


@query("SELECT event_id AS request_id FROM events WHERE (user_id % 2 = 0 AND event_type IN ('view', 'click')) OR (user_id % 2 = 1 AND event_type = 'purchase')")
def scope_check(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    asks = e.select(F.col("event_id").alias("request_id"), (F.col("user_id") % 2).cast("int").alias("principal"), F.col("event_type").alias("action"), F.lit("Patient").alias("resource"))
    scopes = rows(spark, [(0, "*", ["view", "click"]), (1, "Patient", ["purchase"]), (0, "Patient", ["view"]), (1, "Encounter", ["view"])], "principal int, resource string, actions array<string>")
    return policy.scoped(asks, scopes).select("request_id")


@query("SELECT c_custkey AS k, CASE WHEN lower(c_mktsegment) < 'read' THEN lower(c_mktsegment) || '.read' ELSE 'read.' || lower(c_mktsegment) END AS canonical FROM customer")
def permission_canonical(spark, sf_dir):
    """A permission for each customer's segment, spelled in three ways."""
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    spelled = F.when(k % 3 == 0, F.concat(F.lit("read."), F.lower(s))).when(k % 3 == 1, F.concat(s, F.lit("-Read"))).otherwise(F.concat(F.lower(s), F.lit(".read")))
    return table(spark, sf_dir, "customer").select(k.alias("k"), policy.canonical_permission(spelled).alias("canonical"))


@query("SELECT sha256(CAST(c_custkey AS VARCHAR)) AS id, CAST(NULL AS DOUBLE) AS balance, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS name FROM customer")
def deidentified(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    return policy.masked(c, hashed=["id"], removed=["balance"], hidden=["name"])


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 10 <> 0 THEN [p_size % 4, p_partkey % 13, p_partkey % 3] > [p_size % 3, p_partkey % 11, p_partkey % 5] END AS a_newer FROM part")
def semver_compare(spark, sf_dir):
    """Two versions of each part compared by their numbers; every tenth is none."""
    k, size, text = F.col("p_partkey"), F.col("p_size"), lambda c: c.cast("string")
    a = F.when(k % 10 == 0, "x").otherwise(F.concat(F.lit("v"), F.concat_ws(".", text(size % 4), text(k % 13), text(k % 3))))
    b = F.concat_ws(".", text(size % 3), text(k % 11), text(k % 5))
    return table(spark, sf_dir, "part").select(k.alias("k"), (policy.semver(a) > policy.semver(b)).alias("a_newer"))


# forms: each order answers a questionnaire


ITEMS = [("status", "string", True, False), ("total", "decimal", True, False), ("reason", "string", True, False), ("review", "boolean", False, False)]
RULES_OF_ITEMS = [("reason", "status", "=", "f", "all"), ("review", "total", ">", "400000", "any"), ("review", "status", "=", "P", "any")]


def _answers(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    a = lambda link, value, when: F.when(when, F.struct(F.lit(link).alias("link_id"), value.alias("answer")))
    each = F.array_compact(F.array(a("status", F.col("o_orderstatus"), F.lit(True)), a("total", F.when(k % 9 == 0, "many").otherwise(F.col("o_totalprice").cast("string")), F.lit(True)), a("reason", F.lit("r"), k % 4 == 0), a("extra", F.lit("e"), k % 50 == 0)))
    return o.select(k.alias("response_id"), F.explode(each).alias("a")).select("response_id", "a.*")


@query("""SELECT o_orderkey AS response_id, 'status' AS link_id, true AS enabled FROM orders UNION ALL SELECT o_orderkey, 'total', true FROM orders UNION ALL SELECT o_orderkey, 'reason', o_orderstatus = 'F' FROM orders
    UNION ALL SELECT o_orderkey, 'review', (o_orderkey % 9 <> 0 AND o_totalprice > 400000) OR o_orderstatus = 'P' FROM orders""")
def sdc_enable_when(spark, sf_dir):
    items = rows(spark, ITEMS, "link_id string, type string, required boolean, repeats boolean")
    return forms.enabled(items, _answers(spark, sf_dir), rows(spark, RULES_OF_ITEMS, "link_id string, question string, operator string, answer string, behavior string"))


@query("""SELECT o_orderkey AS response_id, 'total' AS link_id, 'type' AS issue FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT o_orderkey, 'reason', 'required' FROM orders WHERE o_orderkey % 4 <> 0
    UNION ALL SELECT o_orderkey, 'extra', 'unknown-item' FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT o_orderkey, 'status', 'option' FROM orders WHERE o_orderstatus = 'P'""")
def sdc_validate(spark, sf_dir):
    items = rows(spark, ITEMS, "link_id string, type string, required boolean, repeats boolean")
    return forms.checked(_answers(spark, sf_dir), items, rows(spark, [("status", "F"), ("status", "O")], "link_id string, option string"))


@query("""SELECT o_orderkey AS response_id, 'Encounter' AS resource_type, '{"resourceType":"Encounter",' || CASE WHEN o_orderkey % 4 = 0 THEN '"reasonText":"r",' ELSE '' END || '"status":"' || o_orderstatus || '"}' AS json FROM orders""")
def sdc_extract(spark, sf_dir):
    mapping = rows(spark, [("status", "Encounter", "status"), ("reason", "Encounter", "reasonText")], "link_id string, resource_type string, field string")
    return forms.extracted(_answers(spark, sf_dir), mapping)


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 'segment' AS link_id, c_mktsegment AS answer FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'phone', '555-1-' || c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def sdc_populate(spark, sf_dir):
    from ..functions.paths import Path

    p = resources(spark, sf_dir, "Patient")
    items = rows(spark, [("segment",), ("phone",)], "link_id string")
    return forms.populated(items, p, {"segment": F.col("segment"), "phone": Path.of(p).at("telecom.value.first()").col, "other": F.lit("x")})


# binary content: the texts of documents


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("blob_id"), F.encode("text", "UTF-8").alias("data"))


@query("SELECT doc_id AS blob_id, sha256(text) AS sha256, strlen(text) AS n_bytes, greatest(1, ceil(strlen(text) / 4096.0))::BIGINT AS chunks FROM documents")
def chunk_reassemble(spark, sf_dir):
    return blobs.assembled(blobs.chunked(_texts(spark, sf_dir), 4096)).select("blob_id", "sha256", "n_bytes", "chunks")


@query("SELECT sha256(text) AS sha256, max(strlen(text)) AS n_bytes, min(doc_id) AS first_id, count(*) AS links FROM documents GROUP BY 1")
def doc_hash_dedupe(spark, sf_dir):
    texts = _texts(spark, sf_dir).select("blob_id", F.sha2("data", 256).alias("sha256"), F.octet_length("data").cast("long").alias("n_bytes"))
    return blobs.manifests(texts)


@query("SELECT doc_id AS blob_id, sha256(text) AS sha256 FROM documents")
def blob_encrypt_roundtrip(spark, sf_dir):
    key = F.lit(b"0123456789abcdef")
    sealed = _texts(spark, sf_dir).select("blob_id", blobs.encrypted("data", key).alias("sealed"))
    return sealed.select("blob_id", F.sha2(blobs.decrypted("sealed", key), 256).alias("sha256"))


@query("SELECT doc_id AS blob_id, greatest(1, ceil(strlen(text) / 4096.0))::BIGINT AS chunks, strlen(text) AS n_bytes FROM documents")
def blob_progress(spark, sf_dir):
    return blobs.progress(blobs.chunked(_texts(spark, sf_dir), 4096))


@query("SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)")
def blob_sync_plan(spark, sf_dir):
    sums = _texts(spark, sf_dir).select("blob_id", F.sha2("data", 256).alias("sha256"))
    return blobs.to_send(sums, sums.where("blob_id % 3 = 0")).select("sha256").distinct()


@query("SELECT event_id FROM events WHERE ts + INTERVAL 7 DAY <= TIMESTAMP '2024-01-20'")
def blob_expired(spark, sf_dir):
    kept = table(spark, sf_dir, "events").select("event_id", (F.col("ts") + F.expr("INTERVAL '7' DAY")).alias("retain_until"))
    return blobs.expired(kept, F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CAST(doc_id AS VARCHAR) AS blob FROM documents")
def blob_references(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    json = F.format_string('{"resourceType":"DocumentReference","content":[{"attachment":{"url":"Binary/%s"}}]}', "id")
    return blobs.blob_references(d.select("id", json.alias("json")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE -1.0 END AS balance FROM customer")
def materialized_upsert(spark, sf_dir):
    from ..sources.sinks import merged

    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_acctbal").alias("balance"))
    return merged(old, old.where("cast(id as bigint) % 2 = 1").select("id", F.lit(-1.0).alias("balance")), ["id"])


