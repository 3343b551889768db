"""Policies, permissions and scopes over requests, as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import predicates


def _holds(field: str, wanted) -> Column:
    """A match entry: one value or several, with ``*`` for any; array columns need one in common."""
    values = [wanted] if isinstance(wanted, str) else list(wanted)
    if "*" in values:
        return F.lit(True)
    if field.startswith("any_"):
        return F.coalesce(F.arrays_overlap(field[4:], F.array(*map(F.lit, values))), F.lit(False))
    if field.startswith("all_"):
        return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, values)), field[4:])) == 0, F.lit(False))
    return F.coalesce(F.col(field).isin(*values), F.lit(False))


def decided(requests: DataFrame, rules: list[dict], default: str = "deny") -> DataFrame:
    """``requests`` with effect and rule: the first rule all of whose match entries hold, else the default.

    A rule is {name, effect, match: {column or any_column or all_column: value or values}}.
    """
    effect, name = F.lit(default), F.lit(None).cast("string")
    for rule in reversed(rules):
        test = F.lit(True)
        for field, wanted in rule.get("match", {}).items():
            test = test & _holds(field, wanted)
        effect, name = F.when(test, rule["effect"]).otherwise(effect), F.when(test, rule["name"]).otherwise(name)
    return requests.select("*", effect.alias("effect"), name.alias("rule"))


def decided_by(requests: DataFrame, rules: DataFrame, facts: Column, key: list[str], default: str = "deny", default_rule: str | None = None) -> DataFrame:
    """``requests`` with effect, rule and reason of the first rule (by priority, then name) that each meets, else the default.

    rules: name, priority, effect, reason, match (map of fields to values; ``all_`` before a field asks for all of them). Any number of rules: they are
    rows, found by an index of their predicates (see ``predicates``). Of a name that occurs twice, or an effect other than allow and deny, the document is refused.
    """
    bad = rules.groupBy("name").agg(F.count("*").alias("n"), F.min(F.col("effect").isin("allow", "deny")).alias("fine")).where("n > 1 or name is null or not coalesce(fine, false)").select("name").head(1)
    if bad:
        raise ValueError(f"rule {bad[0]['name']}: its name is not unique, or its effect neither allow nor deny")
    asked = requests.withColumn("_asked", facts)
    out = predicates.first_met(asked, rules, key, "_asked", ["priority", "name"], ["effect", "name", "reason"])
    return out.select(*requests.columns, F.coalesce("effect", F.lit(default)).alias("effect"), F.coalesce("name", F.lit(default_rule)).alias("rule"), "reason")


def permissions(bindings: DataFrame, roles: DataFrame) -> DataFrame:
    """principal, permission: the union over a principal's roles, each once."""
    return bindings.join(roles, "role").select("principal", F.explode("permissions").alias("permission")).distinct()


def canonical_permission(p: str | Column) -> Column:
    """``read.patient``, ``patient-read`` and the like are one permission."""
    c = F.lower(F.col(p) if isinstance(p, str) else p)
    return F.array_join(F.array_sort(F.split(c, r"[.\-]", 2)), ".")


def tenant(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows that a request may see: its tenant's, and if it is bound to a patient, that patient's only."""
    joined = rows.join(requests, "tenant_id")
    return joined.where(F.col("patient_scope").isNull() | (F.col("patient_scope") == F.col("patient_id")))


def collapsed(scopes: DataFrame) -> DataFrame:
    """context, resource, actions without those that another scope of the context covers (``*`` covers every resource).

    The scopes of a context of a principal, which are few, are compared with each other in one row.
    """
    rest = [c for c in scopes.columns if c not in ("principal", "context")]
    each = scopes.withColumn("actions", F.array_sort(F.array_distinct("actions")))
    own = each.groupBy("principal", "context").agg(F.collect_set(F.struct(*rest)).alias("_all"))  # equal scopes are one

    def covered(a: Column) -> Column:
        def covers(b: Column) -> Column:
            wider = (b["resource"] == "*") | (b["resource"] == a["resource"])
            differs = (a["resource"] != b["resource"]) | (F.size(a["actions"]) < F.size(b["actions"]))
            return F.coalesce(wider & (F.size(F.array_except(a["actions"], b["actions"])) == 0) & differs, F.lit(False))

        return F.exists("_all", covers)

    left = own.where("principal is not null and context is not null").select("principal", "context", F.explode(F.filter("_all", lambda a: ~covered(a))).alias("_s"))
    # what has no principal or context is covered by none
    alone = own.where("principal is null or context is null").select("principal", "context", F.explode("_all").alias("_s"))
    return left.unionByName(alone).select(*[F.col(c) if c in ("principal", "context") else F.col("_s")[c].alias(c) for c in scopes.columns])


def scoped(requests: DataFrame, scopes: DataFrame) -> DataFrame:
    """Requests that some scope of their principal covers: both spellings of the resource are looked up by equality."""
    each = scopes.select("principal", "resource", F.explode("actions").alias("action")).distinct()
    ask = requests.select("*", F.explode(F.array("resource", F.lit("*"))).alias("_resource"))
    fine = ask.join(each.withColumnRenamed("resource", "_resource"), ["principal", "action", "_resource"], "left_semi")
    return fine.drop("_resource").dropDuplicates(["request_id"])


def masked(df: DataFrame, hashed: list[str] = (), removed: list[str] = (), hidden: list[str] = ()) -> DataFrame:
    """De-identification by column: hashed, removed (null) or masked character by character."""
    of = {**{c: F.sha2(F.col(c).cast("string"), 256) for c in hashed}, **{c: F.lit(None).cast(df.schema[c].dataType) for c in removed}, **{c: F.mask(F.col(c).cast("string")) for c in hidden}}
    return df.withColumns(of) if of else df


def parsed_scopes(rows: DataFrame, scope: str = "scope") -> DataFrame:
    """``rows`` with context, resource and actions of a scope: ``patient/Observation.rs``, ``user/*.read``; all null if it is none.

    read is r and s, write is c, u and d, ``*`` is all five, in the order c, r, u, d, s.
    """
    part = lambda i: F.nullif(F.regexp_extract(scope, r"^(patient|user|system)/(\*|[A-Z][A-Za-z]+)\.(read|write|\*|c?r?u?d?s?)$", i), F.lit(""))
    verb = F.when(part(3) == "read", "rs").when(part(3) == "write", "cud").when(part(3) == "*", "cruds").otherwise(part(3))
    return rows.select("*", *[F.when(verb.isNotNull(), part(i)).alias(n) for i, n in ((1, "context"), (2, "resource"))], F.filter(F.split(verb, ""), lambda x: x != "").alias("actions"))


def snapshot(principals: DataFrame, bindings: DataFrame, roles: DataFrame, devices: DataFrame) -> DataFrame:
    """principal, roles, permissions, devices: what access checks need of each principal, in one row."""
    held = bindings.join(roles, "role", "left").groupBy("principal").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("permissions")))).alias("permissions"))
    own = devices.groupBy("principal").agg(F.array_sort(F.collect_set("device")).alias("devices"))
    none = F.array().cast("array<string>")
    return principals.join(held, "principal", "left").join(own, "principal", "left").select("principal", *[F.coalesce(c, none).alias(c) for c in ("roles", "permissions", "devices")])


def semver(v: str | Column) -> Column:
    """A version as numbers, for comparison; null if it is none."""
    c = F.regexp_extract(v, r"^v?(\d+)\.(\d+)\.(\d+)", 0)
    return F.when(c != "", F.transform(F.split(F.ltrim(c, F.lit("v")), r"\."), lambda x: x.try_cast("bigint")))


def ordered_semver(v: str | Column) -> Column:
    """A version as a value that sorts by precedence: numbers, then a pre-release before the release, its parts numbers before words; null if it is none."""
    c = F.col(v) if isinstance(v, str) else v
    pre = F.regexp_extract(c, r"^v?\d+\.\d+\.\d+-([0-9A-Za-z.-]+)(\+.*)?$", 1)
    fine = c.rlike(r"^v?\d+\.\d+\.\d+(-[0-9A-Za-z.-]+)?(\+.*)?$")
    parts = F.transform(F.split(pre, r"\."), lambda x: F.struct(x.try_cast("bigint").isNull().alias("word"), F.coalesce(x.try_cast("bigint"), F.lit(0)).alias("number"), x.alias("text")))
    return F.when(fine, F.struct(semver(c).alias("numbers"), (pre == "").alias("release"), F.when(pre != "", parts).alias("parts")))


def compatible(version: Column, least: Column) -> Column:
    """Whether a version is at least another of the same major version (below 1.0.0: of the same minor one)."""
    a, b = semver(version), semver(least)
    major = (a[0] == b[0]) & ((a[0] > 0) | (a[1] == b[1]))
    return major & (ordered_semver(version) >= ordered_semver(least))
