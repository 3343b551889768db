"""Three-way comparison of JSON resources: changes, overlaps, classification, merge."""

from __future__ import annotations

import json as _json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Paths whose change always needs a review, and the risk that they carry (fixed values).
RISKS = {"birthDate": "identity", "identifier": "identity", "name": "identity", "deceasedBoolean": "clinical", "valueQuantity": "clinical", "status": "clinical"}


#: The default rules of a merge: resource type, path, and how changes at or below it are treated (fixed values).
RULES = [
    ("Patient", "telecom", "auto_merge"), ("Patient", "address", "auto_merge"), ("Appointment", "note", "append_only"), ("Encounter", "statusHistory", "append_only"),
    ("MedicationRequest", "dosageInstruction", "review_only"), ("AllergyIntolerance", "clinicalStatus", "review_only"), ("Observation", "value", "review_only"),
    ("Consent", "provision", "review_only"), ("Appointment", "start", "review_only"), ("Patient", "birthDate", "review_only"),
]


LEAF = "array<struct<pointer:string,path:string,value:string,kind:string>>"


def _found(text: str | None) -> list[tuple[str, str, str, str]]:
    """The leaves of one JSON object, by a list of what is still to be opened: there is no limit of depth."""
    try:
        root = _json.loads(text) if text else None
    except ValueError:
        return []
    out, open_ = [], [("", "", root)] if isinstance(root, dict) and root else []
    while open_:
        pointer, path, value = open_.pop()
        if isinstance(value, dict) and value:
            open_ += [(f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}", f"{path}.{k}" if path else k, v) for k, v in value.items()]
        else:
            kind = "array" if isinstance(value, list) else "object" if isinstance(value, dict) else "scalar"
            out.append((pointer, path, _json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False), kind))
    return out


def opened(json: str | Column) -> Column:
    """The leaves of a JSON object as an array of (pointer, path, value as canonical JSON, kind); arrays and empty objects are leaves.

    ``pointer`` is the JSON Pointer (RFC 6901) that names the leaf, whatever its keys hold; ``path`` its keys with dots, for reports. Objects are opened
    at any depth, here in batches in Python: an expression opens only as many levels as it is written for.
    """

    @F.arrow_udf(LEAF)
    def leaves_of(texts: pa.Array) -> pa.Array:
        names = ("pointer", "path", "value", "kind")
        return pa.array([[dict(zip(names, x)) for x in _found(t)] for t in texts.to_pylist()], pa.list_(pa.struct([(n, pa.string()) for n in names])))

    return leaves_of(F.col(json) if isinstance(json, str) else json)


def leaves(docs: DataFrame, key: str = "id", json: str = "json") -> DataFrame:
    """key, pointer, path, value (canonical JSON), kind of each leaf, in one scan."""
    return docs.select(key, F.explode(opened(json)).alias("leaf")).select(key, "leaf.*")


def _change(old: Column, old_kind: Column, new: Column, new_kind: Column) -> Column:
    """How a leaf changed, null if it did not: scalar_replace, array_append, array_remove, structural (other edits of arrays, other kinds), unsupported (a key that is gone)."""
    items = lambda c: F.transform(F.try_parse_json(c).try_cast("array<variant>"), lambda v: F.to_json(v))
    a, b = items(old), items(new)
    both = (old_kind == "array") & (new_kind == "array")
    append = both & (F.size(b) > F.size(a)) & (F.slice(b, F.lit(1), F.size(a)) == a)
    remove = both & (F.size(b) < F.size(a)) & (F.size(F.array_except(b, a)) == 0)
    return (
        F.when(old.eqNullSafe(new), None).when(new.isNull(), "unsupported").when(append, "array_append").when(remove, "array_remove")
        .when(both | (F.coalesce(old_kind, new_kind) != new_kind), "structural").otherwise("scalar_replace")
    )


def changes(base: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """key, path, change, old, new of every leaf that differs."""
    rows = compared(base, other, base, key).where("mine is not null")
    return rows.select(key, "path", F.col("mine").alias("change"), F.col("base_value").alias("old"), F.col("local_value").alias("new"))


def compared(base: DataFrame, local: DataFrame, remote: DataFrame, key: str = "id") -> DataFrame:
    """key, pointer, path, mine, theirs (changes since base, null for none), the three values and kinds of every leaf that one side changed.

    The three versions are joined by key once and their leaves grouped within it; a version that is not there has no leaves.
    """
    side = lambda df, name: df.select(key, F.col("json").alias(name))
    rows = side(base, "base").join(side(local, "local"), key, "full_outer").join(side(remote, "remote"), key, "full_outer")

    def tag(n: str) -> Column:
        return F.transform(F.coalesce(opened(n), F.array()), lambda x: F.struct(F.lit(n).alias("side"), x.alias("leaf")))

    tagged = F.concat(*map(tag, ("base", "local", "remote")))
    each = rows.select(key, F.explode(tagged).alias("at")).select(key, "at.leaf.pointer", "at.leaf.path", "at.side", "at.leaf.value", "at.leaf.kind")
    pick = [F.max(F.when(F.col("side") == n, F.col(c))).alias(f"{n}_{c}") for n in ("base", "local", "remote") for c in ("value", "kind")]
    each = each.groupBy(key, "pointer").agg(F.max("path").alias("path"), *pick)
    change = lambda n: _change(F.col("base_value"), F.col("base_kind"), F.col(f"{n}_value"), F.col(f"{n}_kind"))
    return each.withColumn("mine", change("local")).withColumn("theirs", change("remote")).where("mine is not null or theirs is not null")


def _at(pointer: Column, place: str) -> Column:
    """Whether a pointer is a place (dotted) or below it."""
    at = "/" + "/".join(x.replace("~", "~0").replace("/", "~1") for x in place.split("."))
    return (pointer == at) | pointer.startswith(at + "/")


def _paths(overlaps: str = "overlaps") -> Column:
    return F.array_join(F.transform(overlaps, lambda x: x["path"]), ",").alias("overlaps")


def _met(rows: DataFrame, key: str) -> DataFrame:
    """key, changed (array of pointer, path, mine, theirs), overlaps (path and pointer of local leaves equal to a remote one, or one within the other), appends (all those are appends on both sides)."""
    of = F.struct("pointer", "path", "mine", "theirs")
    tops = rows.groupBy(key, F.substring_index("pointer", "/", 2).alias("top")).agg(F.collect_list(of).alias("changed"))
    near = lambda a, b: (a == b) | a.startswith(F.concat(b, F.lit("/"))) | b.startswith(F.concat(a, F.lit("/")))
    mine, theirs = F.filter("changed", lambda x: x["mine"].isNotNull()), F.filter("changed", lambda x: x["theirs"].isNotNull())
    hit = F.filter(mine, lambda x: F.exists(theirs, lambda y: near(x["pointer"], y["pointer"])))
    plain = lambda x: (x["mine"] == "array_append") & F.forall(theirs, lambda y: ~near(x["pointer"], y["pointer"]) | (y["theirs"] == "array_append"))
    tops = tops.select(key, "changed", F.transform(hit, lambda x: F.struct(x["path"], x["pointer"])).alias("hit"), F.forall(hit, plain).alias("appends"))
    return tops.groupBy(key).agg(F.flatten(F.collect_list("changed")).alias("changed"), F.array_sort(F.flatten(F.collect_list("hit"))).alias("overlaps"), F.min("appends").alias("appends"))


def classified(base: DataFrame, local: DataFrame, remote: DataFrame, key: str = "id") -> DataFrame:
    """key, decision, risk, overlaps: auto_merge, append_compatible or review."""
    rows = _met(compared(base, local, remote, key), key)

    def risk(pointer: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, kind in reversed(RISKS.items()):
            out = F.when(_at(pointer, name), kind).otherwise(out)
        return out

    hard = F.exists("changed", lambda x: F.coalesce(x["mine"].isin("structural", "unsupported"), F.lit(False)) | F.coalesce(x["theirs"].isin("structural", "unsupported"), F.lit(False)))
    rows = rows.withColumn("risk", F.array_max(F.transform("changed", lambda x: risk(x["pointer"]))))
    decision = F.when(hard | F.col("risk").isNotNull(), "review").when(F.size("overlaps") == 0, "auto_merge").when(F.col("appends"), "append_compatible").otherwise("review")
    return rows.select(key, decision.alias("decision"), "risk", _paths())


def _rule(pointer: Column, kind: str, rules: list[tuple[str, str, str]]) -> Column:
    """How the first rule of the type that is at or above a path treats it; null without one."""
    out = F.lit(None).cast("string")
    for of, at, semantics in reversed(rules):
        if of == kind:
            out = F.when(_at(pointer, at), semantics).otherwise(out)
    return out


def ruled(base: DataFrame, local: DataFrame, remote: DataFrame, kind: str, rules: list[tuple[str, str, str]] = RULES, key: str = "id") -> DataFrame:
    """key, classification, risk, can_merge, overlaps of resources of one type under a pack of rules.

    Risk is blocked (a change that no patch expresses, or a path under ``block``), review (a path under ``review_only``, or no rule at any change) or safe. A merge needs
    a rule at every local change, and of overlapping ones only appends on both sides under ``append_only``.
    """
    rows = _met(compared(base, local, remote, key), key)
    mine, theirs = F.filter("changed", lambda x: x["mine"].isNotNull()), F.filter("changed", lambda x: x["theirs"].isNotNull())
    rule = lambda x: F.coalesce(_rule(x, kind, rules), F.lit("none"))
    lost = lambda c: F.coalesce(c.isin("structural", "unsupported", "array_remove"), F.lit(False))
    blocked = F.exists("changed", lambda x: lost(x["mine"]) | lost(x["theirs"]) | (rule(x["pointer"]) == "block"))
    review = F.exists("changed", lambda x: rule(x["pointer"]) == "review_only")
    ruled_ = F.exists("changed", lambda x: rule(x["pointer"]).isin("auto_merge", "append_only"))
    risk = F.when(blocked, "blocked").when(review | ~ruled_, "review").otherwise("safe")
    append = F.forall("overlaps", lambda x: rule(x["pointer"]) == "append_only") & F.col("appends")
    name = (
        F.when((F.size(mine) == 0) | (F.size(theirs) == 0), "stale_base_only").when(F.size("overlaps") == 0, "non_overlap")
        .when(append, "append_compatible").otherwise("overlap")
    )
    fit = F.forall(mine, lambda x: rule(x["pointer"]).isin("auto_merge", "append_only") & ((rule(x["pointer"]) != "append_only") | (x["mine"] == "array_append")))
    can = (risk == "safe") & fit & ((F.size("overlaps") == 0) | append)
    return rows.select(key, name.alias("classification"), risk.alias("risk"), can.alias("can_merge"), _paths())


def patches(base: DataFrame, local: DataFrame, remote: DataFrame, key: str = "id") -> DataFrame:
    """key, patch: JSON Patch of the local changes on the current resource, by JSON Pointer; null where a change can't be patched.

    Appended items that the current array holds already are not added again.
    """
    rows = compared(base, local, remote, key).where("mine is not null")
    items = lambda c: F.transform(F.try_parse_json(c).try_cast("array<variant>"), lambda v: F.to_json(v))
    quoted = lambda at: F.regexp_replace(F.to_json(F.array(at)), r"^\[|\]$", "")
    op = lambda name, at, value: F.concat(F.lit(f'{{"op":"{name}","path":'), quoted(at), F.lit(',"value":'), value, F.lit("}"))
    old, new = items("base_value"), items("local_value")
    added = F.array_except(F.slice(new, F.size(old) + 1, F.greatest(F.size(new) - F.size(old), F.lit(0))), F.coalesce(items("remote_value"), F.array()))
    ops = F.when(F.col("mine") == "scalar_replace", F.array(op("replace", F.col("pointer"), F.col("local_value")))).when(F.col("mine") == "array_append", F.transform(added, lambda v: op("add", F.concat("pointer", F.lit("/-")), v)))
    each = rows.select(key, "pointer", ops.alias("ops")).groupBy(key).agg(F.max(F.col("ops").isNull()).alias("bad"), F.array_sort(F.collect_list(F.struct("pointer", "ops"))).alias("all"))
    text = F.concat(F.lit("["), F.array_join(F.flatten(F.transform("all", lambda x: x["ops"])), ","), F.lit("]"))
    return each.select(key, F.when(~F.col("bad"), text).alias("patch"))


def jobs(found: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """job_key of each conflict that needs a review and has no job yet, whatever state that job is in."""
    wanted = found.where("decision = 'review'").select(F.concat(F.lit("conflict:"), F.col(key).cast("string")).alias("job_key")).distinct()
    return wanted.join(existing.select("job_key"), "job_key", "left_anti")


def listed(conflicts: DataFrame, resolutions: DataFrame, key: str = "id") -> DataFrame:
    """The conflicts with status (open, resolved) and resolution: the last one (by at, then resolution) of each."""
    last = resolutions.groupBy(key).agg(F.max(F.struct("at", "resolution")).alias("last"))
    rows = conflicts.join(last, key, "left")
    return rows.select(*conflicts.columns, F.when(F.col("last").isNull(), "open").otherwise("resolved").alias("status"), F.col("last.resolution").alias("resolution"))


@F.pandas_udf(T.StringType())
def merged(base: pd.Series, local: pd.Series, current: pd.Series) -> pd.Series:
    """The current resource with the local changes since base; of arrays appended on both sides remote items come first.

    JSON of any shape is walked here, in Python: Catalyst has no way to rebuild an object of unknown fields.
    """

    def one(b, x, y):
        if isinstance(b, dict) and isinstance(x, dict) and isinstance(y, dict):
            return {k: one(b.get(k), x.get(k), y.get(k)) for k in sorted({*x, *y}) if k in x or k not in b}
        if isinstance(x, list) and isinstance(y, list) and isinstance(b, list) and x[: len(b)] == b and y[: len(b)] == b:
            return y + x[len(b) :]
        return y if x == b else x

    load = lambda s: _json.loads(s) if s else None
    return pd.Series([_json.dumps(one(load(b), load(x), load(y)), separators=(",", ":"), sort_keys=True) for b, x, y in zip(base, local, current)])
