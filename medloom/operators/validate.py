"""Structural validation of JSON resources: issues, and their roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids as FHIR allows them (a fixed pattern).
ID_PATTERN = r"^[A-Za-z0-9\-.]{1,64}$"
REFERENCE_PATTERN = r"^([A-Z][A-Za-z]+/[A-Za-z0-9\-.]{1,64}|#.+|urn:.+|https?://.+)$"


def found(json: str | Column, required: dict[str, list[str]]) -> Column:
    """The issues of a resource (array of severity, code, detail), found in its row. ``required`` has the known types and their required fields."""
    v = F.try_parse_json(json)
    get = lambda p: F.get_json_object(json, "$." + p)
    issue = lambda bad, severity, code, detail: F.when(bad, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), detail.alias("detail")))
    kind, id_ = get("resourceType"), get("id")
    refs = F.regexp_extract_all(F.to_json(v), F.lit(r'"reference":"((?:[^"\\]|\\.)*)"'), F.lit(1))
    bad_refs = F.filter(refs, lambda r: ~r.rlike(REFERENCE_PATTERN))
    all_ = [
        issue(v.isNull(), "error", "invalid-json", F.lit("")),
        issue(v.isNotNull() & kind.isNull(), "error", "missing-type", F.lit("")),
        issue(kind.isNotNull() & ~F.coalesce(kind.isin(*required), F.lit(False)), "error", "unknown-type", kind),
        issue(id_.isNotNull() & ~id_.rlike(ID_PATTERN), "error", "invalid-id", id_),
        issue(F.size(bad_refs) > 0, "warning", "invalid-reference", F.array_join(bad_refs, ",")),
    ]
    all_ += [issue((kind == t) & get(f).isNull(), "error", "required", F.lit(f)) for t, fields in required.items() for f in fields]
    return F.array_compact(F.array(*all_))


def issues(docs: DataFrame, required: dict[str, list[str]], json: str = "json", key: str = "key") -> DataFrame:
    """key, severity, code, detail: one row for each issue. ``required`` has the known types and their required fields."""
    return docs.select(key, F.explode(found(json, required)).alias("i")).select(key, "i.*")


def bound(codes: DataFrame, value_sets: DataFrame, key: str = "key") -> DataFrame:
    """key, severity, code, detail of codes that are not in the value set that binds them; to be united with ``issues``.

    codes: key, path, strength (required, extensible, preferred or example), value_set, system, code; value_sets: value_set, system, code. A required binding is an
    error, an extensible one a warning, others say nothing. A value set that is not known is one warning of its own; a code without a system is looked for in any.
    """
    asked = codes.where("code is not null and strength in ('required', 'extensible')")
    known = value_sets.select("value_set", F.col("system").alias("_system"), F.col("code")).distinct()
    sets = known.select("value_set").distinct()
    lost = asked.join(sets, "value_set", "left_anti").select(key, F.lit("warning").alias("severity"), F.lit("unknown-value-set").alias("code"), F.concat_ws(" ", "path", "value_set").alias("detail"))
    with_system = asked.where("system is not null").join(known.withColumnRenamed("_system", "system"), ["value_set", "system", "code"], "left_anti")
    without = asked.where("system is null").join(known.select("value_set", "code"), ["value_set", "code"], "left_anti")
    wrong = with_system.select(*asked.columns).unionByName(without.select(*asked.columns)).join(sets, "value_set", "left_semi")
    severity = F.when(F.col("strength") == "required", "error").otherwise("warning")
    return wrong.select(key, severity.alias("severity"), F.lit("code-not-in-value-set").alias("code"), F.concat_ws(" ", "path", F.concat_ws("|", "system", F.col("code"))).alias("detail")).unionByName(lost)


def rolled_up(docs: DataFrame, found: DataFrame, key: str = "key") -> DataFrame:
    """key, valid, errors, warnings: only errors make a resource invalid."""
    counts = found.groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return docs.select(key).join(counts, key, "left").select(key, (F.coalesce("errors", F.lit(0)) == 0).alias("valid"), zero("errors"), zero("warnings"))
