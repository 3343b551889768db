"""Code systems and value sets: lookup, expansion, validation, closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.resources import canonical, fingerprint
from ..sources.steps import stepped

MAX_EXPANSION = 10_000
MEMBER = ["system", "version", "code"]


class TooCostly(ValueError):
    """An expansion above the limit."""


def flattened(systems: DataFrame) -> DataFrame:
    """(system, version, concept array of (code, display, concept...)) -> system, version, code, display, parent_code.

    One explode a level; the schema says how deep the tree goes.
    """
    level = systems.select("system", "version", F.lit(None).cast("string").alias("parent_code"), F.explode("concept").alias("c"))
    out = None
    while True:
        rows = level.select("system", "version", F.col("c.code").alias("code"), F.col("c.display").alias("display"), "parent_code")
        out = rows if out is None else out.unionByName(rows)
        if "concept" not in level.schema["c"].dataType.names:
            return out
        level = level.select("system", "version", F.col("c.code").alias("parent_code"), F.explode("c.concept").alias("c"))


def newest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each key the row of the highest version (as text)."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "version").alias("r")).select(*keys, "r.*")


def lookup(codes: DataFrame, concepts: DataFrame, retired: DataFrame | None = None) -> DataFrame:
    """Displays of codes; concepts of retired systems are not found."""
    live = concepts if retired is None else concepts.join(retired.select("system"), "system", "left_anti")
    return codes.join(live.select("system", "code", F.col("display").alias("found_display")), ["system", "code"], "left")


def expanded(concepts: DataFrame, include: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Members of the included systems or codes (null code: the whole system) without the excluded codes.

    A member is a code of a system, and of a version where there is one; of several rows the last by their columns stays.
    """
    whole = concepts.join(include.where("code is null").select("system").distinct(), "system", "left_semi")
    single = concepts.join(include.where("code is not null").select("system", "code").distinct(), ["system", "code"], "left_semi")
    both = whole.unionByName(single)
    keys = [c for c in MEMBER if c in both.columns]
    rest = sorted((c for c in both.columns if c not in keys), key=lambda c: c != "display")
    out = both.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("last")).select(*keys, "last.*") if rest else both.distinct()
    return out if exclude is None else out.join(exclude.select("system", "code"), ["system", "code"], "left_anti")


def members(value_sets: DataFrame, start: str) -> DataFrame:
    """Rows of a value set and of those that it includes, however nested; a cycle ends where it closes.

    value_sets: url, system, code, includes (url or null). Each step joins the new urls only.
    """
    spark = value_sets.sparkSession
    seen = spark.createDataFrame([(start,)], "url string")
    fresh = seen
    while not fresh.isEmpty():
        step = value_sets.join(fresh, "url", "left_semi").where("includes is not null").select(F.col("includes").alias("url")).distinct()
        fresh = stepped(step.join(seen, "url", "left_anti"), "fresh")
        seen = seen.unionByName(fresh)
    return value_sets.where("system is not null").join(seen, "url", "left_semi").select("system", "code").distinct()


def page(expansion: DataFrame, offset: int, count: int, limit: int = MAX_EXPANSION) -> DataFrame:
    """A page of an expansion by system and code; larger expansions than ``limit`` are refused."""
    if expansion.limit(limit + 1).count() > limit:
        raise TooCostly(f"more than {limit} members")
    return expansion.orderBy("system", "code").offset(offset).limit(count)


def validated(codings: DataFrame, allowed: DataFrame) -> DataFrame:
    """codings (system, code, display) with result and message: unknown codes fail, other displays only warn."""
    known = allowed.select("system", "code", F.col("display").alias("right_display"))
    rows = codings.join(known, ["system", "code"], "left")
    found = F.col("right_display").isNotNull()
    message = F.when(~found, "unknown code").when(F.col("display").isNotNull() & (F.col("display") != F.col("right_display")), F.concat(F.lit("display should be "), F.col("right_display")))
    return rows.select(*codings.columns, found.alias("result"), message.alias("message"))


def closure(concepts: DataFrame) -> DataFrame:
    """ancestor, code, distance (the least) of every concept under each of its ancestors: a join a level, however many rows; a cycle ends where it closes."""
    edges = stepped(concepts.where("parent_code is not null").select("code", F.col("parent_code").alias("ancestor")).distinct(), "edges")
    fresh = stepped(edges.withColumn("distance", F.lit(1)), "closure")
    out = fresh
    while True:
        up = edges.select(F.col("code").alias("ancestor"), F.col("ancestor").alias("above"))
        step = fresh.join(up, "ancestor").select("code", F.col("above").alias("ancestor"), (F.col("distance") + 1).alias("distance")).distinct()
        fresh = stepped(step.join(out.select("code", "ancestor"), ["code", "ancestor"], "left_anti"), "closure")
        if fresh.isEmpty():
            return out.select("ancestor", "code", "distance")
        out = out.unionByName(fresh)


def compiled(value_sets: DataFrame, compose: str = "compose") -> DataFrame:
    """value_sets with compose in canonical form and its fingerprint; what is no JSON has neither."""
    return value_sets.withColumn(compose, canonical(compose)).withColumn("fingerprint", fingerprint(compose))


def outdated(value_sets: DataFrame, built: DataFrame) -> DataFrame:
    """url, version, fingerprint of compiled value sets that are not built yet, or were built of another compose."""
    done = built.select("url", "version", "fingerprint")
    return value_sets.where("fingerprint is not null").select("url", "version", "fingerprint").join(done, ["url", "version", "fingerprint"], "left_anti")


def replaced(current: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """All rows of the keys that ``new`` has come from it, the others stay as they are."""
    return current.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def first_found(codes: DataFrame, *providers: DataFrame) -> DataFrame:
    """Displays from the first provider that knows a code."""
    out = codes
    for i, p in enumerate(providers):
        out = out.join(p.select("system", "code", F.col("display").alias(f"_d{i}")), ["system", "code"], "left")
    return out.select(*codes.columns, F.coalesce(*[F.col(f"_d{i}") for i in range(len(providers))]).alias("found_display"))
