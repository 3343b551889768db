"""Flat views of resources: columns and filters as paths, compiled to one select over one scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import Path, boolean
from . import audit

Expr = str | Callable[[Path], "Path | Column"]
#: Declared column types and Spark's (fixed values).
TYPES = {"string": "string", "boolean": "boolean", "integer": "bigint", "decimal": "double", "date": "date", "dateTime": "timestamp"}


class ViewError(ValueError):
    """A definition that can't be compiled, or a view that isn't registered."""


@dataclass
class View:
    """``for_each`` unnests a collection (one row an item, none if it is empty; ``or_null``: one row without item)."""

    name: str
    resource: str
    columns: dict[str, Expr]
    where: list[Expr] = field(default_factory=list)
    version: str = "1.0.0"
    types: dict[str, str] = field(default_factory=dict)
    for_each: str = ""
    or_null: bool = False
    permission: str = ""


def evaluate(root: Path, e: Expr) -> Path | Column:
    return root.at(e) if isinstance(e, str) else e(root)


def cell(x: Path | Column) -> Column:
    """A column's value: scalars as they are, collections as arrays, null if empty."""
    if not isinstance(x, Path):
        return x
    return F.nullif(x.array(), F.array().cast(x.dtype)) if x.many else x.col


def compiled(view: View, df: DataFrame, strict: bool = False) -> DataFrame:
    """The view's rows. With ``strict`` a filter that is empty is an error, else such rows are left out."""
    if not view.columns:
        raise ViewError(f"{view.name} has no columns")
    root = Path.of(df)
    for e in view.where:
        df = df.where(boolean(evaluate(root, e), strict))
    if view.for_each:
        items = root.at(view.for_each)
        explode = F.explode_outer if view.or_null else F.explode
        df = df.select("*", explode(items.array()).alias("item"))
        df = df if not isinstance(items.item, T.StructType) else df.select("*", *[F.col("item")[n].alias(f"item_{n}") for n in items.item.names])
        root = Path.of(df)
    out = []
    for name, e in view.columns.items():
        c = cell(evaluate(root, e))
        kind = view.types.get(name)
        out.append((c.try_cast(TYPES[kind]) if kind else c).alias(name))
    return df.select(*out)


def union(views: list[tuple[View, DataFrame]]) -> DataFrame:
    """unionAll of views of the same columns."""
    out = compiled(*views[0])
    for v, df in views[1:]:
        out = out.unionByName(compiled(v, df))
    return out


def paged(rows: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows by columns (``-`` before a name: descending); a top-k, not a sort of all rows."""
    return rows.orderBy(*[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order]).offset(offset).limit(limit)


def logged(view: View, df: DataFrame, actor: str, at: Column) -> DataFrame:
    """The audit record of a run of a view: one row with its name, version and counters."""
    details = {"view": F.lit(view.name), "version": F.lit(view.version), "scanned": F.col("scanned"), "filtered": F.col("filtered")}
    return audit.records(counters(view, df), "view", F.lit(actor), details, at)


def counters(view: View, df: DataFrame) -> DataFrame:
    """scanned and filtered: resources read and resources that pass the filters."""
    root, test = Path.of(df), F.lit(True)
    for e in view.where:
        test = test & boolean(evaluate(root, e))
    return df.agg(F.count("*").alias("scanned"), F.count_if(test).alias("filtered"))


class Views:
    """Registered views by name and version; an empty version resolves only if there is one."""

    def __init__(self, *views: View):
        self.views: dict[tuple[str, str], View] = {}
        for v in views:
            self.register(v)

    def register(self, view: View) -> None:
        if (view.name, view.version) in self.views:
            raise ViewError(f"{view.name} {view.version} is registered")
        self.views[view.name, view.version] = view

    def resolve(self, name: str, version: str = "", permissions: set[str] | None = None) -> View:
        found = [v for (n, x), v in self.views.items() if n == name and version in ("", x)]
        if len(found) != 1:
            raise ViewError(f"{name} {version}: {len(found)} views")
        if permissions is not None and found[0].permission and found[0].permission not in permissions:
            raise PermissionError(found[0].permission)
        return found[0]


PATIENT_SUMMARY = View(
    "patient_summary_view", "Patient",
    {"id": "id", "given": "name.given.first()", "family": "name.family.first()", "gender": "gender", "phone": lambda p: p["telecom"].where(lambda t: t["system"] == "phone")["value"].first()},
    permission="read-patient-summary",
)
ENCOUNTERS_FROM_2000 = View(
    "encounter_view", "Encounter",
    {"id": "id", "status": "status", "description": "priority.text", "patientRef": "subject.reference"},
    where=[lambda p: p["status"] == "finished", lambda p: p["period"]["start"] >= "2000-01-01"],
)
OBSERVATION_QUANTITY = View(
    "observation_view", "Observation",
    {"id": "id", "status": "status", "codeText": "code.text", "value": lambda p: p["value"].ofType("Quantity")["value"], "unit": lambda p: p["value"].ofType("Quantity")["unit"]},
    where=[lambda p: p["status"] == "A"], types={"value": "decimal"},
)
BUILT_IN = Views(PATIENT_SUMMARY, ENCOUNTERS_FROM_2000, OBSERVATION_QUANTITY)
