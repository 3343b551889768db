"""Search parameters from their definitions: SearchParameter resources as data, compiled for the columns that resources have.

A definition names a code, base types, a type and an expression (``Patient.name``, ``Observation.value as Quantity``, alternatives with ``|``). How
values are made index values follows from the definition's type and from the type of the column that the expression reaches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize as N
from ..functions.paths import Path, PathError
from ..operators.search import Param

SCHEMA = "resourceType string, code string, base array<string>, type string, expression string, target array<string>"
KINDS = ("string", "token", "reference", "date", "number", "quantity")
#: Definitions are read to the driver, of so many types and parameters at most.
MOST = 100_000


class DefinitionError(ValueError):
    """A definition that can't be compiled for the columns at hand."""


def alternatives(expression: str, kind: str) -> list[str]:
    """The paths of an expression that start at a type, without it; ``(Observation.value as Quantity)`` is value.ofType(Quantity)."""
    out = []
    for part in expression.split("|"):
        path, _, of = (x.strip() for x in part.strip().strip("()").partition(" as "))
        base, _, rest = path.partition(".")
        if base == kind and rest:
            out.append(f"{rest}.ofType({of})" if of else rest)
    return out


def _normalizer(kind: str, at: Path) -> Callable[[Path], Column]:
    names = set(at.item.names) if isinstance(at.item, T.StructType) else set()
    if kind == "string":
        return N.human_names if {"family", "given"} <= names else N.contact_points if {"system", "value"} <= names else N.strings
    if kind == "token":
        return N.concept_tokens if "coding" in names else N.tokens if "system" in names else N.strings
    return {"reference": N.references, "date": N.dates, "number": N.numbers, "quantity": N.quantities}[kind]


def _values(kind: str, paths: list[str]) -> Callable[[Path], Column]:
    def of(root: Path) -> Column:
        found = []
        for path in paths:
            at = root.at(path)
            found.append(_normalizer(kind, at)(at))
        return F.array_distinct(F.concat(*found)) if len(found) > 1 else found[0]

    return of


def compiled(definitions: DataFrame, load: Callable[[str], DataFrame], kinds: list[str] | None = None, strict: bool = True) -> dict[str, list[Param]]:
    """The parameters of each type (``kinds``, or all bases) from SearchParameter rows (see SCHEMA); ``load`` gives a type's columns.

    A definition of an unknown type, without a path at the type, or with a path that its columns don't have is an error; without ``strict`` it is
    left out, as is a type that ``load`` does not know. A code that occurs twice for a type: the last by expression counts.
    """
    rows = definitions.where("resourceType = 'SearchParameter' and code is not null").select("code", "type", "expression", "target", F.explode("base").alias("base"))
    rows = rows.groupBy("base", "code").agg(F.max_by(F.struct("type", "expression", "target"), "expression").alias("d")).select("base", "code", "d.*").orderBy("base", "code").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise DefinitionError(f"more than {MOST} definitions")
    out: dict[str, list[Param]] = {}
    roots: dict[str, Path] = {}
    for r in rows:
        if kinds is not None and r["base"] not in kinds:
            continue
        try:
            if r["type"] not in KINDS:
                raise DefinitionError(f"{r['base']}.{r['code']}: no type {r['type']}")
            if r["base"] not in roots:
                roots[r["base"]] = Path.of(load(r["base"]))
            paths = alternatives(r["expression"] or "", r["base"])
            if not paths:
                raise DefinitionError(f"{r['base']}.{r['code']}: no path in {r['expression']}")
            values = _values(r["type"], paths)
            values(roots[r["base"]])  # a path that the columns don't have is found now, not in a search
            out.setdefault(r["base"], []).append(Param(r["code"], r["type"], values, tuple(r["target"] or ())))
        except (PathError, DefinitionError, KeyError) as e:
            if strict:
                raise e if isinstance(e, DefinitionError) else DefinitionError(f"{r['base']}.{r['code']}: {e}") from e
    return out
