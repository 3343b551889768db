"""Fields of JSON resources: allow lists, dotted writes, merges, citations of where a result comes from."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALWAYS = ("resourceType", "id")
OBJECT = "map<string,variant>"


def _object(v: Column) -> Column:
    """An object as a map; null for anything else."""
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v.cast(OBJECT))


def _json(fields: Column) -> Column:
    return F.to_json(F.to_variant_object(fields))


def allowed(json: str | Column, names: list[str]) -> Column:
    """The object's top-level fields of the allow list, and resourceType and id; null if it is no object."""
    keep = list(dict.fromkeys([*ALWAYS, *names]))
    return _json(F.map_filter(_object(F.try_parse_json(json)), lambda k, _: k.isin(*keep)))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed, and written into the plan, once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@dataclass
class _Node:
    """A field on the way of some paths: the value put there, and the fields below it."""

    value: str = ""
    order: int = -1
    below: dict[str, _Node] = field(default_factory=dict)


def _tree(paths: list[str]) -> dict[str, _Node]:
    """Paths as a tree: each field's node once, whatever the number of paths that go through it."""
    root: dict[str, _Node] = {}
    for i, path in enumerate(paths):
        at, names = root, path.split(".")
        for n, name in enumerate(names):
            node = at.setdefault(name, _Node())
            if n == len(names) - 1:
                node.value, node.order = f"v{i}", i
            at = node.below
    return root


def _leaves(below: dict[str, _Node]):
    for node in below.values():
        if node.value:
            yield node
        yield from _leaves(node.below)


def _put(fields: Column, below: dict[str, _Node], values: Column, over: tuple[tuple[int, str], ...] = ()) -> Column:
    """A map of fields with the values of a tree at their places; null values leave their places as they are.

    ``over``: values put further up, by their place in the order; where one is there, values before it are gone.
    """

    def given(node: _Node) -> Column:
        gone = [values[v].isNotNull() for order, v in over if order > node.order]
        return F.when(~reduce(or_, gone), values[node.value]) if gone else values[node.value]

    def new(node: _Node, old: Column) -> Column:
        own = given(node) if node.value else F.lit(None).cast("variant")
        if not node.below:
            return own
        deeper = (*over, (node.order, node.value)) if node.value else over
        some = reduce(or_, [_some(x, values, deeper) for x in _leaves(node.below)])
        inner = F.coalesce(_object(F.coalesce(own, old)), F.create_map().cast(OBJECT))
        return F.when(some, F.to_variant_object(_let(inner, lambda m: _put(m, node.below, values, deeper)))).otherwise(own)

    entries = F.array(*[F.struct(F.lit(name).alias("key"), new(node, fields[name]).alias("value")) for name, node in below.items()])
    changed = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return _let(changed, lambda c: F.map_concat(F.map_filter(fields, lambda k, _: ~F.map_contains_key(c, k)), c))


def _some(node: _Node, values: Column, over: tuple[tuple[int, str], ...]) -> Column:
    gone = [values[v].isNull() for order, v in over if order > node.order]
    return reduce(and_, gone, values[node.value].isNotNull())


def with_fields(json: str | Column, values: dict[str, Column]) -> Column:
    """The object with each dotted path set to a value given as JSON text; null text leaves the path as it is.

    Paths are set in the order given. Objects on the way are made where they are missing. The result is canonical JSON; null if ``json``
    is no object. The plan grows with the number of fields in the paths.
    """
    if not values:
        return _json(_object(F.try_parse_json(json)))
    tree = _tree(list(values))
    given = F.struct(*[F.try_parse_json(text).alias(f"v{i}") for i, text in enumerate(values.values())])
    return _json(_let(_object(F.try_parse_json(json)), lambda m: _let(given, lambda v: F.when(m.isNotNull(), _put(m, tree, v)))))


def merged_update(json: str | Column, update: str | Column) -> Column:
    """The object with the top-level fields of another in place of its own; resourceType and id stay."""
    old, new = _object(F.try_parse_json(json)), _object(F.try_parse_json(update))
    new = F.map_filter(F.coalesce(new, F.create_map().cast(OBJECT)), lambda k, _: ~k.isin(*ALWAYS))
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(new), k), F.lit(False)))
    return _json(F.map_concat(kept, new))


def cited(df: DataFrame, kind: str, source: Column, fields: list[str]) -> DataFrame:
    """``df`` with citation: what a row comes from (search, view or write), its reference, version if there is one, and fields used."""
    if kind not in ("search", "view", "write"):
        raise ValueError(f"no citation of {kind}")
    version = F.col("version_id").cast("string") if "version_id" in df.columns else F.lit(None).cast("string")
    return df.withColumn("citation", F.struct(F.lit(kind).alias("kind"), source.alias("reference"), version.alias("version"), F.array(*map(F.lit, fields)).cast("array<string>").alias("fields")))


def checked(requests: DataFrame, lists: DataFrame) -> DataFrame:
    """Requests with ok and refused: the fields asked for that the allow list of the tool and operation does not have.

    requests: request_id, tool, operation, fields; lists: tool, operation, fields. A tool or operation without a list is refused.
    """
    known = lists.select("tool", "operation", F.col("fields").alias("_allowed"))
    rows = requests.join(known, ["tool", "operation"], "left")
    refused = F.when(F.col("_allowed").isNull(), F.col("fields")).otherwise(F.array_except("fields", "_allowed"))
    return rows.select(*requests.columns, (F.col("_allowed").isNotNull() & (F.size(refused) == 0)).alias("ok"), F.array_join(F.array_sort(refused), ",").alias("refused"))
