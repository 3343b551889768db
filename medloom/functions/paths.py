"""Paths over typed nested columns with the collection semantics of FHIRPath, built as Catalyst expressions.

A Path is a Column with its type. Navigation flattens, drops nulls and keeps order; an empty collection is null for a
single value. ``Path.of(df)["name"]["given"].first()`` and ``Path.of(df).at("name.given.first()")`` are the same.
Conditions are functions of a Path: ``p["telecom"].where(lambda t: t["system"] == "phone")``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PathError(ValueError):
    """A path that the schema or the supported functions don't have."""


#: Functions of FHIRPath that are refused, as they need other resources or run-time types.
REFUSED = ("resolve", "memberOf", "is")
MAX_PATH = 4096
#: Items that a collection may have where it is read with ``limited``.
MAX_ITEMS = 1024


class Path:
    functions: dict[str, Callable[[Path], Path]] = {}

    def __init__(self, col: Column, dtype: T.DataType, name: str = "", parent: Path | None = None):
        self.col, self.dtype, self.name, self.parent = col, dtype, name, parent

    @classmethod
    def of(cls, df: DataFrame) -> Path:
        return cls(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema, "$root")

    @classmethod
    def register(cls, name: str, function: Callable[[Path], Path]) -> None:
        """A custom function for ``at`` and ``call``; built-in names can't be taken."""
        if name in REFUSED or hasattr(cls, name) or name == "ofType":
            raise PathError(f"{name} is built in")
        cls.functions[name] = function

    @property
    def many(self) -> bool:
        return isinstance(self.dtype, T.ArrayType)

    @property
    def item(self) -> T.DataType:
        return self.dtype.elementType if self.many else self.dtype

    def __getitem__(self, field: str) -> Path:
        if not isinstance(self.item, T.StructType) or field not in self.item.names:
            if isinstance(self.item, T.StructType) and any(n.startswith(field) and n[len(field) : len(field) + 1].isupper() for n in self.item.names):
                return Path(F.lit(None), T.NullType(), field, self)  # a choice: ofType() picks the column
            raise PathError(f"no {field} in {self.name}")
        of = self.item[field].dataType
        if self.name == "$root":
            return Path(F.col(f"`{field}`"), of, field, self)
        if not self.many:
            return Path(self.col[field], of, field, self)
        inner = F.filter(F.transform(self.col, lambda x: x[field]), lambda x: x.isNotNull())
        if isinstance(of, T.ArrayType):
            inner, of = F.flatten(inner), of.elementType
        return Path(F.filter(inner, lambda x: x.isNotNull()), T.ArrayType(of), field, self)

    def at(self, path: str) -> Path:
        """Dotted fields and calls without arguments but for ofType(T); a leading resource type is skipped."""
        if len(path) > MAX_PATH:
            raise PathError("the path is too long")
        out = self
        for i, step in enumerate(path.split(".")):
            if step.endswith(")"):
                name, _, arg = step[:-1].partition("(")
                out = out.ofType(arg) if name in ("ofType", "as") else out.call(name)
            elif not (i == 0 and step[:1].isupper()):
                out = out[step]
        return out

    def call(self, name: str) -> Path:
        if name in REFUSED:
            raise PathError(f"{name}() is not supported")
        if name in ("first", "exists", "count", "empty", "distinct"):
            return getattr(self, name)()
        if name in self.functions:
            return self.functions[name](self)
        raise PathError(f"no function {name}()")

    def ofType(self, kind: str) -> Path:  # noqa: N802
        """The column of a choice: value.ofType(Quantity) is valueQuantity."""
        if self.parent is None or not isinstance(self.dtype, T.NullType):
            raise PathError(f"{self.name} is no choice")
        return self.parent[self.name + kind[:1].upper() + kind[1:]]

    def array(self) -> Column:
        """The collection as an array without nulls, empty if there is nothing."""
        if self.many:
            return F.coalesce(F.filter(self.col, lambda x: x.isNotNull()), F.array().cast(self.dtype))
        return F.when(self.col.isNull(), F.array().cast(T.ArrayType(self.dtype))).otherwise(F.array(self.col))

    def single(self, strict: bool = False) -> Column:
        """The one value; null if there is none. Of several: null, or with ``strict`` an error."""
        if not self.many:
            return self.col
        a = self.array()
        several = F.raise_error(F.lit(f"{self.name}: more than one value")).cast(self.item) if strict else F.lit(None).cast(self.item)
        return F.when(F.size(a) > 1, several).otherwise(F.get(a, F.lit(0)))

    def first(self) -> Path:
        return Path(F.get(self.array(), F.lit(0)), self.item, self.name, self.parent) if self.many else self

    def exists(self) -> Path:
        return Path(F.size(self.array()) > 0 if self.many else self.col.isNotNull(), T.BooleanType(), "exists")

    def empty(self) -> Path:
        return Path(~self.exists().col, T.BooleanType(), "empty")

    def count(self) -> Path:
        return Path(F.size(self.array()) if self.many else self.col.isNotNull().cast("int"), T.IntegerType(), "count")

    def distinct(self) -> Path:
        return Path(F.array_distinct(self.array()), T.ArrayType(self.item), self.name)

    def where(self, condition: Callable[[Path], Column | Path]) -> Path:
        """The items for which the condition holds; where it is null they go."""
        test = lambda x: column(condition(Path(x, self.item, "$this")))
        if self.many:
            return Path(F.filter(self.array(), test), self.dtype, self.name)
        return Path(F.when(self.col.isNotNull() & test(self.col), self.col), self.dtype, self.name)

    def select(self, f: Callable[[Path], Path]) -> Path:
        """What a path within each item gives, in order, without nulls."""
        inner = f(Path(F.lit(None).cast(self.item), self.item, "$this"))
        got = F.transform(self.array(), lambda x: f(Path(x, self.item, "$this")).array())
        return Path(F.filter(F.flatten(got), lambda x: x.isNotNull()), T.ArrayType(inner.item), "select")

    def all(self, condition: Callable[[Path], Column | Path]) -> Path:
        """Whether the condition holds for every item; true of none, false where it is null."""
        test = lambda x: F.coalesce(column(condition(Path(x, self.item, "$this"))), F.lit(False))
        return Path(F.forall(self.array(), test), T.BooleanType(), "all")

    def matches(self, pattern: str) -> Path:
        """Whether a part of the one string fits a regular expression; empty of nothing."""
        return Path(F.regexp_like(self.single(), F.lit(pattern)), T.BooleanType(), "matches")

    def substring(self, start: int, length: int | None = None) -> Path:
        """Characters of the one string from ``start`` (from 0) on; empty if it does not reach so far."""
        s = self.single()
        part = F.substring(s, start + 1, length if length is not None else 1 << 30)
        return Path(F.when((F.length(s) > start) & F.lit(start >= 0), part), T.StringType(), "substring")

    def repeat(self, field: str) -> Path:
        """The items reached by ``field``, and by it again from those, level by level as deep as the type goes; the items themselves are not among them.

        A typed column has a type of finite depth; content of unknown depth is a JSON column (see ``trees``).
        """
        out, at = None, self
        while isinstance(at.item, T.StructType) and field in at.item.names:
            at = at[field]
            level = Path(F.transform(at.array(), lambda x: _shared(x, at.item, field)), T.ArrayType(_trimmed(at.item, field)), field)
            out = level if out is None else Path(F.concat(out.col, level.col), level.dtype, field)
        if out is None:
            raise PathError(f"no {field} in {self.name}")
        return out

    def limited(self, most: int = MAX_ITEMS) -> Path:
        """The same, with an error where there are more items than ``most``."""
        a = self.array()
        return Path(F.when(F.size(a) > most, F.raise_error(F.lit(f"{self.name}: more than {most} items")).cast(a_type(self))).otherwise(a), a_type(self), self.name)

    def union(self, other: Path) -> Path:
        return Path(F.array_union(self.array(), other.array()), T.ArrayType(self.item), self.name)

    def _compared(self, op: str, other) -> Column:
        """Empty compares to null, several items to false."""
        value = other.single() if isinstance(other, Path) else other if isinstance(other, Column) else F.lit(other)
        test = getattr(self.single(), op)(value)
        return F.when(F.size(self.array()) > 1, F.lit(False)).otherwise(test) if self.many else test

    def __eq__(self, other):
        return self._compared("__eq__", other)

    def __ne__(self, other):
        return self._compared("__ne__", other)

    def __gt__(self, other):
        return self._compared("__gt__", other)

    def __ge__(self, other):
        return self._compared("__ge__", other)

    def __lt__(self, other):
        return self._compared("__lt__", other)

    def __le__(self, other):
        return self._compared("__le__", other)

    __hash__ = None


def _trimmed(of: T.DataType, field: str) -> T.DataType:
    """A type without the field that recurs in it: what all levels have in common."""
    return T.StructType([f for f in of.fields if f.name != field]) if isinstance(of, T.StructType) else of


def _shared(x: Column, of: T.DataType, field: str) -> Column:
    return F.struct(*[x[f.name].alias(f.name) for f in of.fields if f.name != field]) if isinstance(of, T.StructType) else x


def a_type(p: Path) -> T.DataType:
    return p.dtype if p.many else T.ArrayType(p.dtype)


def today() -> Path:
    """The date at the start of the query."""
    return Path(F.current_date().cast("string"), T.StringType(), "today")


def column(x: Path | Column) -> Column:
    return x.single() if isinstance(x, Path) else x


def boolean(x: Path | Column, strict: bool = False) -> Column:
    """A filter's verdict: null is false, or with ``strict`` an error."""
    c = x.single(strict) if isinstance(x, Path) else x
    return F.coalesce(c, F.raise_error(F.lit("the condition is empty")).cast("boolean") if strict else F.lit(False))
