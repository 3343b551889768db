"""Index values of data types: what a search may match, as arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import Path


def _clean(*parts: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")))


def _each(p: Path, f) -> Column:
    return F.array_distinct(F.flatten(F.transform(p.array(), f)))


def strings(p: Path) -> Column:
    return F.array_distinct(F.transform(p.array(), lambda x: x.cast("string")))


def human_names(p: Path) -> Column:
    """text, family, each given, and family with given names."""
    return _each(p, lambda n: F.array_distinct(F.filter(F.concat(F.array(n["text"], n["family"]), F.coalesce(n["given"], F.array().cast("array<string>")), F.array(F.concat_ws(" ", n["family"], F.array_join(n["given"], " ")))), lambda x: x.isNotNull() & (x != ""))))


def contact_points(p: Path) -> Column:
    return _each(p, lambda t: _clean(t["value"]))


def tokens(p: Path) -> Column:
    """Identifier or Coding: system|code and code."""
    code = "value" if "value" in p.item.names else "code"
    return _each(p, lambda t: _clean(F.concat_ws("|", t["system"], t[code]), t[code]))


def concept_tokens(p: Path) -> Column:
    """CodeableConcept: its codings' tokens and its text."""
    out = tokens(p["coding"])
    return F.array_union(out, F.transform(p["text"].array(), lambda x: x)) if "text" in p.item.names else out


def references(p: Path) -> Column:
    """Type/id, id and Type|id; what is no such reference stays as it is."""
    def one(r: Column) -> Column:
        v = r["reference"]
        kind, id_ = F.substring_index(v, "/", 1), F.substring_index(v, "/", -1)
        return F.when(v.contains("/") & ~v.startswith("urn:") & ~v.contains("://"), _clean(v, id_, F.concat_ws("|", kind, id_))).otherwise(_clean(v))

    return _each(p, one)


def dates(p: Path) -> Column:
    """Dates as written: of a Period its start, of a choice (DateTime, Date, Instant, Period) whichever there is."""
    if isinstance(p.dtype, T.NullType) and p.parent is not None and isinstance(p.parent.item, T.StructType):
        kinds = [k for k in ("DateTime", "Date", "Instant", "Period") if p.name + k in p.parent.item.names]
        return F.array_distinct(F.concat(*[dates(p.parent[p.name + k]) for k in kinds])) if kinds else F.array().cast("array<string>")
    return strings(p["start"]) if isinstance(p.item, T.StructType) else strings(p)


def utc(value: Column) -> Column:
    """A time with an offset as the same instant in UTC; anything else as it is."""
    moved = F.date_format(low(value).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(value.rlike(r"T.*[+-]\d\d:\d\d$"), F.coalesce(moved, value)).otherwise(value)


def date_variants(p: Path) -> Column:
    """The value in UTC and its date."""
    return F.array_distinct(F.flatten(F.transform(dates(p), lambda v: _clean(utc(v), F.substring_index(utc(v), "T", 1)))))


def numbers(p: Path) -> Column:
    return F.transform(p.array(), lambda x: x.cast("double").cast("string"))


#: Units of the Unified Code for Units of Measure with their base unit and factor (fixed values).
UNITS = {
    "kg": ("g", 1e3), "g": ("g", 1.0), "mg": ("g", 1e-3), "ug": ("g", 1e-6), "[lb_av]": ("g", 453.59237), "[oz_av]": ("g", 28.349523125),
    "m": ("m", 1.0), "cm": ("m", 1e-2), "mm": ("m", 1e-3), "[in_i]": ("m", 0.0254), "[ft_i]": ("m", 0.3048),
    "L": ("L", 1.0), "dL": ("L", 1e-1), "mL": ("L", 1e-3), "s": ("s", 1.0), "min": ("s", 60.0), "h": ("s", 3600.0), "d": ("s", 86400.0),
    "mm[Hg]": ("Pa", 133.322387415), "kPa": ("Pa", 1e3), "Pa": ("Pa", 1.0),
}


def _base(unit: Column, at: int) -> Column:
    """A unit's base unit (0) or factor (1); other units are their own base."""
    table = F.create_map(*[F.lit(x) for u, v in UNITS.items() for x in (u, v[at])])
    return F.coalesce(F.element_at(table, unit), unit if at == 0 else F.lit(1.0))


def half_step(number: Column) -> Column:
    """Half of a written number's last place: 72 is 71.5 to 72.5, 72.0 is 71.95 to 72.05, 7e1 is 65 to 75."""
    text = F.lower(number)
    mantissa, exponent = F.substring_index(text, "e", 1), F.coalesce(F.nullif(F.regexp_extract(text, r"e([+-]?\d+)$", 1), F.lit("")).try_cast("int"), F.lit(0))
    places = F.length(F.regexp_extract(mantissa, r"\.(\d*)$", 1))
    return F.lit(0.5) * F.pow(F.lit(10.0), exponent - places)


def quantity(number: Column, unit: Column) -> Column:
    """number (as text), unit -> base unit, low, high: the range that the written number stands for, in the base unit; null if it is no number."""
    n, f, h = number.try_cast("double"), _base(unit, 1), half_step(number)
    return F.when(n.isNotNull(), F.struct(_base(unit, 0).alias("unit"), ((n - h) * f).alias("low"), ((n + h) * f).alias("high"), (n * f).alias("value")))


def quantities(p: Path) -> Column:
    """Quantities as number|system|code, and as number||unit where the unit is written otherwise."""
    def number(q: Column) -> Column:
        text = q["value"].cast("string")
        return F.when(text.endswith(".0"), F.substring_index(text, ".", 1)).otherwise(text)  # a double has no written precision

    return _each(p, lambda q: F.when(q["value"].isNotNull(), _clean(F.concat_ws("|", number(q), F.coalesce(q["system"], F.lit("")), F.coalesce(q["code"], q["unit"], F.lit(""))), F.when(q["unit"] != q["code"], F.concat(number(q), F.lit("||"), q["unit"])))).otherwise(F.array().cast("array<string>")))


ZONE = r"(Z|[+-]\d\d:\d\d)$"


def _offset(value: Column) -> Column:
    """How far a value's zone is ahead of UTC."""
    zone = F.when(value.contains("T"), F.regexp_extract(value, r"([+-]\d\d:\d\d)$", 1)).otherwise("")
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")
    return F.make_dt_interval(F.lit(0), F.lit(0), F.when(zone == "", 0).when(zone.startswith("-"), -minutes).otherwise(minutes))


def _written(value: Column) -> Column:
    return F.when(value.contains("T"), F.regexp_replace(value, ZONE, "")).otherwise(value)


def _start(v: Column) -> Column:
    return F.try_to_timestamp(F.when(F.length(v) == 4, F.concat(v, F.lit("-01-01"))).when(F.length(v) == 7, F.concat(v, F.lit("-01"))).otherwise(v)).cast("timestamp_ntz")


def low(value: Column) -> Column:
    """First instant of a date of any precision (year, month, day, time), in UTC."""
    return _start(_written(value)) - _offset(value)


def high(value: Column) -> Column:
    """First instant after a date of any precision, in UTC."""
    v = _written(value)
    start = _start(v)
    return (
        F.when(F.length(v) == 4, start + F.expr("INTERVAL '1' YEAR")).when(F.length(v) == 7, start + F.expr("INTERVAL '1' MONTH"))
        .when(F.length(v) <= 10, start + F.expr("INTERVAL '1' DAY")).when(F.length(v) <= 16, start + F.expr("INTERVAL '1' MINUTE")).otherwise(start + F.expr("INTERVAL '1' SECOND"))
    ) - _offset(value)
