"""Audit records and analytics events: building, filtering, reading by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("read", "search", "view", "create", "update", "delete", "denied", "error")


def records(df: DataFrame, kind: str, actor: Column, details: dict[str, Column], at: Column) -> DataFrame:
    """ts, kind, actor, details (map) of each row."""
    if kind not in KINDS:
        raise ValueError(f"no audit kind {kind}")
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(at.alias("ts"), F.lit(kind).alias("kind"), actor.alias("actor"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("details"))


def listed(rows: DataFrame, limit: int, since=None, until=None, **equal) -> DataFrame:
    """The oldest records that meet all filters given; a top-k, not a sort of the table."""
    for c, v in equal.items():
        rows = rows.where(F.col(c) == v)
    rows = rows if since is None else rows.where(F.col("ts") >= since)
    rows = rows if until is None else rows.where(F.col("ts") < until)
    return rows.orderBy("ts", *[c for c in ("id", "event_id") if c in rows.columns]).limit(limit)


def named(events: DataFrame, name: str, since) -> DataFrame:
    """Analytics events of a name since a time."""
    return events.where((F.col("name") == name) & (F.col("ts") >= since))


def analytics(df: DataFrame, name: Column, ts: Column, dimensions: dict[str, Column], values: dict[str, Column]) -> DataFrame:
    """name, ts, dimensions (map of text), values (map of numbers)."""
    pairs = lambda d, kind: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v.cast(kind))])
    return df.select(name.alias("name"), ts.alias("ts"), pairs(dimensions, "string").alias("dimensions"), pairs(values, "double").alias("values"))
