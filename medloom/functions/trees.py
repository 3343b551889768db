"""JSON content of unknown depth: repeat() and descendants() of FHIRPath, over batches of documents.

A typed column has as many levels as its type; JSON text (a questionnaire's items, extensions in extensions) has any number. It is opened level
by level with a queue, in batches in Python, since an expression opens only as many levels as it is written for.
"""

from __future__ import annotations

import json as _json
from collections import deque

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NODE = "array<struct<level:int,pointer:string,value:string>>"
_TYPE = pa.list_(pa.struct([("level", pa.int32()), ("pointer", pa.string()), ("value", pa.string())]))


def _text(value) -> str:
    return _json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def _key(name) -> str:
    return "/" + str(name).replace("~", "~0").replace("/", "~1")


def _inner(value) -> list[tuple[str, object]]:
    """The children of a value: a field's items one by one."""
    if not isinstance(value, dict):
        return []
    out = []
    for k, v in value.items():
        out += [(f"{_key(k)}/{i}", x) for i, x in enumerate(v)] if isinstance(v, list) else [(_key(k), v)]
    return [(p, v) for p, v in out if v is not None]


def _walked(text: str | None, field: str | None) -> list[dict]:
    try:
        root = _json.loads(text) if text else None
    except ValueError:
        return []
    out, queue = [], deque([(0, "", root)])
    while queue:
        level, pointer, value = queue.popleft()
        for place, child in _inner({field: value[field]} if field is not None and isinstance(value, dict) and field in value else {} if field is not None else value):
            out.append({"level": level + 1, "pointer": pointer + place, "value": _text(child)})
            queue.append((level + 1, pointer + place, child))
    return out


def _udf(field: str | None):
    @F.arrow_udf(NODE)
    def walked(texts: pa.Array) -> pa.Array:
        return pa.array([_walked(t, field) for t in texts.to_pylist()], _TYPE)

    return walked


def descendants(json: str | Column) -> Column:
    """All that a JSON object holds at any depth, level by level: array of (level from 1, JSON Pointer, value as canonical JSON). Nulls are left out; of no JSON, nothing."""
    return _udf(None)(F.col(json) if isinstance(json, str) else json)


def repeat(json: str | Column, field: str) -> Column:
    """What ``field`` gives, and gives again from there on, at any depth: as ``descendants``."""
    return _udf(field)(F.col(json) if isinstance(json, str) else json)
