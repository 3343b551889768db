"""Quantities with units and precision, JSON trees, forms within forms, all pages, replays."""

import json
import random

import pytest
from pyspark.sql import functions as F

from medloom.functions import normalize as N
from medloom.functions import trees
from medloom.functions.paths import Path, PathError
from medloom.operators import forms, sync
from medloom.operators import search as S


def test_written_numbers_stand_for_ranges(spark):
    df = spark.createDataFrame([("72",), ("72.0",), ("7e1",), ("1.5E-2",), (".5",), ("-3",), ("x",), (None,)], "n string")
    got = [None if r.q is None else (round(r.q.low, 9), round(r.q.high, 9)) for r in df.select(N.quantity(F.col("n"), F.lit("g")).alias("q")).collect()]
    assert got == [(71.5, 72.5), (71.95, 72.05), (65.0, 75.0), (0.0145, 0.0155), (0.45, 0.55), (-3.5, -2.5), None, None]


def test_quantity_search(spark):
    rows = [(1, (72.0, "kg", "u", "kg")), (2, (72400.0, "g", "u", "g")), (3, (72.6, "kg", "u", "kg")), (4, (72.0, "beats", None, None)), (5, (None, "kg", "u", "kg")), (6, None), (7, (72.0, "kilo", "other", "kg")), (8, (72.0, "furlong", "u", "fur"))]
    df = spark.createDataFrame(rows, "id int, valueQuantity struct<value:double,unit:string,system:string,code:string>").withColumn("resourceType", F.lit("O"))
    params = [S.Param("v", "quantity", lambda p: N.quantities(p["value"].ofType("Quantity")))]
    found = lambda q: sorted(r.id for r in S.direct(df, params, S.search(f"v={q}").terms).collect())
    assert found("72|u|kg") == [1, 2] and found("72.0|u|kg") == [1] and found("72") == [1, 4, 7, 8]
    assert found("gt72|u|kg") == [2, 3] and found("sa72|u|kg") == [3] and found("lt73||kg") == [1, 2, 3, 7] and found("72||beats") == [4]
    assert found("72||fur") == [8] and found("ap79||kg") == [1, 2, 3, 7] and found("ne72|u|kg") == [3] and found("1|u|kg,72||beats") == [4]
    for bad in ("heavy", "1|kg", "gt"):
        with pytest.raises(S.SearchError):
            found(bad)


def brute(value, level=0, pointer=""):
    out = []
    if isinstance(value, dict):
        for k, v in value.items():
            for i, x in enumerate(v) if isinstance(v, list) else [(None, v)]:
                if x is not None:
                    at = f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}" + ("" if i is None else f"/{i}")
                    out += [(level + 1, at, x), *brute(x, level + 1, at)]
    return out


def test_descendants_and_repeat_at_any_depth(spark):
    rng = random.Random(4)

    def made(n):
        if n == 0:
            return rng.choice([1, "s", None, True, {}])
        return {k: [made(n - 1) for _ in range(rng.randint(0, 2))] if rng.random() < 0.5 else made(rng.randrange(n)) for k in rng.sample(["item", "a/b", "c~", "d.e"], 2)}

    docs = [made(10) for _ in range(20)]
    docs.append({"item": {"item": [{"item": {"x": 1}}, {"y": 2}]}})
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(98, "no json"), (99, None), (97, "[1]")], "id int, json string")
    got = {r.id: [(x.level, x.pointer, json.loads(x.value)) for x in r.d] for r in df.select("id", trees.descendants("json").alias("d")).collect()}
    assert got[97] == got[98] == got[99] == []
    for i, d in enumerate(docs):
        assert [x[0] for x in got[i]] == sorted(x[0] for x in got[i]), "level by level"
        text = lambda xs: sorted((n, p, json.dumps(v, sort_keys=True)) for n, p, v in xs)
        assert text(got[i]) == text(brute(d))
    last = df.where("id = 20").select(trees.repeat("json", "item").alias("r")).first().r
    assert [(x.level, x.pointer) for x in last] == [(1, "/item"), (2, "/item/item/0"), (2, "/item/item/1"), (3, "/item/item/0/item")]


def test_typed_repeat(spark):
    df = spark.createDataFrame([([("a", [("b", [("c",)]), ("d", None)])],)], "item array<struct<id:string,item:array<struct<id:string,item:array<struct<id:string>>>>>>")
    assert [x.id for x in df.select(Path.of(df).repeat("item").col.alias("x")).first().x] == ["a", "b", "d", "c"]
    with pytest.raises(PathError):
        Path.of(df).repeat("none")


def test_forms_within_forms(spark):
    rows = [("r", 0, "a", None, "string"), ("r", 1, "b", "s", "group"), ("r", 2, "b", "t", "group"), ("s", 0, "x", "t", "group"), ("s", 1, "y", None, "string"), ("t", 0, "z", None, "date"), ("t", 1, "up", "r", "group"), ("r", 3, "a", None, "string"), ("r", 4, "gone", "none", "group"), ("other", 0, "q", None, "string")]
    items = spark.createDataFrame(rows, "form string, position int, link_id string, sub_form string, type string")
    done, issues = forms.expanded(items, spark.createDataFrame([("r",), ("empty",)], "form string"))
    assert [(r.link_id, r.type) for r in done.orderBy("form", "place").collect()] == [("a", "string"), ("b/x/z", "date"), ("b/y", "string"), ("b/z", "date"), ("a", "string"), ("gone", "group")]
    assert {tuple(r) for r in issues.collect()} == {("r", "b/x/up", "cycle"), ("r", "b/up", "cycle"), ("r", "gone", "not-found"), ("r", "a", "duplicate")}


def test_all_pages_with_text_and_chains(spark):
    people = spark.createDataFrame([("P", "1", "Ann Lee"), ("P", "2", "Bo Lee")], "resourceType string, id string, name string")
    notes = spark.createDataFrame([("N", str(i), f"lee wrote {'x' if i % 2 else 'y'}", ("P/" + str(1 + i % 2),)) for i in range(130)], "resourceType string, id string, text string, by struct<reference:string>")
    params = {"P": [S.Param("name", "string", lambda p: N.strings(p["name"]))], "N": [S.Param("text", "string", lambda p: N.strings(p["text"])), S.Param("by", "reference", lambda p: N.references(p["by"]), ("P",))]}
    load = {"P": people, "N": notes}.get
    assert S.all_pages([("by:P.name", "Ann Lee"), ("_count", "10"), ("_sort", "_id")], "N", params, load).count() == 65
    assert S.all_pages([("_text", "x lee"), ("by:P.name:contains", "lee")], "N", params, load).count() == 65
    assert S.run("_text=LEE&_count=3", "N", params, load).total.first()[0] == 130


def test_replay_reads_only_the_range_s_resources(spark):
    rows = [(i, "P", f"r{i % 7}", f"v{i}", "update", "{}", i % 2) for i in range(200)]
    log = spark.createDataFrame(rows, "sequence long, resource_type string, id string, version_id string, action string, json string, node int")
    out = {r.sequence: (r.node, r.base_version) for r in sync.replayed(log, 50, 60, 3).collect()}
    assert out == {i: (i % 2, f"v{i - 7}") for i in range(50, 61)}
