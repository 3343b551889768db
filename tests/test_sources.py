"""Bundles in and out, parameters from definitions, contents by hash, bindings."""

import json

import pytest
from pyspark.sql import functions as F

from medloom.operators import search as S
from medloom.operators import validate
from medloom.plans import catalog
from medloom.sources import bundles, definitions
from medloom.sources.stored import BlobStore
from medloom.sources.tables import encounters, observations, patients

SF = "/root/testdata/sf0.001"


def test_bundles_that_are_none(spark, tmp_path):
    entry = {"request": {"method": "PUT", "url": "P/1"}, "resource": {"resourceType": "P", "id": "1", "b": 1, "a": "é"}}
    lines = [json.dumps({"resourceType": "Bundle", "entry": [entry, {"request": {"method": "DELETE", "url": "P/2"}}, {"request": {"method": "PUT"}}]}), "no json", '{"resourceType":"P"}', "", '{"resourceType":"Bundle"}', "[1]"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    rows = bundles.read_bundles(spark, f"file://{tmp_path}/in").select("position", "method", "url", "resource_type", "id", "json", "error").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [(0, "PUT", "P/1", "P", "1", '{"a":"é","b":1,"id":"1","resourceType":"P"}', None), (1, "DELETE", "P/2", None, None, None, None), (2, "PUT", None, None, None, None, "no resource"), (0, *[None] * 5, "no JSON"), (0, *[None] * 5, "no bundle"), (0, *[None] * 5, "no bundle")],
        key=str,
    )
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "b.json").write_text(json.dumps({"resourceType": "Bundle", "entry": [entry]}, indent=2))
    assert [r.id for r in bundles.read_bundles(spark, f"file://{tmp_path}/whole", lines=False).collect()] == ["1"]


def test_bundles_have_their_size_and_order(spark, tmp_path):
    df = spark.range(95).select(F.lit("P").alias("resource_type"), F.format_string("%03d", "id").alias("id"), F.when(F.col("id") != 7, F.format_string('{"id":"%03d"}', "id")).alias("json")).repartition(7)
    bundles.write_bundles(df, f"file://{tmp_path}/out", "batch", 10)
    made = [json.loads(line) for f in (tmp_path / "out").glob("part-*") for line in f.read_text().splitlines()]
    made.sort(key=lambda b: b["entry"][0]["resource"]["id"])
    assert [len(b["entry"]) for b in made] == [10] * 9 + [4] and {b["type"] for b in made} == {"batch"}
    assert [e["request"]["url"] for b in made for e in b["entry"]] == [f"P/{i:03}" for i in range(95) if i != 7]
    with pytest.raises(ValueError):
        bundles.write_bundles(df, f"file://{tmp_path}/x", "message")


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(20).select(F.lit("P").alias("resource_type"), F.col("id").cast("string").alias("id"), F.when(F.col("id") == 13, F.raise_error(F.lit("stop"))).otherwise("{}").alias("json"))
    with pytest.raises(Exception, match="stop"):
        bundles.write_bundles(bad, f"file://{tmp_path}/out", size=3)
    assert not list((tmp_path).rglob("part-*"))


def test_definitions_give_the_parameters_made_by_hand(spark):
    rows = [
        ("name", ["Patient"], "string", "Patient.name", None), ("phone", ["Patient"], "string", "Patient.telecom", None), ("identifier", ["Patient"], "token", "Patient.identifier", None), ("gender", ["Patient"], "token", "Patient.gender", None),
        ("active", ["Patient"], "token", "Patient.active", None), ("birthdate", ["Patient", "Person"], "date", "Person.birthDate | Patient.birthDate", None), ("general-practitioner", ["Patient"], "reference", "Patient.generalPractitioner", ["Location"]),
        ("balance", ["Patient"], "number", "Patient.balance", None), ("_id", ["Patient"], "token", "Patient.id", None),
        ("date", ["Encounter", "Observation"], "date", "Encounter.period | Observation.effective", None), ("priority", ["Encounter"], "token", "Encounter.priority", None), ("value-quantity", ["Observation"], "quantity", "(Observation.value as Quantity)", None),
    ]
    df = spark.createDataFrame([("SearchParameter", *r) for r in rows] + [("Patient", "x", ["Patient"], "token", "Patient.x", None)], definitions.SCHEMA)
    load = {"Patient": patients(spark, SF), "Encounter": encounters(spark, SF), "Observation": observations(spark, SF)}.__getitem__
    made = definitions.compiled(df, load, kinds=["Patient", "Encounter", "Observation"])
    for kind, names in (("Patient", None), ("Encounter", {"date", "priority"}), ("Observation", {"date"})):
        hand = [p for p in catalog.PARAMS[kind] if names is None or p.name in names]
        own = [p for p in made[kind] if names is None or p.name in names]
        assert {p.name: (p.kind, p.targets) for p in own} == {p.name: (p.kind, p.targets) for p in hand}
        a, b = S.index(load(kind), own), S.index(load(kind), hand)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert S.direct(load("Observation"), made["Observation"], S.search("value-quantity=gt30|urn:units|u").terms).count() == load("Observation").where("valueQuantity.value > 30").count()
    for bad in (("x", ["Patient"], "token", "Patient.noSuch", None), ("x", ["Patient"], "special", "Patient.id", None), ("x", ["Patient"], "token", "Other.id", None), ("x", ["Patient"], "token", None, None), ("x", ["Nothing"], "token", "Nothing.id", None)):
        one = spark.createDataFrame([("SearchParameter", *bad)], definitions.SCHEMA)
        assert definitions.compiled(one, load, strict=False) == {}
        with pytest.raises(definitions.DefinitionError):
            definitions.compiled(one, load)


def test_contents_are_stored_once(spark, tmp_path):
    store = BlobStore(spark, f"file://{tmp_path}/blobs", 4)
    df = lambda *rows: spark.createDataFrame(list(rows), "blob_id int, data binary")
    links = store.put(df((1, b"a"), (2, b"a"), (3, b"b"), (4, None), (5, b"")))
    assert links.columns == ["blob_id", "sha256"] and store.read().count() == 3
    before = {p.name for p in tmp_path.rglob("*.parquet")}
    store.put(df((6, b"a"), (7, b"")))
    assert {p.name for p in tmp_path.rglob("*.parquet")} - before == set() or store.read().count() == 3
    assert sorted((r.blob_id, r.data and bytes(r.data)) for r in store.get(links).select("blob_id", "data").collect() if r.blob_id != 4) == [(1, b"a"), (2, b"a"), (3, b"b"), (5, b"")]
    store.keep(links.where("blob_id in (2, 5)"))
    assert sorted(bytes(r.data) for r in store.read().collect()) == [b"", b"a"]
    store.put(df((9, b"b")))
    again = BlobStore(spark, f"file://{tmp_path}/blobs", 4)
    assert sorted(bytes(r.data) for r in again.read().collect()) == [b"", b"a", b"b"]


def test_bindings(spark):
    codes = spark.createDataFrame(
        [(1, "a", "required", "v", "s", "x"), (2, "a", "required", "v", "s", "no"), (3, "a", "extensible", "v", "s", "no"), (4, "a", "example", "v", "s", "no"), (5, "a", "required", "v", None, "x"), (6, "a", "required", "v", None, "no"), (7, "a", "required", "lost", "s", "x"), (8, "a", "required", "v", "s", None), (9, "a", "required", "v", "t", "x")],
        "key int, path string, strength string, value_set string, system string, code string",
    )
    sets = spark.createDataFrame([("v", "s", "x"), ("v", "s", "x")], "value_set string, system string, code string")
    got = {(r.key, r.severity, r.code) for r in validate.bound(codes, sets).collect()}
    bad = "code-not-in-value-set"
    assert got == {(2, "error", bad), (3, "warning", bad), (6, "error", bad), (7, "warning", "unknown-value-set"), (9, "error", bad)}


def test_rows_of_many_ranges_are_numbered_without_loss(spark, tmp_path):
    """Of the written rows, which have more columns than their counts need, so that adaptive plans cut the two in other ways."""
    from medloom.sources.sinks import numbered

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        rows = spark.range(200_000).select("id", *[F.sha2(F.concat(F.lit(n), F.col("id").cast("string")), 256).alias(n) for n in "abc"])
        numbered(rows, ["id"]).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 200_000 and got.where("row_num <> id").count() == 0
