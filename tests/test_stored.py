"""Stored index and postings: after batches they equal a rebuild, other parts keep their files, and searches need no exchange."""

import pytest
from pyspark.sql import functions as F

from medloom.operators import search as S
from medloom.plans import catalog
from medloom.sources.stored import StoredIndex, StoredPostings
from medloom.sources.tables import patients, table

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return S.typed(S.index(df, catalog.PARAMS["Patient"]))


def files(path):
    return {p.parent.name: sorted(f.name for f in p.parent.glob("*.parquet")) for p in path.rglob("*.parquet")}


def same(a, b):
    columns = sorted(a.columns)
    return a.select(*columns).exceptAll(b.select(*columns)).isEmpty() and b.select(*columns).exceptAll(a.select(*columns)).isEmpty()


def test_index_after_batches_equals_a_rebuild(spark, tmp_path):
    p = patients(spark, SF)
    stored = StoredIndex(spark, f"file://{tmp_path}/index", 16)
    stored.rebuild(rows_of(p))
    assert same(stored.read(), rows_of(p))
    before = files(tmp_path)
    one = p.where("id = '7'").withColumn("gender", F.lit("other"))
    stored.apply(rows_of(one), one.select(F.lit("Patient").alias("resource_type"), "id"))
    now = p.where("id <> '7'").unionByName(one)
    assert same(stored.read(), rows_of(now))
    after = files(tmp_path)
    assert sum(before[k] != after[k] for k in before) == 1, "only the part of the changed id was written"
    all_ = p.select(F.lit("Patient").alias("resource_type"), "id")
    stored.apply(rows_of(p.limit(0)), all_)
    assert stored.read().isEmpty()
    stored.apply(rows_of(one), all_.where("id = '7'"))
    assert same(stored.read(), rows_of(one)), "parts that were empty are filled again"
    again = StoredIndex(spark, f"file://{tmp_path}/index", 16)
    assert same(again.read(), rows_of(one)), "another session finds what is there"
    again.drop()


def test_searches_over_the_index_have_no_exchange(spark, tmp_path):
    p = patients(spark, SF)
    stored = StoredIndex(spark, f"file://{tmp_path}/index", 8)
    stored.rebuild(rows_of(p))
    mine = stored.read().where("resource_type = 'Patient'")
    out = S.ids(mine, catalog.PARAMS["Patient"], S.search("gender=female&active=true&birthdate=gt1950-02").terms)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters" in plan
    want = S.direct(p, catalog.PARAMS["Patient"], S.search("gender=female&active=true&birthdate=gt1950-02").terms).select("id")
    assert same(out, want)
    both = mine.where("field = 'gender'").alias("a").join(mine.where("field = 'name'").alias("b"), F.col("a.id") == F.col("b.id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in both.select("a.id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reindex_of_a_parameter_and_purge(spark, tmp_path):
    p = patients(spark, SF)
    stored = StoredIndex(spark, f"file://{tmp_path}/index", 8)
    stored.rebuild(rows_of(p))
    other = p.withColumn("gender", F.lit("unknown"))
    gender = [x for x in catalog.PARAMS["Patient"] if x.name == "gender"]
    stored.reindex("Patient", "gender", S.typed(S.index(other, gender)))
    assert same(stored.read(), rows_of(other))
    stored.reindex("Patient", "gender", S.typed(S.index(other.limit(0), gender)))
    assert same(stored.read(), rows_of(other).where("field <> 'gender'"))
    live = other.where("cast(id as int) % 3 = 0")
    stored.purge(live.select(F.lit("Patient").alias("resource_type"), "id"))
    assert same(stored.read(), rows_of(live).where("field <> 'gender'"))


def test_postings_after_batches_and_what_a_search_reads(spark, tmp_path):
    docs = table(spark, SF, "documents").select(F.lit("D").alias("resource_type"), F.col("doc_id").cast("string").alias("id"), "text")
    stored = StoredPostings(spark, f"file://{tmp_path}/postings", 16)
    stored.rebuild(S.postings(docs))
    changed = F.col("id").cast("int") % 9 == 0
    new = docs.where(changed).withColumn("text", F.when(F.col("id") == "9", F.lit("the")).otherwise(F.concat(F.lit("zebra zebra "), "text")))
    before = files(tmp_path)
    stored.apply(S.postings(docs.where(changed)), S.postings(new))
    assert same(stored.read(), S.postings(docs.where(~changed).unionByName(new)))
    assert S.stored_text(stored, "D", "zebra THE").count() == new.count() - 1 and before.keys() == files(tmp_path).keys()
    rows = stored.of("D", ["zebra"])
    scan = [line for line in rows._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line][0]
    assert "part" in scan and rows.inputFiles() and {f.rsplit("/", 2)[1] for f in rows.inputFiles()} == {f"part={rows.sparkSession.range(1).select(F.pmod(F.hash(F.lit('zebra')), F.lit(16))).first()[0]}"}
    with pytest.raises(S.SearchError):
        S.stored_text(stored, "D", "the of")


def test_a_batch_of_postings_leaves_what_is_stored(spark, tmp_path):
    docs = spark.createDataFrame([("D", str(i), f"one two{i % 3} two{i % 3}") for i in range(30)], "resource_type string, id string, text string")
    stored, now = StoredPostings(spark, f"file://{tmp_path}/postings", 4), docs
    stored.MOST = 3
    stored.rebuild(S.postings(docs))
    for n in range(5):
        held = {str(p) for p in tmp_path.rglob("*.parquet")}
        changed = F.col("id").isin(str(n), str(n + 1))
        new = now.where(changed & (F.col("id") != "3")).withColumn("text", F.lit(f"two{n} new{n}"))
        stored.apply(S.postings(now.where(changed)), S.postings(new))
        now = spark.createDataFrame(now.where(~changed).unionByName(new).collect(), docs.schema)
        assert same(stored.read(), S.postings(now))
        assert {r.id for r in stored.of("D", ["two1"]).collect()} == {r.id for r in now.where("text like '%two1%'").collect()}
        if n < 2:
            assert held <= {str(p) for p in tmp_path.rglob("*.parquet")}, "files of earlier batches stay"


def test_terms_are_counted_without_an_exchange(spark):
    docs = spark.createDataFrame([("D", "1", "b c B, the b"), ("D", "2", "x"), ("D", "3", "the"), ("D", "4", None)], "resource_type string, id string, text string")
    out = S.postings(docs)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.term, r.tf, r.words) for r in out.collect()} == {("1", "", 0, 4), ("1", "b", 3, 4), ("1", "c", 1, 4), ("2", "", 0, 1), ("2", "x", 1, 1)}


def test_a_batch_is_not_written_twice(spark, tmp_path):
    import medloom.sources.stored as module

    stored, p, steps = StoredIndex(spark, f"file://{tmp_path}/index", 4), patients(spark, SF), []
    stored.rebuild(rows_of(p))
    real, module.stepped = module.stepped, lambda df, tag: steps.append(tag) or real(df, tag)
    try:
        stored.apply(rows_of(p.where("id = '7'")), p.where("id in ('7', '9')").select(F.lit("Patient").alias("resource_type"), "id"))
    finally:
        module.stepped = real
    assert "merged" not in steps and same(stored.read(), rows_of(p.where("id <> '9'")))


def test_resources_are_dealt_before_their_values_are_found(spark):
    from medloom.plans.stored_queries import _dealt

    lines = rows_of(_dealt(spark, SF, "Patient"))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    place = lambda name: next(i for i, line in enumerate(lines) if name in line)
    assert place("Generate") < place("RepartitionByExpression")
