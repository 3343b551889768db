import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from medloom.operators import search as S
from medloom.plans.catalog import PARAMS, resources

SF = "/root/testdata/sf0.001"


def test_parts_of_a_query_string():
    s = S.search("name:exact=Doe,Smith&subject.name=X&_sort=-date,id&_count=500&_offset=3&_include=A:b&_text=a&_elements=x,y")
    assert [(t.param, t.modifier, t.values, t.chain) for t in s.terms] == [("name", "exact", ["Doe", "Smith"], ""), ("subject", "", ["X"], "name")]
    assert (s.sort, s.count, s.offset, s.include, s.text, s.elements) == (["-date", "id"], S.MAX_COUNT, 3, ["A:b"], "a", ["x", "y"])


def test_marks_after_a_backslash_are_no_marks():
    assert S.search(r"name=a\,b,c").terms[0].values == ["a,b", "c"]
    assert S.split_at(r"x\$y$z\,", "$") == ["x$y", r"z\,"] and S.plain(r"z\,\|") == "z,|"
    assert S.search("_count=0").count == S.DEFAULT_COUNT
    t = S.search("subject:Patient.name:contains=7").terms[0]
    assert (t.param, t.type, t.chain, t.modifier, t.values) == ("subject", "Patient", "name", "contains", ["7"])
    assert S.search(S.Builder().any("name", "a,b", "c").count(5).query).terms[0].values == ["a,b", "c"]


@pytest.mark.parametrize("text", ["status-priority=finished", "status-priority=a$b$c", "status.x=1", "subject:Group.name=x", "_include=Patient:name", "_include=Encounter:status", "_sort=status-priority", "_sort=", "_revinclude=Nothing:subject", "_summary=count&_elements=id", "nope=1"])
def test_whole_searches_that_are_refused(spark, text):
    with pytest.raises(S.SearchError):
        S.run(text, "Encounter", PARAMS, lambda k: resources(spark, SF, k))


def test_a_whole_search(spark):
    load = lambda k: resources(spark, SF, k)
    out = S.run("subject.name:contains=7&status=finished&_sort=-date,_id&_count=7&_offset=3&_include=Encounter:subject&_elements=status", "Encounter", PARAMS, load)
    people = {r.id for r in load("Patient").collect() if "7" in r.name[0].text}
    want = sorted((r for r in load("Encounter").collect() if r.status == "finished" and r.subject.reference.split("/")[1] in people), key=lambda r: r.id)
    want.sort(key=lambda r: r.period.start, reverse=True)
    page = [r.id for r in out.page.orderBy("position").collect()]
    assert page == [r.id for r in want[3:10]] and out.total.first()[0] == len(want)
    assert {r.id for r in out.included.collect()} == {r.subject.reference.split("/")[1] for r in want[3:10]}
    assert set(out.resources.columns) == {"resourceType", "id", "status"} and out.bundle().count() == len(page) + out.included.count()
    assert out.links()["next"] == "Encounter?_count=7&_offset=10"
    assert S.run("_summary=count&status=finished", "Encounter", PARAMS, load).page.count() == 0


def test_times_with_an_offset_are_compared_in_utc(spark):
    from pyspark.sql import functions as F

    from medloom.functions import normalize as N

    df = spark.createDataFrame([("2024-01-01T00:30:00+05:00",), ("2023-12-31T19:30:00Z",), ("2023-12-31T14:00:00-05:30",), ("2023-12-31",), ("2023",), ("nonsense",)], "v string")
    got = [(str(r[0]), str(r[1]), r[2]) for r in df.select(N.low(F.col("v")), N.high(F.col("v")), N.utc(F.col("v"))).collect()]
    assert got[0] == ("2023-12-31 19:30:00", "2023-12-31 19:30:01", "2023-12-31T19:30:00Z") and got[1][0] == got[0][0] and got[2][0] == got[0][0]
    assert got[3] == ("2023-12-31 00:00:00", "2024-01-01 00:00:00", "2023-12-31") and got[4][1] == "2024-01-01 00:00:00" and got[5] == ("None", "None", "nonsense")


def test_dates_of_choices_and_periods(spark):
    from medloom.functions import normalize as N
    from medloom.functions.paths import Path

    df = spark.createDataFrame([("2024-05", None), (None, ("2023-01-01T01:00:00+02:00", "x"))], "effectiveDateTime string, effectivePeriod struct<start:string,end:string>")
    assert [list(r[0]) for r in df.select(N.dates(Path.of(df)["effective"])).collect()] == [["2024-05"], ["2023-01-01T01:00:00+02:00"]]
    assert [list(r[0]) for r in df.select(N.date_variants(Path.of(df)["effective"])).collect()] == [["2024-05"], ["2022-12-31T23:00:00Z", "2022-12-31"]]


@pytest.mark.parametrize("text", ["name:missing=true", "_has:x=1", "_filter=x", "_list=1", "_include=*", "a.b.c=1", "_count=x"])
def test_refused_searches(text):
    with pytest.raises(S.SearchError):
        S.search(text)


@pytest.mark.parametrize("text", ["gender:contains=x", "nope=1", "name:not=x"])
def test_refused_terms(spark, text):
    df = resources(spark, SF, "Patient")
    with pytest.raises(S.SearchError):
        S.ids(S.index(df, PARAMS["Patient"]), PARAMS["Patient"], S.search(text).terms)


TERMS = st.sampled_from(["gender=female", "gender:not=female", "active=true", "active:not=true", "name:contains=7", "name:contains=1,2", "birthdate=ge1960", "birthdate=lt1955-06", "birthdate=ne1951", "balance=gt5000", "balance=le100.5", "phone=555-1-10,555-2-20", "identifier=urn:cust|5,urn:cust|6"])


@given(st.lists(TERMS, min_size=1, max_size=4))
@settings(max_examples=12, deadline=None)
def test_direct_mode_and_index_mode_agree(spark, terms):
    found = S.search("&".join(terms)).terms
    df = resources(spark, SF, "Patient")
    direct = {r.id for r in S.direct(df, PARAMS["Patient"], found).select("id").collect()}
    indexed = {r.id for r in S.ids(S.index(df, PARAMS["Patient"]), PARAMS["Patient"], found).collect()}
    assert direct == indexed


def test_prefixes_belong_to_dates_and_numbers_only():
    assert S.prefix("date", "gt2020") == ("gt", "2020")
    assert S.prefix("token", "completed") == ("eq", "completed")
    assert S.prefix("string", "nelson") == ("eq", "nelson")


def test_links():
    s = S.search("_count=10&_offset=10")
    assert S.links("Patient", s, 25) == {"self": "Patient?_count=10&_offset=10", "next": "Patient?_count=10&_offset=20"}
    assert "next" not in S.links("Patient", s, 20)
