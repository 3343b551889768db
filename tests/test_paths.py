import pytest
from pyspark.sql import functions as F

from medloom.functions.paths import Path, PathError, boolean

SCHEMA = "resourceType string, id string, active boolean, name array<struct<family:string,given:array<string>>>, telecom array<struct<system:string,value:string>>, valueQuantity struct<value:double,unit:string>, valueString string"


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        ("Patient", "jane", True, [("Doe", ["Jane", "J."]), ("Roe", None)], [("phone", "1"), ("email", "e"), ("phone", "2")], (72.0, "beats"), None),
        ("Patient", "john", False, None, None, None, "text"),
        ("Patient", "none", None, [], [("email", None)], (None, None), None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_navigation_flattens_and_drops_nulls(people):
    p = Path.of(people)
    assert values(people, p["name"]["given"].array()) == [["Jane", "J."], [], []]
    assert values(people, p.at("Patient.name.family").array()) == [["Doe", "Roe"], [], []]
    assert values(people, p.at("name.family.first()").col) == ["Doe", None, None]


def test_where_exists_count(people):
    p = Path.of(people)
    phones = p["telecom"].where(lambda t: t["system"] == "phone")
    assert values(people, phones.count().col) == [2, 0, 0]
    assert values(people, phones["value"].first().col) == ["1", None, None]
    assert values(people, p.at("telecom.value.exists()").col) == [True, False, False]


def test_choice_types(people):
    p = Path.of(people)
    assert values(people, p["value"].ofType("Quantity")["value"].col) == [72.0, None, None]
    assert values(people, p.at("value.ofType(string)").col) == [None, "text", None]


def test_comparison_of_collections(people):
    p = Path.of(people)
    assert values(people, p["telecom"]["system"] == "phone") == [False, None, False]
    assert values(people, boolean(p["active"])) == [True, False, False]


def test_union_is_ordered_and_distinct(people):
    p = Path.of(people)
    assert values(people, p["name"]["family"].union(p["telecom"]["system"]).col)[0] == ["Doe", "Roe", "phone", "email"]


def test_strict_errors(people):
    p = Path.of(people)
    with pytest.raises(Exception, match="more than one value"):
        people.select(p["name"]["family"].single(strict=True)).collect()
    with pytest.raises(Exception, match="empty"):
        people.select(boolean(p["active"], strict=True)).collect()


@pytest.mark.parametrize("path", ["name.nope", "name.resolve()", "id.memberOf()", "id.nofunction()", "x" * 5000])
def test_refused_paths(people, path):
    with pytest.raises(PathError):
        Path.of(people).at(path)


def test_custom_functions(people):
    Path.register("shout", lambda p: Path(F.upper(p.first().col), p.item, "shout"))
    assert values(people, Path.of(people).at("name.family.shout()").col) == ["DOE", None, None]
    with pytest.raises(PathError):
        Path.register("first", lambda p: p)
