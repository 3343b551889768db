import pytest
from pyspark.sql import functions as F

from medloom.operators import blobs, conflict, history, policy, subscriptions, sync, terminology, views
from medloom.sources import resources as R
from medloom.sources import sinks


def test_csv_contract(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], 72.5, True, None)], "s string, arr array<string>, d double, b boolean, n string")
    sinks.write_csv(df.coalesce(1), f"file://{tmp_path}/one")
    assert next((tmp_path / "one").glob("part-*")).read_text().splitlines() == ["s,arr,d,b,n", 'a,"[""x"",""y""]",72.5,true,']
    sinks.write_csv(df.where("s = 'b'").coalesce(1), f"file://{tmp_path}/none")
    assert next((tmp_path / "none").glob("part-*")).read_text().splitlines() == ["s,arr,d,b,n"]


def test_refresh_replaces_rows_and_metadata(spark, tmp_path):
    path = f"file://{tmp_path}/report"
    df = spark.range(10).selectExpr("id", "10 - id AS x")
    assert sinks.refresh(df, path, "v", "1", ["x"])["row_count"] == 10
    assert sinks.refresh(df.where("id < 3"), path, "v", "1", ["x"])["row_count"] == 3
    assert [(r.id, r.row_num) for r in sinks.read_report(spark, path, "v", "1").collect()] == [(2, 0), (1, 1), (0, 2)]


def test_views_refuse_bad_definitions(spark):
    with pytest.raises(views.ViewError):
        views.compiled(views.View("x", "Patient", {}), spark.range(1))
    with pytest.raises(views.ViewError):
        views.BUILT_IN.resolve("nope")
    with pytest.raises(PermissionError):
        views.BUILT_IN.resolve("patient_summary_view", permissions=set())
    with pytest.raises(views.ViewError):
        views.Views(views.PATIENT_SUMMARY, views.PATIENT_SUMMARY)


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b": 1, "a": {"d": [2, 1], "c": 2.50}}',), ("no json",)], "json string")
    assert [r[0] for r in df.select(R.canonical("json")).collect()] == ['{"a":{"c":2.5,"d":[2,1]},"b":1}', None]


def test_conflict_classes(spark):
    docs = lambda *rows: spark.createDataFrame(list(enumerate(rows)), "id long, json string")
    base = docs('{"a":1,"n":["x","y"],"t":"1"}', '{"birthDate":"1"}', '{"o":{"p":1,"q":1}}')
    local = docs('{"a":2,"n":["x"],"t":{"k":1}}', '{"birthDate":"2"}', '{"o":{"p":2,"q":1}}')
    remote = docs('{"a":1,"n":["x","y"],"t":"1"}', '{"birthDate":"1"}', '{"o":{"p":1,"q":2}}')
    assert {(r.id, r.path, r.change) for r in conflict.changes(base, local).collect()} == {(0, "a", "scalar_replace"), (0, "n", "array_remove"), (0, "t", "unsupported"), (0, "t.k", "scalar_replace"), (1, "birthDate", "scalar_replace"), (2, "o.p", "scalar_replace")}
    decided = {r.id: (r.decision, r.risk) for r in conflict.classified(base, local, remote).collect()}
    assert decided[0][0] == "review" and decided[1] == ("review", "identity") and decided[2] == ("auto_merge", None)


def test_cursor_stops_before_the_first_open_event(spark):
    acks = spark.createDataFrame([(1, 1, "accepted"), (1, 2, "rejected"), (1, 3, "needs_retry"), (1, 4, "accepted"), (2, 9, "accepted"), (3, 5, "needs_retry")], "node int, sequence long, ack string")
    assert {(r.node, r.cursor) for r in sync.cursor(acks).collect()} == {(1, 2), (2, 9)}


def test_backoff_is_capped(spark):
    df = spark.range(1, 9)
    assert [r[0] for r in df.select(subscriptions.backoff(F.col("id"))).collect()] == [1, 2, 4, 8, 16, 32, 60, 60]


def test_transaction_is_refused_as_a_whole(spark):
    e = "bundle_id int, entry array<struct<method:string,url:string,resource:string>>"
    df = spark.createDataFrame([(1, [("POST", "Patient", "{}"), ("PUT", "Patient/1", "{}"), ("DELETE", "Patient/2", None)]), (2, [("POST", "Patient", "{}"), ("PUT", "Patient?name=x", "{}")])], e)
    assert [(r.bundle_id, r.status) for r in history.transaction(df).orderBy("bundle_id", "position").collect()] == [(1, "201"), (1, "200"), (1, "204"), (2, "400"), (2, "400")]


def test_expansion_limit(spark):
    with pytest.raises(terminology.TooCostly):
        terminology.page(spark.range(50).selectExpr("'s' AS system", "cast(id as string) AS code"), 0, 10, limit=20)


def test_blob_roundtrip_of_odd_sizes(spark):
    df = spark.createDataFrame([(0, b""), (1, b"a" * 10), (2, b"abc" * 7)], "blob_id int, data binary")
    out = {r.blob_id: (bytes(r.data), r.chunks) for r in blobs.assembled(blobs.chunked(df, 10)).collect()}
    assert out == {0: (b"", 1), 1: (b"a" * 10, 1), 2: (b"abc" * 7, 3)}


def test_policy_default_and_wildcard(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")], "role string, action string")
    rules = [{"name": "r", "effect": "allow", "match": {"role": "b", "action": "*"}}]
    assert [tuple(r)[2:] for r in policy.decided(df, rules).collect()] == [("deny", None), ("allow", "r")]


def test_value_sets_nested_deeper_than_any_limit(spark):
    rows = [(f"v{i}", None, None, f"v{i + 1}") for i in range(35)] + [("v35", "s", "deep", None)]
    sets = spark.createDataFrame(rows, "url string, system string, code string, includes string")
    assert [r.code for r in terminology.members(sets, "v0").collect()] == ["deep"]


def test_closure_and_members_are_whole_however_deep(spark):
    from medloom.operators import terminology as T

    chain = spark.range(1, 12).selectExpr("cast(id as string) as code", "cast(id - 1 as string) as parent_code")
    got = T.closure(chain)
    assert got.count() == 11 * 12 // 2 and got.agg({"distance": "max"}).first()[0] == 11
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "code string, parent_code string")
    assert T.closure(ring).count() == 9
    nested = spark.range(8).selectExpr("cast(id as string) as url", "'s' as system", "cast(id as string) as code", "cast(id + 1 as string) as includes")
    assert T.members(nested, "0").count() == 8


def test_fields_of_what_is_no_object(spark):
    from pyspark.sql import functions as F

    from medloom.operators import fields

    df = spark.createDataFrame([("[1]",), ("{bad",), (None,), ("{}",), ('{"a":[1]}',)], "json string")
    out = [tuple(r) for r in df.select(fields.with_fields("json", {"a.b": F.lit("1")}), fields.allowed("json", ["a"]), fields.merged_update("json", F.lit("no json"))).collect()]
    assert out == [(None,) * 3] * 3 + [('{"a":{"b":1}}', "{}", "{}"), ('{"a":{"b":1}}', '{"a":[1]}', '{"a":[1]}')]


def test_rings_of_calculated_items_do_not_settle(spark):
    from pyspark.sql import functions as F

    from medloom.operators import forms

    df = spark.createDataFrame([(1, 0, 0)], "id int, a int, b int")
    out = forms.calculated(df, {"a": F.col("b") + 1, "b": F.col("a") + 1}).first()
    assert not out.settled and forms.calculated(df, {"a": F.lit(5), "b": F.col("a") * 2}).first().settled


def test_no_local_folder_on_a_cluster():
    from medloom.sources import steps

    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    import pytest

    with pytest.raises(ValueError):
        steps.work_dir(Session())


def test_the_whole_log_is_applied(spark):
    """The batch on top is the whole log, so that an event of the first halves counts where it is a resource's last."""
    from medloom import catalog
    from medloom.plans import log_queries as L

    sf = "/root/testdata/sf0.01"
    state = history.current(L.event_log(spark, sf)).select("id", "sequence", "json")
    got = catalog.QUERIES["write_apply_changes"](spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, state.collect()))


def test_answers_are_not_dealt_by_link_id(spark):
    """A form's few link ids would be as many tasks: neither checks nor extraction exchange answers by them."""
    from medloom.operators import forms
    from medloom.plans.work import rows

    answers = rows(spark, [(1, "a", "1"), (1, "a", "2"), (2, "b", None), (2, "z", "1")], "response_id bigint, link_id string, answer string")
    items = rows(spark, [("a", "string", True, False), ("b", "string", False, True)], "link_id string, type string, required boolean, repeats boolean")
    found = forms.checked(answers, items, rows(spark, [("a", "1")], "link_id string, option string"))
    assert sorted(map(tuple, found.collect())) == [(1, "a", "option"), (1, "a", "repeats"), (2, "a", "required"), (2, "z", "unknown-item")]
    made = forms.extracted(answers, spark.createDataFrame([("a", "T", "f")], "link_id string, resource_type string, field string"))
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (found, made)]
    assert not any("hashpartitioning(link_id" in p for p in plans)


def test_bundles_are_made_where_answers_were_dealt_by_response(spark):
    """Answers move once, nothing is sorted or collected before, and parts stay as many as they were made; results are those of a plain assembly."""
    import json
    import random

    from medloom.operators import forms
    from medloom.plans.work import rows

    links = [("a", "B", "x.y"), ("b", "B", "x"), ("c", "A", "n"), ("d", "A", "n"), ("d", "C", "deep.er.q"), ("d", "C", "deep.er.q"), ("e", "C", "deep.z"), ("never", "D", "w")]
    rng = random.Random(7)
    said = [(i, rng.choice("abcdez"), rng.choice(["10", "9", 'q"\\', "\u00e9", "", None])) for i in (*range(200), None) for _ in range(rng.randint(1, 6))]
    answers = rows(spark, said, "response_id bigint, link_id string, answer string").withColumn("field", F.lit("its own")).repartition(3)
    made = forms.assembled(answers, rows(spark, links, "link_id string, resource_type string, path string"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, link, answer in said:
        for _, kind, path in (x for x in links if x[0] == link and answer is not None):
            given = want.setdefault(i, {}).setdefault(kind, {})
            given[path] = min(given.get(path, answer), answer, key=lambda t: t.encode())
    for i, kinds in want.items():
        entries = []
        for kind in sorted(kinds):
            resource = {"resourceType": kind}
            for path in sorted(kinds[kind]):
                *way, last = path.split(".")
                at = resource
                for name in way:
                    at[name] = at = at[name] if isinstance(at.get(name), dict) else {}
                at[last] = kinds[kind][path]
            entries.append({"request": {"method": "POST", "url": kind}, "resource": resource})
        want[i] = json.dumps({"entry": entries, "resourceType": "Bundle", "type": "transaction"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    got = made.collect()
    assert len(got) == len(want) and {r.response_id: r.bundle for r in got} == want
    assert plan.count("Exchange hashpartitioning") == 1
    before = plan.split("Exchange hashpartitioning")[1]
    assert "Aggregate" not in before and "Sort [" not in before
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_scopes_of_a_context_are_compared_in_a_row(spark):
    """No join of all scopes with each other; what has no principal stays, and of equal scopes one."""
    rows = [("p", "user", "*", ["read"]), ("p", "user", "A", ["read"]), ("p", "user", "A", ["read", "read"]), ("p", "user", "B", ["write", "read"]), ("q", "user", "A", ["read"]), (None, "user", "*", ["read"]), (None, "user", "A", ["read"])]
    out = policy.collapsed(spark.createDataFrame(rows, "principal string, context string, resource string, actions array<string>"))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((str(r.principal), r.resource, *r.actions) for r in out.collect()) == [("None", "*", "read"), ("None", "A", "read"), ("p", "*", "read"), ("p", "B", "read", "write"), ("q", "A", "read")]


def test_distinct_ids_are_dealt_before_they_are_counted(spark):
    from medloom import catalog

    plan = catalog.QUERIES["index_distinct_ids"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and not any("hashpartitioning(kind" in x and " id" in x for x in plan.splitlines())
