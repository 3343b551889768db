"""Streams with state in a store, JSON by trees of paths, leaves of any depth, several writes of a key."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from medloom.operators import conflict, fields, history, validate
from medloom.streaming import events, state


def test_ranges_merge_as_gaps_fill():
    rng = random.Random(2)
    ranges, seen = [], set()
    for _ in range(200):
        batch = [rng.randrange(120) for _ in range(rng.randint(0, 6))]
        ranges, fresh = state.merged_ranges(ranges, batch)
        for s, new in zip(batch, fresh):
            assert new == (s not in seen)
            seen.add(s)
        assert ranges == sorted(ranges) and {x for a, b in ranges for x in range(a, b + 1)} == seen
        assert all(b + 1 < c for (_, b), (c, _) in zip(ranges, ranges[1:])), "ranges that touch are one"
    assert ranges == [(0, 119)]


def test_late_events_are_taken_once_across_runs(spark, tmp_path):
    folder, path = f"file://{tmp_path}/w", f"file://{tmp_path}/in"
    schema = "node string, sequence long"
    put = lambda *s: spark.createDataFrame([("n", i) for i in s], schema).write.mode("append").parquet(path)
    run = lambda: events.drained(state.seen_once(events.read(state.with_store(spark), path, schema)), folder, spark, name="late")
    put(*range(100, 60_000, 100), 70_000)
    run()
    put(5, 100, 69_999)  # 70,000 late and new; late and known; a gap filled
    put(5)
    found = run().where("sequence in (5, 100, 69999)").groupBy("sequence").agg(F.count_if("fresh").alias("fresh"), F.count("*").alias("n")).collect()
    assert {(r.sequence, r.fresh, r.n) for r in found} == {(5, 1, 2), (100, 1, 2), (69_999, 1, 1)}


def test_hub_forgets_no_event(spark, tmp_path):
    rows = [("first", 1, "x", "create", None, "v0")] + [(f"e{i}", i, "x", "update", f"v{i - 2}", f"v{i - 1}") for i in range(2, 400)]
    rows += [("late", 7, "x", "update", "v398", "z"), ("e5", 100_000, "x", "update", "v398", "z"), (None, 9, None, "update", None, None)]
    df = spark.createDataFrame(rows, "event_id string, sequence long, id string, action string, base_version string, version_id string")
    again = (F.col("event_id") == "late") | (F.col("sequence") == 100_000)
    for part in (df.where(~again), df.where(again), df.where("event_id is null")):
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    out = events.drained(state.pushes(events.read(state.with_store(spark), f"file://{tmp_path}/in", df.schema, files_per_batch=1)), f"file://{tmp_path}/w", spark)
    acks = {(r.event_id, r.sequence): r.ack for r in out.collect()}
    assert acks[("late", 7)] == "accepted" and acks[("e5", 100_000)] == "already_processed" and acks[(None, 9)] == "needs_retry"
    assert sum(a == "accepted" for a in acks.values()) == 400


def test_changed_fields_of_odd_content():
    assert state.changed_between(None, '{"A":1,"b":2}') == ["a", "b"]
    assert state.changed_between('{"a":1}', '{"a":1.0,"b":null}') == ["b"]
    assert state.changed_between('{"a":1}', "broken") == ["a"] and state.changed_between("[1]", None) == []


# fields


def set_one_by_one(text, values):
    try:
        root = json.loads(text) if text else None
    except ValueError:
        return None
    if not isinstance(root, dict):
        return None
    for path, value in values:
        if value is None:
            continue
        at, *names = root, *path.split(".")
        for name in names[:-1]:
            if not isinstance(at.get(name), dict):
                at[name] = {}
            at = at[name]
        at[names[-1]] = json.loads(value)
    return root


@pytest.mark.parametrize("seed", range(4))
def test_paths_are_set_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    paths = list(dict.fromkeys(".".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(9)))
    docs = ["{}", '{"a":{"b":{"c":1}},"b":[1,2],"d":"x"}', '{"a":5,"c":{"a":null}}', "[1]", "no json", None]
    rows = [(d, *[rng.choice([None, "1", '"s"', '{"a":7}', "null", "[1]"]) for _ in paths]) for d in docs for _ in range(4)]
    df = spark.createDataFrame(rows, "json string, " + ", ".join(f"v{i} string" for i in range(len(paths))))
    got = df.select("*", fields.with_fields("json", {p: F.col(f"v{i}") for i, p in enumerate(paths)}).alias("out")).collect()
    for r in got:
        want = set_one_by_one(r.json, [(p, r[f"v{i}"]) for i, p in enumerate(paths)])
        assert (json.loads(r.out) if r.out else None) == want, (r, paths)


def test_plan_is_linear_in_paths(spark):
    df = spark.createDataFrame([('{"g1":{"x":0}}',)], "json string")
    size = lambda n, depth: len(df.select(fields.with_fields("json", {".".join([f"g{i}", *["x"] * depth]): F.lit(str(i)) for i in range(n)}))._jdf.queryExecution().analyzed().toString())
    assert size(200, 1) < 5 * size(50, 1) and size(10, 12) < 4 * size(10, 4)
    out = df.select(fields.with_fields("json", {f"g{i}.a.b.c": F.lit(str(i)) for i in range(200)})).first()[0]
    assert json.loads(out)["g199"] == {"a": {"b": {"c": 199}}} and json.loads(out)["g1"]["x"] == 0


# conflicts


def deep(n, value):
    return {"k": deep(n - 1, value)} if n else value


def test_leaves_at_any_depth(spark):
    docs = lambda *rows: spark.createDataFrame([(i, None if r is None else json.dumps(r)) for i, r in enumerate(rows)], "id long, json string")
    base = docs(deep(7, {"gone": 1, "stay": 2}), deep(40, 1), {"a/b": 1, "c~d": {"x.y": 1}, "c": [1]}, {"o": {"p": 1}}, None)
    local = docs(deep(7, {"stay": 2}), deep(40, 2), {"a/b": 2, "c~d": {"x.y": 2}, "c": [1, 'q"']}, {"o": {}}, {"n": 1})
    decided = {r.id: r.decision for r in conflict.classified(base, local, base).collect()}
    assert decided == {0: "review", 1: "auto_merge", 2: "auto_merge", 3: "review", 4: "auto_merge"}
    found = {(r.id, r.path): r.change for r in conflict.changes(base, local).collect()}
    assert found[(0, ".".join("k" * 7) + ".gone")] == "unsupported" and found[(1, ".".join("k" * 40))] == "scalar_replace"
    patch = {r.id: r.patch for r in conflict.patches(base, local, base).collect()}
    assert json.loads(patch[2]) == [{"op": "replace", "path": "/a~1b", "value": 2}, {"op": "add", "path": "/c/-", "value": 'q"'}, {"op": "replace", "path": "/c~0d/x.y", "value": 2}]
    assert json.loads(patch[1])[0]["path"] == "/k" * 40 and patch[0] is None
    assert conflict.leaves(docs(None, "x", [1], {}, {"a": {}})).select("pointer", "value", "kind").collect() == [("/a", "{}", "object")]


def test_names_with_marks_do_not_overlap_with_others(spark):
    docs = lambda r: spark.createDataFrame([(1, json.dumps(r))], "id long, json string")
    base, mine, theirs = {"a.b": 1, "a": {"b": 1}}, {"a.b": 2, "a": {"b": 1}}, {"a.b": 1, "a": {"b": 2}}
    assert conflict.classified(docs(base), docs(mine), docs(theirs)).first().decision == "auto_merge"


# writes


def test_writes_of_one_key_are_judged_in_order(spark):
    log = spark.createDataFrame([(1, "P", "old", "create", "1"), (2, "P", "old", "update", "2"), (3, "P", "dead", "create", "1"), (4, "P", "dead", "delete", "2")], "sequence long, resource_type string, id string, action string, version_id string")
    ok, bad = '{"resourceType":"P","name":"n"}', '{"resourceType":"P"}'
    steps = [(1, "old", "update", ok), (2, "old", "update", ok), (3, "old", "delete", None), (4, "old", "delete", None), (5, "old", "create", bad), (6, "old", "update", ok), (7, "old", "create", ok), (8, "dead", "update", ok), (9, "dead", "create", ok), (10, None, "create", ok), (11, "new-10", "update", ok)]
    changes = spark.createDataFrame([(n, "P", i, a, j) for n, i, a, j in steps], "change_id long, resource_type string, id string, action string, json string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    out = history.prepared(log, changes, {"P": ["name"]})
    got = {r.change_id: (r.status, r.version_id, r.prev_version) for r in out.collect()}
    assert got == {
        1: (200, "3", "2"), 2: (200, "4", "3"), 3: (204, "5", "4"), 4: (404, None, None), 5: (422, None, None), 6: (404, None, None), 7: (201, "6", "5"),
        8: (404, None, None), 9: (201, "3", "2"), 10: (201, "1", None), 11: (200, "2", "1"),
    }
    added = history.written(out, {"P": [("name", "$.name")]}, 100)
    assert {(r.id, r.version_id) for r in added["resources"].collect()} == {("old", "6"), ("dead", "3"), ("new-10", "2")} and added["tombstones"].count() == 0
    assert added["history"].count() == added["events"].count() == 7 and added["index"].count() == 3


def test_errors_of_a_write_are_found_in_its_row(spark):
    log = spark.createDataFrame([(1, "P", "old", "create", "1")], "sequence long, resource_type string, id string, action string, version_id string")
    texts = ['{"resourceType":"P","name":"n"}', '{"resourceType":"P"}', '{"resourceType":"Q","id":"_"}', "{broken", None]
    changes = spark.createDataFrame([(n, "P", None, a, j) for n, (a, j) in enumerate([*(("create", t) for t in texts), ("delete", "{broken")])], "change_id long, resource_type string, id string, action string, json string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    out = history.prepared(log, changes, {"P": ["name"]})
    assert {r.change_id: r.errors for r in out.collect()} == {0: None, 1: "required", 2: "invalid-id,unknown-type", 3: "invalid-json", 4: "invalid-json", 5: None}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in plan.split("\n")) == 1, "the only join is that with the log"
    lines = plan.split("\n")
    dealt = next(i for i, line in enumerate(lines) if "RepartitionByExpression" in line)
    reads = [i for i, line in enumerate(lines) if "get_json_object" in line or "parseJson" in line or "parse_json" in line]
    assert reads and max(reads) < dealt, "JSON is read where the rows are dealt"


def test_references_with_escaped_quotes(spark):
    df = spark.createDataFrame([(1, json.dumps({"resourceType": "P", "a": {"reference": 'x"y'}}))], "key int, json string")
    assert [r.detail for r in validate.issues(df, {"P": []}).where("code = 'invalid-reference'").collect()] == ['x\\"y']


def test_missing_references(spark):
    rows = spark.createDataFrame([(1, "P/1"), (2, "P/2"), (3, None), (4, "Q/1")], "id int, ref string")
    live = spark.createDataFrame([("P", "1"), ("P", "1")], "resourceType string, id string")
    assert sorted(r.id for r in history.missing(rows, F.col("ref"), live).collect()) == [2, 4]


class Held:
    """A value in a store, with the calls that it gets."""

    def __init__(self):
        self.value, self.calls = None, []

    def get(self):
        self.calls.append("get")
        return self.value

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, at):
        self.calls.append(at)


def test_state_of_a_key_costs_few_calls():
    row = Row("sequence", "resource_type", "id", "action", "at", "json")
    p = state._Content()
    p.last = Held()
    out = list(p.handleInputRows(("P", "x"), iter([row(2, "P", "x", "update", 5, '{"a":2}'), row(3, "P", "x", "delete", 6, None), row(1, "P", "x", "create", 4, '{"a":1}')]), None))
    assert [(r.sequence, r.at, r.changed) for r in out] == [(1, 4, ["a"]), (2, 5, ["a"]), (3, 6, ["a"])] and p.last.value == ('{"a":2}',)
    list(p.handleInputRows(("P", "x"), iter([row(4, "P", "x", "update", 7, '{"a":2}')]), None))
    assert p.last.calls == ["get", "update", "get"], "what does not change is not written"
    d = state._Deliveries(lambda job, attempt: attempt < 2)
    d.tried = d.handle = Held()
    assert [tuple(r) for r in d.handleInputRows(("j",), iter([Row("at")(9), Row("at")(7)]), None)] == [("j", 1, 7, "retry")] and d.tried.value == (1, 7)
    assert not list(d.handleInputRows(("j",), iter([Row("at")(1)]), None)), "a job that comes again is known"
