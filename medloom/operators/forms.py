"""Questionnaires and their responses as rows of items: enabling, validation, extraction, calculation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.steps import stepped
from .fields import with_fields

TYPES = {"decimal": "double", "integer": "bigint", "boolean": "boolean", "date": "date"}


#: A form has at most so many items or rules; they are read to the driver and become a literal.
MAX_ITEMS = 10_000


def with_each(rows: DataFrame, form: DataFrame, columns: list[str]) -> DataFrame:
    """Every row with every item of a form, without a join: the form is of bounded size."""
    items = form.select(*columns).limit(MAX_ITEMS + 1).collect()
    if len(items) > MAX_ITEMS:
        raise ValueError(f"a form of more than {MAX_ITEMS} items")
    if not items:
        return rows.where(F.lit(False)).select("*", *[F.lit(None).cast(form.schema[c].dataType).alias(c) for c in columns])
    each = F.array(*[F.struct(*[F.lit(i[c]).cast(form.schema[c].dataType).alias(c) for c in columns]) for i in items])
    return rows.select("*", F.explode(each).alias("_item")).select(*rows.columns, "_item.*")


def same(a: str | Column, b: str | Column) -> Column:
    """Equal values, whatever their case."""
    text = lambda c: F.lower((F.col(c) if isinstance(c, str) else c).cast("string"))
    return text(a) == text(b)


def enabled(items: DataFrame, answers: DataFrame, rules: DataFrame) -> DataFrame:
    """response_id, link_id, enabled for every item of every response.

    rules: link_id, question, operator, answer, behavior (all or any). Items without rules are enabled; an
    unanswered question meets only ``exists false``.
    """
    responses = answers.select("response_id").distinct()
    asked = answers.select("response_id", F.col("link_id").alias("question"), F.col("answer").alias("given"))
    each = with_each(responses, rules, ["link_id", "question", "operator", "answer", "behavior"])
    rows = each.join(asked, ["response_id", "question"], "left")
    number = lambda c: F.col(c).try_cast("double")
    less, more = number("given") < number("answer"), number("given") > number("answer")
    equal = same("given", "answer")
    op = F.col("operator")
    test = (
        F.when(op == "exists", F.col("given").isNotNull() == (F.lower("answer") == "true")).when(op == "=", equal).when(op == "!=", ~equal)
        .when(op == "<", less).when(op == ">", more).when(op == "<=", less | equal).when(op == ">=", more | equal)
    )
    met = rows.withColumn("met", F.coalesce(test, F.lit(False))).groupBy("response_id", "link_id", "behavior").agg(F.min("met").alias("every"), F.max("met").alias("some"))
    met = met.select("response_id", "link_id", F.when(F.col("behavior") == "any", F.col("some")).otherwise(F.col("every")).alias("met"))
    grid = with_each(responses, items, ["link_id"])
    return grid.join(met, ["response_id", "link_id"], "left").select("response_id", "link_id", F.coalesce("met", F.lit(True)).alias("enabled"))


def checked(answers: DataFrame, items: DataFrame, options: DataFrame | None = None, value_sets: DataFrame | None = None) -> DataFrame:
    """response_id, link_id, issue: unknown items, answers of another type, repeats, options, value sets, answers to read-only items, required items left out.

    items: link_id, type, required, repeats, and read_only and value_set (a url) where there are such; value_sets: url, code.
    """
    rows = answers.join(F.broadcast(items), "link_id", "left")  # a form is of bounded size, and its few link ids would be as many tasks
    kind = F.col("type")
    wrong = F.lit(False)
    for t, spark_type in TYPES.items():
        wrong = wrong | ((kind == t) & F.col("answer").isNotNull() & F.col("answer").try_cast(spark_type).isNull())
    issue = lambda df, name: df.select("response_id", "link_id", F.lit(name).alias("issue"))
    out = issue(rows.where(kind.isNull()), "unknown-item").unionByName(issue(rows.where(wrong), "type"))
    # of each response the link ids answered, and those of them that may be answered once: as many as a response has
    said = lambda test: F.collect_list(F.when(F.col("answer").isNotNull() & test, F.col("link_id")))
    given = rows.groupBy("response_id").agg(said(F.lit(True)).alias("_given"), said(~F.col("repeats")).alias("_once"))
    several = given.select("response_id", F.explode(F.filter(F.array_distinct("_once"), lambda x: F.size(F.filter("_once", lambda y: y == x)) > 1)).alias("link_id"))
    out = out.unionByName(issue(several, "repeats"))
    all_ = with_each(given, items.where("required"), ["link_id"])
    out = out.unionByName(issue(all_.where(~F.array_contains("_given", F.col("link_id"))), "required"))
    if "read_only" in items.columns:
        out = out.unionByName(issue(rows.where(F.col("read_only") & F.col("answer").isNotNull()), "read-only"))
    if value_sets is not None:
        bound = rows.where(F.col("value_set").isNotNull() & F.col("answer").isNotNull())
        out = out.unionByName(issue(bound.join(value_sets.select(F.col("url").alias("value_set"), F.col("code").alias("answer")), ["value_set", "answer"], "left_anti"), "value-set"))
    if options is not None:
        closed = answers.join(F.broadcast(options.select("link_id").distinct()), "link_id", "left_semi")
        out = out.unionByName(issue(closed.join(options.select("link_id", F.col("option").alias("answer")), ["link_id", "answer"], "left_anti"), "option"))
    return out


def extracted(answers: DataFrame, mapping: DataFrame) -> DataFrame:
    """response_id, resource_type, json: the answers as resources, by the fields that link ids map to."""
    rows = answers.where("answer is not null").join(F.broadcast(mapping), "link_id")
    fields = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "answer"))))
    return rows.groupBy("response_id", "resource_type").agg(F.to_json(F.map_concat(F.create_map(F.lit("resourceType"), F.first("resource_type")), fields)).alias("json"))


def populated(items: DataFrame, subject: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Initial answers: a column of the subject for each link id; empty values give none."""
    pairs = F.array(*[F.struct(F.lit(k).alias("link_id"), v.cast("string").alias("answer")) for k, v in values.items()])
    rows = subject.select("id", F.explode(pairs).alias("p")).select("id", "p.*").where("answer is not null")
    return rows.join(items.select("link_id"), "link_id", "left_semi")


def expanded(items: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, issues) of forms with their sub-forms in place, however nested.

    items: form, position, link_id, sub_form (null for an item of its own), and what else an item has; roots: form. An item that names a sub-form is
    replaced by that form's items, whose link ids get its own before them (``a/b``). Of the result ``place`` is the order: positions from the root down.
    Issues (form, link_id, issue): not-found (the item stays), cycle (a sub-form within itself: the item goes), duplicate (of a link id).
    One join a level, over what is still open.
    """
    rest = [c for c in items.columns if c not in ("form", "position", "link_id", "sub_form")]
    known = stepped(items.select("form", "position", "link_id", "sub_form", *rest), "items")
    forms = known.select(F.col("form").alias("_sub")).distinct()
    top = known.join(roots.select("form").distinct(), "form", "left_semi")
    level = top.select("form", F.array("position").alias("place"), "link_id", "sub_form", F.array("form").alias("_via"), *rest)
    done, issues = None, None
    plus = lambda a, b: b if a is None else a.unionByName(b)
    while True:
        level = stepped(level.join(forms, F.col("sub_form") == F.col("_sub"), "left"), "level")
        lost = F.col("sub_form").isNotNull() & F.col("_sub").isNull()
        ring = F.coalesce(F.array_contains("_via", F.col("sub_form")), F.lit(False)) & F.col("_sub").isNotNull()
        done = plus(done, level.where(F.col("sub_form").isNull() | lost).select("form", "place", "link_id", *rest))
        for test, name in ((lost, "not-found"), (ring, "cycle")):
            issues = plus(issues, level.where(test).select("form", "link_id", F.lit(name).alias("issue")))
        open_ = level.where(F.col("_sub").isNotNull() & ~ring).select("form", "place", F.col("link_id").alias("_above"), "_sub", "_via")
        if open_.isEmpty():
            break
        inner = known.select(F.col("form").alias("_sub"), "position", "link_id", "sub_form", *rest)
        level = open_.join(inner, "_sub").select("form", F.array_append("place", F.col("position")).alias("place"), F.concat_ws("/", "_above", "link_id").alias("link_id"), "sub_form", F.array_append("_via", F.col("_sub")).alias("_via"), *rest)
    several = done.groupBy("form", "link_id").agg(F.count("*").alias("n")).where("n > 1").select("form", "link_id", F.lit("duplicate").alias("issue"))
    return done, issues.unionByName(several)


def assembled(answers: DataFrame, mapping: DataFrame) -> DataFrame:
    """response_id, bundle: a transaction Bundle of the resources that the answers make, by the dotted paths that link ids map to.

    mapping: link_id, resource_type, path (of at most MAX_ITEMS rows). Each resource is posted; resources come by type, fields by path, so the
    bundle is the same each time. Of several answers to an item the least by text counts.

    A path goes by its number, those of a type in a row. Answers are dealt by response once, before anything is held, and texts are made last.
    The number of parts is fixed: adaptive execution would make them as few as there are cores, and a part is what a task holds.
    """
    fields = mapping.select("link_id", "resource_type", "path").limit(MAX_ITEMS + 1).collect()
    if len(fields) > MAX_ITEMS:
        raise ValueError(f"a mapping of more than {MAX_ITEMS} paths")
    spark = answers.sparkSession
    number = {place: i for i, place in enumerate(sorted({(f["resource_type"], f["path"]) for f in fields}))}
    kinds: dict[str, dict[str, int]] = {}
    for (kind, path), i in number.items():
        kinds.setdefault(kind, {})[path] = i
    link = StructType([mapping.schema["link_id"], StructField("field", IntegerType())])
    links = [dict(zip(link.names, x)) for x in dict.fromkeys((f["link_id"], number[f["resource_type"], f["path"]]) for f in fields)]
    numbered = spark.createDataFrame(pa.Table.from_pylist(links, schema=to_arrow_schema(link)), link)
    said = answers.where("answer is not null").select("response_id", "link_id", "answer").join(F.broadcast(numbered), "link_id").drop("link_id")
    dealt = said.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "response_id")
    least = dealt.groupBy("response_id", "field").agg(F.min("answer").alias("answer"))
    own = least.groupBy("response_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "answer"))).alias("given"))
    of = lambda paths: F.map_filter("given", lambda k, _: k.between(min(paths.values()), max(paths.values())))
    own = own.select("response_id", *[of(paths).alias(f"_of{i}") for i, paths in enumerate(kinds.values())])
    entries = []
    for i, (kind, paths) in enumerate(kinds.items()):
        made = with_fields(F.lit(f'{{"resourceType":"{kind}"}}'), {path: _quoted(F.col(f"_of{i}")[n]) for path, n in paths.items()})
        entry = F.concat(F.lit(f'{{"request":{{"method":"POST","url":"{kind}"}},"resource":'), made, F.lit("}"))
        entries.append(F.when(F.size(f"_of{i}") > 0, entry))
    return own.select("response_id", F.concat(F.lit('{"entry":['), F.concat_ws(",", *entries), F.lit('],"resourceType":"Bundle","type":"transaction"}')).alias("bundle"))


def _quoted(text: Column) -> Column:
    """Text as a JSON string; null stays null."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1))


def calculated(values: DataFrame, rules: dict[str, Column], rounds: int = 8) -> DataFrame:
    """``values`` (one column an item) with calculated items: each round all rules see the values of the round before, until nothing changes.

    A rule is a Column over the items. Items whose rules refer to each other in a ring may go on changing: ``settled`` is
    false where the last round still changed something.
    """
    names = list(rules)
    rows = values
    for _ in range(rounds):
        rows = rows.withColumns({f"_old_{n}": F.col(n) for n in names}).withColumns(rules)
    same_ = F.lit(True)
    for n in names:
        same_ = same_ & F.col(n).eqNullSafe(F.col(f"_old_{n}"))
    return rows.withColumn("settled", same_).drop(*[f"_old_{n}" for n in names])
