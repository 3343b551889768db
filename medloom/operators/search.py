"""Search over resources: an index of typed values, predicates fused into one pass, chains, includes, sorting, paging.

A search is given as its query string (``name=Doe&birthdate=gt1980&_sort=-birthdate``) or as pairs. ``run`` answers all of it: filters
on the typed resources' own columns (direct mode), which reach the Parquet scan, chains as semi-joins, full text, order, page, total,
includes, projection and links. Over an index of values (index mode) all parameters are judged in one scan and aggregation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import parse_qsl

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.paths import Path

DEFAULT_COUNT, MAX_COUNT = 20, 100
PREFIXES = ("eq", "ne", "gt", "lt", "ge", "le", "sa", "eb", "ap")
MODIFIERS = {"string": ("exact", "contains"), "token": ("not", "text"), "reference": ("identifier", "type")}
REFUSED = ("_has", "_filter", "_list", "_type", "_contained", "_containedType")
#: Words that full-text search passes over (fixed values).
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")


class SearchError(ValueError):
    """A parameter, modifier or value that searches don't support."""


@dataclass
class Param:
    name: str
    kind: str  # string, token, reference, date, number, quantity, composite
    values: Callable[[Path], Column]  # array<string>
    targets: tuple[str, ...] = ()
    components: int = 0  # of a composite


@dataclass
class Term:
    param: str
    modifier: str = ""
    values: list[str] = field(default_factory=list)
    chain: str = ""
    type: str = ""  # of a chain: the only type that it follows


@dataclass
class Search:
    terms: list[Term] = field(default_factory=list)
    sort: list[str] = field(default_factory=list)
    count: int = DEFAULT_COUNT
    offset: int = 0
    include: list[str] = field(default_factory=list)
    revinclude: list[str] = field(default_factory=list)
    text: str = ""
    summary: str = ""
    elements: list[str] = field(default_factory=list)


def split_at(value: str, mark: str) -> list[str]:
    """Parts between marks; one after a backslash is no mark. Backslashes before other characters stay."""
    parts, at = [""], 0
    while at < len(value):
        c = value[at]
        if c == "\\" and at + 1 < len(value):
            parts[-1] += value[at + 1] if value[at + 1] == mark else value[at : at + 2]
            at += 1
        elif c == mark:
            parts.append("")
        else:
            parts[-1] += c
        at += 1
    return parts


def plain(value: str) -> str:
    """A value without the backslashes that escape other characters."""
    out, at = "", 0
    while at < len(value):
        at += value[at] == "\\" and at + 1 < len(value)
        out += value[at]
        at += 1
    return out


def search(query: str | list[tuple[str, str]]) -> Search:
    """The parts of a query string. Values separated by commas are alternatives; repeated parameters must all hold."""
    out = Search()
    for key, value in parse_qsl(query, keep_blank_values=True) if isinstance(query, str) else query:
        name, _, modifier = key.partition(":")
        if name in REFUSED or modifier == "missing":
            raise SearchError(f"{key} is not supported")
        if name == "_sort":
            out.sort += value.split(",")
        elif name in ("_count", "_offset"):
            if not value.isdigit():
                raise SearchError(f"{name} must be a number")
            setattr(out, name[1:], min(int(value) or DEFAULT_COUNT, MAX_COUNT) if name == "_count" else int(value))
        elif name in ("_include", "_revinclude"):
            if "*" in value or value.count(":") < 1:
                raise SearchError(f"{name}={value} is not supported")
            getattr(out, name[1:]).append(value)
        elif name in ("_text", "_content"):
            out.text = f"{out.text} {value}".strip()
        elif name == "_summary":
            out.summary = value
        elif name == "_elements":
            out.elements += value.split(",")
        else:
            param, _, chain = name.partition(".")
            kind = ""
            if "." in modifier:  # subject:Patient.name, maybe with a modifier of its own
                kind, _, chain = modifier.partition(".")
                chain, _, modifier = chain.partition(":")
            if "." in chain:
                raise SearchError(f"{name}: chains of one step only")
            out.terms.append(Term(param, modifier, split_at(value, ","), chain, kind))
    if out.summary == "count" and out.elements:
        raise SearchError("_summary=count with _elements")
    return out


def index(df: DataFrame, params: list[Param]) -> DataFrame:
    """resource_type, id, kind, field, value: one row for each distinct value of each parameter of each resource."""
    root = Path.of(df)

    def values(p: Param) -> Column:
        row = lambda v: F.struct(F.lit(p.kind).alias("kind"), F.lit(p.name).alias("field"), v.alias("value"))
        return F.transform(F.filter(p.values(root), lambda v: v.isNotNull() & (v != "")), row)

    return df.select(F.col("resourceType").alias("resource_type"), "id", F.explode(F.concat(*map(values, params))).alias("row")).select("resource_type", "id", "row.*")


def prefix(kind: str, value: str) -> tuple[str, str]:
    """Comparison and value: only dates, numbers and quantities have prefixes."""
    return (value[:2], value[2:]) if kind in ("date", "number", "quantity") and value[:2] in PREFIXES else ("eq", value)


def typed(rows: DataFrame) -> DataFrame:
    """Index rows with the bounds of their dates as instants (at, until; null for other kinds), for ``StoredIndex``."""
    date = F.when(F.col("kind") == "date", F.col("value"))
    return rows.select("*", N.low(date).alias("at"), N.high(date).alias("until"))


def matches(param: Param, term: Term, value: Column, at: Column | None = None) -> Column:
    """Whether an index value meets one of the term's values; ``at`` is a date's instant where the index has it."""
    if term.modifier and term.modifier not in MODIFIERS.get(param.kind, ()):
        raise SearchError(f"{param.name}:{term.modifier} is not supported")
    if param.components:
        parts = [[plain(x.strip()) for x in split_at(v, "$")] for v in term.values]
        if any(len(x) != param.components for x in parts):
            raise SearchError(f"{param.name} has {param.components} components")
        return value.isin(*["$".join(x) for x in parts])
    values = [plain(v) for v in term.values]
    if term.modifier == "contains" or term.modifier == "text":
        return _any([F.contains(F.lower(value), F.lit(v.lower())) for v in values])
    if term.modifier == "type":
        return _any([value.startswith(v + "/") | value.startswith(v + "|") for v in values])
    if term.modifier == "identifier":
        return _any([(value == v) | value.endswith("/" + v) | value.endswith("|" + v) for v in values])
    if param.kind == "quantity":
        return _any([_measured(*prefix(param.kind, v), value) for v in term.values])
    if param.kind in ("date", "number"):
        return _any([_ordered(param.kind, *prefix(param.kind, v), value, at) for v in values])
    return value.isin(*values)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _measured(op: str, v: str, value: Column) -> Column:
    """Whether a quantity (number|system|code) meets a searched one: number, number|system|code or number||unit.

    A written number stands for a range (half of its last place to both sides), and a unit for a factor of its base unit. Equal: the value lies in the
    searched range; gt and lt compare with the number itself, ge and le also take what is equal, sa and eb are beyond the range, ap within a tenth. Without a unit any unit is
    compared, by number.
    """
    number, *rest = [plain(x) for x in split_at(v, "|")]
    try:
        float(number)
    except ValueError as e:
        raise SearchError(f"{v} is no quantity") from e
    if len(rest) not in (0, 2):
        raise SearchError(f"{v}: a quantity is number, number|system|code or number||unit")
    system, code = rest or ("", "")
    part = lambda i: F.get(F.split(value, r"\|"), F.lit(i))
    wanted = N.quantity(F.lit(number), F.lit(code) if code else F.lit(""))
    have = N.quantity(part(0), part(2) if code else F.lit(""))
    x, n, low, high = have["value"], wanted["value"], wanted["low"], wanted["high"]
    same, more = (x >= low) & (x < high), F.abs(n) * 1e-12  # what factors of units leave is no difference
    test = {"eq": same, "ne": ~same, "gt": x > n + more, "lt": x < n - more, "ge": (x > n) | same, "le": (x < n) | same, "sa": x >= high, "eb": x < low, "ap": F.abs(x - n) <= F.abs(n) * (0.1 + 1e-12)}[op]
    fits = (have["unit"] == wanted["unit"]) if code else F.lit(True)
    return test & fits & ((part(1) == system) if system else F.lit(True))


def _ordered(kind: str, op: str, v: str, value: Column, at: Column | None = None) -> Column:
    if kind == "number":
        try:
            n = float(v)
        except ValueError as e:
            raise SearchError(f"{v} is no number") from e
        x = F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")
        return {"eq": x == n, "ne": x != n, "gt": x > n, "ge": x >= n, "lt": x < n, "le": x <= n, "sa": x > n, "eb": x < n, "ap": F.abs(x - n) <= abs(n) * 0.1}[op]
    x, a, b = N.low(value) if at is None else at, N.low(F.lit(v)), N.high(F.lit(v))
    same = (x >= a) & (x < b)
    return {"eq": same, "ne": ~same, "gt": x >= b, "ge": x >= a, "lt": x < a, "le": x < b, "sa": x >= b, "eb": x < a, "ap": same}[op]


#: Parameters that every resource type has; the time of the last update is looked for in the resource's meta.
SPECIAL = [Param("_id", "token", lambda p: N.strings(p["id"])), Param("_lastUpdated", "date", lambda p: N.strings(p["meta"]["lastUpdated"]))]


def _lookup(params: list[Param], name: str) -> Param:
    found = next((p for p in [*params, *SPECIAL] if p.name == name), None)
    if found is None:
        raise SearchError(f"no parameter {name}")
    return found


def ids(rows: DataFrame, params: list[Param], terms: list[Term]) -> DataFrame:
    """Index mode: distinct ids of the resources that meet all terms (without chains), in one pass of the index.

    Only index rows that meet some term go to the aggregation; of a term with ``:not`` all rows of its field do. Over a ``StoredIndex``, whose
    rows of an id lie together, there is no exchange.
    """
    if any(t.chain for t in terms):
        raise SearchError("an index of one type can't follow chains; use run")
    tests = [(t, _lookup(params, t.param)) for t in terms]
    if not tests:
        return rows.select("id").distinct()
    verdicts, some = [], F.lit(False)
    for i, (t, p) in enumerate(tests):
        here = (F.col("field") == t.param) & F.coalesce(matches(p, t, F.col("value"), F.col("at") if "at" in rows.columns else None), F.lit(False))
        verdicts.append(F.max(here).alias(f"t{i}"))
        some = some | (F.col("field") == t.param if t.modifier == "not" else here)
        if t.modifier == "not":
            verdicts.append(F.max(F.col("field") == t.param).alias(f"f{i}"))
    judged = rows.where(some).groupBy("id").agg(*verdicts)
    for i, (t, _) in enumerate(tests):
        judged = judged.where(F.col(f"f{i}") & ~F.col(f"t{i}") if t.modifier == "not" else F.col(f"t{i}"))
    return judged.select("id")


def direct(df: DataFrame, params: list[Param], terms: list[Term]) -> DataFrame:
    """Direct mode: the resources that meet all terms, by filters on their own columns."""
    root = Path.of(df)

    def test(t: Term) -> Column:
        if t.chain:
            raise SearchError("chains need other types; use run")
        p = _lookup(params, t.param)
        values = p.values(root)
        met = F.exists(values, lambda v: F.coalesce(matches(p, t, v), F.lit(False)))
        return (F.size(values) > 0) & ~met if t.modifier == "not" else met

    for t in terms:
        df = df.where(test(t))
    return df


def chained(rows: DataFrame, ref: str, target_ids: DataFrame, target: str) -> DataFrame:
    """Ids whose reference ``ref`` points to one of the ids of a type: a semi-join on the typed spelling."""
    typed = target_ids.select(F.concat(F.lit(target + "/"), F.col("id")).alias("value"))
    return rows.where((F.col("field") == ref) & (F.col("kind") == "reference")).join(typed, "value", "left_semi").select("id").distinct()


def included(page: DataFrame, rows: DataFrame, ref: str, targets: DataFrame) -> DataFrame:
    """The resources that a page's reference ``ref`` points to, each once."""
    links = rows.where((F.col("field") == ref) & F.contains("value", F.lit("/"))).join(page.select("id"), "id", "left_semi")
    wanted = links.select(F.substring_index("value", "/", 1).alias("resourceType"), F.substring_index("value", "/", -1).alias("id")).distinct()
    return targets.join(wanted, ["resourceType", "id"], "left_semi")


def revincluded(page: DataFrame, rows: DataFrame, ref: str, kind: str, sources: DataFrame) -> DataFrame:
    """The resources whose reference ``ref`` points to a resource of the page, of type ``kind``."""
    return sources.join(chained(rows, ref, page, kind), "id", "left_semi")


def ordered(found: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``found`` with its sort columns, in order: missing values are as empty strings, ties go by id."""
    order = []
    for i, key in enumerate(keys):
        name = key.lstrip("-")
        if name == "_id":
            order.append(F.desc("id") if key[0] == "-" else F.asc("id"))
            continue
        value = rows.where(F.col("field") == name).groupBy("id").agg(F.min("value").alias(f"sort{i}"))
        found = found.join(value, "id", "left").withColumn(f"sort{i}", F.coalesce(f"sort{i}", F.lit("")))
        order.append(F.desc(f"sort{i}") if key[0] == "-" else F.asc(f"sort{i}"))
    return found.orderBy(*order, "id")


def page(found: DataFrame, s: Search) -> DataFrame:
    return found.offset(s.offset).limit(s.count)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def full_text(docs: DataFrame, text: str, query: str) -> DataFrame:
    """id, rank of the documents that hold every word of the query: how often, against the document's words."""
    wanted = [w for w in query.lower().split() if w not in STOP_WORDS]
    tokens = docs.select("id", words(F.col(text)).alias("w"))
    tokens = tokens.where(F.size(F.array_intersect("w", F.array(*map(F.lit, dict.fromkeys(wanted))))) == len(set(wanted)))
    hits = F.size(F.filter("w", lambda w: w.isin(*wanted)))
    return tokens.select("id", F.round(hits / F.size("w"), 6).alias("rank"))


def text_documents(rows: DataFrame) -> DataFrame:
    """The text of each resource: its distinct string values in order, with spaces between."""
    return rows.where("kind = 'string'").groupBy("resource_type", "id").agg(F.array_join(F.sort_array(F.collect_set("value")), " ").alias("text"))


def _ranked(df: DataFrame, params: list[Param], query: str) -> DataFrame:
    """The resources that hold every word of the query, with rank: on the row's own strings, so without an exchange."""
    root = Path.of(df)
    values = F.filter(F.flatten(F.array(*[p.values(root) for p in params])), lambda v: v.isNotNull() & (v != ""))
    wanted = [w for w in query.lower().split() if w not in STOP_WORDS]
    out = df.withColumn("_w", words(F.array_join(F.sort_array(F.array_distinct(values)), " ")))
    out = out.where((F.size("_w") > 0) & (F.size(F.array_intersect("_w", F.array(*map(F.lit, dict.fromkeys(wanted))).cast("array<string>"))) == len(set(wanted))))
    hits = F.size(F.filter("_w", lambda w: w.isin(*wanted))) if wanted else F.lit(0)
    return out.withColumn("rank", F.round(hits / F.size("_w"), 6)).drop("_w")


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """resource_type, term, id, tf, words of texts (resource_type, id and ``text``); the term "" stands for each document with words, once.

    A text is one row, so its terms are counted there, as runs of its sorted words: nothing is moved to count them.
    """
    tokens = docs.select("resource_type", "id", F.array_sort(words(F.col(text))).alias("w")).where(F.size("w") > 0)

    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        return F.get(F.transform(F.array(starts), lambda at: F.transform(at, lambda i, k: F.struct(F.get(w, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(w)) - i).cast("long").alias("tf")))), F.lit(0))

    whole = F.array(F.struct(F.lit("").alias("term"), F.lit(0).cast("long").alias("tf")))
    each = tokens.select("resource_type", "id", F.size("w").cast("long").alias("words"), F.explode(F.concat(whole, runs(F.col("w")))).alias("p"))
    return each.select("resource_type", "p.term", "id", "p.tf", "words")


def stored_text(stored, kind: str, query: str) -> DataFrame:
    """id, rank of the documents of a type that hold every word of the query, by ``StoredPostings``: only the parts of those words are read.

    A word counts the more, the fewer documents have it and the larger its share of the document's words is.
    """
    wanted = list(dict.fromkeys(w for w in query.lower().split() if w not in STOP_WORDS))
    if not wanted:
        raise SearchError(f"{query!r} has no word to look for")
    rows = stored.of(kind, [*wanted, ""])
    n = rows.where("term = ''").agg(F.count("*").alias("n"))
    hits = rows.where("term <> ''")
    weights = hits.groupBy("term").agg(F.count("*").alias("df")).join(n).select("term", F.log(1 + F.col("n") / F.col("df")).alias("weight"))  # a row for each word of the query
    found = hits.join(F.broadcast(weights), "term").groupBy("id").agg(F.count("*").alias("met"), F.sum(F.col("weight") * F.col("tf") / F.col("words")).alias("rank"))
    return found.where(F.col("met") == len(wanted)).select("id", F.round("rank", 6).alias("rank"))


SUMMARY = {"text": ["resourceType", "id", "meta", "text"], "true": ["resourceType", "id", "meta", "identifier", "name", "active", "gender", "status", "subject"]}


def projected(df: DataFrame, s: Search) -> DataFrame:
    """_summary and _elements as column lists; resourceType, id and meta always stay."""
    keep = list(df.columns)
    if s.summary in SUMMARY:
        keep = [c for c in keep if c in SUMMARY[s.summary]]
    elif s.summary == "data":
        keep = [c for c in keep if c != "text"]
    elif s.summary not in ("", "false", "count"):
        raise SearchError(f"_summary={s.summary} is not supported")
    if s.elements:
        keep = [c for c in df.columns if c in s.elements or c in ("resourceType", "id", "meta") or (s.summary in SUMMARY and c in keep)]
    return df.select(*keep)


def bundle(found: DataFrame, *more: DataFrame) -> DataFrame:
    """resource_type, id, mode, full_url of matches and included resources."""
    part = lambda df, mode: df.select(F.col("resourceType").alias("resource_type"), "id", F.lit(mode).alias("mode"), F.concat_ws("/", "resourceType", "id").alias("full_url"))
    out = part(found, "match")
    for df in more:
        out = out.unionByName(part(df, "include"))
    return out


def links(base: str, s: Search, total: int) -> dict[str, str]:
    at = lambda offset: f"{base}{'&' if '?' in base else '?'}_count={s.count}&_offset={offset}"
    return {"self": at(s.offset)} | ({"next": at(s.offset + s.count)} if s.offset + s.count < total else {})


def orphans(rows: DataFrame, live: DataFrame) -> DataFrame:
    """Index rows of resources that are no more."""
    return rows.join(live.select("id"), "id", "left_anti")


@dataclass
class Found:
    """What a search gives: ``page`` (id, position, and rank of full text), ``total``, ``resources`` (projected), ``included`` (resourceType, id)."""

    search: Search
    kind: str
    page: DataFrame
    total: DataFrame
    resources: DataFrame
    included: DataFrame

    def bundle(self) -> DataFrame:
        return bundle(self.page.select(F.lit(self.kind).alias("resourceType"), "id"), self.included)

    def links(self, base: str = "") -> dict[str, str]:
        return links(base or self.kind, self.search, self.total.first()[0])


def _links(df: DataFrame, p: Param) -> DataFrame:
    """id, target_type, target of the typed references of a parameter."""
    values = df.select("id", F.explode(F.array_distinct(p.values(Path.of(df)))).alias("value")).where(F.contains("value", F.lit("/")))
    return values.select("id", F.substring_index("value", "/", 1).alias("target_type"), F.substring_index("value", "/", -1).alias("target"))


def _sorted_by(df: DataFrame, params: list[Param], keys: list[str]) -> list[Column]:
    """Orders of a resource's own columns: of several values the least; a missing one comes first, or last if descending."""
    order, root = [], Path.of(df)
    for key in keys:
        p = _lookup(params, key.lstrip("-"))
        if p.kind == "composite":
            raise SearchError(f"_sort={key} is not supported")
        typed = {"date": N.low, "number": lambda v: v.try_cast("double"), "quantity": lambda v: N.quantity(F.get(F.split(v, r"\|"), F.lit(0)), F.get(F.split(v, r"\|"), F.lit(2)))["value"]}.get(p.kind, lambda v: v)
        value = F.array_min(F.transform(p.values(root), typed))
        order.append(value.desc_nulls_last() if key[0] == "-" else value.asc_nulls_first())
    return order


def _matching(s: Search, kind: str, params: dict[str, list[Param]], load: Callable[[str], DataFrame]) -> DataFrame:
    """The resources that meet the terms, chains and full text of a search; with rank where there is text."""
    own = params[kind]
    df = direct(load(kind), own, [t for t in s.terms if not t.chain])
    for t in s.terms:
        if t.chain:
            ref = _lookup(own, t.param)
            targets = [k for k in ref.targets if t.type in ("", k)]
            if ref.kind != "reference" or not targets:
                raise SearchError(f"{t.param}:{t.type} is no reference that can be followed")
            met = None
            for k in targets:
                ids_ = direct(load(k), params[k], [Term(t.chain, t.modifier, t.values)]).select(F.lit(k).alias("target_type"), F.col("id").alias("target"))
                met = ids_ if met is None else met.unionByName(ids_)
            df = df.join(_links(df, ref).join(met, ["target_type", "target"], "left_semi").select("id").distinct(), "id", "left_semi")
    if s.text:
        strings_ = [p for p in own if p.kind == "string"]
        if not strings_:
            raise SearchError(f"{kind} has no text")
        df = _ranked(df, strings_, s.text)
    return df


def run(query: str | list[tuple[str, str]], kind: str, params: dict[str, list[Param]], load: Callable[[str], DataFrame]) -> Found:
    """The whole answer to a search of one resource type; ``load`` gives the resources of a type, ``params`` its parameters.

    Without ``_sort`` a full-text search comes by rank, any other by id; ties always go by id. Includes belong to the page. What a
    search does not support raises SearchError.
    """
    s, own = search(query), params[kind]
    for name, values in (("_sort", s.sort), ("_include", s.include), ("_revinclude", s.revinclude)):
        if any(not v.strip("-") for v in values):
            raise SearchError(f"{name} is empty")
    df = _matching(s, kind, params, load)
    rank = ["rank"] if s.text else []
    total = df.agg(F.count("*").alias("total"))
    order = _sorted_by(df, own, s.sort) if s.sort else [F.desc("rank")] if rank else []
    limited = df.orderBy(*order, "id").offset(s.offset).limit(0 if s.summary == "count" else s.count)
    numbered = limited.withColumn("position", F.row_number().over(Window.orderBy(*order, "id")) + s.offset)  # a page of MAX_COUNT rows at most
    page_ = numbered.select("id", "position", *rank)
    more = []
    for value in s.include:
        source, name, *only = value.split(":")
        ref = _lookup(own, name)
        if source != kind or ref.kind != "reference":
            raise SearchError(f"_include={value} is not supported")
        wanted = _links(limited, ref).select(F.col("target_type").alias("resourceType"), F.col("target").alias("id")).distinct()
        more += [load(k).select("resourceType", "id").join(wanted, ["resourceType", "id"], "left_semi") for k in ref.targets if not only or k in only]
    for value in s.revinclude:
        source, name, *only = value.split(":")
        if source not in params or only and only != [kind]:
            raise SearchError(f"_revinclude={value} is not supported")
        others, ref = load(source), _lookup(params[source], name)
        back = _links(others, ref).where(F.col("target_type") == kind).join(limited.select(F.col("id").alias("target")), "target", "left_semi")
        more.append(others.select("resourceType", "id").join(back.select("id").distinct(), "id", "left_semi"))
    included_ = df.sparkSession.createDataFrame([], "resourceType string, id string")
    for part in more:
        included_ = included_.unionByName(part.select("resourceType", "id"))
    included_ = included_.distinct().join(limited.select("resourceType", "id"), ["resourceType", "id"], "left_anti")
    resources_ = projected(numbered.drop(*rank, "position") if rank else numbered.drop("position"), s)
    return Found(s, kind, page_, total, resources_, included_)


class Builder:
    """A search built step by step: ``Builder().where("name", "Doe").any("status", "a", "b").sort("-date").count(10).query``."""

    def __init__(self, parts: tuple[tuple[str, str], ...] = ()):
        self.parts = parts

    def _with(self, name: str, value: str) -> Builder:
        return Builder((*self.parts, (name, value)))

    def where(self, name: str, value: str, modifier: str = "") -> Builder:
        return self.any(name, value, modifier=modifier)

    def any(self, name: str, *values: str, modifier: str = "") -> Builder:
        """One of the values; marks within them are escaped."""
        escaped = [v.replace("\\", "\\\\").replace(",", "\\,") for v in values]
        return self._with(name + (f":{modifier}" if modifier else ""), ",".join(escaped))

    def sort(self, *keys: str) -> Builder:
        return self._with("_sort", ",".join(keys))

    def count(self, n: int) -> Builder:
        return self._with("_count", str(n))

    def offset(self, n: int) -> Builder:
        return self._with("_offset", str(n))

    def include(self, path: str) -> Builder:
        return self._with("_include", path)

    @property
    def query(self) -> list[tuple[str, str]]:
        return list(self.parts)


def all_pages(query: list[tuple[str, str]], kind: str, params: dict[str, list[Param]], load: Callable[[str], DataFrame]) -> DataFrame:
    """All matches of a search, as following its next links gives them: the pages are one plan here, without the limit. Chains and full text as in ``run`` (then with rank)."""
    plain_ = [(k, v) for k, v in query if k not in ("_count", "_offset", "_sort", "_summary", "_elements", "_include", "_revinclude")]
    return _matching(search(plain_), kind, params, load)
