"""The append-only change log: current state, history, previous versions, batches of writes, transaction bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.resources import canonical
from ..sources.sinks import numbered
from . import validate
from .fields import with_fields

KEY = ["resource_type", "id"]
METHODS = {"create": "POST", "update": "PUT", "delete": "DELETE"}


def since(log: DataFrame, after: int, limit: int | None = None) -> DataFrame:
    """Events after a cursor, in order. The sort stops at ``limit`` rows (top-k), so a batch never sorts the log."""
    rows = log.where(F.col("sequence") > after)
    return rows.orderBy("sequence").limit(limit) if limit else rows


def latest(log: DataFrame) -> DataFrame:
    """The last event of each resource: a partial aggregate, no sort of histories."""
    cols = [c for c in log.columns if c not in KEY]
    last = log.groupBy(*KEY).agg(F.max_by(F.struct(*cols), "sequence").alias("last"))
    return last.select(*KEY, "last.*")


def current(log: DataFrame) -> DataFrame:
    """Resources that are: the last event is no delete."""
    return latest(log).where("action <> 'delete'")


def versions(log: DataFrame) -> DataFrame:
    """Each event with the version and the last content before it."""
    w = Window.partitionBy(*KEY).orderBy("sequence")
    return log.select(
        "*",
        F.lag("version_id").over(w).alias("prev_version"),
        F.last("json", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prev_json"),
    )


def history_bundle(log: DataFrame) -> DataFrame:
    """Method, url and etag of each version, as a history bundle lists them."""
    method = F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv])[F.col("action")]
    url = F.when(F.col("action") == "create", F.col("resource_type")).otherwise(F.concat_ws("/", *KEY))
    return log.select("sequence", *KEY, method.alias("method"), url.alias("url"), F.format_string('W/"%s"', "version_id").alias("etag"))


def applied(current_rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Current resources after a batch of changes: the last change of each key wins, deletes remove it."""
    new = latest(changes)
    kept = current_rows.join(new.select(*KEY), KEY, "left_anti")
    cols = [c for c in current_rows.columns if c in new.columns]
    return kept.select(*cols).unionByName(new.where("action <> 'delete'").select(*cols))


def transaction(bundles: DataFrame) -> DataFrame:
    """(bundle_id, entry array<struct<method, url, resource>>) -> one change an entry, in order, with its response.

    A bundle with a method or url that is refused (conditional urls, updates without id) is refused as a whole.
    """
    e = bundles.select("bundle_id", F.posexplode("entry").alias("position", "e"))
    path = F.split("e.url", "/")
    kind, id_ = F.get(path, F.lit(0)), F.get(path, F.lit(1))
    method = F.upper("e.method")
    fine = method.isin("POST", "PUT", "DELETE") & ~F.contains("e.url", F.lit("?")) & ((method == "POST") | id_.isNotNull())
    rows = e.select("bundle_id", "position", method.alias("method"), kind.alias("resource_type"), F.coalesce(id_, F.concat_ws("-", F.col("bundle_id").cast("string"), F.col("position").cast("string"))).alias("id"), F.col("e.resource").alias("json"), F.coalesce(fine, F.lit(False)).alias("fine"))
    whole = rows.groupBy("bundle_id").agg(F.min("fine").alias("ok"))
    action = F.when(F.col("method") == "POST", "create").when(F.col("method") == "PUT", "update").otherwise("delete")
    status = F.when(~F.col("ok"), "400").when(F.col("method") == "POST", "201").when(F.col("method") == "PUT", "200").otherwise("204")
    return rows.join(whole, "bundle_id").select("bundle_id", "position", "resource_type", "id", action.alias("action"), status.alias("status"), F.when(F.col("method") != "DELETE", F.col("json")).alias("json"))


def enriched(log: DataFrame, *more: str) -> DataFrame:
    """Local events as they are pushed: base version, base content, content, and ``more`` columns of the log."""
    return versions(log).select("sequence", *more, *KEY, "action", "version_id", F.col("prev_version").alias("base_version"), F.col("prev_json").alias("base_json"), "json")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Reserved ids that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def read(rows: DataFrame, keys: DataFrame, found: str = "found") -> DataFrame:
    """Each key with its row, and whether there is one."""
    return keys.join(rows.withColumn(found, F.lit(True)), KEY, "left").withColumn(found, F.coalesce(found, F.lit(False)))


def missing(rows: DataFrame, reference: Column, live: DataFrame) -> DataFrame:
    """The rows whose reference (Type/id) names no live resource (resourceType, id); rows without a reference are left out."""
    typed = live.select(F.concat_ws("/", "resourceType", "id").alias("_reference")).distinct()
    return rows.withColumn("_reference", reference).where("_reference is not null").join(typed, "_reference", "left_anti").drop("_reference")


def prepared(log: DataFrame, changes: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """A batch of writes as events of the log: change_id, resource_type, id, action, status, version_id, json, and prev_version.

    changes: change_id (in order), resource_type, id or null, action, json. JSON is made canonical and validated; an error aborts that
    write (status 422), as do creating what exists (409) and changing what does not (404). A create without an id gets one from
    change_id. Versions count on from the log, deletes get one of their own, as tombstones; meta carries version and time (``at`` of changes).
    Several writes of one key are judged in order, each by what those before it left: a valid create leaves the resource there and a valid delete
    leaves it gone, whether they are accepted or were so already. So no write needs another one's answer, and running windows are enough.
    """
    rows = changes.withColumn("id", F.coalesce("id", F.concat(F.lit("new-"), F.col("change_id").cast("string"))))
    # dealt by key once, for join and windows; JSON is read behind that, as a table of little bytes may be a single task
    rows = rows.repartition(*KEY).withColumn("json", canonical("json"))
    # found in the row of the write: no write is moved to learn of its errors
    codes = F.array_sort(F.array_distinct(F.transform(F.filter(validate.found("json", required), lambda i: i["severity"] == "error"), lambda i: i["code"])))
    rows = rows.withColumn("errors", F.when((F.col("action") != "delete") & (F.size(codes) > 0), F.array_join(codes, ",")))
    before = log.groupBy(*KEY).agg(F.count("*").alias("events"), (F.max_by("action", "sequence") != "delete").alias("live"), F.max_by("version_id", "sequence").alias("last_version"))
    rows = rows.join(before, KEY, "left")
    order = Window.partitionBy(*KEY).orderBy("change_id")
    earlier, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    left = F.when(F.col("errors").isNull() & F.col("action").isin("create", "delete"), F.col("action") == "create")
    rows = rows.withColumn("_live", F.coalesce(F.last(left, ignorenulls=True).over(earlier), "live", F.lit(False)))
    live = F.col("_live")
    status = (
        F.when(F.col("errors").isNotNull(), 422).when((F.col("action") == "create") & live, 409).when((F.col("action") != "create") & ~live, 404)
        .when(F.col("action") == "create", 201).when(F.col("action") == "update", 200).otherwise(204)
    )
    rows = rows.withColumn("status", status)
    number = F.coalesce("events", F.lit(0)) + F.count_if(F.col("status") < 300).over(so_far)
    rows = rows.withColumn("_version", F.when(F.col("status") < 300, number.cast("string")))
    rows = rows.withColumn("_prev", F.coalesce(F.last("_version", ignorenulls=True).over(earlier), "last_version"))
    version = F.col("_version")
    meta = F.concat(F.lit('{"lastUpdated":"'), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","versionId":"'), version, F.lit('"}'))
    id_ = F.concat(F.lit('"'), F.col("id"), F.lit('"'))
    json = F.when((F.col("status") < 300) & (F.col("action") != "delete"), with_fields("json", {"id": id_, "meta": meta}))
    return rows.select("change_id", *KEY, "action", "status", version.alias("version_id"), F.when(F.col("status") < 300, F.col("_prev")).alias("prev_version"), json.alias("json"), "errors", "at")


def written(events: DataFrame, params: dict[str, list], first: int) -> dict[str, DataFrame]:
    """What one batch of prepared writes adds: resources, tombstones, history, events and index rows; refused writes add nothing.

    History and events have each write; resources, tombstones and index what the last accepted one of each key leaves. Sequences of
    events count on from ``first`` in order of change_id, numbered in sorted ranges.
    """
    fine = events.where("status < 300")
    kept = fine.groupBy(*KEY).agg(F.max_by(F.struct("action", "version_id", "json"), "change_id").alias("last")).select(*KEY, "last.*")
    numbered_ = numbered(fine, ["change_id"]).withColumn("sequence", F.col("row_num") + first)
    text = kept.where("action <> 'delete'").select(F.col("resource_type").alias("resourceType"), "id", "json")
    rows = None
    for kind, fields in params.items():
        pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.get_json_object("json", p).alias("value")) for n, p in fields])
        own = text.where(F.col("resourceType") == kind).select(F.col("resourceType").alias("resource_type"), "id", F.explode(pairs).alias("v")).select("resource_type", "id", "v.*").where("value is not null")
        rows = own if rows is None else rows.unionByName(own)
    return {
        "resources": kept.where("action <> 'delete'").select(*KEY, "version_id", "json"), "tombstones": kept.where("action = 'delete'").select(*KEY, "version_id"),
        "history": fine.select(*KEY, "version_id", "action", "json"), "events": numbered_.select("sequence", *KEY, "action", "version_id", "prev_version"), "index": rows,
    }
