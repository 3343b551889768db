"""Push and pull between a device's log and a hub: staleness, acknowledgements, idempotent apply, cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.steps import stepped
from .history import KEY, enriched

TERMINAL = ("accepted", "rejected", "already_processed", "conflicted")
RETRY_AFTER_S = 30


def deduplicated(events: DataFrame, inbox: DataFrame | None = None, id_: str = "event_id") -> DataFrame:
    """Events not applied yet, each once."""
    out = events.dropDuplicates([id_])
    return out if inbox is None else out.join(inbox.select(id_), id_, "left_anti")


def judged(pushed: DataFrame, hub: DataFrame, seen: DataFrame) -> DataFrame:
    """``pushed`` with the hub's acknowledgement.

    pushed: event_id, resource_type, id, action, base_version; hub: resource_type, id, current_version; seen: event_id.
    A known event is already processed. Creating what exists or changing what doesn't is rejected, a change of
    another version than the current one conflicts, an event without id needs a retry.
    """
    rows = pushed.join(hub.select(*KEY, "current_version"), KEY, "left").join(seen.select("event_id", F.lit(True).alias("seen")), "event_id", "left")
    exists = F.col("current_version").isNotNull()
    ack = (
        F.when(F.col("seen"), "already_processed")
        .when(F.col("id").isNull(), "needs_retry")
        .when((F.col("action") == "create") & exists, "rejected")
        .when((F.col("action") != "create") & ~exists, "rejected")
        .when((F.col("action") != "create") & ~F.col("base_version").eqNullSafe(F.col("current_version")), "conflicted")
        .otherwise("accepted")
    )
    rows = rows.withColumn("ack", ack).drop("seen")
    return rows.withColumn("retry_after_s", F.when(F.col("ack") == "needs_retry", RETRY_AFTER_S))


def cursor(acks: DataFrame, by: str = "node") -> DataFrame:
    """The last sequence before each node's first event without a terminal acknowledgement: min and max, no sort."""
    open_ = acks.groupBy(by).agg(F.min(F.when(~F.col("ack").isin(*TERMINAL), F.col("sequence"))).alias("stop"))
    return acks.join(open_, by).where(F.col("stop").isNull() | (F.col("sequence") < F.col("stop"))).groupBy(by).agg(F.max("sequence").alias("cursor"))


def summary(acks: DataFrame) -> DataFrame:
    """proposed, applied, skipped and the last sequence."""
    return acks.agg(F.count("*").alias("proposed"), F.count_if(F.col("ack") == "accepted").alias("applied"), F.count_if(F.col("ack") != "accepted").alias("skipped"), F.max("sequence").alias("last_sequence"))


def batches(events: DataFrame, size: int = 100, by: str = "node") -> DataFrame:
    """Push batches of each node in order of sequence, deletes last within a batch.

    A node's events are numbered in sorted ranges, whose counts are added up: no task holds all events of a node.
    """
    cut = events.repartitionByRange(by, "sequence").withColumn("_part", F.spark_partition_id())
    cut = stepped(cut, "batches")
    per = cut.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), before.alias("_before"))
    w = Window.partitionBy(by, "_part").orderBy("sequence")
    rows = cut.withColumn("_row", F.row_number().over(w)).join(F.broadcast(per), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    rows = rows.withColumn("batch", F.floor((F.col("_row") + F.col("_before") - 1) / size)).select(*events.columns, "batch")
    inner = Window.partitionBy(by, "batch").orderBy(F.col("action") == "delete", "sequence")
    return rows.withColumn("position", F.row_number().over(inner))


def pulled(log: DataFrame, current: DataFrame, after: int) -> DataFrame:
    """Canonical events for a node: each event after its cursor with the resource as it is now."""
    now = current.select(*KEY, F.col("version_id").alias("current_version"), F.col("json").alias("current_json"))
    return log.where(F.col("sequence") > after).join(now, KEY, "left")


def replayed(log: DataFrame, first: int, last: int, size: int = 100, by: str = "node") -> DataFrame:
    """The pushes of a range of sequences once more: enriched events of the range with the batch and the place that they had from there on.

    Base versions come from the log before the range, of those resources only that the range has; so a replay sends what the first push sent.
    """
    within = log.where(F.col("sequence").between(first, last))
    own = log.where(F.col("sequence") <= last).join(within.select(*KEY).distinct(), KEY, "left_semi")
    return batches(enriched(own, by).where(F.col("sequence") >= first), size, by)


def nodes(registry: DataFrame, seen: DataFrame, now: Column, stale_after: str = "1 day") -> DataFrame:
    """node, kind, last_seen, state of the registered nodes: active, stale (not seen for a time) or new (never seen)."""
    last = seen.groupBy("node").agg(F.max("at").alias("last_seen"))
    state = F.when(F.col("last_seen").isNull(), "new").when(F.col("last_seen") < now - F.expr(f"INTERVAL {stale_after}"), "stale").otherwise("active")
    return registry.join(last, "node", "left").withColumn("state", state)


def advanced(stored: DataFrame, new: DataFrame, by: str = "node") -> DataFrame:
    """Stored cursors after an exchange: a cursor never goes back, nodes without a stored one get theirs."""
    return stored.select(by, "cursor").unionByName(new.select(by, "cursor")).groupBy(by).agg(F.max("cursor").alias("cursor"))
