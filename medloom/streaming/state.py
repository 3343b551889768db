"""Streams that keep state in a store: resources with their content, events seen, deliveries that are tried again later.

Each operator is a StatefulProcessor: what it knows of a key are values, maps and timers in the state store (RocksDB), read and
written entry by entry. A resource with very many events is a key with many entries, not a row of that size, and no entry is dropped to save room.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.subscriptions import BASE_S, CAP_S, FACTOR, MAX_ATTEMPTS
from ..operators.sync import RETRY_AFTER_S

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> SparkSession:
    """The session, set to keep the state of streams in RocksDB, as these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by)  # of one key and one micro-batch


# the hub


ACKED = "event_id string, sequence long, id string, action string, base_version string, version_id string, ack string, retry_after_s int"


class _Hub(StatefulProcessor):
    """Of each resource the current version, and a map of the events that it had."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "version string")
        self.seen = handle.getMapState("seen", "event_id string", "sequence long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows, ["sequence", "event_id"])
        current = self.version.get()[0] if self.version.exists() else None
        acks, before = [], current
        for event, sequence, action, base, new in batch[["event_id", "sequence", "action", "base_version", "version_id"]].itertuples(index=False):
            if self.seen.containsKey((event,)):
                acks.append("already_processed")
                continue
            self.seen.updateValue((event,), (int(sequence),))
            if (action == "create") == (current is not None):
                acks.append("rejected")
            elif action != "create" and base != current:
                acks.append("conflicted")
            else:
                current = None if action == "delete" else new
                acks.append("accepted")
        if current != before:
            self.version.update((current,)) if current is not None else self.version.clear()
        yield batch.assign(ack=acks, retry_after_s=pd.array([None] * len(acks), "Int32"))[[c.split()[0] for c in ACKED.split(", ")]]

    def close(self) -> None:
        pass


def pushes(stream: DataFrame) -> DataFrame:
    """The hub's acknowledgement of each pushed event, with the current version and the events seen of each resource as state.

    accepted; rejected: creating what exists, or changing what does not; conflicted: a change of another version than
    the current one; already_processed: an event that came before, however long ago; needs_retry, after RETRY_AFTER_S: an event without id, which
    is answered as it comes and belongs to no resource's state.
    """
    names = ["event_id", "sequence", "id", "action", "base_version", "version_id"]
    rows = stream.select(*names)
    lost = rows.where("id is null").select("*", F.lit("needs_retry").alias("ack"), F.lit(RETRY_AFTER_S).alias("retry_after_s"))
    known = rows.where("id is not null").groupBy("id").transformWithStateInPandas(_Hub(), ACKED, "append", "none")
    return known.unionByName(lost)


# events seen, as ranges of sequences


BLOCK = 1 << 16


def merged_ranges(ranges: list[tuple[int, int]], sequences: list[int]) -> tuple[list[tuple[int, int]], list[bool]]:
    """Closed ranges with the sequences put in, and which of these were in already; ranges that touch become one."""
    out, fresh = sorted(ranges), []
    for s in sequences:
        low, high = 0, len(out)
        while low < high:  # the first range that starts behind s
            mid = (low + high) // 2
            low, high = (mid + 1, high) if out[mid][0] <= s else (low, mid)
        known = low > 0 and s <= out[low - 1][1]
        fresh.append(not known)
        if known:
            continue
        left, right = low > 0 and out[low - 1][1] == s - 1, low < len(out) and out[low][0] == s + 1
        span = (out[low - 1][0] if left else s, out[low][1] if right else s)
        out[low - left : low + right] = [span]
    return out, fresh


class _Seen(StatefulProcessor):
    """Of a block of a node's sequences the ranges that came: at most as many as there are gaps."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ranges = handle.getValueState("ranges", "low array<long>, high array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows, ["sequence"])
        old = list(zip(*self.ranges.get())) if self.ranges.exists() else []
        new, fresh = merged_ranges([(int(a), int(b)) for a, b in old], [int(s) for s in batch["sequence"]])
        if any(fresh):
            self.ranges.update(([a for a, _ in new], [b for _, b in new]))
        yield batch.assign(fresh=fresh).drop(columns=["block"])

    def close(self) -> None:
        pass


def seen_once(stream: DataFrame, node: str = "node") -> DataFrame:
    """``stream`` with fresh: whether an event's sequence of its node comes for the first time, however late it is.

    State are ranges of sequences, for blocks of BLOCK of them: a node without gaps has one range a block, and a node with very many events is many keys.
    Events without a sequence are left out. Ties within a micro-batch: one of them is fresh.
    """
    rows = stream.where("sequence is not null").withColumn("block", F.floor(F.col("sequence") / BLOCK))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + ", fresh boolean"
    return rows.groupBy(node, "block").transformWithStateInPandas(_Seen(), schema, "append", "none")


# resources with their content


CHANGED = "sequence long, resource_type string, id string, action string, at long, json string, changed array<string>"
_changed = Row(*[c.split()[0] for c in CHANGED.split(", ")])


def changed_between(old: str | None, new: str | None) -> list[str]:
    """Top-level JSON fields that differ, in lower case; all of them if there is no older content."""

    def fields(text):
        try:
            value = json.loads(text) if text else {}
        except ValueError:
            return {}
        return value if isinstance(value, dict) else {}

    a, b = fields(old), fields(new)
    return sorted(k.lower() for k in {*a, *b} if k not in a or k not in b or a[k] != b[k])


class _Content(StatefulProcessor):
    """Of each resource its last content. Rows, not frames: with few events of a key a frame for each key would cost more than the work."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self.last.get()
        before = old = state[0] if state else None
        for r in sorted(rows, key=lambda r: (r["sequence"] is None, r["sequence"] or 0)):  # of one key and one micro-batch
            text = r["json"]
            yield _changed(*r, changed_between(old, text))
            old = text if text is not None else old
        if old != before:
            self.last.update((old,))

    def close(self) -> None:
        pass


def with_changes(stream: DataFrame) -> DataFrame:
    """Events (sequence, resource_type, id, action, timestamp, json) with changed: the fields that differ from the resource's last content, which is kept as state.

    Events of a resource must come in the order of their sequence; a delete keeps the last content.
    """
    rows = stream.select("sequence", "resource_type", "id", "action", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"), "json")
    out = rows.groupBy("resource_type", "id").transformWithState(_Content(), CHANGED, "append", "none")
    return out.select("sequence", "resource_type", "id", "action", F.timestamp_micros("at").alias("timestamp"), "json", "changed")


# deliveries that are tried again


TRIED = "job_id string, attempt int, at long, outcome string"
_tried = Row(*[c.split()[0] for c in TRIED.split(", ")])


class _Deliveries(StatefulProcessor):
    """Of each job how often it was tried; a timer says when the next time is. Rows, not frames: a job has one row at a time."""

    def __init__(self, fails):
        self.fails = fails

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tried = handle.getValueState("tried", "attempt int, at long")

    def _try(self, job: str, attempt: int, at: int) -> Row:
        failed = self.fails(job, attempt)
        outcome = "delivered" if not failed else "failed" if attempt >= MAX_ATTEMPTS else "retry"
        self.tried.update((attempt, at))
        if outcome == "retry":
            self.handle.registerTimer(at + 1000 * min(BASE_S * FACTOR ** (attempt - 1), CAP_S))
        return _tried(job, attempt, at, outcome)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = min(r["at"] for r in rows)
        if not self.tried.exists():  # a job that comes again is known already
            yield self._try(key[0], 1, first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self._try(key[0], self.tried.get()[0] + 1, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def deliveries(stream: DataFrame, fails, delay: str = "0 seconds") -> DataFrame:
    """job_id, attempt, at, outcome (delivered, retry, failed) of each attempt to deliver the jobs of a stream (job_id, timestamp), each job once.

    ``fails(job_id, attempt)`` says whether an attempt fails. A failed one is tried again after a backoff, by a timer on event time: as
    the watermark passes it. After MAX_ATTEMPTS a job has failed for good.
    """
    rows = stream.select("job_id", "timestamp").withWatermark("timestamp", delay)
    tried = rows.withColumn("at", F.unix_millis("timestamp")).groupBy("job_id").transformWithState(_Deliveries(fails), TRIED, "append", "eventTime")
    return tried.withColumn("at", F.timestamp_millis("at"))
