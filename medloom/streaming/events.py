"""Structured Streaming over the change log: subscriptions, windows, idempotent apply, the hub's state. See ``state`` for what needs a state store."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import subscriptions
from ..sources.steps import goes


def read(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder (or one file) as a stream, by their time of arrival.

    What is later than a watermark allows is dropped, and state judges events as they come: files must come in the order of their events.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drained(stream: DataFrame, folder: str, spark: SparkSession, write: Callable | None = None, name: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote.

    A call of the same ``name`` goes on where the last one ended and returns all that was written under it; without a name each
    call begins anew, and its files go when the program ends.
    """
    if name is None:
        name = uuid.uuid4().hex
        goes(spark, f"{folder}/stream-{name}")
    out = stream.writeStream.option("checkpointLocation", f"{folder}/stream-{name}/checkpoint").trigger(availableNow=True)
    out = out.foreachBatch(write) if write else out.format("parquet").outputMode("append").option("path", f"{folder}/stream-{name}/rows")
    query = out.start()
    query.awaitTermination()
    return None if write else spark.read.schema(stream.schema).parquet(f"{folder}/stream-{name}/rows")


def matches(stream: DataFrame, subs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events and the subscriptions they trigger (stream-static join), each job once within the watermark."""
    found = subscriptions.matched(stream.withWatermark("timestamp", delay), subs)
    return found.dropDuplicatesWithinWatermark(["job_id"])


def window_counts(stream: DataFrame, width: str, delay: str, *keys: str) -> DataFrame:
    """Events by window and keys; a window comes out when the watermark has passed it."""
    w = F.window("timestamp", width)
    return stream.withWatermark("timestamp", delay).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def once(stream: DataFrame, delay: str, *keys: str) -> DataFrame:
    """Each event id once within the watermark."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(list(keys))


ACKS = "sequence long, id string, action string, ack string"


def _acked(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    exists = state.get[0] if state.exists else False
    rows = pd.concat(list(batches)).sort_values("sequence")  # of one id and one micro-batch
    acks = []
    for action in rows["action"]:
        fine = exists != (action == "create")
        exists = action != "delete" if fine else exists
        acks.append("accepted" if fine else "rejected")
    state.update((bool(exists),))
    yield rows.assign(ack=acks)[["sequence", "id", "action", "ack"]]


def hub(stream: DataFrame) -> DataFrame:
    """The hub's answer to each change, by what each resource's state is after the changes before it."""
    return stream.select("sequence", "id", "action").groupBy("id").applyInPandasWithState(_acked, ACKS, "exists boolean", "append", GroupStateTimeout.NoTimeout)
