"""Streams that keep state: changed fields, late events, deliveries with retries, a sink for each micro-batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import subscriptions
from ..sources import sinks
from ..sources.steps import temporary
from ..sources.tables import event_log, table
from ..streaming import events, state
from .log_queries import LOG, SUBSCRIPTION, SUBSCRIPTIONS
from .registry import query
from .work import rows, work_dir


def _streamed(spark, df, *order: str, files: int = 4):
    """``df`` as a stream of a few files, one a micro-batch, in order."""
    path = temporary(spark, "streamed")
    low, high = df.agg(F.min(order[0]), F.max(order[0])).first()
    step = max(1, -(-(high - low + 1) // files)) if low is not None else 1
    for i in range(files):
        part = df.where((F.col(order[0]) >= (low or 0) + i * step) & (F.col(order[0]) < (low or 0) + (i + 1) * step))
        part.coalesce(1).sortWithinPartitions(*order).write.mode("append").parquet(path)
    return events.read(state.with_store(spark), path, df.schema, files_per_batch=1)


@query(f"""WITH l AS ({LOG}), p AS (SELECT *, last_value(json IGNORE NULLS) OVER (PARTITION BY id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM l)
    SELECT 's1:' || sequence AS job_id, sequence, 's1' AS subscription_id FROM p WHERE action = 'create'
    UNION ALL SELECT 's2:' || sequence, sequence, 's2' FROM p WHERE action = 'update' AND json IS DISTINCT FROM old UNION ALL SELECT 's6:' || sequence, sequence, 's6' FROM p WHERE action = 'delete'""")
def stream_changed_fields(spark, sf_dir):
    """The jobs of the batch query, from a stream that keeps each resource's last content as state."""
    log = event_log(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    changed = state.with_changes(_streamed(spark, log, "sequence"))
    found = subscriptions.matched(changed, rows(spark, SUBSCRIPTIONS, SUBSCRIPTION)).select("job_id", "sequence", "subscription_id")
    return events.drained(found, work_dir(spark), spark)


@query("SELECT event_id AS sequence, user_id % 3 AS node, event_id % 2 = 0 AS again, event_id % 2 = 1 AND n = 1 OR event_id % 2 = 0 AND n = 1 AS fresh FROM events, (VALUES (1), (2)) v(n) WHERE n = 1 OR event_id % 2 = 0")
def stream_late_events(spark, sf_dir):
    """Every second event comes again, after all others: none of them is taken for new, and none that is new for old."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"), (F.col("user_id") % 3).alias("node"), (F.col("event_id") % 2 == 0).alias("again"))
    path = temporary(spark, "late")
    for part in (e.where("sequence % 4 < 3"), e.where("sequence % 4 = 3"), e.where("again")):  # the second fills gaps that the first left
        part.coalesce(2).write.mode("append").parquet(path)
    out = state.seen_once(events.read(state.with_store(spark), path, e.schema, files_per_batch=2))
    return events.drained(out, work_dir(spark), spark)


_TRIES = """j AS (SELECT 'j' || s_suppkey AS job_id, s_suppkey % 7 AS fails FROM supplier), a AS (SELECT unnest(range(1, 6)) AS attempt)
    SELECT job_id, CAST(attempt AS INTEGER) AS attempt, epoch_ms(1704067200000 + 1000 * (CAST(pow(2, attempt - 1) AS BIGINT) - 1)) AS at, CASE WHEN attempt > fails THEN 'delivered' WHEN attempt = 5 THEN 'failed' ELSE 'retry' END AS outcome FROM j, a WHERE attempt <= fails + 1"""


@query(f"WITH {_TRIES}")
def stream_retries(spark, sf_dir):
    """A job for each supplier fails so often as its key says; timers try it again after 1, 2, 4, 8 seconds, five times at most."""
    start = F.lit("2024-01-01").cast("timestamp")
    jobs = table(spark, sf_dir, "supplier").select(F.concat(F.lit("j"), F.col("s_suppkey").cast("string")).alias("job_id"), start.alias("timestamp"), F.lit(0).alias("i"))
    clock = spark.range(1, 9).select(F.concat(F.lit("clock"), F.col("id").cast("string")).alias("job_id"), (start + F.make_dt_interval(mins=F.col("id"))).alias("timestamp"), F.col("id").cast("int").alias("i"))
    stream = _streamed(spark, jobs.unionByName(clock), "i", files=9)
    out = state.deliveries(stream, lambda job, attempt: job.startswith("j") and attempt <= int(job[1:]) % 7)
    return events.drained(out, work_dir(spark), spark).where("job_id like 'j%'").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(f"WITH l AS ({LOG}) SELECT action, count(*) AS n, count(DISTINCT id) AS ids FROM l GROUP BY action")
def stream_sink(spark, sf_dir):
    """Each micro-batch is written by a function of one's own, under its number, so that a batch that comes again replaces itself."""
    path, log = temporary(spark, "sink"), event_log(spark, sf_dir)
    stream = _streamed(spark, log, "sequence")
    events.drained(stream, work_dir(spark), spark, write=lambda df, n: sinks.write_parquet(df, f"{path}/batch={n}"))
    return spark.read.schema(log.schema).parquet(f"{path}/*").groupBy("action").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
