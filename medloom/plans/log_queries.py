"""The change log: history, sync, subscriptions, jobs, and the same as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, history, subscriptions, sync
from ..sources import resources as R
from ..sources.tables import event_log, table
from ..streaming import events as stream_events
from .catalog import resources
from .registry import query
from .work import rows, work_dir

ACTION = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END"
LOG = f"SELECT event_id AS sequence, CAST(user_id AS VARCHAR) AS id, 'v' || event_id AS version_id, {ACTION} AS action, ts, CASE WHEN event_type <> 'error' THEN props END AS json, event_type, value FROM events"
SUBSCRIPTIONS = [("s1", "active", "Patient", "create", None), ("s2", "active", "Patient", "update", ["K"]), ("s3", "off", "Patient", "delete", None), ("s4", "active", "Encounter", "update", None), ("s5", "active", "Patient", "update", ["other"]), ("s6", "active", "Patient", "delete", [])]
SUBSCRIPTION = "subscription_id string, status string, resource_type string, event string, changed_fields array<string>"


@query(f"WITH l AS ({LOG}) SELECT sequence, version_id, lag(version_id) OVER (PARTITION BY id ORDER BY sequence) AS prev_version FROM l")
def history_prev_version(spark, sf_dir):
    return history.versions(event_log(spark, sf_dir)).select("sequence", "version_id", "prev_version")


@query(f"WITH l AS ({LOG}) SELECT sequence, last_value(json IGNORE NULLS) OVER (PARTITION BY id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_json FROM l")
def history_prev_nonnull(spark, sf_dir):
    return history.versions(event_log(spark, sf_dir)).select("sequence", "prev_json")


@query(f"WITH l AS ({LOG}) SELECT id, sequence, action, version_id FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY sequence DESC) = 1")
def events_latest(spark, sf_dir):
    return history.latest(event_log(spark, sf_dir)).select("id", "sequence", "action", "version_id")


@query(f"WITH l AS ({LOG}), m AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY sequence DESC) = 1) SELECT id, version_id, json FROM m WHERE action <> 'delete'")
def events_current_state(spark, sf_dir):
    return history.current(event_log(spark, sf_dir)).select("id", "version_id", "json")


@query(f"WITH l AS ({LOG}) SELECT sequence, id, action FROM l WHERE sequence > 500 ORDER BY sequence LIMIT 100")
def events_since_cursor(spark, sf_dir):
    return history.since(event_log(spark, sf_dir), 500, 100).select("sequence", "id", "action")


@query(f"WITH l AS ({LOG}) SELECT sequence, CASE action WHEN 'create' THEN 'POST' WHEN 'update' THEN 'PUT' ELSE 'DELETE' END AS method, CASE WHEN action = 'create' THEN 'Patient' ELSE 'Patient/' || id END AS url, 'W/\"' || version_id || '\"' AS etag FROM l")
def bundle_history_methods(spark, sf_dir):
    return history.history_bundle(event_log(spark, sf_dir)).select("sequence", "method", "url", "etag")


@query(f"""WITH l AS ({LOG}), m AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY sequence DESC) = 1) SELECT id, sequence, json FROM m WHERE action <> 'delete'""")
def write_apply_changes(spark, sf_dir):
    """The first half of each thousand events applied, then the whole log as one batch on top of it."""
    log = event_log(spark, sf_dir)
    first = history.current(log.where("sequence % 1000 < 500")).select("resource_type", "id", "sequence", "json")
    return history.applied(first, log).select("id", "sequence", "json")


@query(f"""SELECT o_custkey AS bundle_id, CAST(n AS INTEGER) AS position, CASE WHEN o_custkey % 7 = 0 THEN '400' WHEN n % 2 = 0 THEN '200' ELSE '204' END AS status, 'Encounter' AS resource_type, CAST(o_orderkey AS VARCHAR) AS id
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)
    UNION ALL SELECT o_custkey, CAST(count(*) AS INTEGER), '400', 'Encounter?x', o_custkey || '-' || count(*) FROM orders WHERE o_custkey % 7 = 0 GROUP BY o_custkey""")
def transaction_bundle(spark, sf_dir):
    """Each patient's encounters as a bundle: updates and deletes in turn; every seventh has a conditional url."""
    o = table(spark, sf_dir, "orders")
    entries = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k, i: F.struct(F.when(i % 2 == 0, "PUT").otherwise("DELETE").alias("method"), F.concat(F.lit("Encounter/"), k.cast("string")).alias("url"), F.lit("{}").alias("resource")))
    bad = F.array(F.struct(F.lit("POST").alias("method"), F.lit("Encounter?x").alias("url"), F.lit("{}").alias("resource")))
    b = o.groupBy(F.col("o_custkey").alias("bundle_id")).agg(entries.alias("entry")).withColumn("entry", F.when(F.col("bundle_id") % 7 == 0, F.concat("entry", bad)).otherwise(F.col("entry")))
    return history.transaction(b).select("bundle_id", "position", "status", "resource_type", "id")


@query("SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey % 5 = 2")
def reference_missing(spark, sf_dir):
    live = resources(spark, sf_dir, "Patient").where("cast(id as bigint) % 5 <> 2").select("resourceType", "id")
    return history.missing(resources(spark, sf_dir, "Encounter"), F.col("subject.reference"), live).select("id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def id_registry_duplicates(spark, sf_dir):
    return history.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Patient/' || o_custkey AS reference, 'Patient' AS resource_type, CAST(o_custkey AS VARCHAR) AS target FROM orders")
def reference_collect(spark, sf_dir):
    e = resources(spark, sf_dir, "Encounter")
    return R.references(e.select("id", F.to_json(F.struct(*e.columns)).alias("json")))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS id, '{"id":"' || n_nationkey || '","name":"' || n_name || '","resourceType":"Location"}' AS json, sha256('{"id":"' || n_nationkey || '","name":"' || n_name || '","resourceType":"Location"}') AS hash FROM nation""")
def resource_canonical_hash(spark, sf_dir):
    p = resources(spark, sf_dir, "Location").where("partOf is not null")
    return R.envelope(p.select(F.format_string('{ "resourceType":"Location",  "name": "%s", "id":"%s"}', "name", "id").alias("json"))).select("id", "json", "hash")


PUSHED = """p AS (SELECT event_id, event_id AS sequence, user_id % 8 AS node, CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS id,
        CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS action, 'v' || (CAST(floor(value + 0.5) AS BIGINT) % 3) AS base FROM events),
    h AS (SELECT CAST(user_id AS VARCHAR) AS id, 'v' || (user_id % 3) AS cur FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 4 <> 0)),
    a AS (SELECT p.*, CASE WHEN p.event_id % 10 = 0 THEN 'already_processed' WHEN p.id IS NULL THEN 'needs_retry' WHEN action = 'create' AND cur IS NOT NULL THEN 'rejected' WHEN action <> 'create' AND cur IS NULL THEN 'rejected'
        WHEN action <> 'create' AND base IS DISTINCT FROM cur THEN 'conflicted' ELSE 'accepted' END AS ack FROM p LEFT JOIN h ON p.id = h.id)"""


def _acked(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    log = event_log(spark, sf_dir)
    pushed = log.select(
        F.col("sequence").alias("event_id"), "sequence", (F.col("id").cast("bigint") % 8).alias("node"), "resource_type", F.when(F.col("sequence") % 97 != 0, F.col("id")).alias("id"), "action",
        F.concat(F.lit("v"), (F.floor(F.col("value") + 0.5) % 3).cast("string")).alias("base_version"),
    )
    hub = e.where("user_id % 4 <> 0").select(F.lit("Patient").alias("resource_type"), F.col("user_id").cast("string").alias("id"), F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("current_version")).distinct()
    return sync.judged(pushed, hub, e.where("event_id % 10 = 0").select("event_id"))


@query("WITH " + PUSHED + " SELECT sequence, ack FROM a")
def sync_stale_base(spark, sf_dir):
    return _acked(spark, sf_dir).select("sequence", "ack")


@query("WITH " + PUSHED + " SELECT count(*) AS proposed, count(*) FILTER (ack = 'accepted') AS applied, count(*) FILTER (ack <> 'accepted') AS skipped, max(sequence) AS last_sequence FROM a")
def sync_ack_summary(spark, sf_dir):
    return sync.summary(_acked(spark, sf_dir))


@query("WITH " + PUSHED + ", s AS (SELECT node, min(sequence) FILTER (ack = 'needs_retry') AS stop FROM a GROUP BY node) SELECT a.node, max(sequence) AS cursor FROM a JOIN s ON a.node = s.node WHERE stop IS NULL OR sequence < stop GROUP BY a.node")
def push_cursor_advance(spark, sf_dir):
    return sync.cursor(_acked(spark, sf_dir))


@query("SELECT event_id FROM events WHERE event_id % 3 <> 1")
def sync_dedupe_apply(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return sync.deduplicated(e.unionByName(e.where("event_id % 2 = 0")), e.where("event_id % 3 = 1"))


@query(f"""WITH l AS ({LOG}), b AS (SELECT *, CAST(id AS BIGINT) % 4 AS node FROM l), c AS (SELECT *, (row_number() OVER (PARTITION BY node ORDER BY sequence) - 1) // 100 AS batch FROM b)
    SELECT sequence, node, batch, row_number() OVER (PARTITION BY node, batch ORDER BY action = 'delete', sequence) AS position FROM c""")
def sync_push_batches(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("node", F.col("id").cast("bigint") % 4)
    return sync.batches(log).select("sequence", "node", "batch", F.col("position").cast("long").alias("position"))


@query(f"WITH l AS ({LOG}), m AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY sequence DESC) = 1) SELECT l.sequence, l.id, m.version_id AS current_version FROM l LEFT JOIN (SELECT * FROM m WHERE action <> 'delete') m ON l.id = m.id WHERE l.sequence > 700")
def sync_pull(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return sync.pulled(log, history.current(log), 700).select("sequence", "id", "current_version")


_HUB = f"WITH l AS ({LOG}), s AS (SELECT *, coalesce(last_value(CASE WHEN action <> 'update' THEN action = 'create' END IGNORE NULLS) OVER (PARTITION BY id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS present FROM l) SELECT sequence, id, action, CASE WHEN present <> (action = 'create') THEN 'accepted' ELSE 'rejected' END AS ack FROM s"


def _log_stream(spark, sf_dir):
    # a pattern: streams take the files of a folder or of a pattern, and the table may be one file
    raw = stream_events.read(spark, f"{sf_dir}/event[s].parquet", table(spark, sf_dir, "events").schema)
    action = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("update")
    return raw.select(F.col("event_id").alias("sequence"), F.lit("Patient").alias("resource_type"), F.col("user_id").cast("string").alias("id"), action.alias("action"), F.col("ts").cast("timestamp").alias("timestamp"), "event_type", F.when(action != "delete", F.col("props")).alias("json"))


@query(_HUB)
def stream_hub_acks(spark, sf_dir):
    return stream_events.drained(stream_events.hub(_log_stream(spark, sf_dir)), work_dir(spark), spark)


@query(f"""WITH l AS ({LOG}), p AS (SELECT *, last_value(json IGNORE NULLS) OVER (PARTITION BY id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM l)
    SELECT 's1:' || sequence AS job_id, sequence, 's1' AS subscription_id FROM p WHERE action = 'create'
    UNION ALL SELECT 's2:' || sequence, sequence, 's2' FROM p WHERE action = 'update' AND json IS DISTINCT FROM old
    UNION ALL SELECT 's6:' || sequence, sequence, 's6' FROM p WHERE action = 'delete'""")
def subscription_match(spark, sf_dir):
    log = history.versions(event_log(spark, sf_dir)).withColumn("changed", subscriptions.changed_fields("prev_json", "json"))
    return subscriptions.matched(log, rows(spark, SUBSCRIPTIONS, SUBSCRIPTION)).select("job_id", "sequence", "subscription_id")


@query(f"WITH l AS ({LOG}) SELECT 's1:' || sequence AS job_id, sequence, 's1' AS subscription_id FROM l WHERE action = 'create' UNION ALL SELECT 's2:' || sequence, sequence, 's2' FROM l WHERE action = 'update' UNION ALL SELECT 's6:' || sequence, sequence, 's6' FROM l WHERE action = 'delete'")
def stream_events_match(spark, sf_dir):
    log = _log_stream(spark, sf_dir).withColumn("changed", subscriptions.changed_fields(F.lit(None).cast("string"), "json"))
    found = stream_events.matches(log, rows(spark, SUBSCRIPTIONS, SUBSCRIPTION))
    return stream_events.drained(found, work_dir(spark), spark).select("job_id", "sequence", "subscription_id")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2
    HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_window_counts(spark, sf_dir):
    out = stream_events.window_counts(_log_stream(spark, sf_dir), "1 hour", "10 minutes", "event_type")
    return stream_events.drained(out, work_dir(spark), spark).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id AS sequence FROM events")
def stream_dedupe(spark, sf_dir):
    """Each event comes twice in the stream and once out of it."""
    log = _log_stream(spark, sf_dir).select("sequence", "timestamp")
    twice = log.withColumn("sequence", F.explode(F.array("sequence", "sequence")))
    return stream_events.drained(stream_events.once(twice, "1 hour", "sequence"), work_dir(spark), spark).select("sequence")


@query("SELECT event_id AS job_id FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0")
def delivery_pending(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("job_id"), "user_id")
    return subscriptions.pending(jobs, jobs.where("user_id % 2 = 1")).select("job_id")


@query("SELECT event_id AS job_id, event_type AS type FROM events WHERE user_id % 3 = 0 AND ts <= TIMESTAMP '2024-01-15' AND event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) = 1")
def job_claim_next(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    jobs = e.select(F.col("event_id").alias("job_id"), F.col("event_type").alias("type"), F.when(F.col("user_id") % 3 == 0, "pending").otherwise("completed").alias("status"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 2 == 1, F.col("ts")).otherwise(F.lit("2025-01-01").cast("timestamp_ntz")).alias("run_after"))
    return subscriptions.claimable(jobs, F.lit("2024-01-15").cast("timestamp_ntz")).select("job_id", "type")


@query("SELECT event_id AS job_id, least(CAST(pow(2, event_id % 9) AS BIGINT), 60) AS seconds FROM events")
def retry_schedule(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), subscriptions.backoff(F.col("event_id") % 9 + 1).alias("seconds"))


@query("SELECT event_id AS job_id, CASE WHEN event_id % 3 = 0 THEN 'completed' WHEN event_id % 7 + 1 >= 5 THEN 'failed' ELSE 'pending' END AS status, CAST(event_id % 7 + 1 AS BIGINT) AS attempts FROM events")
def job_after_attempt(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    jobs = e.select(F.col("event_id").alias("job_id"), F.lit("running").alias("status"), (F.col("event_id") % 7).alias("attempts"), F.col("ts").cast("timestamp").alias("run_after"))
    return subscriptions.after_attempt(jobs, F.col("job_id") % 3 == 0, F.current_timestamp()).select("job_id", "status", "attempts")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND user_id = 8 AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts, event_id LIMIT 20")
def audit_filtered(spark, sf_dir):
    return audit.listed(table(spark, sf_dir, "events"), 20, since=F.lit("2024-01-05").cast("timestamp_ntz"), event_type="error", user_id=8).select("event_id", "user_id")


@query("SELECT 'read' AS kind, 'user/' || user_id AS actor, CAST(value AS VARCHAR) AS value, ts FROM events WHERE event_type = 'view'")
def audit_records(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    return audit.records(e, "read", F.concat(F.lit("user/"), F.col("user_id").cast("string")), {"value": F.col("value")}, F.col("ts")).select("kind", "actor", F.col("details")["value"].alias("value"), "ts")


@query("SELECT ts, CAST(user_id AS VARCHAR) AS \"user\", value FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-20'")
def analytics_by_name_since(spark, sf_dir):
    rows_ = audit.analytics(table(spark, sf_dir, "events"), F.col("event_type"), F.col("ts"), {"user": F.col("user_id")}, {"value": F.col("value")})
    return audit.named(rows_, "purchase", F.lit("2024-01-20").cast("timestamp_ntz")).select("ts", F.col("dimensions")["user"].alias("user"), F.col("values")["value"].alias("value"))
