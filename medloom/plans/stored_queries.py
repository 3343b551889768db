"""Searches over tables that are kept: an index by id and postings by term, built, and brought up to date by batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..sources.steps import temporary
from ..sources.stored import StoredIndex, StoredPostings
from ..sources.tables import table
from .catalog import PARAMS, resources
from .registry import query
from .search_queries import BIRTH, STATUS

PARTS = 8


def _dealt(spark, sf_dir, kind: str):
    """Resources dealt by id: their values and dates are found in all tasks, also where a table of little bytes is read by one."""
    return resources(spark, sf_dir, kind).repartition("id")


def _index(spark, sf_dir, *kinds: str) -> StoredIndex:
    stored = StoredIndex(spark, temporary(spark, "index"), PARTS)
    rows = None
    for kind in kinds:
        own = S.typed(S.index(_dealt(spark, sf_dir, kind), PARAMS[kind]))
        rows = own if rows is None else rows.unionByName(own)
    stored.rebuild(rows)
    return stored


def _ids(stored: StoredIndex, kind: str, text: str):
    return S.ids(stored.read().where(F.col("resource_type") == kind), PARAMS[kind], S.search(text).terms)


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE {STATUS} = 'finished' AND o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1999-01-01' AND o_orderpriority <> '1-URGENT'""")
def stored_index_search(spark, sf_dir):
    """Four terms over the stored index, dates as instants: one scan, no exchange."""
    return _ids(_index(spark, sf_dir, "Encounter"), "Encounter", "status=finished&date=ge1996-02&date=lt1999&priority:not=1-URGENT")


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 7 <> 3 AND (CASE WHEN c_custkey % 5 = 1 THEN c_custkey % 2 = 0 ELSE c_custkey % 2 = 1 END) AND {BIRTH} < DATE '1953-01-01'
    UNION ALL SELECT 'n' || c_custkey FROM customer WHERE c_custkey % 9 = 0 AND c_custkey % 2 = 1 AND {BIRTH} < DATE '1953-01-01'""")
def stored_index_updated(spark, sf_dir):
    """A batch changes the gender of every fifth patient, deletes every seventh and adds some; then a search."""
    stored, p, k = _index(spark, sf_dir, "Patient", "Location"), _dealt(spark, sf_dir, "Patient"), F.col("id").cast("bigint")
    turned = p.where((k % 5 == 1) & (k % 7 != 3)).withColumn("gender", F.when(F.col("gender") == "male", "female").otherwise("male"))
    new = p.where(k % 9 == 0).withColumn("id", F.concat(F.lit("n"), "id"))
    gone = p.where(k % 7 == 3)
    changed = turned.unionByName(new).unionByName(gone).select(F.lit("Patient").alias("resource_type"), "id")
    stored.apply(S.typed(S.index(turned.unionByName(new), PARAMS["Patient"])), changed)
    return _ids(stored, "Patient", "gender=male&birthdate=lt1953")


@query("""SELECT 'segment' AS field, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'gender', CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END, count(*) FROM customer WHERE c_custkey % 4 <> 2 GROUP BY 2""")
def stored_index_reindexed(spark, sf_dir):
    """One parameter is new and is added to the index; then resources go, and orphans of another parameter with them."""
    from ..functions import normalize as N

    stored, p = _index(spark, sf_dir, "Patient"), resources(spark, sf_dir, "Patient")
    live = p.where("cast(id as bigint) % 4 <> 2").select(F.lit("Patient").alias("resource_type"), "id")
    stored.purge(live)
    stored.reindex("Patient", "segment", S.typed(S.index(p, [S.Param("segment", "token", lambda x: N.strings(x["segment"]))])))
    return stored.read().where("field in ('segment', 'gender')").groupBy("field", "value").agg(F.count("*").alias("n"))


_STOPS = ", ".join(f"'{w}'" for w in S.STOP_WORDS)
_TEXT = f"""t AS (SELECT CAST(doc_id AS VARCHAR) AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND w NOT IN ({_STOPS}))) AS term FROM (%s)),
    p AS (SELECT id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY id) AS words FROM t GROUP BY 1, 2), n AS (SELECT count(DISTINCT id) AS n FROM p),
    w AS (SELECT term, ln(1 + (SELECT n FROM n) / count(*)) AS weight FROM p WHERE term IN ('tion', 'ndly', 'ing') GROUP BY term)
    SELECT id, round(sum(weight * tf / words), 6) AS rank FROM p JOIN w USING (term) GROUP BY id HAVING count(*) = 3"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.lit("DocumentReference").alias("resource_type"), F.col("doc_id").cast("string").alias("id"), "text")


@query("WITH " + _TEXT % "SELECT doc_id, text FROM documents")
def stored_text_rank(spark, sf_dir):
    stored = StoredPostings(spark, temporary(spark, "postings"), PARTS)
    stored.rebuild(S.postings(_docs(spark, sf_dir)))
    return S.stored_text(stored, "DocumentReference", "tion ndly ING the")


@query("WITH " + _TEXT % "SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN text || ' tion ndly ing zebra' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 2")
def stored_text_updated(spark, sf_dir):
    """Every tenth text gets new words, every tenth goes."""
    docs, k = _docs(spark, sf_dir), F.col("id").cast("bigint")
    stored = StoredPostings(spark, temporary(spark, "postings"), PARTS)
    stored.rebuild(S.postings(docs))
    longer = docs.where(k % 10 == 1).withColumn("text", F.concat("text", F.lit(" tion ndly ing zebra")))
    stored.apply(S.postings(docs.where((k % 10 == 1) | (k % 10 == 2))), S.postings(longer))
    return S.stored_text(stored, "DocumentReference", "tion ndly ing")
