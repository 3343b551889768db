"""Ranked lexical search by TPUT (Cao and Wang 2004) over postings partitioned by term.

Index. One pass over the documents counts terms; a posting (term, document) holds its share of a score, which no query changes. Postings
are dealt by ranges of (term, share), so that a term's list is in order of its shares, and a list of any length lies
in as many parts as it needs.

Search, for all items at once. First, the head of each list (HEADS * k entries) gives partial sums; their k-th is a lower bound of
the k-th score. A document that reaches that bound has a share of at least bound / lists in some list. Second, each list
gives all entries from that threshold on; the new sums give a better bound, and with the threshold in place of each share
not seen, an upper bound for every document. Third, the exact scores of those that can still be among the first are looked up.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words
from .common import discard, written

K = 50
#: Entries of a list's head for each result asked for: with more of them the first bound comes nearer to the final one.
HEADS = 8
#: Part of bound / lists that is the threshold: with a lower one more is fetched and less is left open.
ALPHA = 4
#: Fixed value: bytes that belong to terms. A text's other bytes end a term.
TERM_BYTES = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_FOLD = bytes(b if b in TERM_BYTES else 32 for b in range(256)).lower()
FILTER_BITS = 20
#: Pairs of an item and a term up to which they are sent to every task, however many files they lie in; with more of them Spark chooses.
SENT_PAIRS = 1 << 18
COUNTED = "row long, doc_id long, term string, tf long, n long"


def terms_of(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the different terms of each item; rows of one item_id are one item, rows without item_id none."""

    def run(batches):
        for batch in batches:
            pairs = [(i, t) for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()) for t in dict.fromkeys(terms_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary()).cast(pa.string())], ["item_id", "term"])

    return items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term string").distinct()


def term_filter(terms: DataFrame) -> np.ndarray:
    """A table of fixed size that says of a term's hash whether it may be one of ``terms`` (as a Bloom filter does)."""
    slot = F.crc32("term").bitwiseAND((1 << FILTER_BITS) - 1)
    keep = np.zeros(1 << FILTER_BITS, bool)
    keep[[r[0] for r in terms.select(slot).distinct().collect()]] = True
    return keep


def counted(docs: DataFrame, keep: np.ndarray | None = None) -> DataFrame:
    """row, doc_id, term, tf, n (the row's terms with repeats) of each row of ``docs`` and each of its terms that ``keep`` lets pass.

    Rows without a term (null) hold totals of a part: tf documents with some term, n terms with repeats.
    """
    shared = None if keep is None else docs.sparkSession.sparkContext.broadcast(keep.tobytes())
    mask = (1 << FILTER_BITS) - 1

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        wanted = None if shared is None else shared.value
        crc = zlib.crc32
        known: dict[bytes, int] = {}

        def passes(term: bytes) -> int:
            if len(known) > words.CHUNK:
                known.clear()
            known[term] = yes = wanted[crc(term) & mask]
            return yes

        def batch_of(terms, tfs, sizes, ids, lengths, first):
            k = len(ids)
            rows = np.append(np.repeat(np.arange(first, first + k), sizes), 0)
            doc = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(k), sizes)))
            lengths = np.array(lengths, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.concat_arrays([doc, pa.nulls(1, pa.int64())]), pa.array([*terms, None], pa.binary()).cast(pa.string()), pa.array([*tfs, int((lengths > 0).sum())], pa.int64()), pa.array(np.append(np.repeat(lengths, sizes), lengths.sum()))],
                ["row", "doc_id", "term", "tf", "n"],
            )

        for batch in batches:
            texts, doc_ids = batch.column("text"), batch.column("doc_id").to_pylist()
            terms, tfs, sizes, ids, lengths, first = [], [], [], [], [], row
            for i in range(batch.num_rows):
                found = terms_of(texts[i].as_py())
                tf = Counter(found)
                if wanted is not None:
                    get = known.get
                    tf = {t: c for t, c in tf.items() if (y := get(t)) or (y is None and passes(t))}
                terms.extend(tf)
                tfs.extend(tf.values())
                sizes.append(len(tf))
                ids.append(doc_ids[i])
                lengths.append(len(found))
                row += 1
                if len(terms) >= words.CHUNK // 8 or i == batch.num_rows - 1:
                    yield batch_of(terms, tfs, sizes, ids, lengths, first)
                    terms, tfs, sizes, ids, lengths, first = [], [], [], [], [], row

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTED)


def index(docs: DataFrame, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, lists): term, share, row, doc_id of each posting, in order; term, df, weight of each list.

    With ``terms``, only of lists that may be asked for. Counts are those of all documents and whole texts in both cases.
    """
    seen = written(counted(docs, None if terms is None else term_filter(terms)), "counted")
    n_docs, n_terms = (int(x or 0) for x in seen.where("term is null").agg(F.sum("tf"), F.sum("n")).first())
    weight = F.floor(F.lit(1000) * F.log((F.lit(2.0 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    lists = written(seen.where("term is not null").groupBy("term").agg(F.count("*").alias("df")).withColumn("weight", weight), "lists")
    m = f"50 + (50 * n * {n_docs}L) div {max(1, n_terms)}L"
    share = F.expr(f"weight * ((1000000000L * tf) div (1000 * tf + 20 * ({m})))")
    postings = seen.where("term is not null").join(lists, "term").select("term", share.alias("share"), "row", "doc_id").where("share > 0")
    postings = written(postings.repartitionByRange("term", F.desc("share"), "row").sortWithinPartitions("term", F.desc("share"), "row"), "postings")
    discard(seen)
    return postings, lists


def _kth(sums: DataFrame, k: int, name: str) -> DataFrame:
    """item_id and the k-th largest of its sums; items with fewer documents are left out."""
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("sum"), "row"))
    return sums.withColumn("place", place).where(F.col("place") == k).select("item_id", F.col("sum").alias(name))


def search(postings: DataFrame, lists: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 of each item (``item_terms``), ties by doc_id, then by row."""
    asked = queries.join(lists.select("term"), "term")
    asked = written(asked.join(asked.groupBy("item_id").agg(F.count("*").alias("lists")), "item_id"), "asked")
    sent = F.broadcast if asked.limit(SENT_PAIRS + 1).count() <= SENT_PAIRS else lambda df: df

    # 1: heads of the lists
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("share"), "row"))
    heads = written(postings.join(sent(asked.select("term").distinct()), "term", "left_semi").select("term", "share", "row", place.alias("place")).where(F.col("place") <= HEADS * k), "heads")
    partial = heads.join(sent(asked), "term").groupBy("item_id", "row").agg(F.sum("share").alias("sum"))
    bound = _kth(partial, k, "bound")
    least = F.greatest(F.lit(1).cast("long"), F.expr(f"(coalesce(bound, 0) + {ALPHA} * lists - 1) div ({ALPHA} * lists)"))
    asked = asked.join(bound, "item_id", "left").join(heads.groupBy("term").agg(F.max("share").alias("top")), "term")
    # what a list may still give where it is not seen: less than the threshold, and no more than its first entry
    asked = asked.select("item_id", "term", F.coalesce("bound", F.lit(0)).alias("bound"), least.alias("least"), F.least(least - 1, "top").alias("most"))
    asked = written(asked.join(asked.groupBy("item_id").agg(F.sum("most").alias("all_most")), "item_id"), "thresholds")

    # 2: all entries from the threshold on. An entry moves once, to its row's partition, whatever the items that ask for it: from
    # the lowest of the list's thresholds on. Partitioned by row, sums by item and row need no further exchange: joined by a sort instead, every
    # entry of every item that asks for it would move again
    lowest = asked.groupBy("term").agg(F.min("least").alias("lowest"))
    entries = postings.join(sent(lowest), "term").where("share >= lowest").select("term", "share", "row", "doc_id").repartition("row")
    fetched = entries.join(sent(asked), "term").where("share >= least")
    fetched = fetched.groupBy("item_id", "row").agg(F.sum("share").alias("sum"), F.first("doc_id").alias("doc_id"), (F.first("all_most") - F.sum("most")).alias("open"), F.first("bound").alias("bound"))
    fetched = written(fetched.where("sum + open >= bound").drop("bound"), "fetched")
    bound = _kth(fetched, k, "bound")
    able = fetched.join(bound, "item_id", "left").where("sum + open >= coalesce(bound, 0)")
    able = written(able.select("item_id", "row", "doc_id", "sum", (F.col("open") == 0).alias("exact")), "candidates")
    discard(fetched, heads)

    # 3: exact scores
    look = able.where("not exact").select("item_id", "row")
    found = postings.join(look, "row").join(asked.select("item_id", "term"), ["item_id", "term"]).groupBy("item_id", "row").agg(F.first("doc_id").alias("doc_id"), F.sum("share").alias("sum"))
    scored = able.where("exact").select("item_id", "row", "doc_id", "sum").unionByName(found)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("sum"), F.asc_nulls_first("doc_id"), "row"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", F.col("sum").alias("score"))


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score of the best documents of each item.

    Each row of ``docs`` is a document, also where doc_ids repeat or are null (null comes first among equal scores). Null texts have no terms.
    Items without a term that some document holds have no rows; so has everything if a table is empty. Other columns are not read.
    """
    queries = written(item_terms(items), "items")
    return search(*index(docs, queries), queries, k)
