"""What both substring operators share: rows and their identity, anchors that occur more than once, covered units.

Every window of a text (50 bytes, or 35 words) holds short anchors; the smallest of them by hash stands for it. Equal
windows have equal anchors, so a window can be repeated only if its anchor is. Anchors are counted with partial
aggregation and joined back, one row for each anchor of each text: rows grow with the input, however its texts repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Rows of one anchor from which on its windows go through the shuffle one by one.
HOT_ROWS = 100_000
#: Of a batch of texts: first text, number of texts, text (from 0) and anchor of each segment, and whether a window may occur twice in it.
Cut = Callable[[list[str]], Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]]


def window_min(v: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` consecutive values, from each place on."""
    span, out = 1, v
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text (null is empty) and k1, k2: 128 bits of doc_id and text that name a row; rows alike in both are alike."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64(F.lit(34), "text", "doc_id"))


def compressed(rows: DataFrame) -> DataFrame:
    """doc_id, k1, k2 and body: the text's UTF-8 bytes, compressed, for a join that moves all texts."""

    def run(batches):
        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            body = [pack(t.encode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(body, pa.binary())], ["doc_id", "k1", "k2", "body"])

    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, body binary")


def longs(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Columns as 64-bit integers; a null is 0 (numpy would turn a column with nulls into floats)."""
    return [batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in names]


def repeated_anchors(rows: DataFrame, cut: Cut, earlier: bool) -> DataFrame:
    """uid, k1, k2, anchors, hot: the anchors of each text that occur again, those of over HOT_ROWS rows apart; uid numbers the texts.

    ``earlier``: only anchors of texts of two doc_ids count; else those that occur twice anywhere. Written.
    """

    def run(batches):
        for batch in batches:
            k1, k2, did = longs(batch, "k1", "k2", "doc_id")
            for first, n, text, anchor, twice in cut(batch.column("text").to_pylist()):
                if len(text):
                    order = np.lexsort((anchor, text))
                    text, anchor, twice = text[order], anchor[order], twice[order]
                    at = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
                    times = np.diff(np.append(at, len(text)))
                    again = (times > 1) | np.logical_or.reduceat(twice, at)
                    of = first + text[at]
                    columns = [anchor[at].view(np.int64), k1[of], k2[of], did[of], times, again]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "k1", "k2", "doc_id", "times", "again"])

    each = rows.mapInArrow(run, "anchor long, k1 long, k2 long, doc_id long, times long, again boolean")
    if earlier:
        counts = each.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("times").alias("n")).where("low < high")
    else:
        counts = each.groupBy("anchor").agg(F.sum("times").alias("n"), F.max("again").alias("again")).where("again or n > 1")
    again = written(counts.select("anchor", (F.col("n") > HOT_ROWS).alias("hot")), "repeated")
    met = each.select("anchor", "k1", "k2").join(again, "anchor")
    listed = lambda hot: F.collect_set(F.when(F.col("hot") == hot, F.col("anchor")))
    met = met.groupBy("k1", "k2").agg(listed(False).alias("anchors"), listed(True).alias("hot"))
    met = written(met.select(F.monotonically_increasing_id().alias("uid"), "*"), "anchors")
    discard(again)
    return met


def wanted(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the lists of anchors of a batch, and the anchors end to end."""
    column = batch.column(name)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def chosen(edges: np.ndarray, anchors: np.ndarray, first: int, n: int, text: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Places of the segments whose anchor is in the list of their own text; segments are sorted by text."""
    ends = np.searchsorted(text, np.arange(n + 1))
    take = [ends[i] + np.flatnonzero(np.isin(anchor[ends[i] : ends[i + 1]], anchors[edges[first + i] : edges[first + i + 1]])) for i in range(n) if ends[i + 1] > ends[i] and edges[first + i + 1] > edges[first + i]]
    return np.concatenate(take) if take else np.zeros(0, np.int64)


def covered(n: int, length: int, bits: int, start: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which of n units windows cover: bit i of a mask (``bits`` bits) is the window at start + i."""
    if not len(start):
        return np.zeros(n, bool)
    which, bit = np.nonzero((mask[:, None] >> np.arange(bits)) & 1)
    at = start[which] + bit
    step = np.bincount(at, minlength=n + length + 1) - np.bincount(at + length, minlength=n + length + 1)
    return np.cumsum(step)[:n] > 0


def finished(rows: DataFrame, spans: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """``finish(text, fields)`` of every row; fields are the numbers of its ``spans`` (an array of structs), by name."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            column = batch.column("spans")
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            edges, flat = np.concatenate([[0], np.cumsum(sizes)]), column.flatten()
            fields = {f.name: flat.field(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i, f in enumerate(flat.type)}
            out = [finish(text, {k: v[edges[i] : edges[i + 1]] for k, v in fields.items()}) for i, text in enumerate(batch.column("text").to_pylist())]
            columns = list(zip(*out)) or [[] for _ in names[1:]]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **{f: list(c) for f, c in zip(names[1:], columns)}})

    return rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
