"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

Documents go to shards of bounded size by a hash of doc_id, and each shard packs its own, longest first. Open bins
are ordered by what room is left; each carries a bitmap of the duplicate clusters it holds and a stack of bitmaps
of the sources (bitmap k: sources held more than k times). For a document the search starts at the tightest room
that fits and goes on to the next larger one until a bin is compatible: it holds no document of the same cluster
and fewer than ``per_source`` of the same source. So each document gets the tightest compatible bin, or a new one.

Documents longer than a bin are cut into pieces: whole bins of their own, and a last piece that is packed.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, n_words

CAPACITY = 4096
SHARD_DOCS = 8192
PER_SOURCE = 8

PACKED = "doc_id long, source string, piece int, n_tokens long, shard long, bin long, slot int, start long"


class Bins:
    """Open bins by room left: ``rooms`` is sorted, ``at`` has the bins of each room in order of opening."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.rooms: list[int] = []
        self.at: dict[int, list[int]] = {}
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.used: list[int] = []
        self.docs: list[int] = []

    def compatible(self, b: int, cluster: int, source: int) -> bool:
        planes = self.sources[b]
        return not self.clusters[b] & cluster and (len(planes) < self.per_source or not planes[-1] & source)

    def open(self) -> int:
        self.clusters.append(0)
        self.sources.append([])
        self.used.append(0)
        self.docs.append(0)
        return len(self.used) - 1

    def find(self, size: int, cluster: int, source: int) -> int:
        """The bin with the least room that fits and is compatible; it leaves the order. A new one if there is none."""
        for i in range(bisect_left(self.rooms, size), len(self.rooms)):
            own = self.at[self.rooms[i]]
            for k, b in enumerate(own):
                if self.compatible(b, cluster, source):
                    own.pop(k)
                    if not own:
                        del self.at[self.rooms.pop(i)]
                    return b
        return self.open()

    def put(self, b: int, size: int, cluster: int, source: int) -> tuple[int, int]:
        """Slot and first token of the document in the bin."""
        slot, start = self.docs[b], self.used[b]
        self.docs[b] += 1
        self.used[b] += size
        self.clusters[b] |= cluster
        planes = self.sources[b]
        for k, plane in enumerate(planes):
            if not plane & source:
                planes[k] |= source
                break
        else:
            planes.append(source)
        room = self.capacity - self.used[b]
        if room > 0:
            if room not in self.at:
                insort(self.rooms, room)
                self.at[room] = []
            self.at[room].append(b)
        return slot, start


def pack_shard(pdf: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "key", "doc_id", "copy"], ascending=[False, True, True, True], kind="stable", na_position="last")
    repeated = pdf["cluster"][pdf["cluster"].duplicated()]
    bit_c = {c: 1 << i for i, c in enumerate(pd.unique(repeated))}  # a cluster of one document here conflicts with nothing
    bit_s = {s: 1 << i for i, s in enumerate(pd.unique(pdf["source"]))}
    bins, out = Bins(capacity, per_source), []
    tails = []
    for doc, source, n, cluster in zip(pdf["doc_id"], pdf["source"], pdf["n_tokens"], pdf["cluster"]):
        piece = 0
        while n > capacity:
            out.append((doc, source, piece, capacity, bins.open(), 0, 0))
            n, piece = n - capacity, piece + 1
        tails.append((n, len(tails), doc, source, piece, cluster))
    tails.sort(key=lambda x: (-x[0], x[1]))
    for n, _, doc, source, piece, cluster in tails:
        c, s = bit_c.get(cluster, 0), bit_s[source]
        b = bins.find(n, c, s)
        slot, start = bins.put(b, n, c, s)
        out.append((doc, source, piece, n, b, slot, start))
    done = pd.DataFrame(out, columns=["doc_id", "source", "piece", "n_tokens", "bin", "slot", "start"])
    done["doc_id"] = done["doc_id"].astype("Int64")
    return done.assign(shard=pdf["shard"].iloc[0])[["doc_id", "source", "piece", "n_tokens", "shard", "bin", "slot", "start"]]


def pack(docs: DataFrame, cluster: str | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, source, piece, n_tokens, shard, bin, slot, start: where each piece of each row is packed.

    ``cluster`` names a column of duplicate clusters; without it, rows of the same text (up to white space) are
    one cluster. Tokens are words. Every row is packed, an empty or null text with 0 tokens; a null source counts as
    one source; repeated rows are packed as often as they occur. (shard, bin) names a bin. An empty table packs
    to nothing.
    """
    of = F.xxhash64(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")) if cluster is None else F.xxhash64(F.col(cluster))
    rows = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("source"), n_words("text").alias("n_tokens"), of.alias("cluster"), F.xxhash64("doc_id", of).alias("key"))
    units = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    shards = max(1, -(-docs.count() // shard_docs))
    each = units.select(*rows.columns, F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    dealt = each.withColumn("shard", F.pmod(F.xxhash64("key", "copy"), F.lit(shards).cast("long")))
    return dealt.groupBy("shard").applyInPandas(lambda pdf: pack_shard(pdf, capacity, per_source), PACKED)
