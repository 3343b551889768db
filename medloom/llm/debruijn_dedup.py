"""Substring dedup over words by de Bruijn compaction (in the way of Chikhi, Limasset, Medvedev 2016).

Edges are windows of 35 words, nodes their 34 words. Edges are filed under their smallest anchor (a run of ANCHOR words), so
neighbouring edges of a text mostly arrive as one compacted stretch of at most LONGEST edges. Then

1. stretches whose anchor occurs once anywhere are left (see anchors.py);
2. equal stretches (128 bits of their very words) are one path: as a whole it occurs as often as they do;
3. where one anchor has several paths, the graph branches: one source of each path is read at its coordinates and opened
   into edges, which are counted by their words;
4. a path whose edges all repeat is joined to the path behind it where neither has another neighbour, by Spark joins that
   double the length reached each time: maximal nonbranching paths, each with a source (row, first word);
5. every occurrence of such a path is read at its coordinates and compared with 128 bits of the source's words there; one
   that differs would not be removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import anchors, words
from .common import discard, written

LENGTH = 35
ANCHOR = 8
#: Edges of a stretch at most.
LONGEST = LENGTH - ANCHOR + 1
BLOCK = 1 << 20
#: Paths of one anchor from which on edges go through the shuffle one by one, and edges that one cell counts.
OPEN_PATHS = 50_000
CELL_EDGES = 200_000
PATH = ["anchor", "d1", "d2", "n"]


def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    h = a * words.BASE
    h += b * words.MIX_A
    h ^= h >> np.uint64(32)
    h *= words.MIX_B
    return h


class Stretches:
    """Of a batch of texts: text (from 0), first word, number of edges, anchor, whether an edge may occur twice; and their words."""

    def __init__(self, text, start, n, anchor, twice, word, data, begin, end):
        self.text, self.start, self.n, self.anchor, self.twice, self.word = text, start, n, anchor, twice, word
        self.data, self.begin, self.end = data, begin, end

    def pick(self, at: np.ndarray) -> Stretches:
        return Stretches(*(x[at] for x in (self.text, self.start, self.n, self.anchor, self.twice, self.word)), self.data, self.begin, self.end)

    def spelled(self) -> list[bytes]:
        """The words of each stretch, with one space between."""
        return [self.data[a:b] for a, b in zip(self.begin[self.word].tolist(), self.end[self.word + self.n + LENGTH - 2].tolist())]


def spelled(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of ``data`` with one space between, their starts and ends there, their hashes, and starts in ``data``."""
    h, starts, ends = words.word_hashes(data)
    a = np.frombuffer(data, np.uint8)
    size = ends - starts
    begin = np.concatenate([[0], np.cumsum(size + 1)])[: len(size)].astype(np.int64)
    solid = np.zeros(len(a) + 1, np.int8)
    solid[starts] += 1
    np.subtract.at(solid, ends, 1)
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = a[np.cumsum(solid[:-1]) > 0]
    return out.tobytes(), begin, begin + size, h, starts


def stretches(texts: list[str | None]):
    """(first text, texts, Stretches) of batches of texts; texts of over BLOCK words come in blocks that count from their own first word."""
    for first, n, data, begin in words.batches(texts):
        joined, low, high, h, starts = spelled(data)
        doc = np.searchsorted(begin, starts, "right") - 1
        count = np.bincount(doc, minlength=n)
        edge = np.concatenate([[0], np.cumsum(count)])
        place = np.arange(len(h)) - edge[doc]
        at = 0
        for i in [*np.flatnonzero(count > BLOCK), n]:
            yield first, n, _stretches(h, doc, place, at, edge[i], joined, low, high)
            for s in range(edge[i], edge[i + 1], BLOCK) if i < n else ():
                yield first, n, _stretches(h, doc, place, s, min(s + BLOCK + LENGTH - 1, edge[i + 1]), joined, low, high)
            at = edge[min(i + 1, n)]


def _stretches(h, doc, place, a: int, b: int, *spelled_) -> Stretches:
    h, doc, place = h[a:b], doc[a:b], place[a:b]
    m = len(h) - LENGTH + 1
    if m < 1:
        e = np.zeros(0, np.int64)
        return Stretches(e, e, e, e.astype(np.uint64), e.astype(bool), e, *spelled_)
    two = pairs(h[:-1], h[1:])
    four = pairs(two[:-2], two[2:])
    eight = pairs(four[:-4], four[4:])
    sixteen = pairs(eight[:-8], eight[8:])
    half = pairs(sixteen[:-16], sixteen[16:])
    inside = np.flatnonzero(doc[:m] == doc[LENGTH - 1 :])
    text, start, word = doc[inside], place[inside], a + inside
    anchor, edge = anchors.window_min(eight, LONGEST)[:m][inside], pairs(half[:m], half[3 : 3 + m])[inside]
    if not len(text):
        return Stretches(text, start, start, anchor, text.astype(bool), word, *spelled_)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    offset = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))
    at = np.flatnonzero(offset % LONGEST == 0)
    n = np.diff(np.append(at, len(text)))
    twice, last = np.zeros(len(text), bool), np.repeat(at + n, n)
    for p in range(1, min(LONGEST, len(edge))):
        same = np.flatnonzero(edge[p:] == edge[:-p])
        twice[same[same + p < last[same]]] = True
    return Stretches(text[at], start[at], n, anchor[at], np.logical_or.reduceat(twice, at), word[at], *spelled_)


def cut(texts: list[str | None]):
    for first, n, s in stretches(texts):
        yield first, n, s.text, s.anchor, s.twice


def digests(spelled_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each, as two integers."""
    d = np.frombuffer(b"".join(hashlib.md5(x).digest() for x in spelled_), np.int64).reshape(-1, 2)
    return d[:, 0], d[:, 1]


def _found(batches):
    """The stretches of texts whose anchors are repeated."""
    for batch in batches:
        k1, k2 = anchors.longs(batch, "k1", "k2")
        edges, known = anchors.wanted(batch, "anchors")
        for first, n, s in stretches(batch.column("text").to_pylist()):
            s = s.pick(anchors.chosen(edges, known, first, n, s.text, s.anchor))
            d1, d2 = digests(s.spelled())
            columns = [s.anchor.view(np.int64), d1, d2, s.n.astype(np.int32), s.start.astype(np.int64), k1[first + s.text], k2[first + s.text], s.twice]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*PATH, "start", "k1", "k2", "twice"])


def _opened(batches):
    """The words of the paths asked for, read at their sources."""
    for batch in batches:
        asked = batch.column("asked")
        edges = np.concatenate([[0], np.cumsum(asked.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        flat = asked.flatten()
        fields = {f.name: flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, f in enumerate(flat.type)}
        for first, n, s in stretches(batch.column("text").to_pylist()):
            ends = np.searchsorted(s.text, np.arange(n + 1))
            mine, theirs = [], []
            for i in range(n):
                own, q = s.start[ends[i] : ends[i + 1]], fields["start"][edges[first + i] : edges[first + i + 1]]
                at = np.searchsorted(own, q)
                here = np.flatnonzero(at < len(own))
                here = here[own[at[here]] == q[here]]
                mine.append(ends[i] + at[here])
                theirs.append(edges[first + i] + here)
            mine, theirs = np.concatenate(mine), np.concatenate(theirs)
            columns = [pa.array(fields[c][theirs]) for c in (*PATH, "times")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(s.pick(mine).spelled(), pa.binary())], [*PATH, "times", "words"])


def _edges(path: bytes, n: int) -> list[bytes]:
    """The edges of a path, as their words."""
    a = np.concatenate([[-1], np.flatnonzero(np.frombuffer(path, np.uint8) == 32), [len(path)]])
    return [path[x:y] for x, y in zip((a[:n] + 1).tolist(), a[LENGTH : LENGTH + n].tolist())]


def _counted(t: pa.Table) -> pa.Table:
    """How often each edge of the paths of a cell occurs."""
    seen: dict[bytes, int] = {}
    paths = {}  # repeated rows open the same path
    for a, d1, d2, n, times, path in zip(*(t[c].to_pylist() for c in (*PATH, "times", "words"))):
        paths[a, d1, d2, n] = (times, path)
    for (_, _, _, n), (times, path) in paths.items():
        for e in _edges(path, n):
            seen[e] = seen.get(e, 0) + times
    found = [[seen[e] for e in _edges(path, key[3])] for key, (_, path) in paths.items()]
    keys = np.array(list(paths), np.int64).reshape(-1, 4)
    return pa.table({**{c: pa.array(keys[:, i]) for i, c in enumerate(PATH)}, "found": pa.array(found, pa.list_(pa.int64()))})


def _counted_apart(many: DataFrame) -> DataFrame:
    """As _counted, for anchors of very many paths: edge by edge through the shuffle, whatever their number."""

    def unpacked(batches):
        for batch in batches:
            each = [_edges(p, n) for p, n in zip(batch.column("words").to_pylist(), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*PATH, "times")), pa.array(each, pa.list_(pa.binary()))], [*PATH, "times", "edges"])

    many = many.dropDuplicates(PATH)
    each = many.mapInArrow(unpacked, "anchor long, d1 long, d2 long, n long, times long, edges array<binary>").select(*PATH, "times", F.posexplode("edges").alias("i", "edge"))
    total = each.groupBy("edge").agg(F.sum("times").alias("total"))
    at = each.join(total, "edge").groupBy(*PATH).agg(F.sort_array(F.collect_list(F.struct("i", "total"))).alias("all"))
    return at.select(*PATH, F.transform("all", lambda x: x["total"]).alias("found"))


def repeated_edges(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences of paths with what of them is repeated: PATH, start, k1, k2, mask (bit i: edge i is repeated). Written."""
    met = anchors.repeated_anchors(rows, cut, earlier=False)
    both = met.select("k1", "k2", F.concat("anchors", "hot").alias("anchors"))
    found = rows.join(both, ["k1", "k2"]).mapInArrow(_found, "anchor long, d1 long, d2 long, n int, start long, k1 long, k2 long, twice boolean")
    found = written(found, "stretches")
    discard(met)
    own = F.min(F.struct("k1", "k2", "start")).alias("own")
    paths = written(found.groupBy(*PATH).agg(own, F.count("*").alias("times"), F.max("twice").alias("twice")), "paths")
    branching = paths.groupBy("anchor").agg(F.count("*").alias("paths"), F.max("twice").alias("again")).where("paths > 1 or again").select("anchor", "paths")
    branching = written(branching, "branching")  # written, so that the join can split a very common anchor
    open_ = written(paths.join(branching, "anchor"), "open")

    def opened(part: DataFrame) -> DataFrame:
        asked = F.collect_list(F.struct("own.start", *PATH, "times")).alias("asked")
        texts = rows.join(part.groupBy("own.k1", "own.k2").agg(asked), ["k1", "k2"])
        return texts.mapInArrow(_opened, "anchor long, d1 long, d2 long, n long, times long, words binary")

    few, many = open_.where(F.col("paths") <= OPEN_PATHS), open_.where(F.col("paths") > OPEN_PATHS)
    cells = max(1, -(-(few.agg(F.sum("n")).first()[0] or 0) // CELL_EDGES))
    cell = F.pmod(F.xxhash64("anchor"), F.lit(cells)).alias("cell")
    counted = [written(opened(few).groupBy(cell).applyInArrow(_counted, "anchor long, d1 long, d2 long, n long, found array<long>"), "counted")]
    if not many.isEmpty():
        counted.append(written(_counted_apart(opened(many)), "counted"))
    discard(open_)
    verdicts = paths.select(*PATH, "times").join(counted[0] if len(counted) == 1 else counted[0].unionByName(counted[1]), PATH, "left")
    bits = F.expr("aggregate(transform(found, (x, i) -> if(x > 1, shiftleft(1L, i), 0L)), 0L, (t, x) -> t | x)")
    whole = F.expr("if(times > 1, shiftleft(1L, n) - 1L, 0L)")
    masks = verdicts.select(*PATH, F.when(F.col("found").isNull(), whole).otherwise(bits).alias("mask")).where("mask <> 0")
    out = written(found.join(masks, PATH).select(*PATH, "start", "k1", "k2", "mask"), "repeats")
    discard(found, paths, *counted)
    return out


def compacted(repeats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Maximal nonbranching paths of two stretches or more: heads (d1, d2, edges) and the members behind a head (d1, d2). Written.

    A stretch whose edges all repeat is joined to the one behind it if that is so in all texts, seen from either one.
    """
    whole = repeats.where("mask = shiftleft(1L, n) - 1L").select("k1", "k2", "start", "n", "d1", "d2").distinct()
    text = Window.partitionBy("k1", "k2").orderBy("start")
    beside = whole.select("d1", "d2", "n", *[F.when(touch, f(F.col(c)).over(text)).alias(f"{side}{c}") for side, f, touch in (
        ("next_", F.lead, F.lead("start").over(text) == F.col("start") + F.col("n")), ("last_", F.lag, F.lag(F.col("start") + F.col("n")).over(text) == F.col("start"))) for c in ("d1", "d2")])
    only = [F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c)).alias(c) for c in ("next_d1", "next_d2", "last_d1", "last_d2")]
    near = written(beside.groupBy("d1", "d2").agg(F.min("n").cast("long").alias("n"), *only), "neighbours")
    a = near.where("next_d1 is not null and next_d2 is not null").select("d1", "d2", F.col("next_d1").alias("e1"), F.col("next_d2").alias("e2"))
    b = near.where("last_d1 is not null and last_d2 is not null").select(F.col("last_d1").alias("d1"), F.col("last_d2").alias("d2"), F.col("d1").alias("e1"), F.col("d2").alias("e2"))
    links = a.join(b, ["d1", "d2", "e1", "e2"]).where("d1 <> e1 or d2 <> e2")
    # each stretch that has one before it points there, and each round as far again; the first ones point to themselves
    ahead = written(links.select(F.col("e1").alias("d1"), F.col("e2").alias("d2"), F.col("d1").alias("p1"), F.col("d2").alias("p2")), "ahead")
    heads = ahead.select(F.col("p1").alias("d1"), F.col("p2").alias("d2")).join(ahead.select("d1", "d2"), ["d1", "d2"], "left_anti")
    state = written(heads.select("d1", "d2", F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.lit(True).alias("end")).unionByName(ahead.select("*", F.lit(False).alias("end"))), "reach")
    settled = -1
    while (now := state.where("end").count()) != settled:  # what is in a ring never settles, and stays as it is
        settled, before = now, state
        onward = before.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("end").alias("ended"))
        moved = before.where("not end").join(onward, ["p1", "p2"]).select("d1", "d2", F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.col("ended").alias("end"))
        state = written(before.where("end").unionByName(moved), "reach")
        discard(before)
    placed = state.where("end").join(near.select("d1", "d2", "n"), ["d1", "d2"])
    heads = written(placed.groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.sum("n").alias("edges")), "heads")
    members = written(state.where("end and (d1 <> p1 or d2 <> p2)").select("d1", "d2"), "members")
    discard(near, ahead, state)
    return heads, members


def _at_source(batches):
    """128 bits of the words of long paths, read at their sources."""
    for batch in batches:
        asked = batch.column("asked")
        sizes = asked.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        edges, flat = np.concatenate([[0], np.cumsum(sizes)]), asked.flatten()
        d1, d2, start, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
        out: list[bytes] = []
        for i, text in enumerate(batch.column("text").to_pylist()):
            data, begin, end, _, _ = spelled(text.encode("utf-8", "replace"))
            out += [data[begin[s] : end[s + m + LENGTH - 2]] for s, m in zip(start[edges[i] : edges[i + 1]], n[edges[i] : edges[i + 1]])]
        w1, w2 = digests(out)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d1, d2, w1, w2)], ["d1", "d2", "w1", "w2"])


def spans_of(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """k1, k2, spans: (start, mask) of single stretches; (start, edges, w1, w2) of long paths, with what their words must be. Written."""
    heads, members = compacted(repeats)
    single = repeats.join(members, ["d1", "d2"], "left_anti").join(heads, ["d1", "d2"], "left")
    single = written(single.select("k1", "k2", "start", "mask", "d1", "d2", "edges"), "single")
    sources = single.where("edges is not null").groupBy("d1", "d2").agg(F.min(F.struct("k1", "k2", "start", "edges")).alias("own"))
    asked = sources.groupBy("own.k1", "own.k2").agg(F.collect_list(F.struct("d1", "d2", "own.start", "own.edges")).alias("asked"))
    words_ = written(rows.join(asked, ["k1", "k2"]).mapInArrow(_at_source, "d1 long, d2 long, w1 long, w2 long").distinct(), "sources")
    all_ = single.join(words_, ["d1", "d2"], "left")
    spans = written(all_.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "mask", "edges", "w1", "w2")).alias("spans")), "spans")
    discard(heads, members, single, words_)
    return spans


def _runs(stay: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """First and last byte of each run of words that stay."""
    step = np.diff(np.concatenate([[0], stay.astype(np.int8), [0]]))
    return list(zip(begin[np.flatnonzero(step == 1)].tolist(), end[np.flatnonzero(step == -1) - 1].tolist()))


def _finish(texts: bool):
    def one(text: str, spans: dict):
        data, begin, end, _, _ = spelled(text.encode("utf-8", "replace"))
        long = np.flatnonzero(spans["edges"])
        gone = anchors.covered(len(begin), LENGTH, LONGEST, *(np.delete(spans[c], long) for c in ("start", "mask")))
        for i in long:
            a, b = spans["start"][i], spans["start"][i] + spans["edges"][i] + LENGTH - 1
            if [int(x[0]) for x in digests([data[begin[a] : end[b - 1]]])] == [spans["w1"][i], spans["w2"][i]]:
                gone[a:b] = True
        kept = b" ".join([data[a:b] for a, b in _runs(~gone, begin, end)])
        return (len(begin), int(gone.sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "replace")] if texts else []))

    return one


def dedup(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if ``texts``, kept of every row.

    Words covered by a run of 35 words that also starts anywhere else are removed, every occurrence of it. Null is
    empty; repeated rows, and rows without doc_id, are documents like others.
    """
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    rows = anchors.rows_of(docs)
    repeats = repeated_edges(rows)
    spans = spans_of(rows, repeats)
    discard(repeats)
    return anchors.finished(rows, spans, _finish(texts), schema)
