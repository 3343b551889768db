"""Substring dedup over bytes by external induced sorting of suffixes (in the way of Bingmann, Fischer, Osipov 2013).

Only sampled suffixes are sorted directly: as S* suffixes are minima among their neighbours, a sampled suffix is, by a
hash of its first ANCHOR bytes, the smallest of those that start in some window of LENGTH bytes and still have ANCHOR bytes
of it (about one of fourteen). A sampled suffix travels as a tuple: the bytes to its right that its windows need, those to its
left, document and place. Tuples are dealt by their first ANCHOR bytes and sorted by their right bytes with Spark's
external sort, whose spilled runs and merge are the disk-backed priority queue; no task holds its shard.

A task reads the sorted tuples as a stream, run by run of equal first bytes. It takes the common-prefix values of
neighbours, and induces from the order of the suffixes at p that of the suffixes at p - 1, from that the one at p - 2 and
so on: by the byte before, ties by the order there is; the common prefix of two such neighbours is one more than the
least value between them before. Suffixes with a common prefix of LENGTH bytes are equal windows: bytes are compared
throughout, and hashes only choose samples and tasks.

Tuples of anchors that no second document holds are not sent at all (see anchors.py). Of anchors of very many rows the windows
are grouped one by one, with partial aggregation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, words
from .common import discard, written

LENGTH = 50
ANCHOR = 24
#: Windows that one sampled suffix can stand for.
LONGEST = LENGTH - ANCHOR + 1
CHUNK = 1 << 15
RUN_TUPLES = 50_000
HELD_BYTES = 1 << 20
#: Rounds over the anchors, each with its share of the tuples: what they take of the disks at once.
ROUNDS = 2
PLACE_BITS = np.uint64(21)
TUPLE = "right binary, left binary, doc_id long, uid long, start long"
CUTS = "uid long, k1 long, k2 long, doc_id long, body binary, cuts array<binary>"
HIT = "uid long, start long, mask long"


def anchor_hashes(data: bytes) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place on. It chooses samples and tasks only, so a weak one costs work, not results."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    eight = eight ^ (eight >> np.uint64(29))
    h = eight[:-16] * words.BASE
    h += eight[8:-8] * words.MIX_A
    h += eight[16:] * words.MIX_B
    h ^= h >> np.uint64(32)
    h *= words.BASE
    return h


def sampled(blocks: list[bytes]):
    """Of texts: their bytes end to end, and for each sampled suffix its text, first window, number of windows, place and anchor.

    First window and place count from the first byte of all texts. Windows across two texts have no suffix.
    """
    data = b"".join(blocks)
    a = np.frombuffer(data, np.uint8)
    n = len(a) - LENGTH + 1
    if n < 1:
        e = np.zeros(0, np.int64)
        return a, e, e, e, e, e.astype(np.uint64)
    anchor = anchor_hashes(data)
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    place = (anchors.window_min((anchor & ~low) | np.arange(len(anchor), dtype=np.uint64), LONGEST)[:n] & low).astype(np.int64)
    ends = np.cumsum([len(b) for b in blocks])
    inside = np.ones(n, bool)
    for e in ends.tolist():
        inside[max(0, e - LENGTH + 1) : e] = False
    moved = place[1:] != place[:-1]
    new = np.flatnonzero(inside & np.append(True, moved | ~inside[:-1]))
    stop = np.flatnonzero(inside & np.append(moved | ~inside[1:], True))
    text = np.searchsorted(ends, new, "right")
    return a, text, new, stop - new + 1, place[new], anchor[place[new]]


def batches(texts: list[str | bytes | None]):
    """(first text, texts, bytes of each, place of the first in its text): a text of more than CHUNK bytes comes in chunks."""
    run: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        data = t if isinstance(t, bytes) else (t or "").encode("utf-8", "replace")
        if run and size + len(data) > CHUNK:
            yield i - len(run), len(run), run, 0
            run, size = [], 0
        if len(data) <= CHUNK:
            run.append(data)
            size += len(data)
        else:
            for s in range(0, len(data) - LENGTH + 1, CHUNK):
                yield i, 1, [data[s : s + CHUNK + LENGTH - 1]], s
    if run:
        yield len(texts) - len(run), len(run), run, 0


def cut(texts: list[str | None]):
    for first, n, blocks, _ in batches(texts):
        _, text, start, _, _, anchor = sampled(blocks)
        yield first, n, text, anchor, np.zeros(len(start), bool)


def _slices(a: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Bytes of ``a`` from each start on, as a column."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    flat = a[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])


def _cuts(batches_):
    """Of each text with its lists of anchors: place, first window and number of windows of the sampled suffixes that are in them, for each round, then for hot anchors."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches_:
        lists = [anchors.wanted(batch, which) for which in ("anchors", "hot")]
        found = [[[] for _ in range(ROUNDS + 1)] for _ in range(batch.num_rows)]
        for first, n, blocks, base in batches([unpack(b) for b in batch.column("body").to_pylist()]):
            _, text, start, size, place, anchor = sampled(blocks)
            begin = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
            for hot, (edges, known) in enumerate(lists):
                if not len(known):
                    continue
                at = anchors.chosen(edges, known, first, n, text, anchor)
                turn = np.full(len(at), ROUNDS) if hot else (anchor[at] % np.uint64(ROUNDS)).astype(np.int64)
                order = np.lexsort((turn, text[at]))
                at, key = at[order], (text[at] * (ROUNDS + 1) + turn)[order]
                three = np.array([place[at], start[at], size[at]]) + np.array([base - begin[text[at]], base - begin[text[at]], np.zeros(len(at), np.int64)])
                edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else []
                for a, b in zip(edge, [*edge[1:], len(key)]):
                    found[first + int(key[a]) // (ROUNDS + 1)][int(key[a]) % (ROUNDS + 1)].append(three[:, a:b])
        cuts = [[np.concatenate(x, 1).astype(np.int32).tobytes() if x else b"" for x in row] for row in found]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "k1", "k2", "doc_id", "body")), pa.array(cuts, pa.list_(pa.binary()))], [f.split()[0] for f in CUTS.split(", ")])


def _tuples(turn: int):
    """The tuples of the sampled suffixes of a round."""

    def run(batches_):
        unpack = zstandard.ZstdDecompressor().decompress
        names = [f.split()[0] for f in TUPLE.split(", ")]

        def out(blocks, cuts, uid, did):
            sizes = [c.shape[1] for c in cuts]
            place, start, size = np.concatenate(cuts, 1).astype(np.int64)
            of = np.repeat(np.arange(len(blocks)), sizes)
            begin = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])[of]
            a = np.frombuffer(b"".join(blocks), np.uint8)
            right = _slices(a, begin + place, start + size - 1 + LENGTH - place)
            columns = [right, _slices(a, begin + start, place - start), pa.array(np.array(did)[of]), pa.array(np.array(uid)[of]), pa.array(start)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches_:
            uid, did = anchors.longs(batch, "uid", "doc_id")
            held, size = ([], [], [], []), 0
            for i, (body, cuts) in enumerate(zip(batch.column("body"), batch.column("cuts").to_pylist())):
                if not cuts[turn]:
                    continue
                three = np.frombuffer(cuts[turn], np.int32).reshape(3, -1)
                text = unpack(body.as_py())
                for s in range(0, three.shape[1], RUN_TUPLES):  # a text of very many tuples comes in parts
                    for column, value in zip(held, (text, three[:, s : s + RUN_TUPLES], uid[i], did[i])):
                        column.append(value)
                    size += len(text)
                    if size >= HELD_BYTES:
                        yield out(*held)
                        held, size = ([], [], [], []), 0
            if held[0]:
                yield out(*held)

    return run


def _matrix(column: pa.Array, width: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each value in rows of ``width``, padded with zeros (``backwards``: from the last byte on), and their lengths."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    at = offsets[1:, None] - 1 - np.arange(width) if backwards else offsets[:-1, None] + np.arange(width)
    inside = np.arange(width) < size[:, None]
    return np.where(inside, np.append(data, np.uint8(0))[np.where(inside, at, 0)], np.uint8(0)), size


def least_between(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest of v[low : high] for each pair of places, low < high."""
    table, span = [v], 1
    widest = int((high - low).max()) if len(low) else 0
    while span * 2 <= widest:
        table.append(np.minimum(table[-1][:-span], table[-1][span:]))
        span *= 2
    out = np.empty(len(low), v.dtype)
    level = np.log2(np.maximum(high - low, 1)).astype(int)
    for k in range(len(table)):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[k][low[at]], table[k][high[at] - (1 << k)])
    return out


def common_prefixes(right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the row before; 0 for the first."""
    differ = right[1:] != right[:-1]
    same = np.where(differ.any(1), differ.argmax(1), right.shape[1])
    return np.concatenate([[0], np.minimum(same, np.minimum(size[1:], size[:-1]))]) if len(right) else np.zeros(0, np.int64)


def induced(right: np.ndarray, n_right: np.ndarray, left: np.ndarray, n_left: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For tuples sorted by their right bytes: bit i of mask says that window i also starts in a smaller document.

    ``left`` has the bytes to the left, nearest first. Window i starts n_left - i bytes to the left of the sampled suffix.
    """
    mask = np.zeros(len(doc), np.int64)
    order, lcp = np.arange(len(doc)), common_prefixes(right, n_right)
    for back in range(LONGEST):
        if back:  # the suffixes one byte further to the left, from the order and common prefixes of the last ones
            have = np.flatnonzero(n_left[order] >= back)
            by = left[order[have], back - 1]
            sort = np.argsort(by, kind="stable")
            at = have[sort]
            same = np.append(False, by[sort][1:] == by[sort][:-1])
            common = np.zeros(len(at), np.int64)
            again = np.flatnonzero(same)
            common[again] = 1 + least_between(lcp, at[again - 1] + 1, at[again] + 1)
            order, lcp = order[at], common
        if not len(order):
            break
        first = np.flatnonzero(lcp < LENGTH)
        least = np.minimum.reduceat(doc[order], first)
        hit = np.repeat(least, np.diff(np.append(first, len(order)))) < doc[order]
        own = order[hit]
        mask[own] |= np.int64(1) << (n_left[own] - back)
    return mask


def _judged(batches_):
    """Reads tuples sorted by right bytes, in runs that end where the first ANCHOR bytes change, and gives what is repeated."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        column = lambda c: t[c].chunk(0) if t[c].num_chunks else pa.array([], t[c].type)
        (right, n_right), (left, n_left) = _matrix(column("right"), LENGTH, False), _matrix(column("left"), LONGEST, True)
        mask = induced(right, n_right, left, n_left, t["doc_id"].to_numpy())
        at = np.flatnonzero(mask)
        columns = [pa.array(t[c].to_numpy()[at]) for c in ("uid", "start")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(mask[at])], ["uid", "start", "mask"])

    for batch in batches_:
        held.append(batch)
        size += batch.num_rows
        if size < RUN_TUPLES:
            continue
        t = pa.Table.from_batches(held)
        head, _ = _matrix(t["right"].combine_chunks() if t["right"].num_chunks == 1 else pa.concat_arrays(t["right"].chunks), ANCHOR, False)
        last = np.flatnonzero((head != head[-1]).any(1))
        if len(last):
            done = int(last[-1]) + 1
            yield out(t.slice(0, done))
            held, size = t.slice(done).to_batches(), t.num_rows - done
        else:
            held = t.to_batches()
    if held:
        yield out(pa.Table.from_batches(held))


def _windows(batches_):
    """The windows of tuples, one by one."""
    for batch in batches_:
        right, left, start = batch.column("right").to_pylist(), batch.column("left").to_pylist(), anchors.longs(batch, "start")[0]
        own, at, window = [], [], []
        for i, (r, x) in enumerate(zip(right, left)):
            whole = x + r
            n = len(whole) - LENGTH + 1
            own += [i] * n
            at += range(n)
            window += [whole[k : k + LENGTH] for k in range(n)]
        take = pa.array(np.array(own, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(window, pa.binary()), *(batch.column(c).take(take) for c in ("doc_id", "uid")), pa.array(start[np.array(own, int)] if own else start[:0]), pa.array(1 << np.array(at, np.int64))], ["window", "doc_id", "uid", "start", "bit"])


def repeated_windows(rows: DataFrame) -> DataFrame:
    """k1, k2, spans of the texts that hold a string of LENGTH bytes of an earlier document. Written."""
    met = anchors.repeated_anchors(rows, cut, earlier=True)
    # texts meet their lists once, and are sampled for all rounds at once
    texts = written(anchors.compressed(rows).join(met, ["k1", "k2"]).mapInArrow(_cuts, CUTS), "cuts")
    some_hot, hits = not met.where(F.size("hot") > 0).isEmpty(), None
    discard(met)
    for r in range(ROUNDS):
        found = texts.select("doc_id", "uid", "body", "cuts").mapInArrow(_tuples(r), TUPLE)
        part = found.repartition(F.xxhash64(F.substring("right", 1, ANCHOR))).sortWithinPartitions("right").mapInArrow(_judged, HIT)
        part = written(part, "hits")
        hits = part if hits is None else hits.unionByName(part)
    if some_hot:
        each = texts.select("doc_id", "uid", "body", "cuts").mapInArrow(_tuples(ROUNDS), TUPLE).mapInArrow(_windows, "window binary, doc_id long, uid long, start long, bit long")
        least = each.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
        least = written(least, "least")  # written, so that the join can split a very common window
        hits = hits.unionByName(each.join(least, "window").where("least < doc_id").groupBy("uid", "start").agg(F.bit_or("bit").alias("mask")))
    named = texts.groupBy("uid").agg(F.first("k1").alias("k1"), F.first("k2").alias("k2"))  # rows alike are several texts of one uid
    spans = hits.groupBy("uid").agg(F.collect_set(F.struct("start", "mask")).alias("spans")).join(named, "uid").select("k1", "k2", "spans")
    spans = written(spans, "spans")
    discard(texts)
    return spans


def _finish(texts: bool):
    def one(text: str, spans: dict):
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        gone = anchors.covered(len(data), LENGTH, LONGEST, spans["start"], spans["mask"])
        runs = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
        kept = data[~gone].tobytes()
        return (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), *([kept] if texts else []))

    return one


def dedup(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if ``texts``, kept (binary) of every row.

    Bytes covered by a 50-byte string that also starts in a document of smaller doc_id are removed. Null is empty.
    A row without doc_id removes nothing and keeps all; rows that share a doc_id remove nothing from each other.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    rows = anchors.rows_of(docs)
    return anchors.finished(rows, repeated_windows(rows.where("doc_id is not null")), _finish(texts), schema)
