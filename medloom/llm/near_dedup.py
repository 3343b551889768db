"""Near-dedup by improved consistent weighted sampling (Ioffe 2010) over TF-IDF shingles of five words.

Weights. A shingle's weight is its count in the document times (IDF_BASE + the mean idf of its words). Document
frequencies are counted for words, over all documents, in a table of fixed size: a word's frequency is a fraction
that does not change with the size of the corpus, and a shingle's own frequency would lower its weight in a
large family of near copies and split that family. IDF_BASE is the smoothing constant.

Candidates. SAMPLES consistent samples a document are cut into bands; documents that agree in all samples of a
band share a bucket. In each bucket all are compared with the one of smallest doc_id; after the links found so are
joined to components, every document outside that one's component is compared with the likeliest of other components in
its bucket; and after those links, what is still outside with all of them. So every pair that shares a bucket is compared, or is already in one component.

Verification. Pairs whose samples agree in MIN_AGREE places or more are verified by the exact weighted Jaccard
similarity of their whole texts. Where a bucket still has several components, its documents get FINE further
samples, and only pairs that agree in FINE_AGREE of them are verified: a large family of loose copies has very
many pairs a little under the limit. A pair of similarity 0.8 is lost (no shared bucket, or too few places agree)
with a probability under 0.0004.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import written
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
SAMPLES = 64
BAND = 4
MIN_AGREE = 36
FINE = 512
FINE_AGREE = 376
CACHED = 2_000_000
DF_BITS = 16
IDF_BASE = 8.0
SEED = 2
BLOCK_ROWS = 2048
CELL_ROWS = 20_000
ELEMENTS = 1 << 15


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold a word of each hash bucket, over all documents, and the number of documents."""

    def count(batches):
        total, n = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in batches:
            for _, k, data, begin in words.batches(batch.column("text").to_pylist()):
                h, starts, _ = words.word_hashes(data)
                doc = np.searchsorted(begin, starts, "right") - 1
                seen = np.unique((doc.astype(np.uint64) << np.uint64(DF_BITS)) | (h >> np.uint64(64 - DF_BITS)))
                total += np.bincount((seen & np.uint64((1 << DF_BITS) - 1)).astype(np.int64), minlength=1 << DF_BITS)
                n += k
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": np.append(at, -1), "n": np.append(total[at], n)})

    seen = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(1 << DF_BITS)
    real = seen[seen["bucket"] >= 0]
    table[real["bucket"].to_numpy()] = real["n"].to_numpy()
    return table, int(seen.loc[seen["bucket"] < 0, "n"].sum())


def idf_table(frequencies: np.ndarray, n: int) -> np.ndarray:
    return np.log((n + 1) / (frequencies + 1)).astype(np.float32)


def shingles(data: bytes, begin: np.ndarray, idf: np.ndarray):
    """Of texts joined by spaces: (text, shingle, log weight) of each distinct shingle, sorted by text and shingle.

    A text of fewer than five words has one shingle of all its words; one without words has none. Also a
    128-bit hash of each text's words in order, and their number.
    """
    h, starts, _ = words.word_hashes(data)
    doc = np.searchsorted(begin, starts, "right") - 1
    count = np.bincount(doc, minlength=len(begin))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    rare = idf[h >> np.uint64(64 - DF_BITS)].astype(np.float64)
    place = np.arange(len(h)) - first[doc]
    total = np.concatenate([[0.0], np.cumsum(rare)])
    n = np.minimum(count, SHINGLE)[doc]
    at = np.flatnonzero(place + n <= count[doc])
    key = np.zeros(len(at), np.uint64)
    for i in range(SHINGLE):
        use = n[at] > i
        key = np.where(use, words.mix(key * words.BASE + h[np.minimum(at + i, max(len(h) - 1, 0))]), key) if len(at) else key
    mean = (total[at + n[at]] - total[at]) / n[at]
    weight = np.log(IDF_BASE + np.round(mean, 6))
    order = np.lexsort((key, doc[at]))
    key, own, weight = key[order], doc[at][order], weight[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    where = np.flatnonzero(fresh)
    times = np.diff(np.append(where, len(key)))
    x = words.mix(h ^ words.mix(place.astype(np.uint64)))
    y = words.mix(h + words.mix(place.astype(np.uint64) + np.uint64(1 << 40)))
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(z, dtype=np.uint64)]) for z in (x, y)]
    exact = [s[first + count] - s[first] for s in sums]
    return own[where], key[where], (weight[where] + np.log(times)).astype(np.float32), exact, count


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at (i + 0.5) / n."""
    x = np.concatenate([[0], np.geomspace(1e-5, 40, 400_000)])
    return np.interp((np.arange(n) + 0.5) / n, 1 - (1 + x) * np.exp(-x), x)


_tables: list[np.ndarray] = []


def samples(own: np.ndarray, key: np.ndarray, log_weight: np.ndarray, n: int, m: int = SAMPLES, seed: int = SEED) -> np.ndarray:
    """(n, m) consistent weighted samples: two texts agree in a place with the probability of their weighted Jaccard similarity."""
    if not _tables:
        r = _gamma_quantiles(1 << 16)
        _tables[:] = [r.astype(np.float32), (1 / r).astype(np.float32), np.log(r).astype(np.float32)]
    rate, inverse, log_c = _tables
    multipliers = words.mix(np.arange(1, m + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)
    out = np.zeros((n, m), np.int32)
    edges = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
    ends = np.append(edges[1:], len(own))
    a = 0
    while a < len(edges):
        b = max(a + 1, int(np.searchsorted(ends, edges[a] + ELEMENTS, "right")))
        low, high = edges[a], ends[b - 1]
        k, s = key[low:high], log_weight[low:high]
        cuts, sizes = edges[a:b] - low, ends[a:b] - edges[a:b]
        for j in range(m):
            x = k * multipliers[j]
            x ^= x >> np.uint64(32)
            x *= words.MIX_A
            i = (x >> np.uint64(48)).astype(np.int32)
            beta = ((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2**-16)
            t = np.floor(s * inverse[i] + beta)
            cost = log_c[((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int32)] - rate[i] * (t - beta + np.float32(1))
            hit = np.flatnonzero(cost == np.repeat(np.minimum.reduceat(cost, cuts), sizes))
            row = np.searchsorted(cuts, hit, "right") - 1
            one = np.append(True, row[1:] != row[:-1])
            hit, row = hit[one], row[one]
            sample = words.mix(k[hit] + words.mix(t[hit].astype(np.int64).astype(np.uint64) + np.uint64(j)))
            out[own[low:high][cuts[row]], j] = (sample >> np.uint64(32)).astype(np.uint32).view(np.int32)
        a = b
    return out


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, k1, k2, x, y (the hash of the words), n_words, sig (array of samples) of every row of ``keyed``."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        for batch in batches:
            for first, n, data, begin in words.batches(batch.column("text").to_pylist()):
                own, key, weight, exact, count = shingles(data, begin, shared.value)
                sig = samples(own, key, weight, n)
                offsets = pa.array(np.arange(0, sig.size + 1, SAMPLES, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, n) for c in ("doc_id", "k1", "k2")), pa.array(exact[0].view(np.int64)), pa.array(exact[1].view(np.int64)), pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(sig.ravel()))],
                    ["doc_id", "k1", "k2", "x", "y", "n_words", "sig"],
                )

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long, x long, y long, n_words long, sig array<int>")


def _names() -> list[Column]:
    """k1, k2: 128 bits of doc_id and text that name a row of a table; rows alike in both are alike."""
    id_ = F.col("doc_id").cast("long")
    return [F.xxhash64(id_, "text").alias("k1"), F.xxhash64(F.lit(2), "text", id_).alias("k2")]


def finer(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """rep, fine: FINE further samples of each text (rep, text), 16 bits each."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        for batch in batches:
            ids = batch.column("rep")
            for first, n, data, begin in words.batches(batch.column("text").to_pylist()):
                own, key, weight, _, _ = shingles(data, begin, shared.value)
                fine = samples(own, key, weight, n, FINE, SEED + 1).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), pa.array([row.tobytes() for row in fine], pa.binary())], ["rep", "fine"])

    return texts.select("rep", "text").mapInArrow(run, "rep long, fine binary")


def weighted_jaccard(pairs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(a, b, text_a, text_b) -> (a, b, similarity)."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        known: dict[int, tuple] = {}  # weights of documents met before, CACHED shingles of them at most
        size = 0
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")]
            for a, b, text_a, text_b in zip(*columns):
                for i, text in ((a, text_a), (b, text_b)):
                    if i not in known:
                        if size > CACHED:
                            known, size = {k: known[k] for k in (a, b) if k in known}, 0
                        known[i] = _weights(text, shared.value)
                        size += len(known[i][0])
                (k, v, total), (m, w, other) = known[a], known[b]
                at = np.searchsorted(m, k)
                at[at == len(m)] = 0
                both = np.flatnonzero(m[at] == k) if len(m) else at[:0]
                least = np.minimum(v[both], w[at[both]]).sum()
                out.append(least / max(total + other - least, 1e-12))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def _weights(text: str, idf: np.ndarray):
    _, key, weight, _, _ = shingles((text or "").encode("utf-8", "replace"), np.zeros(1, int), idf)
    weight = np.exp(weight.astype(np.float64))
    return key, weight, weight.sum()


def _strangers(best: bool):
    """Pairs of a stray and a row of its block in another component whose samples agree as those of similar texts do.

    ``best``: of each stray in a block only the pair whose samples agree most. Otherwise all, each from the first band that
    the two share; their components differ, so one of them is a stray there.
    """

    def run(rows: pa.Table, strays: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        if rows.num_rows and strays.num_rows:
            rows, strays = rows.sort_by("block"), strays.sort_by("block")
            rb, sb = rows["block"].to_numpy(), strays["block"].to_numpy()
            fine = lambda t: np.frombuffer(b"".join(t["fine"].to_pylist()), np.uint16).reshape(-1, FINE)
            columns = lambda t: (t["rep"].to_numpy(), t["comp"].to_numpy(), t["sig"].combine_chunks().flatten().to_numpy().reshape(-1, SAMPLES), fine(t))
            (rid, rc, rs, rf), (sid, sc, ss, sf), band = columns(rows), columns(strays), rows["band"].to_numpy()
            blocks, start = np.unique(rb, return_index=True)
            for block, a, b in zip(blocks, start, np.append(start[1:], len(rb))):
                for i in range(np.searchsorted(sb, block, "left"), np.searchsorted(sb, block, "right")):
                    near = np.flatnonzero(((rs[a:b] == ss[i]).sum(1) >= MIN_AGREE) & (rc[a:b] != sc[i])) + a
                    agree = (rf[near] == sf[i]).sum(1)
                    near, agree = near[agree >= FINE_AGREE], agree[agree >= FINE_AGREE]
                    if best:
                        near = near[np.argsort(-agree, kind="stable")[:1]]
                    else:
                        shared = (rs[near] == ss[i]).reshape(-1, SAMPLES // BAND, BAND).all(2)
                        near = near[shared.argmax(1) == band[a]]
                    found.append(np.stack([np.minimum(rid[near], sid[i]), np.maximum(rid[near], sid[i])]))
        pairs = np.unique(np.concatenate(found, 1), axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pairs[0].astype(np.int64), "b": pairs[1].astype(np.int64)})

    return run


def _groups(docs: DataFrame, similarity: float) -> DataFrame:
    """As near_groups, with k1 and k2 of each row. A text (that is, its words) is known by a number, ``rep``, whatever its doc_ids."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_names())
    idf = idf_table(*document_frequencies(docs))
    signed = written(signatures(keyed, idf).withColumn("row", F.monotonically_increasing_id()), "signatures")
    real = signed.where("doc_id is not null and n_words > 0")
    reps = real.groupBy("x", "y").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("own"), F.min_by("sig", "doc_id").alias("sig"))
    # numbers in the order of doc_id: the first document of a family leads it, as a rule the one that the others were made of
    reps = reps.select("x", "y", "own.*", "sig").repartitionByRange("doc_id", "k1").sortWithinPartitions("doc_id", "k1", "k2")
    reps = written(reps.select("x", "y", "k1", "k2", "sig", F.monotonically_increasing_id().alias("rep")), "reps")
    bands = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES // BAND - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * BAND + 1, BAND)))
    rows = written(reps.select("rep", F.posexplode(bands).alias("band", "bucket")), "bands")
    leaders = written(rows.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1"), "leaders")
    rows = written(rows.join(leaders, "bucket"), "buckets")

    ids = rows.select("rep").distinct().join(reps.select("rep", "k1", "k2"), "rep")
    texts = written(keyed.select("k1", "k2", "text").join(ids, ["k1", "k2"]).select("rep", "text").dropDuplicates(["rep"]), "texts")
    sigs = reps.select("rep", "sig")

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
        return written(weighted_jaccard(both, idf).where(F.col("similarity") >= similarity).select("a", "b"), "links")

    stars = rows.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    stars = stars.join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b").join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
    links = linked(written(stars.where(agree >= MIN_AGREE).select("a", "b"), "stars"))
    fine = None
    for best in (True, False):
        root = written(components(links), "roots")
        placed = rows.join(root.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("comp", F.coalesce("root", "rep"))
        heads = root.select(F.col("node").alias("leader"), F.col("root").alias("head"))
        placed = placed.join(heads, "leader", "left").select("band", "bucket", "rep", "n", "comp", F.coalesce("head", "leader").alias("main"))
        mixed = written(placed.groupBy("bucket").agg(F.count_if(F.col("comp") != F.col("main")).alias("strays")).where("strays > 0"), "several")
        placed = written(placed.join(mixed, "bucket"), "mixed")
        cells = max(1, -(-placed.count() // CELL_ROWS))
        if fine is None:  # buckets of several components only get fewer
            fine = written(finer(texts.join(placed.select("rep").distinct(), "rep", "left_semi"), idf), "finer")
        placed = written(placed.join(sigs, "rep").join(fine, "rep"), "compared")
        # a block is a part of a bucket's rows against a part of its strays, each of BLOCK_ROWS or so
        splits, own = F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("strays") / BLOCK_ROWS)
        part = lambda n: F.pmod(F.xxhash64("rep"), n)
        all_ = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        cell = F.pmod(F.xxhash64("block"), F.lit(cells)).alias("cell")
        members = placed.select("bucket", "band", "rep", "comp", "sig", "fine", part(splits).alias("i"), all_(own).alias("j"))
        members = members.select(F.xxhash64("bucket", "i", "j").alias("block"), "band", "rep", "comp", "sig", "fine").select(cell, "*")
        strays = placed.where("comp <> main").select("bucket", "rep", "comp", "sig", "fine", all_(splits).alias("i"), part(own).alias("j"))
        strays = strays.select(F.xxhash64("bucket", "i", "j").alias("block"), "rep", "comp", "sig", "fine").select(cell, "*")
        more = members.groupBy("cell").cogroup(strays.groupBy("cell")).applyInArrow(_strangers(best), "a long, b long").distinct()
        links = links.unionByName(linked(written(more, "strangers")))
    root = written(components(links), "roots")

    found = real.select("doc_id", "k1", "k2", "row", "x", "y").join(reps.select("x", "y", "rep"), ["x", "y"])
    found = found.join(root.select(F.col("node").alias("rep"), "root"), "rep", "left").select("doc_id", "k1", "k2", "row", F.coalesce("root", "rep").alias("class"))
    sizes = written(found.groupBy("class").agg(F.min(F.struct("doc_id", "k1", "k2", "row")).alias("first"), F.count("*").alias("class_size")), "classes")
    found = found.join(sizes, "class").select("doc_id", "k1", "k2", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"))
    alone = signed.where("doc_id is null or n_words = 0").select("doc_id", "k1", "k2", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return found.unionByName(alone)


def near_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size, kept of every row: class_id is the smallest doc_id of its class.

    A class holds documents joined by links of the given similarity or more; texts of the same words are one.
    Rows without doc_id and texts without words (null, empty) are classes of their own, and stay; a null doc_id has
    a null class_id. Rows that share a doc_id and differ in text are compared as other rows are: each is in the class of its
    own text. One row of each class stays: of smallest doc_id; of several rows of that doc_id the one whose names (hashes of doc_id and
    text) are smallest, and of rows alike in both any one. An empty table gives an empty result.
    """
    return _groups(docs, similarity).select("doc_id", "class_id", "class_size", "kept")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The input's columns of the rows that stay, one of each class (see ``near_groups``); rows alike in doc_id and text count as one, whatever their other columns."""
    real = _groups(docs, SIMILARITY).where("doc_id is not null and class_size > 1")
    names = real.groupBy("k1", "k2").agg(F.max("kept").alias("kept"), F.count("*").alias("copies"))
    names = written(names.where("not kept or copies > 1"), "names")
    rows = docs.select(F.struct("*").alias("_row"), *_names())
    stay = rows.join(names.select("k1", "k2"), ["k1", "k2"], "left_anti").select("_row")
    again = names.where("kept").select("k1", "k2")  # rows that occur more than once, and stay once
    if not again.isEmpty():
        stay = stay.unionByName(rows.join(again, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("_row").alias("_row")).select("_row"))
    return stay.select("_row.*")
